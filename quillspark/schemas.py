"""Schemas of the datasets, passed to every reader: nothing is inferred."""

from __future__ import annotations

EXAMPLE = (
    "struct<politician:string,statement:string,score:double,prior_score:double,explanation:string,subject:string,subject_name:string,falsification_criterion:string,resolve_by:string,"
    "proposition:string,stance:string,commitment:string,responding_to:string,claim_class:string,confidence_markers:string,quote_check:string>"
)
_TALLY = "struct<parties:map<string,int>,members:array<string>,unresolved_members:array<string>,total:int,declared_total:int>"
_POSITIONS = "map<string,struct<stance:string,support_weight:int,oppose_weight:int>>"

SCHEMAS: dict[str, str] = {
    "article": "headline string, date string, author string, content string, url string, source string",
    "transcript_part": "headline string, date string, author string, content string, url string, source string",
    "roster": "id string, name string, party string, aliases array<string>",
    "division": f"division_id string, date string, parliament int, question string, type string, substantive boolean, bills array<string>, bill_source string, ayes {_TALLY}, noes {_TALLY}, abstentions {_TALLY}, result string, verdict_line string, flags array<string>, hansard_headline string, source_url string",
    "oral_pair": "question_id string, date string, asker string, responder string, question string, answer string, is_primary boolean, supplementary_index int, number int, portfolio string, addressee string, asker_id string, responder_id string, source_url string",
    "written_question": "question_id string, number int, year int, parliament int, asker string, asker_id string, minister string, minister_id string, portfolio string, question string, reply string, answered boolean, attachment_only boolean, attachment_name string, released_date string, url string",
    "bill": "bill_id string, title string, bill_number string, parliament int, bill_type string, status string, current_stage string, outcome string, enacted boolean, act string, description string, member_in_charge string, member_in_charge_id string, select_committees array<string>, dates struct<introduced:string,first_reading:string,select_committee:string,second_reading:string,committee_of_whole_house:string,third_reading:string>, stages array<struct<stage:string,date:string,outcome:string,type:string>>, legislation_url string, url string",
    "proposed_bill": "proposed_id string, title string, parliament int, member string, member_id string, party string, ballot_date string, url string",
    "amendment_paper": "amendment_id string, sop string, bill_title string, title string, parliament int, member string, member_id string, published string, url string",
    "proposition": f"proposition_id string, label string, kind string, bill_id string, bill_type string, outcome string, member_in_charge_id string, description string, first_division string, last_division string, division_ids array<string>, n_divisions int, decisive_stage string, stance_confidence string, party_positions {_POSITIONS}, member_positions {_POSITIONS}",
    "position": "politician_id string, politician string, party string, proposition string, proposition_id string, stance string, quote string, date string, confidence double",
    "window_scores": f"window_id string, date string, window_tokens int, url string, source string, party string, examples_by_attribute map<string,array<{EXAMPLE}>>",
    "qa_score": "question_id string, date string, source string, politician string, politician_id string, asker string, attribute string, score double, explanation string, question string, statement string",
    "usage": "ts timestamp_ntz, label string, model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, cost_usd double, duration_s double, ok boolean",
}
