"""Party votes in transcripts, read by a line automaton as a segmented fold.

Every line is a call (which begins a vote), a label of a side, a tally, or other.  The last
line that is neither label nor tally is carried along each day (``ordered.carried``), so a
line belongs to a vote's block if that line is a call: a block may be of any length, and
nothing looks ahead.  A block's lines are then folded in order: a label waits for its tally;
a tally stays open until a full stop or until the total that its label declared; without
labels the sides come in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.ordered import carried
from quillspark.operators.parsers import SUBSTANTIVE, question_type

#: How a vote is called, lines that stand among tallies but are none, the labels of the sides, and sides without labels in their order.
CALL = r"(?i)A party vote was called for on the question,\s*(.*)$"
PROSE = r"(?i)^(The result corrected|The bill was divided|The committee divided|A party vote was called)"
LABEL = r"(?i)^(Ayes|Noes|Abstentions?|Abstained)\s+(\d+)$"
SIDES = ("ayes", "noes", "abstentions")
#: Lengths of the longest tally line, heading and verdict.
LONGEST_TALLY, LONGEST_HEADING, LONGEST_VERDICT = 400, 140, 90
_COUNT = r"^(.*?)\s+(\d+)$"
_MEMBER = r"^\p{Lu}[\p{L}\p{N}_’'‑-]{1,24}$"
_BILL = r"[^,]*?\bBill\b(?:\s*\(No \d+\))?"


def clean(line: Column) -> Column:
    """White space of any kind as single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"(?U)\s+", " "))


def segments(line: Column) -> Column:
    """Parts of a tally line between semicolons, or between commas where a number stands before one."""
    parts = F.split(F.regexp_replace(line, r"[. ]+$", ""), ";")
    split = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"\d\s*,"), F.split(p, ",")).otherwise(F.array(p))))
    return F.filter(F.transform(split, lambda p: F.trim(p)), lambda p: p != "")


def _party(segment: Column, parties: dict[str, str] | None) -> Column:
    """The party's short name; NULL for a segment that isn't a known party's count."""
    name = F.nullif(F.regexp_extract(segment, _COUNT, 1), F.lit(""))
    if parties is None:
        return F.when(name.rlike(r"^\p{Lu}"), name)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in parties.items() for x in pair)), name)


def is_tally(line: Column, parties: dict[str, str] | None) -> Column:
    """Whether all parts are counts of known parties or single surnames, one a count at least."""
    parts = segments(line)
    known = lambda p: _party(p, parties).isNotNull()
    whole = F.exists(parts, known) & F.forall(parts, lambda p: known(p) | p.rlike(_MEMBER))
    return (F.length(line) <= LONGEST_TALLY) & ~F.contains(line, F.lit(":")) & ~line.rlike(PROSE) & whole


def tally(parts: Column, parties: dict[str, str] | None, declared: Column) -> Column:
    """struct<parties, members, total, declared_total>: counts of a party that is named twice are
    added up, and each member named alone is one vote."""
    counts = F.filter(F.transform(parts, lambda p: F.struct(_party(p, parties).alias("party"), F.regexp_extract(p, _COUNT, 2).try_cast("int").alias("n"))), lambda c: c["party"].isNotNull())
    names = F.array_distinct(F.transform(counts, lambda c: c["party"]))
    add = lambda cs: F.aggregate(cs, F.lit(0), lambda a, c: a + c["n"])
    members = F.filter(parts, lambda p: ~p.rlike(_COUNT))
    sums = F.map_from_arrays(names, F.transform(names, lambda x: add(F.filter(counts, lambda c: c["party"] == x))))
    return F.struct(sums.alias("parties"), members.alias("members"), (add(counts) + F.size(members)).alias("total"), declared.alias("declared_total"))


def titles(text: Column) -> Column:
    """Titles of the bills that a reference names: without the report of a committee on them, and
    split where one bill's title ends and another's begins."""
    bare = F.regexp_replace(text, r"(?i)^.*?\bCommittee on the\s+", "")
    return F.filter(F.transform(F.split(bare, r"(?<=\bBill)\s+and\s+(?:the\s+)?(?=\p{Lu})"), lambda t: F.trim(t)), lambda t: t.rlike(r"\bBill\b"))


def bills_in_question(question: Column) -> Column:
    return titles(F.regexp_extract(question, rf"(?i)That (?:the )?(\p{{L}}{_BILL})\s+be\b", 1))


def bills_in_heading(line: Column) -> Column:
    stages = "in committee|third reading|second reading|first reading|introduction"
    title = F.regexp_extract(line, rf"^((?:\p{{Lu}})[^:.]{{5,110}}?\bBill\b(?:\s*\(No \d+\))?)(?i:,\s*(?:{stages}))?$", 1)
    return F.when((F.length(line) <= LONGEST_HEADING) & ~line.rlike("(?i)^that "), titles(title)).otherwise(F.array().cast("array<string>"))


def verdict(line: Column) -> Column:
    """agreed or not_agreed of a line that declares how a vote ended; NULL of others."""
    said = (F.length(line) <= LONGEST_VERDICT) & ~F.contains(line, F.lit(":")) & ~line.rlike("(?i)party vote|question is|called for")
    return F.when(said & line.rlike(r"(?i)\b(not agreed to|negatived|lost)\.$"), "not_agreed").when(said & line.rlike(r"(?i)\b(agreed to|read a (first|second|third) time|carried)\.$"), "agreed")


def _fold(block: Column) -> Column:
    """struct<sides, consumed>: tallies of a block, and how many of its lines they took.

    ``block`` holds struct<line, kind, side, declared, parts, votes> in order; the lines behind
    the one that ends the block change nothing.
    """
    side = "struct<side:string,declared:int,parts:array<string>>"
    start = F.struct(
        F.array().cast(f"array<{side}>").alias("sides"), F.lit(None).cast("string").alias("pending"), F.lit(None).cast("int").alias("declared"),
        F.array().cast("array<string>").alias("open"), F.lit(0).alias("votes"), F.lit(0).alias("at"), F.lit(0).alias("consumed"), F.lit(False).alias("over"),
    )

    def step(s: Column, x: Column) -> Column:
        label, counts = x["kind"] == "label", x["kind"] == "tally"
        n, votes = F.size(s["sides"]), s["votes"] + x["votes"]
        complete = x["line"].endswith(".") | F.coalesce(votes >= s["declared"], F.lit(False))
        unnamed = s["pending"].isNull()
        over = s["over"] | ~(label | counts) | (label & (s["pending"].isNotNull() | (F.size(s["open"]) > 0))) | (counts & complete & unnamed & (n >= len(SIDES)))
        parts = F.concat(s["open"], x["parts"])
        name = F.coalesce(s["pending"], F.get(F.array(*map(F.lit, SIDES)), n))
        closed = counts & complete
        new = F.struct(
            F.when(closed, F.concat(s["sides"], F.array(F.struct(name.alias("side"), F.when(~unnamed, s["declared"]).alias("declared"), parts.alias("parts"))))).otherwise(s["sides"]).alias("sides"),
            F.when(label, x["side"]).when(~closed, s["pending"]).alias("pending"),
            F.when(label, x["declared"]).when(~closed, s["declared"]).alias("declared"),
            F.when(closed, F.array().cast("array<string>")).when(counts, parts).otherwise(s["open"]).alias("open"),
            F.when(closed, F.lit(0)).when(counts, votes).otherwise(s["votes"]).alias("votes"),
            (s["at"] + 1).alias("at"),
            F.when(counts, s["at"] + 1).otherwise(s["consumed"]).alias("consumed"),
            F.lit(False).alias("over"),
        )
        stopped = F.struct(*(s[c].alias(c) for c in ("sides", "pending", "declared", "open", "votes", "at", "consumed")), F.lit(True).alias("over"))
        return F.when(over, stopped).otherwise(new)

    return F.aggregate(block, start, step, lambda s: F.struct(s["sides"].alias("sides"), s["consumed"].alias("consumed")))


def division_records(lines: DataFrame, keys: list[str], order: str, line: str, parties: dict[str, str] | None = None) -> DataFrame:
    """A row for each vote that is called: ``keys, division_id, at, question, type, substantive,
    bills, bill_source, ayes, noes, abstentions, result, verdict_line, flags``.

    ``lines`` has a day's lines, told by ``keys``, in the order of ``order`` (unique in a day);
    NULL lines are blank.  ``parties`` gives the short names of the parties as they are written;
    a line that names another isn't a tally.  Without it any capitalised name counts.  A
    question that names no bill is about the last one that a question or a heading of that day
    named.  The totals decide; a verdict right behind the block that disagrees is flagged, as
    are totals that differ from the declared ones and votes without noes or without tallies.
    A tally that never closes is no side.  ``at`` is the call's place in the order.
    """
    text, call = F.col("line"), F.regexp_extract(F.col("line"), CALL, 1)
    side = F.lower(F.regexp_extract(text, LABEL, 1))
    kind = F.when(text.rlike(CALL), "call").when(text.rlike(LABEL), "label").when(is_tally(text, parties), "tally").otherwise("other")
    rows = lines.select(*keys, F.col(order).alias("at"), clean(F.col(line)).alias("line")).select(
        *keys, "at", "line", kind.alias("kind"), F.trim(F.regexp_replace(call, r"[. ]+$", "")).alias("question"),
        F.when(side.startswith("abst"), "abstentions").when(side != "", side).alias("side"), F.regexp_extract(text, LABEL, 2).try_cast("int").alias("declared"),
    )
    parts = F.when(F.col("kind") == "tally", segments(text)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"parts": parts, "votes": F.when(F.col("kind") == "tally", tally(parts, parties, F.lit(None).cast("int"))["total"]).otherwise(0)})
    named = F.when(F.col("kind") == "call", bills_in_question(F.col("question")))
    subject = F.when(F.size(named) > 0, named).when(F.size(bills_in_heading(text)) > 0, bills_in_heading(text))
    mark = F.when(F.col("kind").isin("call", "other"), F.struct("at", (F.col("kind") == "call").alias("is_call")))
    known = carried(rows.withColumn("named", named), keys, ["at"], {"mark": mark, "subject": subject}, strict=True)
    vote = F.when(F.col("kind") == "call", F.col("at")).when(F.col("mark.is_call"), F.col("mark.at"))
    call_of = F.max(F.when(F.col("kind") == "call", F.struct("question", "named", "subject")))
    block = F.array_sort(F.collect_list(F.when(F.col("kind") != "call", F.struct("at", "line", "kind", "side", "declared", "parts", "votes"))))
    found = known.withColumn("vote", vote).where("vote is not null").groupBy(*keys, "vote").agg(call_of.alias("c"), block.alias("block"))
    found = found.withColumn("f", _fold(F.col("block"))).withColumn("verdict_line", F.get(F.col("block"), F.col("f.consumed"))["line"])
    last = lambda name: F.try_element_at(F.filter(F.col("f.sides"), lambda s: s["side"] == name), F.lit(-1))
    found = found.withColumns({name: F.when(last(name).isNotNull(), tally(last(name)["parts"], parties, last(name)["declared"])) for name in SIDES})
    said = verdict(F.col("verdict_line"))
    totals = F.when(F.col("ayes").isNotNull(), F.when(F.col("ayes.total") > F.coalesce("noes.total", F.lit(0)), "agreed").otherwise("not_agreed"))
    any_side, labelled = F.size("f.sides") > 0, F.exists("f.sides", lambda s: s["declared"].isNotNull())
    mismatch = F.exists(F.array(*(F.col(f"{x}.total") != F.col(f"{x}.declared_total") for x in SIDES)), lambda x: F.coalesce(x, F.lit(False)))
    flags = F.array(
        F.when(~any_side, "no_vote_lines"), F.when(mismatch, "tally_mismatch"), F.when(any_side, F.when(labelled, "ayes_labelled").otherwise("ayes_order_inferred")),
        F.when(F.col("ayes").isNotNull() & F.col("noes").isNull(), "unopposed"), F.when(said.isNull() & totals.isNotNull(), "result_from_totals"), F.when(said != totals, "verdict_conflicts_with_totals"),
    )
    own = F.size("c.named") > 0
    number = F.lpad(F.row_number().over(Window.partitionBy(*keys).orderBy("vote")).cast("string"), 3, "0")
    return found.select(
        *keys, F.concat_ws("-", *keys, number).alias("division_id"), F.col("vote").alias("at"), F.col("c.question").alias("question"), question_type(F.col("c.question")).alias("type"),
        question_type(F.col("c.question")).isin(*SUBSTANTIVE).alias("substantive"), F.when(own, F.col("c.named")).otherwise(F.col("c.subject")).alias("bills"),
        F.when(own, "question").when(F.col("c.subject").isNotNull(), "carried_forward").alias("bill_source"), *SIDES,
        F.coalesce(totals, said).alias("result"), F.when(said.isNotNull(), F.col("verdict_line")).alias("verdict_line"), F.filter(flags, lambda f: f.isNotNull()).alias("flags"),
    )
