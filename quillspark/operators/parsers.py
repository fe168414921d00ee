"""Parsers of transcripts: who speaks, and votes with their tallies.

Lines are read in order within a day; a vote is found by its opening line and the lines
after it are joined by number, so a day's text is never gathered in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of questions by the words of the question (in any case), first match wins, and those that decide something.
KINDS = [
    ("third_reading", r"read a third time"),
    ("second_reading", r"read a second time"),
    ("first_reading", r"read a first time"),
    ("closure", r"debate on this question now close|question be now put"),
    ("urgency", r"urgency be accorded|extended sitting"),
    ("committee_report", r"be reported to the House"),
    ("amendment", r"\bamendments?\b.*be agreed to"),
    ("committee", r"\b(clause|Part|Schedule)s?\b.*be agreed to"),
    ("motion", r"That the motion be agreed to"),
]
SUBSTANTIVE = ("first_reading", "second_reading", "third_reading", "committee", "amendment", "motion")
#: Lines after the opening among which a vote's labels, tallies and verdict are looked for.
REACH = 24
CALL = r"(?i)^an? (party|personal) vote was called for"
_LABEL = r"(?i)^(ayes|noes|abstentions?)\b"
_TALLY = r"^\p{Lu}[^.;]*\d+(;[^.;]*\d+)*\.?\s*$"


def speaker_lines(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with ``speaker`` and ``said``: what stands before the first colon outside brackets,
    where it is a name of 2 to 90 characters that begins like one."""
    pattern = r"^((?:[^():]|\([^()]*\)){2,90}?)\s*:\s+(.*)$"
    tag = F.regexp_extract(line, pattern, 1)
    named = tag.rlike(r"^(?:(?:Rt )?Hon |Dr |Mr |Mrs |Ms )*[\p{Lu}][\p{Lu}'’.-]+(?: [\p{Lu}][\p{Lu}'’.-]*)*(?: \([^()]*\))?$")
    return lines.withColumns({"speaker": F.when(named, tag), "said": F.when(named, F.regexp_extract(line, pattern, 2)).otherwise(F.col(line))})


def question_type(question: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(KINDS):
        out = F.when(question.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def bill_title(question: Column) -> Column:
    """The bill that a question names."""
    title = F.regexp_extract(question, r"((?:\p{Lu}[\p{L}'’-]*(?: \([^)]*\))?,? (?:(?:and|of|for|to|the|on|in) )*)+Bill)\b", 1)
    return F.nullif(F.regexp_replace(title, "^(?:That|The) (?:the )?", ""), F.lit(""))


def tally(line: Column, declared: Column) -> Column:
    """struct<parties, members, total, declared_total> of "Party 12; Independents: Name, Name 2." """
    parts = F.filter(F.split(F.regexp_replace(line, r"\.\s*$", ""), r"\s*;\s*"), lambda p: p.rlike(r"\d"))
    name = lambda p: F.trim(F.regexp_extract(p, r"^\s*([^:\d]+?)\s*(?::|\d)", 1))
    count = lambda p: F.regexp_extract(p, r"(\d+)\s*$", 1).try_cast("int")
    members = F.flatten(F.transform(F.filter(parts, lambda p: p.contains(":")), lambda p: F.transform(F.split(F.regexp_extract(p, r":\s*(.*?)\s*\d*\s*$", 1), r"\s*,\s*"), F.trim)))
    return F.struct(
        F.map_from_entries(F.transform(parts, lambda p: F.struct(name(p), count(p)))).alias("parties"),
        F.filter(members, lambda m: m != "").alias("members"),
        F.aggregate(parts, F.lit(0), lambda a, p: a + F.coalesce(count(p), F.lit(0))).alias("total"),
        declared.alias("declared_total"),
    )


def verdict(line: Column) -> Column:
    """passed or failed; words of failure are looked for first."""
    low = F.lower(line)
    return F.when(low.rlike(r"not agreed|negatived|defeated|lost"), "failed").when(low.rlike(r"agreed|passed|carried|read a (first|second|third) time"), "passed")


def divisions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Votes of rows ``keys, ord, line``: ``division_id, question, type, substantive, bill, ayes, noes, result, flags``.

    A bill that the question doesn't name is the last one named that day.  The tally decides; a
    verdict line or a declared total that disagrees is flagged.
    """
    named = bill_title(F.col("line"))
    order = Window.partitionBy(*keys).orderBy("ord")
    rows = lines.withColumns({"__at": F.row_number().over(order), "__bill": F.last(named, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "__vote": F.col("line").rlike(CALL)})
    after = {f"__l{i}": F.lead("line", i).over(order) for i in range(1, REACH + 1)}
    votes = rows.withColumns(after).where("__vote")
    block = F.filter(F.array(*(F.col(f"__l{i}") for i in range(1, REACH + 1))), lambda x: x.isNotNull())
    # a block ends where the next vote is called
    calls = F.array_position(F.transform(block, lambda x: x.rlike(CALL)), F.lit(True)).cast("int")
    votes = votes.withColumns({"__block": F.when(calls > 0, F.slice(block, 1, calls - 1)).otherwise(block), "question": F.regexp_extract("line", r"(?i)on the question,?\s*(.*?)\.?$", 1)})
    first = lambda array, pattern: F.array_position(F.transform(array, lambda x: x.rlike(pattern)), F.lit(True)).cast("int")
    lines, sides = F.col("__block"), {}
    unlabelled = first(lines, r"(?i)^(ayes|noes)\b") == 0
    tallies = F.filter(lines, lambda x: x.rlike(_TALLY))
    for k, name in enumerate(("ayes", "noes")):
        start = first(lines, rf"(?i)^{name}\b")
        rest = F.slice(lines, start + 1, F.lit(REACH))
        # a tally may run over several lines: to its full stop, or to the next label
        stop, label = F.nullif(first(rest, r"\.\s*$"), F.lit(0)), F.nullif(first(rest, _LABEL), F.lit(0))
        n = F.least(F.coalesce(stop, F.size(rest)), F.coalesce(label - 1, F.size(rest)))
        bare = F.get(tallies, F.lit(k))
        sides[f"__{name}_text"] = F.when(unlabelled, bare).when(start > 0, F.array_join(F.slice(rest, F.lit(1), n), " "))
        sides[f"__{name}_end"] = F.when(unlabelled, F.array_position(lines, bare).cast("int")).when(start > 0, start + n)
        sides[f"__{name}_said"] = F.when(start > 0, F.regexp_extract(F.get(lines, start - 1), r"(\d+)", 1).try_cast("int"))
    votes = votes.withColumns(sides)

    def side(name: str) -> Column:
        return F.when(F.col(f"__{name}_text").isNotNull(), tally(F.col(f"__{name}_text"), F.col(f"__{name}_said")))

    last = F.coalesce(F.greatest("__ayes_end", "__noes_end"), F.lit(0))
    after_block = F.filter(F.slice(lines, last + 1, F.lit(REACH)), lambda x: verdict(x).isNotNull())
    votes = votes.withColumns({"ayes": side("ayes"), "noes": side("noes"), "verdict_line": F.get(after_block, F.lit(0)), "type": question_type(F.col("question"))})
    counted = F.when(F.col("ayes.total") > F.col("noes.total"), "passed").when(F.col("ayes.total").isNotNull() & F.col("noes.total").isNotNull(), "failed")
    said = verdict(F.col("verdict_line"))
    flags = F.filter(
        F.array(
            F.when(F.col("ayes.total") != F.col("ayes.declared_total"), "ayes_total_mismatch"),
            F.when(F.col("noes.total") != F.col("noes.declared_total"), "noes_total_mismatch"),
            F.when(counted != said, "verdict_mismatch"),
        ),
        lambda f: f.isNotNull(),
    )
    number = F.lpad(F.row_number().over(order).cast("string"), 3, "0")
    own = bill_title(F.col("question"))
    return votes.select(
        *keys,
        F.concat_ws("-", *keys, number).alias("division_id"),
        "question",
        "type",
        F.col("type").isin(*SUBSTANTIVE).alias("substantive"),
        F.coalesce(own, "__bill").alias("bill"),
        F.when(own.isNotNull(), "question").when(F.col("__bill").isNotNull(), "context").alias("bill_source"),
        "ayes",
        "noes",
        "verdict_line",
        F.coalesce(counted, said).alias("result"),
        flags.alias("flags"),
    )
