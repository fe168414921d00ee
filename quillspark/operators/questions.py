"""Oral questions in transcripts: blocks, who asks whom, and each question with its answer.

A block begins at its header and its lines are told by the header's place, which is carried along
the day.  Within a block only running values are needed (the first speaker after the primary
question, the last turn that counts, how many questions came before), so no block is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import names
from quillspark.operators.ordered import carried

#: Headers of blocks, primary questions, who presides, and turns of procedure.
BLOCK = r"^Question No\.\s*(\d+)\s*(?:[—–-]\s*(.*))?$"
PRIMARY = r"^(?:\d+\.\s*)?([^:()]+?)\s*(?:\([^)]*\)\s*)*\bto the\s+([^:]+?)\s*:\s*(.+)$"
CHAIR = r"(?i)^(SPEAKER|ASSISTANT SPEAKER|CHAIRPERSON|Mr Speaker|Madam Speaker|Deputy Speaker|CLERK|Hon Member)\b"
PROCEDURE = r"(?i)^\s*(point of order|speaking to the point of order|I seek leave|I raise a point of order|supplementary question\s*[.?]?\s*$)"
#: Lengths of a speaker's tag.
SHORTEST_TAG, LONGEST_TAG = 2, 90
_TURN = r"^((?:[^(:]++|\((?:[^()]++|\([^()]*+\))*+\))++):\s*(.*)$"


def split_turn(line: Column) -> tuple[Column, Column]:
    """(speaker, text) of a line with a colon outside of brackets; NULLs of other lines."""
    speaker = F.trim(F.regexp_extract(line, _TURN, 1))
    fits = F.length(speaker).between(SHORTEST_TAG, LONGEST_TAG)
    return F.when(fits, speaker), F.when(fits, F.trim(F.regexp_extract(line, _TURN, 2)))


def question_pairs(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """``keys, question_id, number, portfolio, asker, addressee, responder, question, answer,
    is_primary, supplementary_index`` of every answered question.

    ``lines`` has a day's lines, told by ``keys``, in the order of ``order`` (unique in a day).
    Who speaks first after the primary question is the responder; their first turn after a
    question is its answer, later ones go on with it.  The asker's later turns are supplementary
    questions, but for those of procedure; everyone else interjects.  Ids number the blocks
    of a day that have an answer, and the pairs of a block from 0.  NULL lines are blank.
    """
    text = F.trim(F.coalesce(F.col(line), F.lit("")))
    rows = lines.select(*keys, F.col(order).alias("at"), text.alias("line"))
    header = F.when(F.col("line").rlike(BLOCK), F.struct(F.col("at").alias("at"), F.regexp_extract("line", BLOCK, 1).cast("int").alias("number"), F.nullif(F.trim(F.regexp_extract("line", BLOCK, 2)), F.lit("")).alias("portfolio")))
    known = carried(rows, keys, ["at"], {"block": header}, strict=True).where("block IS NOT NULL").where(~F.col("line").rlike(BLOCK))
    block = Window.partitionBy(*keys, "block.at")
    is_primary = F.col("line").rlike(PRIMARY)
    found = known.withColumn("p", F.min(F.when(is_primary, F.struct("at", "line"))).over(block)).where(F.col("at") > F.col("p.at"))
    speaker, said = split_turn(F.col("line"))
    turns = found.withColumns({"speaker": speaker, "said": said}).where((F.col("said") != "") & ~F.col("speaker").rlike(CHAIR))
    of = lambda k: F.regexp_extract("p.line", PRIMARY, k)
    turns = turns.withColumns({"asker": names.clean(of(1)), "first": F.min(F.struct("at", "speaker")).over(block)["speaker"]})
    answers = names.same_person(F.col("speaker"), F.col("first"))
    role = F.when(answers, "answer").when(names.same_person(F.col("speaker"), F.col("asker")) & ~F.col("said").rlike(PROCEDURE), "question")
    so_far = block.orderBy("at")
    told = turns.withColumn("role", role).where("role IS NOT NULL")
    told = told.withColumns({"before": F.lag(F.struct("role", "said")).over(so_far), "asked": F.sum((F.col("role") == "question").cast("int")).over(so_far)})
    pairs = told.where((F.col("role") == "answer") & (F.col("before").isNull() | (F.col("before.role") == "question")))
    pairs = pairs.withColumn("k", F.row_number().over(so_far) - 1).withColumn("b", F.dense_rank().over(Window.partitionBy(*keys).orderBy("block.at")))
    asked = F.coalesce("before.said", F.trim(of(3)))
    return pairs.select(
        *keys, F.concat(F.concat_ws("-", *keys), F.lit("-b"), F.lpad("b", 2, "0"), F.lit("-"), "k").alias("question_id"), "block.number", "block.portfolio", "asker", F.trim(of(2)).alias("addressee"),
        names.clean(F.col("first")).alias("responder"), asked.alias("question"), F.col("said").alias("answer"), (F.col("k") == 0).alias("is_primary"), F.when(F.col("k") > 0, F.col("asked")).cast("int").alias("supplementary_index"),
    )


def uniform_pairs(oral: DataFrame, written: DataFrame) -> DataFrame:
    """``source, id, date, asker, responder, question, answer`` of both sources.

    ``oral`` has question_id, date, asker, responder, question, answer; ``written`` has question_id,
    released_date, asker, minister, question, reply, answered, attachment_only.  Written questions
    without an answer yet, and those whose reply is a file, are left out.  Missing texts are empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = lambda source, i, date, responder, answer: [F.lit(source).alias("source"), F.col(i).cast("string").alias("id"), text(date).alias("date"), F.col("asker"), F.col(responder).alias("responder"), text("question").alias("question"), text(answer).alias("answer")]
    ready = written.where(F.coalesce("answered", F.lit(False)) & ~F.coalesce("attachment_only", F.lit(False)))
    return oral.select(*row("oral", "question_id", "date", "responder", "answer")).unionByName(ready.select(*row("written", "question_id", "released_date", "minister", "reply")))
