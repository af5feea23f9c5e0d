"""Chat formatting with a grammar round trip (operator 8). DataFrame and SQL functions only.

    turn = "###" [ "\\" ] " " role ": " text "</turn>" line feed

A turn is rendered plainly, parsed again, and compared with its source. The parser takes no control string ("</turn>",
"###") inside a role or a text, wherever it stands. If the turns differ, the turn is rendered with escapes (marked by the
backslash in its head): backslashes are doubled, and one more breaks "</turn>", "##" and the ": " of a role; the parser
takes one backslash off each escaped character. The plain form stays wherever it reads back alike. A turn whose escaped form does not read back either stops the job. A
conversation is its turns, one after the other, and is parsed once more as a whole. ``loss_mask`` says, turn by turn,
which code points of the formatted conversation a model is trained on: those of the trained role's texts, as escaped.

Defined results: null roles and texts are empty; turns are ordered by turn, then role, then text, so ties and repeated
rows have one order; rows with a null conv_id form one conversation; a very long text is one turn like any other; extra
columns are ignored; an empty table stays empty. A conversation's rows come together in one row, which is what a training example is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
TRAINED_ROLE = "assistant"
#: How an escaped turn starts.
ESCAPED = "###\\ "
_HEAD = r"(?s)\A###(\\?) (.*?): (.*)\z"


def _escape(x: Column) -> Column:
    doubled = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("##"), F.lit("#\\#"))


def _unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def plain(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), role, F.lit(": "), text, F.lit(END))


def escaped(role: Column, text: Column) -> Column:
    head = F.replace(_escape(role), F.lit(": "), F.lit(":\\ "))
    return F.concat(F.lit(ESCAPED), head, F.lit(": "), _escape(text), F.lit(END))


def _segments(formatted: Column) -> Column:
    """The turns of a formatted text, without their ends."""
    found = F.split(formatted, END)
    return F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))


def parse(formatted: Column) -> Column:
    """An array of (role, text), read from formatted turns; what is not a turn gives nulls."""

    def turn(x: Column) -> Column:
        marked = F.regexp_extract(x, _HEAD, 1) == "\\"
        role, text = F.regexp_extract(x, _HEAD, 2), F.regexp_extract(x, _HEAD, 3)
        free = ~F.contains(x, F.lit("</turn>")) & ~F.contains(F.substring(x, 4, 1 << 30), F.lit("###"))
        valid = F.regexp_like(x, F.lit(_HEAD)) & free
        return F.struct(
            F.when(valid, F.when(marked, _unescape(role)).otherwise(role)).alias("role"),
            F.when(valid, F.when(marked, _unescape(text)).otherwise(text)).alias("text"),
        )

    return F.transform(_segments(formatted), turn)


def rendered(role: Column, text: Column) -> Column:
    """The plain form of a turn if it reads back alike, else the escaped one, which must."""

    def alike(form: Column) -> Column:
        back = parse(form)
        return (F.size(back) == 1) & back[0]["role"].eqNullSafe(role) & back[0]["text"].eqNullSafe(text)

    bare, coded = plain(role, text), escaped(role, text)
    return F.when(alike(bare), bare).when(alike(coded), coded).otherwise(F.raise_error(F.lit("a turn does not read back alike")).cast("string"))


def format_conversations(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) to one row per conversation: source (array of role, text), formatted (string), and
    loss_mask: for each turn (lead, start, length) of the text to train on, from the turn's and the conversation's start
    (code points, from 0), null where there is none."""
    rows = turns.select(
        F.col(id_column), F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # rendered before the shuffle, so that a turn is parsed once
    rows = rows.select(id_column, F.struct("turn", "role", "text").alias("source"), rendered(F.col("role"), F.col("text")).alias("formatted"))
    earlier = Window.partitionBy(id_column).orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("formatted")).over(earlier), F.lit(0)))
    # a turn has a length, so that the place before it sorts the turns
    whole = rows.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("before", "source", "formatted"))).alias("t"))

    def mask(x: Column) -> Column:
        text = F.when(F.startswith(x["formatted"], F.lit(ESCAPED)), _escape(x["source"]["text"])).otherwise(x["source"]["text"])
        lead = F.length(x["formatted"]) - F.length(text) - len(END)
        span = F.struct(lead.alias("lead"), (x["before"] + lead).alias("start"), F.length(text).alias("length"))
        return F.when(x["source"]["role"] == TRAINED_ROLE, span)

    return whole.select(
        id_column, F.transform("t", lambda x: F.struct(x["source"]["role"].alias("role"), x["source"]["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"), F.transform("t", mask).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns``, parsed from the formatted text, and ``loss_text``: what lies under the mask, without escapes."""

    def masked(x: Column, span: Column) -> Column:
        text = F.substring(x, span["lead"] + 1, span["length"])
        return F.when(span.isNotNull(), F.when(F.startswith(x, F.lit(ESCAPED)), _unescape(text)).otherwise(text))

    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    return parsed.withColumn("loss_text", F.array_join(F.zip_with(_segments(F.col("formatted")), "loss_mask", masked), ""))


def digest(parsed: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Counts and digests of what was read back."""
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return parsed.select(
        id_column, F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), (F.col("turns") == F.col("source")).alias("round_trip"),
    )
