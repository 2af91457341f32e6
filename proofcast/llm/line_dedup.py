"""Lines that many documents share go, except where they came first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofcast.llm.common import cut

#: What the line key is stripped of: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id: later than any other.
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """Stripped at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _reassembled(text: Column, dropped: Column) -> Column:
    """struct(n_lines, n_dropped, kept) of a text without the lines at some positions."""

    def one(whole: str, gone) -> tuple:
        lines = whole.split("\n")
        if gone is None or not len(gone):
            return len(lines), 0, whole
        out = set(gone.tolist())
        return len(lines), len(out), "\n".join(line for i, line in enumerate(lines) if i not in out)

    @F.pandas_udf("struct<n_lines: bigint, n_dropped: bigint, kept: string>")
    def of(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, g) for t, g in zip(texts, gone, strict=True)], columns=["n_lines", "n_dropped", "kept"])

    return of(text, dropped)


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, threshold: int = 2) -> DataFrame:
    """Documents without the lines that `threshold` or more documents hold.

    Returns the input's other columns in a struct `row`, and n_lines, n_dropped, kept
    (the lines that stay, joined by newlines). Keys shorter than `min_chars` code
    points always stay. The smallest doc_id that holds a line keeps all its
    copies. Rows with one id are one document; rows with a null id are one
    document with the largest id. Null text counts as one empty line; an empty
    table gives no rows.

    A line is known by 128 bits of its key. Each (key, document) is counted once,
    before and after the shuffle, so a line that a third of all documents hold
    is a few rows for each task. Texts are shuffled once, to meet the positions
    they lose, and not with the lines.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row"),
        F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(LAST)).alias("id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).withColumn("print", F.unhex(F.md5("text")))
    lines = (
        rows.select("id", "print", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "print", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "print", "pos", F.unhex(F.md5("key")).alias("line"))
    )
    if threshold == 2:  # two ends that differ are two documents: no need to count them
        shared = lines.groupBy("line").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    else:
        once = lines.select("line", "id").distinct()
        shared = once.groupBy("line").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= threshold).drop("n")
    gone = (
        lines.join(cut(shared, "shared-lines"), "line")
        .where("id > first")
        .groupBy("id", "print")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    return (
        rows.join(gone, ["id", "print"], "left")
        .withColumn("result", _reassembled(F.col("text"), F.col("dropped")))
        .select("row", "result.n_lines", "result.n_dropped", "result.kept")
    )
