"""Bounded training samples: the one place where texts reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest text, in bytes, that a model learns from. Predictions read every text whole.
MOST_BYTES = 1 << 16


def _place(key: Column) -> Column:
    """A hash as a place between 0 and 1."""
    return F.pmod(key, F.lit(1 << 52)) / F.lit(float(1 << 52))


def labelled_sample(rows: DataFrame, most: int) -> list[tuple[str, object]]:
    """At most `most` distinct texts of each label, as (text, label) in a fixed order.

    `rows` has text, label and key, a hash of the text or id that spreads evenly.
    A label's distinct keys are counted, and rows whose key falls into the share
    wanted are fetched: no text is shuffled, copies count once, and the sample
    depends neither on order nor on partitioning. Labels are a small closed set.
    Texts that are null or longer than MOST_BYTES teach nothing.
    """
    rows = rows.where(F.col("text").isNotNull() & F.col("label").isNotNull() & (F.octet_length("text") <= MOST_BYTES))
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("key").alias("n")).collect()
    if not sizes:
        return []
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("label") == F.lit(row["label"]), F.lit(1.2 * most / max(row["n"], 1))).otherwise(share)
    found = rows.where(_place(F.col("key")) < share).groupBy("label", "key").agg(F.min("text").alias("text")).collect()
    out, taken = [], {}
    for row in sorted(found, key=lambda r: (r["key"], str(r["label"]))):
        taken[row["label"]] = taken.get(row["label"], 0) + 1
        if taken[row["label"]] <= most:
            out.append((row["text"], row["label"]))
    return out
