"""Exact order statistics and numbering that never gather a whole group.

A group here may hold any share of the data. Values are first counted per
distinct value (ties shrink on the map side), then split into ordered bins that
depend on the value alone. Only one bin of one group is ever sorted together;
running counts over the bins turn places within a bin into places in the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofcast.functions.columns import order_bin
from proofcast.functions.frames import join_null_safe


def _before(column: str, keys: Sequence[str], *order: Column) -> Column:
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def distinct_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each value occurs in each group, with its bin. Nulls stay."""
    return (
        df.groupBy(*keys, F.col(value).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_bin", order_bin(F.col("_x")))
    )


def merged_counts(counts: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Counted values that were stored in several parts, as `distinct_counts` of all of them."""
    return (
        counts.groupBy(*keys, F.col(value).alias("_x"))
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_bin", order_bin(F.col("_x")))
    )


def bin_offsets(counts: DataFrame, keys: Sequence[str], lowest: str | None = None) -> DataFrame:
    """Per group and bin: values before it, values in it, values in the group.

    The frame has one row per group and non-empty bin, so its windows run over
    counts, never over data, and share one shuffle. The null bin comes last and is
    not part of _n. `lowest` names a column for the group's smallest value.
    """
    sizes = counts.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_in_bin"), F.min("_x").alias("_low"))
    whole = Window.partitionBy(*keys)
    extra = [F.min("_low").over(whole).alias(lowest)] if lowest else []
    return sizes.select(
        *extra,
        *keys,
        "_bin",
        "_in_bin",
        _before("_in_bin", keys, F.col("_bin").asc_nulls_last()).alias("_offset"),
        F.coalesce(F.sum(F.when(F.col("_bin").isNotNull(), F.col("_in_bin"))).over(whole), F.lit(0)).alias("_n"),
        F.sum("_in_bin").over(whole).alias("_rows"),
    )


def place_values(counts: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach to each distinct value how many values of its group are smaller.

    Group and bin are one value, so null keys match and the join and the order
    within a bin share one shuffle.
    """
    cell = F.struct(*keys, "_bin").alias("_cell")
    bins = offsets.select(cell, *[F.col(n) for n in offsets.columns if n not in (*keys, "_bin")])
    joined = counts.withColumn("_cell", F.struct(*keys, "_bin")).join(bins, "_cell")
    return joined.withColumn("_before", F.col("_offset") + _before("_w", ["_cell"], F.col("_x").asc_nulls_last())).drop("_cell")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], count: str | None = None
) -> DataFrame:
    """Exact quantiles (linear interpolation) of groups of any size.

    One row per group, null quantiles where a group has no value. `count` names
    an output column with the number of rows of the group, nulls included.
    """
    counts = distinct_counts(df, keys, value)
    offsets = bin_offsets(counts, keys)

    # only the bins a quantile falls into are sorted; a group without values keeps its null bin
    hits = [
        f"(_offset <= ceil({p}D * (_n - 1)) AND _offset + _in_bin > floor({p}D * (_n - 1)))" for p in probs.values()
    ]
    wanted = F.expr(f"CASE WHEN _n = 0 THEN true ELSE _bin IS NOT NULL AND ({' OR '.join(hits)}) END")

    placed = place_values(counts, offsets.filter(wanted), keys)
    picked = placed.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max("_rows").alias("_rows"), *quantile_picks(probs)
    )
    extra = [F.col("_rows").alias(count)] if count else []
    return picked.select(*keys, *between_picks(probs, "_n"), *extra)


def pick(p: float, place: str) -> str:
    """SQL aggregate: the value whose place is floor or ceil of a quantile's position."""
    at = f"{place}({p}D * (_n - 1))"
    return f"max(CASE WHEN _before <= {at} AND _before + _w > {at} THEN _x END)"


def quantile_picks(probs: Mapping[str, float]) -> list[Column]:
    """Aggregates that pick the two values next to each quantile."""
    return [
        F.expr(f"{pick(p, place)} AS `_{place}_{name}`") for name, p in probs.items() for place in ("floor", "ceil")
    ]


def interpolate(name: str, p: float, n: str) -> str:
    """SQL: linear interpolation between two picked values."""
    at = f"{p}D * ({n} - 1)"
    return f"`_floor_{name}` + (`_ceil_{name}` - `_floor_{name}`) * ({at} - floor({at}))"


def between_picks(probs: Mapping[str, float], n: str) -> list[Column]:
    return [F.expr(f"{interpolate(name, p, n)} AS `{name}`") for name, p in probs.items()]


# Rows written out together when a repeated value is numbered.
PIECE = 1_000_000


def numbered_values(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Number the values 1, 2, 3, ... in each group, smallest first, nulls last.

    Equal values are interchangeable, so they are counted first and written out
    again in pieces, spread over tasks.
    """
    counts = distinct_counts(df.select(*keys, value), keys, value)
    placed = place_values(counts, bin_offsets(counts, keys), keys)
    pieces = placed.withColumn("_piece", F.expr(f"explode(sequence(0L, (_w - 1) div {PIECE}L))"))
    last = f"least(_w, (_piece + 1) * {PIECE}L)"
    written = pieces.withColumn(name, F.expr(f"explode(sequence(_before + _piece * {PIECE}L + 1, _before + {last}))"))
    return written.select(*keys, F.col("_x").alias(value), name)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, name: str
) -> DataFrame:
    """1, 2, 3, ... within each group, however large the group.

    `chunk` is an expression that never decreases along `order` (null last); one
    chunk of one group is sorted together, and chunk sizes give the rest.
    """
    tagged = df.withColumn("_chunk", chunk)
    sizes = tagged.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *keys, "_chunk", _before("_size", keys, F.col("_chunk").asc_nulls_last()).alias("_offset")
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        join_null_safe(tagged, offsets, [*keys, "_chunk"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(within)).cast("int"))
        .drop("_chunk", "_offset")
    )


def numbered_by_value(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str, descending: bool = False
) -> DataFrame:
    """Number rows by a value, nulls last, ties by a second column."""
    coarse = order_bin(F.col(value), per_octave=16)
    ordered = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return numbered(
        df,
        keys,
        [ordered, F.col(tie).asc_nulls_last()],
        -coarse if descending else coarse,
        name,
    )
