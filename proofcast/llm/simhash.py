"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofcast.llm.common import cut
from proofcast.llm.graph import components

SEED = 42
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 16
HALF = 0xFFFFFFFF
#: A segment value with more fingerprints than this is searched by a longer key.
CROWDED = 256


def _hashes(text: str, size: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint_of(text: str | None, size: int) -> int:
    """Bits set in over half of the shingle hashes; zero without a word."""
    hashes = np.array(_hashes(text or "", size), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK, None].view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def fingerprint(text: Column, size: int = 3) -> Column:
    """64-bit fingerprint as a signed bigint; A-Z in lower case, words between ASCII blanks."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(t, size) for t in batch], dtype="int64")

    return of(text)


def _half(which: int) -> Column:
    """The low (0) or the high (1) 32 bits."""
    return F.col("fp").bitwiseAND(HALF) if which == 0 else F.shiftrightunsigned("fp", 32)


def _ball(value: Column, width: int, radius: int) -> Column:
    """All values of `width` bits within `radius` bits, as an array."""
    flips = [0] + ([1 << i for i in range(width)] if radius else [])
    return F.transform(F.array(*(F.lit(f).cast("bigint") for f in flips)), lambda f: value.bitwiseXOR(f))


def _tagged(values: Column, quarter: int) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(quarter).alias("quarter"), x.alias("bits16")))


def _verified(pairs: DataFrame, bits: int) -> DataFrame:
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    return pairs.where((F.col("u") > F.col("v")) & near)


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs (u > v) of distinct fingerprints within `bits` (at most 3) bits.

    Two fingerprints within three bits agree in one 32-bit half up to one bit. So
    a fingerprint asks both tables of halves for its half and the values at one
    bit from it, and the whole distance of what it finds is verified.

    Halves that very many fingerprints share would pair all of them. Such a half
    is searched by a longer key, exactly: within it the other halves must be
    within three bits, so one of their two 16-bit quarters is within one bit, and
    half with quarter is the key.
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be between 0 and 3")
    sides = [(s, _half(s), _half(1 - s)) for s in (0, 1)]
    entry = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), own.alias("key"), other.alias("rest")) for s, own, other in sides)))
    tables = prints.select("fp", entry.alias("e")).select("fp", "e.*")
    crowded = cut(tables.groupBy("side", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).drop("n"), "crowded")
    probes = tables.withColumn("key", F.explode(_ball(F.col("key"), 32, 1)))

    plain = tables.join(crowded, ["side", "key"], "left_anti").select("side", "key", F.col("fp").alias("v"))
    found = _verified(probes.select("side", "key", F.col("fp").alias("u")).join(plain, ["side", "key"]).select("u", "v"), bits)

    def quarters(df: DataFrame, radius: int) -> DataFrame:
        low, high = F.col("rest").bitwiseAND(0xFFFF), F.shiftrightunsigned("rest", 16)
        longer = F.concat(*(_tagged(_ball(q, 16, radius), i) for i, q in enumerate((low, high))))
        return df.select("side", "key", "fp", F.explode(longer).alias("q")).select("side", "key", "fp", "q.*")

    keys = ["side", "key", "quarter", "bits16"]
    deep = quarters(tables.join(crowded, ["side", "key"], "left_semi"), 0).withColumnRenamed("fp", "v")
    asked = quarters(probes.join(crowded, ["side", "key"], "left_semi"), 1).withColumnRenamed("fp", "u")
    found = found.union(_verified(asked.join(deep, keys).select("u", "v"), bits))
    return found.distinct()


def simhash_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp (bigint), component_id: the smallest doc_id that links reach.

    Copies share a fingerprint and are one node of the search, so a group of them
    costs one row whatever its size. Null and wordless texts have fingerprint
    zero. A null doc_id stays null and is never a component_id unless the whole
    component has no other. Repeated rows give repeated rows; an empty table gives
    none; other columns are not read.
    """
    rows = cut(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), fingerprint(F.col(f"`{text}`"), size).alias("fp")), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = cut(components(links(nodes.select("fp"), bits)), "roots")
    member = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = cut(member, "members")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut(member.join(cut(named, "components"), "root").select("fp", "component_id"), "by-print")
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, bits: int = 3) -> DataFrame:
    """The documents without near duplicates: of each component its smallest doc_id.

    Rows without an id are kept: they cannot be told apart. Repeated rows of the
    smallest id all stay; exact copies are not this operator's business.
    """
    classes = simhash_classes(docs, text, doc_id, size, bits)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("bigint") == gone["__gone"], "left_anti")
