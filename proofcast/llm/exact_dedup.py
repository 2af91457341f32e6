"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. Sorting the distinct blocks gives each an
integer name; adjacent names are paired, distinct pairs get names again, until one
name is left for a text. Two texts have the same name and the same number of
blocks exactly if they are equal, whatever their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofcast.llm.common import cut

BLOCK_BYTES = 4096
#: Stands for a null id: smaller than any other.
LEAST = -(2**63)


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names in the order of each partition's sorted rows.

    Rows of one exchange, sorted by their whole value: the same rows get the same
    names when a task is run again.
    """
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _fingerprint(block: Column, salt: int) -> Column:
    """128 bits that stand for a block in shuffles, once shown to be unambiguous."""
    return F.unhex(F.md5(F.concat(F.lit(bytes([salt])), block) if salt else block))


def _first_names(rows: DataFrame, blocks: Column, keep: list[str]) -> DataFrame:
    """One row for each block: keep..., pos, name.

    Only the distinct blocks are shuffled whole. The rows meet their names by
    fingerprint, which is checked to have one block for each value; should two
    blocks share one, another salt is tried.
    """
    for salt in range(256):
        exploded = rows.select(*keep, F.posexplode(blocks).alias("pos", "block"))
        prints = exploded.select(_fingerprint(F.col("block"), salt).alias("print"), "block")
        names = _named(prints.distinct(), ["block"])
        names = cut(names.groupBy("print").agg(F.min("name").alias("name"), F.count("*").alias("blocks")), "block-names")
        if not names.where("blocks > 1").isEmpty():
            continue
        lean = exploded.withColumn("print", _fingerprint(F.col("block"), salt)).drop("block")
        return lean.join(names.drop("blocks"), "print").drop("print")
    raise RuntimeError("no salt separates the blocks")


def identities(docs: DataFrame, text: Column, doc_id: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: row, doc_id, digest, n_blocks, name.

    `row` tells repeated rows apart. (n_blocks, name) is the identity of the text;
    null counts as the empty text, which is one empty block.
    """
    whole = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes)).cast("int")
    rows = docs.select(doc_id.cast("bigint").alias("doc_id"), whole.alias("bytes")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "bytes", count.alias("n_blocks"), F.unhex(F.sha2("bytes", 256)).alias("digest")
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    level = _first_names(rows, blocks, ["row", "doc_id", "digest", "n_blocks"])
    level = cut(level.withColumn("left", F.col("n_blocks")), "level-0")
    kept = ["row", "doc_id", "digest", "n_blocks"]
    done = level.where("left = 1").select(*kept, "name")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    while most > 1:
        most = (most + 1) // 2
        pairs = cut(
            level.where("left > 1")
            .groupBy(*kept, "left", F.shiftright("pos", 1).alias("half"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")),
            "pairs",
        )
        names = cut(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        level = pairs.join(names, ["a", "b"]).select(*kept, ((F.col("left") + 1) / 2).cast("int").alias("left"), F.col("half").alias("pos"), "name")
        level = cut(level, "level")
        done = done.union(level.where("left = 1").select(*kept, "name"))
    return done


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Classes of equal texts and the row of each that stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    The largest doc_id of a class stays; a null id is smaller than any other; of
    repeated rows one stays. `normalise` maps the text column to the one compared
    (default: unchanged). Null and empty texts are equal; an empty table gives no
    rows; other columns are not read, so their names cannot clash.
    """
    column = F.col(f"`{text}`")
    ids = identities(docs, normalise(column) if normalise else column, F.col(f"`{doc_id}`"), block_bytes)
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(LEAST)).alias("rank"), "row", "doc_id"))
    groups = cut(ids.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return ids.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise=None) -> DataFrame:
    """The documents that stay, with all their columns."""
    column = normalise(F.col(f"`{text}`")) if normalise else F.col(f"`{text}`")
    stay = exact_dedup(docs, text, doc_id, normalise).where("kept")
    stay = stay.select(F.coalesce("doc_id", F.lit(LEAST)).alias("__id"), F.unhex("text_sha256").alias("__digest"))
    rows = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(LEAST)).alias("__id"),
        F.unhex(F.sha2(F.coalesce(column, F.lit("")), 256)).alias("__digest"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"),
    )
    # repeated rows are cut to one on the map side already
    same = Window.partitionBy("__id", "__digest").orderBy("__digest")
    once = rows.withColumn("__n", F.row_number().over(same)).where("__n = 1")
    return once.join(stay, ["__id", "__digest"], "left_semi").select("__row.*")
