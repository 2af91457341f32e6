"""Two tokenizers aligned on the bytes of a text, by diagonal run skipping.

Tokens of either side are known by the offsets where they end. As long as both
sides end together one by one, their indexes keep one shift: exponentially longer
stretches of the end arrays are compared at that shift, and shorter ones again
where they differ. The group that breaks the run is resolved token by token until
both sides end together, which gives the next shift.

How many documents link two ids is counted over the corpus. Blocks of documents
name their distinct pairs once, so what is shuffled is a row for each pair and
block, not for each pair and document.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofcast.llm.common import cut

#: A block of documents ends with this many tokens of side A.
BLOCK_TOKENS = 1 << 20
#: Groups with more links than this are counted by their distinct ids.
WIDE = 1 << 12
#: How byte-level vocabularies of this kind part a text (fixed value).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel(NamedTuple):
    """Byte-level BPE: a file of ranks, and the same vocabulary as JSON for texts that the first library can't take."""

    ranks: str
    json: str


class Pieces(NamedTuple):
    """A piece model that puts a blank before the text and falls back to bytes."""

    model: str


class _ByteLevel:
    def __init__(self, side: ByteLevel) -> None:
        import tiktoken

        with open(side.ranks, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.json, self.spare = side.json, None
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.sizes = np.array(list(map(len, self.bytes)))
        self.model = tiktoken.Encoding("byte_level", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        try:
            return self.model.encode_ordinary(" " + text)
        except BaseException as error:  # very long white space exhausts its stack; it panics, which is no Exception
            if type(error).__name__ != "PanicException":
                raise
        if self.spare is None:
            from tokenizers import Tokenizer

            self.spare = Tokenizer.from_file(self.json)
            self.spare.encode_special_tokens = True
            self.spare.no_truncation()
            self.spare.no_padding()
        return self.spare.encode(" " + text, add_special_tokens=False).ids


class _Pieces:
    def __init__(self, side: Pieces) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=side.model)
        self.bytes = [
            bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
            for i in range(m.get_piece_size())
        ]
        self.sizes = np.array(list(map(len, self.bytes)))

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(maxsize=8)
def encoder(side: ByteLevel | Pieces) -> _ByteLevel | _Pieces:
    """One for each worker; the files lie at the same path on every machine."""
    return _ByteLevel(side) if isinstance(side, ByteLevel) else _Pieces(side)


def irregular(ea: list[int], eb: list[int]) -> list[int]:
    """Groups that are not one token to one, from the offsets where tokens end.

    Four numbers for each, one behind the other: a from, a to, b from, b to. Both
    lists rise strictly and end with the same offset.
    """
    na, nb = len(ea), len(eb)
    i = j = 0
    found: list[int] = []
    while True:
        step = 4
        while (run := ea[i : i + step]) and run == eb[j : j + step]:
            i, j, step = i + len(run), j + len(run), 2 * step
        while step > 1:
            step //= 2
            if (run := ea[i : i + step]) and run == eb[j : j + step]:
                i, j = i + len(run), j + len(run)
        if i >= na or j >= nb:
            return found
        x, y, s, t = ea[i], eb[j], i, j
        i, j = i + 1, j + 1
        while x != y:
            if x < y:
                x, i = ea[i], i + 1
            else:
                y, j = eb[j], j + 1
        found += (s, i, t, j)


def aligned(ea: list[int], eb: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as token indexes of either side: after every token but those within an irregular group."""
    odd = np.array(irregular(ea, eb), np.int64).reshape(-1, 4)
    out = []
    for n, first, last in ((len(ea), odd[:, 0], odd[:, 1] - 1), (len(eb), odd[:, 2], odd[:, 3] - 1)):
        within = np.zeros(n + 1, np.int64)
        np.add.at(within, first, 1)
        np.add.at(within, last, -1)
        out.append(np.flatnonzero(np.cumsum(within)[:n] == 0) + 1)
    return out[0], out[1]


def tokens(text: str | None, a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids of both sides and where groups end; None for a text that either side can't give back byte by byte."""
    if not text:
        return None
    whole = b" " + text.encode("utf-8", "surrogatepass")
    ids, ends = [], []
    for side in (encoder(a), encoder(b)):
        found = side.encode(text)
        if b"".join(map(side.bytes.__getitem__, found)) != whole:
            return None
        ids.append(np.array(found, np.int64))
        ends.append(np.cumsum(side.sizes[ids[-1]]).tolist())
    return (*ids, *aligned(*ends))


@lru_cache(maxsize=1)
def _shown(n: int) -> np.ndarray:
    """Ids below n in decimal with what may follow: a comma, the bar between sides, the mark between groups."""
    return np.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(n)], object)


def render(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """Groups as `a1,a2|b1;a3|b2,b3`."""
    n = 1 << int(max(a.max(), b.max())).bit_length()
    shown = _shown(max(n, 1 << 16))
    n = len(shown) // 3
    # the tokens of a group stand together, side A first: a token stands behind its own side and the other's earlier groups
    group_a = np.searchsorted(a_ends, np.arange(len(a)), side="right")
    group_b = np.searchsorted(b_ends, np.arange(len(b)), side="right")
    before_b = np.concatenate([[0], b_ends[:-1]])
    row = np.empty(len(a) + len(b), np.int64)
    marked_a, marked_b = a.copy(), b.copy()
    marked_a[a_ends - 1] += n
    marked_b[b_ends - 1] += 2 * n
    row[np.arange(len(a)) + before_b[group_a]] = marked_a
    row[np.arange(len(b)) + a_ends[group_b]] = marked_b
    return b"".join(shown[row].tolist())[:-1]


def links(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of links, distinct linked ids as a << 32 | b, and how many links each has."""
    start_a, start_b = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    wide_b = b_ends - start_b
    sizes = (a_ends - start_a) * wide_b
    one, some = sizes == 1, (sizes > 1) & (sizes <= WIDE)
    n = sizes[some]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    over = np.repeat(wide_b[some], n)
    keys = a[np.repeat(start_a[some], n) + k // over] << 32 | b[np.repeat(start_b[some], n) + k % over]
    pairs, times = np.unique(np.concatenate([a[start_a[one]] << 32 | b[start_b[one]], keys]), return_counts=True)
    for g in np.flatnonzero(sizes > WIDE):
        x, nx = np.unique(a[start_a[g] : a_ends[g]], return_counts=True)
        y, ny = np.unique(b[start_b[g] : b_ends[g]], return_counts=True)
        every = np.concatenate([pairs, (x[:, None] << 32 | y).ravel()])
        weights = np.concatenate([times, (nx[:, None] * ny).ravel()])
        pairs, at = np.unique(every, return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, at, weights)
    return int(sizes.sum()), pairs, times


SCHEMA = "doc_id bigint, block bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, at array<int>, times array<bigint>, pairs array<bigint>, held array<bigint>"


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    sizes = [0 if p is None else len(p) for p in parts]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, np.int64)])
    missing = np.array([p is None for p in parts])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind), mask=pa.array(missing) if missing.any() else None)


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """The documents of a block; the first one carries the block's distinct pairs and how many documents hold each."""
    known, at = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True)
    held = np.bincount(at, minlength=len(known)).astype(np.int64)
    cuts = np.cumsum([len(r[6]) for r in rows])[:-1]
    lead: list = [None] * (len(rows) - 1)
    columns = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([number] * len(rows), pa.int64()),
        *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3, 4)),
        pa.array([r[5] for r in rows], pa.string()),
        _lists(np.split(at, cuts), pa.int32()),
        _lists([r[7] for r in rows], pa.int64()),
        _lists([known, *lead], pa.int64()),
        _lists([held, *lead], pa.int64()),
    ]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _blocks(a: ByteLevel | Pieces, b: ByteLevel | Pieces, digest: bool, most: int):
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers are stable once the table is written
        number = TaskContext.get().partitionId() << 32
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = tokens(text.as_py(), a, b)
                if found is None:
                    rows.append((doc_id.as_py(), 0, 0, 0, 0, "", none, none))
                    continue
                shown = render(*found)
                n, pairs, times = links(*found)
                shown = hashlib.sha256(shown).hexdigest() if digest else shown.decode()
                rows.append((doc_id.as_py(), len(found[0]), len(found[1]), len(found[2]), n, shown, pairs, times))
                size += len(found[0])
                if size >= most:
                    yield _block(number, rows)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield _block(number, rows)

    return run


def align_documents(docs: DataFrame, a: ByteLevel | Pieces, b: ByteLevel | Pieces, text: str = "text", doc_id: str = "doc_id", digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: one row for each row of the table.

    `groups` holds the groups' ids as text (see `render`), or with `digest` its
    sha256. Links are all pairs of tokens of either side in one group; a pair of
    ids counts the rows that hold it linked, over the whole table. n_best are
    links whose count is the highest that their id of side A has anywhere, ties
    included; count_sum adds the counts of all links. Texts that are null or empty,
    or that a tokenizer does not give back byte by byte after a blank, have zeros
    and an empty `groups`. Repeated rows count each; a null doc_id stays null; an
    empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    blocks = cut(rows.mapInArrow(_blocks(a, b, digest, BLOCK_TOKENS), SCHEMA), "token-blocks")
    named = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("pos", "p"))
    named = cut(named.select("block", "pos", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held")), "token-pairs")
    counts = cut(named.groupBy("pair").agg(F.sum("held").alias("n")), "pair-counts")
    left = F.shiftright("pair", 32)
    best = cut(counts.groupBy(left.alias("a")).agg(F.max("n").alias("most")), "best-counts")
    told = cut(counts.join(best, left == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "told")
    answers = named.join(told, "pair").select("block", "pos", "n", "best")

    def score(documents: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        n[found["pos"].to_numpy()], best[found["pos"].to_numpy()] = found["n"].to_numpy(), found["best"].to_numpy()
        documents["n_best"] = [int((t * best[at]).sum()) for at, t in zip(documents["at"], documents["times"], strict=True)]
        documents["count_sum"] = [int((t * n[at]).sum()) for at, t in zip(documents["at"], documents["times"], strict=True)]
        return documents[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]]

    documents = blocks.drop("pairs", "held")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, schema)
