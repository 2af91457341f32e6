"""Passages that documents share, also with a few words changed: seeds, chains, alignment.

Documents that share a k-mer of words seed each other. Seeds of one pair of
documents are chained in order, with a cost for gaps; chains are aligned word by
word and extended at both ends.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofcast.llm.common import cut

#: Words of a k-mer; k-mers of which the least is a seed. A shared run of K + W - 1
#: words always shares a seed, one of 50 words two.
K, W = 5, 20
#: A k-mer whose hash is below this is a seed whatever stands around it, so that
#: passages with a changed word in every window share seeds too: one k-mer in 16,
#: and few that are not the least of a window anyway.
SURE = np.uint64(1 << 60)
#: Words looked at beyond the outer seeds of a chain, words that two seeds of one
#: chain may be apart, and what a word of gap costs, against 1 for a seed.
MARGIN, GAP, GAP_COST = 64, 100, 0.01
#: Words that one side may have alone where a passage is extended.
HOP = 3
#: Words of a passage, and the share of them that must be equal.
LEAST_WORDS, LEAST_SHARE = 50, 0.8
#: Words of a text that travel together.
BLOCK = 64
REMEMBERED = 400_000
#: Words of texts whose seeds' surroundings are worked out together.
TOGETHER = 1 << 17
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_words = re.compile(r"\w+").findall
NONE = np.uint64(2**64 - 1)
#: Words on either side of a seed that are compared in any order, and how many of
#: them may be missing on the other side: a fifth of a passage of 50 words.
NEAR, MISSING = 22, 10
#: Words of a stretch whose holders are linked to the first of them only, and how
#: many of them stand before the seed: of 58 equal words around a seed, one such
#: stretch is always among them.
SAME, BEFORE = 50, (0, 9, 18, 27, 36, 45)
#: What stands around a seed: the set of NEAR words on either side as 64 bits, and
#: the stretches of SAME words that hold it, word for word.
SETS = ("left", "right")
KEYS = tuple(f"same_{n}" for n in BEFORE)
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
SEED = ("seed", "id", "pos", *SETS, *KEYS)
#: Occurrences of a seed that meet in one place; a seed with more is split in blocks.
CROWD = 4096


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def _over(values: np.ndarray, together: np.ufunc, width: int) -> np.ndarray:
    """A running minimum or union of `width` values from each place on, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = together(values[:-step], values[step:])
        size += step
    return values


def _mixed(values: np.ndarray, factor: int) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(factor)
    return values ^ (values >> np.uint64(29))


def surroundings(codes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Sets and keys (SETS, KEYS) around places in joined texts.

    Each place's text goes from `low` to `high`; what reaches beyond it is zero.
    """
    codes = np.concatenate([codes, np.zeros(SAME, np.uint64)])
    sets = _over(np.uint64(1) << (codes & np.uint64(63)), np.bitwise_or, NEAR).view(np.int64)
    # a run's hash: words folded in pairs of growing stretches would not be cheaper than a sum of powers
    powers = np.full((2, len(codes)), [[np.uint64(_MIX[0])], [_BACK]], np.uint64)
    powers[:, 0] = 1
    rising, falling = np.multiply.accumulate(powers, axis=1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * falling, dtype=np.uint64)])
    out_sets, out_keys = [], []
    for near in (at - NEAR, at + K):
        inside = (near >= low) & (near + NEAR <= high)
        out_sets.append(np.where(inside, sets[np.where(inside, near, 0)], 0))
    for before in BEFORE:
        start = at - before
        inside = (start >= low) & (start + SAME <= high)
        start = np.where(inside, start, 0)
        key = _mixed((sums[start + SAME] - sums[start]) * rising[start], _MIX[1])
        out_keys.append(np.where(inside, key >> np.uint64(32) | np.uint64(1), np.uint64(0)).astype(np.uint32).view(np.int32))
    return [*out_sets, *out_keys]


def seeds_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the seeds among the codes of a text's words.

    A k-mer that recurs within eight words is a seed once: runs of a repeated word
    or phrase seed at their start only.
    """
    n = len(codes) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    for i in range(K):
        hashes = (hashes ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    plain = hashes.copy()
    for back in range(1, min(8, n - 1) + 1):
        hashes[back:][plain[back:] == plain[:-back]] = NONE
    width = min(W, n)
    chosen = []
    for start in range(0, n - width + 1, 1 << 18):
        part = hashes[start : start + (1 << 18) + width - 1]
        least = np.lib.stride_tricks.sliding_window_view(part, width).argmin(axis=1)
        chosen.append(np.unique(least + np.arange(start, start + len(least))))
    at = np.unique(np.concatenate([*chosen, np.flatnonzero(hashes < SURE)]))
    at = at[hashes[at] != NONE]
    return hashes[at].view(np.int64), at


def _coded(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > REMEMBERED:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh64_intdigest(word)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(docs: DataFrame) -> DataFrame:
    """The seeds of every document (id, text) with their surroundings: all columns of SEED.

    One more row for each document, with pos = -1 - its words, holds a digest of its
    text in seed and left.
    """

    def told(ids: list, digests: list, hashes: list, places: list, codes: list) -> pd.DataFrame:
        found, sizes = [len(x) for x in hashes], [len(x) for x in codes]
        ends = np.cumsum(sizes)
        high = np.repeat(ends, found)
        low = np.repeat(ends - sizes, found)
        at, own = np.concatenate(places), np.array(ids, np.int64)
        digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        left, *others = surroundings(np.concatenate(codes), at + low, low, high)
        seed = np.concatenate([*hashes, digest[:, 0]])
        columns = [seed, np.concatenate([np.repeat(own, found), own]), np.concatenate([at, -1 - np.array(sizes)])]
        columns += [np.concatenate([left, digest[:, 1]]), *[np.concatenate([x, np.zeros(len(own), x.dtype)]) for x in others]]
        return pd.DataFrame(dict(zip(SEED, columns, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            parts, size = [], 0
            for id_, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                codes = _coded(words_of(text), known)
                digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                parts.append((id_, digest, *seeds_of(codes), codes))
                size += len(codes)
                if size >= TOGETHER:
                    yield told(*zip(*parts, strict=True))
                    parts, size = [], 0
            if parts:
                yield told(*zip(*parts, strict=True))

    return docs.mapInPandas(run, ", ".join(f"{c} {'int' if c in ('pos', *KEYS) else 'bigint'}" for c in SEED))


def held(every: DataFrame) -> DataFrame:
    """The seeds that two documents hold, with the `blocks` that their pairs are made in, and all rows of digests.

    Seeds are dealt out once: what only one document holds, most of them, ends here
    and is neither written nor read again.
    """
    same = Window.partitionBy("seed")
    shared = F.min("id").over(same) < F.max("id").over(same)
    blocks = F.ceil(F.count(F.lit(1)).over(same) / CROWD).cast("int")
    return cut(every.select(*SEED, blocks.alias("blocks"), shared.alias("shared")).where("shared or pos < 0").drop("shared"), "shared-seeds")


def copies(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, rep, n_words of texts that an earlier document holds too; and the ids that hold no other text."""
    found = every.where("pos < 0").select("id", F.struct("seed", "left").alias("same"), (-1 - F.col("pos")).alias("n_words")).distinct()
    first = found.groupBy("same").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").drop("last")
    held = cut(found.join(first, "same", "left").select("id", F.coalesce("rep", "id").alias("rep"), "n_words"), "copies")
    only = held.groupBy("id").agg(F.max(F.col("rep") == F.col("id")).alias("own")).where("not own").select("id")
    return held.where("rep < id"), cut(only, "copied")


def anchors(every: DataFrame, apart: DataFrame) -> DataFrame:
    """a, b, a_pos, b_pos: of all seeds, those that document b shares with an earlier document a.

    All occurrences of a seed in different documents are paired, but for two that
    share one of the stretches of SAME words around it and are both not the first
    to hold it: that first one is paired with both, on the same words. So copies
    of a passage are not expanded into all pairs, and passages that differ all meet.

    A pair ends here where on both sides more of the NEAR words differ, whatever
    their order, than a passage allows. The work grows with the square of the
    different surroundings of a seed; a crowded seed's pairs are made in blocks of
    CROWD by CROWD, each of which another task can take. Ids in `apart` are left out.
    """
    held = every.where("pos >= 0").join(apart, "id", "left_anti").repartition("seed").distinct()
    number = [F.row_number().over(Window.partitionBy("seed", k).orderBy("id", "pos")) for k in KEYS]
    first = reduce(lambda x, y: x + y, [F.when(n == 1, F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(number)])
    held = cut(held.select(*SEED, "blocks", first.alias("first")), "held-seeds")

    block = F.pmod(F.xxhash64("id", "pos"), F.col("blocks")).cast("int")
    rows = held.withColumn("block", block)
    own = ["id", "pos", *SETS, *KEYS, "first"]
    left = rows.select("seed", F.col("block").alias("i"), F.expr("explode(sequence(block, blocks - 1)) AS j"), *[F.col(n).alias(f"x_{n}") for n in own])
    right = rows.select("seed", F.expr("explode(sequence(0, block)) AS i"), F.col("block").alias("j"), *[F.col(n).alias(f"y_{n}") for n in own])

    def alike(side: str):
        one, other = F.col(f"x_{side}"), F.col(f"y_{side}")

        def missing(one, other):
            return F.bit_count(one.bitwiseAND(F.bitwise_not(other))) <= MISSING

        return (one != 0) & (other != 0) & missing(one, other) & missing(other, one)

    equal = [(F.col(f"x_{k}") != 0) & (F.col(f"x_{k}") == F.col(f"y_{k}")) for k in KEYS]
    either = F.col("x_first").bitwiseOR(F.col("y_first"))
    by_first = [e & (either.bitwiseAND(F.lit(1 << i)) != 0) for i, e in enumerate(equal)]
    rising = F.col("x_id") < F.col("y_id")
    pairs = left.join(right, ["seed", "i", "j"]).where((F.col("x_id") != F.col("y_id")) & ((F.col("i") < F.col("j")) | rising))
    pairs = pairs.where(alike("left") | alike("right")).where(~reduce(lambda p, q: p | q, equal) | reduce(lambda p, q: p | q, by_first))
    return pairs.select(
        F.least("x_id", "y_id").alias("a"),
        F.greatest("x_id", "y_id").alias("b"),
        F.when(rising, F.col("x_pos")).otherwise(F.col("y_pos")).alias("a_pos"),
        F.when(rising, F.col("y_pos")).otherwise(F.col("x_pos")).alias("b_pos"),
    )


class _Window:
    """Best scores by place in a stretch of GAP words, of the anchors at most GAP words of b behind.

    A Fenwick tree for prefixes, one for suffixes. Anchors come in order of b, so a
    node keeps a queue of those that may still be the best: falling in value, the
    oldest first.
    """

    def __init__(self) -> None:
        self.nodes: dict[tuple[int, int], deque] = {}

    def add(self, place: int, b: int, value: float, anchor: int) -> None:
        for side, k in ((0, place + 1), (1, GAP - place)):
            while k <= GAP:
                queue = self.nodes.setdefault((side, k), deque())
                while queue and queue[-1][1] <= value:
                    queue.pop()
                queue.append((b, value, anchor))
                k += k & -k

    def best(self, side: int, k: int, since: int) -> tuple[float, int]:
        """The best of the first k places from the left (side 0) or the right (1)."""
        found = (0.0, -1)
        while k:
            queue = self.nodes.get((side, k))
            while queue and queue[0][0] < since:
                queue.popleft()
            if queue and queue[0][1] > found[0]:
                found = queue[0][1:]
            k -= k & -k
        return found


def chains(a: list[int], b: list[int]) -> list[list[int]]:
    """Disjoint chains of anchors that rise in both documents, best first.

    Anchor j may follow i if a_i < a_j, b_i < b_j and neither gap is over GAP. The
    score is a seed each minus GAP_COST for each word between. Anchors are taken in
    order of b; those that may come before one lie in its own stretch of GAP words
    of a, left of it, or in the stretch before, not left of its place there.
    """
    order = sorted(range(len(a)), key=lambda i: (b[i], -a[i]))
    score, before = [0.0] * len(a), [-1] * len(a)
    windows: dict[int, _Window] = {}
    for i in order:
        stretch, place = divmod(a[i], GAP)
        since, here = b[i] - GAP, GAP_COST * (a[i] + b[i])
        found = (0.0, -1)
        if stretch in windows:
            found = windows[stretch].best(0, place, since)
        if stretch - 1 in windows:
            found = max(found, windows[stretch - 1].best(1, GAP - place, since))
        gain = found[0] - here
        score[i], before[i] = (1 + gain, found[1]) if found[1] >= 0 and gain > 0 else (1.0, -1)
        windows.setdefault(stretch, _Window()).add(place, b[i], score[i] + here, i)
    used, found = [False] * len(a), []
    for i in sorted(range(len(a)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            found.append(chain[::-1])
    return found


def _groups(keys: list[str], use: Callable[[pd.DataFrame], list[tuple]], columns: list[str]):
    """A mapInPandas body over sorted rows: `use` sees the rows of one key at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rows[keys].to_numpy()
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            out = [r for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for r in use(rows.iloc[s:e])]
            rest = rows.iloc[starts[-1] :]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if rest is not None and (out := use(rest)):
            yield pd.DataFrame(out, columns=columns)

    return run


def _listed(keys: list[str], use: Callable[..., list[tuple]], columns: list[str]):
    """As _groups, where `use` gets each column of a key's rows as a list: far less for each of many small groups."""

    def whole(rows: pd.DataFrame, starts: list[int], ends: list[int]) -> list[tuple]:
        parts = [rows[c].tolist() for c in rows.columns]
        return [r for s, e in zip(starts, ends, strict=True) for r in use(*[x[s:e] for x in parts])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rows[keys].to_numpy()
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))).tolist()
            rest = rows.iloc[starts[-1] :]
            if out := whole(rows.iloc[: starts[-1]], starts[:-1], starts[1:]):
                yield pd.DataFrame(out, columns=columns)
        if rest is not None and (out := whole(rest, [0], [len(rest)])):
            yield pd.DataFrame(out, columns=columns)

    return run


def chained(found: DataFrame) -> DataFrame:
    """a, b, chain, a_at, b_at: the seeds' places of every chain of a pair of documents."""

    def use(one: list[int], other: list[int], a: list[int], b: list[int]) -> list[tuple]:
        if len(a) == 1:
            return [(one[0], other[0], 0, a, b)]
        a, b = (list(x) for x in zip(*sorted(set(zip(a, b, strict=True))), strict=True))
        return [(one[0], other[0], n, [a[i] for i in c], [b[i] for i in c]) for n, c in enumerate(chains(a, b))]

    columns = ["a", "b", "chain", "a_at", "b_at"]
    ordered = found.select("a", "b", "a_pos", "b_pos").repartition("a", "b").sortWithinPartitions("a", "b", "b_pos", "a_pos")
    return ordered.mapInPandas(_listed(["a", "b"], use, columns), "a bigint, b bigint, chain int, a_at array<int>, b_at array<int>")


def blocks(docs: DataFrame) -> DataFrame:
    """id, blocks: the words of every document, BLOCK at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                words = words_of(text)
                out.append((id_, [" ".join(words[n : n + BLOCK]) for n in range(0, len(words), BLOCK)]))
            if out:
                yield pd.DataFrame(out, columns=["id", "blocks"])

    return docs.mapInPandas(run, "id bigint, blocks array<string>")


def _extend(a: list[str], b: list[str], i: int, j: int, step: int, cost: int = 2) -> tuple[int, int, int]:
    """How far a passage goes beyond (i, j).

    1 for an equal word and -`cost` for another; where three words agree again after up
    to HOP words of one side alone, the walk goes on there. The best place counts;
    the walk ends ten below it or at a text's end. Returns words of a, words of b
    and equal words.
    """
    start_i, start_j, equal, score = i, j, 0, 0
    best = (0, 0, 0, 0)

    def alike(i: int, j: int) -> bool:
        ends = i + 2 * step, j + 2 * step
        return 0 <= min(i, j, *ends) and max(i, ends[0]) < len(a) and max(j, ends[1]) < len(b) and all(a[i + n * step] == b[j + n * step] for n in range(3))

    while 0 <= i < len(a) and 0 <= j < len(b) and score > best[0] - 10:
        if a[i] == b[j]:
            equal, score = equal + 1, score + 1
        else:
            score -= cost
            for hop in range(1, HOP + 1):
                x, y = i + hop * step, j + hop * step
                if 0 <= x < len(a) and a[x] == b[j] and alike(x, j):
                    i += (hop - 1) * step
                    j -= step
                    break
                if 0 <= y < len(b) and a[i] == b[y] and alike(i, y):
                    i -= step
                    j += (hop - 1) * step
                    break
        i, j = i + step, j + step
        if score > best[0]:
            best = (score, abs(i - start_i), abs(j - start_j), equal)
    return best[1:]


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two short gaps."""
    if len(a) == len(b):
        along = sum(x == y for x, y in zip(a, b, strict=True))
        if along == len(a):
            return along
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def align(a: list[str], b: list[str], a_at: list[int], b_at: list[int], cost: int = 2) -> tuple[int, int, int, int, int]:
    """Span in a, span in b and equal words of a chain, from its seeds outwards; a low cost reaches farther."""
    equal, i, j = 0, a_at[0], b_at[0]
    for x, y in zip(a_at, b_at, strict=True):
        if x < i or y < j:  # seeds that overlap: count what is new
            over = max(i - x, j - y)
            x, y, size = x + over, y + over, K - over
        else:
            size = K
        if size <= 0:
            continue
        equal += _common(a[i:x], b[j:y]) + sum(p == q for p, q in zip(a[x : x + size], b[y : y + size], strict=False))
        i, j = x + size, y + size
    a_left, b_left, before = _extend(a, b, a_at[0] - 1, b_at[0] - 1, -1, cost)
    a_right, b_right, behind = _extend(a, b, i, j, 1, cost)
    return a_at[0] - a_left, i + a_right, b_at[0] - b_left, j + b_right, equal + before + behind


def passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Passages of at least 50 words that two documents share, four fifths of them or more.

    Returns doc_id, start, other_id, other_start, n_words, share: `other_id` is an
    earlier document; places count words (runs of letters, digits and underscores in
    lower case), `n_words` is the longer of the two spans and `share` the equal words
    in it. A text that an earlier document holds as a whole is reported beside the
    smallest of them only, which stands for it. Two documents that hold 50 or more
    words alike may be reported beside the first holder of these words instead of
    beside each other; all others that share a seed are compared with each other. A
    passage is followed up to 64 words beyond its outer seeds.

    Null and empty texts and rows without an id give nothing; rows that repeat an
    id with the same text count once, and of several texts of one id one counts;
    a passage that recurs within one document only is not shared; an empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.where("id is not null and text is not null and text <> ''")
    every = held(seeds(rows))
    whole, apart = copies(every)
    found = cut(chained(anchors(every, apart)), "chains")

    nothing = F.lit(None).cast("array<int>")

    def wanted(side: str, *places) -> DataFrame:
        """A row for a side of each chain, with the first and last block to be read; one side brings the seeds' places."""
        low, high = (F.floor(x / BLOCK).cast("int") for x in (F.greatest(F.lit(0), F.array_min(f"{side}_at") - MARGIN), F.array_max(f"{side}_at") + K + MARGIN))
        return found.select("a", "b", "chain", F.lit(side).alias("side"), F.col(side).alias("id"), low.alias("low"), high.alias("high"), *places)

    asked = wanted("a", "a_at", "b_at").union(wanted("b", nothing, nothing))
    words = F.concat_ws(" ", F.slice("blocks", F.col("low") + 1, F.col("high") - F.col("low") + 1)).alias("words")
    together = blocks(rows).join(asked, "id").select("a", "b", "chain", "side", "low", words, "a_at", "b_at")
    together = together.repartition("a", "b", "chain").sortWithinPartitions("a", "b", "chain", "side")

    def use(one: list, other: list, _: list, sides: list, lows: list, texts: list, a_at: list, b_at: list) -> list[tuple]:
        n = sides.count("a")  # more than one where an id repeats
        if not 0 < n < len(sides) or not texts[0] or not texts[n]:
            return []
        low = {"a": lows[0], "b": lows[n]}
        a, b = texts[0].split(" "), texts[n].split(" ")
        at, bt = ([int(x) - low[s] * BLOCK for x in places[0]] for s, places in (("a", a_at), ("b", b_at)))
        for cost in (2, 1):  # the farther reach only where the nearer is no passage
            a0, a1, b0, b1, equal = align(a, b, at, bt, cost)
            size = max(a1 - a0, b1 - b0)
            if min(a1 - a0, b1 - b0) >= least_words and equal >= least_share * size:
                break
        else:
            return []
        return [(other[0], b0 + low["b"] * BLOCK, one[0], a0 + low["a"] * BLOCK, size, equal / size)]

    columns = ["doc_id", "start", "other_id", "other_start", "n_words", "share"]
    schema = "doc_id bigint, start int, other_id bigint, other_start int, n_words int, share double"
    members = whole.where(F.col("n_words") >= least_words)
    members = members.select(F.col("id").alias("doc_id"), F.lit(0).alias("start"), F.col("rep").alias("other_id"), F.lit(0).alias("other_start"), "n_words", F.lit(1.0).alias("share"))
    return together.mapInPandas(_listed(["a", "b", "chain"], use, columns), schema).union(members)
