"""Byte-pair encoding and decoding with a published word vocabulary.

Merging uses a segment tree over the ranks of adjacent pairs: the root names the
leftmost pair of lowest rank, and a merge changes three leaves. Words of similar
length are merged together, a tree for each in one array.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose ids a task remembers; beyond, the memory is emptied.
REMEMBERED = 600_000
#: Words of the texts that are encoded together.
TOGETHER = 1_000_000
#: Symbols of the longest words that are merged together, and the words of one such merge.
WIDEST = 64
ROWS = 8192
NONE = 1 << 62


# The Unicode versions that the published vocabulary is used with.
# Letters and numbers are those of Unicode 16; these it has beyond Unicode 15.1.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
# Lower case is that of Unicode 17; these it has beyond Unicode 15.1: first, last, first of the lower ones.
LOWER_17 = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
# Composed forms are those of Unicode 9; these later marks neither move nor compose.
LATER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C),
    (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27),
    (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99),
    (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)


class Letters:
    """Letters, numbers, lower case and composed forms of fixed Unicode versions.

    The Python modules follow versions of their own. `odd` marks the code points
    for which they would act otherwise; texts without such go to them as they are.
    """

    #: One of each class, for the expression that finds words.
    STAND_INS = {"L": "\u014b", "N": "\u00b2", "": "!"}

    def __init__(self):
        everything = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        kind = {c: k for c in everything if (k := unicodedata.category(c)[0]) in "LN"}
        for ranges, name in ((LETTERS_16, "L"), (NUMBERS_16, "N")):
            kind.update((chr(c), name) for a, b in ranges for c in range(a, b + 1))
        whole = "".join(everything)
        seen = dict.fromkeys(regex.findall(r"\p{L}", whole), "L") | dict.fromkeys(regex.findall(r"\p{N}", whole), "N")
        differ = (c for c in seen.keys() | kind.keys() if seen.get(c) != kind.get(c))
        #: Code points that the expression takes for another class: one it takes for theirs.
        self.stand_in = {ord(c): self.STAND_INS[kind.get(c, "")] for c in differ}
        self.lower = {a + i: low + i for a, b, low in LOWER_17 for i in range(b - a + 1)}
        marks = {c for a, b in LATER_MARKS for c in range(a, b + 1)}
        self.later = regex.compile("([" + "".join(map(chr, sorted(marks))) + "])")
        self.odd = np.zeros(0x110000, bool)
        self.odd[[*self.stand_in, *self.lower, *marks]] = True

    def plain(self, text: str) -> bool:
        """Whether the Python modules treat each code point of a text as wanted."""
        return text.isascii() or not self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any()

    def normalise(self, text: str) -> str:
        """`normalise` for any text."""
        parts = self.later.split(text)
        parts[::2] = [normalise(part) for part in parts[::2]]
        return "".join(parts).translate(self.lower)

    def words(self, pattern: regex.Pattern, text: str) -> list[str]:
        """`pattern.findall(text)` by the fixed classes."""
        return [text[m.start() : m.end()] for m in pattern.finditer(text.translate(self.stand_in))]


def normalise(text: str) -> str:
    """Composed form, letters in lower case one by one.

    The file also turns blanks into one space; words never hold a blank, so
    that step changes nothing and is left out.
    """
    text = unicodedata.normalize("NFC", text)
    # a whole text's lower() would give the last sigma of a word its own form
    return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))


@lru_cache(maxsize=1)
def letters() -> Letters:
    """One copy for each Python worker."""
    return Letters()


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge until no pair has a rank. `ranks`: pair -> (rank, merged symbol).

    Leaf i of the tree holds rank * n + i of the pair that starts at i, or NONE;
    an inner node holds the smaller of its children. Point updates walk up while
    the value changes.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * width)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    find = ranks.get
    for i in range(n - 1):
        hit = find((symbols[i], symbols[i + 1]))
        if hit:
            tree[width + i] = hit[0] * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int) -> None:
        j = after[i]
        hit = find((symbols[i], symbols[j])) if j < n else None
        value, i = (hit[0] * n + i if hit else NONE), i + width
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            least = value if value < other else other
            if tree[i] == least:
                return
            tree[i] = value = least

    def clear(i: int) -> None:
        i += width
        tree[i] = NONE
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            tree[i] = a if a < b else b

    while tree[1] < NONE:
        i = tree[1] % n
        j = after[i]
        symbols[i] = find((symbols[i], symbols[j]))[1]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        symbols[j] = -1
        clear(j)
        put(i)
        if before[i] >= 0:
            put(before[i])
    return [s for s in symbols if s >= 0]


class PairTable:
    """Ranks of pairs, looked up for many pairs at once."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([(a << 32) | b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.array([r for r, _ in ranks.values()], np.int64)[order], -1)
        self.merged = np.zeros(len(ranks), np.int64)
        for rank, symbol in ranks.values():
            self.merged[rank] = symbol

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], -1)


def merge_many(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> None:
    """`merge` for many words of at most `width` symbols, one tree for each row.

    `symbols` is (words, width), a power of two wide, and is changed in place:
    merged away symbols become -1. All words take their next merge together.
    """
    count, width = symbols.shape
    spot = np.arange(width)
    tree = np.full((count, 2 * width), NONE, np.int64)
    pair = table.find(symbols[:, :-1], symbols[:, 1:])
    ok = (pair >= 0) & (spot[:-1] < (lengths - 1)[:, None])
    tree[:, width : 2 * width - 1] = np.where(ok, pair * width + spot[:-1], NONE)
    for level in range(width.bit_length() - 2, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = tree[:, 2 * lo : 4 * lo].reshape(count, lo, 2).min(axis=2)
    after = np.tile(spot + 1, (count, 1))
    before = np.tile(spot - 1, (count, 1))
    flat, flat_symbols, flat_after, flat_before = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        base, wide = rows * width, rows * (2 * width)
        rank, i = np.divmod(flat[wide + 1], width)
        j = flat_after[base + i]
        k = flat_after[base + j]
        flat_symbols[base + i] = table.merged[rank]
        flat_symbols[base + j] = -1
        flat_after[base + i] = k
        right = k < lengths[rows]
        flat_before[(base + k)[right]] = i[right]
        h = flat_before[base + i]
        left = h >= 0
        flat[wide + width + j] = NONE
        found = table.find(flat_symbols[base + i], flat_symbols[base + np.where(right, k, 0)])
        flat[wide + width + i] = np.where(right & (found >= 0), found * width + i, NONE)
        at = base[left] + h[left]
        found = table.find(flat_symbols[at], flat_symbols[base[left] + i[left]])
        flat[wide[left] + width + h[left]] = np.where(found >= 0, found * width + h[left], NONE)
        # the three leaves' paths to the root, level by level
        paths = np.concatenate([j, i, h[left]]) + width
        wide3 = np.concatenate([wide, wide, wide[left]])
        for _ in range(width.bit_length() - 1):
            paths >>= 1
            child = wide3 + 2 * paths
            flat[wide3 + paths] = np.minimum(flat[child], flat[child + 1])
        rows = rows[flat[wide + 1] < NONE]


class WordBPE:
    """The vocabulary of one file, and what it makes of words and texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.table = PairTable(self.ranks)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.letters = letters()
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        printed = byte_letters()
        self.inner = [self.vocab.get(printed[b], -1) for b in range(256)]
        self.last = [self.vocab.get(printed[b] + self.end, -1) for b in range(256)]
        self.known: dict[str, bytes] = {}

    def start(self, word: str) -> list[int]:
        """A word's bytes as symbols; bytes that the vocabulary lacks are left out."""
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        return symbols if min(symbols) >= 0 else [s for s in symbols if s >= 0]

    def learn(self, words: set[str]) -> None:
        """Merge words and remember their ids."""
        groups: dict[int, list[tuple[str, list[int]]]] = {}
        for word in words:
            symbols = self.start(word)
            width = max(4, 1 << (len(symbols) - 1).bit_length()) if symbols else 4
            groups.setdefault(width if width <= WIDEST else 0, []).append((word, symbols))
        for width, group in groups.items():
            for at in range(0, len(group), ROWS):
                part = group[at : at + ROWS]
                if not width:
                    for word, symbols in part:
                        self.known[word] = pack(merge(symbols, self.ranks))
                    continue
                lengths = np.array([len(s) for _, s in part], np.int64)
                grid = np.full((len(part), width), -1, np.int64)
                grid[np.arange(width) < lengths[:, None]] = list(chain.from_iterable(s for _, s in part))
                merge_many(grid, lengths, self.table)
                left = grid >= 0
                ids = grid[left].astype("<u4").tobytes()
                ends = np.cumsum(left.sum(axis=1)) * 4
                begin = 0
                for (word, _), end in zip(part, ends.tolist(), strict=True):
                    self.known[word] = ids[begin:end]
                    begin = end

    def parts(self, text: str) -> list[str]:
        """Words in lower case of a text without special tokens."""
        if self.letters.plain(text):
            return self.pattern.findall(normalise(text))
        return self.letters.words(self.pattern, self.letters.normalise(text))

    def split(self, text: str) -> list[str]:
        """Words in lower case; special tokens keep their own form."""
        if not self.marks:
            return self.parts(text)
        words: list[str] = []
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                words.append(part)
            else:
                words += self.parts(part)
        return words

    def packed_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of texts as little-endian 32-bit integers."""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            waiting.append(self.split(text))
            size += len(waiting[-1])
            if size >= TOGETHER:
                yield from self._pack(waiting)
                waiting, size = [], 0
        yield from self._pack(waiting)

    def _pack(self, texts: list[list[str]]) -> Iterator[bytes]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known.update((mark, pack([i])) for mark, i in self.special.items())
        self.learn(set().union(*texts).difference(self.known))
        for words in texts:
            yield b"".join(map(self.known.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return unpack(next(self.packed_many([text])))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens between spaces, as the library writes them where a file names no decoder."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


@lru_cache(maxsize=4)
def load(path: str) -> WordBPE:
    """One copy for each Python worker."""
    return WordBPE(path)


def encoded(text: Column, path: str) -> Column:
    """Ids of whole texts as an array<int>; null gives no ids."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for batch in batches:
            yield pd.Series([unpack(p) for p in bpe.packed_many(t or "" for t in batch)], dtype=object)

    return of(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of ids; null gives the empty text, unknown ids are left out."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for batch in batches:
            yield pd.Series([bpe.decode([] if i is None else list(i)) for i in batch], dtype=object)

    return of(ids)


def round_trip(text: Column, path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of a text encoded and decoded again.

    Ids and decoded text stay in the task, so only their digests are written.
    """

    @F.pandas_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path)

        def ends(packed: bytes) -> tuple:
            back = bpe.decode(unpack(packed))
            return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()

        for batch in batches:
            results = [ends(p) for p in bpe.packed_many(t or "" for t in batch)]
            yield pd.DataFrame(results, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)
