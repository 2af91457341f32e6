"""Encoding and decoding against the tokenizers library and a naive merge loop."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from proofcast.llm.bpe import LATER_MARKS, LETTERS_16, LOWER_17, NUMBERS_16, PairTable, WordBPE, byte_letters, decoded, encoded, merge, merge_many, round_trip
from proofcast.llm.queries import tokenizer_path

np = pytest.importorskip("numpy")
tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "", None, "Hello world, it's we'll DON'T", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ßẞ Ǆ", "é é ﬁ ½ ²3 ٣",
    "日本語テキスト 한국어 가", "😀👩‍👩‍👧 ___--!!", "\x00\x01﻿", "a" * 5000, "ab" * 700 + " x", "x\x1fy\x85z 　w", "été Über ñandú 2024 3.14 %%% &&& ***", " \n\t ",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def naive(symbols, ranks):
    symbols = list(symbols)
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i : i + 2] = [ranks[symbols[i], symbols[i + 1]][1]]


def test_merge_takes_the_leftmost_of_lowest_rank():
    rng = random.Random(2)
    for _ in range(300):
        pairs = {(rng.randrange(6), rng.randrange(6)) for _ in range(12)}
        ranks = {p: (r, 6 + r) for r, p in enumerate(sorted(pairs))}
        ranks |= {(6 + rng.randrange(6), rng.randrange(6)): (len(ranks) + k, 40 + k) for k in range(3)}
        ranks = {p: (r, ranks[p][1]) for r, p in enumerate(sorted(ranks, key=lambda p: ranks[p][0]))}
        words = [[rng.randrange(6) for _ in range(rng.randrange(0, 17))] for _ in range(8)]
        want = [naive(w, ranks) for w in words]
        assert [merge(list(w), ranks) for w in words] == want
        # the table numbers merged symbols by rank
        grid = np.full((8, 16), -1, np.int64)
        for i, w in enumerate(words):
            grid[i, : len(w)] = w
        merge_many(grid, np.array([len(w) for w in words]), PairTable(ranks))
        assert [[s for s in row if s >= 0] for row in grid.tolist()] == want


def test_same_ids_and_text_as_the_library(library):
    bpe = WordBPE(tokenizer_path())
    for text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert bpe.encode(text or "") == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice([chr(rng.randrange(32, 0x250)), "the ", "\n", "ing", "é"]) for _ in range(rng.randrange(60)))
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


CODE_POINTS = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("form", ["{}", "a{}b", "a\u0315{}\u0334", "{}\u0307 1{}2!{}?"])
def test_every_code_point_as_the_library_splits_it(library, form):
    bpe, printed = WordBPE(tokenizer_path()), byte_letters()
    for at in range(0, len(CODE_POINTS), 1024):
        text = " ".join(form.replace("{}", chr(c)) for c in CODE_POINTS[at : at + 1024])
        want = [word for word, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        assert ["".join(printed[b] for b in word.encode()) for word in bpe.split(text)] == want


def test_ids_of_code_points_that_modules_know_differently(library):
    bpe = WordBPE(tokenizer_path())
    ranges = [(r[0], r[1]) for r in (*LETTERS_16, *NUMBERS_16, *LOWER_17, *LATER_MARKS)]
    texts = [f"x{chr(a)} {chr(b)}y {chr(a)}\u0301{chr(b)}\u0323 It{chr(a)}'s" for a, b in ranges]
    texts += ["\U00011935\U00011930 \U00011938\u0301", "\u0558a \U0003fc16b"]
    for text in texts:
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_columns(docs_of, library):
    path = tokenizer_path()
    df = docs_of(list(enumerate(TEXTS))).withColumn("ids", encoded(F.col("text"), path))
    rows = df.select("text", "ids", decoded(F.col("ids"), path).alias("back"), round_trip(F.col("text"), path).alias("r")).collect()
    for row in rows:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert list(row["ids"]) == ids and row["back"] == back
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert tuple(row["r"]) == (len(ids), digest, hashlib.sha256(back.encode()).hexdigest())
    assert docs_of([]).select(round_trip(F.col("text"), path)).count() == 0
