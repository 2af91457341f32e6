"""Alignment of two tokenizers against groups and counts made one by one."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from proofcast.llm import token_alignment as A

BYTE = A.ByteLevel(str(P.path("byte_bpe_50k.tiktoken")), str(P.path("byte_bpe_50k.json")))
PIECE = A.Pieces(str(P.path("piece_bpe_32k.model")))
RNG = random.Random(9)


def plain_ids(text):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE.json)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=PIECE.model)
    # the byte alphabet of byte-level vocabularies: printable bytes stand for themselves
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = s.encode(text)
    a_bytes = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, a_bytes, b_bytes


def plain_groups(text):
    if not text:
        return []
    a, b, a_bytes, b_bytes = plain_ids(text)
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    ends_a, ends_b = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
    both = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in both]
    for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
        g = 0
        for i, e in zip(ids, ends, strict=True):
            while e > both[g]:
                g += 1
            groups[g][side].append(i)
    return groups


def plain(rows):
    made = [(d, plain_groups(t)) for d, t in rows]
    counts = Counter(p for _, g in made for p in {(x, y) for a, b in g for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for d, g in made:
        pairs = [(x, y) for a, b in g for x in a for y in b]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), shown))
    return sorted(out, key=str)


def rows():
    words = ["the", "Grüße", "naïve", "antidisestablishmentarianism", "12345", "日本語", "don't", "\t", "  ", "\n\n", "😀", "xyzzyq", "Москва", "a▁b", "<s>", "<|endoftext|>", " ", "\x00", "é"]
    made = [(i, " ".join(RNG.choices(words, k=RNG.randrange(1, 30)))) for i in range(80)]
    return made + [(900, None), (901, ""), (902, " "), (None, "the the"), (7, made[7][1]), (903, "aaaa" * 500 + " b" * 300), (904, "▁"), (905, "日" * 400)]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_documents(docs_of, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK_TOKENS", block)
    data = rows()
    want = plain(data)
    got = sorted(map(tuple, A.align_documents(docs_of(data), BYTE, PIECE).collect()), key=str)
    assert got == want
    digests = sorted((r["doc_id"], r["groups"]) for r in A.align_documents(docs_of(data), BYTE, PIECE, digest=True).where("doc_id is not null").collect())
    assert digests == sorted((w[0], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want if w[0] is not None)


def test_groups_of_random_ends():
    for k in range(3000):
        total = RNG.randrange(1, 200)
        thin = RNG.choice([0.05, 0.5, 0.95])
        every = [x for x in range(1, total) if RNG.random() < 0.5]
        ea = sorted({x for x in every if RNG.random() < thin} | {x for x in range(1, total) if RNG.random() < 0.1 * (k % 3)} | {total})
        eb = sorted({x for x in every if RNG.random() < 0.95} | {total})
        a_ends, b_ends = A.aligned(ea, eb)
        both = sorted(set(ea) & set(eb))
        assert [ea[i - 1] for i in a_ends] == both == [eb[j - 1] for j in b_ends]


def test_wide_groups_count_the_same(monkeypatch):
    import numpy as np

    a, b = np.array([RNG.randrange(9) for _ in range(120)]), np.array([RNG.randrange(7) for _ in range(90)])
    a_ends, b_ends = np.array([1, 2, 80, 120]), np.array([1, 5, 60, 90])
    found = A.links(a, b, a_ends, b_ends)
    monkeypatch.setattr(A, "WIDE", 3)
    again = A.links(a, b, a_ends, b_ends)
    want = Counter()
    s = t = 0
    for i, j in zip(a_ends, b_ends, strict=True):
        want.update(int(x) << 32 | int(y) for x in a[s:i] for y in b[t:j])
        s, t = i, j
    for n, pairs, times in (found, again):
        assert n == sum(want.values()) and dict(zip(pairs.tolist(), times.tolist(), strict=True)) == dict(want)


def test_both_byte_level_libraries_agree_on_every_code_point():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(BYTE.json)
    slow.encode_special_tokens = True
    fast = A.encoder(BYTE)
    texts = [f"a{chr(c)}b 1{chr(c)}{chr(c)} {chr(c)}x'{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        assert [e.ids for e in slow.encode_batch([" " + t for t in part], add_special_tokens=False)] == [fast.encode(t) for t in part]


def test_long_white_space_and_long_texts(docs_of):
    data = [(1, " " * 300_000 + "x"), (2, "ab cd\n" * 50_000), (3, "z" * 100_000)]
    got = {r["doc_id"]: r for r in A.align_documents(docs_of(data), BYTE, PIECE, digest=True).collect()}
    for d, t in data[:2]:
        a, b, *_ = plain_ids(t)
        assert (got[d]["n_a"], got[d]["n_b"]) == (len(a), len(b))
    assert got[3]["n_links"] >= got[3]["n_a"]


def test_empty_table(docs_of):
    assert A.align_documents(docs_of([]), BYTE, PIECE).count() == 0
    assert [tuple(r) for r in A.align_documents(docs_of([(1, None)]), BYTE, PIECE).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
