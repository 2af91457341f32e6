"""SimHash against fingerprints and links made one by one."""

import random
from collections import Counter

import pytest
import xxhash

from proofcast.llm import simhash
from proofcast.llm.graph import components

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(4)) for _ in range(60)]


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, prints, bits=3):
    parent = list(range(len(ids)))

    def up(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[up(i)] = up(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[up(i)] = min(least.get(up(i), d), d)
    return [least.get(up(i)) for i in range(len(ids))]


def texts():
    base = [" ".join(RNG.choice(WORDS) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        words = RNG.choice(base).split()
        for _ in range(RNG.randrange(3)):
            words[RNG.randrange(len(words))] = RNG.choice(WORDS)
        rows.append((100 + k, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \t"), (None, base[0]), (903, "Uno DOS"), (904, "uno\x0bdos"), (905, "uno dos"), (906, "É a b c"), (100, "again")]


def test_fingerprints_and_classes(docs_of):
    rows = texts()
    got = simhash.simhash_classes(docs_of(rows))
    prints = [plain_print(t) for _, t in rows]
    want = Counter(zip([d for d, _ in rows], prints, roots([d for d, _ in rows], prints), strict=True))
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got.collect()) == want
    assert max(want.values()) == 1 and len({c for _, _, c in want}) < len(want)


@pytest.mark.parametrize("crowded", [256, 3])
def test_links_are_all_pairs_within_three_bits(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    centres = [RNG.getrandbits(64) for _ in range(6)]
    prints = set(centres)
    for c in centres:
        for _ in range(40):
            prints.add(c ^ sum(1 << b for b in RNG.sample(range(64), RNG.randrange(1, 5))))
        for _ in range(20):  # many that share a half
            prints.add(c ^ sum(1 << b for b in RNG.sample(range(32, 64), RNG.randrange(1, 6))))
    signed = lambda x: x - 2**64 if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp bigint"))
    found = [(r["u"], r["v"]) for r in got.collect()]
    values = [signed(p) for p in prints]
    want = {(a, b) for a in values for b in values if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert len(found) == len(set(found)) and set(found) == want


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u int, v int")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {x: 100 for x in range(101, 160)} | {201: 200}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_keep_one_and_empty(docs_of):
    rows = texts()
    kept = simhash.keep_one(docs_of(rows))
    prints = [plain_print(t) for _, t in rows]
    want = Counter(d for d, c in zip([d for d, _ in rows], roots([d for d, _ in rows], prints), strict=True) if d is None or d == c or d == 100)
    got = Counter(r["doc_id"] for r in kept.collect())
    assert {d for d in got if d != 100} == {d for d in want if d != 100} and "name" in kept.columns
    assert simhash.simhash_classes(docs_of([])).count() == 0
