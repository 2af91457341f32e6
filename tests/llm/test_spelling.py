"""Words and their forms against every pair compared one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from proofcast.llm import spelling as S

RNG = random.Random(11)


def plain_counts(rows, slip, least=6):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if slip and h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, slip=None, min_count=5):
    n = {w: k for w, k in plain_counts(rows, slip).items() if k >= min_count}
    form, out = {}, []
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def edited(word):
    letters = "abcé"
    k = RNG.randrange(len(word) + 1)
    return RNG.choice([word[:k] + RNG.choice(letters) + word[k:], word[:k] + word[k + 1 :], word[:k] + RNG.choice(letters) + word[k + 1 :]])


def made(kinds, docs):
    base = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randrange(6, 10))) for _ in range(kinds)]
    words = base + [edited(w) for w in base for _ in range(4)] + [edited(edited(w)) for w in base]
    weights = [200] * kinds + [RNG.choice([1, 3, 30]) for _ in range(4 * kinds)] + [2] * kinds
    rows = []
    for i in range(docs):
        chosen = RNG.choices(words, weights, k=150)
        chosen += ["bonnets"] * 30 + ["bonnetz"] * 4 * (i % 3) + ["bonnetzz"] * (i % 4 == 1)
        rows.append((i, " ".join(w.upper() if RNG.random() < 0.1 else w for w in chosen) + "."))
    return rows


@pytest.mark.parametrize(("slip", "listed"), [(None, 2000), (7, 3)])
def test_forms(docs_of, monkeypatch, slip, listed):
    monkeypatch.setattr(S, "LISTED", listed)
    monkeypatch.setattr(S, "HELD", 50)
    rows = made(60, 60)
    got = sorted(map(tuple, S.spelling_forms(docs_of(rows), slip=slip).collect()))
    want = plain(rows, slip)
    assert got == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] != w[1] and w[1] for w in want)


def test_every_pair_of_a_dense_vocabulary(spark):
    words = sorted({"".join(RNG.choice("ab") for _ in range(RNG.randrange(4, 9))) for _ in range(400)} | {"aaaaaa", "aaaaa", "aaaa", "éèêëéè", "éèêëéé"})
    got = {(r["word"], r["other"]) for r in S.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_pivots_are_the_lightest_pair_apart():
    weight = {a + b: RNG.randrange(1, 30) for a in "abc" for b in "abc"}
    order = {g: k for k, (g, _) in enumerate(sorted(weight.items(), key=lambda x: (x[1], x[0])))}
    for _ in range(500):
        word = "".join(RNG.choice("abc") for _ in range(RNG.randrange(4, 12)))
        prefix, pivots = S.pivotal(word, order, weight)
        w = lambda i: weight[word[i : i + 2]]  # noqa: B023, E731
        ranks = sorted(order[word[i : i + 2]] for i in range(len(word) - 1))
        assert prefix == [i for i in range(len(word) - 1) if order[word[i : i + 2]] <= ranks[2]]
        pairs = [(w(i) + w(j), i, j) for i in prefix for j in prefix if j >= i + 2]
        assert sum(map(w, pivots)) == min(pairs)[0] and pivots[1] - pivots[0] >= 2 and set(pivots) <= set(prefix)


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (None, "nothing nothing"), (3, "ab 12 cd"), (4, "Nothing× nothing-nothing NOTHING"), (4, "nothing " * 9), (5, "x" * 200_000), (6, "İstanbul " * 6 + "ſhorten " * 5)]
    got = sorted(map(tuple, S.spelling_forms(docs_of(rows)).collect()))
    assert got == plain(rows)
    assert S.spelling_forms(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        S.spelling_forms(docs_of([]), min_length=3)
