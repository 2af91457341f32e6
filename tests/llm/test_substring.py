"""Substring dedup against a search for all shared runs of words."""

import random

import pytest

from proofcast.llm import substring_dedup as s

RNG = random.Random(8)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 8))) for _ in range(3000)]


def prose(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def brute_chain_score(a, b):
    """Best score of a chain that ends at each anchor, by trying all predecessors."""
    order = sorted(range(len(a)), key=lambda i: (b[i], a[i]))
    score = {}
    for i in order:
        score[i] = 1.0
        for j in score:
            if a[j] < a[i] and b[j] < b[i] and a[i] - a[j] <= s.GAP and b[i] - b[j] <= s.GAP:
                score[i] = max(score[i], 1 + score[j] - s.GAP_COST * (a[i] - a[j] + b[i] - b[j]))
    return max(score.values())


def test_best_chain():
    for _ in range(200):
        n = RNG.randrange(1, 14)
        a, b = [RNG.randrange(90) for _ in range(n)], [RNG.randrange(90) for _ in range(n)]
        found = s.chains(a, b)
        assert sorted(i for c in found for i in c) == list(range(n))
        best = found[0]
        got = len(best) - s.GAP_COST * (a[best[-1]] - a[best[0]] + b[best[-1]] - b[best[0]])
        assert got == pytest.approx(brute_chain_score(a, b))
        assert all(a[i] < a[j] and b[i] < b[j] for c in found for i, j in zip(c, c[1:], strict=False))


def test_align_counts_equal_words():
    a = "p q r s t u v w x y z one two three four five six".split()
    b = "p q r s t u V w x y z one two and three four five six".split()
    assert s.align(a, b, [0, 7], [0, 7]) == (0, 17, 0, 18, 16)
    assert s.align(b, a, [0], [0]) == (0, 18, 0, 17, 16)
    back = [x[::-1] for x in (a, b)]
    assert s.align(*back, [12], [13]) == (0, 17, 0, 18, 16)


def documents():
    shared, fuzzy = prose(60), prose(120)
    changed = list(fuzzy)
    for i in range(7, 120, 14):
        changed[i] = "changed"
    whole = prose(700)
    return [
        (1, prose(80) + shared + prose(50)), (2, prose(10) + shared), (3, shared + prose(200)), (4, prose(300)), (5, prose(30) + fuzzy + prose(9)),
        (6, prose(45) + changed), (7, whole), (8, whole), (9, shared[:40] + prose(100)), (10, ["the"] * 400), (11, prose(20) + fuzzy + prose(20) + fuzzy),
    ]


def test_passages(docs_of):
    docs = documents()
    text = [(i, " ".join(w)) for i, w in docs]
    frame = docs_of([*text, (20, None), (21, ""), (None, text[0][1]), text[6]])
    rows = s.passages(frame).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in rows}
    # 6 and 11 may also meet in seeds that 5 lacks by chance
    assert pairs - {(11, 6)} == {(2, 1), (3, 1), (6, 5), (8, 7), (11, 5)}
    by = {(r["doc_id"], r["other_id"]): r for r in rows}
    assert tuple(by[2, 1])[1:] == (10, 1, 80, 60, 1.0)
    assert by[8, 7]["n_words"] == 700 and by[6, 5]["share"] > 0.9 and 110 <= by[6, 5]["n_words"] <= 125
    assert sum((r["doc_id"], r["other_id"]) == (11, 5) for r in rows) == 2


def test_every_shared_run_of_fifty_words_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    holders = {}
    for r in docs.collect():
        words = s.words_of(r["text"])
        for i in range(len(words) - 49):
            holders.setdefault(" ".join(words[i : i + 50]), {}).setdefault(r["doc_id"], i)
    repeated = lambda run: len(set(run.split())) < 10  # noqa: E731  one word over and over
    want = {d for run, ids in holders.items() if len(ids) > 1 and not repeated(run) for d in ids}
    rows = s.passages(docs).collect()
    found = {x for r in rows for x in (r["doc_id"], r["other_id"])}
    assert want and want <= found
    by_id = {r["doc_id"]: s.words_of(r["text"]) for r in docs.collect()}
    for r in rows:
        a = by_id[r["doc_id"]][r["start"] : r["start"] + r["n_words"]]
        b = by_id[r["other_id"]][r["other_start"] : r["other_start"] + r["n_words"]]
        assert len(set(a) & set(b)) >= 0.5 * len(set(a)) and r["n_words"] >= 50 and r["share"] >= 0.8


def test_earlier_holders_of_parts_hide_no_passage(docs_of):
    whole = prose(50)
    docs = [(1, whole[:30]), (2, whole[20:]), (3, whole), (4, whole)]
    rows = s.passages(docs_of([(i, " ".join(prose(40) + w + prose(40))) for i, w in docs])).collect()
    assert {(r["doc_id"], r["other_id"]): r["n_words"] for r in rows} == {(4, 3): 50}


def test_words_put_in_leave_the_surroundings_alike(docs_of):
    rng, docs = random.Random(3), []
    for n, every in enumerate(range(8, 13)):
        one = [rng.choice(VOCAB) for _ in range(120)]
        other = [w for i, x in enumerate(one) for w in ((x, "extra") if i % every == every - 1 else (x,))]
        for k, words in enumerate((one, other)):
            docs.append((10 * n + k, " ".join(prose(40) + words + prose(40))))
    rows = s.passages(docs_of(docs)).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(10 * n + 1, 10 * n) for n in range(5)}


def test_a_long_passage_does_not_hide_the_next():
    for top in (90, 300, 1000):
        for _ in range(60):
            n = RNG.randrange(1, 60)
            a, b = [RNG.randrange(top) for _ in range(n)], [RNG.randrange(top) for _ in range(n)]
            best = s.chains(a, b)[0]
            got = len(best) - s.GAP_COST * (a[best[-1]] - a[best[0]] + b[best[-1]] - b[best[0]])
            assert got == pytest.approx(brute_chain_score(a, b))
    first, second = list(range(0, 700, 10)), list(range(850, 910, 10))
    assert sorted(map(len, s.chains(first + second, first + second))) == [6, 70]


def test_empty(docs_of):
    assert s.passages(docs_of([])).count() == 0
    assert s.passages(docs_of([(1, "just one text")])).count() == 0


def changed_words(words, share, rng):
    places = set(rng.sample(range(len(words)), round(share * len(words))))
    return [rng.choice(VOCAB) if i in places else w for i, w in enumerate(words)]


def test_unrelated_earlier_holders_of_seeds_hide_no_fuzzy_passage(docs_of):
    """The first document of each triple holds the passage's pieces of five words, apart; the third lacks 8 words of the second's."""
    rng, docs = random.Random(6), []
    noise = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    for t in range(40):
        passage = noise(60)
        other = list(passage)
        for i in rng.sample(range(60), 8):
            other[i] = rng.choice(VOCAB)
        pieces = [w for i in range(0, 60, 5) for w in (*noise(30), *passage[i : i + 5])]
        docs += [(3 * t, " ".join(pieces)), (3 * t + 1, " ".join(noise(40) + passage + noise(40))), (3 * t + 2, " ".join(noise(40) + other + noise(40)))]
    pairs = {(r["doc_id"], r["other_id"]) for r in s.passages(docs_of(docs)).collect()}
    lost = [t for t in range(40) if (3 * t + 2, 3 * t + 1) not in pairs]
    assert len(lost) <= 4


@pytest.mark.parametrize(("share", "least"), [(0.1, 0.9), (0.15, 0.8), (0.18, 0.7)])
def test_recall_of_changed_passages(docs_of, share, least):
    rng, docs = random.Random(5), []
    for t in range(100):
        one = [rng.choice(VOCAB) for _ in range(60)]
        docs += [(2 * t, " ".join(prose(30) + one + prose(30))), (2 * t + 1, " ".join(prose(30) + changed_words(one, share, rng) + prose(30)))]
    pairs = {(r["doc_id"], r["other_id"]) for r in s.passages(docs_of(docs)).collect()}
    assert sum((2 * t + 1, 2 * t) in pairs for t in range(100)) >= 100 * least


def test_an_earlier_holder_of_less_than_a_passage_hides_none(docs_of):
    """The first document of each triple holds 45 of the 50 words that the others share."""
    rng, docs = random.Random(11), []
    noise = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    for t in range(30):
        passage = noise(50)
        docs += [(3 * t + k, " ".join(noise(40) + passage[:n] + noise(40))) for k, n in enumerate((45, 50, 50))]
    pairs = {(r["doc_id"], r["other_id"]) for r in s.passages(docs_of(docs)).collect()}
    assert {(3 * t + 2, 3 * t + 1) for t in range(30)} <= pairs


def variants():
    """Four groups of five documents, each with the words of another twelfth of a common passage changed."""
    rng, docs = random.Random(12), []
    noise = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    for g in range(4):
        passage = noise(72)
        for v in range(5):
            words = [rng.choice(VOCAB) if 12 * v <= i < 12 * v + 12 and i % 3 == 0 else w for i, w in enumerate(passage)]
            docs.append((5 * g + v, " ".join(noise(40) + words + noise(40))))
    return docs


@pytest.mark.parametrize("crowd", [4096, 2])
def test_all_variants_of_a_passage_meet(docs_of, monkeypatch, crowd):
    monkeypatch.setattr(s, "CROWD", crowd)
    pairs = {(r["doc_id"], r["other_id"]) for r in s.passages(docs_of(variants())).collect()}
    assert pairs == {(5 * g + v, 5 * g + u) for g in range(4) for v in range(5) for u in range(v)}


def test_copies_are_reported_beside_the_first(docs_of):
    rng = random.Random(13)
    text = " ".join(rng.choice(VOCAB) for _ in range(60))
    other = " ".join(rng.choice(VOCAB) for _ in range(30)) + " " + text
    docs = [(9, text), (4, text), (7, text), (7, text), (5, other), (6, "short"), (8, "short")]
    rows = s.passages(docs_of(docs)).collect()
    assert sorted((r["doc_id"], r["other_id"], r["start"], r["other_start"], r["n_words"], r["share"]) for r in rows) == [
        (5, 4, 30, 0, 60, 1.0), (7, 4, 0, 0, 60, 1.0), (9, 4, 0, 0, 60, 1.0),
    ]


def test_a_passage_copied_whole_is_not_expanded(docs_of):
    rng = random.Random(14)
    noise = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    passage = noise(90)
    rows = s.passages(docs_of([(i, " ".join(noise(30) + passage + noise(30))) for i in range(12)])).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(i, 0) for i in range(1, 12)}


def test_seeds_that_one_document_holds_are_not_stored(docs_of):
    """Only shared seeds and a row for each document's digest go on; what stands around a seed is dealt out once."""
    rng = random.Random(15)
    noise = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    passage = noise(60)
    docs = docs_of([(i, " ".join(noise(300) + (passage if i < 2 else []) + noise(300))) for i in range(8)])
    rows = docs.selectExpr("doc_id AS id", "text")
    every, kept = s.seeds(rows).collect(), s.held(s.seeds(rows)).collect()
    holders = {}
    for r in every:
        holders.setdefault(r["seed"], set()).add(r["id"])
    assert {(r["seed"], r["id"], r["pos"]) for r in kept} == {(r["seed"], r["id"], r["pos"]) for r in every if r["pos"] < 0 or len(holders[r["seed"]]) > 1}
    assert 8 < len(kept) < len(every) / 5 and {r["blocks"] for r in kept} == {1}


def test_rows_of_a_key_meet_whatever_the_batches():
    rows = s.pd.DataFrame({"a": [1, 1, 1, 2, 3, 3], "b": [1, 1, 2, 2, 2, 2], "x": list("uvwxyz")})
    use = lambda a, b, x: [(a[0], b[0], "".join(x))]
    for size in range(1, 7):
        batches = (rows.iloc[n : n + size] for n in range(0, 6, size))
        out = s.pd.concat(s._listed(["a", "b"], use, ["a", "b", "x"])(batches))
        assert out.to_numpy().tolist() == [[1, 1, "uv"], [1, 2, "w"], [2, 2, "x"], [3, 2, "yz"]]
