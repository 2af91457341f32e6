"""Quality: the voters' model, and the scorer against labels it never saw."""

import numpy as np
from pyspark.sql import functions as F

from proofcast.llm import quality as q

SF = "/root/testdata/sf0.01"
CLEAN = "A quiet morning came over the hills, and nobody spoke for a while. Then the bells began."
JUNK = {
    "symbols": " ".join(w + "%%%" for w in CLEAN.split()),
    "capitals": " ".join(w.upper() + "!!" for w in CLEAN.split()),
    "repeats": "then " * 60,
    "bars": " | ".join(CLEAN.split()),
}


def test_votes():
    assert q.BAD not in q.profile(CLEAN)[1]
    for text in JUNK.values():
        assert q.BAD in q.profile(text)[1]
    assert q.profile("")[1] == q.profile(None)[1] == [q.NONE] * len(q.VOTERS)
    votes = [q.BAD, q.GOOD, q.NONE, q.GOOD, q.BAD, q.NONE, q.GOOD]
    assert q.votes_of(q.pattern_of(votes)) == votes


def test_long_words_are_read_whole():
    bare, text, marked = ("%" * 80, "%" * 80 + "word", "a%b%c%d%e%f%g%" + "word" * 30 + "%")
    forms = q._words(f"{bare} {text} {marked} {marked}x")[1].tolist()
    assert forms[0] == q._words("%")[1][0] and forms[1] == q._words("%word")[1][0]
    assert [q._ends_marked(f) for f in forms] == [False, False, True, False]


def test_posteriors_find_the_accurate_voters():
    rng = np.random.default_rng(1)
    counts, truth = {}, {}
    for _ in range(20000):
        good = rng.random() < 0.85
        kind = rng.integers(3)
        votes = [q.NONE] * len(q.VOTERS)
        for j in range(3):  # two of them know each kind of bad text
            votes[j] = q.GOOD if good or kind == j else q.BAD
        votes[3] = q.BAD if rng.random() < 0.02 else q.GOOD  # one that knows nothing
        p = q.pattern_of(votes)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    got = q.posteriors(counts)
    sure = [p for p in counts if q.votes_of(p)[3] == q.GOOD]
    assert all((got[p] > 0.5) == (np.mean(truth[p]) > 0.5) for p in sure)
    assert q.posteriors({}) == {}


def test_scores_agree_with_labels_never_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = q.fit_quality(docs, most=300)
    rows = docs.join(labels, "doc_id").select("quality", q.quality(F.col("text"), model).alias("s")).collect()
    good, bad = [r["s"] for r in rows if r["quality"] == 1], [r["s"] for r in rows if r["quality"] == 0]
    assert np.mean([s >= 0.5 for s in good]) > 0.99
    assert np.mean([s < 0.5 for s in bad]) > 0.9
    assert all(model.score(q.profile(t)[0]) < 0.5 for t in JUNK.values()) and model.score(q.profile(CLEAN)[0]) > 0.5


def test_odd_texts_and_columns(docs_of):
    many = [(100 + i, f"{CLEAN} {CLEAN.split()[i % 9]} again {i}") for i in range(120)]
    junk = [(1000 + i, list(JUNK.values())[i % 4] + f" {CLEAN.split()[i % 9]}") for i in range(60)]
    rows = [*many, *junk, (1, None), (2, ""), (3, CLEAN), (3, CLEAN), (None, CLEAN), (4, "x" * 300000), *((10 + i, t) for i, t in enumerate(JUNK.values()))]
    docs = docs_of(rows)
    kept = q.keep_good(docs, most=200)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect() if r["doc_id"] is None or r["doc_id"] < 100 and r["doc_id"] != 4)
    assert ids == [(False, 1), (False, 2), (False, 3), (False, 3), (True, None)]
    assert q.keep_good(docs_of([])).count() == 0
