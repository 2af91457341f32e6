"""Exact duplicates against plain grouping, with blocks small enough to recurse."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from proofcast.llm.exact_dedup import exact_dedup, keep_first

RNG = random.Random(1)
LONG = "".join(RNG.choice("abé") for _ in range(700))
ROWS = [
    (1, "same text"), (2, "same text"), (9, "same text"), (3, None), (4, ""), (5, LONG), (6, LONG), (7, LONG[:-1] + "z"),
    (8, "z" + LONG[1:]), (10, LONG + LONG), (11, "aaaa" * 3), (12, "aaaa" * 4), (13, "aaaa" * 4 + "a"), (None, "same text"), (None, "alone"), (None, "alone"),
    (20, "twice"), (20, "twice"), (21, "other"), (21, "another"),
]


def brute(rows, normalise=lambda t: t):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normalise(t or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        stays = ids.index(best)
        out += [(i, best, len(ids), k == stays, digest) for k, i in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_same_as_grouping(docs_of, block):
    got = exact_dedup(docs_of(ROWS), block_bytes=block)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(ROWS)


def test_normalised_texts(docs_of):
    from pyspark.sql import functions as F

    rows = [(1, "A b"), (2, "a B"), (3, "c")]
    got = exact_dedup(docs_of(rows), normalise=F.lower)
    assert Counter(map(tuple, got.collect())) == brute(rows, str.lower)


def test_empty_table(docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    assert keep_first(docs_of([])).count() == 0


def test_kept_rows_have_all_columns(docs_of):
    docs = docs_of(ROWS)
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    want = Counter((d, h) for (d, _, _, k, h), n in brute(ROWS).items() if k for _ in range(n))
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect()) == want


def test_plan_has_no_python(docs_of):
    plan = exact_dedup(docs_of(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
