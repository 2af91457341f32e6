"""The pipeline's stages, each against a plain version on its own input, and the entry point."""

import hashlib
import importlib.util
import os
import shutil
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from proofcast.llm import queries

from test_simhash import plain_print, roots  # isort: skip

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_all_but_the_last_return_documents(stages):
    columns = stages[0][1].columns
    assert all(df.columns == columns for _, df in stages[:-1])
    counts = [df.count() for _, df in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] and counts[-1] > 0.5 * counts[0]


def test_quality_keeps_labelled_good(spark, stages):
    kept = texts(stages[1][1])
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = [r["doc_id"] for r in labels if r["quality"] == 1], [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d not in kept for d in bad) >= 0.6 * len(bad)


def test_exact_dedup_keeps_the_largest_id(stages):
    before, after = texts(stages[1][1]), texts(stages[2][1])
    best = {}
    for d, t in before.items():
        best[t or ""] = max(d, best.get(t or "", d))
    assert set(after) == set(best.values())


def test_simhash_keeps_the_smallest_id(stages):
    before, after = texts(stages[2][1]), texts(stages[3][1])
    ids = sorted(before)
    assert set(after) == {d for d, c in zip(ids, roots(ids, [plain_print(before[d]) for d in ids]), strict=True) if d == c}


def test_decontamination_drops_documents_with_items(spark, stages):
    before, after = texts(stages[3][1]), texts(stages[4][1])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {d for d, t in before.items() if any(i in (t or "") for i in items)}
    assert not leaky & set(after)
    runs = {tuple(w[j : j + 8]) for w in (i.lower().split() for i in items) for j in range(len(w) - 7)}
    clean = {d for d, t in before.items() if not any(tuple(w[j : j + 8]) in runs for w in [(t or "").lower().split()] for j in range(len(w) - 7))}
    assert clean <= set(after)


def test_encoding_is_the_library_s(stages):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    before = texts(stages[4][1])
    got = {r["doc_id"]: r for r in stages[5][1].collect()}
    assert set(got) == set(before)
    for d, text in before.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, stages[-1][1].collect()))


def test_stages_take_an_empty_table_and_nulls(spark, stages):
    schema = stages[0][1].schema
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
        assert stage(spark, spark.createDataFrame([(None, None, None, None, None)], schema), SF).count() == 1


def test_entry_lists_one_query_for_each_operator():
    spec = importlib.util.spec_from_file_location("entry_with_llm", f"{ROOT}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_the_rest_imports_without_these_operators(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/proofcast", tmp_path / "proofcast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; names = e.queries(); assert names and 'pipeline' not in names and not any(n.startswith('op4_') for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
