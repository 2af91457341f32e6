"""The operators bound to the supplied tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofcast.llm.bpe import round_trip
from proofcast.llm.common import held_out, table
from proofcast.llm.decontaminate import item_classes, leaks
from proofcast.llm.embedding_dedup import embedding_classes
from proofcast.llm.exact_dedup import exact_dedup
from proofcast.llm.langid import fit_languages, predict
from proofcast.llm.line_dedup import line_dedup
from proofcast.llm.quality import fit_quality, quality
from proofcast.llm.simhash import simhash_classes
from proofcast.llm.spelling import spelling_forms
from proofcast.llm.substring_dedup import passages
from proofcast.llm.token_alignment import ByteLevel, Pieces, align_documents
from proofcast.llm.toxicity import fit_toxicity, toxicity
from proofcast.llm.warc import archive, page_of

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a published vocabulary lies on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", round_trip(F.col("text"), tokenizer_path()).alias("r")).select("doc_id", "r.*")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"))
    model = fit_languages(docs.where(~apart))
    return docs.select("doc_id", apart.alias("held_out"), predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; `kept` is what a filter at one half keeps."""
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", quality(F.col("text"), fit_quality(docs)).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive(table(spark, sf_dir, "pages"))
    return read.select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, its class and the words that line up."""
    items = table(spark, sf_dir, "benchmark")
    found = leaks(table(spark, sf_dir, "documents"), items)
    return found.join(item_classes(items).select("item_id", "class_id").distinct(), "item_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_classes(table(spark, sf_dir, "documents"), size=3, bits=3)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"), min_chars=10, threshold=2)
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"), min_length=6, min_count=5, times=5, slip=199)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level = ByteLevel(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json"))
    found = align_documents(table(spark, sf_dir, "documents"), byte_level, Pieces(tokenizer_path("piece_bpe_32k.model")), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(table(spark, sf_dir, "embeddings"), least=0.95)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_spelling": op11_spelling,
    "op12_token_alignment": op12_token_alignment,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLE_SQL = {
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload
            FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload) END AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM f
    """,
    "op9_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (
            SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d
        ), k AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), s AS (
            SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), m AS (
            SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.first AS gone
            FROM k LEFT JOIN s ON k.key = s.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op13_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
        ), n AS (
            SELECT vec_id, e, sqrt(list_sum(list_transform(e, x -> x * x))) AS size FROM v
        ), l AS (
            SELECT a.vec_id AS u, b.vec_id AS v
            FROM n AS a JOIN n AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95
        ), r AS (
            SELECT vec_id AS node, vec_id AS root FROM embeddings
            UNION
            SELECT l.v, r.root FROM r JOIN l ON r.node = l.u
        ), c AS (
            SELECT node, min(root) AS component_id FROM r GROUP BY node
        ), k AS (
            SELECT u, count(*) AS n_links FROM l GROUP BY u
        )
        SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings AS e LEFT JOIN k ON e.vec_id = k.u JOIN c ON e.vec_id = c.node
    """,
}
