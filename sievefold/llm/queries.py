"""The operators' queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bagminhash import near_duplicates
from .bpe import bpe, vocabulary
from .common import documents
from .exact import exact_duplicates
from .licenses import license_scan
from .pii import pii_spans
from .prefixfree import remove_repeats
from .secrets import secret_spans
from .summa import hard_negatives
from .tiling import contamination
from .tokenfiles import token_files
from .toxicity import toxicity
from .voronoi import top_k
from .whitening import whitened


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), vocabulary(tokenizer_path()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(documents(spark, sf_dir))


def op5_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op7_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(documents(spark, sf_dir), tokenizer_path())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings(spark, sf_dir), anchors=F.col("vec_id") % 100 == 0, label=label)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(embeddings(spark, sf_dir), queries=F.col("vec_id") % 50 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(embeddings(spark, sf_dir))


_ALL = (
    op1_license_scan,
    op2_token_files,
    op3_toxicity,
    op4_pii,
    op5_exact_duplicates,
    op6_near_duplicates,
    op7_remove_repeats,
    op8_decontamination,
    op9_secrets,
    op10_bpe,
    op11_hard_negatives,
    op12_top_k,
    op13_whitening,
)
QUERIES = {f.__name__: f for f in _ALL}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Rows that take part, their components as whole numbers.
_WHOLE = "list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::DOUBLE) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
#: The methods' own labels, scores and spans, token ids, tilings and removed bytes are beyond SQL: the tests
#: hold those queries against plain Python.
ORACLE: dict[str, str] = {
    "op5_exact_duplicates": f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOW} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    # all pairs that share a shingle, by exact weighted overlap, and their transitive closure
    "op6_near_duplicates": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE m / (x.n + y.n - m) >= 0.8), either AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, either.b FROM r JOIN either ON r.y = either.a), k AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM k""",
    "op11_hard_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AND label IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5""",
    "op12_top_k": f"""WITH v AS (SELECT vec_id, {_WHOLE}),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}
