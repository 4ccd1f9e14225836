"""The text operators' queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ._shared import table
from .centroids import cluster_report
from .decontamination import contaminated_spans, contamination
from .jaccard import jaccard_components
from .language_model import language_model_scores
from .licenses import license_scan
from .media import media_digests
from .piece_codec import piece_digests
from .quality import fit_quality, quality_scores
from .sharding import assign_shards, table_size, table_sql
from .spelling import spelling_groups
from .token_counts import token_counts
from .token_files import token_digests
from .url_filters import judge_urls

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL, END = public_tokenizers.path("word_bpe_49k.json"), 2
SHARDS = 32


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the piece model, and whether they are more than 4096."""
    return token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under a hierarchical Pitman-Yor model of the training documents."""
    return language_model_scores(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an ISO media file, read back and described."""
    return media_digests(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return license_scan(table(spark, sf_dir, "documents")).drop("places")


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces, and whether they decode to the document."""
    return piece_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return contamination(contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the more frequent form one edit away, and the form that forms lead to."""
    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from Simple-8b files in order of documents."""
    return token_digests(table(spark, sf_dir, "documents"), WORD_MODEL, END)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every embedding after three rounds of sixteen centroids."""
    return cluster_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_url_filters, op3_sharding, op4_ngram_jaccard_join, op5_lm_scoring, op6_media_columns,
        op7_license_scans, op8_sentencepiece_codec, op9_quality_classifier, op10_benchmark_decontamination,
        op11_spelling_variants, op12_token_files, op13_centroid_clusters,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_SPACED = _WORDS.replace(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x20\x09-\x0D]+")



def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Assignments in turn with centroids by exact floors of means."""
    ctes = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), v LIMIT {k})",
    ]
    near = """SELECT vec_id, v, min([d, cluster]) AS m FROM (SELECT vec_id, v, row, cluster, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d
        FROM (SELECT *, row_number() OVER () AS row FROM kept), c{i}) GROUP BY vec_id, v, row"""
    for i in range(rounds):
        ctes.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        ctes.append(
            f"""m{i} AS (SELECT m[2] AS cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
            c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(new.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM m{i} GROUP BY 1) new USING (cluster))"""
        )
    ctes.append(f"a{rounds} AS MATERIALIZED ({near.format(i=rounds)})")
    return f"""WITH {', '.join(ctes)}
        SELECT vec_id, m[2]::INTEGER AS cluster, m[1]::BIGINT AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia, (sum(m[1]) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON cluster = m[2]"""


ORACLE_SQL: dict[str, str] = {
    "op13_centroid_clusters": _clusters_sql(),
    "op4_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS grams
            FROM d
        ),
        listed AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM listed a JOIN listed b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
        ),
        reached AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT y, root FROM reached JOIN links ON x = doc_id)
        SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY 1) USING (doc_id)
    """,
    "op3_sharding": f"""
        SELECT doc_id, t.slot, t.shard
        FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {table_size(SHARDS)} AS slot FROM documents) d
        JOIN ({table_sql(SHARDS)}) t ON t.slot = d.slot
    """,
    "op10_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        items AS (
            SELECT item_id, least(len(w), 13) AS n, unnest(range(greatest(len(w) - 12, least(len(w), 1)))) AS p, w FROM b
        ),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1 : p + n], ' ') AS s FROM items),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS s
            FROM (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)
        ),
        found AS (SELECT doc_id, item_id, n, p FROM places JOIN windows USING (n, s)),
        hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS word FROM found) GROUP BY doc_id),
        ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
    """,
}
