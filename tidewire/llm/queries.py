"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, exact_dedup, fim, fingerprints, licenses, line_dedup, mixing, near_dedup, pieces, pii, sharding, spelling, toxicity
from tidewire.llm.text import documents

STAND_IN = "stand-in"  # where a corpus has its secret key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.score(documents(spark, folder), labels).select("row.doc_id", "held_out", "score", "predicted")


@query(
    "op2_exact_dedup",
    """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
    k AS (SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k""",
)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, folder))


@query(
    "op3_mixing",
    r"""WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) || '-' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS place FROM documents),
    src AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
    walk AS (SELECT *, coalesce(sum(3 * source_size) OVER up, 0) AS caps, sum(weight) OVER rest AS weights,
        (SELECT sum(source_size) FROM src) AS total
      FROM src WINDOW up AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        rest AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    level AS (SELECT max(CAST(total - caps AS DOUBLE) / CAST(weights AS DOUBLE)) FILTER ((total - caps) * weight <= 3 * source_size * weights) AS level FROM walk),
    goals AS (SELECT source, source_size, least(weight * level, CAST(3 * source_size AS DOUBLE)) AS target FROM src, level),
    drawn AS (SELECT doc_id, size, source_size, target, floor(target / source_size) AS whole,
        sum(size) OVER (PARTITION BY s.source ORDER BY place) - size AS before
      FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target,
      CAST(size * (whole + CASE WHEN before < target - whole * source_size AND 2 * ((target - whole * source_size) - before) >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM drawn""",
)
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.copies(documents(spark, folder)).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query("op4_bpe")
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(documents(spark, folder))


def bpe_digests(docs: DataFrame, path: str | None = None, *, keep_ids: bool = False) -> DataFrame:
    """Encode and decode whole texts with a rank file: n_tokens and digests of the ids and of the decoded bytes."""
    ranks = bpe.read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, packed=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
        *(["ids"] if keep_ids else []),
    )


@query("op5_pii")
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, folder), key=STAND_IN).select("row.doc_id", "text", "n_values", "n_replaced")


@query("op6_sharding")
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(documents(spark, folder))


@query("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder))


def _license_sql() -> str:
    rows = ", ".join(f"({n}, {i}, '{a}', '{b}', '{label}', {exact}, {grams})" for n, i, a, b, label, exact, grams in licenses.template_rows())
    return f"""WITH t(template, t_place, t_one, t_two, t_label, exact, grams) AS (VALUES {rows}),
    w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{licenses.TERM}') AS words FROM documents),
    g AS (SELECT rid, i - 1 AS place, words[i] AS one, words[i + 1] AS two FROM (SELECT rid, words, unnest(range(1, len(words))) AS i FROM w)),
    h AS (SELECT rid, template, t_label, exact, grams, place - t_place AS diagonal, count(DISTINCT t_place) AS n, list(DISTINCT t_place) AS held
      FROM g JOIN t ON one = t_one AND two = t_two GROUP BY ALL),
    s AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {licenses.NEAR} THEN 1 ELSE 0 END AS starts FROM h),
    p AS (SELECT *, sum(starts) OVER (PARTITION BY rid, template ORDER BY diagonal) AS spot FROM s),
    m AS (SELECT rid, t_label, exact, grams, len(list_distinct(flatten(list(held)))) AS covered, count(*) FILTER (exact AND n = grams) AS whole,
        min(diagonal) FILTER (exact AND n = grams) AS first, max(diagonal) FILTER (exact AND n = grams) AS last, max(diagonal) - min(diagonal) AS stretch
      FROM p GROUP BY rid, template, t_label, exact, grams, spot),
    d AS (SELECT rid, sum(whole) AS n_base, min(first) AS first_word, max(last) AS last_word, max(CAST(covered AS DOUBLE) / grams) AS score,
        string_agg(DISTINCT t_label, ',' ORDER BY t_label) FILTER (whole > 0) AS base_labels,
        string_agg(DISTINCT t_label, ',' ORDER BY t_label) FILTER (whole > 0 OR (NOT exact AND CAST(covered AS DOUBLE) / grams >= {licenses.COVER} AND stretch <= grams)) AS labels
      FROM m GROUP BY rid)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
      CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM w LEFT JOIN d USING (rid)"""


@query("op8_licenses", _license_sql())
def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_pairs(documents(spark, folder))


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = line_dedup.without_repeats(documents(spark, folder), min_words=0)
    return left.select("row.doc_id", "n_lines", "n_deleted", "text", "n_runs", "longest_run", "runs")


@query("op11_pieces")
def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(documents(spark, folder))


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode whole texts with an end id and decode them: n_tokens and digests of the ids and of the decoded text."""
    vocabulary = pieces.read_pieces(path or public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(docs, vocabulary, end=True, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query(
    "op12_fim",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    d AS (SELECT *, CAST(length(body) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, substring(body, 1, a) AS prefix, substring(body, a + 1, b - a) AS middle, substring(body, b + 1) AS suffix FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(body) AS restored_sha256 FROM p""",
)
def op12_fim(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.fill_in_middle(documents(spark, folder))
    return made.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op13_spelling")
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_forms(documents(spark, folder))
