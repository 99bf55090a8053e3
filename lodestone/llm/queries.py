"""The corpus operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, fingerprints, licenses, mixing, multi_index, near_dedup, permutation_index, pieces, quality, secrets, sharding, toxicity, vector_file
from .common import held_out, table


def op1_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op5_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "expected")


def op8_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op9_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["rank"] < len(secrets.BASE))

    def count(n: int):
        return F.size(F.filter("secret_spans", lambda s: s["rank"] == n)).cast("long")

    return found.select(
        "doc_id", *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(secrets.BASE)],
        F.sha2(secrets.span_digest(base), 256).alias("base_sha256"), secrets.span_digest(F.col("secret_spans")).alias("spans"),
    )


def _secrets_sql() -> str:
    parts = []
    for n, r in enumerate(secrets.RULES):
        rx = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT k, {n} AS rank, '{r.kind}' AS kind, m, list_transform(string_split_regex(t, '{rx}'), lambda x: length(x)) AS gaps, "
            f"regexp_extract_all(t, '{rx}', {r.group}) AS parts, {r.least} AS least "
            f"FROM (SELECT k, t, regexp_extract_all(t, '{rx}', 0) AS m FROM d) WHERE len(m) > 0"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT k, rank, kind, unnest(range(1, len(m) + 1)) AS i, m, gaps, parts, least FROM found),
spans AS (SELECT k, rank, kind,
  CAST(list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS w
  FROM each WHERE length(parts[i]) >= least),
texts AS (SELECT k, rank, s, concat(kind, ':', s, ':', s + w) AS x FROM spans),
per AS (SELECT k, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(x, ',' ORDER BY s, rank) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg(x, ',' ORDER BY s, rank) AS every FROM texts GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN per USING (k)
"""


def op2_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.add_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), to="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op4_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.add_scores(docs, quality.train(docs, table(spark, sf_dir, "labels")), to="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def _template_rx(markup: str) -> str:
    """A template as a regular expression over words that each end in a space."""
    out = []
    for token in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if token.startswith("<<any"):
            out.append(r"(?:[^ ]+ ){0,%s}" % token[6:-2])
        else:
            out.append({"<<optional>>": "(?:", "<</optional>>": ")?"}.get(token, token + " "))
    return " " + "".join(out)


def _licenses_sql() -> str:
    places = " UNION ALL ".join(
        f"SELECT k, i - 1 AS pos, '{label}' AS label FROM each WHERE w[i:i + {len(p.split()) - 1}] = [{', '.join(repr(x) for x in p.split())}]" for p, label in licenses.PHRASES.items()
    )
    accepted = " UNION ALL ".join(f"SELECT k, '{label}' AS label FROM d WHERE regexp_matches(joined, '{_template_rx(t)}')" for label, t in licenses.TEMPLATES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM t),
each AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d),
places AS ({places}),
base AS (SELECT k, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY k),
accepted AS (SELECT DISTINCT * FROM ({accepted})),
lab AS (SELECT k, label, max(sure) AS sure FROM (SELECT k, label, 1 AS sure FROM accepted UNION ALL SELECT k, label, 0 FROM places) GROUP BY k, label),
every AS (SELECT k, string_agg(label, ',' ORDER BY label) AS labels, avg(CASE WHEN sure = 1 THEN 1.0 ELSE 0.5 END) AS score FROM lab GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(base.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM d LEFT JOIN base USING (k) LEFT JOIN every USING (k)
"""


def op7_maxplus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.read_vocabulary()
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    back = pieces.decode(encoded, vocabulary)
    return back.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op10_multi_index_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op11_vector_file_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return vector_file.hard_negatives(moved, lambda i: i % 100 == 0)


_NEGATIVES_SQL = """
WITH fine AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""


def op12_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprints.written(F.col("anchors")).alias("fingerprint"), fingerprints.written(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op13_bitmap_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM t),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(words) < 200 AS "A", 100 * len(list_distinct(words)) < 50 * len(words) AS "B",
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS "C", regexp_matches(t, '[#$%&*|]') AS "D", coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS "E"
  FROM w LEFT JOIN marks USING (doc_id)),
n AS (SELECT part, MAP {'A': "A", 'B': "B", 'C': "C", 'D': "D", 'E': "E"} AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
g AS (SELECT part, o, step, o[step] AS x, n, good, toxic, fails[o[step]] AS fails_it, len(list_filter(o[1:step - 1], lambda y: fails[y])) > 0 AS gone, len(list_filter(o, lambda y: fails[y])) AS many FROM n, s),
r AS (SELECT part, array_to_string(o, '') AS filter_order, step, x, sum(n) FILTER (NOT gone AND NOT fails_it) AS kept, sum(n) FILTER (NOT gone AND fails_it) AS removed, sum(n) FILTER (gone AND fails_it) AS redundant,
  sum(n) FILTER (fails_it AND many = 1) AS unique_fails, sum(good) FILTER (NOT gone AND fails_it) AS good_lost, sum(toxic) FILTER (NOT gone AND fails_it) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_histogram_sharding": op1_histogram_sharding,
    "op2_nb_ngram_toxicity": op2_nb_ngram_toxicity,
    "op3_permutation_search": op3_permutation_search,
    "op4_rule_ensemble_quality": op4_rule_ensemble_quality,
    "op5_pareto_mixing": op5_pareto_mixing,
    "op6_template_licenses": op6_template_licenses,
    "op7_maxplus_pieces": op7_maxplus_pieces,
    "op8_bagminhash_dedup": op8_bagminhash_dedup,
    "op9_trigram_secrets": op9_trigram_secrets,
    "op10_multi_index_duplicates": op10_multi_index_duplicates,
    "op11_vector_file_negatives": op11_vector_file_negatives,
    "op12_closed_syncmers": op12_closed_syncmers,
    "op13_bitmap_filter_audit": op13_bitmap_filter_audit,
}
ORACLES: dict[str, str] = {
    "op6_template_licenses": _licenses_sql(),
    "op9_trigram_secrets": _secrets_sql(),
    "op11_vector_file_negatives": _NEGATIVES_SQL,
    "op13_bitmap_filter_audit": _AUDIT_SQL,
}
