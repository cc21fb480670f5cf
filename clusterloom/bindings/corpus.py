"""Corpus construction queries; hashes differ between engines, so invariants are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.bindings import query, table
from clusterloom.bindings.features import SEQS, WORDS, counted_vocabulary, sequences, word_counts
from clusterloom.operators import corpus as cp

# 40 percent positives: 1.5 negatives each, every second input gets two.
PLAN = """plan AS (
  SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) % 2 = 0 THEN 2 ELSE 1 END AS replicas FROM documents)"""


@query("replica_counts", f"WITH {PLAN} SELECT doc_id, replicas FROM plan")
def replica_counts(spark, sf):
    return cp.replica_counts(table(spark, sf, "documents"), "doc_id", 40)


@query("shuffled_negatives", f"""
WITH {SEQS}, {PLAN}, cut AS (
  SELECT doc_id, replicas, CASE WHEN length(seq) % 2 = 1 THEN substr(seq, 1, length(seq) - 1) ELSE seq END AS s
  FROM seqs JOIN plan USING (doc_id)),
blocks AS (SELECT doc_id, string_agg(b, '' ORDER BY b) AS bag FROM (
  SELECT doc_id, substr(s, i * 2 + 1, 2) AS b FROM (SELECT doc_id, s, unnest(range(0, length(s) // 2)) AS i FROM cut))
  GROUP BY doc_id)
SELECT doc_id, replica, length(s) AS n, md5(coalesce(bag, '')) AS digest
FROM (SELECT doc_id, s, unnest(range(0, replicas))::INT AS replica FROM cut) LEFT JOIN blocks USING (doc_id)""")
def shuffled_negatives(spark, sf):
    out = cp.shuffled_negatives(sequences(spark, sf), "doc_id", "seq", 40)
    pairs = F.sort_array(F.regexp_extract_all("seq", F.lit("(..)"), F.lit(1)))
    return out.select("doc_id", "replica", F.length("seq").alias("n"),
                      F.md5(F.array_join(pairs, "").cast("binary")).alias("digest"))


# The scarcer quality class of the labelled documents is the positive one.
@query("train_validation_manifest", """
WITH c AS (SELECT count(*) FILTER (quality = 0) AS pos, count(*) FILTER (quality = 1) AS neg FROM labels),
w AS (SELECT pos, neg, pos * 50 / 50.0 AS wanted, floor(0.2 * pos * 50 / 50.0)::BIGINT AS nv, floor(0.2 * pos)::BIGINT AS pv FROM c)
SELECT 1 AS label, pos AS available, pos - pv AS train, pv AS validation FROM w
UNION ALL SELECT 0, neg, floor(wanted - nv)::BIGINT, nv FROM w""")
def train_validation_manifest(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    split = cp.split_train_validation(lab, "doc_id", "label", 50, 20)
    return cp.split_manifest(lab, split, "label")


@query("stratified_fold_sizes", """
WITH r AS (SELECT quality AS label, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS fold FROM labels)
SELECT label, fold::INT AS fold, count(*) AS n FROM r GROUP BY ALL""")
def stratified_fold_sizes(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return cp.stratified_folds(lab, "doc_id", "label").groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("fold_feature_filter", f"""
WITH {WORDS},
vocab AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx
          FROM (SELECT feature FROM words GROUP BY feature HAVING count(*) >= 2)),
occ AS (SELECT instance_id, idx, count(*) AS cnt FROM words JOIN vocab USING (feature) GROUP BY ALL),
folds(fold) AS (VALUES (0), (1), (2), (3), (4))
SELECT fold, idx, sum(cnt)::BIGINT AS total FROM occ JOIN folds ON fold <> instance_id % 5 GROUP BY fold, idx""")
def fold_feature_filter(spark, sf):
    counts = word_counts(spark, sf)
    occ = counts.join(counted_vocabulary(counts), ["feature_type", "feature"]).select("instance_id", "idx", "cnt")
    folds = table(spark, sf, "documents").select(
        F.col("doc_id").alias("instance_id"), (F.col("doc_id") % 5).cast("int").alias("fold"))
    return cp.positive_features_per_fold(occ, folds)
