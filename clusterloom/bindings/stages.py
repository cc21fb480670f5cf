"""Composed stages over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.bindings import evaluation as be
from clusterloom.bindings import ordering as bo
from clusterloom.bindings import policy as bp
from clusterloom.bindings import query
from clusterloom.operators import merge as mg
from clusterloom.operators import policy as pl
from clusterloom.plans import evaluation as pe

MERGE_THEN_VOTE = f"""{bo.LEADERS},
grp AS (SELECT user_id, coalesce(lead, pos) AS pos, arg_min(score, pos) AS score FROM led GROUP BY user_id, coalesce(lead, pos)),
members AS (
  SELECT user_id, coalesce(lead, pos) AS pos, gene, min({{'p': pos, 'i': i}}) AS ord
  FROM (SELECT user_id, pos, lead, unnest(genes) AS gene, unnest(range(0, 3)) AS i FROM led) GROUP BY ALL),
seated AS (SELECT m.*, row_number() OVER (PARTITION BY user_id, pos ORDER BY ord) - 1 AS i FROM members m),
votes AS (
  SELECT user_id, gene, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share, min({{'p': pos, 'i': i}}) AS first
  FROM seated JOIN grp USING (user_id, pos) GROUP BY user_id, gene),
lengths AS (SELECT 'g' || user_id || '_' || pos AS gene, floor(value * 10)::BIGINT AS length FROM ranked),
placed AS (
  SELECT user_id, gene, share >= 0.5 AS positive, coalesce(length, 0) AS length,
         row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS gpos FROM votes LEFT JOIN lengths USING (gene)),
groups AS (
  SELECT user_id, gpos, positive, gpos AS grp, length AS run FROM placed WHERE gpos = 0
  UNION ALL
  SELECT p.user_id, p.gpos, p.positive,
         CASE WHEN p.positive = w.positive AND (p.positive OR w.run < 1500) THEN w.grp ELSE p.gpos END,
         CASE WHEN p.positive = w.positive AND (p.positive OR w.run < 1500) THEN w.run + p.length ELSE p.length END
  FROM groups w JOIN placed p ON p.user_id = w.user_id AND p.gpos = w.gpos + 1)"""


@query("merge_stage", f"""
WITH RECURSIVE {MERGE_THEN_VOTE}
SELECT user_id, grp AS pos, string_agg(gene, '|' ORDER BY gpos) AS genes,
       max(CASE WHEN positive THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM groups JOIN placed USING (user_id, gpos, positive) GROUP BY user_id, grp""")
def merge_stage(spark, sf):
    out = pe.merge_stage(bo.predictions(spark, sf), bo.USER, successive=2, majority=True,
                         lengths=bo.gene_lengths(spark, sf), max_length=1500)
    return out.withColumn("genes", F.array_join("genes", "|"))


def supplier_clusters(spark, sf):
    """Genes of a supplier as one positive cluster each, in line order."""
    rows = bo.supplier_genes(spark, sf)
    return rows.groupBy("l_suppkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "gene"))), lambda e: e["gene"]).alias("genes")
    ).select("l_suppkey", F.lit(0).cast("long").alias("pos"), "genes",
             F.when(F.col("l_suppkey") % 4 == 0, 0.25).otherwise(0.75).alias("score"))


FRAGMENTS = f"""{bo.RUNS},
marked AS (SELECT l_suppkey, idx, gene, NOT flag AS kept, idx = 0 OR (in_split AND istart = idx) AS edge FROM runs),
cuts AS (
  SELECT l_suppkey, idx, gene, kept, idx AS fragment, kept::INT AS size FROM marked WHERE idx = 0
  UNION ALL
  SELECT m.l_suppkey, m.idx, m.gene, m.kept, CASE WHEN m.edge AND w.size >= 5 THEN m.idx ELSE w.fragment END,
         CASE WHEN m.edge AND w.size >= 5 THEN 0 ELSE w.size END + m.kept::INT
  FROM cuts w JOIN marked m ON m.l_suppkey = w.l_suppkey AND m.idx = w.idx + 1),
kept AS (SELECT l_suppkey, fragment, idx, gene FROM (
  SELECT *, max(size) OVER (PARTITION BY l_suppkey, fragment) AS final FROM cuts)
  WHERE kept AND final >= 5 AND l_suppkey % 4 <> 0)"""


@query("rule_filter_stage", f"""
WITH RECURSIVE {FRAGMENTS}
SELECT l_suppkey, fragment, count(*) AS n, md5(string_agg(gene, '|' ORDER BY idx)) AS digest, 0.75::DOUBLE AS score
FROM kept GROUP BY l_suppkey, fragment
UNION ALL
SELECT l_suppkey, 0, count(*), md5(string_agg(gene, '|' ORDER BY idx)), 0.25 FROM genes WHERE l_suppkey % 4 = 0 GROUP BY l_suppkey""")
def rule_filter_stage(spark, sf):
    flagged = mg.flagged_genes(bo.gene_domains(spark, sf), bo.rule_list(spark, sf))
    out = pe.filter_stage(supplier_clusters(spark, sf), bo.SUPP, flagged=flagged)
    return _digested(out)


def _digested(out):
    return out.select("l_suppkey", "fragment", F.size("genes").cast("long").alias("n"),
                      F.md5(F.array_join("genes", "|").cast("binary")).alias("digest"), "score")


@query("policy_filter_stage", f"""
WITH RECURSIVE {FRAGMENTS}, {bp.POLICY},
dec AS (SELECT k.l_suppkey, k.fragment, k.gene,
               CASE WHEN gp.gene IS NULL THEN 'undecided' WHEN round(keep_reward, 9) >= round(skip_reward, 9) THEN 'keep' ELSE 'skip' END AS act
        FROM kept k LEFT JOIN gp ON gp.gene = k.gene),
fin AS (SELECT *, CASE WHEN act <> 'undecided' THEN act
         WHEN avg(CASE WHEN act = 'keep' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY l_suppkey, fragment) > 0.5 THEN 'keep' ELSE 'skip' END AS f FROM dec)
SELECT l_suppkey, fragment, count(DISTINCT gene) AS n, md5(string_agg(DISTINCT gene, '|' ORDER BY gene)) AS digest,
       CASE WHEN f = 'keep' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM fin GROUP BY l_suppkey, fragment, f
UNION ALL
SELECT l_suppkey, 0, count(*), md5(string_agg(gene, '|' ORDER BY idx)), 0.0 FROM genes WHERE l_suppkey % 4 = 0 GROUP BY l_suppkey""")
def policy_filter_stage(spark, sf):
    flagged = mg.flagged_genes(bo.gene_domains(spark, sf), bo.rule_list(spark, sf))
    policy = pl.gene_policy(bp.gene_domains(spark, sf), bp.learned_values(spark, sf))
    out = pe.filter_stage(supplier_clusters(spark, sf), bo.SUPP, flagged=flagged, policy=policy, average_action=True)
    return _digested(out)


@query("evaluation_metrics", f"""
WITH RECURSIVE {be.MERGED}, gold AS (SELECT 'S' || l_suppkey AS cluster_id, {be.PG} AS gene FROM lineitem WHERE l_returnflag = 'R'),
allpost AS (SELECT f.o_custkey * 1000 + f.g AS pos, f.genes, c.score FROM folded f
            JOIN cl c ON c.o_custkey = f.o_custkey AND c.cpos = f.g),
pg AS (SELECT pos, score, unnest(genes) AS gene FROM allpost),
hit AS (SELECT DISTINCT gene FROM pg WHERE score >= 0.5),
matched AS (SELECT cluster_id, gene, gene IN (SELECT gene FROM hit) AS label FROM (SELECT DISTINCT cluster_id, gene FROM gold)),
rows AS (
  SELECT 'genes' AS level, (SELECT count(*) FROM matched WHERE label)::DOUBLE AS matches, (SELECT count(*) FROM hit) AS predicted,
         (SELECT count(*) FROM gold) AS gold
  UNION ALL
  SELECT 'clusters', (SELECT count(DISTINCT cluster_id) FROM matched WHERE label), (SELECT count(*) FROM allpost WHERE score >= 0.5),
         (SELECT count(DISTINCT cluster_id) FROM gold)),
m AS (SELECT *, least(1.0, matches / predicted) AS p, least(1.0, matches / gold) AS r, matches > 0 AS ok FROM rows)
SELECT level, matches, predicted, gold, {be.PRF} FROM m""")
def evaluation_metrics(spark, sf):
    base = be.clusters(spark, sf, lambda e: be.plain_gene(e["l_partkey"])).select("o_custkey", "pos", "genes", "score")
    post = be.globally(pe.merge_stage(base, be.CUST, successive=2))
    gold = be.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("S"), be.txt("l_suppkey")).alias("cluster_id"), be.plain_gene("l_partkey").alias("gene"))
    return pe.evaluate(gold, be.globally(base), post, successive=2)["metrics"]
