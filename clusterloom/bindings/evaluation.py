"""Join, match and evaluation queries: orders are scored gene clusters, suppliers gold clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.bindings import query, table
from clusterloom.bindings.features import FAN, PIECE, SEQS, digests_sql, sequences
from clusterloom.operators import evaluate as ev
from clusterloom.operators import match as mt
from clusterloom.operators import merge as mg
from clusterloom.operators import pieces as pc
from clusterloom.operators import similarity as sim
from clusterloom.operators.ordered import index_rows, scan
from clusterloom.session import cut_lineage, hold

# Inputs --------------------------------------------------------------------------------

CUST = ["o_custkey"]
txt = lambda c: F.col(c).cast("string")
plain_gene = lambda c: F.format_string("P_%05d", F.col(c) if isinstance(c, str) else c)


def line_gene(line=None):
    of = F.col if line is None else lambda c: line[c]
    return F.concat(plain_gene(of("l_partkey")), F.lit("x"), of("l_suppkey").cast("string"))


def folded_orders(spark, sf):
    """Orders with their lines' keys in order; genes are named after the rows have moved."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("e"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    folded = li.groupBy("l_orderkey").agg(
        F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e["l_partkey"].alias("l_partkey"), e["l_suppkey"].alias("l_suppkey"))).alias("lines"))
    return folded.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "lines", "o_totalprice")


def _named(rows, gene):
    return rows.select(
        *[c for c in ("o_custkey", "l_orderkey") if c in rows.columns], F.transform("lines", gene).alias("genes"),
        (F.col("o_totalprice") / 500000).alias("score"), "pos")


def clusters(spark, sf, gene):
    """Orders as clusters of genes, ordered per customer; ``pos`` is dense per customer."""
    return _named(index_rows(folded_orders(spark, sf), CUST, ["l_orderkey"]), gene)


def globally(df):
    """One global position per prediction: customer first, then position."""
    rows = df.select("o_custkey", F.col("pos").alias("_pos"), "genes", "score")
    return index_rows(rows, [], ["o_custkey", "_pos"]).select("pos", "genes", "score")


def predictions(spark, sf):
    """One global position per prediction, by customer and order at once."""
    rows = index_rows(folded_orders(spark, sf), [], ["o_custkey", "l_orderkey"])
    return _named(rows, line_gene).select("pos", "genes", "score")


def gold(spark, sf):
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("S"), txt("l_suppkey")).alias("cluster_id"), line_gene().alias("gene"))


def gold_with_absent(spark, sf):
    """Gold clusters whose genes partly never appear in a prediction."""
    brands = table(spark, sf, "part").select(
        F.col("p_brand").alias("cluster_id"),
        F.concat(plain_gene("p_partkey"), F.lit("x"), txt("p_size")).alias("gene"))
    return gold(spark, sf).unionByName(brands)


LG = "printf('P_%05d', l_partkey) || 'x' || l_suppkey"
PG = "printf('P_%05d', l_partkey)"


def preds_sql(gene: str) -> str:
    return f"""cl AS (
  SELECT o_custkey, l_orderkey, score, genes,
         row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) - 1 AS cpos,
         count(*) OVER (PARTITION BY o_custkey) AS cn
  FROM (SELECT l_orderkey, list({gene} ORDER BY l_linenumber, l_partkey, l_suppkey) AS genes
        FROM lineitem GROUP BY l_orderkey)
  JOIN (SELECT o_orderkey, o_custkey, o_totalprice / 500000 AS score FROM orders) ON o_orderkey = l_orderkey),
preds AS (SELECT row_number() OVER (ORDER BY o_custkey, cpos) - 1 AS pos, genes, score FROM cl)"""


GOLD = f"""gold AS (SELECT 'S' || l_suppkey AS cluster_id, {LG} AS gene FROM lineitem WHERE l_returnflag = 'R')"""
GOLD_ABSENT = f"""gold AS (
  SELECT 'S' || l_suppkey AS cluster_id, {LG} AS gene FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL
  SELECT p_brand, printf('P_%05d', p_partkey) || 'x' || p_size FROM part)"""
MATCHED = """pg AS (
  SELECT pos, score, 'Cluster' || genes[1] || '_' || genes[-1] AS name, unnest(genes) AS gene FROM preds),
per_gene AS (SELECT gene, min(pos) AS first_pos, arg_min(name, pos) AS name,
                    max(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS hit FROM pg GROUP BY gene),
matched AS (
  SELECT cluster_id, gene, coalesce(hit, 0) AS label, coalesce(name, 'not found') AS predicted_cluster, first_pos
  FROM (SELECT DISTINCT cluster_id, gene FROM gold) LEFT JOIN per_gene USING (gene))"""
BASE = f"{preds_sql(LG)}, {GOLD_ABSENT}, {MATCHED}"
REPRESENTED = """counts AS (
  SELECT cluster_id, predicted_cluster, count(*) AS n, min(first_pos) AS mpos FROM matched WHERE label = 1 GROUP BY ALL),
best AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, predicted_cluster) = 1),
lasts AS (SELECT cluster_id, arg_max(predicted_cluster, gene) AS name,
                 max_by(coalesce(first_pos, -1), gene) AS lpos FROM matched GROUP BY cluster_id),
represented AS (
  SELECT l.cluster_id, coalesce(b.predicted_cluster, l.name) AS predicted_cluster,
         CASE WHEN b.cluster_id IS NULL THEN nullif(l.lpos, -1) ELSE b.mpos END AS match_pos
  FROM lasts l LEFT JOIN best b USING (cluster_id))"""
RUNS = """hits AS (SELECT cluster_id, gene, first_pos, row_number() OVER w AS rn,
                CASE WHEN first_pos IS DISTINCT FROM lag(first_pos) OVER w THEN 1 ELSE 0 END AS c
         FROM matched WHERE label = 1 WINDOW w AS (PARTITION BY cluster_id ORDER BY gene)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY cluster_id ORDER BY rn) AS island FROM hits),
runs AS (SELECT cluster_id, max(n) AS run FROM (SELECT cluster_id, island, count(*) AS n FROM isl GROUP BY ALL)
         GROUP BY cluster_id),
sized AS (SELECT cluster_id, count(*) AS n_genes FROM matched GROUP BY cluster_id),
scores AS (SELECT cluster_id, coalesce(run, 0) AS run, n_genes FROM sized LEFT JOIN runs USING (cluster_id))"""


def similar_pairs(spark, sf, wanted=None, block=()):
    """Genes of one part on lines of one number are similar, by their quantities; with ``wanted``
    only pairs whose ``b`` is among its rows, with ``block`` its columns too, which are those of the part.

    Lines are shuffled once, by part; their pairs, many more, are reduced where they are made and
    named at the end. Equal line numbers are a filter, since a key would shuffle by both.
    """
    li = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("q"))
    if wanted is None:
        li = li.repartition("l_partkey")
    left = li.withColumnsRenamed({"l_linenumber": "_n", "l_suppkey": "a", "q": "_q"})
    right = li.withColumnsRenamed({"l_suppkey": "b"})
    if wanted is not None:
        right = hold(li.withColumn("b", line_gene()).join(wanted, "b", "left_semi").select(
            "l_partkey", "l_linenumber", F.col("l_suppkey").alias("b"), "q"))
    pairs = left.join(right, "l_partkey").filter(F.col("_n") - F.col("l_linenumber") == 0)
    best = mt.max_similarity(pairs.select("l_partkey", "a", "b", (F.col("_q") + F.col("q")).alias("pident")), ["l_partkey"])
    named = lambda c: F.concat(plain_gene("l_partkey"), F.lit("x"), txt(c)).alias(c)
    return best.select(*block, named("a"), named("b"), "pident")


PAIRS = f"""near AS (SELECT l_partkey, l_linenumber, {LG} AS gene, l_quantity AS q FROM lineitem),
pairs AS (SELECT x.gene AS a, y.gene AS b, max(x.q + y.q) AS pident FROM near x JOIN near y USING (l_partkey, l_linenumber) GROUP BY ALL)"""

CREDIT = """found AS (SELECT DISTINCT gene FROM matched WHERE label = 1),
missing AS (SELECT cluster_id, gene FROM matched WHERE gene NOT IN (SELECT gene FROM found)),
partners AS (
  SELECT * FROM (
    SELECT cluster_id, unnest(genes) AS b, unnest(range(len(genes))) AS i
    FROM represented JOIN preds ON pos = match_pos AND score >= 0.5)
  WHERE b NOT IN (SELECT gene FROM found)),
scored AS (SELECT m.cluster_id, m.gene, p.b, p.i, s.pident
           FROM missing m JOIN pairs s ON s.a = m.gene JOIN partners p ON p.cluster_id = m.cluster_id AND p.b = s.b
           WHERE s.pident > 0),
top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY cluster_id, gene ORDER BY pident DESC, i, b DESC) = 1),
credit AS (SELECT cluster_id, sum(pident) / 100 AS credit FROM (
  SELECT cluster_id, b, max(pident) AS pident FROM top GROUP BY ALL) GROUP BY cluster_id)"""


def _matched(spark, sf):
    preds = predictions(spark, sf)  # its lineage ends at the numbered rows
    return preds, hold(ev.match_gold(gold_with_absent(spark, sf), preds))


# Folding and matching ------------------------------------------------------------------


@query("folded_gold", f"""
WITH {GOLD}
SELECT cluster_id, count(DISTINCT gene) AS n, md5(string_agg(DISTINCT gene, '|' ORDER BY gene)) AS digest
FROM gold GROUP BY cluster_id""")
def folded_gold(spark, sf):
    return ev.fold_clusters(gold(spark, sf)).select(
        "cluster_id", F.size("genes").cast("long").alias("n"),
        F.md5(F.array_join("genes", "|").cast("binary")).alias("digest"))


@query("positive_gene_set", f"""
WITH {preds_sql(LG)} SELECT DISTINCT unnest(genes) AS gene FROM preds WHERE score >= 0.5""")
def positive_gene_set(spark, sf):
    return ev.positive_genes(predictions(spark, sf))


@query("gold_gene_matches", f"""
WITH {BASE} SELECT cluster_id, gene, label, predicted_cluster FROM matched""")
def gold_gene_matches(spark, sf):
    return _matched(spark, sf)[1].drop("first_pos")


@query("longest_match_runs", f"""
WITH {BASE}, {RUNS}
SELECT cluster_id, run, n_genes, round(run / n_genes, 6) AS cluster_score FROM scores""")
def longest_match_runs(spark, sf):
    scores = ev.cluster_scores(_matched(spark, sf)[1])
    return scores.withColumn("cluster_score", F.round("cluster_score", 6))


@query("ranked_cluster_scores", f"""
WITH {BASE}, {RUNS}, {REPRESENTED}
SELECT s.cluster_id AS gold_cluster_id, r.predicted_cluster AS predicted_cluster_id,
       round(s.run / s.n_genes, 6) AS cluster_score, array_to_string(p.genes, '|') AS genes
FROM scores s JOIN represented r USING (cluster_id) LEFT JOIN preds p ON p.pos = r.match_pos""")
def ranked_cluster_scores(spark, sf):
    preds, matched = _matched(spark, sf)
    out = ev.ranked_scores(ev.cluster_scores(matched), ev.matched_clusters(matched), preds)
    return out.withColumn("cluster_score", F.round("cluster_score", 6)).withColumn(
        "genes", F.array_join("genes", "|"))


@query("similarity_credit", f"""
WITH {BASE}, {REPRESENTED}, {PAIRS}, {CREDIT} SELECT cluster_id, round(credit, 6) AS credit FROM credit""")
def similarity_credit(spark, sf):
    preds, matched = _matched(spark, sf)
    out = ev.similarity_credit(matched, ev.matched_clusters(matched), preds, lambda wanted: similar_pairs(spark, sf, wanted))
    return out.withColumn("credit", F.round("credit", 6))


PRF = """CASE WHEN ok THEN round(p, 3) END AS precision, CASE WHEN ok THEN round(r, 3) END AS recall,
       CASE WHEN ok THEN round(least(1.0, 2 * p * r / (p + r)), 3) END AS f_measure"""


@query("gold_metrics", f"""
WITH {BASE}, {REPRESENTED}, {PAIRS}, {CREDIT},
rows AS (
  SELECT 'genes' AS level,
         (SELECT count(*) FROM matched WHERE label = 1) + coalesce((SELECT sum(credit) FROM credit), 0.0) AS matches,
         (SELECT count(DISTINCT gene) FROM pg WHERE score >= 0.5) AS predicted, (SELECT count(*) FROM gold) AS gold
  UNION ALL
  SELECT 'clusters', (SELECT count(DISTINCT cluster_id) FROM matched WHERE label = 1),
         (SELECT count(*) FROM preds WHERE score >= 0.5), (SELECT count(DISTINCT cluster_id) FROM gold)),
m AS (SELECT *, least(1.0, matches / predicted) AS p, least(1.0, matches / gold) AS r,
             predicted > 0 AND gold > 0 AND matches > 0 AS ok FROM rows)
SELECT level, round(matches::DOUBLE, 4) AS matches, predicted, gold, {PRF} FROM m""")
def gold_metrics(spark, sf):
    preds, matched = _matched(spark, sf)
    credit = ev.similarity_credit(matched, ev.matched_clusters(matched), preds, lambda wanted: similar_pairs(spark, sf, wanted))
    out = ev.gold_metrics(gold_with_absent(spark, sf), matched, preds, credit)
    return out.withColumn("matches", F.round("matches", 4))


# Overestimation ------------------------------------------------------------------------


def region_gold(spark, sf):
    """Small blocks of neighbouring parts, plus brand-wide clusters that spread too far."""
    part = table(spark, sf, "part")
    blocks = part.filter("p_size > 25 AND p_brand LIKE 'Brand#1%'").select(
        F.concat(F.lit("K"), F.floor(F.col("p_partkey") / 20).cast("string")).alias("cluster_id"),
        plain_gene("p_partkey").alias("gene"))
    wide = part.filter("p_size <= 3").select(F.col("p_brand").alias("cluster_id"), plain_gene("p_partkey").alias("gene"))
    return blocks.unionByName(wide)


REGIONS = """rgold AS (
  SELECT 'K' || (p_partkey // 20) AS cluster_id, p_partkey AS k FROM part WHERE p_size > 25 AND p_brand LIKE 'Brand#1%'
  UNION ALL SELECT p_brand, p_partkey FROM part WHERE p_size <= 3),
spans AS (SELECT cluster_id, min(k) AS lo, max(k) AS hi FROM rgold GROUP BY cluster_id),
regions AS (
  SELECT DISTINCT printf('P_%05d', k) AS gene, cluster_id FROM (
    SELECT cluster_id, unnest(range(lo, hi + 1)) AS k FROM spans WHERE hi - lo + 1 <= 100
    UNION ALL SELECT cluster_id, k FROM rgold JOIN spans USING (cluster_id) WHERE hi - lo + 1 > 100))"""

MERGED = f"""{preds_sql(PG)}, walk AS (
  SELECT o_custkey, cpos, CASE WHEN score >= 0.5 AND cpos < cn - 2 THEN cpos END AS lead FROM cl WHERE cpos = 0
  UNION ALL
  SELECT p.o_custkey, p.cpos, CASE WHEN w.lead IS NOT NULL AND p.cpos - w.lead <= 2 THEN w.lead
         WHEN p.score >= 0.5 AND p.cpos < p.cn - 2 THEN p.cpos END
  FROM walk w JOIN cl p ON p.o_custkey = w.o_custkey AND p.cpos = w.cpos + 1),
grp AS (SELECT o_custkey, coalesce(lead, cpos) AS g, cpos, genes, score,
               count(*) OVER (PARTITION BY o_custkey, coalesce(lead, cpos)) AS members
        FROM cl JOIN walk USING (o_custkey, cpos)),
folded AS (
  SELECT o_custkey, g, list(gene ORDER BY ord) AS genes FROM (
    SELECT o_custkey, g, gene, min(ord) AS ord FROM (
      SELECT o_custkey, g, CASE WHEN members = 1 THEN i ELSE 0 END AS solo, gene, {{'c': cpos, 'i': i}} AS ord
      FROM (SELECT o_custkey, g, cpos, members, unnest(genes) AS gene, unnest(range(len(genes))) AS i FROM grp))
    GROUP BY o_custkey, g, solo, gene) GROUP BY o_custkey, g),
post AS (SELECT pos, genes FROM (
  SELECT row_number() OVER (ORDER BY f.o_custkey, f.g) - 1 AS pos, f.genes, c.score
  FROM folded f JOIN cl c ON c.o_custkey = f.o_custkey AND c.cpos = f.g) WHERE score >= 0.5),
orig AS (SELECT pos, genes FROM preds WHERE score >= 0.5)"""

BEST = """target AS (SELECT pos, CASE WHEN len(genes) > 2 THEN genes[:len(genes) // 2] ELSE genes END AS t FROM post),
by_start AS (SELECT t.pos, t.t, min(o.pos) AS o FROM target t LEFT JOIN orig o ON o.genes[1] = t.t[1] GROUP BY t.pos, t.t),
tg AS (SELECT DISTINCT pos, unnest(t) AS gene FROM by_start WHERE o IS NULL),
og AS (SELECT DISTINCT pos AS o, unnest(genes) AS gene FROM orig),
ov AS (SELECT pos, o FROM (SELECT pos, o, count(*) AS n FROM tg JOIN og USING (gene) GROUP BY pos, o)
       QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, o) = 1),
origin AS (SELECT b.pos, coalesce(b.o, ov.o) AS original_pos FROM by_start b LEFT JOIN ov USING (pos))"""

OVER = f"""{MERGED}, {BEST}, {REGIONS},
rgenes AS (SELECT DISTINCT gene FROM regions),
pg2 AS (
  SELECT DISTINCT g.pos, g.gene, list_contains(coalesce(o.genes, []), g.gene) AS orig,
         g.gene IN (SELECT gene FROM rgenes) AS gold
  FROM (SELECT pos, unnest(genes) AS gene FROM post) g JOIN origin n ON n.pos = g.pos
  LEFT JOIN orig o ON o.pos = original_pos),
cnt AS (SELECT pos, count(*) FILTER (orig) AS o, count(*) FILTER (NOT orig) AS m, count(*) FILTER (orig AND NOT gold) AS onot,
               count(*) FILTER (NOT orig AND NOT gold) AS mnot, count(*) FILTER (gold) AS ing FROM pg2 GROUP BY pos),
report AS (
  SELECT p.pos, 'Cluster' || p.genes[1] || '_' || p.genes[-1] AS cluster, coalesce(len(o.genes), 0) AS n_original,
         len(p.genes) AS n_processed, CASE WHEN c.o > 0 THEN onot * 100.0 / c.o ELSE 0 END AS over_original,
         CASE WHEN m > 0 THEN mnot * 100.0 / m ELSE 0 END AS over_merged,
         (onot + mnot) * 100.0 / len(p.genes) AS over_total
  FROM cnt c JOIN post p ON p.pos = c.pos JOIN origin n ON n.pos = c.pos
  LEFT JOIN orig o ON o.pos = original_pos WHERE ing > 0)"""


def merged_and_original(spark, sf):
    base = clusters(spark, sf, lambda e: plain_gene(e["l_partkey"])).select("o_custkey", "pos", "genes", "score")
    post = globally(mg.successive_merge(base, CUST, 2)).filter("score >= 0.5")
    return post, globally(base).filter("score >= 0.5")


@query("gold_regions", f"WITH {REGIONS} SELECT gene, cluster_id FROM regions")
def gold_regions(spark, sf):
    return ev.gold_regions(region_gold(spark, sf))


@query("top_gold_matches", f"""
WITH RECURSIVE {MERGED}, {REGIONS}
SELECT pos, rank, cluster_id, n FROM (
  SELECT pos, cluster_id, count(*) AS n, row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, cluster_id) AS rank
  FROM (SELECT DISTINCT pos, unnest(genes) AS gene FROM post) JOIN regions USING (gene) GROUP BY pos, cluster_id)
WHERE rank <= 2""")
def top_gold_matches(spark, sf):
    post, _ = merged_and_original(spark, sf)
    return ev.top_gold_matches(post, ev.gold_regions(region_gold(spark, sf)))


@query("best_original_cluster", f"WITH RECURSIVE {MERGED}, {BEST} SELECT pos, original_pos FROM origin")
def best_original_cluster(spark, sf):
    post, orig = merged_and_original(spark, sf)
    return ev.best_original(post, orig, 2)


@query("best_original_by_overlap", f"""
WITH RECURSIVE {MERGED.replace("post AS (SELECT pos, genes", "post AS (SELECT pos, list_concat(['none'], genes) AS genes")}, {BEST}
SELECT pos, original_pos FROM origin""")
def best_original_by_overlap(spark, sf):
    """A leading gene that no original has: every cluster is settled by shared genes."""
    post, orig = merged_and_original(spark, sf)
    shifted = post.withColumn("genes", F.concat(F.array(F.lit("none")), "genes"))
    return ev.best_original(shifted, orig, 2)


@query("overestimation", f"""
WITH RECURSIVE {OVER}
SELECT pos, cluster, n_original, n_processed, round(over_original, 4) AS over_original,
       round(over_merged, 4) AS over_merged, round(over_total, 4) AS over_total FROM report""")
def overestimation(spark, sf):
    post, orig = merged_and_original(spark, sf)
    out = ev.overestimation(post, orig, ev.gold_regions(region_gold(spark, sf)), 2)
    for c in ("over_original", "over_merged", "over_total"):
        out = out.withColumn(c, F.round(c, 4))
    return out


@query("overestimation_averages", f"""
WITH RECURSIVE {OVER}
SELECT round(avg(over_original), 4) AS over_original, round(avg(over_merged), 4) AS over_merged,
       round(avg(over_total), 4) AS over_total FROM report""")
def overestimation_averages(spark, sf):
    post, orig = merged_and_original(spark, sf)
    out = ev.overestimation_averages(
        ev.overestimation(post, orig, ev.gold_regions(region_gold(spark, sf)), 2))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("gold_overlap_genes", f"""
WITH {preds_sql(LG)}, {GOLD}
SELECT pos, count(*) AS n FROM (SELECT DISTINCT pos, unnest(genes) AS gene FROM preds WHERE score >= 0.5)
WHERE gene IN (SELECT gene FROM gold) GROUP BY pos""")
def gold_overlap_genes(spark, sf):
    genes = ev.positive_clusters(predictions(spark, sf)).select(
        "pos", F.explode(F.array_distinct("genes")).alias("gene"))
    return genes.join(gold(spark, sf).select("gene"), "gene", "left_semi").groupBy("pos").agg(
        F.count("*").alias("n"))


# Joins ---------------------------------------------------------------------------------


def hits(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("Q"), txt("l_orderkey")).alias("qseqid"),
        F.concat(F.lit("S"), txt("l_suppkey")).alias("sseqid"),
        (F.col("l_tax") * 1000).alias("pident"), (F.col("l_discount") / 10000).alias("evalue"),
        F.col("l_extendedprice").alias("bitscore"), (F.col("l_quantity") * 2).alias("qcovs"))


HITS = """hits AS (
  SELECT 'Q' || l_orderkey AS qseqid, 'S' || l_suppkey AS sseqid, l_tax * 1000 AS pident,
         l_discount / 10000 AS evalue, l_extendedprice AS bitscore, l_quantity * 2 AS qcovs FROM lineitem)"""
SUBJECTS = f"""{HITS}, subjects AS (
  SELECT qseqid, sseqid, max(qcovs) AS qcovs FROM hits WHERE evalue < 0.00001::DOUBLE AND qcovs > 50 GROUP BY ALL)"""


@query("significant_alignments", f"WITH {SUBJECTS} SELECT * FROM subjects")
def significant_alignments(spark, sf):
    return mt.order_by_coverage(mt.significant_subjects(hits(spark, sf)))


@query("alignment_table", f"WITH {HITS} SELECT * FROM hits WHERE evalue < 0.000005::DOUBLE")
def alignment_table(spark, sf):
    return mt.alignment_table(hits(spark, sf), 0.000005)


@query("reduced_similarity", f"""
WITH {HITS} SELECT qseqid || '|' || sseqid AS id, pident, bitscore, qcovs FROM hits""")
def reduced_similarity(spark, sf):
    return mt.reduced_similarity(hits(spark, sf))


@query("max_pair_similarity", f"WITH {PAIRS} SELECT a, b, pident FROM pairs")
def max_pair_similarity(spark, sf):
    return similar_pairs(spark, sf)


@query("ontology_terms", f"""
WITH {SUBJECTS}, m AS (
  SELECT 'S' || s_suppkey AS entry, unnest(['GO:' || s_nationkey, 'GO:' || (s_suppkey % 7)]) AS goid FROM supplier)
SELECT DISTINCT qseqid, goid FROM subjects JOIN m ON entry = sseqid""")
def ontology_terms(spark, sf):
    mapping = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), txt("s_suppkey")).alias("entry"),
        F.concat(F.lit("GO:"), txt("s_nationkey"), F.lit("; GO:"),
                 (F.col("s_suppkey") % 7).cast("string"), F.lit(";")).alias("goids"))
    return mt.ontology_terms(mt.significant_subjects(hits(spark, sf)), mapping)


@query("orthogroup_sequences", f"""
WITH {SEQS}
SELECT doc_id::VARCHAR AS seq_id, length(seq) AS n FROM seqs
WHERE length(seq) > 1 AND doc_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)""")
def orthogroup_sequences(spark, sf):
    groups = table(spark, sf, "customer").filter("c_nationkey < 20").select(
        F.col("c_nationkey").cast("string").alias("group_id"),
        F.array(F.concat(F.lit(" "), txt("c_custkey"))).alias("members"))
    seqs = sequences(spark, sf).select(txt("doc_id").alias("seq_id"), "seq")
    return mt.orthogroup_sequences(groups, seqs).select("seq_id", F.length("seq").alias("n"))


@query("unlabelled_sequences", f"""
WITH {SEQS} SELECT doc_id AS seq_id, md5(seq) AS digest FROM seqs WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unlabelled_sequences(spark, sf):
    seqs = sequences(spark, sf).select(F.col("doc_id").alias("seq_id"), "seq")
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("seq_id"))
    return mt.without_ids(seqs, ids).select("seq_id", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("not_yet_written", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def not_yet_written(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return mt.not_yet_written(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


def source_members(spark, sf):
    return sequences(spark, sf).select(
        F.concat("source", F.lit(".1|"), txt("doc_id")).alias("seq_id"), F.col("doc_id").alias("pos"), "seq")


JOINED = f"""{SEQS},
joined AS (SELECT source AS cluster_id, coalesce(string_agg(seq, '' ORDER BY doc_id), '') AS alltext FROM seqs GROUP BY source)"""


@query("cluster_concatenation", f"""
WITH {JOINED}, {digests_sql("joined", "cluster_id", "alltext")} SELECT * FROM digests""")
def cluster_concatenation(spark, sf):
    return pc.piece_digests(mt.cluster_pieces(source_members(spark, sf), piece=PIECE), ["cluster_id"], FAN)


@query("cluster_piece_table", f"""
WITH {JOINED} SELECT cluster_id, p AS piece, p * {PIECE} AS "offset", md5(substr(alltext, (p * {PIECE} + 1)::BIGINT, {PIECE})) AS digest
FROM (SELECT cluster_id, alltext, unnest(range(0, greatest((length(alltext) + {PIECE - 1}) // {PIECE}, 1))) AS p FROM joined)""")
def cluster_piece_table(spark, sf):
    return mt.cluster_pieces(source_members(spark, sf), piece=PIECE).select(
        "cluster_id", "piece", "offset", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("cluster_region_texts", f"""
WITH {JOINED},
ends AS (SELECT doc_id, source, sum(length(seq)) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM seqs)
SELECT doc_id, md5(substr(alltext, (greatest(e - 900, 0) + 1)::BIGINT, (e + 60 - greatest(e - 900, 0))::BIGINT)) AS digest
FROM ends JOIN joined ON cluster_id = source""")
def cluster_region_texts(spark, sf):
    """The text around the end of every sequence in its cluster, over the seams."""
    members = source_members(spark, sf)
    lengths = members.select(
        F.split_part("seq_id", F.lit("."), F.lit(1)).alias("cluster_id"), "pos", F.length("seq").cast("long").alias("n"))
    ends = scan(lengths, ["cluster_id"], "pos", sums={"e": F.col("n")}).select(
        "cluster_id", F.col("pos").alias("doc_id"), (F.col("e") - 900).alias("begin"), (F.col("e") + 60).alias("end"))
    texts = pc.region_texts(mt.cluster_pieces(members, piece=PIECE), ["cluster_id"], ends, "doc_id", PIECE)
    return texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def mrna(spark, sf):
    return table(spark, sf, "part").filter("p_size <= 40").select(
        plain_gene("p_partkey").alias("name"), F.col("p_brand").alias("seqid"),
        (F.col("p_size") * 100).alias("start"),
        (F.col("p_size") * 100 + F.floor("p_retailprice")).cast("long").alias("end"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("p_partkey") % 3).cast("string").alias("phase"))


def order_genes(spark, sf):
    """Genes of every order in line order, as long rows."""
    folded = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("e"))
    return folded.select(
        F.col("l_orderkey").alias("cluster_id"), F.posexplode("e").alias("pos", "e")
    ).select("cluster_id", "pos", plain_gene("e.l_partkey").alias("gene"))


LOCATED = f"""mrna AS (
  SELECT printf('P_%05d', p_partkey) AS name, p_brand AS seqid, p_size * 100 AS start,
         p_size * 100 + floor(p_retailprice)::BIGINT AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
         (p_partkey % 3)::VARCHAR AS phase, p_partkey, p_type, p_size FROM part WHERE p_size <= 40),
located AS (
  SELECT l_orderkey AS cluster_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
         {PG} AS gene, mrna.* FROM lineitem LEFT JOIN mrna ON name = {PG})"""


@query("gene_features", f"""
WITH {LOCATED}
SELECT cluster_id, pos, gene, name IS NOT NULL AS found, seqid, start, "end", strand, phase FROM located""")
def gene_features(spark, sf):
    return mt.gene_features(order_genes(spark, sf), mrna(spark, sf)).select(
        "cluster_id", F.col("pos").cast("long").alias("pos"), "gene", "found", "seqid", "start", "end", "strand", "phase")


@query("unmatched_genes", f"WITH {LOCATED} SELECT DISTINCT gene FROM located WHERE name IS NULL")
def unmatched_genes(spark, sf):
    return mt.unmatched_genes(mt.gene_features(order_genes(spark, sf), mrna(spark, sf)))


@query("cluster_extents", f"""
WITH {LOCATED}, edge AS (SELECT cluster_id, min(pos) AS lo, max(pos) AS hi FROM located GROUP BY cluster_id)
SELECT e.cluster_id, f.seqid, f.start, l."end", f.strand, f.phase
FROM edge e JOIN located f ON f.cluster_id = e.cluster_id AND f.pos = e.lo
JOIN located l ON l.cluster_id = e.cluster_id AND l.pos = e.hi""")
def cluster_extents(spark, sf):
    return mt.cluster_extent(mt.gene_features(order_genes(spark, sf), mrna(spark, sf)))


@query("coloured_genes", f"""
WITH {LOCATED}, {GOLD.replace(LG, PG)}, kinds AS (
  SELECT printf('P_%05d', p_partkey) AS gene, CASE WHEN p_size > 30 THEN 'backbone' ELSE 'transporter' END AS kind
  FROM part WHERE p_size > 20)
SELECT cluster_id, pos, l.gene, CASE WHEN kind = 'backbone' THEN '#EE0000' WHEN kind = 'transporter' THEN '#1888f0'
       WHEN g.gene IS NOT NULL THEN '#9931f2' END AS colour
FROM located l LEFT JOIN kinds USING (gene) LEFT JOIN (SELECT DISTINCT gene FROM gold) g USING (gene)""")
def coloured_genes(spark, sf):
    kinds = table(spark, sf, "part").filter("p_size > 20").select(
        plain_gene("p_partkey").alias("gene"),
        F.when(F.col("p_size") > 30, "backbone").otherwise("transporter").alias("type"))
    members = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(plain_gene("l_partkey").alias("gene"))
    located = mt.gene_features(order_genes(spark, sf), mrna(spark, sf))
    return mt.coloured_genes(located, kinds, members).select(
        "cluster_id", F.col("pos").cast("long").alias("pos"), "gene", "colour")


@query("similar_gene_votes", f"""
WITH {PAIRS}, {preds_sql(LG)}, pos_genes AS (SELECT DISTINCT unnest(genes) AS gene FROM preds WHERE score >= 0.5),
both_ways AS (SELECT a, b, max(pident) AS pident FROM (
  SELECT a, b, pident FROM pairs UNION ALL SELECT b, a, pident FROM pairs WHERE a <> b) GROUP BY a, b),
und AS (SELECT DISTINCT {LG} AS gene FROM lineitem WHERE l_returnflag = 'N'),
ranked AS (SELECT a, b FROM both_ways WHERE a IN (SELECT gene FROM und)
           QUALIFY row_number() OVER (PARTITION BY a ORDER BY pident DESC, b) <= 10),
votes AS (SELECT a AS gene, count(*) FILTER (b IN (SELECT gene FROM pos_genes)) AS n FROM ranked GROUP BY a)
SELECT gene, round(coalesce(n, 0) * 0.1, 4)::DOUBLE AS score, coalesce(n, 0) >= 5 AS positive FROM und LEFT JOIN votes USING (gene)""")
def similar_gene_votes(spark, sf):
    und = table(spark, sf, "lineitem").filter("l_returnflag = 'N'").select(line_gene().alias("gene"))
    pairs = similar_pairs(spark, sf, block=("l_partkey",))
    out = mt.vote_by_similar(und, pairs, ev.positive_genes(predictions(spark, sf)), within=("l_partkey",))
    return out.withColumn("score", F.round("score", 4))


# Sequence similarity -------------------------------------------------------------------

REPS = f"""{SEQS}, reps AS (SELECT min(doc_id) AS id, seq FROM seqs GROUP BY seq)"""


@query("copy_groups", f"""
WITH {REPS} SELECT doc_id, id AS representative FROM seqs JOIN reps USING (seq)""")
def copy_groups(spark, sf):
    return sim.copy_groups(sequences(spark, sf), "doc_id", "seq")


SETS = f"""{REPS}, grams AS (
  SELECT DISTINCT id, substr(seq, i, 16) AS g FROM (SELECT id, seq, unnest(range(1, length(seq) - 14)) AS i FROM reps)),
sized AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
shared AS (
  SELECT a, b, sa.n AS na, sb.n AS nb, shared FROM (
    SELECT x.id AS a, y.id AS b, count(*) AS shared FROM grams x JOIN grams y USING (g) WHERE x.id < y.id GROUP BY x.id, y.id)
  JOIN sized sa ON sa.id = a JOIN sized sb ON sb.id = b)"""


@query("seed_similarity", f"""
WITH {SETS}
SELECT a, b, shared::BIGINT AS shared, round(shared / (na + nb - shared), 6) AS jaccard,
       round(shared / least(na, nb), 6) AS containment, round(shared / na, 6) AS qcov, round(shared / nb, 6) AS scov
FROM shared WHERE shared / (na + nb - shared) >= 0.5""")
def seed_similarity(spark, sf):
    out = sim.seed_similarity(sequences(spark, sf), "doc_id", "seq", 16, 0.5)
    return out.select("a", "b", "shared", *[
        F.round(c, 6).alias(c) for c in ("jaccard", "containment", "qcov", "scov")])


@query("similarity_with_self", f"""
WITH {SETS}
SELECT a, b, round(shared / (na + nb - shared), 6) AS jaccard FROM shared WHERE shared / (na + nb - shared) >= 0.8
UNION ALL SELECT id, id, 1.0 FROM reps""")
def similarity_with_self(spark, sf):
    seqs = sequences(spark, sf)
    pairs = sim.seed_similarity(seqs, "doc_id", "seq", 16, 0.8)
    out = sim.with_self_pairs(pairs, sim.copy_groups(seqs, "doc_id", "seq"), "doc_id")
    return out.withColumn("jaccard", F.round("jaccard", 6))


# Every seventh sequence also stands alone as its first quarter, which is inside it but not similar.
PARTS = f"""{SEQS}, reps AS (
  SELECT min(id) AS id, seq FROM (SELECT doc_id AS id, seq FROM seqs
    UNION ALL SELECT -doc_id - 1, substr(seq, 1, length(seq) // 4) FROM seqs WHERE doc_id % 7 = 0) GROUP BY seq)"""


@query("contained_sequences", f"""
WITH {SETS.replace(REPS, PARTS)}
SELECT a AS query, b AS subject, shared::BIGINT AS shared, round(shared / na, 6) AS qcov, round(shared / nb, 6) AS scov FROM (
  SELECT a, b, na, nb, shared FROM shared UNION ALL SELECT b, a, nb, na, shared FROM shared) WHERE shared / na > 0.5""")
def contained_sequences(spark, sf):
    seqs = sequences(spark, sf).select("doc_id", "seq")
    quarter = seqs.filter(F.col("doc_id") % 7 == 0).select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.substring("seq", F.lit(1), F.floor(F.length("seq") / 4).cast("int")).alias("seq"))
    out = sim.contained_sequences(seqs.unionByName(quarter), "doc_id", "seq", 16, 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("qcov", "scov")})
