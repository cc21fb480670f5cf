"""Dataset plans over the test tables: each writes its files, and the query reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.bindings import evaluation as be
from clusterloom.bindings import files as bf
from clusterloom.bindings import policy as bp
from clusterloom.bindings import query, table
from clusterloom.bindings.features import SEQS, sequences
from clusterloom.operators import similarity as sim
from clusterloom.plans import corpus as pc
from clusterloom.plans import features as pf
from clusterloom.sources import readers as rd

txt = lambda c: F.col(c).cast("string")
md5 = lambda c: F.md5(F.col(c).cast("binary"))

# Domain records of every order, as a dataset folder -------------------------------------

DOMAINS = f"""{bf.DOMAIN_LINES},
seen AS (SELECT instance_id::VARCHAR AS instance_id, 'PF' || l_partkey % 50 AS feature, l_linenumber, l_partkey, l_suppkey
         FROM (SELECT l_orderkey AS instance_id, l_partkey, l_suppkey, l_linenumber FROM lineitem)),
counted AS (SELECT feature, count(*) AS n FROM seen GROUP BY feature),
vocab AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM counted WHERE n >= 3)"""


def domain_folder(spark, sf):
    """One record per order with a domain per line, read back as dataset contents."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))),
        lambda e: F.concat(F.lit("PF"), (e["l_partkey"] % 50).cast("string"))), "\n").alias("body"))
    root = bf.scratch(spark, "dataset")
    bf.write_lines(lines.select(F.concat(F.lit(">"), txt("l_orderkey"), F.lit("\n"), F.col("body")).alias("value")), f"{root}/domains")
    return rd.read_dataset(spark, root, "domains", by_folder=True), root


@query("dataset_vocabulary", f"WITH {DOMAINS} SELECT 'domains' AS feature_type, feature, idx FROM vocab")
def dataset_vocabulary(spark, sf):
    contents, root = domain_folder(spark, sf)
    return pf.extract_features(contents, "domains", path=f"{root}/vocabulary")


@query("dataset_matrix", f"""
WITH {DOMAINS} SELECT instance_id, idx, count(*)::DOUBLE AS cnt FROM seen JOIN vocab USING (feature) GROUP BY ALL""")
def dataset_matrix(spark, sf):
    contents, _ = domain_folder(spark, sf)
    return pf.feature_matrix(contents, pf.extract_features(contents, "domains")).select("instance_id", "idx", F.col("cnt").cast("double").alias("cnt"))


# Similarity ------------------------------------------------------------------------------


@query("similarity_dataset", f"""
WITH {be.SETS} SELECT least(a::VARCHAR, b::VARCHAR) AS a, greatest(a::VARCHAR, b::VARCHAR) AS b, round(100 * shared / (na + nb - shared), 4) AS pident
FROM (SELECT shared, na, nb, a, b FROM shared) WHERE shared / (na + nb - shared) >= 0.8
UNION ALL SELECT least(doc_id::VARCHAR, id::VARCHAR), greatest(doc_id::VARCHAR, id::VARCHAR), 100.0 FROM seqs JOIN reps USING (seq) WHERE doc_id <> id""")
def similarity_dataset(spark, sf):
    """The written table names representatives; the copies beside it give their identity."""
    root = bf.scratch(spark, "similarity")
    seqs = sequences(spark, sf)
    bf.write_lines(seqs.select(F.concat(F.lit(">"), F.format_string("%012d", "doc_id"), F.lit("\n"), F.col("seq")).alias("value")), f"{root}/fasta")
    pc.similarity_table(spark, f"{root}/fasta", f"{root}/out", 16, 0.8, ext=None)
    pairs = rd.read_similarity(spark, f"{root}/out/similarity")
    copies = spark.read.csv(f"{root}/out/copies", sep="\t", header=True, schema="id string, representative string")
    full = sim.with_copies(pairs, copies)
    number = lambda c: F.col(c).cast("long").cast("string")
    return full.select(F.least(number("a"), number("b")).alias("a"), F.greatest(number("a"), number("b")).alias("b"), F.round("pident", 4).alias("pident"))


# Annotation records ----------------------------------------------------------------------


@query("ontology_dataset", f"""
WITH {be.SUBJECTS}, owners AS (SELECT 'S' || s_suppkey AS entry, 'GO:' || s_nationkey AS goid FROM supplier),
terms AS (SELECT DISTINCT qseqid FROM subjects JOIN owners ON entry = sseqid)
SELECT count(*) FILTER (q IN (SELECT qseqid FROM terms)) AS found, count(*) FILTER (q NOT IN (SELECT qseqid FROM terms)) AS not_found
FROM (SELECT 'Q' || o_orderkey AS q FROM orders)""")
def ontology_dataset(spark, sf):
    mapping = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), txt("s_suppkey")).alias("entry"), F.concat(F.lit("GO:"), txt("s_nationkey")).alias("goids"))
    queries = table(spark, sf, "orders").select(F.concat(F.lit("Q"), txt("o_orderkey")).alias("instance_id"))
    return pc.ontology_dataset(be.hits(spark, sf), mapping, queries, bf.scratch(spark, "ontology"))


@query("domain_dataset", """
SELECT l_orderkey::VARCHAR AS header, md5(string_agg('PF' || l_partkey || '|dom' || l_suppkey, chr(10)
  ORDER BY l_linenumber, 'PF' || l_partkey || '|dom' || l_suppkey)) AS digest FROM lineitem GROUP BY l_orderkey""")
def domain_dataset(spark, sf):
    hits = table(spark, sf, "lineitem").select(
        txt("l_orderkey").alias("seq_id"), F.col("l_linenumber").alias("ali_start"), F.concat(F.lit("PF"), txt("l_partkey")).alias("hmm_acc"),
        F.concat(F.lit("dom"), txt("l_suppkey")).alias("hmm_name"))
    owners = table(spark, sf, "orders").select(txt("o_orderkey").alias("instance_id"))
    path = bf.scratch(spark, "domains")
    pc.domain_dataset(hits, owners, path)
    return rd.read_headed_records(spark, path, None).select("header", md5("body").alias("digest"))


# Cluster features ------------------------------------------------------------------------


@query("cluster_gff_files", f"""
WITH {be.LOCATED.split("located AS (")[0]}
genes AS (SELECT cluster_id, gene, row_number() OVER (PARTITION BY cluster_id ORDER BY gene) AS i, count(*) OVER (PARTITION BY cluster_id) AS n
          FROM (SELECT DISTINCT l_orderkey AS cluster_id, {be.PG} AS gene FROM lineitem)),
spot AS (SELECT genes.*, m.* FROM genes LEFT JOIN mrna m ON name = gene),
ends AS (SELECT f.cluster_id, f.seqid, f.start, l."end", f.strand, f.phase, (SELECT string_agg(gene, '|' ORDER BY i) FROM genes g WHERE g.cluster_id = f.cluster_id) AS genes
         FROM spot f JOIN spot l ON f.cluster_id = l.cluster_id AND f.i = 1 AND l.i = l.n)
SELECT 'pergene' AS kind, concat_ws(chr(9), seqid, 'loom', start, "end", '?', strand, phase, 'Name=' || name || ';Note=' || cluster_id) AS line
FROM spot WHERE name IS NOT NULL
UNION ALL
SELECT 'percluster', concat_ws(chr(9), coalesce(seqid, '.'), 'loom', coalesce(start::VARCHAR, '.'), coalesce("end"::VARCHAR, '.'), '?',
  coalesce(strand, '.'), coalesce(phase, '.'), 'Name=' || cluster_id || ';Note=' || genes) FROM ends""")
def cluster_gff_files(spark, sf):
    """Clusters whose first or last gene has no feature keep all columns, as points."""
    m = be.mrna(spark, sf)
    gff = m.select("seqid", F.lit("mRNA").alias("type"), "start", "end", "strand", "phase", F.create_map(F.lit("Name"), F.col("name")).alias("attributes"))
    root = bf.scratch(spark, "gff")
    pc.clusters_to_gff(be.order_genes(spark, sf).select("cluster_id", "gene"), gff, root, "loom")
    lines = lambda kind: rd.read_lines(spark, f"{root}/{kind}", None).filter(~F.col("line").startswith("#")).select(F.lit(kind).alias("kind"), "line")
    return lines("pergene").unionByName(lines("percluster"))


# Policy ----------------------------------------------------------------------------------


def policy_contents(spark, sf):
    """Domain contents, one file per user."""
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", bp.domain().alias("d"))
    return ev.groupBy("user_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "d"))), lambda e: e["d"]), "\n").alias("content")).select(
        F.concat(F.lit("x/"), F.when(F.col("user_id") % 2 == 1, "bgc").otherwise("neg"), txt("user_id")).alias("file"),
        F.lit("domains").alias("feature_type"), "content")


@query("trained_policy", f"""
WITH RECURSIVE {bp.QSQL}
SELECT state, round(r_keep, 6) AS r_keep, round(r_skip, 6) AS r_skip, round(q_keep, 6) AS q_keep, round(q_skip, 6) AS q_skip FROM qf""")
def trained_policy(spark, sf):
    """The Q table as a later run reads it."""
    q = pc.train_policy(policy_contents(spark, sf), bf.scratch(spark, "policy"), keep_threshold=0.9, alpha=1.0, gamma=bp.GAMMA, tolerance=bp.TOLERANCE)
    return q.select("state", *[F.round(c, 6).alias(c) for c in ("r_keep", "r_skip", "q_keep", "q_skip")])


@query("policy_statistics", f"""
WITH RECURSIVE {bp.QSQL}
SELECT state AS id, round(r_keep, 6) AS "rewardKeep", round(r_skip, 6) AS "rewardSkip", round(q_keep, 6) AS "qvalueKeep", round(q_skip, 6) AS "qvalueSkip" FROM qf""")
def policy_statistics(spark, sf):
    """The statistics file of a trained policy, read back."""
    out = bf.scratch(spark, "policy")
    pc.train_policy(policy_contents(spark, sf), out, keep_threshold=0.9, alpha=1.0, gamma=bp.GAMMA, tolerance=bp.TOLERANCE)
    stat = rd.read_policy_statistics(spark, f"{out}/stat")
    return stat.select("id", *[F.round(c, 6).alias(c) for c in stat.columns if c != "id"])
