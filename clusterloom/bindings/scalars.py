"""Column expressions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.bindings import query, table
from clusterloom.functions import scalar as sc


@query("normalized_sequences", """
WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z-]', '', 'g')) AS seq FROM documents)
SELECT doc_id,
       md5(regexp_replace(seq, '[BDEFHIJKLMNOPQRSUVWXYZ]', '', 'g')) AS nucleotide,
       md5(regexp_replace(seq, '[BJXZ-]', '', 'g')) AS aminoacid
FROM s""")
def normalized_sequences(spark, sf):
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z-]", ""))
    digest = lambda kind: F.md5(sc.normalize_sequence(seq, kind).cast("binary")).alias(kind)
    return table(spark, sf, "documents").select("doc_id", digest("nucleotide"), digest("aminoacid"))


@query("labels_from_names", """
SELECT event_id, CASE WHEN lower(name) LIKE '%bgc%' THEN 1 ELSE 0 END AS label
FROM (SELECT event_id, 'run/' || CASE WHEN event_type IN ('view', 'click') THEN 'BGC' ELSE 'neg' END
             || user_id || '.fasta' AS name FROM events)""")
def labels_from_names(spark, sf):
    name = F.concat(
        F.lit("run/"), F.when(F.col("event_type").isin("view", "click"), "BGC").otherwise("neg"),
        F.col("user_id").cast("string"), F.lit(".fasta"))
    return table(spark, sf, "events").select("event_id", sc.label_from_name(name).alias("label"))


@query("normalized_gene_ids", """
SELECT l_orderkey, l_partkey, l_linenumber,
       CASE WHEN l_linenumber % 2 = 0 THEN 'g' || l_partkey || '|' || l_suppkey || '.1'
            ELSE 'g' || l_partkey END AS gene_id,
       'PF' || l_suppkey AS accession
FROM lineitem""")
def normalized_gene_ids(spark, sf):
    key = lambda c: F.col(c).cast("string")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(
        F.lit(">g"), key("l_partkey"), F.lit("|"), key("l_suppkey"), F.lit(".1"))).otherwise(
        F.concat(F.lit(">g"), key("l_partkey"), F.lit("."), key("l_linenumber")))
    acc = F.concat(F.lit("PF"), key("l_suppkey"), F.lit("."), key("l_linenumber"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", sc.normalize_gene_id(raw).alias("gene_id"),
        sc.strip_version(acc).alias("accession"))


@query("path_parts", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)
SELECT page_id, string_split(path, '/')[-1] AS base_name,
       string_split(string_split(path, '/')[-1], '.')[1] AS stem,
       regexp_extract(string_split(path, '/')[-1], '[^.](\.[^.]*)$', 1) AS extension,
       string_split(path, '/')[-2] AS species
FROM p""")
def path_parts(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf, "pages").select(
        "page_id", sc.base_name(path).alias("base_name"), sc.file_stem(path).alias("stem"),
        sc.extension(path).alias("extension"), sc.species_from_path(path).alias("species"))


@query("positive_scores", """
SELECT event_type, count(*) AS n, count(*) FILTER (value / 100 >= 0.5) AS n_positive
FROM events GROUP BY event_type""")
def positive_scores(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.count_if(sc.is_positive(F.col("value") / 100)).alias("n_positive"))


@query("cluster_names", """
WITH c AS (SELECT l_orderkey, list('G' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS genes
           FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'Cluster' || genes[1] || '_' || genes[-1] AS display_id,
       genes[1] || '|to|' || genes[-1] AS slim_id
FROM c""")
def cluster_names(spark, sf):
    genes = F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))),
        lambda g: F.concat(F.lit("G"), g["l_partkey"].cast("string")))
    return (table(spark, sf, "lineitem").groupBy("l_orderkey").agg(genes.alias("genes"))
            .select("l_orderkey", sc.cluster_display_id(F.col("genes")).alias("display_id"),
                    sc.slim_window_id(F.col("genes")).alias("slim_id")))


@query("annotation_colours", """
WITH a AS (
  SELECT p_partkey, p_size, CASE p_type WHEN 'ECONOMY' THEN 'backbone PKS' WHEN 'SMALL' THEN 'tailoring'
         WHEN 'MEDIUM' THEN 'transcription factor transcript' WHEN 'LARGE' THEN 'transporter' END AS kind
  FROM part)
SELECT p_partkey, CASE kind WHEN 'backbone PKS' THEN '#EE0000' WHEN 'tailoring' THEN '#EE9300'
         WHEN 'transcription factor transcript' THEN '#048014' WHEN 'transporter' THEN '#1888f0'
         ELSE CASE WHEN p_size > 25 THEN '#9931f2' END END AS colour,
       CASE WHEN kind IS NULL THEN 0.0 WHEN kind = 'backbone PKS' THEN 2.0 ELSE 1.5 END::DOUBLE AS weight
FROM a""")
def annotation_colours(spark, sf):
    kind = (F.when(F.col("p_type") == "ECONOMY", "backbone PKS")
            .when(F.col("p_type") == "SMALL", "tailoring")
            .when(F.col("p_type") == "MEDIUM", "transcription factor transcript")
            .when(F.col("p_type") == "LARGE", "transporter"))
    return table(spark, sf, "part").select(
        "p_partkey", sc.annotation_colour(kind, F.col("p_size") > 25).alias("colour"),
        sc.annotation_weight(kind).alias("weight"))


@query("result_name_fields", """
SELECT event_id, 'kmers6+' || event_type AS features, 'logit' AS classifier,
       user_id::VARCHAR AS length, substr('50x', 1, 2) AS overlap,
       CASE user_id % 4 WHEN 0 THEN 'succ0' WHEN 1 THEN 'succ2' WHEN 2 THEN 'merge2' ELSE 'sim' END AS variant
FROM events""")
def result_name_fields(spark, sf):
    variant = F.element_at(F.array(
        F.lit(""), F.lit("succ2."), F.lit("merge.succ2."), F.lit("similar.")),
        (F.col("user_id") % 4 + 1).cast("int"))
    name = F.concat(
        F.lit("logit_kmers6_"), F.col("event_type"), F.lit("_len"), F.col("user_id").cast("string"),
        F.lit("_overlap50x_org.IDs.test."), variant, F.lit("eval.metrics"))
    fields = sc.parse_result_name(name)
    return table(spark, sf, "events").select("event_id", *(c.alias(n) for n, c in fields.items()))
