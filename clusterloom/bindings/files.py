"""File round trips: the tables are written in a file format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clusterloom.bindings import query, table
from clusterloom.bindings.evaluation import HITS, LG, PG, hits, line_gene, mrna, order_genes, plain_gene, predictions, preds_sql
from clusterloom.bindings.features import SEQS, WORDS, sequences
from clusterloom.operators import evaluate as ev
from clusterloom.operators import match as mt
from clusterloom.sources import incremental as inc
from clusterloom.sources import readers as rd
from clusterloom.sources import records as rc
from clusterloom.sources import writers as wr
from clusterloom.session import cut_lineage, ensure_checkpoint_dir


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}/{name}"


def write_lines(df, path: str) -> str:
    df.write.mode("overwrite").text(path)
    return path


txt = lambda c: F.col(c).cast("string")
md5 = lambda c: F.md5(F.col(c).cast("binary"))


@query("fasta_round_trip", f"""
WITH {SEQS} SELECT doc_id::VARCHAR AS seq_id, md5(seq) AS digest, length(seq) AS n FROM seqs""")
def fasta_round_trip(spark, sf):
    path = scratch(spark, "all.fasta")
    # Wrapped at 60 characters, as sequence files are.
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    wr.write_fasta(sequences(spark, sf), F.concat(txt("doc_id"), F.lit(" "), F.col("lang")), wrapped, path)
    return rd.read_fasta(spark, path, None).select("seq_id", md5("seq").alias("digest"), F.length("seq").alias("n"))


@query("incremental_fasta", f"""
WITH {SEQS}
SELECT doc_id::VARCHAR AS seq_id, md5(seq) AS digest, doc_id % 3 = 0 AS in_first_run, 1 AS n_times FROM seqs""")
def incremental_fasta(spark, sf):
    path, out, state = (scratch(spark, name) for name in ("grown", "parsed", "state"))
    seqs = sequences(spark, sf)

    def run(part: str, rows):
        wr.write_fasta(rows, txt("doc_id"), "seq", f"{path}/{part}")
        return inc.ingest(rd.read_fasta(spark, path, None, stream=True), out, state)

    first = cut_lineage(run("first", seqs.filter("doc_id % 3 = 0")).select("seq_id").distinct())
    grown = run("second", seqs.filter("doc_id % 3 <> 0"))
    each = grown.groupBy("seq_id", md5("seq").alias("digest")).agg(F.count("*").alias("n_times"))
    seen = first.withColumn("_seen", F.lit(True))
    return each.join(seen, "seq_id", "left").select(
        "seq_id", "digest", F.coalesce("_seen", F.lit(False)).alias("in_first_run"), "n_times")


@query("sorted_fasta", f"""
WITH {SEQS} SELECT doc_id AS seq_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM seqs""")
def sorted_fasta(spark, sf):
    path = scratch(spark, "sorted.fasta")
    wr.write_fasta(sequences(spark, sf), "doc_id", "seq", path, sort=True)
    back = rd.read_fasta(spark, path, None).select(F.col("seq_id").cast("long").alias("seq_id"), "file")
    from clusterloom.operators.ordered import index_rows

    # Part files keep the order, so (file, id) sorts like id alone.
    return index_rows(back, [], ["file", "seq_id"]).select("seq_id", "pos")


@query("file_listing", """
SELECT count(DISTINCT source) AS n_sources, (SELECT count(*) FROM documents) AS n_records FROM documents""")
def file_listing(spark, sf):
    path = scratch(spark, "tree")
    docs = table(spark, sf, "documents").select(
        "source", F.concat(F.lit(">"), txt("doc_id"), F.lit("\nA")).alias("value"))
    docs.repartition("source").write.mode("overwrite").partitionBy("source").text(path)
    files = rd.list_files(spark, path, "txt").select(
        F.regexp_extract("file", "source=([^/]*)/", 1).alias("source"), "size").filter("size > 0")
    n = rd.read_lines(spark, path, "txt").filter(F.col("line").startswith(">")).agg(F.count("*")).scalar()
    return files.agg(F.countDistinct("source").alias("n_sources")).withColumn("n_records", n)


GBK_TAGS = """CASE doc_id % 3 WHEN 0 THEN 'LT_' || doc_id WHEN 1 THEN 'gene' || doc_id ELSE 'prot' || doc_id END"""


def genbank_path(spark, sf):
    """Documents as flat-file records: one CDS each, the sequence in ORIGIN lines."""
    path = scratch(spark, "zoo")
    d = sequences(spark, sf).withColumn("dna", F.translate("seq", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "acgtacgtacgtacgtacgtacgtac"))
    pad = F.lit("\n" + " " * 21)
    tag = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('/locus_tag="LT_'), txt("doc_id"), F.lit('"'))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit('/gene="gene'), txt("doc_id"), F.lit('"'))).otherwise(
        F.concat(F.lit('/protein_id="prot/'), txt("doc_id"), F.lit('"')))
    protein = F.regexp_replace("seq", "(.{58})", "$1\n" + " " * 21)
    record = F.concat(
        F.lit("LOCUS       L"), txt("doc_id"), F.lit("\nVERSION     V"), txt("doc_id"),
        F.lit(".1\nSOURCE      x\n  ORGANISM  "), F.col("lang"), F.lit("\nFEATURES             Location/Qualifiers\n     source          1..9\n     CDS             1..9"),
        pad, tag, pad, F.lit('/product="made by\n' + " " * 21), F.col("source"), F.lit('"'), pad, F.lit('/translation="'),
        protein, F.lit('"\nORIGIN\n        1 '), F.regexp_replace("dna", "(.{10})", "$1 "), F.lit("\n//"))
    return write_lines(d.select(record.alias("value")), path)


@query("genbank_proteins", f"""
WITH {SEQS}
SELECT 'V' || doc_id || '.1|zoo|' || {GBK_TAGS} || '|made by ' || source AS header, md5(seq) AS digest FROM seqs""")
def genbank_proteins(spark, sf):
    records = rd.read_genbank(spark, genbank_path(spark, sf), None)
    return rd.genbank_proteins(records).select("header", md5("seq").alias("digest"))


@query("genbank_fasta_folder", f"""
WITH {SEQS}
SELECT 'V' || doc_id || '.1|zoo|' || {GBK_TAGS} || '|made by ' || source AS header, md5(seq) AS digest FROM seqs""")
def genbank_fasta_folder(spark, sf):
    from clusterloom.plans.corpus import genbank_to_fasta

    back = genbank_to_fasta(spark, genbank_path(spark, sf), scratch(spark, "zoo.fasta"), None)
    return back.select("header", md5("body").alias("digest"))


@query("genbank_nucleotides", f"""
WITH {SEQS}
SELECT 'V' || doc_id || '.1' AS record_id, lang AS organism,
       md5(translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')) AS digest FROM seqs""")
def genbank_nucleotides(spark, sf):
    return rd.read_genbank(spark, genbank_path(spark, sf), None).select("record_id", "organism", md5("seq").alias("digest"))


@query("genbank_translations", f"""
WITH {SEQS} SELECT 'V' || doc_id || '.1' AS seq_id, md5(seq) AS cds_digest, length(seq) // 3 AS n FROM seqs""")
def genbank_translations(spark, sf):
    out = rd.genbank_translations(rd.read_genbank(spark, genbank_path(spark, sf), None))
    return out.select("seq_id", md5("cds_protein").alias("cds_digest"), F.length("protein").cast("long").alias("n"))


def gff_path(spark, sf):
    path = scratch(spark, "genes.gff3")
    rows = mrna(spark, sf).withColumn("name", F.concat("name", F.lit(".1")))
    body = wr.gff_lines(rows, "mRNA-source", F.col("seqid"), F.col("name"))
    # The third column is the feature type.
    typed = body.select(F.regexp_replace("line", "\tmRNA-source\t", "\tsrc\tmRNA\t").alias("line"))
    wr.write_gff(typed, path)
    return path


@query("gff_mrna_features", """
SELECT 'P_' || lpad(p_partkey::VARCHAR, 5, '0') AS name, p_brand AS seqid, p_size * 100 AS start,
       (p_size * 100 + floor(p_retailprice))::BIGINT AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       (p_partkey % 3)::VARCHAR AS phase FROM part WHERE p_size <= 40""")
def gff_mrna_features(spark, sf):
    gff = rd.read_gff(spark, gff_path(spark, sf))
    return rd.mrna_features(gff).withColumn("end", F.col("end").cast("long"))


@query("cluster_gff_lines", f"""
WITH located AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, {PG} AS gene,
         p_brand, p_size, p_retailprice, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey),
e AS (SELECT l_orderkey, arg_min(p_brand, rn) AS seqid, arg_min(p_size, rn) * 100 AS s,
             arg_max(p_size * 100 + floor(p_retailprice)::BIGINT, rn) AS e, arg_min(p_partkey, rn) AS k FROM located GROUP BY l_orderkey)
SELECT seqid || chr(9) || 'set' || chr(9) || s || chr(9) || e || chr(9) || '?' || chr(9) || CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END
       || chr(9) || (k % 3) || chr(9) || 'Name=' || l_orderkey || ';Note=C' || l_orderkey AS line FROM e""")
def cluster_gff_lines(spark, sf):
    every = table(spark, sf, "part").select(
        plain_gene("p_partkey").alias("name"), F.col("p_brand").alias("seqid"), (F.col("p_size") * 100).alias("start"),
        (F.col("p_size") * 100 + F.floor("p_retailprice")).cast("long").alias("end"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("p_partkey") % 3).cast("string").alias("phase"))
    extent = mt.cluster_extent(mt.gene_features(order_genes(spark, sf), every))
    path = scratch(spark, "percluster.gff3")
    wr.write_gff(wr.gff_lines(extent, "set", F.concat(F.lit("C"), txt("cluster_id")), txt("cluster_id")), path)
    return rd.read_lines(spark, path).filter(~F.col("line").startswith("##")).select("line")


@query("blast_round_trip", f"""
WITH {HITS} SELECT qseqid, sseqid, pident, evalue, bitscore, qcovs FROM hits""")
def blast_round_trip(spark, sf):
    path = scratch(spark, "out.blast")
    zero = lambda n: F.lit(0).alias(n)
    wr.write_tsv(hits(spark, sf).select(
        "qseqid", "sseqid", "pident", zero("length"), zero("mismatch"), zero("gapopen"), zero("qstart"), zero("qend"),
        zero("sstart"), zero("send"), "evalue", "bitscore", "qcovs"), path, header=False)
    return rd.read_blast(spark, path).select("qseqid", "sseqid", "pident", "evalue", "bitscore", "qcovs")


@query("domain_hit_round_trip", """
SELECT 's' || l_orderkey AS seq_id, l_linenumber AS ali_start, 'PF' || l_partkey || '.1' AS hmm_acc, 'dom' || l_suppkey AS hmm_name,
       l_quantity AS bit_score, CASE WHEN l_returnflag = 'R' THEN 'site' END AS active_site FROM lineitem""")
def domain_hit_round_trip(spark, sf):
    t = lambda c: F.col(c).cast("string")
    line = F.concat_ws(
        "  ", F.concat(F.lit("s"), t("l_orderkey")), t("l_linenumber"), F.lit("9"), F.lit("1"), F.lit("9"),
        F.concat(F.lit("PF"), t("l_partkey"), F.lit(".1")), F.concat(F.lit("dom"), t("l_suppkey")), F.lit("Domain"),
        F.lit("1"), F.lit("2"), F.lit("3"), t("l_quantity"), F.lit("1e-5"), F.lit("1"), F.lit("No_clan"),
        F.when(F.col("l_returnflag") == "R", "site"))
    path = write_lines(table(spark, sf, "lineitem").select(line.alias("value")), scratch(spark, "scan.out"))
    return rd.read_domain_hits(spark, path).select("seq_id", "ali_start", "hmm_acc", "hmm_name", "bit_score", "active_site")


DOMAIN_LINES = """dl AS (
  SELECT l_orderkey AS instance_id, {'n': l_linenumber, 'p': l_partkey} AS pos, 'PF' || l_partkey || '|dom' || l_suppkey AS line FROM lineitem)"""


def line_domains(spark, sf):
    t = lambda c: F.col(c).cast("string")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"), F.struct("l_linenumber", "l_partkey").alias("pos"),
        F.concat(F.lit("PF"), t("l_partkey"), F.lit("|dom"), t("l_suppkey")).alias("line"))


def annotation_rows(spark, sf):
    owners = table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"))
    return wr.annotation_records(line_domains(spark, sf), owners)


@query("annotation_records", f"""
WITH {DOMAIN_LINES}
SELECT instance_id::VARCHAR AS header, md5(string_agg(line, chr(10) ORDER BY pos, line)) AS digest FROM dl GROUP BY instance_id""")
def annotation_records(spark, sf):
    path = scratch(spark, "ann.domains")
    wr.write_annotations(annotation_rows(spark, sf), path)
    return rd.read_headed_records(spark, path, "txt").select("header", md5("body").alias("digest"))


@query("annotation_counts", """
SELECT count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS found,
       count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS not_found FROM orders""")
def annotation_counts(spark, sf):
    return wr.annotation_counts(annotation_rows(spark, sf))


@query("labelled_domain_table", """
SELECT l_orderkey AS sequence_id, 'dom' || l_suppkey AS protein_id, 'PF' || l_partkey AS pfam_id, l_orderkey % 2 AS in_cluster,
       count(*) AS n FROM lineitem GROUP BY ALL""")
def labelled_domain_table(spark, sf):
    path = scratch(spark, "labelled")
    label = F.col("instance_id") % 2
    wr.write_labelled_domains(wr.labelled_domains(line_domains(spark, sf), label), path)
    back = spark.read.csv(path, sep="\t", header=True, schema=(
        "sequence_id long, protein_id string, gene_start int, gene_end int, gene_strand int, pfam_id string, in_cluster long"))
    return back.groupBy("sequence_id", "protein_id", "pfam_id", "in_cluster").agg(F.count("*").alias("n"))


@query("dataset_contents", f"""
WITH {SEQS}, {DOMAIN_LINES}
SELECT doc_id::VARCHAR AS instance_id, 'kmers' AS feature_type, md5(regexp_replace(seq, '[BJXZ]', '', 'g')) AS digest FROM seqs
UNION ALL
SELECT instance_id::VARCHAR, 'domains', md5(string_agg(line, chr(10) ORDER BY pos, line)) FROM dl GROUP BY instance_id
UNION ALL
SELECT doc_id::VARCHAR, 'go', md5('GO:' || quality || chr(10) || 'GO:' || toxic) FROM labels""")
def dataset_contents(spark, sf):
    root = scratch(spark, "corpus")

    seqs = sequences(spark, sf).select(F.concat(F.lit(">"), txt("doc_id"), F.lit("\n"), F.col("seq")).alias("value"))
    go = table(spark, sf, "labels").select(F.concat(
        F.lit(">"), txt("doc_id"), F.lit("\nGO:"), txt("quality"), F.lit("\nGO:"), txt("toxic")).alias("value"))
    doms = annotation_rows(spark, sf).filter(F.col("record").isNotNull()).select(F.col("record").alias("value"))
    for df, ext in ((seqs, "fasta"), (go, "go"), (doms, "domains")):
        write_lines(df, f"{root}/{ext}")
    out = rd.read_dataset(spark, root, "go-kmers-domains", by_folder=True)
    return out.select("instance_id", "feature_type", md5("content").alias("digest"))


@query("prediction_file_order", f"""
WITH {preds_sql(LG)}, lines AS (SELECT array_to_string(genes, '|') AS g, score FROM preds)
SELECT row_number() OVER (ORDER BY g || chr(9) || score) - 1 AS pos, g AS genes, score FROM lines""")
def prediction_file_order(spark, sf):
    path = scratch(spark, "ids.test")
    wr.write_predictions(predictions(spark, sf), path)
    return rd.read_predictions(spark, path).withColumn("genes", F.array_join("genes", "|"))


@query("score_file_fold", f"""
WITH c AS (SELECT l_orderkey, {LG} AS gene FROM lineitem),
s AS (SELECT o_orderkey, 'PC' || o_custkey AS pc FROM orders WHERE o_totalprice / 500000 >= 0.5)
SELECT pc AS cluster_id, count(DISTINCT gene) AS n, md5(string_agg(DISTINCT gene, '|' ORDER BY gene)) AS digest
FROM c JOIN s ON o_orderkey = l_orderkey GROUP BY pc""")
def score_file_fold(spark, sf):
    genes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line_gene()).alias("genes"))
    rows = genes.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("G"), txt("o_orderkey")).alias("gold_cluster_id"),
        F.concat(F.lit("PC"), txt("o_custkey")).alias("predicted_cluster_id"),
        (F.col("o_totalprice") / 500000).alias("cluster_score"), "genes")
    path = scratch(spark, "eval.score")
    wr.write_scores(rows, path)
    return ev.fold_scores(rd.read_scores(spark, path, 0.5)).select(
        "cluster_id", F.size("genes").cast("long").alias("n"), F.md5(F.array_join("genes", "|").cast("binary")).alias("digest"))


@query("similarity_file", f"""
WITH {HITS} SELECT qseqid AS a, sseqid AS b, max(pident) AS pident FROM hits GROUP BY ALL""")
def similarity_file(spark, sf):
    path = scratch(spark, "similarity")
    wr.write_tsv(mt.reduced_similarity(hits(spark, sf)), path)
    return rd.read_similarity(spark, path)


@query("gold_file", """SELECT 'S' || l_suppkey AS cluster_id, 'P' || l_partkey AS gene, count(*) AS n FROM lineitem GROUP BY ALL""")
def gold_file(spark, sf):
    path = scratch(spark, "gold")
    wr.write_tsv(table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), txt("l_suppkey")).alias("clusterID"), F.concat(F.lit("P"), txt("l_partkey")).alias("geneID")), path)
    return rd.read_gold(spark, path).groupBy("cluster_id", "gene").agg(F.count("*").alias("n"))


@query("mapping_file", "SELECT 'S' || s_suppkey AS entry, 'GO:' || s_nationkey || '; GO:1' AS goids FROM supplier")
def mapping_file(spark, sf):
    path = scratch(spark, "map.tab")
    wr.write_tsv(table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), txt("s_suppkey")).alias("entry"),
        F.concat(F.lit("GO:"), txt("s_nationkey"), F.lit("; GO:1")).alias("goids")), path)
    return rd.read_ontology_mapping(spark, path)


@query("dictionary_file", """
SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS feature, count(*) AS n FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 2 <> 0 GROUP BY 1""")
def dictionary_file(spark, sf):
    """Even parts are tabbed, every fifth of them with a one-character feature that is skipped."""
    k = F.col("p_partkey")
    line = F.when(k % 10 == 0, F.concat(F.lit("id\t"), F.lit("x"))).when(
        k % 2 == 0, F.concat(F.lit("id\t"), F.col("p_name"))).otherwise(F.col("p_brand"))
    path = write_lines(table(spark, sf, "part").select(line.alias("value")), scratch(spark, "dict"))
    return rd.read_dictionary(spark, path).groupBy("feature").agg(F.count("*").alias("n"))


@query("gene_length_file", "SELECT 'P' || p_partkey AS gene, p_size::BIGINT AS length FROM part")
def gene_length_file(spark, sf):
    path = scratch(spark, "len")
    wr.write_tsv(table(spark, sf, "part").select(
        F.concat(F.lit("P"), txt("p_partkey"), F.lit(".1")).alias("gene"), "p_size"), path, header=False)
    return rd.read_gene_lengths(spark, path)


@query("target_cluster_file", "SELECT replace(s_name, ' ', '_') AS key, s_nationkey::VARCHAR AS value FROM supplier")
def target_cluster_file(spark, sf):
    path = scratch(spark, "targets")
    wr.write_tsv(table(spark, sf, "supplier").select("s_name", txt("s_nationkey").alias("v")), path, header=False)
    return rd.read_target_clusters(spark, path)


@query("rule_and_annotation_files", """
SELECT p_brand AS domain, count(*) AS n, max(p_type) AS type FROM part GROUP BY p_brand""")
def rule_and_annotation_files(spark, sf):
    part = table(spark, sf, "part")
    rules = write_lines(part.select(F.col("p_brand").alias("value")).distinct(), scratch(spark, "rules"))
    ann = scratch(spark, "ann")
    wr.write_tsv(part.select("p_brand", "p_type"), ann, header=False)
    return rd.read_list(spark, rules).join(rd.read_annotation(spark, ann), "domain").groupBy("domain").agg(
        F.count("*").alias("n"), F.max("type").alias("type"))


@query("reward_file", """
SELECT 'PF' || user_id AS domain, list(CASE WHEN event_type = 'view' THEN 1 ELSE -1 END ORDER BY event_id)::INT[]::VARCHAR AS rewards,
       count(*) AS n FROM events GROUP BY user_id""")
def reward_file(spark, sf):
    ev_ = table(spark, sf, "events").groupBy("user_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("event_id", "event_type"))),
        lambda e: F.when(e["event_type"] == "view", "1").otherwise("-1")).alias("v"))
    line = F.concat(F.lit("PF"), txt("user_id"), F.lit(".7|name\t"), F.array_join("v", ","))
    path = write_lines(ev_.select(line.alias("value")), scratch(spark, "rewards"))
    back = rd.read_rewards(spark, path)
    sizes = rd.long_rewards(back).groupBy("domain").agg(F.count("*").alias("n"))
    shown = F.concat(F.lit("["), F.array_join(F.col("rewards").cast("array<string>"), ", "), F.lit("]"))
    return back.select("domain", shown.alias("rewards")).join(sizes, "domain")


@query("orthogroup_file", """
SELECT printf('OG%03d', c_nationkey) AS group_id, count(*) AS n, min(c_name) AS low FROM customer
GROUP BY c_nationkey ORDER BY 1 LIMIT 10""")
def orthogroup_file(spark, sf):
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list("c_name").alias("m"))
    name = F.format_string("OG%03d", "c_nationkey")
    line = F.concat(name, F.lit("\t"), F.array_join("m", ", "))
    path = scratch(spark, "ortho")
    rows.orderBy(name).select(line.alias("Orthogroup\tmembers")).write.mode("overwrite").csv(path, header=True, sep="\u0001", quote="", escape="")
    return rd.read_orthogroups(spark, path, 10).select(
        "group_id", F.size("members").cast("long").alias("n"), F.array_min("members").alias("low"))


@query("word_vector_file", """
SELECT 'w' || vec_id AS feature, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[-1]::DOUBLE, 5) AS last, len(embedding) AS n FROM embeddings""")
def word_vector_file(spark, sf):
    v = table(spark, sf, "embeddings")
    line = F.concat(F.lit("w"), txt("vec_id"), F.lit(" "), F.array_join(F.col("embedding").cast("array<string>"), " "))
    head = v.agg(F.count("*").alias("n")).select(F.concat(txt("n"), F.lit(" 64")).alias("value"))
    path = write_lines(head.unionByName(v.select(line.alias("value"))), scratch(spark, "w2v"))
    return rd.read_word_vectors(spark, path).select(
        "feature", F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"),
        F.round(F.element_at("vector", -1).cast("double"), 5).alias("last"), F.size("vector").cast("long").alias("n"))


@query("metrics_summary", """
SELECT 'logit_kmers6_domains_len' || (user_id * 10) || '_overlap50_x.IDs.test.succ2.eval.metrics' AS name,
       'kmers6+domains' AS features, 'logit' AS classifier, (user_id * 10)::VARCHAR AS length, '50' AS overlap, 'succ2' AS variant, '20' AS pos,
       count(*) || chr(9) || '0.5' AS metrics FROM events GROUP BY user_id""")
def metrics_summary(spark, sf):
    root = scratch(spark, "metrics-pos20")
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("logit_kmers6_domains_len"), (F.col("user_id") * 10).cast("string"),
                 F.lit("_overlap50_x.IDs.test.succ2.eval.metrics")).alias("run"),
        F.concat(F.lit("Metrics\n\tP\npos\t"), txt("n"), F.lit("\t0.5")).alias("value"))
    # A file for each run costs its opening, whatever its size: the runs go to all cores, and tasks put their own files in place.
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows.repartition(tasks, "run").write.mode("overwrite").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("run").text(root)
    return rd.summarize_metrics(spark, root)


@query("gzip_text", f"WITH {SEQS} SELECT doc_id::VARCHAR AS seq_id, length(seq) AS n FROM seqs")
def gzip_text(spark, sf):
    path = scratch(spark, "packed")
    sequences(spark, sf).select(F.concat(F.lit(">"), txt("doc_id"), F.lit("\n"), F.col("seq")).alias("value")).write.mode(
        "overwrite").option("compression", "gzip").text(path)
    return rd.read_fasta(spark, path, "gz").select("seq_id", F.length("seq").alias("n"))


@query("feature_list_file", f"WITH {WORDS} SELECT DISTINCT feature FROM words WHERE feature <> ''")
def feature_list_file(spark, sf):
    from clusterloom.bindings.features import word_tokens

    path = scratch(spark, "words.feat")
    wr.write_tsv(word_tokens(spark, sf).select("feature").distinct().orderBy("feature"), path, header=False)
    return rd.read_dictionary(spark, path)


# Sequences in pieces of 600 characters, as records that span splits are read.
PIECES = f"""{SEQS}, pieces AS (
  SELECT doc_id, seq, unnest(range((length(seq) + 599) // 600)) AS piece FROM seqs WHERE length(seq) > 0)"""


@query("fasta_pieces", f"""
WITH {PIECES} SELECT doc_id::VARCHAR AS seq_id, piece, md5(substr(seq, piece * 600 + 1, 600)) AS digest FROM pieces""")
def fasta_pieces(spark, sf):
    path = scratch(spark, "long.fasta")
    wrapped = F.regexp_replace("seq", "(.{70})", "$1\n")
    wr.write_fasta(sequences(spark, sf), F.concat(txt("doc_id"), F.lit(" "), F.col("lang")), wrapped, path)
    return rc.read_pieces(spark, path, None, "fasta", 600).select("seq_id", "piece", md5("text").alias("digest"))


@query("genbank_pieces", f"""
WITH {PIECES}
SELECT 'V' || doc_id || '.1' AS seq_id, piece,
       md5(translate(substr(seq, piece * 600 + 1, 600), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')) AS digest FROM pieces""")
def genbank_pieces(spark, sf):
    return rc.read_pieces(spark, genbank_path(spark, sf), None, "genbank", 600).select("seq_id", "piece", md5("text").alias("digest"))
