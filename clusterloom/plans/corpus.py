"""Dataset builders: similarity, ontology terms, domains, GFF3 and policy training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions import scalar
from clusterloom.operators import evaluate as ev
from clusterloom.operators import features as ft
from clusterloom.operators import match as mt
from clusterloom.operators import policy as pl
from clusterloom.operators import similarity as sim
from clusterloom.operators.ordered import index_rows
from clusterloom.sources import readers as rd
from clusterloom.sources import writers as wr


def similarity_table(
    spark: SparkSession, fasta: str, out: str, k: int = 6, threshold: float = 0.5, ext: str | None = "fasta",
) -> None:
    """All-against-all seed similarity of a FASTA folder, as the reduced similarity table.

    Jaccard stands for identity (percent), shared seeds for the bit score. The copy groups are
    written beside it, so every id finds its representative.
    """
    seqs = rd.read_fasta(spark, fasta, ext)
    pairs = sim.seed_similarity(seqs, "seq_id", "seq", k, threshold)
    wr.write_tsv(
        pairs.select(F.concat_ws("|", "a", "b").alias("id"), (F.col("jaccard") * 100).alias("pident"),
                     F.col("shared").cast("double").alias("bitscore"), (F.col("qcov") * 100).alias("qcovs"))
        .orderBy("id"), f"{out}/similarity")
    wr.write_tsv(sim.copy_groups(seqs, "seq_id", "seq"), f"{out}/copies")


def ontology_dataset(hits: DataFrame, mapping: DataFrame, instances: DataFrame, out: str) -> DataFrame:
    """Ontology records per query; returns found and not-found counts."""
    terms = mt.ontology_terms(mt.significant_subjects(hits), mapping)
    lines = terms.select(F.col("qseqid").alias("instance_id"), F.col("goid").alias("pos"), F.col("goid").alias("line"))
    records = wr.annotation_records(lines, instances)
    wr.write_annotations(records, out)
    return wr.annotation_counts(records)


def domain_dataset(hits: DataFrame, instances: DataFrame, out: str) -> DataFrame:
    """Domain records per sequence; returns found and not-found counts."""
    records = wr.annotation_records(wr.domain_lines(hits), instances)
    wr.write_annotations(records, out)
    return wr.annotation_counts(records)


def clusters_to_gff(
    clusters: DataFrame, gff: DataFrame, out: str, source: str, gold: DataFrame | None = None,
    annotation: DataFrame | None = None,
) -> DataFrame:
    """Per-gene and per-cluster GFF3 of ``cluster_id, gene`` rows; returns the unmatched genes."""
    folded = ev.fold_clusters(clusters)
    genes = folded.select("cluster_id", F.posexplode("genes").alias("pos", "gene"))
    located = mt.gene_features(genes, rd.mrna_features(gff))
    found = located.filter("found")
    colour = None
    if gold is not None and annotation is not None:
        found, colour = mt.coloured_genes(found, annotation, gold), F.col("colour")
    wr.write_gff(wr.gff_lines(found, source, F.col("cluster_id"), F.col("name"), colour), f"{out}/pergene")
    extent = mt.cluster_extent(located).join(folded, "cluster_id")
    wr.write_gff(
        wr.gff_lines(extent, source, F.array_join("genes", "|"), F.col("cluster_id")), f"{out}/percluster")
    return mt.unmatched_genes(located)


def train_policy(
    contents: DataFrame, out: str, *, kind: str = "occ", keep_threshold: float = 0.5,
    alpha: float = 0.01, gamma: float = 0.01, iterations: int = 500, tolerance: float | None = None,
) -> DataFrame:
    """Rewards, transitions and value iteration over domain contents (one row per file).

    Writes the Q table and its statistics; returns the Q table. With ``tolerance`` the values are
    within that of the fixed point, however many of the ``iterations`` that takes.
    """
    tokens = contents.filter("feature_type = 'domains'").select(
        "file", F.posexplode(F.split("content", "\n")).alias("_p", "feature")).filter("feature <> ''")
    label = scalar.label_from_name(scalar.base_name(F.col("file")))
    rewards = ft.feature_rewards(tokens, label, kind).withColumnRenamed("feature", "domain")
    ordered = index_rows(tokens.withColumnRenamed("feature", "state"), ["file"], ["_p"])
    q = pl.q_iteration(
        pl.reward_table(rewards, keep_threshold), pl.transitions(ordered, ["file"]),
        alpha=alpha, gamma=gamma, iterations=iterations, tolerance=tolerance)
    wr.write_table(q, f"{out}/qtable")
    wr.write_tsv(q.select(F.col("state").alias("id"), F.col("r_keep").alias("rewardKeep"),
                          F.col("r_skip").alias("rewardSkip"), F.col("q_keep").alias("qvalueKeep"),
                          F.col("q_skip").alias("qvalueSkip")).orderBy("id"), f"{out}/stat")
    return contents.sparkSession.read.parquet(f"{out}/qtable")


def genbank_to_fasta(spark: SparkSession, path: str, out: str, ext: str | None = "gbk") -> DataFrame:
    """All proteins of a folder of GenBank files as one FASTA folder; ``file, header, body`` as read back.

    One job writes all files, each record where it is read; exact duplicates are written once.
    """
    proteins = rd.genbank_proteins(rd.read_genbank(spark, path, ext))
    wr.write_fasta(proteins, "header", "seq", out)
    return rd.read_headed_records(spark, out, None)
