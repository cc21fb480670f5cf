"""Alignment filters and equi-joins between genes, annotations and mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clusterloom.functions.scalar import annotation_colour
from clusterloom.operators.pieces import PIECE, joined_pieces


def significant_subjects(hits: DataFrame, max_evalue: float = 1e-5, min_qcovs: float = 50.0) -> DataFrame:
    """Distinct subjects per query with a significant, covering alignment: ``qseqid, sseqid, qcovs``."""
    return (
        hits.filter((F.col("evalue") < max_evalue) & (F.col("qcovs") > min_qcovs))
        .groupBy("qseqid", "sseqid")
        .agg(F.max("qcovs").alias("qcovs"))
    )


def order_by_coverage(subjects: DataFrame) -> DataFrame:
    return subjects.orderBy("qseqid", F.desc("qcovs"), "sseqid")


def alignment_table(hits: DataFrame, max_evalue: float = 0.01) -> DataFrame:
    """Alignments below ``max_evalue``: subject up, bit score and identity down, query up."""
    return hits.filter(F.col("evalue") < max_evalue).orderBy(
        "sseqid", F.desc("bitscore"), F.desc("pident"), "qseqid")


def ontology_terms(subjects: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct ontology ids per query: ``qseqid, goid``.

    ``mapping`` rows are ``entry, goids`` with a ``;`` list, joined on equality of the entry.
    """
    terms = mapping.select("entry", F.explode(F.split("goids", ";")).alias("_t")).select(
        "entry", F.replace("_t", F.lit(" "), F.lit("")).alias("goid"))
    return (
        subjects.select("qseqid", F.col("sseqid").alias("entry"))
        .join(terms.filter(F.col("goid") != "").distinct(), "entry")
        .select("qseqid", "goid")
        .distinct()
    )


def orthogroup_sequences(groups: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sequences of more than one character that belong to any group, once: ``seq_id, seq``."""
    members = groups.select(F.explode("members").alias("seq_id")).select(F.trim("seq_id").alias("seq_id"))
    return sequences.filter(F.length("seq") > 1).join(members.distinct(), "seq_id", "left_semi")


def without_ids(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """Sequences whose id is not listed."""
    return sequences.join(ids.select("seq_id"), "seq_id", "left_anti")


def not_yet_written(inputs: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(written.select(key), key, "left_anti")


def _cluster_of(seq_id: str) -> Column:
    """Cluster id of a header: up to ``|``, before ``.``."""
    return F.split_part(F.split_part(seq_id, F.lit("|"), F.lit(1)), F.lit("."), F.lit(1))


def cluster_pieces(sequences: DataFrame, pos: str = "pos", piece: int = PIECE) -> DataFrame:
    """Sequences concatenated per cluster, of any length: ``cluster_id, piece, offset, text``.

    ``pos`` is LONG and unique within a cluster; ids are not null.
    """
    rows = sequences.select(_cluster_of("seq_id").alias("cluster_id"), pos, "seq")
    return joined_pieces(rows, ["cluster_id"], pos, "seq", piece)


def concat_by_cluster(sequences: DataFrame, pos: str = "pos") -> DataFrame:
    """Sequences concatenated per cluster as one value each; ``cluster_pieces`` has no such limit."""
    return sequences.groupBy(_cluster_of("seq_id").alias("cluster_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "seq"))),
                                 lambda e: e["seq"]), "").alias("seq"))


def gene_features(genes: DataFrame, mrna: DataFrame) -> DataFrame:
    """Cluster genes with their mRNA feature; ``found`` tells the unmatched.

    ``genes`` rows are ``cluster_id, pos, gene``; ``mrna`` rows carry ``name, seqid, start, end,
    strand, phase``, one per name.
    """
    name = F.regexp_replace("gene", r"\.1$", "")
    return genes.withColumn("name", name).join(
        mrna.withColumn("found", F.lit(True)), "name", "left"
    ).withColumn("found", F.coalesce("found", F.lit(False)))


def unmatched_genes(located: DataFrame) -> DataFrame:
    return located.filter(~F.col("found")).select("gene").distinct()


def cluster_extent(located: DataFrame) -> DataFrame:
    """Start of the first gene, end of the last, strand and phase of the first."""
    first = lambda c: F.min_by(c, "pos").alias(c)
    return located.groupBy("cluster_id").agg(
        first("seqid"), first("start"), F.max_by("end", "pos").alias("end"),
        first("strand"), first("phase"))


def coloured_genes(located: DataFrame, annotation: DataFrame, gold: DataFrame) -> DataFrame:
    """Add the display colour: by the gene's annotation type, else the gold colour."""
    kinds = annotation.groupBy("gene").agg(F.min("type").alias("_kind"))
    members = gold.select("gene").distinct().withColumn("_gold", F.lit(True))
    return (
        located.join(kinds, "gene", "left")
        .join(members, "gene", "left")
        .withColumn("colour", annotation_colour(F.col("_kind"), F.coalesce("_gold", F.lit(False))))
        .drop("_kind", "_gold")
    )


def reduced_similarity(hits: DataFrame) -> DataFrame:
    """``id = a|b, pident, bitscore, qcovs`` sorted by id."""
    return hits.select(
        F.concat_ws("|", "qseqid", "sseqid").alias("id"), "pident", "bitscore", "qcovs"
    ).orderBy("id", "pident", "bitscore", "qcovs")


def max_similarity(pairs: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Highest identity per ordered pair: ``within…, a, b, pident``.

    ``within`` names the block that ``a`` and ``b`` are numbered in. Pairs that already lie together by
    block are not shuffled again.
    """
    return pairs.groupBy(*within, "a", "b").agg(F.max("pident").alias("pident"))


def vote_by_similar(
    undecided: DataFrame, pairs: DataFrame, positives: DataFrame, top: int = 10,
    step: float = 0.1, threshold: float = 0.5, within: Sequence[str] = (),
) -> DataFrame:
    """Genes without domains follow their most similar genes: ``gene, score, positive``.

    Each of the ``top`` partners that was kept adds ``step``. ``within`` names the block of ``pairs`` in which
    they were made: the best ``top`` of a gene in each block are taken there, as no other can be among its best, and
    only those are shuffled.
    """
    # Both directions come from one pass, so the pairs are made once.
    back = F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = pairs.select(*within, "pident", F.explode(F.array(F.struct("a", "b"), back)).alias("_p")).filter(
        "_p IS NOT NULL").select(*within, "_p.a", "_p.b", "pident")
    if within:
        nearest = W.partitionBy(*within, "a").orderBy(F.desc("pident"), "b")
        both = max_similarity(both, within).withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= top)
    order = W.partitionBy("a").orderBy(F.desc("pident"), "b")
    partners = (
        both.join(undecided.select(F.col("gene").alias("a")).distinct(), "a", "left_semi")
        .groupBy("a", "b").agg(F.max("pident").alias("pident"))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= top)
    )
    kept = positives.select(F.col("gene").alias("b")).distinct().withColumn("_kept", F.lit(1))
    votes = partners.join(kept, "b", "left").groupBy(F.col("a").alias("gene")).agg(
        (F.count("_kept") * step).alias("score"))
    return undecided.select("gene").distinct().join(votes, "gene", "left").select(
        "gene", F.coalesce("score", F.lit(0.0)).alias("score"),
        (F.coalesce("score", F.lit(0.0)) >= threshold - 1e-9).alias("positive"))
