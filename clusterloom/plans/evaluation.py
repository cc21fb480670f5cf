"""Post-processing stages and the evaluation against gold clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators import evaluate as ev
from clusterloom.operators import merge as mg
from clusterloom.operators import policy as pl
from clusterloom.operators.ordered import index_rows
from clusterloom.session import cut_lineage


def merge_stage(
    predictions: DataFrame, parts: Sequence[str], *, successive: int = 0, merge: bool = True,
    majority: bool = False, lengths: DataFrame | None = None, threshold: float = 0.5,
    share: float = 0.5, max_length: int = 10000,
) -> DataFrame:
    """Successive merge (or relabel), then majority regrouping: ``parts…, pos, genes, score``."""
    out = predictions
    if successive > 0:
        step = mg.successive_merge if merge else mg.successive_relabel
        out = step(out, parts, successive, threshold)
    if majority:
        if lengths is None:
            raise ValueError("majority regrouping needs gene lengths")
        votes = mg.majority_vote(out, parts, threshold)
        out = mg.fold_groups(mg.majority_regroup(votes, parts, lengths, share, max_length), parts)
    return out


def filter_stage(
    predictions: DataFrame, parts: Sequence[str], *, threshold: float = 0.5,
    flagged: DataFrame | None = None, do_filter: bool = True, do_split: bool = True,
    min_run: int = 3, min_fragment: int = 5, policy: DataFrame | None = None,
    weights: DataFrame | None = None, average_action: bool = False, dry: bool = False,
    neighbours: bool = False,
) -> DataFrame:
    """Rule filter and split, then the keep / skip policy: ``parts…, pos, fragment, genes, score``.

    ``flagged`` are rule-list genes, ``policy`` the output of ``gene_policy``, ``weights`` rows
    ``gene, weight`` for the island and neighbour rules. Negatives pass through.
    """
    cluster = [*parts, "pos"]
    negative = predictions.filter(F.col("score") < threshold).select(
        *cluster, F.lit(0).cast("long").alias("fragment"), "genes",
        (F.lit(0.0) if policy is not None else F.col("score")).alias("score"))
    positive = ev.positive_clusters(predictions, threshold)
    genes = positive.select(*cluster, F.posexplode("genes").alias("idx", "gene")).withColumn(
        "idx", F.col("idx").cast("long"))
    if flagged is not None:
        rows = mg.filter_and_split(
            mg.flag_genes(genes, flagged), cluster, do_filter=do_filter, do_split=do_split,
            min_run=min_run, min_fragment=min_fragment)
    else:
        rows = genes.withColumn("fragment", F.lit(0).cast("long"))
    piece = [*cluster, "fragment"]
    if policy is None:
        folded = rows.groupBy(*piece).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "gene"))), lambda e: e["gene"]).alias("genes"))
        kept = folded.join(positive.select(*cluster, "score"), cluster)
        return kept.select(*piece, "genes", "score").unionByName(negative)
    dense = index_rows(rows.withColumnRenamed("idx", "_old"), piece, ["_old"], "idx").drop("_old")
    actions = pl.apply_policy(dense, policy, undecided=average_action or dry or neighbours)
    if average_action:
        actions = pl.settle_undecided(actions, piece)
    if dry or neighbours:
        if weights is None:
            raise ValueError("island and neighbour rules need gene weights")
        per_gene = weights.groupBy("gene").agg(F.sum("weight").alias("weight"))
        actions = actions.join(per_gene, "gene", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        if dry:
            actions = mg.dry_islands(actions, piece)
        if neighbours:
            actions = mg.neighbour_weights(actions, piece)
    return pl.rebuild_clusters(actions, piece).select(*piece, "genes", "score").unionByName(negative)


def evaluate(
    gold: DataFrame, original: DataFrame, processed: DataFrame, *, pairs: DataFrame | None = None,
    threshold: float = 0.5, successive: int = 0,
) -> dict[str, DataFrame]:
    """All evaluation tables of one run: matches, scores, metrics, overestimation and averages.

    ``original`` and ``processed`` are predictions with a global ``pos`` before and after the
    merge and filter stages.
    """
    # Predictions and matches feed every table below.
    original, processed = cut_lineage(original), cut_lineage(processed)
    matched = cut_lineage(ev.match_gold(gold, processed, threshold))
    represented = ev.matched_clusters(matched)
    credit = None
    if pairs is not None:
        credit = ev.similarity_credit(matched, represented, processed, pairs, threshold)
    report = ev.overestimation(
        ev.positive_clusters(processed, threshold).select("pos", "genes"),
        ev.positive_clusters(original, threshold).select("pos", "genes"),
        ev.gold_regions(gold), successive)
    return {
        "matches": matched,
        "scores": ev.ranked_scores(ev.cluster_scores(matched, credit), represented, processed),
        "metrics": ev.gold_metrics(gold, matched, processed, credit, threshold),
        "overestimation": report,
        "averages": ev.overestimation_averages(report),
    }
