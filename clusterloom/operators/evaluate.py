"""Evaluation of ordered predictions against gold clusters.

Predictions are rows ``pos, genes ARRAY<STRING>, score`` with a unique global ``pos``; gold is
``cluster_id, gene`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clusterloom.functions.scalar import cluster_display_id
from clusterloom.operators.ordered import index_rows, islands
from clusterloom.session import cut_lineage, hold

NOT_FOUND = "not found"


def fold_clusters(rows: DataFrame, cluster: str = "cluster_id", gene: str = "gene") -> DataFrame:
    """Gene list per cluster, sorted and distinct: ``cluster, genes``."""
    return rows.groupBy(cluster).agg(F.array_sort(F.collect_set(gene)).alias("genes"))


def fold_scores(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predicted clusters of a score table from ``threshold`` on, folded to gene lists."""
    rows = scores.filter(F.col("cluster_score") >= threshold).select(
        F.col("predicted_cluster_id").alias("cluster_id"), F.explode("genes").alias("gene"))
    return fold_clusters(rows.filter(F.col("gene") != ""))


def positive_clusters(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    return predictions.filter(F.col("score") >= threshold)


def positive_genes(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Distinct genes of positive predictions."""
    genes = positive_clusters(predictions, threshold).select(F.explode("genes").alias("gene"))
    return genes.filter(F.col("gene") != "").distinct()


def match_gold(gold: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every gold gene with its first prediction and its flag.

    ``cluster_id, gene, label, predicted_cluster, first_pos``. Predictions are aggregated to one
    row per gene before the join, so a gene found in many predictions joins once.
    """
    exploded = predictions.select(
        "pos", "score", cluster_display_id(F.col("genes")).alias("_name"),
        F.explode("genes").alias("gene"))
    per_gene = exploded.groupBy("gene").agg(
        F.min("pos").alias("first_pos"), F.min_by("_name", "pos").alias("_name"),
        F.max((F.col("score") >= threshold).cast("int")).alias("_hit"))
    # Distinct where the join needs the rows, so that they are shuffled once.
    return (
        gold.select("cluster_id", "gene").repartition("gene").distinct()
        .join(per_gene, "gene", "left")
        .select("cluster_id", "gene", F.coalesce("_hit", F.lit(0)).alias("label"),
                F.coalesce("_name", F.lit(NOT_FOUND)).alias("predicted_cluster"), "first_pos")
    )


def longest_runs(matched: DataFrame) -> DataFrame:
    """Longest run of consecutive positive gold genes in one prediction: ``cluster_id, run, n_genes``."""
    hits = index_rows(
        matched.filter("label = 1").select("cluster_id", "gene", "first_pos"), ["cluster_id"], ["gene"])
    runs = islands(hits, ["cluster_id"], "pos", F.col("first_pos"))
    best = runs.groupBy("cluster_id").agg(
        F.max(F.col("island_end") - F.col("island_start") + 1).alias("run"))
    sizes = matched.groupBy("cluster_id").agg(F.count("*").alias("n_genes"))
    return sizes.join(best, "cluster_id", "left").withColumn("run", F.coalesce("run", F.lit(0)))


def matched_clusters(matched: DataFrame) -> DataFrame:
    """Prediction that best represents each gold cluster: ``cluster_id, predicted_cluster, match_pos``.

    The most frequent positive match (smallest id on ties); without one, the first match of
    the last gold gene.
    """
    counts = matched.filter("label = 1").groupBy("cluster_id", "predicted_cluster").agg(
        F.count("*").alias("_n"), F.min("first_pos").alias("_pos"))
    best = counts.groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("predicted_cluster").alias("name"),
                       F.col("_pos").alias("pos"))).alias("_best"))
    last = matched.groupBy("cluster_id").agg(
        F.max_by(F.struct(F.col("predicted_cluster").alias("name"), F.col("first_pos").alias("pos")),
                 "gene").alias("_last"))
    return last.join(best, "cluster_id", "left").select(
        "cluster_id",
        F.coalesce(F.col("_best.name"), F.col("_last.name")).alias("predicted_cluster"),
        F.coalesce(F.col("_best.pos"), F.col("_last.pos")).alias("match_pos"))


def similarity_credit(
    matched: DataFrame, represented: DataFrame, predictions: DataFrame,
    pairs: DataFrame | Callable[[DataFrame], DataFrame], threshold: float = 0.5,
) -> DataFrame:
    """Credit of similar genes per gold cluster: ``cluster_id, credit``.

    Unfound gold genes take their most similar unfound gene of the representing positive
    prediction; each predicted gene counts once with its highest identity / 100.
    ``pairs`` rows are ``a, b, pident`` with one row per pair, or a function that makes them for
    the values of ``b`` it is given, rows ``b``. Representing predictions are few beside all genes,
    so pairs are cut down to their genes before they meet the gold genes.
    """
    found = matched.filter("label = 1").select("gene")
    listed = hold(
        positive_clusters(predictions, threshold).select(F.col("pos").alias("match_pos"), "genes")
        .join(hold(represented.select("cluster_id", "match_pos")), "match_pos")
        .select("cluster_id", F.posexplode("genes").alias("_i", "b")))
    partners = hold(without_found(listed, "b", found))
    wanted = hold(partners.select("b").distinct())
    near = pairs(wanted) if callable(pairs) else pairs.select("a", "b", "pident").join(wanted, "b", "left_semi")
    candidates = hold(
        near.filter(F.col("pident") > 0).join(partners, "b")
        .select("cluster_id", F.col("a").alias("gene"), "b", "_i", "pident"))
    scored = hold(matched.select("cluster_id", "gene").join(candidates, ["cluster_id", "gene"]))
    best = without_found(scored, "gene", found).groupBy("cluster_id", "gene").agg(
        F.max(F.struct("pident", (-F.col("_i")).alias("order"), "b")).alias("_best"))
    used = best.groupBy("cluster_id", F.col("_best.b").alias("b")).agg(
        F.max("_best.pident").alias("pident"))
    return used.groupBy("cluster_id").agg((F.sum("pident") / 100).alias("credit"))


def without_found(rows: DataFrame, gene: str, found: DataFrame) -> DataFrame:
    """``rows`` whose ``gene`` is not among the genes ``found``, which are cut down to those of
    ``rows`` first."""
    asked = hold(rows.select(F.col(gene).alias("gene")).distinct())
    there = hold(found.join(asked, "gene").select(F.col("gene").alias(gene)).distinct())
    return rows.join(there, gene, "left_anti")


def cluster_scores(matched: DataFrame, credit: DataFrame | None = None) -> DataFrame:
    """Score per gold cluster: longest run (plus credit) over its number of genes."""
    runs = longest_runs(matched)
    if credit is not None:
        runs = runs.join(credit, "cluster_id", "left")
    else:
        runs = runs.withColumn("credit", F.lit(0.0))
    return runs.select(
        "cluster_id", "run", "n_genes",
        ((F.col("run") + F.coalesce("credit", F.lit(0.0))) / F.col("n_genes")).alias("cluster_score"))


def ranked_scores(scores: DataFrame, represented: DataFrame, predictions: DataFrame) -> DataFrame:
    """Score report with the matched prediction's genes, best first."""
    genes = predictions.select(F.col("pos").alias("match_pos"), "genes")
    return (
        scores.join(represented, "cluster_id").join(genes, "match_pos", "left")
        .select(F.col("cluster_id").alias("gold_cluster_id"),
                F.col("predicted_cluster").alias("predicted_cluster_id"), "cluster_score", "genes")
        .orderBy(F.desc("cluster_score"), "gold_cluster_id")
    )


def prf(matches: Column, n_predicted: Column, n_gold: Column) -> dict[str, Column]:
    """Precision, recall and F, capped at 1 and rounded to 3; all null when undefined."""
    p = F.least(F.lit(1.0), F.try_divide(matches.cast("double"), n_predicted.cast("double")))
    r = F.least(F.lit(1.0), F.try_divide(matches.cast("double"), n_gold.cast("double")))
    ok = (n_predicted > 0) & (n_gold > 0) & (p + r > 0)
    f = 2 * F.try_divide(p * r, p + r)
    return {name: F.when(ok, F.round(c, 3)) for name, c in
            (("precision", p), ("recall", r), ("f_measure", F.least(F.lit(1.0), f)))}


def gold_metrics(
    gold: DataFrame, matched: DataFrame, predictions: DataFrame, credit: DataFrame | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Gene and cluster level metrics, one row each: ``level, matches, predicted, gold, P, R, F``."""
    one = lambda df, expr, name: df.agg(expr.alias(name)).scalar()
    extra = F.lit(0.0) if credit is None else F.coalesce(
        one(credit, F.sum("credit"), "c"), F.lit(0.0))
    gene_row = gold.agg(F.count("*").alias("gold")).select(
        F.lit("genes").alias("level"),
        (one(matched, F.count_if(F.col("label") == 1), "m") + extra).cast("double").alias("matches"),
        one(positive_genes(predictions, threshold), F.count("*"), "p").alias("predicted"), "gold")
    cluster_row = gold.agg(F.countDistinct("cluster_id").alias("gold")).select(
        F.lit("clusters").alias("level"),
        one(matched.filter("label = 1").select("cluster_id").distinct(), F.count("*"), "m")
        .cast("double").alias("matches"),
        one(positive_clusters(predictions, threshold), F.count("*"), "p").alias("predicted"), "gold")
    rows = gene_row.unionByName(cluster_row)
    m = prf(F.col("matches"), F.col("predicted"), F.col("gold"))
    return rows.select("*", *(c.alias(n) for n, c in m.items()))


# ------------------------------------------------------------------ overestimation


def gold_regions(gold: DataFrame, max_span: int = 100) -> DataFrame:
    """Genes of every gold region: ``gene, cluster_id``.

    All ordinals between the least and the greatest gene number when the span is at most
    ``max_span``, else the members only. Numbers have five digits or more.
    """
    number = F.regexp_extract("gene", r"_(\d+)", 1).try_cast("long")
    bounds = gold.groupBy("cluster_id").agg(
        F.split_part(F.min("gene"), F.lit("_"), F.lit(1)).alias("_org"), F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    compact = F.coalesce(F.col("_hi") - F.col("_lo") + 1 <= max_span, F.lit(False))
    region = F.transform(
        F.sequence("_lo", "_hi"),
        lambda i: F.concat(F.col("_org"), F.lit("_"), F.format_string("%05d", i)))
    filled = bounds.filter(compact).select(F.explode(region).alias("gene"), "cluster_id")
    # Spread clusters keep their members, which stay rows.
    members = gold.select("gene", "cluster_id").join(
        bounds.filter(~compact).select("cluster_id"), "cluster_id", "left_semi").select("gene", "cluster_id")
    return filled.unionByName(members).distinct()


def top_gold_matches(predictions: DataFrame, regions: DataFrame, top: int = 2) -> DataFrame:
    """The ``top`` gold clusters with most region genes per prediction: ``pos, rank, cluster_id, n``."""
    genes = predictions.select("pos", F.explode(F.array_distinct("genes")).alias("gene"))
    counts = genes.join(regions, "gene").groupBy("pos", "cluster_id").agg(F.count("*").alias("n"))
    order = W.partitionBy("pos").orderBy(F.desc("n"), "cluster_id")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def best_original(
    processed: DataFrame, originals: DataFrame, successive: int = 0
) -> DataFrame:
    """Original cluster behind every processed one: ``pos, original_pos`` (null without overlap).

    An original that starts with the same gene wins (the earliest); only the others are
    compared by shared genes. With ``successive`` n > 0 only the first 1/n of a longer cluster
    is compared.
    """
    n = F.size("genes")
    take = n if successive <= 0 else F.when(n > successive, F.floor(n / successive).cast("int")).otherwise(n)
    target = processed.select("pos", F.slice("genes", 1, take).alias("_t"))
    first = lambda c: F.element_at(c, 1)
    starts = originals.groupBy(first("genes").alias("_g")).agg(F.min("pos").alias("original_pos"))
    by_start = hold(
        target.select("pos", "_t", first("_t").alias("_g")).join(starts, "_g", "left").drop("_g"))
    rest = by_start.filter("original_pos IS NULL").select(
        "pos", F.explode(F.array_distinct("_t")).alias("gene"))
    pool = originals.select(F.col("pos").alias("_o"), F.explode(F.array_distinct("genes")).alias("gene"))
    overlap = (
        rest.join(pool, "gene").groupBy("pos", "_o").agg(F.count("*").alias("_n"))
        .groupBy("pos")
        .agg(F.max(F.struct("_n", (-F.col("_o")).alias("back"))).alias("_best"))
        .select("pos", (-F.col("_best.back")).alias("_by_overlap"))
    )
    return by_start.join(overlap, "pos", "left").select(
        "pos", F.coalesce("original_pos", "_by_overlap").alias("original_pos"))


def overestimation(
    processed: DataFrame, originals: DataFrame, regions: DataFrame, successive: int = 0
) -> DataFrame:
    """Share of genes outside gold regions per processed cluster that touches one.

    ``pos, cluster, n_original, n_processed, over_original, over_merged, over_total``.
    """
    # Both inputs are used several times.
    processed, originals = cut_lineage(processed), cut_lineage(originals)
    genes_of = lambda df, pos: df.select(
        F.col("pos").alias(pos), F.explode(F.array_distinct("genes")).alias("gene")).filter("gene IS NOT NULL")
    inside = regions.select("gene").distinct()
    # Only clusters that touch a region are reported, so only they look for their original.
    touching = genes_of(processed, "pos").join(inside, "gene", "left_semi").select("pos").distinct()
    reached = cut_lineage(processed.join(touching, "pos", "left_semi"))
    origin = cut_lineage(best_original(reached, originals, successive))
    found = originals.join(origin.select(F.col("original_pos").alias("pos")).distinct(), "pos", "left_semi")
    rows = (
        genes_of(reached, "pos").join(origin, "pos")
        .join(genes_of(found, "original_pos").withColumn("orig", F.lit(True)), ["original_pos", "gene"], "left")
        .join(inside.withColumn("_gold", F.lit(True)), "gene", "left")
        .select("pos", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("orig", "_gold")))
    )
    flags = rows.groupBy("pos").agg(
        F.count_if("_gold").alias("_in"),
        F.count_if("orig").alias("_o"), F.count_if(~F.col("orig")).alias("_m"),
        F.count_if(F.col("orig") & ~F.col("_gold")).alias("_on"),
        F.count_if(~F.col("orig") & ~F.col("_gold")).alias("_mn"))
    sizes = originals.select(F.col("pos").alias("original_pos"), F.size("genes").alias("n_original"))
    counts = reached.select(
        "pos", cluster_display_id(F.col("genes")).alias("cluster"), F.size("genes").alias("n_processed"),
    ).join(flags, "pos").join(origin, "pos").join(sizes, "original_pos", "left").withColumn(
        "n_original", F.coalesce("n_original", F.lit(0)))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0))
    return counts.filter("_in > 0").select(
        "pos", "cluster", "n_original", "n_processed",
        share("_on", "_o").alias("over_original"), share("_mn", "_m").alias("over_merged"),
        ((F.col("_on") + F.col("_mn")) * 100.0 / F.col("n_processed")).alias("over_total"))


def overestimation_averages(report: DataFrame) -> DataFrame:
    return report.agg(*[F.avg(c).alias(c) for c in ("over_original", "over_merged", "over_total")])
