"""Post-processing of ordered, scored clusters.

Clusters are rows ``parts…, pos, genes ARRAY<STRING>, score`` with a dense ``pos`` per part.
Gene-level operators work on rows ``cluster…, idx, gene`` with a dense ``idx`` per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.ordered import (
    greedy_starts, group_starts, index_rows, islands, neighbour_frame, scan,
)
from clusterloom.operators.pieces import PIECE, joined_pieces
from clusterloom.session import cut_lineage


def order_predictions(df: DataFrame, parts: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Sort predictions and fix their order as ``pos``."""
    return index_rows(df, parts, order, "pos")


def successive_leaders(
    df: DataFrame, parts: Sequence[str], n: int, threshold: float = 0.5
) -> DataFrame:
    """Positions of the positives that absorb their next ``n`` items: ``parts…, pos``.

    A positive leads when at least ``n`` items follow it; absorbed items never lead.
    """
    rows = scan(df.select(*parts, "pos", "score"), parts, "pos", totals={"_n": F.lit(1)})
    leads = (F.col("score") >= threshold) & (F.col("pos") < F.col("_n") - n)
    return greedy_starts(rows, parts, "pos", F.col("pos"), n + 1, eligible=leads)


def _joined_genes(entries: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.array_sort(entries), lambda e: e["genes"])))


def _merge_groups(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Fold rows sharing ``_lead``; a lone row keeps its genes as they are."""
    entries = F.collect_list(F.struct("pos", "genes"))
    return (
        df.groupBy(*parts, F.col("_lead").alias("pos"))
        .agg(entries.alias("_e"), F.min_by("score", "pos").alias("score"))
        .select(*parts, "pos",
                F.when(F.size("_e") == 1, F.get("_e", F.lit(0))["genes"])
                .otherwise(_joined_genes(F.col("_e"))).alias("genes"), "score")
    )


def successive_merge(
    df: DataFrame, parts: Sequence[str], n: int, threshold: float = 0.5
) -> DataFrame:
    """Each leader absorbs its next ``n`` items, genes de-duplicated, and keeps its score."""
    starts = successive_leaders(df, parts, n, threshold)
    members = starts.select(
        *parts, F.col("pos").alias("_lead"),
        F.explode(F.sequence(F.col("pos"), F.col("pos") + n)).alias("pos"),
    )
    tagged = df.join(members, [*parts, "pos"], "left").withColumn(
        "_lead", F.coalesce("_lead", "pos")
    )
    return _merge_groups(tagged, parts)


def successive_relabel(
    df: DataFrame, parts: Sequence[str], n: int, threshold: float = 0.5
) -> DataFrame:
    """Followers below the threshold take their leader's score and lose its genes."""
    starts = successive_leaders(df, parts, n, threshold)
    lead = df.join(starts, [*parts, "pos"]).select(
        *parts, F.col("score").alias("_score"), F.col("genes").alias("_genes"),
        F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + n)).alias("pos"),
    )
    change = F.col("_score").isNotNull() & (F.col("score") < threshold)
    fresh = F.filter("genes", lambda g: ~F.array_contains(F.col("_genes"), g))
    return df.join(lead, [*parts, "pos"], "left").select(
        *parts, "pos", F.when(change, fresh).otherwise(F.col("genes")).alias("genes"),
        F.when(change, F.col("_score")).otherwise(F.col("score")).alias("score"),
    )


def carry_forward_merge(
    df: DataFrame, parts: Sequence[str], n: int, threshold: float = 0.5, merge: bool = True
) -> DataFrame:
    """Up to ``n`` negatives after a positive join it (or take its score)."""
    positive = F.col("score") >= threshold
    seen = scan(df, parts, "pos", lasts={
        "_from": F.when(positive, F.struct(F.col("pos").alias("pos"), F.col("score").alias("score")))})
    follows = ~positive & F.col("_from").isNotNull() & (F.col("pos") - F.col("_from.pos") <= n)
    if not merge:
        return seen.select(
            *parts, "pos", "genes",
            F.when(follows, F.col("_from.score")).otherwise(F.col("score")).alias("score"))
    lead = F.when(follows, F.col("_from.pos")).otherwise(F.col("pos"))
    return _merge_groups(seen.withColumn("_lead", lead).drop("_from"), parts)


def majority_vote(df: DataFrame, parts: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Share of positive clusters per gene, placed at the gene's first appearance.

    ``gene, share, parts…, first_pos, first_idx``.
    """
    label = F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)
    genes = df.select(*parts, "pos", label.alias("_label"), F.posexplode("genes").alias("_i", "gene"))
    place = F.struct(*parts, F.col("pos").alias("first_pos"), F.col("_i").alias("first_idx"))
    return (
        genes.filter(F.col("gene") != "")
        .groupBy("gene")
        .agg(F.avg("_label").alias("share"), F.min(place).alias("_first"))
        .select("gene", "share", "_first.*")
    )


def with_gene_length(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """Left join of ``gene, length``; a gene without a length counts 0."""
    one = lengths.groupBy("gene").agg(F.max("length").alias("length"))
    return df.join(one, "gene", "left").withColumn(
        "length", F.coalesce(F.col("length").cast("long"), F.lit(0).cast("long"))
    )


def majority_regroup(
    votes: DataFrame, parts: Sequence[str], lengths: DataFrame, share: float = 0.5,
    max_length: int = 10000,
) -> DataFrame:
    """Regroup genes by majority: rows ``parts…, group, gpos, gene, score``.

    Consecutive positive genes form one group (score 1). Negative genes are cut into groups
    that close once their total length reaches ``max_length``. Genes stay rows: a group may
    be arbitrarily long.
    """
    placed = index_rows(with_gene_length(votes, lengths), parts, ["first_pos", "first_idx"], "gpos")
    positive = F.col("share") >= share
    seen = scan(placed, parts, "gpos", prevs={"_before": positive}, sums={"_upto": F.col("length")})
    change = F.col("_before").isNull() | (F.col("_before") != positive)
    starts = greedy_starts(
        seen, parts, "gpos", F.col("_upto") - F.col("length"), max_length,
        eligible=~positive, forced=change)
    return group_starts(placed, parts, "gpos", starts, "group").select(
        *parts, "group", "gpos", "gene", F.when(positive, 1.0).otherwise(0.0).alias("score"))


def fold_groups(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Group rows back into scored clusters with gene lists."""
    return rows.groupBy(*parts, F.col("group").alias("pos")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("gpos", "gene"))),
                    lambda e: e["gene"]).alias("genes"),
        F.max("score").alias("score"),
    )


# ------------------------------------------------------------------ rule filter and split


def split_runs(genes: DataFrame, cluster: Sequence[str], min_run: int = 3) -> DataFrame:
    """Runs of at least ``min_run`` flagged genes that an unflagged gene follows.

    Adds ``in_split`` and ``run_start`` to rows ``cluster…, idx, flag``.
    """
    seen = islands(genes, cluster, "idx", F.col("flag"), totals={"_n": F.lit(1)})
    run = F.col("island_end") - F.col("island_start") + 1
    inside = F.col("flag") & (run >= min_run) & (F.col("island_end") < F.col("_n") - 1)
    return seen.withColumn("in_split", inside).withColumn(
        "run_start", F.when(inside, F.col("island_start"))
    ).drop("island_start", "island_end", "_n")


def filter_and_split(
    genes: DataFrame, cluster: Sequence[str], *, do_filter: bool = True, do_split: bool = True,
    min_run: int = 3, min_fragment: int = 5,
) -> DataFrame:
    """Drop flagged genes and cut clusters at split runs: ``cluster…, fragment, idx, gene``.

    ``genes`` are the flagged genes of positive clusters (``cluster…, idx, gene, flag``). A
    fragment shorter than ``min_fragment`` joins the next one; a short last one is dropped.
    """
    rows = cut_lineage(split_runs(genes, cluster, min_run))
    cut = F.col("in_split") if do_split else F.lit(False)
    gone = cut | (F.col("flag") if do_filter else F.lit(False))
    rows = rows.select(
        *cluster, "idx", "gene", F.when(gone, 0).otherwise(1).alias("_kept"),
        ((F.col("idx") == 0) | (cut & (F.col("run_start") == F.col("idx")))).alias("_edge"))
    # Every scan reads its input twice: fix the narrow rows before the greedy pass.
    rows = cut_lineage(
        scan(rows, cluster, "idx", sums={"_upto": F.col("_kept")}, totals={"_all": F.col("_kept")})
        .withColumn("_x", F.col("_upto") - F.col("_kept"))
        .drop("_upto")
    )
    starts = greedy_starts(rows, cluster, "idx", F.col("_x"), min_fragment, eligible=F.col("_edge"))
    opened = cut_lineage(rows.join(starts, [*cluster, "idx"]).select(*cluster, "idx", "_x", "_all"))
    # A fragment reaches to the next start, the last one to the end of the cluster.
    closed = scan(opened, cluster, "idx", nexts={"_nx": F.col("_x")}).select(
        *cluster, "idx",
        F.struct(
            F.col("idx").alias("fragment"),
            (F.coalesce("_nx", "_all") - F.col("_x") >= min_fragment).alias("long_enough"),
        ).alias("_mark"))
    marked = rows.drop("_x", "_all", "_edge").join(cut_lineage(closed), [*cluster, "idx"], "left")
    return (
        scan(marked, cluster, "idx", lasts={"_in": F.col("_mark")})
        .filter((F.col("_kept") == 1) & F.col("_in.long_enough"))
        .select(*cluster, F.col("_in.fragment").alias("fragment"), "idx", "gene")
    )


def flagged_genes(gene_domains: DataFrame, rules: DataFrame) -> DataFrame:
    """Genes that carry any rule-list domain: distinct ``gene``.

    ``gene_domains`` has the domain text per gene, split on line breaks and dots.
    """
    parts = gene_domains.select("gene", F.explode(F.split("content", "[\n.]")).alias("domain"))
    return parts.join(rules.select("domain"), "domain", "left_semi").select("gene").distinct()


def flag_genes(genes: DataFrame, flagged: DataFrame) -> DataFrame:
    marks = flagged.select("gene", F.lit(True).alias("flag"))
    return genes.join(marks, "gene", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


# ------------------------------------------------------------------ weight adjustments


def dry_islands(
    decisions: DataFrame, cluster: Sequence[str], min_run: int = 3
) -> DataFrame:
    """Runs of ``min_run`` zero-weight genes turn keep into skip; undecided genes stay.

    Rows ``cluster…, idx, gene, weight, action``.
    """
    seen = islands(decisions, cluster, "idx", F.col("weight") == 0)
    dry = (F.col("weight") == 0) & (
        F.col("island_end") - F.col("island_start") + 1 >= min_run)
    return seen.withColumn(
        "action", F.when(dry & (F.col("action") == "keep"), "skip").otherwise(F.col("action"))
    ).drop("island_start", "island_end")


def neighbour_weights(
    decisions: DataFrame, cluster: Sequence[str], width: int = 1
) -> DataFrame:
    """Genes next to an annotated gene (weight sum above 1 on a side) turn skip into keep."""
    seen = neighbour_frame(decisions, cluster, "idx", width,
                           before={"_b": F.col("weight")}, after={"_a": F.col("weight")})
    near = (F.col("_b") > 1) | (F.col("_a") > 1)
    return seen.withColumn(
        "action", F.when(near & (F.col("action") == "skip"), "keep").otherwise(F.col("action"))
    ).withColumn(
        "weight", F.when(near, F.greatest("weight", F.lit(1.0))).otherwise(F.col("weight"))
    ).drop("_b", "_a")


def consecutive_pieces(
    df: DataFrame, parts: Sequence[str], pos: str, id_col: str, text_col: str, piece: int = PIECE
) -> tuple[DataFrame, DataFrame]:
    """Consecutive rows with the same id, of any length, as runs and as their joined texts.

    Returns ``parts…, start, id, n`` and ``parts…, start, piece, offset, text``; ``pos`` is dense.
    """
    # Runs are found on narrow rows: a chunk of them is one task, whose texts would make it long.
    placed = cut_lineage(islands(df.select(*parts, pos, id_col), parts, pos, F.col(id_col)).select(
        *parts, pos, id_col, F.col("island_start").alias("start")))
    runs = placed.groupBy(*parts, "start").agg(F.min(id_col).alias(id_col), F.count("*").alias("n"))
    rows = placed.drop(id_col).join(df.select(*parts, pos, text_col), [*parts, pos])
    return runs, joined_pieces(rows, [*parts, "start"], pos, text_col, piece)


def group_consecutive(
    df: DataFrame, parts: Sequence[str], pos: str, id_col: str, text_col: str
) -> DataFrame:
    """Texts of consecutive rows with the same id as one value: ``parts…, start, id, text``.

    ``consecutive_pieces`` is for runs of any length.
    """
    runs = islands(df, parts, pos, F.col(id_col))
    return runs.groupBy(*parts, F.col("island_start").alias("start"), id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text_col))),
                                 lambda e: e[text_col]), "").alias(text_col),
        F.count("*").alias("n"))
