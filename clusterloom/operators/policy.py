"""Keep / skip policy: rewards, transitions, value iteration and its application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.ordered import scan
from clusterloom.session import cut_lineage


def reward_table(rewards: DataFrame, keep_threshold: float = 0.5) -> DataFrame:
    """Keep and skip reward per domain: ``domain, r_keep, r_skip``.

    ``rewards`` are rows ``domain, file, reward``. Keep wins when its mean exceeds the skip
    mean times ``keep_threshold``; the winner's mean is the reward, its negative the penalty.
    """
    sums = rewards.groupBy("domain").agg(
        F.sum(F.when(F.col("reward") > 0, F.col("reward")).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col("reward") < 0, F.col("reward")).otherwise(0)).alias("_neg"),
    )
    n = sums.agg(F.count("*").cast("double")).scalar()
    counted = sums.withColumn("_n", n).withColumns(
        {"_keep": F.col("_pos") / F.col("_n"), "_skip": F.abs(F.col("_neg") / F.col("_n"))}
    )
    wins = F.col("_keep") > F.col("_skip") * keep_threshold
    return counted.select(
        "domain",
        F.when(wins, F.col("_keep")).otherwise(-F.col("_skip")).alias("r_keep"),
        F.when(wins, -F.col("_keep")).otherwise(F.col("_skip")).alias("r_skip"),
    )


def transitions(states: DataFrame, parts: Sequence[str], pos: str = "pos") -> DataFrame:
    """Counts of ``state, next_state``; the last state of a sequence follows itself."""
    seen = scan(states.select(*parts, pos, "state"), parts, pos, nexts={"_next": F.col("state")})
    return (
        seen.groupBy("state", F.coalesce("_next", "state").alias("next_state"))
        .agg(F.count("*").alias("n"))
    )


def q_iteration(
    rewards: DataFrame, moves: DataFrame, *, alpha: float = 0.01, gamma: float = 0.01,
    iterations: int = 500, checkpoint_every: int = 10, tolerance: float | None = None,
) -> DataFrame:
    """Batch value iteration: ``state, r_keep, r_skip, q_keep, q_skip``.

    Every round sets Q to ``(1 - alpha) Q + alpha (r + gamma E[max Q(next)])`` over the
    observed transitions. Moves are aggregated once to one row per state pair, so a round
    costs the size of the transition table, not of the sequences. ``checkpoint_every`` rounds
    the lineage is cut.

    With ``tolerance`` the rounds stop once no value is further than that from the fixed point. A
    round shrinks that distance by ``c = 1 - alpha (1 - gamma)``, so it is at most ``c / (1 - c)``
    times the last round's largest change; should ``iterations`` rounds not get there, it is an
    error. ``alpha = 1`` takes the fewest rounds; the fixed point is the same for all.
    """
    if tolerance is not None and not (0 < alpha <= 1 and 0 <= gamma < 1):
        raise ValueError("a bounded distance needs 0 < alpha <= 1 and 0 <= gamma < 1")
    total = moves.groupBy("state").agg(F.sum("n").alias("_total"))
    share = moves.join(total, "state").select(
        "state", "next_state", (F.col("n") / F.col("_total")).alias("_p"))
    # Every state also points at itself without weight, which carries its own values along:
    # a round then reads Q once, so the plan grows by one join per round.
    own = rewards.select(F.col("domain").alias("state"), F.col("domain").alias("next_state"),
                         F.lit(None).cast("double").alias("_p"))
    edges = cut_lineage(share.unionByName(own))
    q = cut_lineage(rewards.select(
        F.col("domain").alias("state"), "r_keep", "r_skip",
        F.lit(0.0).alias("q_keep"), F.lit(0.0).alias("q_skip")))
    values = ("r_keep", "r_skip", "q_keep", "q_skip")
    for i in range(1, iterations + 1):
        carried = [F.max(F.when(F.col("_p").isNull(), F.col(c))).alias(c) for c in values]
        seen = (
            edges.join(q.withColumnRenamed("state", "next_state"), "next_state")
            .groupBy("state")
            .agg(F.sum(F.col("_p") * F.greatest("q_keep", "q_skip")).alias("_ahead"), *carried)
            .filter(F.col("r_keep").isNotNull())
        )

        def updated(action: str) -> Column:
            target = F.col(f"r_{action}") + gamma * F.col("_ahead")
            # A state never seen in a sequence is never updated.
            return F.when(
                F.col("_ahead").isNull(), F.col(f"q_{action}")
            ).otherwise((1 - alpha) * F.col(f"q_{action}") + alpha * target)

        due = i % checkpoint_every == 0 or i == iterations
        new = [updated("keep").alias("q_keep"), updated("skip").alias("q_skip")]
        if due and tolerance is not None:
            moved = F.greatest(*[F.abs(updated(a) - F.col(f"q_{a}")) for a in ("keep", "skip")])
            q = cut_lineage(seen.select("state", "r_keep", "r_skip", *new, moved.alias("_moved")))
            change = q.agg(F.max("_moved")).first()[0] or 0.0
            q = q.drop("_moved")
            shrink = 1 - alpha * (1 - gamma)
            if change * shrink / (1 - shrink) <= tolerance:
                return q
            continue
        q = seen.select("state", "r_keep", "r_skip", *new)
        if due:
            q = cut_lineage(q)
    if tolerance is not None:
        raise RuntimeError(f"{iterations} rounds leave values further than {tolerance} from the fixed point")
    return q


def greedy_action(keep: Column, skip: Column) -> Column:
    return F.when(keep >= skip, "keep").otherwise("skip")


def penalty_count(rewards: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Chosen rewards below the threshold: one row ``penalties``."""
    return rewards.agg(F.count_if(F.col("reward") < threshold).alias("penalties"))


def domain_choices(gene_domains: DataFrame, q: DataFrame) -> DataFrame:
    """Greedy action and its reward per (gene, domain): unseen domains keep with reward 0."""
    joined = gene_domains.join(q.withColumnRenamed("state", "domain"), "domain", "left")
    known = F.col("q_keep").isNotNull()
    action = F.when(known, greedy_action(F.col("q_keep"), F.col("q_skip"))).otherwise("keep")
    reward = F.when(action == "keep", F.col("r_keep")).otherwise(F.col("r_skip"))
    return joined.select(
        *gene_domains.columns, action.alias("action"), F.coalesce(reward, F.lit(0.0)).alias("reward"))


def gene_policy(gene_domains: DataFrame, q: DataFrame) -> DataFrame:
    """One row per gene with domains: ``gene, keep_reward, skip_reward, action, n_penalties``.

    The decision depends on the gene alone, so it is taken once per gene (sums only, combined
    before the shuffle) and joined to the clusters afterwards. ``gene_domains`` rows are
    ``gene, pos, domain``.
    """
    part = lambda action: F.sum(
        F.when(F.col("action") == action, F.col("reward")).otherwise(0.0)).alias(f"{action}_reward")
    return (
        domain_choices(gene_domains, q)
        .groupBy("gene")
        .agg(part("keep"), part("skip"), F.count_if(F.col("reward") < 0).alias("n_penalties"))
        # Sums arrive in any order: ties are decided on rounded values.
        .withColumn("action", greedy_action(F.round("keep_reward", 9), F.round("skip_reward", 9)))
    )


def domain_report(policy: DataFrame, gene_domains: DataFrame) -> DataFrame:
    """Gene, action and its domains as one text."""
    named = gene_domains.groupBy("gene").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "domain"))),
                                 lambda e: e["domain"]), ", ").alias("domains"))
    return policy.join(named, "gene")


def apply_policy(genes: DataFrame, policy: DataFrame, undecided: bool = False) -> DataFrame:
    """Action of every gene of every cluster.

    A gene without domains is skipped, or ``undecided`` when a later rule will settle it.
    """
    fallback = "undecided" if undecided else "skip"
    return genes.join(policy.select("gene", "action", "n_penalties"), "gene", "left").withColumns(
        {"action": F.coalesce("action", F.lit(fallback)),
         "n_penalties": F.coalesce("n_penalties", F.lit(0))})


def settle_undecided(decisions: DataFrame, cluster: Sequence[str], keep_percent: float = 50.0) -> DataFrame:
    """Undecided genes take keep when more than ``keep_percent`` of the cluster keeps.

    Counts are aggregated per cluster and joined back, so no window holds a cluster.
    """
    ratio = decisions.groupBy(*cluster).agg(
        (F.count_if(F.col("action") == "keep") * 100.0 / F.count("*")).alias("_keep"))
    settled = F.when(F.col("_keep") > keep_percent, "keep").otherwise("skip")
    return decisions.join(ratio, list(cluster)).withColumn(
        "action", F.when(F.col("action") == "undecided", settled).otherwise(F.col("action"))
    ).drop("_keep")


def rebuild_clusters(decisions: DataFrame, cluster: Sequence[str]) -> DataFrame:
    """Kept genes score 1, the others 0: ``cluster…, score, genes`` (sorted, distinct)."""
    kept = F.when(F.col("action") == "keep", 1.0).otherwise(0.0)
    return decisions.groupBy(*cluster, kept.alias("score")).agg(
        F.array_sort(F.collect_set("gene")).alias("genes"))


def gene_domain_lists(domains: DataFrame) -> DataFrame:
    """Gene to its domains in order: ``gene, domains``. Rows ``gene, pos, domain``."""
    return domains.groupBy("gene").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "domain"))),
                    lambda e: e["domain"]).alias("domains"))


def annotation_weights(domains: DataFrame, annotation: DataFrame) -> DataFrame:
    """Summed annotation weight per gene: ``gene, weight``. Annotation rows ``domain, type``."""
    from clusterloom.functions.scalar import annotation_weight

    return domains.join(annotation.select("domain", "type"), "domain", "left").groupBy("gene").agg(
        F.sum(annotation_weight(F.col("type"))).alias("weight"))
