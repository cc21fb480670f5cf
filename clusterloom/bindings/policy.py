"""Keep / skip policy queries: domains come from ``events``, clusters from suppliers' parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.bindings import query, table
from clusterloom.bindings.ordering import GENES, SUPP, USER, supplier_genes
from clusterloom.operators import features as ft
from clusterloom.operators import policy as pl
from clusterloom.operators.ordered import index_rows
from clusterloom.session import cut_lineage



def domain():
    return F.concat(F.col("event_type"), F.lit("_"), (F.floor("value") % 20).cast("string"))


DOMAIN = "event_type || '_' || (floor(value)::BIGINT % 20)"
GAMMA = 0.5
#: Values are the fixed point, to this distance; SQL takes as many rounds of full steps as give it.
TOLERANCE, SQL_ROUNDS = 1e-9, 44

REWARDS = f"""rew AS (
  SELECT {DOMAIN} AS domain, user_id AS file, sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE -1 END) AS reward
  FROM events GROUP BY ALL),
sums AS (SELECT domain, sum(reward) FILTER (reward > 0) AS p, sum(reward) FILTER (reward < 0) AS n FROM rew GROUP BY domain),
means AS (SELECT domain, coalesce(p, 0)::DOUBLE / (SELECT count(*) FROM sums) AS k,
                 abs(coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM sums)) AS s FROM sums),
rt AS (SELECT domain, CASE WHEN k > s * 0.9::DOUBLE THEN k ELSE -s END AS r_keep, CASE WHEN k > s * 0.9::DOUBLE THEN -k ELSE s END AS r_skip
       FROM means)"""


def rewards(spark, sf):
    ev = table(spark, sf, "events").select(domain().alias("feature"), F.col("user_id").alias("file"))
    return ft.feature_rewards(ev, F.col("file") % 2).withColumnRenamed("feature", "domain")


def reward_table_(spark, sf):
    return pl.reward_table(rewards(spark, sf), 0.9)


def moves(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", domain().alias("state"))
    return pl.transitions(index_rows(ev, USER, ["ts", "event_id"]), USER)


@query("reward_table", f"WITH {REWARDS} SELECT domain, round(r_keep, 6) AS r_keep, round(r_skip, 6) AS r_skip FROM rt")
def reward_table(spark, sf):
    return reward_table_(spark, sf).select(
        "domain", F.round("r_keep", 6).alias("r_keep"), F.round("r_skip", 6).alias("r_skip"))


QSQL = f"""{REWARDS},
mv AS (SELECT state, coalesce(nxt, state) AS next_state, count(*) AS n FROM (
  SELECT {DOMAIN} AS state, lead({DOMAIN}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) GROUP BY ALL),
share AS (SELECT state, next_state, n::DOUBLE / sum(n) OVER (PARTITION BY state) AS p FROM mv),
q AS (
  SELECT 0 AS i, domain AS state, r_keep, r_skip, 0.0::DOUBLE AS q_keep, 0.0::DOUBLE AS q_skip FROM rt
  UNION ALL
  SELECT i + 1, state, r_keep, r_skip,
         CASE WHEN ahead IS NULL THEN q_keep ELSE r_keep + {GAMMA} * ahead END,
         CASE WHEN ahead IS NULL THEN q_skip ELSE r_skip + {GAMMA} * ahead END
  FROM (SELECT q.*, a.ahead FROM q LEFT JOIN (
          SELECT share.state, sum(p * greatest(q2.q_keep, q2.q_skip)) AS ahead
          FROM share JOIN q q2 ON q2.state = share.next_state GROUP BY share.state) a ON a.state = q.state)
  WHERE i < {SQL_ROUNDS}),
qf AS (SELECT * FROM q WHERE i = {SQL_ROUNDS})"""


def q_table(spark, sf):
    return pl.q_iteration(reward_table_(spark, sf), moves(spark, sf), alpha=1.0, gamma=GAMMA, tolerance=TOLERANCE)


@query("policy_values", f"""
WITH RECURSIVE {QSQL}
SELECT state, round(r_keep, 6) AS r_keep, round(r_skip, 6) AS r_skip, round(q_keep, 6) AS q_keep, round(q_skip, 6) AS q_skip FROM qf""")
def policy_values(spark, sf):
    q = q_table(spark, sf)
    return q.select("state", *[F.round(c, 6).alias(c) for c in ("r_keep", "r_skip", "q_keep", "q_skip")])


def learned_values(spark, sf):
    """The Q table, learned once per session and folder, as an application reads a stored one."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LEARNED:
        _LEARNED.clear()
        _LEARNED[key] = cut_lineage(q_table(spark, sf))
    return _LEARNED[key]


_LEARNED = {}


def gene_domains(spark, sf):
    """Three of four parts have domains; error events carry domains outside the table."""
    label = F.when(F.col("event_type") == "error", F.concat(F.lit("new_"), F.col("user_id").cast("string"))).otherwise(domain())
    return table(spark, sf, "events").select(
        F.concat(F.lit("G"), (F.col("event_id") % 1500).cast("string")).alias("gene"),
        F.col("event_id").alias("pos"), label.alias("domain"))


GD = f"""gd AS (SELECT 'G' || (event_id % 1500) AS gene, event_id AS pos,
               CASE WHEN event_type = 'error' THEN 'new_' || user_id ELSE {DOMAIN} END AS domain FROM events)"""
POLICY = f"""{QSQL}, {GD},
ch AS (SELECT gene, pos, gd.domain, CASE WHEN qf.state IS NULL OR q_keep >= q_skip THEN 'keep' ELSE 'skip' END AS action,
              coalesce(CASE WHEN q_keep >= q_skip THEN r_keep ELSE r_skip END, 0) AS reward
       FROM gd LEFT JOIN qf ON qf.state = gd.domain),
gp AS (SELECT gene, coalesce(sum(reward) FILTER (action = 'keep'), 0) AS keep_reward,
              coalesce(sum(reward) FILTER (action = 'skip'), 0) AS skip_reward,
              count(*) FILTER (reward < 0) AS n_penalties, string_agg(domain, ', ' ORDER BY pos) AS domains
       FROM ch GROUP BY gene)"""


@query("domain_choices", f"""
WITH RECURSIVE {POLICY} SELECT gene, pos, domain, action, round(reward, 6) AS reward FROM ch""")
def domain_choices(spark, sf):
    out = pl.domain_choices(gene_domains(spark, sf), learned_values(spark, sf))
    return out.withColumn("reward", F.round("reward", 6))


@query("gene_policy_report", f"""
WITH RECURSIVE {POLICY}
SELECT gene, round(keep_reward, 5) AS keep_reward, round(skip_reward, 5) AS skip_reward, n_penalties, domains,
       CASE WHEN round(keep_reward, 9) >= round(skip_reward, 9) THEN 'keep' ELSE 'skip' END AS action FROM gp""")
def gene_policy_report(spark, sf):
    domains = gene_domains(spark, sf)
    out = pl.domain_report(pl.gene_policy(domains, learned_values(spark, sf)), domains)
    return out.withColumns({c: F.round(c, 5) for c in ("keep_reward", "skip_reward")})


@query("penalties", f"""
WITH {REWARDS} SELECT (SELECT count(*) FROM rt WHERE r_keep < 0) AS penalties""")
def penalties(spark, sf):
    return pl.penalty_count(reward_table_(spark, sf).select(F.col("r_keep").alias("reward")))


@query("gene_domain_lists", f"""
WITH {GD} SELECT gene, count(*) AS n, md5(string_agg(domain, '|' ORDER BY pos)) AS digest FROM gd GROUP BY gene""")
def gene_domain_lists(spark, sf):
    return pl.gene_domain_lists(gene_domains(spark, sf)).select(
        "gene", F.size("domains").cast("long").alias("n"),
        F.md5(F.array_join("domains", "|").cast("binary")).alias("digest"))


ACTIONS = f"""{GENES}, {POLICY},
dec AS (SELECT l_suppkey, idx, genes.gene,
               CASE WHEN gp.gene IS NULL THEN 'undecided' WHEN round(keep_reward, 9) >= round(skip_reward, 9) THEN 'keep' ELSE 'skip' END AS act
        FROM genes LEFT JOIN gp ON gp.gene = genes.gene),
settled AS (SELECT *, CASE WHEN act <> 'undecided' THEN act
       WHEN avg(CASE WHEN act = 'keep' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY l_suppkey) > 0.5 THEN 'keep' ELSE 'skip' END AS fin FROM dec)"""


def applied(spark, sf, undecided):
    policy = pl.gene_policy(gene_domains(spark, sf), learned_values(spark, sf))
    return pl.apply_policy(supplier_genes(spark, sf), policy, undecided)


@query("policy_actions", f"""
WITH RECURSIVE {ACTIONS} SELECT l_suppkey, idx, gene, CASE WHEN act = 'undecided' THEN 'skip' ELSE act END AS action FROM dec""")
def policy_actions(spark, sf):
    return applied(spark, sf, False).select(*SUPP, "idx", "gene", "action")


@query("settled_actions", f"WITH RECURSIVE {ACTIONS} SELECT l_suppkey, idx, gene, fin AS action FROM settled")
def settled_actions(spark, sf):
    return pl.settle_undecided(applied(spark, sf, True), SUPP).select(*SUPP, "idx", "gene", "action")


@query("policy_clusters", f"""
WITH RECURSIVE {ACTIONS}
SELECT l_suppkey, CASE WHEN fin = 'keep' THEN 1.0 ELSE 0.0 END::DOUBLE AS score, count(DISTINCT gene) AS n,
       md5(string_agg(DISTINCT gene, '|' ORDER BY gene)) AS digest FROM settled GROUP BY ALL""")
def policy_clusters(spark, sf):
    settled = pl.settle_undecided(applied(spark, sf, True), SUPP)
    return pl.rebuild_clusters(settled, SUPP).select(
        *SUPP, "score", F.size("genes").cast("long").alias("n"),
        F.md5(F.array_join("genes", "|").cast("binary")).alias("digest"))


@query("gene_annotation_weights", f"""
WITH {GD}, ann AS (
  SELECT DISTINCT {DOMAIN} AS domain, CASE WHEN event_type = 'view' THEN 'backbone' ELSE 'tailoring' END AS type
  FROM events WHERE event_type IN ('view', 'click'))
SELECT gene, sum(CASE WHEN type IS NULL THEN 0.0 WHEN type = 'backbone' THEN 2.0 ELSE 1.5 END)::DOUBLE AS weight
FROM gd LEFT JOIN ann USING (domain) GROUP BY gene""")
def gene_annotation_weights(spark, sf):
    ann = table(spark, sf, "events").filter(F.col("event_type").isin("view", "click")).select(
        domain().alias("domain"),
        F.when(F.col("event_type") == "view", "backbone").otherwise("tailoring").alias("type")).distinct()
    return pl.annotation_weights(gene_domains(spark, sf), ann)
