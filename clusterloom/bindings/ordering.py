"""Ordered-sequence queries: predictions from ``events``, gene lists from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.bindings import query, table
from clusterloom.bindings.features import FAN, PIECE, SEQS, digests_sql, sequences
from clusterloom.operators import merge as mg
from clusterloom.operators import pieces as pc
from clusterloom.operators.ordered import index_rows, scan
from clusterloom.operators.windows import sequence_windows

# Inputs --------------------------------------------------------------------------------

USER = ["user_id"]
SUPP = ["l_suppkey"]


def states(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return index_rows(ev, USER, ["ts", "event_id"])


def predictions(spark, sf):
    """One scored cluster per event; neighbours share genes as overlapping windows do."""
    gene = lambda i: F.concat(F.lit("g"), F.col("user_id").cast("string"), F.lit("_"),
                              (F.col("pos") + i).cast("string"))
    return states(spark, sf).select(
        "user_id", "pos", F.array(gene(0), gene(1), gene(2)).alias("genes"),
        (F.col("value") / 100).alias("score"))


PRED = """ranked AS (
  SELECT user_id, event_type, value, ts, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
pred AS (
  SELECT user_id, pos, n, value / 100 AS score,
         list_transform([0, 1, 2], lambda k: 'g' || user_id || '_' || (pos + k)) AS genes
  FROM ranked)"""

LEADERS = f"""{PRED},
walk AS (
  SELECT user_id, pos, CASE WHEN score >= 0.5 AND pos < n - 2 THEN pos END AS lead
  FROM pred WHERE pos = 0
  UNION ALL
  SELECT p.user_id, p.pos,
         CASE WHEN w.lead IS NOT NULL AND p.pos - w.lead <= 2 THEN w.lead
              WHEN p.score >= 0.5 AND p.pos < p.n - 2 THEN p.pos END
  FROM walk w JOIN pred p ON p.user_id = w.user_id AND p.pos = w.pos + 1),
led AS (SELECT p.*, w.lead FROM pred p JOIN walk w USING (user_id, pos))"""


def genes_sql(key: str, src: str) -> str:
    return f"""(
  SELECT user_id, pos, string_agg(gene, '|' ORDER BY ord) AS genes FROM (
    SELECT user_id, {key} AS pos, gene, min(pos * 10 + i) AS ord
    FROM (SELECT user_id, pos, lead, unnest(genes) AS gene, unnest(range(1, 4)) AS i FROM {src})
    GROUP BY ALL) GROUP BY user_id, pos)"""


def _joined(df, *extra):
    return df.select("user_id", "pos", F.array_join("genes", "|").alias("genes"), "score", *extra)


@query("ordered_predictions", f"""
WITH {PRED} SELECT user_id, pos, array_to_string(genes, '|') AS genes, score FROM pred""")
def ordered_predictions(spark, sf):
    return _joined(predictions(spark, sf))


@query("successive_merge", f"""
WITH RECURSIVE {LEADERS}
SELECT g.user_id, g.pos, g.genes, p.score
FROM {genes_sql('coalesce(lead, pos)', 'led')} g JOIN pred p USING (user_id, pos)""")
def successive_merge(spark, sf):
    return _joined(mg.successive_merge(predictions(spark, sf), USER, 2))


@query("successive_relabel", f"""
WITH RECURSIVE {LEADERS}
SELECT f.user_id, f.pos,
       CASE WHEN f.lead < f.pos AND f.score < 0.5
            THEN array_to_string(list_filter(f.genes, lambda g: NOT list_contains(l.genes, g)), '|')
            ELSE array_to_string(f.genes, '|') END AS genes,
       CASE WHEN f.lead < f.pos AND f.score < 0.5 THEN l.score ELSE f.score END AS score
FROM led f LEFT JOIN pred l ON l.user_id = f.user_id AND l.pos = f.lead""")
def successive_relabel(spark, sf):
    return _joined(mg.successive_relabel(predictions(spark, sf), USER, 2))


CARRIED = f"""{PRED},
seen AS (
  SELECT *, last_value(CASE WHEN score >= 0.5 THEN pos END IGNORE NULLS)
              OVER (PARTITION BY user_id ORDER BY pos) AS frm FROM pred),
led AS (SELECT *, CASE WHEN score < 0.5 AND pos - frm <= 2 THEN frm END AS lead FROM seen)"""


@query("carry_forward_merge", f"""
WITH {CARRIED}
SELECT g.user_id, g.pos, g.genes, p.score
FROM {genes_sql('coalesce(lead, pos)', 'led')} g JOIN pred p USING (user_id, pos)""")
def carry_forward_merge(spark, sf):
    return _joined(mg.carry_forward_merge(predictions(spark, sf), USER, 2))


@query("carry_forward_relabel", f"""
WITH {CARRIED}
SELECT f.user_id, f.pos, array_to_string(f.genes, '|') AS genes, coalesce(l.score, f.score) AS score
FROM led f LEFT JOIN pred l ON l.user_id = f.user_id AND l.pos = f.lead""")
def carry_forward_relabel(spark, sf):
    return _joined(mg.carry_forward_merge(predictions(spark, sf), USER, 2, merge=False))


VOTES = f"""{PRED},
votes AS (
  SELECT gene, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share, user_id,
         min(pos * 10 + i) // 10 AS first_pos, min(pos * 10 + i) % 10 AS first_idx
  FROM (SELECT user_id, pos, score, unnest(genes) AS gene, unnest(range(0, 3)) AS i FROM pred)
  GROUP BY gene, user_id),
lengths AS (SELECT 'g' || user_id || '_' || pos AS gene, floor(value * 10)::BIGINT AS length FROM ranked),
placed AS (
  SELECT user_id, gene, share >= 0.5 AS positive, coalesce(length, 0) AS length,
         row_number() OVER (PARTITION BY user_id ORDER BY first_pos, first_idx) - 1 AS gpos
  FROM votes LEFT JOIN lengths USING (gene))"""


@query("majority_vote", f"WITH {VOTES} SELECT gene, round(share, 6) AS share, user_id, first_pos, first_idx FROM votes")
def majority_vote(spark, sf):
    v = mg.majority_vote(predictions(spark, sf), USER)
    return v.withColumn("share", F.round("share", 6)).withColumn(
        "first_idx", F.col("first_idx").cast("long"))


def gene_lengths(spark, sf):
    return states(spark, sf).select(
        F.concat(F.lit("g"), F.col("user_id").cast("string"), F.lit("_"),
                 F.col("pos").cast("string")).alias("gene"),
        F.floor(F.col("value") * 10).cast("long").alias("length"))


@query("gene_length_lookup", f"WITH {VOTES} SELECT user_id, gene, length FROM placed")
def gene_length_lookup(spark, sf):
    votes = mg.majority_vote(predictions(spark, sf), USER)
    return mg.with_gene_length(votes, gene_lengths(spark, sf)).select("user_id", "gene", "length")


@query("majority_regroup", f"""
WITH RECURSIVE {VOTES},
walk AS (
  SELECT user_id, gpos, positive, gpos AS grp, length AS run FROM placed WHERE gpos = 0
  UNION ALL
  SELECT p.user_id, p.gpos, p.positive,
         CASE WHEN p.positive = w.positive AND (p.positive OR w.run < 1500) THEN w.grp ELSE p.gpos END,
         CASE WHEN p.positive = w.positive AND (p.positive OR w.run < 1500) THEN w.run + p.length ELSE p.length END
  FROM walk w JOIN placed p ON p.user_id = w.user_id AND p.gpos = w.gpos + 1)
SELECT user_id, grp AS "group", gpos, gene, CASE WHEN positive THEN 1.0 ELSE 0.0 END::DOUBLE AS score
FROM walk JOIN placed USING (user_id, gpos, positive)""")
def majority_regroup(spark, sf):
    votes = mg.majority_vote(predictions(spark, sf), USER)
    return mg.majority_regroup(votes, USER, gene_lengths(spark, sf), 0.5, 1500)


# Gene-level operators over supplier gene lists -----------------------------------------


def supplier_genes(spark, sf):
    """Genes (parts) of a supplier in order; kinds and decisions follow part attributes."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return index_rows(
        li, SUPP, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "idx"
    ).select("l_suppkey", "idx", F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene"))


def gene_domains(spark, sf):
    return table(spark, sf, "part").select(
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"),
        F.concat("p_brand", F.lit(".1\n"), "p_type", F.lit(".2")).alias("content"))


def rule_list(spark, sf):
    return (table(spark, sf, "part").filter(F.col("p_brand").startswith("Brand#1"))
            .select(F.col("p_brand").alias("domain")).distinct())


def decisions(spark, sf):
    part = table(spark, sf, "part").select(
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"),
        F.when(F.col("p_size") < 5, 2.0).when(F.col("p_size") < 12, 1.5).otherwise(0.0).alias("weight"),
        F.element_at(F.array(F.lit("keep"), F.lit("skip"), F.lit("undecided")),
                     (F.col("p_partkey") % 3 + 1).cast("int")).alias("action"))
    return supplier_genes(spark, sf).join(part, "gene")


GENES = """genes AS (
  SELECT l_suppkey, 'G' || l_partkey AS gene, l_partkey, p_size,
         row_number() OVER (PARTITION BY l_suppkey
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx,
         p_brand LIKE 'Brand#1%' AS flag,
         CASE WHEN p_size < 5 THEN 2.0 WHEN p_size < 12 THEN 1.5 ELSE 0.0 END::DOUBLE AS weight,
         ['keep', 'skip', 'undecided'][p_partkey % 3 + 1] AS action
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

RUNS = f"""{GENES},
chg AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS c
        FROM genes WINDOW w AS (PARTITION BY l_suppkey ORDER BY idx)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY l_suppkey ORDER BY idx) AS island FROM chg),
runs AS (
  SELECT *, flag AND count(*) OVER (PARTITION BY l_suppkey, island) >= 3
           AND island < max(island) OVER (PARTITION BY l_suppkey) AS in_split,
         min(idx) OVER (PARTITION BY l_suppkey, island) AS istart
  FROM isl)"""


@query("flagged_genes", """
SELECT 'G' || p_partkey AS gene FROM part WHERE p_brand LIKE 'Brand#1%'""")
def flagged_genes(spark, sf):
    return mg.flagged_genes(gene_domains(spark, sf), rule_list(spark, sf))


def flagged_rows(spark, sf):
    flagged = mg.flagged_genes(gene_domains(spark, sf), rule_list(spark, sf))
    return mg.flag_genes(supplier_genes(spark, sf), flagged).select(*SUPP, "idx", "gene", "flag")


@query("split_runs", f"""
WITH {RUNS}
SELECT l_suppkey, istart AS run_start, count(*) AS run_length FROM runs WHERE in_split GROUP BY ALL""")
def split_runs(spark, sf):
    rows = mg.split_runs(flagged_rows(spark, sf), SUPP, 3)
    return rows.filter("in_split").groupBy("l_suppkey", "run_start").agg(
        F.count("*").alias("run_length"))


@query("rule_filter_split", f"""
WITH RECURSIVE {RUNS},
marked AS (SELECT l_suppkey, idx, gene, NOT flag AS kept, idx = 0 OR (in_split AND istart = idx) AS edge FROM runs),
walk AS (
  SELECT l_suppkey, idx, gene, kept, idx AS fragment, kept::INT AS size FROM marked WHERE idx = 0
  UNION ALL
  SELECT m.l_suppkey, m.idx, m.gene, m.kept,
         CASE WHEN m.edge AND w.size >= 5 THEN m.idx ELSE w.fragment END,
         CASE WHEN m.edge AND w.size >= 5 THEN 0 ELSE w.size END + m.kept::INT
  FROM walk w JOIN marked m ON m.l_suppkey = w.l_suppkey AND m.idx = w.idx + 1)
SELECT l_suppkey, fragment, idx, gene FROM (
  SELECT *, max(size) OVER (PARTITION BY l_suppkey, fragment) AS final FROM walk)
WHERE kept AND final >= 5""")
def rule_filter_split(spark, sf):
    return mg.filter_and_split(flagged_rows(spark, sf), SUPP)


@query("dry_islands", f"""
WITH {GENES},
chg AS (SELECT *, CASE WHEN (weight = 0) IS DISTINCT FROM lag(weight = 0) OVER w THEN 1 ELSE 0 END AS c
        FROM genes WINDOW w AS (PARTITION BY l_suppkey ORDER BY idx)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY l_suppkey ORDER BY idx) AS island FROM chg)
SELECT l_suppkey, idx, gene, weight,
       CASE WHEN action = 'keep' AND weight = 0 AND count(*) OVER (PARTITION BY l_suppkey, island) >= 3
            THEN 'skip' ELSE action END AS action
FROM isl""")
def dry_islands(spark, sf):
    return mg.dry_islands(decisions(spark, sf), SUPP).select(*SUPP, "idx", "gene", "weight", "action")


@query("neighbour_weights", f"""
WITH {GENES},
near AS (
  SELECT *, coalesce(sum(weight) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) > 1
         OR coalesce(sum(weight) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) > 1 AS hit
  FROM genes WINDOW w AS (PARTITION BY l_suppkey ORDER BY idx))
SELECT l_suppkey, idx, gene, CASE WHEN hit THEN greatest(weight, 1.0) ELSE weight END AS weight,
       CASE WHEN hit AND action = 'skip' THEN 'keep' ELSE action END AS action
FROM near""")
def neighbour_weights(spark, sf):
    return mg.neighbour_weights(decisions(spark, sf), SUPP, 2).select(
        *SUPP, "idx", "gene", "weight", "action")


# States, runs and windows --------------------------------------------------------------


@query("state_transitions", """
SELECT event_type AS state, coalesce(nxt, event_type) AS next_state, count(*) AS n
FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
GROUP BY ALL""")
def state_transitions(spark, sf):
    from clusterloom.operators.policy import transitions

    seq = states(spark, sf).withColumnRenamed("event_type", "state")
    return transitions(seq, USER)


@query("consecutive_record_merge", f"""
WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, lang, text FROM documents),
c AS (SELECT *, CASE WHEN lang IS DISTINCT FROM lag(lang) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS c FROM o),
i AS (SELECT *, sum(c) OVER (ORDER BY pos) AS island FROM c),
runs AS (SELECT min(pos) AS start, lang, coalesce(string_agg(text, '' ORDER BY pos), '') AS alltext, count(*) AS n FROM i GROUP BY island, lang),
{digests_sql("runs", "start", "alltext")}
SELECT start, lang, runs.n, n_chars, n_pieces, digest FROM runs JOIN digests USING (start)""")
def consecutive_record_merge(spark, sf):
    docs = index_rows(table(spark, sf, "documents").select("doc_id", "lang", "text"), [], ["doc_id"])
    runs, pieces = mg.consecutive_pieces(docs, [], "pos", "lang", "text", PIECE)
    return runs.join(pc.piece_digests(pieces, ["start"], FAN), "start").select(
        "start", "lang", "n", "n_chars", "n_pieces", "digest")


@query("running_scores", """
SELECT user_id, pos, round(total, 4) AS total, round(prev, 4) AS prev FROM (
  SELECT user_id, row_number() OVER w - 1 AS pos, sum(value) OVER w AS total, lag(value) OVER w AS prev
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def running_scores(spark, sf):
    seen = scan(states(spark, sf), USER, "pos", sums={"total": F.col("value")},
                prevs={"prev": F.col("value")})
    return seen.select("user_id", "pos", F.round("total", 4).alias("total"), F.round("prev", 4).alias("prev"))


@query("overlapping_windows", f"""
WITH {SEQS},
offs AS (SELECT lang, doc_id, length(seq) AS len,
                sum(length(seq)) OVER (PARTITION BY lang ORDER BY doc_id) - length(seq) AS off FROM seqs),
alls AS (SELECT lang, string_agg(seq, '' ORDER BY doc_id) AS alltext FROM seqs GROUP BY lang),
wins AS (SELECT lang, alltext, unnest(range(0, (length(alltext) - 7000) // 3500 + 1)) AS w
         FROM alls WHERE length(alltext) >= 7000),
mem AS (SELECT w.lang, w.w, string_agg(doc_id, '|' ORDER BY doc_id) AS ids,
               min(doc_id) || '|to|' || max(doc_id) AS window_id
        FROM wins w JOIN offs o ON o.lang = w.lang AND o.len > 0
          AND o.off < w.w * 3500 + 7000 AND o.off + o.len > w.w * 3500
        GROUP BY w.lang, w.w)
SELECT lang, w AS "window", ids, window_id, md5(substr(alltext, (w * 3500 + 1)::INT, 7000)) AS digest
FROM wins JOIN mem USING (lang, w)""")
def overlapping_windows(spark, sf):
    out = sequence_windows(sequences(spark, sf), ["lang"], "doc_id", "seq", 7000, 50)
    return out.select("lang", "window", F.array_join(F.col("ids").cast("array<string>"), "|").alias("ids"),
                      "window_id", F.md5(F.col("content").cast("binary")).alias("digest"))
