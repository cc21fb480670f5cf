"""One query per operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm import url_vocabulary
from clusterloom.llm.common import read, unsigned_crc32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clusterloom.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Host and path rules of the URL query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _quoted(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


# Terms are single runs of letters, so a hit between boundaries is a token of the URL.
URL_SQL = f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, regexp_split_to_array(lower(coalesce(url, '')), '[^a-z0-9]+') AS tokens FROM pages),
h AS (SELECT *, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{url_vocabulary.UPPER}', '{url_vocabulary.LOWER}') AS host,
             regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
             len(list_filter(tokens, lambda t: list_contains({_quoted(url_vocabulary.STRICT)}, t))) AS n_strict,
             len(list_distinct(list_filter(tokens, lambda t: list_contains({_quoted(url_vocabulary.SOFT)}, t)))) AS n_soft FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft, n_soft::DOUBLE AS soft_weight FROM r"""


@query("op5_url_vocabulary", URL_SQL)
def op5_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_vocabulary.judge(read(spark, sf_dir, "pages"), URL_RULES)


@query("op9_bounded_ring")
def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import bounded_ring

    return bounded_ring.assign(read(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def in_training(modulus: int, held_out: int):
    """Whether a row's id puts it in the training part; a null id does not."""
    return F.coalesce(unsigned_crc32(F.col("doc_id")) % modulus != held_out, F.lit(False))


def held_out(modulus: int, remainder: int):
    """The column ``held_out``; false for a null id."""
    return F.coalesce(unsigned_crc32(F.col("doc_id")) % modulus == remainder, F.lit(False)).alias("held_out")


@query("op3_crf_language")
def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import crf_language

    docs = read(spark, sf_dir, "documents")
    model = crf_language.train(docs, in_training(3, 1))
    return crf_language.predict(docs, model).select(
        "doc_id", held_out(3, 1), "lang_pred", "score")


@query("op10_template_decontamination")
def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import template_decontamination

    return template_decontamination.flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Links ``l`` (both ways) over nodes ``v`` to the smallest node each one reaches.
REACH = """r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a)"""


@query("op8_ngram_join", f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{url_vocabulary.UPPER}', '{url_vocabulary.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
v AS (SELECT w.id, count(s.s) AS n FROM w LEFT JOIN s ON s.id = w.id GROUP BY w.id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN v p ON p.id = a JOIN v q ON q.id = b WHERE 100 * m >= 80 * (p.n + q.n - m)), {REACH}
SELECT v.id AS doc_id, n AS n_shingles, component_id FROM v JOIN c USING (id)""")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import ngram_join

    return ngram_join.cluster(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_column_suffixes")
def op7_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import column_suffixes

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return column_suffixes.remove(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_subspace_join", f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings),
l AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id <> q.id AND list_cosine_similarity(p.x, q.x) >= 0.98), {REACH},
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n USING (id)""")
def op4_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import subspace_join

    return subspace_join.cluster(read(spark, sf_dir, "embeddings"))


@query("op2_perspective_chat", """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '<\\|') AS body FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, body) - 1 AS pos FROM t),
people AS (SELECT DISTINCT conv_id, who AS assistant FROM t WHERE who <> 'system'),
n AS (SELECT conv_id, count(*) AS n_participants FROM people GROUP BY conv_id),
v AS (SELECT p.*, assistant, pos // 64 AS piece, CASE WHEN who = assistant THEN '<|assistant|>' WHEN who = 'system' THEN '<|system|>'
             ELSE '<|user|>' || replace(who, '<|', '<\\|') END || chr(10) AS head FROM p JOIN people USING (conv_id)),
m AS (SELECT *, head || body || '<|end|>' || chr(10) AS msg FROM v),
o AS (SELECT *, sum(length(msg)) OVER (PARTITION BY conv_id, assistant, piece ORDER BY pos) - length(msg) + length(head) AS pt FROM m)
SELECT conv_id, assistant, piece, count(*) AS n_turns, any_value(n_participants) AS n_participants, string_agg(msg, '' ORDER BY pos) AS text,
       coalesce(string_agg(pt || '-' || (pt + length(body) + 7), ',' ORDER BY pos) FILTER (who = assistant), '') AS mask
FROM o JOIN n USING (conv_id) GROUP BY conv_id, assistant, piece""")
def op2_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import perspective_chat

    out = perspective_chat.rotate(read(spark, sf_dir, "conversations"))
    shown = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.withColumn("mask", shown)


@query("op6_gated_lm")
def op6_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import gated_lm

    scored, n = gated_lm.score_documents(read(spark, sf_dir, "documents"), in_training(7, 2))
    return scored.select(
        "doc_id", held_out(7, 2), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


@query("op13_phrase_mining", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, unnest(range(1, 6)) AS t(m) WHERE len(w) >= m),
f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, m)) AS k FROM f WHERE m > 1),
x AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(s[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(s[k + 1:], ' ')
      JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[:m - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase FROM f WHERE m > 2),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
      WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND i.f = b.a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= 2000""")
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import phrase_mining

    return phrase_mining.mine(read(spark, sf_dir, "documents"))


@query("op11_hard_negatives", """
WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor, p.id AS positive, p.score AS top, s.id, s.score,
             row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id)::INT AS rank
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank, id AS negative_id, top AS positive_score, score AS negative_score FROM n WHERE rank <= 5""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import hard_negatives

    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


@query("op12_host_suffixes")
def op12_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterloom.llm import host_suffixes

    return host_suffixes.extract(read(spark, sf_dir, "pages"))
