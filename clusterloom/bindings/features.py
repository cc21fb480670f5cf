"""Token, vocabulary, occurrence and encoding queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.bindings import query, table
from clusterloom.functions import tokens as tk
from clusterloom.operators import features as ft
from clusterloom.operators import kmer_bins as kb
from clusterloom.session import cut_lineage

# Shared inputs -------------------------------------------------------------------------


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", "lang", "source",
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"),
    )


SEQS = """seqs AS (
  SELECT doc_id, lang, source, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq
  FROM documents)"""


PIECE, FAN = 4096, 64


def digests_sql(source: str, key: str, text: str) -> str:
    """CTEs ending in ``digests (key, n_chars, n_pieces, digest)``: the hash tree over pieces of ``text``."""
    levels = [f"""pieces AS (SELECT {key}, p AS node, 1 AS n, sha256(substr(t, (p * {PIECE} + 1)::BIGINT, {PIECE})) AS d, nc
  FROM (SELECT {key}, {text} AS t, length({text}) AS nc, unnest(range(0, greatest((length({text}) + {PIECE - 1}) // {PIECE}, 1))) AS p FROM {source}))"""]
    before = "pieces"
    for i in range(4):
        levels.append(f"""up{i} AS (SELECT {key}, node // {FAN} AS node, sum(n)::BIGINT AS n, any_value(nc) AS nc,
  CASE WHEN count(*) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY node)) END AS d FROM {before} GROUP BY {key}, {before}.node // {FAN})""")
        before = f"up{i}"
    levels.append(f"digests AS (SELECT {key}, nc AS n_chars, n AS n_pieces, d AS digest FROM {before})")
    return ",\n".join(levels)


def kmers_sql(k: int) -> str:
    return f"""(SELECT doc_id, source, seq, i AS pos, substr(seq, i, {k}) AS feature FROM (
    SELECT doc_id, source, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM seqs))"""


#: ``[^A-Za-z.]+``; the JVM matches the intersection many times faster than the one class.
NO_WORD = "[[^A-Za-z]&&[^.]]+"


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """k-mer, domain (words) and ontology (labels) contents; the document source is the file."""
    docs = table(spark, sf, "documents")
    seqs = sequences(spark, sf).select(
        F.col("doc_id").alias("instance_id"), F.col("source").alias("file"),
        F.lit("kmers").alias("feature_type"), F.col("seq").alias("content"),
    )
    words = docs.select(
        F.col("doc_id").alias("instance_id"), F.col("source").alias("file"),
        F.lit("domains").alias("feature_type"),
        F.regexp_replace("text", NO_WORD, "\n").alias("content"),
    )
    terms = table(spark, sf, "labels").select(
        F.col("doc_id").alias("instance_id"), F.lit("labels").alias("file"),
        F.lit("go").alias("feature_type"),
        F.concat(F.lit("GO:q"), F.col("quality").cast("string"), F.lit("\nGO:t"),
                 F.col("toxic").cast("string")).alias("content"),
    )
    return seqs.unionByName(words).unionByName(terms)


def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tk.tokenize(contents(spark, sf), "domains")


WORDS = r"""word_lines AS (
  SELECT doc_id, source,
         string_split(regexp_replace(text, '[^A-Za-z.]+', chr(10), 'g'), chr(10)) AS toks
  FROM documents),
words AS (
  SELECT doc_id AS instance_id, source AS file, 'domains' AS feature_type, pos,
         split_part(tok, '.', 1) AS feature
  FROM (SELECT doc_id, source, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos
        FROM word_lines)
  WHERE length(tok) > 1)"""

TERMS = """terms AS (
  SELECT doc_id AS instance_id, 'labels' AS file, 'go' AS feature_type, 1 AS pos,
         'GO:q' || quality AS feature FROM labels
  UNION ALL
  SELECT doc_id, 'labels', 'go', 2, 'GO:t' || toxic FROM labels)"""

KMERS3 = f"""kmers3 AS (
  SELECT doc_id AS instance_id, source AS file, 'kmers' AS feature_type, pos, feature
  FROM {kmers_sql(3)} t)"""

ALL_TOKENS = f"""{SEQS}, {WORDS}, {TERMS}, {KMERS3},
tokens AS (SELECT * FROM kmers3 UNION ALL SELECT * FROM words UNION ALL SELECT * FROM terms),
feats AS (
  SELECT feature_type, feature, count(*) AS cnt FROM tokens GROUP BY ALL
  HAVING feature_type <> 'kmers' OR count(*) >= 3),
vocab AS (
  SELECT feature_type, feature,
         row_number() OVER (ORDER BY CASE WHEN feature_type = 'kmers' THEN 0 ELSE 2 END,
                            feature, feature_type) - 1 AS idx
  FROM feats)"""


def all_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tk.tokenize(contents(spark, sf), "go-kmers-domains", 3)


def full_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return ft.vocabulary(ft.feature_set(all_tokens(spark, sf), 3))


# Tokenizers and counts -----------------------------------------------------------------


@query("kmer_corpus_count", f"""
WITH {SEQS}
SELECT feature, count(*) AS cnt FROM {kmers_sql(6)} t GROUP BY feature HAVING count(*) >= 3""")
def kmer_corpus_count(spark, sf):
    return ft.kmer_counts(sequences(spark, sf), "seq", 6, 3)


@query("binned_kmer_count", f"""
WITH {SEQS}
SELECT feature, count(*) AS cnt FROM {kmers_sql(15)} t GROUP BY feature HAVING count(*) >= 3""")
def binned_kmer_count(spark, sf):
    return kb.binned_kmer_counts(sequences(spark, sf), "seq", 15, 3)


@query("kmer_range_count", f"""
WITH {SEQS}, grams AS (
  SELECT feature FROM {kmers_sql(3)} a UNION ALL SELECT feature FROM {kmers_sql(4)} b
  UNION ALL SELECT feature FROM {kmers_sql(5)} c)
SELECT feature, count(*) AS cnt FROM grams GROUP BY feature HAVING count(*) >= 5""")
def kmer_range_count(spark, sf):
    return ft.kmer_counts(sequences(spark, sf), "seq", "3to5", 5)


@query("kmer_position_profile", f"""
WITH {SEQS}
SELECT feature, count(*) AS cnt, min(pos) AS first_pos, max(pos) AS last_pos,
       count(DISTINCT doc_id) AS n_docs
FROM {kmers_sql(2)} t GROUP BY feature""")
def kmer_position_profile(spark, sf):
    grams = tk.explode_kmers(sequences(spark, sf).select("doc_id", "seq"), "seq", 2, pos_col="pos")
    per_doc = grams.groupBy("feature", "doc_id").agg(
        F.count("*").alias("c"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return per_doc.groupBy("feature").agg(
        F.sum("c").alias("cnt"), F.min("lo").alias("first_pos"), F.max("hi").alias("last_pos"),
        F.count("*").alias("n_docs"))


@query("line_bigrams", r"""
WITH lines AS (SELECT string_split(text, chr(10)) AS l FROM documents),
grams AS (SELECT l[i] || ' ' || l[i + 1] AS g
          FROM (SELECT l, unnest(range(1, len(l))) AS i FROM lines))
SELECT split_part(g, '.', 1) AS feature, count(*) AS cnt FROM grams
WHERE length(g) > 1 GROUP BY 1""")
def line_bigrams(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return (tk.explode_line_ngrams(docs, "text", 2).groupBy("feature")
            .agg(F.count("*").alias("cnt")))


@query("tokens_by_type", f"""
WITH {ALL_TOKENS}
SELECT feature_type, file, count(*) AS n_tokens, count(DISTINCT feature) AS n_features
FROM tokens GROUP BY ALL""")
def tokens_by_type(spark, sf):
    per = all_tokens(spark, sf).groupBy("feature_type", "file", "feature").agg(F.count("*").alias("c"))
    return per.groupBy("feature_type", "file").agg(
        F.sum("c").alias("n_tokens"), F.count("*").alias("n_features"))


@query("indexed_feature_names", """
SELECT vec_id, label, count(*) AS n, min(round(v, 4)) AS low, max(round(v, 4)) AS high,
       max(CASE WHEN i = 1 THEN 'dim-' || i ELSE '' END) AS first_name
FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
             unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
GROUP BY vec_id, label""")
def indexed_feature_names(spark, sf):
    vec = table(spark, sf, "embeddings")
    flat = vec.select("vec_id", "label", F.explode(tk.flatten_indexed(F.col("embedding"), "dim")))
    return flat.groupBy("vec_id", "label").agg(
        F.count("*").alias("n"),
        F.min(F.round(F.col("value").cast("double"), 4)).alias("low"),
        F.max(F.round(F.col("value").cast("double"), 4)).alias("high"),
        F.max(F.when(F.col("key") == "dim-1", F.col("key")).otherwise("")).alias("first_name"))


@query("feature_set", f"WITH {ALL_TOKENS} SELECT feature_type, feature, cnt FROM feats")
def feature_set(spark, sf):
    return ft.feature_set(all_tokens(spark, sf), 3)


@query("vocabulary_index", f"WITH {ALL_TOKENS} SELECT feature_type, feature, idx FROM vocab")
def vocabulary_index(spark, sf):
    return full_vocabulary(spark, sf).select("feature_type", "feature", "idx")


# Occurrences ---------------------------------------------------------------------------

NONOVERLAP3 = f"""kcounts AS (
  SELECT doc_id AS instance_id, source AS file, 'kmers' AS feature_type, feature,
         (length(seq) - length(replace(seq, feature, ''))) // 3 AS cnt
  FROM (SELECT DISTINCT doc_id, source, seq, feature FROM {kmers_sql(3)} t))"""


@query("nonoverlapping_kmer_count", f"""
WITH {SEQS}, {NONOVERLAP3}
SELECT feature, sum(cnt)::BIGINT AS total, count(*) AS n_instances, max(cnt)::BIGINT AS most
FROM kcounts GROUP BY feature""")
def nonoverlapping_kmer_count(spark, sf):
    src = contents(spark, sf).filter("feature_type = 'kmers'")
    return ft.kmer_occurrences(src, 3, ["instance_id"]).groupBy("feature").agg(
        F.sum("cnt").alias("total"), F.count("*").alias("n_instances"), F.max("cnt").alias("most"))


@query("occurrence_matrix", f"""
WITH {ALL_TOKENS}, {NONOVERLAP3},
counts AS (
  SELECT instance_id, file, feature_type, feature, cnt FROM kcounts
  UNION ALL
  SELECT instance_id, file, feature_type, feature, count(*) FROM tokens
  WHERE feature_type <> 'kmers' GROUP BY ALL)
SELECT file AS instance_id, idx, sum(cnt)::DOUBLE AS cnt
FROM counts JOIN vocab USING (feature_type, feature) GROUP BY file, idx""")
def occurrence_matrix(spark, sf):
    """Vectors of all documents of one source merged under the source id."""
    return ft.merge_same_id(ft.occurrences(contents(spark, sf), full_vocabulary(spark, sf), 3, owner="file"))


@query("complete_instances", f"""
WITH {ALL_TOKENS}
SELECT instance_id, count(DISTINCT feature_type) AS n_types FROM tokens
GROUP BY instance_id HAVING count(DISTINCT feature_type) >= 3""")
def complete_instances(spark, sf):
    return ft.complete_instances(all_tokens(spark, sf), 3)


@query("features_per_instance", f"""
WITH {WORDS}, {TERMS}, toks AS (SELECT * FROM words UNION ALL SELECT * FROM terms)
SELECT instance_id, count(*) AS n_features,
       md5(string_agg(feature, ' ' ORDER BY feature_type, file, pos)) AS digest
FROM toks GROUP BY instance_id""")
def features_per_instance(spark, sf):
    toks = tk.tokenize(contents(spark, sf), "go-domains")
    return ft.features_per_instance(toks).select(
        "instance_id", F.size("features").cast("long").alias("n_features"),
        F.md5(F.array_join("features", " ").cast("binary")).alias("digest"))


@query("domain_file_index", f"""
WITH {WORDS}
SELECT feature, file, count(*) AS cnt, max(CASE WHEN file LIKE '%7%' THEN 1 ELSE 0 END) AS label
FROM words GROUP BY feature, file""")
def domain_file_index(spark, sf):
    label = F.when(F.col("file").contains("7"), 1).otherwise(0)
    return ft.domain_files(word_tokens(spark, sf), label)[0]


@query("domain_labels", f"""
WITH {WORDS}
SELECT feature, count(DISTINCT file) AS n_files,
       max(CASE WHEN file LIKE '%7%' THEN 1 ELSE 0 END) AS label
FROM words GROUP BY feature""")
def domain_labels(spark, sf):
    label = F.when(F.col("file").contains("7"), 1).otherwise(0)
    return ft.domain_files(word_tokens(spark, sf), label)[1]


# Encoded sequences ---------------------------------------------------------------------

# Only words seen at least twice are known, so encoding drops the others.
WORD_VOCAB = f"""{WORDS},
vocab AS (
  SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx
  FROM (SELECT feature FROM words GROUP BY feature HAVING count(*) >= 2)),
encoded AS (
  SELECT instance_id, coalesce(list(idx ORDER BY pos) FILTER (idx IS NOT NULL), []) AS ids,
         count(idx) AS size
  FROM words LEFT JOIN vocab USING (feature) GROUP BY instance_id)"""


def word_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    known = word_tokens(spark, sf).groupBy("feature_type", "feature").agg(F.count("*").alias("cnt"))
    return ft.vocabulary(known.filter("cnt >= 2"))


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document has each word, counted where its text is cut and kept: the vocabulary and
    the occurrences both follow from it, so no text is cut twice."""
    words = contents(spark, sf).filter("feature_type = 'domains'").repartition("instance_id")
    return cut_lineage(tk.tokenize(words, "domains").groupBy("instance_id", "feature_type", "feature").agg(F.count("*").alias("cnt")))


def counted_vocabulary(counts: DataFrame) -> DataFrame:
    """``word_vocabulary`` of counted words."""
    known = counts.groupBy("feature_type", "feature").agg(F.sum("cnt").alias("cnt"))
    return ft.vocabulary(known.filter("cnt >= 2"))


def encoded_words(spark: SparkSession, sf: str) -> DataFrame:
    return ft.encode(word_tokens(spark, sf), word_vocabulary(spark, sf))


def _digest(col: str):
    return F.md5(F.array_join(F.col(col).cast("array<string>"), ",").cast("binary"))


def _padded_digest(padding: str):
    """The digest of ``padded``; the run of zeros is written at once, as ids in it are never 0."""
    ids = F.array_remove("padded", 0)
    n = F.size("padded") - F.size(ids)
    kept = F.when(F.size(ids) > 0, F.array_join(ids.cast("array<string>"), ","))
    fill = F.when(n > 0, F.concat(F.lit("0"), F.repeat(F.lit(",0"), n - 1)))
    text = F.concat_ws(",", kept, fill) if padding == "post" else F.concat_ws(",", fill, kept)
    return F.when(F.col("padded").isNotNull(), F.md5(text.cast("binary")))


@query("encoded_instances", f"""
WITH {WORD_VOCAB}
SELECT instance_id, size, md5(array_to_string(ids, ',')) AS digest FROM encoded""")
def encoded_instances(spark, sf):
    return encoded_words(spark, sf).select("instance_id", "size", _digest("ids").alias("digest"))


@query("max_instance_length", f"WITH {WORD_VOCAB} SELECT max(size) AS max_len FROM encoded")
def max_instance_length(spark, sf):
    return ft.max_length(encoded_words(spark, sf))


def training_width(encoded) -> int:
    return encoded.filter("instance_id % 5 <> 0").agg(F.max("size")).first()[0]


@query("padded_sequences", f"""
WITH {WORD_VOCAB}, shifted AS (
  SELECT instance_id, list_transform(ids, lambda i: i + 1)[greatest(len(ids) - w + 1, 1):] AS kept, w
  FROM encoded, (SELECT max(size) AS w FROM encoded WHERE instance_id % 5 <> 0))
SELECT instance_id, md5(array_to_string(
  list_concat(kept, list_transform(range(w - len(kept)), lambda i: 0)), ',')) AS digest
FROM shifted""")
def padded_sequences(spark, sf):
    """All instances at the width of the longest training instance."""
    encoded = cut_lineage(encoded_words(spark, sf))
    return ft.pad_sequences(encoded, training_width(encoded)).select(
        "instance_id", _padded_digest("post").alias("digest"))


@query("padded_to_longest", f"""
WITH {WORD_VOCAB}
SELECT instance_id, max_len, (SELECT max(size) FROM encoded) AS padded_size, list_sum(ids) + len(ids) AS checksum
FROM encoded, (SELECT max(size) AS max_len FROM encoded)""")
def padded_to_longest(spark, sf):
    # Zeros add nothing, so the sum leaves them out.
    return ft.pad_sequences(cut_lineage(encoded_words(spark, sf))).select(
        "instance_id", "max_len", F.size("padded").cast("long").alias("padded_size"),
        F.when(F.size("ids") > 0, F.aggregate(
            F.array_remove("padded", 0), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))).alias("checksum"))


@query("padded_batches", f"""
WITH {WORD_VOCAB}, batched AS (
  SELECT instance_id, ids, (row_number() OVER (ORDER BY instance_id) - 1) // 32 AS batch
  FROM encoded),
widths AS (SELECT batch, least(max(len(ids)), (SELECT max(size) FROM encoded WHERE instance_id % 5 <> 0)) AS width FROM batched GROUP BY batch),
shifted AS (
  SELECT instance_id, batch, width,
         list_transform(ids, lambda i: i + 1)[greatest(len(ids) - width + 1, 1):] AS kept
  FROM batched JOIN widths USING (batch))
SELECT instance_id, batch, md5(array_to_string(
  list_concat(list_transform(range(width - len(kept)), lambda i: 0), kept), ',')) AS digest
FROM shifted""")
def padded_batches(spark, sf):
    encoded = cut_lineage(encoded_words(spark, sf))
    return ft.pad_batches(encoded, 32, training_width(encoded)).select(
        "instance_id", "batch", _padded_digest("pre").alias("digest"))


@query("embedding_lookup", f"""
WITH {WORD_VOCAB}
SELECT idx, feature, coalesce(round(embedding[1]::DOUBLE, 5), 0.0) AS v1,
       vec_id IS NOT NULL AS found
FROM vocab LEFT JOIN embeddings ON vec_id = idx
WHERE regexp_matches(feature, '^[A-Za-z]+$')""")
def embedding_lookup(spark, sf):
    vocab = word_vocabulary(spark, sf)
    vec = table(spark, sf, "embeddings")
    vectors = vocab.join(vec, vocab["idx"] == vec["vec_id"]).select(
        "feature", F.col("embedding").alias("vector"))
    matrix = ft.embedding_matrix(vocab, vectors, "kmer", 64)
    return matrix.select(
        "idx", "feature", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("v1"), "found")


EMBEDDED = """names AS (
  SELECT idx, unnest(['PF' || idx, 'GO:' || idx, translate(idx::VARCHAR, '0123456789', 'ABCDEFGHIJ'), '#' || idx]) AS feature
  FROM (SELECT p_partkey AS idx FROM part))"""


def embedded_names(df, key):
    """A domain, a term, a word and a name of no kind for each key."""
    k = F.col(key).cast("string")
    word = F.translate(k, "0123456789", "ABCDEFGHIJ")
    names = F.array(F.concat(F.lit("PF"), k), F.concat(F.lit("GO:"), k), word, F.concat(F.lit("#"), k))
    return df.withColumn("feature", F.explode(names))


@query("embedding_match_counts", f"""
WITH {EMBEDDED}
SELECT CASE WHEN feature LIKE 'PF%' THEN 'domain' WHEN feature LIKE 'GO:%' THEN 'go' ELSE 'kmer' END AS kind,
       count(vec_id) AS n_found, count(*) AS n_features
FROM names LEFT JOIN embeddings ON vec_id = idx AND CASE WHEN feature LIKE 'PF%' THEN idx % 2 WHEN feature LIKE 'GO:%' THEN idx % 3 ELSE 0 END = 0
WHERE feature NOT LIKE '#%' GROUP BY 1""")
def embedding_match_counts(spark, sf):
    vocab = embedded_names(table(spark, sf, "part").select(F.col("p_partkey").alias("idx")), "idx").select("idx", "feature")
    every = F.when(F.col("feature").startswith("PF"), 2).when(F.col("feature").startswith("GO"), 3).otherwise(1)
    vectors = embedded_names(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    return ft.embedding_matches_by_kind(vocab, vectors.filter(F.col("vec_id") % every == 0))


# Ids and rewards -----------------------------------------------------------------------


@query("duplicate_id_suffix", """
SELECT id || repeat('|', (row_number() OVER (PARTITION BY id ORDER BY l_partkey, l_suppkey) - 1)::INT)
       AS instance_id, count(*) OVER (PARTITION BY id) AS n_same
FROM (SELECT l_orderkey || '_' || l_linenumber AS id, l_partkey, l_suppkey FROM lineitem)""")
def duplicate_id_suffix(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("instance_id"),
        "l_partkey", "l_suppkey", "l_extendedprice")
    named = li.withColumn("base", F.col("instance_id"))
    suffixed = ft.distinguish_ids(named, ["base"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    sizes = named.groupBy("base").agg(F.count("*").alias("n_same"))
    return suffixed.join(sizes, "base").select("instance_id", "n_same")


@query("domain_rewards", """
SELECT event_type AS feature, user_id AS file,
       sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS reward
FROM events GROUP BY ALL""")
def domain_rewards(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("feature"), F.col("user_id").alias("file"))
    return ft.feature_rewards(ev, F.col("file") % 2)


@query("domain_reward_signs", """
SELECT event_type AS feature, user_id AS file,
       max(CASE WHEN user_id % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS reward
FROM events GROUP BY ALL""")
def domain_reward_signs(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("feature"), F.col("user_id").alias("file"))
    return ft.feature_rewards(ev, F.col("file") % 2, "label")
