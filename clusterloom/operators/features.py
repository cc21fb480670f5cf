"""Vocabulary, occurrence and encoding operators over tokens.

Tables: contents ``instance_id, file, feature_type, content``; tokens ``instance_id, file,
feature_type, pos, feature``; vocabulary ``feature_type, feature, idx``; occurrences
``instance_id, idx, cnt`` (long and sparse: a dense matrix never exists).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.tokens import explode_kmer_range, explode_line_ngrams, parse_size
from clusterloom.operators.ordered import index_rows


def type_rank(feature_type: Column) -> Column:
    """k-mers first, then protein properties, then the rest."""
    return (
        F.when(feature_type.startswith("kmer"), 0)
        .when(feature_type.startswith("prot"), 1)
        .otherwise(2)
    )


def kmer_counts(
    df: DataFrame, seq_col: str, size: str | int = 6, min_occ: int = 3
) -> DataFrame:
    """Corpus count per k-mer, kept from ``min_occ`` on: ``feature, cnt``."""
    return (
        explode_kmer_range(df.select(seq_col), seq_col, size)
        .groupBy("feature")
        .agg(F.count("*").alias("cnt"))
        .filter(F.col("cnt") >= min_occ)
    )


def feature_set(tokens: DataFrame, min_occ: int = 3) -> DataFrame:
    """Distinct features per type; ``min_occ`` applies to k-mers only: ``feature_type, feature, cnt``."""
    return (
        tokens.groupBy("feature_type", "feature")
        .agg(F.count("*").alias("cnt"))
        .filter(~F.col("feature_type").startswith("kmer") | (F.col("cnt") >= min_occ))
    )


def vocabulary(features: DataFrame) -> DataFrame:
    """Dense 0-based index over (type rank, feature); a distributed sort, no driver list."""
    ranked = features.select(
        "feature_type", "feature", type_rank(F.col("feature_type")).alias("_rank")
    ).distinct()
    return index_rows(ranked, [], ["_rank", "feature", "feature_type"], "idx").drop("_rank")


def overlaps_itself(feature: Column, max_len: int) -> Column:
    """True when two occurrences of ``feature`` can overlap (it has a border).

    The shortest border is at most half the length, so only those lengths are compared.
    """
    out = F.lit(False)
    for b in range(1, max_len // 2 + 1):
        out = out | (
            (F.length(feature) >= 2 * b)
            & (F.substring(feature, 1, b) == F.substring(feature, -b, b))
        )
    return out


def greedy_count(positions: Column, width: Column) -> Column:
    """Left-to-right count of positions at least ``width`` apart."""
    start = F.struct(F.lit(-(1 << 62)).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, p: Column) -> Column:
        return F.when(
            p >= acc["last"] + width,
            F.struct(p.alias("last"), (acc["n"] + 1).alias("n")),
        ).otherwise(acc)

    return F.aggregate(F.array_sort(positions), start, step, lambda acc: acc["n"])


def kmer_occurrences(contents: DataFrame, size: str | int, key: list[str] | None = None) -> DataFrame:
    """Non-overlapping k-mer counts per instance: ``key…, feature, cnt``.

    A k-mer that cannot overlap itself is counted by a plain hash aggregate. Only the others
    (a few percent of all positions) keep positions, at most one list entry per character of
    one sequence. Contents are dealt by key before they are cut, so that no k-mer is shuffled.
    """
    key = key or ["instance_id", "feature_type"]
    hi = parse_size(size)[1]
    contents = contents.select(*key, "content").repartition(*key)
    grams = explode_kmer_range(contents, "content", size)
    plain = (
        grams.filter(~overlaps_itself(F.col("feature"), hi))
        .groupBy(*key, "feature")
        .agg(F.count("*").alias("cnt"))
    )
    if hi == 1:
        return plain
    placed = explode_kmer_range(contents, "content", size, pos_col="pos")
    selfish = (
        placed.filter(overlaps_itself(F.col("feature"), hi))
        .groupBy(*key, "feature")
        .agg(F.collect_list("pos").alias("_at"))
        .select(*key, "feature", greedy_count(F.col("_at"), F.length("feature")).alias("cnt"))
    )
    return plain.unionByName(selfish)


def occurrences(
    contents: DataFrame, vocab: DataFrame, size: str | int = 6,
    property_values: DataFrame | None = None, owner: str | None = None,
) -> DataFrame:
    """Instance x vocabulary counts in long form: ``instance_id, feature_type, idx, cnt``.

    With ``owner``, a column of ``contents``, the counts of all instances of one owner are summed
    under its id, before the vocabulary join and without a row per instance where none is needed.

    Counts are taken per instance first, so the vocabulary join sees one row per distinct
    feature of an instance. ``property_values`` (``instance_id, feature, value``) adds protein
    properties, whose indices are disjoint from the others.
    """
    key = ["instance_id", "feature_type"]
    if owner is not None:
        if property_values is not None:
            raise ValueError("property values belong to instances, not to owners")
        return _owned_occurrences(contents, vocab, size, owner)
    kmers = kmer_occurrences(contents.filter(F.col("feature_type") == "kmers"), size, key)
    lines = (
        explode_line_ngrams(
            contents.filter(F.col("feature_type").isin("domains", "go")).select(*key, "content"),
            "content", 1,
        )
        .groupBy(*key, "feature")
        .agg(F.count("*").alias("cnt"))
    )
    counts = kmers.unionByName(lines).withColumn("cnt", F.col("cnt").cast("double"))
    if property_values is not None:
        counts = counts.unionByName(
            property_values.select(
                "instance_id", F.lit("protanalys").alias("feature_type"), "feature",
                F.col("value").cast("double").alias("cnt"),
            )
        )
    return counts.join(vocab, ["feature_type", "feature"]).select(
        "instance_id", "feature_type", "idx", "cnt"
    )


def _owned_occurrences(contents: DataFrame, vocab: DataFrame, size: str | int, owner: str) -> DataFrame:
    """Only k-mers that can overlap themselves are counted by instance; all other counts just add up."""
    hi = parse_size(size)[1]
    kmers = contents.filter(F.col("feature_type") == "kmers").select("instance_id", "feature_type", F.col(owner).alias("_owner"), "content")
    lines = contents.filter(F.col("feature_type").isin("domains", "go")).select("feature_type", F.col(owner).alias("_owner"), "content")
    grams = explode_kmer_range(kmers.drop("instance_id"), "content", size).filter(~overlaps_itself(F.col("feature"), hi))
    plain = grams.select("_owner", "feature_type", "feature").unionByName(
        explode_line_ngrams(lines, "content", 1).select("_owner", "feature_type", "feature"))
    by_owner = ["_owner", "feature_type", "feature"]
    counts = plain.groupBy(*by_owner).agg(F.count("*").alias("cnt"))
    if hi > 1:
        placed = explode_kmer_range(kmers.repartition("instance_id"), "content", size, pos_col="pos")
        selfish = placed.filter(overlaps_itself(F.col("feature"), hi)).groupBy("instance_id", *by_owner).agg(
            greedy_count(F.collect_list("pos"), F.length("feature")).alias("cnt"))
        counts = counts.unionByName(selfish.groupBy(*by_owner).agg(F.sum("cnt").alias("cnt")))
    return counts.join(vocab, ["feature_type", "feature"]).select(
        F.col("_owner").alias("instance_id"), "feature_type", "idx", F.col("cnt").cast("double").alias("cnt"))


def merge_same_id(occ: DataFrame, id_col: str = "instance_id") -> DataFrame:
    """Element-wise sum of the vectors of one id; disjoint index ranges concatenate."""
    return occ.groupBy(id_col, "idx").agg(F.sum("cnt").alias("cnt"))


def complete_instances(tokens: DataFrame, n_types: int) -> DataFrame:
    """Ids that carry all ``n_types`` feature types."""
    return (
        tokens.groupBy("instance_id")
        .agg(F.countDistinct("feature_type").alias("n_types"))
        .filter(F.col("n_types") >= n_types)
    )


def features_per_instance(tokens: DataFrame) -> DataFrame:
    """Ordered feature list of an instance over all its files: ``instance_id, features``."""
    entry = F.struct("feature_type", "file", "pos", "feature")
    return tokens.groupBy("instance_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["feature"]).alias("features")
    )


def domain_files(tokens: DataFrame, label: Column) -> tuple[DataFrame, DataFrame]:
    """Inverted index: (``feature, file`` pairs with counts, ``feature, n_files, label``).

    A domain is positive when any of its files is. Pairs stay rows: a frequent domain never
    becomes one list.
    """
    pairs = tokens.groupBy("feature", "file").agg(
        F.count("*").alias("cnt"), F.max(label).alias("label")
    )
    labels = pairs.groupBy("feature").agg(
        F.count("*").alias("n_files"), F.max("label").alias("label")
    )
    return pairs, labels


def encode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Vocabulary ids of an instance in order, unknown features dropped: ``instance_id, ids, size``."""
    known = tokens.join(vocab, ["feature_type", "feature"], "left")
    # Both groupings work where the rows of an instance meet; an id does not carry the names of its file along.
    by_file = known.select("instance_id", "feature_type", "file", "pos", "idx").repartition("instance_id").groupBy(
        "instance_id", "feature_type", "file").agg(
        F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("pos", F.col("idx").cast("int").alias("idx"))))).alias("_ids"))
    listed = F.array_sort(F.collect_list(F.struct("feature_type", "file", F.col("_ids.idx").alias("idx"))))
    return by_file.groupBy("instance_id").agg(F.flatten(listed["idx"]).alias("ids")).withColumn("size", F.size("ids").cast("long"))


def max_length(encoded: DataFrame) -> DataFrame:
    return encoded.agg(F.max("size").alias("max_len"))


def pad_ids(ids: Column, length: Column, padding: str = "post") -> Column:
    """Ids shifted by one (0 is padding), the last ``length`` kept, padded to ``length``."""
    shifted = F.transform(ids, lambda i: i + 1)
    kept = F.slice(shifted, F.greatest(F.size(shifted) - length + 1, F.lit(1)), length)
    fill = F.array_repeat(F.lit(0), F.greatest(length - F.size(kept), F.lit(0)))
    return F.concat(kept, fill) if padding == "post" else F.concat(fill, kept)


def pad_sequences(encoded: DataFrame, max_len: int | None = None) -> DataFrame:
    """Post-padded ``padded`` arrays; ``max_len`` defaults to the longest instance."""
    if max_len is not None:
        return encoded.withColumn("padded", pad_ids(F.col("ids"), F.lit(max_len)))
    longest = max_length(encoded).scalar()
    return encoded.withColumn("max_len", longest).withColumn(
        "padded", pad_ids(F.col("ids"), F.col("max_len").cast("int"))
    )


def pad_batches(
    encoded: DataFrame, batch_size: int, max_len: int | None = None, padding: str = "pre"
) -> DataFrame:
    """Batches of consecutive instances padded to ``min(max_len, longest in batch)``."""
    placed = index_rows(encoded, [], ["instance_id"], "_row").withColumn(
        "batch", F.floor(F.col("_row") / batch_size)
    )
    longest = placed.groupBy("batch").agg(F.max("size").cast("int").alias("_longest"))
    width = F.col("_longest") if max_len is None else F.least(F.col("_longest"), F.lit(max_len))
    return (
        placed.join(longest, "batch")
        .withColumn("padded", pad_ids(F.col("ids"), width, padding))
        .drop("_longest", "_row")
    )


def distinguish_ids(df: DataFrame, keys: list[str], order: list[str], id_col: str = "instance_id") -> DataFrame:
    """Append one ``|`` per earlier row with the same id (within ``keys``)."""
    return (
        index_rows(df, keys, order, "_nth")
        .withColumn(id_col, F.concat(F.col(id_col), F.repeat(F.lit("|"), F.col("_nth").cast("int"))))
        .drop("_nth")
    )


#: What features of each kind with vectors look like.
EMBEDDED_KINDS = {"domain": r"^PF\d", "go": "^GO:", "kmer": r"^\p{L}+$"}


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, kind: str, dim: int) -> DataFrame:
    """Vector per vocabulary feature of one kind, zeros when missing: ``idx, feature, vector, found``."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (
        vocab.filter(F.col("feature").rlike(EMBEDDED_KINDS[kind]))
        .join(vectors.select("feature", "vector"), "feature", "left")
        .select("idx", "feature", F.coalesce("vector", zeros).alias("vector"),
                F.col("vector").isNotNull().alias("found"))
    )


def embedding_matches(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        F.count_if("found").alias("n_found"), F.count("*").alias("n_features")
    )


def embedding_matches_by_kind(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """``kind, n_found, n_features`` of all kinds in one join; a kind without a feature has no row."""
    kind = F.coalesce(*(F.when(F.col("feature").rlike(p), F.lit(k)) for k, p in EMBEDDED_KINDS.items()))
    known = vectors.filter("vector IS NOT NULL").select("feature").distinct().withColumn("_found", F.lit(True))
    return (
        vocab.select("feature", kind.alias("kind")).filter("kind IS NOT NULL").join(known, "feature", "left")
        .groupBy("kind").agg(F.count("_found").alias("n_found"), F.count("*").alias("n_features"))
    )


def feature_rewards(tokens: DataFrame, label: Column, kind: str = "occ") -> DataFrame:
    """+1 per positive, -1 per negative occurrence, by (feature, file): ``feature, file, reward``.

    ``occ`` sums the occurrences; ``label`` keeps the sign only.
    """
    sign = F.when(label == 1, 1).otherwise(-1)
    fold = F.sum(sign) if kind == "occ" else F.max(sign)
    return tokens.groupBy("feature", "file").agg(fold.cast("long").alias("reward"))
