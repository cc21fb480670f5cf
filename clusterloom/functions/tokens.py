"""Explode-style tokenizers.

Sequences are first cut into bounded blocks that overlap by ``k - 1`` characters, then every
block yields its k-mers. Both cuts use one linear regex pass: positional ``substring`` walks
the string from its start, which is quadratic in the sequence length. A block is also the
largest array built per row, so one very long sequence streams through its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.functions import scalar

BLOCK = 4096


def _blocks(seq: Column, block: int, overlap: int) -> Column:
    return F.regexp_extract_all(
        seq, F.lit(f"(?s)(?=(.{{1,{block + overlap}}})).{{1,{block}}}"), F.lit(1)
    )


def explode_blocks(df: DataFrame, seq_col: str, block: int, overlap: int = 0) -> DataFrame:
    """Replace ``seq_col`` by its blocks: ``block_start`` (0-based) and ``block``."""
    rest = [c for c in df.columns if c != seq_col]
    return df.select(
        *rest, F.posexplode(_blocks(F.col(seq_col), block, overlap)).alias("_b", "block")
    ).select(
        *rest, (F.col("_b").cast("long") * block).alias("block_start"), "block"
    )


def explode_kmers(
    df: DataFrame,
    seq_col: str,
    k: int,
    feature_col: str = "feature",
    pos_col: str | None = None,
    tail: int = 0,
) -> DataFrame:
    """All overlapping substrings of length ``k`` (with at least ``tail`` characters after).

    ``pos_col`` adds the 1-based position.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rest = [c for c in df.columns if c != seq_col]
    blocks = explode_blocks(df, seq_col, BLOCK, k - 1 + tail)
    after = f".{{{tail}}}" if tail else ""
    grams = F.regexp_extract_all(
        F.col("block"), F.lit(f"(?s)(?=(.{{{k}}}){after})."), F.lit(1)
    )
    if pos_col is None:
        return blocks.select(*rest, F.explode(grams).alias(feature_col))
    return blocks.select(
        *rest, "block_start", F.posexplode(grams).alias("_i", feature_col)
    ).select(*rest, (F.col("block_start") + F.col("_i") + 1).alias(pos_col), feature_col)


def parse_size(size: str | int) -> tuple[int, int]:
    """``6`` -> (6, 6); ``"3to6"`` -> (3, 6)."""
    low, _, high = str(size).partition("to")
    lo, hi = int(low), int(high or low)
    if lo < 1 or hi < lo:
        raise ValueError(f"bad k-mer size {size!r}")
    return lo, hi


def explode_kmer_range(
    df: DataFrame, seq_col: str, size: str | int, feature_col: str = "feature",
    pos_col: str | None = None,
) -> DataFrame:
    """k-mers of every length in the range, ``"3to6"`` style, from one scan of the sequence."""
    lo, hi = parse_size(size)
    if lo == hi:
        return explode_kmers(df, seq_col, lo, feature_col, pos_col)
    rest = [c for c in df.columns if c != seq_col]
    # One pass yields the longest gram at each position (shorter at the very end); its
    # prefixes of every length in range are the k-mers that start there.
    blocks = explode_blocks(df, seq_col, BLOCK, hi - 1)
    longest = F.regexp_extract_all(
        F.col("block"), F.lit(f"(?s)(?=(.{{{lo},{hi}}}))."), F.lit(1)
    )
    # A block's overlap region starts the next block's own positions: keep starts inside BLOCK.
    grams = blocks.select(
        *rest, "block_start", F.posexplode(F.slice(longest, 1, BLOCK)).alias("_i", "_g")
    )
    out = grams.select(
        *rest, "block_start", "_i", "_g",
        F.explode(F.sequence(F.lit(lo), F.length("_g"))).alias("_k"),
    )
    gram = F.substring(F.col("_g"), F.lit(1), F.col("_k")).alias(feature_col)
    if pos_col is None:
        return out.select(*rest, gram)
    return out.select(*rest, (F.col("block_start") + F.col("_i") + 1).alias(pos_col), gram)


def explode_line_ngrams(
    df: DataFrame, content_col: str, n: int = 1, feature_col: str = "feature",
    pos_col: str = "pos",
) -> DataFrame:
    """n-grams over the lines of a content; one-character tokens are skipped.

    Accession versions (from the first dot on) are cut from the joined token.
    """
    rest = [c for c in df.columns if c != content_col]
    lines = F.split(F.col(content_col), "\n")
    if n == 1:
        exploded = df.select(*rest, F.posexplode(lines).alias("_p", "_t"))
    else:
        starts = F.when(
            F.size(lines) >= n, F.sequence(F.lit(1), F.size(lines) - n + 1)
        ).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(lines, i, n), " "))
        exploded = df.select(*rest, F.posexplode(grams).alias("_p", "_t"))
    return exploded.filter(F.length("_t") > 1).select(
        *rest, (F.col("_p").cast("long") + 1).alias(pos_col),
        scalar.strip_version(F.col("_t")).alias(feature_col),
    )


def tokenize(
    contents: DataFrame, feature_types: str, size: str | int = 6,
    property_features: DataFrame | None = None,
) -> DataFrame:
    """Typed dispatch over dataset contents (``instance_id, feature_type, content``).

    ``feature_types`` is a dash list such as ``go-kmers-domains``. Returns
    ``instance_id, file, feature_type, pos, feature``. ``property_features`` is the output of
    the protein property operators (``instance_id, file, feature``) when ``prot`` is wanted.
    """
    wanted = feature_types.split("-")
    keep = ["instance_id", "file", "feature_type"]
    parts = []
    for kind in wanted:
        if kind.startswith("kmer"):
            src = contents.filter(F.col("feature_type") == "kmers")
            parts.append(explode_kmer_range(src.select(*keep, "content"), "content", size, pos_col="pos"))
        elif kind.startswith("domain") or kind == "go":
            name = "go" if kind == "go" else "domains"
            src = contents.filter(F.col("feature_type") == name)
            parts.append(explode_line_ngrams(src.select(*keep, "content"), "content", 1))
        elif kind.startswith("prot"):
            if property_features is None:
                raise ValueError("protein properties wanted but property_features not given")
            parts.append(
                property_features.select(
                    "instance_id", "file", F.lit("protanalys").alias("feature_type"),
                    F.lit(0).cast("long").alias("pos"), "feature",
                )
            )
        else:
            raise ValueError(f"unknown feature type {kind!r}")
    out = parts[0].select(*keep, "pos", "feature")
    for part in parts[1:]:
        out = out.unionByName(part.select(*keep, "pos", "feature"))
    return out


def flatten_indexed(values: Column, name: str) -> Column:
    """Array ``[v1, v2]`` -> map ``{name-1: v1, name-2: v2}``."""
    keys = F.transform(values, lambda _v, i: F.concat(F.lit(name + "-"), (i + 1).cast("string")))
    return F.map_from_arrays(keys, values)
