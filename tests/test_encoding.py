from __future__ import annotations

import re

from pyspark.sql import functions as F

from clusterloom.bindings import features as bf
from clusterloom.operators import features as ft


def test_digest_of_padded_ids_writes_the_zeros_at_once(spark):
    rows = [(1, [4, 0, 7]), (2, []), (3, [9]), (4, [1, 2, 3, 4, 5, 6])]
    encoded = spark.createDataFrame(rows, "instance_id long, ids array<int>").withColumn("size", F.size("ids").cast("long"))
    for width in (0, 1, 4, None):
        for padding in ("post", "pre"):
            padded = encoded.withColumn("padded", ft.pad_ids(F.col("ids"), F.lit(width).cast("int"), padding))
            for r in padded.select(bf._padded_digest(padding).alias("a"), bf._digest("padded").alias("b")).collect():
                assert r["a"] == r["b"]


def test_encoding_orders_ids_by_type_file_and_place(spark):
    tokens = spark.createDataFrame(
        [(1, "b", "domains", 1, "x"), (1, "a", "domains", 2, "y"), (1, "a", "domains", 10, "x"), (1, None, "domains", 3, "z"),
         (1, "a", "go", 1, "x"), (2, "a", "domains", 1, "unknown"), (1, "a", "domains", 3, "unknown")],
        "instance_id long, file string, feature_type string, pos long, feature string")
    vocab = spark.createDataFrame([("domains", "x", 0), ("domains", "y", 1), ("domains", "z", 2), ("go", "x", 3)], "feature_type string, feature string, idx long")
    out = {r["instance_id"]: (r["ids"], r["size"]) for r in ft.encode(tokens, vocab).collect()}
    assert out == {1: ([2, 1, 0, 0, 3], 5), 2: ([], 0)}


def test_class_of_no_word_characters_is_the_one_of_the_sql(spark):
    text = "".join(map(chr, range(1, 600))) + "a.b, c.. \n\n\U0001F600x"
    got = spark.createDataFrame([(text,)], "text string").select(F.regexp_replace("text", bf.NO_WORD, "\n")).first()[0]
    assert got == re.sub("[^A-Za-z.]+", "\n", text)
