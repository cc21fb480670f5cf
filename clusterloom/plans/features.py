"""From files to vocabulary, matrix, encoded sequences and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions import protein as pr
from clusterloom.functions import scalar, tokens as tk
from clusterloom.operators import features as ft
from clusterloom.operators import learn as ln
from clusterloom.sources import readers as rd
from clusterloom.sources import writers as wr


def with_labels(contents: DataFrame) -> DataFrame:
    """Instance labels from the file names: ``instance_id, label``."""
    return contents.groupBy("instance_id").agg(
        F.max(scalar.label_from_name(scalar.base_name(F.col("file")))).alias("label"))


def protein_values(contents: DataFrame) -> DataFrame:
    """All protein properties in long form: ``instance_id, file, feature, value``."""
    src = contents.filter("feature_type = 'protanalys'").select("instance_id", "file", "content")
    whole = {**pr.composition(F.col("content")), "proteinIsoelec": pr.isoelectric_point(F.col("content"))}
    wide = F.explode(F.create_map(*[x for n, c in whole.items() for x in (F.lit(n), c)])).alias("feature", "value")
    flex = pr.flexibility_by_residue(src, ["instance_id", "file"], "content")
    return src.select("instance_id", "file", wide).filter("value IS NOT NULL").unionByName(flex)


def token_table(contents: DataFrame, feature_types: str, size: str | int) -> DataFrame:
    props = protein_values(contents) if "prot" in feature_types else None
    return tk.tokenize(contents, feature_types, size, props)


def extract_features(
    contents: DataFrame, feature_types: str, size: str | int = 6, min_occ: int = 3, path: str | None = None,
) -> DataFrame:
    """Vocabulary of a dataset (``feature_type, feature, idx``), stored when ``path`` is given."""
    vocab = ft.vocabulary(ft.feature_set(token_table(contents, feature_types, size), min_occ))
    if path:
        wr.write_table(vocab, path)
        return contents.sparkSession.read.parquet(path)
    return vocab


def feature_matrix(contents: DataFrame, vocab: DataFrame, size: str | int = 6) -> DataFrame:
    """Occurrences with the vectors of one id merged: ``instance_id, idx, cnt``."""
    has_prot = bool(contents.filter("feature_type = 'protanalys'").head(1))
    props = protein_values(contents) if has_prot else None
    return ft.merge_same_id(ft.occurrences(contents, vocab, size, props))


def encoded_dataset(
    contents: DataFrame, vocab: DataFrame, feature_types: str, size: str | int = 6, max_len: int | None = None,
) -> DataFrame:
    """Padded id sequences with labels: ``instance_id, label, size, padded``."""
    encoded = ft.encode(token_table(contents, feature_types, size), vocab)
    return ft.pad_sequences(encoded, max_len).join(with_labels(contents), "instance_id").select(
        "instance_id", "label", "size", "padded")


def train_and_predict(
    spark: SparkSession, train_path: str, test_path: str, model_path: str, feature_types: str,
    kind: str = "randomforest", size: str | int = 6, min_occ: int = 3, source_type: str = "aminoacid",
    components: int | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """Train on one folder, predict another: (``instance_id, label, prediction``, class report).

    The vocabulary and the model are stored below ``model_path`` and read back, as a later
    prediction run would.
    """
    train_contents = rd.read_dataset(spark, train_path, feature_types, source_type)
    vocab = extract_features(train_contents, feature_types, size, min_occ, f"{model_path}/vocabulary")
    n = vocab.count()

    def vectors(contents: DataFrame) -> DataFrame:
        labels = with_labels(contents)
        return ln.labelled(ln.feature_vectors(feature_matrix(contents, vocab, size), n, labels), labels)

    data, width = vectors(train_contents), n
    test = vectors(rd.read_dataset(spark, test_path, feature_types, source_type))
    if components:
        pca = ln.reduce_dimensions(data, components, f"{model_path}/pca")
        shrink = lambda df: pca.transform(df).select("instance_id", "label", F.col("reduced").alias("features"))
        data, test, width = shrink(data), shrink(test), components
    model = ln.train(data.cache(), kind, width, f"{model_path}/model", **options)
    ln.check_width(model, width)
    scored = model.transform(test).select("instance_id", "label", "prediction")
    return scored, ln.class_report(scored)
