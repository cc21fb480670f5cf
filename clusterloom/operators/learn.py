"""Classifiers, outlier labels and model evaluation on the long occurrence table.

Spark ML trains on distributed vectors. Where the original solver has no distributed form the
closest scalable one is used and named in the docstring.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clusterloom.functions.hashing import int_hash
from clusterloom.operators.corpus import positive_features_per_fold, stratified_folds
from clusterloom.operators.ordered import index_rows
from clusterloom.session import cut_lineage, hold

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows and features of a projected block.
KERNEL_ROWS, KERNEL_COLUMNS = 1024, 2048

# ------------------------------------------------------------------ vectors


def sparse_rows(occ: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """``instance_id, indices, values`` from rows ``instance_id, idx, cnt``.

    With ``instances`` there is one row for each of them; one without a feature is empty.
    """
    entries = F.array_sort(F.collect_list(F.struct("idx", "cnt")))
    rows = occ.groupBy("instance_id").agg(entries.alias("_e"))
    if instances is not None:
        rows = instances.select("instance_id").join(rows, "instance_id", "left")
    at = lambda name, kind: F.coalesce(F.transform("_e", lambda e: e[name].cast(kind)), F.array().cast(f"array<{kind}>"))
    return rows.select("instance_id", at("idx", "int").alias("indices"), at("cnt", "double").alias("values"))


def feature_vectors(occ: DataFrame, size: int, instances: DataFrame | None = None) -> DataFrame:
    """``instance_id, features``, of all ``instances`` where given. Only the final wrap into the
    vector type runs in Python."""
    wrap = F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT())
    return sparse_rows(occ, instances).select("instance_id", wrap("indices", "values").alias("features"))


def labelled(vectors: DataFrame, labels: DataFrame, id_col: str = "instance_id") -> DataFrame:
    """Add ``label`` to the vectors that have one."""
    return vectors.join(labels.select(id_col, F.col("label").cast("double").alias("label")), id_col)


#: How a column's values stand for those of its equal features: the weights of the features, which are equal,
#: then have the same penalty as the column's one weight.
SHARES = {
    "sum": lambda copies, spread: 1 / copies,  # of absolute weights, whatever the scale
    "squares": lambda copies, spread: 1 / F.sqrt(copies),
    "scaled squares": lambda copies, spread: F.when(spread > 0, 1 / (F.sqrt(copies) * spread)).otherwise(0.0),  # weights of features of deviation 1
}


def equal_columns(occ: DataFrame, n_rows: int, penalty: str) -> tuple[DataFrame, int]:
    """Features that have equal counts in all ``n_rows`` training rows as one column, ``idx, column, share``, and
    the number of columns.

    Most words are rare, so very many of them share the one or two rows they stand in. A linear model from
    zero gives equal features equal weights; ``share`` turns their counts into the column's, so that a fit on
    columns has the loss and the ``penalty`` of the fit on features, and scores follow. A feature
    without a training row has the weight 0 and no column. Equal means equal in number, sums and two
    64-bit hashes of all places.
    """
    place = lambda *salt: F.bit_xor(F.xxhash64("instance_id", F.col("cnt").cast("double"), *salt))
    cnt = F.col("cnt").cast("double")
    seen = cut_lineage(occ.groupBy("idx").agg(
        F.count("*").alias("_n"), place().alias("_h"), place(F.lit(1)).alias("_g"), F.sum(cnt).alias("_s"), F.sum(cnt * cnt).alias("_q")))
    key = ["_n", "_h", "_g"]
    same = seen.groupBy(*key).agg(F.count("*").cast("double").alias("_c"), F.max("_s").alias("_s"), F.max("_q").alias("_q"))
    placed = hold(index_rows(same, [], key, "column"))
    spread = F.sqrt(F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / n_rows) / max(n_rows - 1, 1), F.lit(0.0)))
    share = SHARES[penalty](F.col("_c"), spread)
    return hold(seen.select("idx", *key).join(placed.select(*key, "column", share.alias("share")), key).select("idx", "column", "share")), placed.count()


def on_columns(occ: DataFrame, columns: DataFrame) -> DataFrame:
    """Occurrences of columns, ``instance_id, idx, cnt``, from those of features."""
    return occ.join(columns, "idx").groupBy("instance_id", F.col("column").cast("int").alias("idx")).agg(
        F.sum(F.col("cnt") * F.col("share")).alias("cnt"))


@dataclass
class ColumnModel:
    """A model of ``numFeatures`` features that was fitted on columns of equal ones."""
    model: object
    columns: DataFrame
    n_columns: int
    numFeatures: int

    def transform(self, occ: DataFrame, instances: DataFrame) -> DataFrame:
        """Predictions of all ``instances`` from their occurrences of features."""
        return self.model.transform(feature_vectors(on_columns(occ, self.columns), self.n_columns, instances))


def _unit(*parts) -> np.ndarray:
    """Hash of whole numbers within (0, 1]."""
    h = np.uint64(42)
    for part in parts:
        h = int_hash(part, h)
    return ((h & np.uint64((1 << 40) - 1)).astype(np.float64) + 1) / float((1 << 40) + 1)


def _kernel_weights(idx: np.ndarray, components: int, gamma: float, seed: int) -> np.ndarray:
    """Normals of features by components, by Box-Muller over two hashes."""
    i, j = idx[:, None], np.arange(1, components + 1)[None]
    u, v = _unit(i, j, seed), _unit(i, j, seed + 1)
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v) * math.sqrt(2 * gamma)


def fourier_features(sparse: DataFrame, gamma: float, components: int, seed: int = 7) -> DataFrame:
    """Random Fourier features of the RBF kernel: ``instance_id, features``.

    Weights are hashed normals, so no projection matrix is stored or shipped: a task makes those of the
    features it meets, ``KERNEL_COLUMNS`` of them at a time, and projects ``KERNEL_ROWS`` rows at a time.
    """
    rows_at_a_time, columns_at_a_time = KERNEL_ROWS, KERNEL_COLUMNS

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shift = 2 * math.pi * _unit(np.arange(1, components + 1), seed + 2)
        kept, weights = np.zeros(0, np.int64), None
        for indices, values in frames:
            out = []
            for a in range(0, len(indices), rows_at_a_time):
                own, given = indices.iloc[a:a + rows_at_a_time], values.iloc[a:a + rows_at_a_time]
                row = np.repeat(np.arange(len(own)), own.map(len).to_numpy(np.int64))
                idx = np.concatenate(own.to_numpy()).astype(np.int64)
                value = np.concatenate(given.to_numpy()).astype(np.float64)
                met, place = np.unique(idx, return_inverse=True)
                dot = np.zeros((len(own), components))
                for b in range(0, len(met), columns_at_a_time):
                    part = met[b:b + columns_at_a_time]
                    if weights is None or not np.array_equal(part, kept):
                        kept, weights = part, _kernel_weights(part, components, gamma, seed)
                    here = (place >= b) & (place < b + len(part))
                    dense = np.bincount(row[here] * len(part) + place[here] - b, value[here], len(own) * len(part))
                    dot += dense.reshape(len(own), len(part)) @ weights
                out += list(math.sqrt(2 / components) * np.cos(dot + shift))
            yield pd.Series(out, dtype=object)

    project = F.pandas_udf(run, "array<double>")
    return sparse.select("instance_id", array_to_vector(project("indices", "values")).alias("features"))


# ------------------------------------------------------------------ classifiers


def classifier(kind: str, n_rows: int, n_features: int, **options):
    """Estimator with the default parameters of each kind.

    ``regParam`` is ``1 / (C n)``. Linear SVM uses the hinge loss, the perceptron sigmoid units
    and l-bfgs, as Spark offers them. ``svc`` expects Fourier features (see above).
    """
    kind = kind.lower()
    if kind == "linearsvc":
        return LinearSVC(regParam=1 / (options.pop("C", 0.01) * n_rows), **options)
    if kind == "svc":
        return LinearSVC(regParam=1 / (options.pop("C", 100) * n_rows), **options)
    if kind == "logit":
        return LogisticRegression(
            elasticNetParam=1.0, regParam=1 / (options.pop("C", 10) * n_rows), **options)
    if kind == "mlp":
        hidden = options.pop("hidden", 256)
        return MultilayerPerceptronClassifier(
            layers=[n_features, hidden, 2], blockSize=options.pop("blockSize", 256), **options)
    if kind == "randomforest":
        return RandomForestClassifier(**{
            "impurity": "entropy", "featureSubsetStrategy": "log2", "bootstrap": False,
            "numTrees": 1000, **options})
    raise ValueError(f"unknown classifier {kind!r}")


#: Features from which sums are added up before they reach the driver.
WIDE = 1 << 13
#: Columns of all models that are fitted at a time: a solver keeps some thirty numbers for each on the driver.
TOGETHER = 1 << 20


def sums_left(partitions: int, depth: int) -> int:
    """How many partial sums the last round of a tree aggregation of this depth sends to the driver."""
    scale = max(math.ceil(partitions ** (1 / depth)), 2)
    while partitions > scale + math.ceil(partitions / scale):
        partitions //= scale
    return partitions


def aggregation(partitions: int) -> tuple[int, int]:
    """Partitions, 28 at least and three fifths of them kept, and the depth by which a tree aggregation
    sends the driver the fewest sums: one or two."""
    most = max(partitions, 28)
    _, p, depth = min((sums_left(p, d), -p, d) for p in range(max(28, most * 3 // 5), most + 1) for d in range(2, 8))
    return -p, depth


def train(data: DataFrame, kind: str, n_features: int, path: str | None = None, **options):
    """Fit a classifier on ``features, label``; saved as a pipeline model when ``path`` is given.

    A step of a linear solver sends the driver sums as wide as the features: of ``WIDE`` features or more
    one or two, however many partitions there are.
    """
    n_rows = data.count()
    if kind.lower() in ("linearsvc", "logit") and n_features >= WIDE and "aggregationDepth" not in options:
        now = data.rdd.getNumPartitions()
        partitions, depth = aggregation(now)
        data = data.coalesce(partitions) if partitions <= now else data.repartition(partitions)
        options = {**options, "aggregationDepth": depth}
    model = Pipeline(stages=[classifier(kind, n_rows, n_features, **options)]).fit(data)
    if path:
        model.write().overwrite().save(path)
    return model


def input_width(model) -> int:
    """Number of features a fitted (pipeline) model expects."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    return last.numFeatures


def check_width(model, n_features: int) -> None:
    if input_width(model) != n_features:
        raise ValueError(f"model expects {input_width(model)} features, vocabulary has {n_features}")


def confidence_table(predictions: DataFrame, id_col: str = "instance_id") -> DataFrame:
    """``id, predicted, actual, confidence``: the margin of class 1."""
    return predictions.select(
        id_col, F.col("prediction").cast("int").alias("predicted"),
        F.col("label").cast("int").alias("actual"),
        F.element_at(vector_to_array("rawPrediction"), -1).alias("confidence"))


def feature_importance(model, vocab: DataFrame) -> DataFrame:
    """Importance per vocabulary feature, highest first.

    The importances are part of the model (one number per feature), already on the driver.
    """
    last = model.stages[-1] if hasattr(model, "stages") else model
    sparse = last.featureImportances
    indices = getattr(sparse, "indices", None)
    pairs = enumerate(sparse.toArray()) if indices is None else zip(indices, sparse.values)
    rows = [(int(i), float(v)) for i, v in pairs if v]
    scores = vocab.sparkSession.createDataFrame(rows, "idx long, importance double")
    return vocab.join(scores, "idx", "left").select(
        "idx", "feature", F.coalesce("importance", F.lit(0.0)).alias("importance")
    ).orderBy(F.desc("importance"), "idx")


def reduce_dimensions(train_data: DataFrame, components: int = 2, path: str | None = None):
    """PCA fitted on the training vectors, reused for other data. At most 65,535 features."""
    model = PCA(k=components, inputCol="features", outputCol="reduced").fit(train_data)
    if path:
        model.write().overwrite().save(path)
    return model


# ------------------------------------------------------------------ reports


def confusion(predictions: DataFrame) -> DataFrame:
    """Confusion matrix: ``label, pred_neg, pred_pos``."""
    return predictions.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count_if(F.col("prediction") == 0).alias("pred_neg"),
        F.count_if(F.col("prediction") == 1).alias("pred_pos"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Per class ``precision, recall, f1, support`` and the overall ``accuracy``.

    Counted in one pass; a class never predicted gets precision 0.
    """
    cells = predictions.groupBy(
        F.col("label").cast("int").alias("l"), F.col("prediction").cast("int").alias("p")
    ).agg(F.count("*").alias("n"))
    sums = cells.agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n"))).alias("right"),
        *[F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(f"{name}{c}")
          for c in (0, 1) for name, cond in (
              ("hit", (F.col("l") == c) & (F.col("p") == c)), ("real", F.col("l") == c),
              ("said", F.col("p") == c))])
    row = lambda c: F.struct(
        F.lit(c).alias("label"), F.col(f"hit{c}").alias("hit"), F.col(f"real{c}").alias("real"),
        F.col(f"said{c}").alias("said"))
    each = sums.select("total", "right", F.explode(F.array(row(0), row(1))).alias("r"))
    p = F.coalesce(F.try_divide(F.col("r.hit"), F.col("r.said")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("r.hit"), F.col("r.real")), F.lit(0.0))
    return each.select(
        "r.label", p.alias("precision"), r.alias("recall"),
        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
        F.col("r.real").alias("support"),
        F.coalesce(F.col("right") / F.col("total"), F.lit(0.0)).alias("accuracy"))


def fold_reports(predictions: DataFrame, folds: int = 5) -> DataFrame:
    """The class report of every fold of out-of-fold predictions: ``fold`` and its columns."""
    out = None
    for fold in range(folds):
        part = class_report(predictions.filter(F.col("fold") == fold)).withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return out


def grid_summary(scores: DataFrame, params: Sequence[str]) -> DataFrame:
    """Mean and twice the population deviation per parameter set."""
    return scores.groupBy(*params).agg(
        F.avg("score").alias("mean"), (2 * F.stddev_pop("score")).alias("spread"))


# ------------------------------------------------------------------ validation and search


def cross_validate(
    occ: DataFrame, labels: DataFrame, kind: str, n_features: int, folds: int = 5, seed: int = 5,
    parallelism: int = 6, **options,
):
    """Stratified folds with the per-fold feature filter.

    Returns out-of-fold predictions (``instance_id, fold, label, prediction``) and the model
    refitted on everything. Features without a positive sum in the training part are removed
    from both parts. At most ``parallelism`` of the models are fitted at a time. Linear models of ``WIDE`` features
    or more are fitted on columns of equal features, and only as many at a time as have ``TOGETHER`` columns.
    """
    assigned = cut_lineage(stratified_folds(labels, "instance_id", "label", folds, seed))
    allowed = cut_lineage(positive_features_per_fold(occ, assigned).select("fold", "idx"))
    classes = assigned.select("instance_id", "fold", F.col("label").cast("double").alias("label"))
    penalty = "scaled squares" if kind.lower() == "linearsvc" else "sum"
    wide = kind.lower() in ("linearsvc", "logit") and n_features >= WIDE
    if wide and kind.lower() == "linearsvc":
        options = {**options, "standardization": False}

    def one_fold(fold: int) -> DataFrame:
        kept = occ.join(allowed.filter(F.col("fold") == fold).select("idx"), "idx", "left_semi")
        width = n_features
        if wide:
            known = assigned.filter(F.col("fold") != fold).select("instance_id")
            columns, width = equal_columns(kept.join(known, "instance_id", "left_semi"), known.count(), penalty)
            kept = on_columns(kept, columns)
        data = cut_lineage(feature_vectors(kept, width, assigned).join(classes, "instance_id"))
        model = train(data.filter(F.col("fold") != fold), kind, width, **options)
        return model.transform(data.filter(F.col("fold") == fold)).select("instance_id", "fold", "label", "prediction")

    def refit():
        if not wide:
            return train(cut_lineage(labelled(feature_vectors(occ, n_features, labels), labels)), kind, n_features, **options)
        data = cut_lineage(labelled(feature_vectors(on_columns(occ, every), n_columns, labels), labels))
        return ColumnModel(train(data, kind, n_columns, **options), every, n_columns, n_features)

    if wide:
        every, n_columns = equal_columns(occ, assigned.count(), penalty)
        parallelism = min(parallelism, TOGETHER // max(n_columns, 1))
    # The steps of one model wait for each other and each is a small job, so the models take turns.
    with ThreadPool(max(1, min(parallelism, folds + 1))) as pool:
        jobs = [pool.apply_async(inheritable_thread_target(occ.sparkSession)(refit))]
        jobs += [pool.apply_async(inheritable_thread_target(occ.sparkSession)(one_fold), (fold,)) for fold in range(folds)]
        final, *parts = [job.get() for job in jobs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, final


# Searched parameter values.
GRID_C = (0.01, 0.1, 1, 10, 100)
GRID_TREES = (10, 100, 1000)
GRID_SUBSETS = ("sqrt", "log2")
GRID_IMPURITY = ("gini", "entropy")
GRID_HIDDEN = (64, 128, 256, 512, 1024)
GRID_BLOCKS = (32, 64, 128, 256)
#: Rows in a partition of searched data.
SEARCH_ROWS = 1 << 14
GRID_SCORES = {"f1": "fMeasureByLabel", "precision": "precisionByLabel", "recall": "recallByLabel"}


def parameter_grid(kind: str, estimator, n_rows: int, n_features: int, **limits) -> list[dict]:
    """Grid of the classifier; ``limits`` narrows a named list of values."""
    values = lambda name, default: list(limits.get(name, default))
    grid = ParamGridBuilder()
    if kind in ("linearsvc", "svc", "logit"):
        grid.addGrid(estimator.regParam, [1 / (c * n_rows) for c in values("C", GRID_C)])
    if kind == "logit":
        grid.addGrid(estimator.elasticNetParam, values("penalty", (0.0, 1.0)))
    if kind == "randomforest":
        grid.addGrid(estimator.numTrees, values("trees", GRID_TREES))
        grid.addGrid(estimator.featureSubsetStrategy, values("subsets", GRID_SUBSETS))
        grid.addGrid(estimator.impurity, values("impurity", GRID_IMPURITY))
        grid.addGrid(estimator.bootstrap, values("bootstrap", (True, False)))
    if kind == "mlp":
        grid.addGrid(estimator.layers, [[n_features, h, 2] for h in values("hidden", GRID_HIDDEN)])
        grid.addGrid(estimator.blockSize, values("blocks", GRID_BLOCKS))
    return grid.build()


def grid_search(
    data: DataFrame, kind: str, n_features: int, score: str = "f1", folds: int = 5,
    parallelism: int = 4, seed: int = 5, limits: dict | None = None, **options,
):
    """Cross-validated search for one score: (best model, rows ``params, mean, spread``).

    With an ``instance_id`` folds have equal shares of each class, as the folds of
    ``cross_validate`` have, and rows lie in a partition for each ``SEARCH_ROWS`` of them, two at
    least, since every step of a solver is a job over them.
    """
    n_rows = data.count()
    chosen = {}
    if "instance_id" in data.columns:
        fold = stratified_folds(data.select("instance_id", "label"), "instance_id", "label", folds, seed)
        data = data.join(fold.select("instance_id", F.col("fold").cast("int").alias("_fold")), "instance_id")
        data = cut_lineage(data.repartition(max(2, -(-n_rows // SEARCH_ROWS))))
        chosen = {"foldCol": "_fold"}
    estimator = classifier(kind, n_rows, n_features, **options)
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=parameter_grid(kind, estimator, n_rows, n_features, **(limits or {})),
        evaluator=MulticlassClassificationEvaluator(metricName=GRID_SCORES[score], metricLabel=1.0),
        numFolds=folds, parallelism=parallelism, seed=seed, **chosen)
    fitted = search.fit(data)
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(a), 2 * float(s))
        for m, a, s in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics, fitted.stdMetrics)]
    table = data.sparkSession.createDataFrame(rows, "params string, mean double, spread double")
    return fitted.bestModel, table


# ------------------------------------------------------------------ outlier labels


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean unsuccessful search depth in a binary tree of n points."""
    n = np.asarray(n, float)
    full = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def _grow_tree(seed: int, sample: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_h").head(sample)
        x = np.stack(pdf["x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(usable):
                nodes.append((tree, node, -1, 0.0, depth + float(_average_path(len(rows)))))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            nodes.append((tree, node, f, cut, 0.0))
            left = x[rows, f] <= cut
            todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "depth"])

    return grow


def isolation_labels(
    data: DataFrame, id_col: str, array_col: str, trees: int = 100, sample: int = 256, seed: int = 11,
) -> DataFrame:
    """Isolation-forest labels: ``id, score, prediction`` (-1 for scores above 0.5).

    Every tree grows on a hash sample of at most ``sample`` rows; rows send only the few copies
    that are sampled. The forest has under ``2 * trees * sample`` nodes, which bounds what each
    task gets.
    """
    n = data.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    draw = lambda t: F.pmod(F.xxhash64(F.col(id_col), t, F.lit(seed)), F.lit(1 << 30))
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                      lambda t: draw(t) < F.lit(int(share * (1 << 30))))
    grown = (
        data.select(F.col(id_col), F.col(array_col).cast("array<double>").alias("x"), picked.alias("_t"))
        .select(id_col, "x", F.explode("_t").alias("tree"))
        .withColumn("_h", draw(F.col("tree")))
        .groupBy("tree")
        .applyInPandas(_grow_tree(seed, sample), "tree int, node int, feature int, cut double, depth double")
    )
    forest: dict[int, dict[int, tuple]] = {}
    for r in grown.collect():  # under 2 * trees * sample nodes
        forest.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["cut"], r["depth"])
    size = float(_average_path(min(sample, n)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            total = np.zeros(len(x))
            for nodes in forest.values():
                todo = [(0, np.arange(len(x)))]
                while todo:
                    node, rows = todo.pop()
                    feature, cut, depth = nodes[node]
                    if feature < 0:
                        total[rows] += depth
                        continue
                    left = x[rows, feature] <= cut
                    todo += [(2 * node + s, rows[m]) for s, m in ((1, left), (2, ~left)) if m.any()]
            mean = total / max(len(forest), 1)
            yield pdf[[id_col]].assign(score=2.0 ** (-mean / max(size, 1e-9)))

    kind = data.schema[id_col].dataType.simpleString()
    scored = data.select(id_col, F.col(array_col).cast("array<double>").alias("x")).mapInPandas(
        score, f"{id_col} {kind}, score double")
    return scored.withColumn("prediction", F.when(F.col("score") > 0.5, -1).otherwise(1))


def _moments(data: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of ``x``; partial sums per task, then one row per matrix cell."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())])
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    cells = data.select("x").mapInPandas(partial, "i int, j int, s double")
    m = np.zeros((dim + 1, dim + 1))
    for r in cells.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # (dim + 1)^2 rows
        m[r["i"], r["j"]] = r["s"]
    mean = m[0, 1:] / m[0, 0]
    return mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)


def _with_distance(data: DataFrame, mean: np.ndarray, cov: np.ndarray) -> DataFrame:
    inverse = np.linalg.pinv(cov)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                c = np.stack(pdf["x"].to_numpy()) - mean
                yield pdf.assign(distance=np.einsum("ij,jk,ik->i", c, inverse, c))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.schema.fields)
    return data.mapInPandas(measure, fields + ", distance double")


def _value_at_share(df: DataFrame, column: str, share: float) -> float | None:
    """Smallest value that at least ``share`` of the rows do not exceed; exact, by a range sort."""
    ranked = index_rows(df.select(column), [], [column], "_rank")
    n = ranked.count()
    # The small term keeps a product such as 0.9 * 10 from being rounded up past 9.
    at = max(math.ceil(share * n - 1e-9), 1) - 1
    found = ranked.filter(F.col("_rank") == at).first()
    return found[column] if found else None


def covariance_labels(
    data: DataFrame, id_col: str, array_col: str, dim: int, contamination: float = 0.1, steps: int = 5,
) -> DataFrame:
    """Robust-covariance labels: ``id, distance, prediction``.

    Concentration steps refit mean and covariance on the closest half of the rows (up to 1/10000);
    the furthest ``contamination`` share is labelled -1, rows that tie with its border are not. ``dim``
    is limited since its square reaches the driver.
    """
    if dim > 1024:
        raise ValueError("reduce the dimensions first: at most 1024")
    rows = cut_lineage(data.select(id_col, F.col(array_col).cast("array<double>").alias("x")))
    mean, cov = _moments(rows, dim)
    for _ in range(steps):
        near = _with_distance(rows, mean, cov)
        half = near.agg(F.percentile_approx("distance", 0.5, 10000)).first()[0]
        mean, cov = _moments(near.filter(F.col("distance") <= half), dim)
    final = _with_distance(rows, mean, cov).drop("x")
    cutoff = _value_at_share(final, "distance", 1 - contamination)
    return final.withColumn("prediction", F.when(F.col("distance") > cutoff, -1).otherwise(1))


#: Rows compared at a time, neighbouring rows whose least distance bounds what is looked at, pairs measured at a time.
NEAR_ROWS, NEAR_SPAN, NEAR_PAIRS = 256, 64, 1 << 17


def closest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of ``y`` with another id for each row of ``x``, ties by id: rows, their places in ``y``, distances.

    One product gives all distances but for rounding. The least of every few neighbouring rows come from one pass;
    no more than the k-th of these, and the rounding, can be among the k nearest, so only such pairs are measured and sorted.
    """
    square = (y**2).sum(1)
    far = np.append(y, square[:, None], 1).T.copy()
    slack = 1e-12 * (1 + (x**2).sum(1).max() + square.max())
    order = np.argsort(others, kind="stable")
    first, last = (np.searchsorted(others, ids, side, sorter=order) for side in ("left", "right"))
    spans = np.arange(0, len(y), NEAR_SPAN)
    found = []
    for a in range(0, len(x), NEAR_ROWS):
        part = x[a:a + NEAR_ROWS]
        d = np.append(-2 * part, np.ones((len(part), 1)), 1) @ far
        own = last[a:a + NEAR_ROWS] - first[a:a + NEAR_ROWS]
        begin = np.repeat(first[a:a + NEAR_ROWS] - np.cumsum(own) + own, own)
        d[np.repeat(np.arange(len(part)), own), order[begin + np.arange(own.sum())]] = np.inf
        if len(spans) > k:
            bound = np.partition(np.minimum.reduceat(d, spans, axis=1), k - 1, axis=1)[:, k - 1]
        elif d.shape[1] > k:
            bound = np.partition(d, k - 1, axis=1)[:, k - 1]
        else:
            bound = np.full(len(part), np.inf)
        row, near = np.nonzero((d <= bound[:, None] + slack) & np.isfinite(d))
        exact = np.concatenate([np.zeros(0), *(
            np.sqrt(((part[row[i:i + NEAR_PAIRS]] - y[near[i:i + NEAR_PAIRS]]) ** 2).sum(1)) for i in range(0, len(row), NEAR_PAIRS))])
        by = np.lexsort((others[near], exact, row))
        row, near, exact = row[by], near[by], exact[by]
        count = np.bincount(row, minlength=len(part))
        kept = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) < k
        found.append((a + row[kept], near[kept], exact[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


def nearest_neighbours(
    data: DataFrame, id_col: str, array_col: str, k: int = 20, block: int = 16384,
) -> DataFrame:
    """The k nearest other rows of every row: ``id, other, distance``; exact at every size.

    Rows fall into hash blocks of at most about ``block``, four of them as soon as an eighth of that
    fills each, so that few rows occupy several tasks too. Each pair of blocks is one bounded task
    that keeps k candidates per row; the candidates are merged. The work is quadratic in the rows, as
    exact neighbours in many dimensions are; every row is sent once for each block, in its own type,
    so larger blocks and narrower types send less.
    """
    kind = data.schema[id_col].dataType.simpleString()
    rows = data.select(id_col, F.col(array_col).alias("x"))
    n = rows.count()
    count = max(1, -(-n // block), min(4, -(-n * 8 // block)))
    placed = rows.withColumn("_own", F.pmod(F.xxhash64(id_col), F.lit(count)))
    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))
    asked = placed.select(id_col, "x", F.col("_own").alias("_q"), every.alias("_b"))
    given = placed.select(id_col, "x", every.alias("_q"), F.col("_own").alias("_b"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, others = left[id_col].to_numpy(), right[id_col].to_numpy()
        if not len(ids) or not len(others):
            return pd.DataFrame({id_col: ids[:0], "other": ids[:0], "distance": np.zeros(0)})
        x, y = np.stack(left["x"].to_numpy()).astype(np.float64), np.stack(right["x"].to_numpy()).astype(np.float64)
        row, near, distance = closest(x, y, ids, others, k)
        return pd.DataFrame({id_col: ids[row], "other": others[near], "distance": distance})

    found = asked.groupBy("_q", "_b").cogroup(given.groupBy("_q", "_b")).applyInPandas(
        nearest, f"{id_col} {kind}, other {kind}, distance double")
    order = W.partitionBy(id_col).orderBy("distance", "other")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def local_outliers(neighbours: DataFrame, id_col: str, offset: float = 1.5) -> DataFrame:
    """Local outlier factors from a neighbour table: ``id, factor, prediction``."""
    fixed = cut_lineage(neighbours)
    reach = fixed.groupBy(F.col(id_col).alias("other")).agg(F.max("distance").alias("_k"))
    density = fixed.join(reach, "other").groupBy(id_col).agg(
        (1 / (F.avg(F.greatest("distance", "_k")) + 1e-10)).alias("_lrd"))
    around = density.select(F.col(id_col).alias("other"), F.col("_lrd").alias("_other"))
    return (
        fixed.join(around, "other").groupBy(id_col).agg(F.avg("_other").alias("_m"))
        .join(density, id_col)
        .select(id_col, (F.col("_m") / F.col("_lrd")).alias("factor"))
        .withColumn("prediction", F.when(F.col("factor") > offset, -1).otherwise(1))
    )
