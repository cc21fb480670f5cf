"""Learning queries: embeddings as vectors, words of labelled documents as sparse features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clusterloom.bindings import ORACLES, query, table
from clusterloom.bindings.features import counted_vocabulary, word_counts
from clusterloom.bindings.files import scratch
from clusterloom.operators import features as ft
from clusterloom.operators import learn as ln
from clusterloom.operators import margin as mg
from clusterloom.session import cut_lineage
from clusterloom.sources import readers as rd
from clusterloom.sources import writers as wr


def embedded(spark, sf):
    """Vectors; the class is the sign of the first two components' sum, which a model can learn."""
    first = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("instance_id"), "embedding",
        array_to_vector("embedding").alias("features"),
        F.when(first(1) + first(2) > 0, 1.0).otherwise(0.0).alias("label"))


def dimension(spark, sf) -> int:
    return embedded(spark, sf).agg(F.max(F.size("embedding"))).first()[0]


def word_data(spark, sf):
    """Labelled documents, whose class is whether they are English: occurrences, labels, vocabulary."""
    counts = word_counts(spark, sf)
    vocab = cut_lineage(counted_vocabulary(counts))
    labels = table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("instance_id"), F.coalesce(F.col("lang") == "en", F.lit(False)).cast("int").alias("label"))
    occ = ft.merge_same_id(
        counts.join(labels.select("instance_id"), "instance_id", "left_semi").withColumn("cnt", F.col("cnt").cast("double"))
        .join(vocab, ["feature_type", "feature"]).select("instance_id", "idx", "cnt"))
    return cut_lineage(occ), labels, vocab


@query("sparse_feature_rows", """
SELECT vec_id AS instance_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings""")
def sparse_feature_rows(spark, sf):
    occ = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("instance_id"), F.posexplode("embedding").alias("idx", "cnt"))
    return ln.sparse_rows(occ).select(
        "instance_id", F.size("indices").cast("long").alias("n"),
        F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


# Fitted values depend on the solver, so SQL checks which held-out rows are scored, their labels, and
# that the model has learned: its accuracy there lies well above the share of the larger class.

def held_out(column="instance_id"):
    return F.col(column) % 5 == 0


def on_held_out(data, fit):
    """Fit on the training rows, score the others."""
    data = cut_lineage(data)
    model = fit(data.filter(~held_out()))
    return model, model.transform(data.filter(held_out()))


#: What a model's held-out accuracy must have over the larger class, as a share of the errors that
#: always saying the larger class makes.
MARGIN = 0.3


def beats_majority(scored):
    """One row ``learned``: whether a third of the majority's errors or more are avoided."""
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    larger = F.greatest(F.avg("label"), 1 - F.avg("label"))
    return scored.agg((right >= larger + MARGIN * (1 - larger)).alias("learned"))


def _scored(scored):
    scored = cut_lineage(scored.select("instance_id", "label", "prediction"))
    return scored.select("instance_id", F.col("label").cast("long").alias("label")).withColumn("learned", beats_majority(scored).scalar())


def word_columns(spark, sf, penalty):
    """Occurrences of columns, labels and the number of columns: words that stand alike in all training rows are one."""
    occ, labels, vocab = word_data(spark, sf)
    columns, n = ln.equal_columns(occ.filter(~held_out()), labels.filter(~held_out()).count(), penalty)
    return ln.on_columns(occ, columns), labels, n


def word_vectors(spark, sf, penalty):
    occ, labels, n = word_columns(spark, sf, penalty)
    return ln.labelled(ln.feature_vectors(occ, n, labels), labels), n


ENGLISH = "SELECT doc_id AS instance_id, coalesce(lang = 'en', FALSE)::BIGINT AS label FROM labels JOIN documents USING (doc_id)"
SIGN = "SELECT vec_id AS instance_id, (embedding[1]::DOUBLE + embedding[2]::DOUBLE > 0)::BIGINT AS label FROM embeddings"
HELD_WORDS = f"SELECT *{{}} FROM ({ENGLISH}) WHERE instance_id % 5 = 0"
HELD_VECTORS = f"SELECT *{{}} FROM ({SIGN}) WHERE instance_id % 5 = 0"


@query("linear_svm_predictions", HELD_WORDS.format(", TRUE AS learned"))
def linear_svm_predictions(spark, sf):
    # Columns are scaled already.
    data, n = word_vectors(spark, sf, "scaled squares")
    return _scored(on_held_out(data, lambda d: ln.train(d, "linearsvc", n, standardization=False))[1])


@query("squared_hinge_predictions", HELD_WORDS.format(", TRUE AS learned"))
def squared_hinge_predictions(spark, sf):
    occ, labels, n = word_columns(spark, sf, "squares")
    rows = cut_lineage(ln.sparse_rows(occ, labels).join(labels, "instance_id"))
    model = mg.fit_squared_hinge(rows.filter(~held_out()), n)
    scored = mg.margins(rows.filter(held_out()), model).join(labels, "instance_id")
    return _scored(scored)


@query("logistic_confidences", HELD_WORDS.format(", TRUE AS agrees, TRUE AS learned"))
def logistic_confidences(spark, sf):
    """The margin's sign is the predicted class, of every held-out instance."""
    data, n = word_vectors(spark, sf, "sum")
    model, scored = on_held_out(data, lambda d: ln.train(d, "logit", n))
    ln.check_width(model, n)
    scored = cut_lineage(scored.select("instance_id", "label", "prediction", "rawPrediction"))
    return ln.confidence_table(scored).select(
        "instance_id", F.col("actual").cast("long").alias("label"), ((F.col("confidence") > 0) == (F.col("predicted") == 1)).alias("agrees")
    ).withColumn("learned", beats_majority(scored).scalar())


@query("kernel_svm_predictions", HELD_VECTORS.format(", TRUE AS learned"))
def kernel_svm_predictions(spark, sf):
    occ = embedded(spark, sf).select("instance_id", F.posexplode("embedding").alias("idx", "cnt"))
    labels = embedded(spark, sf).select("instance_id", "label")
    data = ln.labelled(ln.fourier_features(ln.sparse_rows(occ), 1 / dimension(spark, sf), 512), labels)
    return _scored(on_held_out(data, lambda d: ln.train(d, "svc", 512))[1])


@query("perceptron_predictions", HELD_VECTORS.format(", TRUE AS learned"))
def perceptron_predictions(spark, sf):
    n = dimension(spark, sf)
    return _scored(on_held_out(embedded(spark, sf), lambda d: ln.train(d, "mlp", n, seed=1))[1])


@query("forest_importances", """
WITH d AS (SELECT max(len(embedding)) AS n FROM embeddings)
SELECT i AS idx, 'dim-' || (i + 1) AS feature, i < 2 AS leading, 1.0::DOUBLE AS total FROM d, unnest(range(n)) AS t(i)""")
def forest_importances(spark, sf):
    """Importances of all features by the default forest; the two that make the class lead."""
    data = cut_lineage(embedded(spark, sf))
    n = dimension(spark, sf)
    model = ln.train(data, "randomforest", n, seed=1)
    names = data.select(F.posexplode("embedding").alias("idx", "_v")).select(
        F.col("idx").cast("long").alias("idx"), F.concat(F.lit("dim-"), (F.col("idx") + 1).cast("string")).alias("feature")).distinct()
    out = cut_lineage(ln.feature_importance(model, names))
    total = out.agg(F.round(F.sum("importance"), 6).alias("total"))
    third = out.agg(F.get(F.reverse(F.array_sort(F.collect_list("importance"))), F.lit(2)).alias("third"))  # one number per feature
    return out.withColumn("_third", third.scalar()).select("idx", "feature", (F.col("importance") > F.col("_third")).alias("leading")).withColumn(
        "total", total.scalar())


@query("forest_predictions", HELD_VECTORS.format(", TRUE AS learned"))
def forest_predictions(spark, sf):
    n = dimension(spark, sf)
    return _scored(on_held_out(embedded(spark, sf), lambda d: ln.train(d, "randomforest", n, seed=1))[1])


@query("reduced_dimensions", "SELECT count(*) AS n, TRUE AS ordered, 0.0::DOUBLE AS correlation FROM embeddings")
def reduced_dimensions(spark, sf):
    """Components of falling variance without correlation."""
    from pyspark.ml.functions import vector_to_array

    data = embedded(spark, sf)
    out = ln.reduce_dimensions(data, 2).transform(data)
    xy = vector_to_array("reduced")
    both = out.select(F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"))
    return both.agg(F.count("*").alias("n"), (F.variance("x") >= F.variance("y")).alias("ordered"),
                    (F.abs(F.round(F.corr("x", "y"), 4))).alias("correlation"))


_PREDICTED = {}


def out_of_fold(spark, sf):
    """Out-of-fold predictions, made once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PREDICTED:
        occ, labels, vocab = word_data(spark, sf)
        _PREDICTED.clear()
        _PREDICTED[key] = cut_lineage(ln.cross_validate(occ, labels, "logit", vocab.count())[0])
    return _PREDICTED[key]


@query("cross_validated_report", f"""
SELECT label::INT AS label, count(*) AS support, TRUE AS learned FROM ({ENGLISH}) GROUP BY label""")
def cross_validated_report(spark, sf):
    """Every labelled instance is predicted in exactly one fold, by models that have learned."""
    out = out_of_fold(spark, sf)
    report = ln.class_report(out).withColumn("_l", beats_majority(out).scalar())
    good = (F.col("f1") > 0.5) & F.col("precision").between(0, 1) & F.col("recall").between(0, 1)
    return report.select("label", "support", (F.col("_l") & good).alias("learned"))


@query("fold_reports", f"""
SELECT fold, label, TRUE AS learned FROM unnest(range(5)) AS f(fold), (VALUES (0), (1)) AS l(label)""")
def fold_reports(spark, sf):
    """A report per fold: both classes of each fold are found."""
    return ln.fold_reports(out_of_fold(spark, sf)).select(F.col("fold").cast("long").alias("fold"), "label", (F.col("f1") > 0.4).alias("learned"))


#: Classifiers whose grids are searched, whole.
SEARCHED = ("logit", "randomforest", "mlp")


@query("grid_search_scores", """
SELECT kind, n, TRUE AS complete, TRUE AS learned FROM (VALUES ('logit', 10), ('randomforest', 24), ('mlp', 20)) AS t(kind, n)""")
def grid_search_scores(spark, sf):
    """Whole grids by two folds of equal class shares: all parameter sets have a score, the best one's is high."""
    data = cut_lineage(embedded(spark, sf).select("instance_id", "features", "label"))
    n_features = dimension(spark, sf)
    out = None
    for kind in SEARCHED:
        _, scores = ln.grid_search(data, kind, n_features, "f1", folds=2, parallelism=8)
        one = scores.agg(F.count("*").cast("int").alias("n"), (F.count_if(F.col("mean").between(0, 1)) == F.count("*")).alias("complete"),
                         (F.max("mean") > 0.65).alias("learned")).select(F.lit(kind).alias("kind"), "n", "complete", "learned")
        out = one if out is None else out.unionByName(one)
    return out


RULE = "CASE WHEN (toxic = 1 OR doc_id % 3 = 0) THEN 1 ELSE 0 END"


def rule_predictions(spark, sf):
    said = F.when((F.col("toxic") == 1) | (F.col("doc_id") % 3 == 0), 1).otherwise(0)
    return table(spark, sf, "labels").select(F.col("quality").alias("label"), said.alias("prediction"))


@query("confusion_matrix", f"""
SELECT quality AS label, count(*) FILTER (p = 0) AS pred_neg, count(*) FILTER (p = 1) AS pred_pos
FROM (SELECT quality, {RULE} AS p FROM labels) GROUP BY quality""")
def confusion_matrix(spark, sf):
    return ln.confusion(rule_predictions(spark, sf))


@query("class_report", f"""
WITH d AS (SELECT quality AS l, {RULE} AS p FROM labels),
c(label) AS (VALUES (0), (1)),
s AS (SELECT label, count(*) FILTER (l = label AND p = label) AS hit, count(*) FILTER (l = label) AS real,
             count(*) FILTER (p = label) AS said, (SELECT avg(CASE WHEN l = p THEN 1.0 ELSE 0.0 END) FROM d) AS acc
      FROM c, d GROUP BY label)
SELECT label, round(hit / said, 6) AS precision, round(hit / real, 6) AS recall, round(2.0 * hit / (said + real), 6) AS f1,
       real AS support, round(acc::DOUBLE, 6) AS accuracy FROM s""")
def class_report(spark, sf):
    out = ln.class_report(rule_predictions(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy")})


@query("report_round_trip", ORACLES["class_report"])
def report_round_trip(spark, sf):
    """The class report as the report sink wrote it."""
    path = scratch(spark, "report")
    wr.write_report(ln.class_report(rule_predictions(spark, sf)), path)
    out = rd.read_report(spark, path, "label long, precision double, recall double, f1 double, support long, accuracy double")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy")})


@query("grid_score_summary", """
SELECT event_type, user_id % 5 AS fold_group, round(avg(value), 6) AS mean, round(2 * stddev_pop(value), 6) AS spread FROM events GROUP BY ALL""")
def grid_score_summary(spark, sf):
    ev = table(spark, sf, "events").select("event_type", (F.col("user_id") % 5).alias("fold_group"), F.col("value").alias("score"))
    return ln.grid_summary(ev, ["event_type", "fold_group"]).withColumns(
        {c: F.round(c, 6) for c in ("mean", "spread")})


def with_far_rows(spark, sf):
    """Vectors, and copies of a fiftieth of them far out along their own direction, by negative ids."""
    data = embedded(spark, sf).select("instance_id", "embedding")
    far = data.filter(F.col("instance_id") % 50 == 0).select(
        (-F.col("instance_id") - 1).alias("instance_id"), F.transform("embedding", lambda x: (x * 20).cast("float")).alias("embedding"))
    return data.unionByName(far)


FAR = "SELECT -vec_id - 1 AS instance_id FROM embeddings WHERE vec_id % 50 = 0"


@query("isolation_outliers", f"""
SELECT vec_id AS instance_id, TRUE AS is_share, TRUE AS agrees, TRUE AS far_is_found, TRUE AS far_scores_higher FROM embeddings
UNION ALL SELECT instance_id, TRUE, TRUE, TRUE, TRUE FROM ({FAR})""")
def isolation_outliers(spark, sf):
    """Rows planted far out are labelled, and score above all others' mean."""
    out = cut_lineage(ln.isolation_labels(with_far_rows(spark, sf), "instance_id", "embedding"))
    mean = out.filter("instance_id >= 0").agg(F.avg("score").alias("m"))
    far = F.col("instance_id") < 0
    return out.withColumn("_m", mean.scalar()).select(
        "instance_id", F.col("score").between(0, 1).alias("is_share"), ((F.col("score") > 0.5) == (F.col("prediction") == -1)).alias("agrees"),
        (~far | (F.col("prediction") == -1)).alias("far_is_found"), (~far | (F.col("score") > F.col("_m"))).alias("far_scores_higher"))


@query("covariance_outliers", f"""
SELECT (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM ({FAR})) AS n, (SELECT count(*) FROM ({FAR})) AS far_found, 0.1::DOUBLE AS labelled""")
def covariance_outliers(spark, sf):
    """A tenth is labelled, and in it all rows planted far out."""
    out = ln.covariance_labels(with_far_rows(spark, sf), "instance_id", "embedding", dimension(spark, sf))
    hit = F.col("prediction") == -1
    return out.agg(F.count("*").alias("n"), F.count_if(hit & (F.col("instance_id") < 0)).alias("far_found"),
                   F.round(F.avg(hit.cast("double")), 2).alias("labelled"))


@query("local_outlier_factors", """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
near AS (SELECT a.id, b.id AS other, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.id <> b.id
         QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) <= 20),
reach AS (SELECT id, max(d) AS k FROM near GROUP BY id),
density AS (SELECT n.id, 1 / (avg(greatest(d, k)) + 1e-10) AS lrd FROM near n JOIN reach r ON r.id = n.other GROUP BY n.id),
f AS (SELECT n.id, avg(o.lrd) / any_value(s.lrd) AS factor FROM near n JOIN density o ON o.id = n.other JOIN density s ON s.id = n.id GROUP BY n.id)
SELECT id AS instance_id, round(factor, 4) AS factor, CASE WHEN factor > 1.5 THEN -1 ELSE 1 END AS prediction FROM f""")
def local_outlier_factors(spark, sf):
    near = ln.nearest_neighbours(embedded(spark, sf), "instance_id", "embedding", k=20)
    return ln.local_outliers(near, "instance_id").withColumn("factor", F.round("factor", 4))
