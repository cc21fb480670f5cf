from __future__ import annotations

import re

from clusterloom.bindings import ORACLES
from clusterloom.bindings import learning as bl
from clusterloom.operators import learn as ln


def test_searched_grids_are_whole(spark, sf_dir, monkeypatch):
    """Every parameter set of a searched classifier is tried, and the SQL expects as many."""
    tried = {}
    search = ln.CrossValidator

    def watched(**given):
        tried[type(given["estimator"]).__name__] = len(given["estimatorParamMaps"])
        kept = {k: given[k] for k in ("evaluator", "numFolds", "parallelism", "seed", "foldCol")}
        return search(estimator=ln.classifier("logit", 100, 64), estimatorParamMaps=given["estimatorParamMaps"][:0] or [{}], **kept)

    monkeypatch.setattr(ln, "CrossValidator", watched)
    bl.grid_search_scores(spark, sf_dir)
    whole = {}
    for kind, name in (("logit", "LogisticRegression"), ("randomforest", "RandomForestClassifier"), ("mlp", "MultilayerPerceptronClassifier")):
        whole[name] = len(ln.parameter_grid(kind, ln.classifier(kind, 100, 64), 100, 64))
        assert re.search(rf"'{kind}', {whole[name]}\)", ORACLES["grid_search_scores"])
    assert tried == whole
