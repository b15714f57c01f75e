"""Folds of the baseline are fitted at a time, and as they would be alone."""

import threading

from pyspark.ml.classification import GBTClassifier
from test_runs import planted

from tempora.operators import splits
from tempora.plans import pipelines


def test_folds_are_fitted_at_a_time(spark, monkeypatch):
    seqs, vocabulary = planted(spark, 200)
    folds = splits.create_folds(seqs.select("subject_id"), 2)
    features = pipelines.materialize(pipelines.baseline_features(seqs, vocabulary), "one_hot")
    together, fit = threading.Barrier(2, timeout=30), GBTClassifier.fit

    def met(self, *args):
        together.wait()
        return fit(self, *args)

    options = {"iterations": 1, "depth": 2}  # one fit a fold
    alone = pipelines.baseline_models(features, folds, **options, parallelism=1)
    monkeypatch.setattr(GBTClassifier, "fit", met)
    both = pipelines.baseline_models(features, folds, **options)
    assert sorted(both) == sorted(alone) == [0, 1]
    assert [both[k].featureImportances for k in (0, 1)] == [alone[k].featureImportances for k in (0, 1)]
    assert [both[k].treeWeights for k in (0, 1)] == [alone[k].treeWeights for k in (0, 1)]
