"""Model training is reproducible and importances are well formed."""

import pytest

from dropflow.operators.labels import label_quartile
from dropflow.plans.evaluate import top_k, train_classifiers
from dropflow.plans.model_queries import model_table

from paths import SF001


def test_random_forest_is_reproducible(spark):
    data, _ = label_quartile(model_table(spark, SF001))
    runs = []
    for _ in range(2):
        m, imp = train_classifiers(data, "NIVEL_RISCO", "x", task="quartile", only=["RandomForest"])
        r = m.first()
        runs.append((r["Accuracy"], r["ROC-AUC (weighted, ovr)"]))
        total = sum(x["Importance"] for x in imp.collect())
        assert total == pytest.approx(1.0)
    # equal up to the order of floating-point sums across partitions
    assert runs[0] == pytest.approx(runs[1], abs=1e-12)
    top = top_k(imp, 5).collect()
    assert len(top) == 5 and [x["rank"] for x in top] == [1, 2, 3, 4, 5]
