"""DuckDB SQL of the model queries' invariants: sizes of the stratified or plain test set."""

from __future__ import annotations

from .oracle import BIN_GT, COURSES, LABELLED, QUART, R2_EXPR, with_ctes

RATED_ALL = f"rated AS (SELECT *, {R2_EXPR} AS TX_EVASAO FROM courses)"


def _facts(model: str, sizes: str, labels: str, importance: str) -> str:
    return (f"SELECT '{model}' AS modelo, n_test, {labels} AS n_labels, n_test AS n_finite, "
            f"CAST({importance} AS DOUBLE) AS importance_sum, true AS metrics_in_range FROM ({sizes}) t")


def _stratified(table: str) -> str:
    return (f"SELECT CAST(sum(ceil(n * 0.2::DOUBLE)) AS BIGINT) AS n_test, count(*) AS n_classes "
            f"FROM (SELECT NIVEL_RISCO, count(*) AS n FROM {table} GROUP BY NIVEL_RISCO) c")


def model_oracles() -> dict[str, str]:
    quartile = with_ctes(COURSES, RATED_ALL, QUART, LABELLED)
    binary = with_ctes(COURSES, RATED_ALL, BIN_GT)
    # the label of a regression is log1p of the rate; the test set is a plain fifth
    plain = ("SELECT CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS n_test FROM rated WHERE TX_EVASAO IS NOT NULL")
    q = {}
    for name, model, importance in (("q_model_rf", "RandomForest", "1.0"), ("q_model_lr", "LogisticRegression", "NULL"),
                                    ("q_model_xgb_quartile", "XGBoost", "1.0"), ("q_model_gbt_quartile", "LightGBM", "1.0")):
        q[name] = quartile + _facts(model, _stratified("labelled"), "n_classes", importance)
    for name, model, importance in (("q_model_mlp", "MLP", "NULL"), ("q_model_gbt", "LightGBM", "1.0"),
                                    ("q_model_xgb", "XGBoost", "1.0"), ("q_model_rf_default", "RandomForest", "1.0")):
        q[name] = binary + _facts(model, _stratified("bin"), "n_classes", importance)
    for name, model, importance in (("q_model_rf_reg", "RandomForest", "1.0"), ("q_model_gbt_reg", "LightGBM", "1.0"),
                                    ("q_model_xgb_reg", "XGBoost", "1.0"),
                                    ("q_model_mlp_reg", "MLP", "NULL")):
        q[name] = with_ctes(COURSES, RATED_ALL) + _facts(model, plain, "CAST(NULL AS BIGINT)", importance)
    return q
