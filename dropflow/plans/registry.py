"""Registry of the queries exposed through the driver contract."""

from __future__ import annotations

from . import course_queries as cq
from . import model_queries as modq
from . import more_queries as mq
from .oracle import course_oracles
from .oracle_models import model_oracles
from .oracle_more import more_oracles

COURSE = ["q_filter_courses", "q_filter_audit", "q_rate_r1", "q_rate_r2", "q_rate_r3",
          "q_rate_r4", "q_rate_r5", "q_to_numeric", "q_features", "q_feature_table",
          "q_share_by_region", "q_threshold_median", "q_label_binary_gt",
          "q_label_binary_ge", "q_label_binary_median", "q_quartiles",
          "q_label_quartile", "q_class_counts", "q_class_weights", "q_complete_cases",
          "q_simple_table", "q_social_features"]
MORE = ["q_box_stats", "q_box_stats_events", "q_union_years", "q_mega_dataset", "q_root_filter",
        "q_analysis_table", "q_clean_categories", "q_ordinal_encode", "q_ordinal_unseen",
        "q_onehot", "q_impute_median", "q_impute_mode", "q_scale", "q_scale_only", "q_scale_zero", "q_split_sizes",
        "q_stratified_sizes", "q_split_repeated_keys", "q_union_complete", "q_cls_metrics", "q_roc_auc", "q_weighted_metrics",
        "q_roc_auc_ovr", "q_reg_metrics", "q_reg_metrics_log", "q_topk_importance",
        "q_collect_metrics", "q_metric_report", "q_eligibility"]

MODELS = ["q_model_rf", "q_model_lr", "q_model_mlp", "q_model_gbt", "q_model_xgb", "q_model_xgb_quartile",
          "q_model_gbt_quartile", "q_model_rf_default", "q_model_rf_reg", "q_model_gbt_reg", "q_model_xgb_reg", "q_model_mlp_reg"]


def spark_queries() -> dict:
    q = {name: getattr(cq, name) for name in COURSE}
    q.update({name: getattr(mq, name) for name in MORE})
    q.update({name: getattr(modq, name) for name in MODELS})
    return q


def oracle_queries() -> dict:
    o = {}
    o.update(course_oracles())
    o.update(more_oracles())
    o.update(model_oracles())
    names = set(spark_queries())
    return {k: v for k, v in o.items() if k in names}
