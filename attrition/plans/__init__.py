"""Named queries (Spark builder + DuckDB oracle SQL) and end-to-end plans."""

import importlib

PLAN_MODULES = ("q_profile", "q_clean", "q_prep", "q_metrics", "q_neighbors", "q_segment", "q_models", "q_boost", "q_studies", "q_cart", "pipelines")


def load_all():
    from attrition.plans.registry import REGISTRY
    for m in PLAN_MODULES:
        importlib.import_module(f"attrition.plans.{m}")
    return REGISTRY
