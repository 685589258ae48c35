"""Registry of the queries of this package."""

from __future__ import annotations

from attrition.plans.registry import Query


def load_queries() -> dict[str, Query]:
    """Name → query, in operator order; the pipeline last."""
    import corpus_pipeline
    from attrition.llm import queries
    out = {q.name: q for q in queries.QUERIES}
    out["pipeline"] = Query("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
    return out
