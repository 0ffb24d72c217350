"""Query plans. Importing ``all_queries`` registers every query module."""


def all_queries():
    from leakscope.plans import q_ingest  # noqa: F401
    for mod in ("q_catalogue", "q_metrics", "q_models", "q_reports"):
        try:
            __import__(f"leakscope.plans.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"leakscope.plans.{mod}":
                raise
    from leakscope.plans.registry import ORACLE, QUERIES
    return QUERIES, ORACLE
