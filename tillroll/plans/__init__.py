from tillroll.plans.catalog import P, STUDY, Params, analyses, panel_queries, queries, register_views
from tillroll.plans.oracle import oracle_sql

__all__ = ["P", "STUDY", "Params", "analyses", "panel_queries", "queries", "register_views", "oracle_sql"]
