"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import answer_plans, compare_plans, feature_plans, geo_plans, graph_plans, index_plans, io_plans, leg_plans, package_plans, render_plans, support_plans, text_plans

MODULES = (compare_plans, package_plans, feature_plans, answer_plans, render_plans, text_plans, leg_plans, graph_plans, geo_plans, io_plans, index_plans, support_plans)
QUERIES: dict = {k: f for m in MODULES for k, f in m.Q.items()}
ORACLE: dict = {k: s for m in MODULES for k, s in m.S.items()}
