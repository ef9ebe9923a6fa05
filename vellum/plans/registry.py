"""All queries with their SQL."""

from __future__ import annotations

from . import cleanup_plans, detection_plans, lettering_plans, mask_plans, page_plans, region_plans, service_plans, source_plans, text_plans

_PLANS = (text_plans, region_plans, page_plans, service_plans, source_plans, cleanup_plans, detection_plans, mask_plans, lettering_plans)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
