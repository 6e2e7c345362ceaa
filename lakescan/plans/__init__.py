"""Plans that are built first and lowered to DataFrames."""

from lakescan.plans.logical import Aggregate, Empty, Filter, Join, Limit, Plan, Project, Scan, Sort, Union
from lakescan.plans.query import QueryPlan

__all__ = ["Aggregate", "Empty", "Filter", "Join", "Limit", "Plan", "Project", "QueryPlan", "Scan", "Sort", "Union"]
