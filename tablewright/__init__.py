"""Spreadsheet-style analytics as Spark jobs: tidy, profile, clean, edit, aggregate, chart, dashboard."""

from tablewright.operators.aggregates import column_function, kpi_block
from tablewright.operators.profile import profile, profile_frame
from tablewright.plans.dashboard import dashboard
from tablewright.plans.insights import insights
from tablewright.plans.recipe import run_recipe
from tablewright.sources.readers import read_table

__all__ = [
    "column_function",
    "dashboard",
    "insights",
    "kpi_block",
    "profile",
    "profile_frame",
    "read_table",
    "run_recipe",
]
