"""Declarative recipes: a list of actions folded into one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright.functions.parsing import column
from tablewright.operators import charts, cleaning, columns, edits, filters, ordering
from tablewright.operators.aggregates import column_function
from tablewright.operators.rowindex import INDEX, dense_index


def _sort(df, a):
    return ordering.sort_rows(df, a["colName"], a.get("ascending", True) is not False, a.get("tie"))


def _chart(df, a):
    x, y = _name(df, a["xCol"]), _name(df, a["yCol"])
    return charts.series_for(df, a.get("chartType", "bar"), x, y, a.get("tie", [INDEX]), **a.get("options", {}))


def _name(df: DataFrame, given) -> str:
    """A column by name, or by position among the data columns."""
    if isinstance(given, int):
        return [c for c in df.columns if c != INDEX][given]
    return given


def _function(df, a):
    if a.get("result_column"):
        return columns.function_to_column(df, a["function"], a["column"], a["result_column"])
    return column_function(df, a["function"], a["column"])


# What each action does with a table and its own parameters.
ACTIONS = {
    "expr": lambda df, a: columns.transform(df, exprs=a["columns"]),
    "sort": _sort,
    "chart": _chart,
    "add_row": lambda df, a: edits.append_rows(df, [a.get("data", {})]),
    "add_column": lambda df, a: columns.add_column(df, a.get("column_name"), a.get("default_value", "")),
    "update_cell": lambda df, a: edits.update_cell(df, a["row_index"], a["column"], a["value"]),
    "delete_row": lambda df, a: edits.delete_rows(df, [a["row_index"]]),
    "function": _function,
    "message": lambda df, a: df,
    "trim": lambda df, a: cleaning.trim_whitespace(df),
    "fill_empty": lambda df, a: cleaning.fill_empty(df, a.get("fill", "0")),
    "remove_duplicates": lambda df, a: cleaning.remove_duplicates(df),
    "uppercase_columns": lambda df, a: columns.uppercase_columns(df),
    "search": lambda df, a: filters.search(df, a["text"], a.get("columns")),
    "complete_cases": lambda df, a: filters.complete_cases(df, a["columns"]),
    "keep": lambda df, a: df.where(a["condition"]),
}


#: Actions that take rows away and leave their indices out, and those that go by the places of rows.
THINNING = {"keep", "search", "complete_cases", "remove_duplicates"}
PLACED = {"add_row", "update_cell", "delete_row"}


def run_recipe(df: DataFrame, actions: list[dict]) -> DataFrame:
    """Applies ``[{"action": ..., parameters}, ...]`` in order; an unknown action is an error.

    An action that goes by the place of a row after others have taken rows away finds the rows numbered anew.
    """
    unknown = [a.get("action") for a in actions if a.get("action") not in ACTIONS]
    if unknown:
        raise ValueError(f"unknown actions: {unknown}")
    thinned = False
    for action in actions:
        name = action["action"]
        if thinned and name in PLACED and INDEX in df.columns:
            names = df.columns
            df = dense_index(df.withColumnRenamed(INDEX, "_thinned"), ["_thinned"]).select(*[column(c) for c in names])
            thinned = False
        df = ACTIONS[name](df, action)
        thinned = thinned or name in THINNING
    return df
