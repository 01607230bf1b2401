"""Tables of results as CSV or JSON folders, one per name and tag."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelspark.sources.panel import HEADERS


def table_path(folder: str, name: str, tag: str = "") -> str:
    return f"{folder.rstrip('/')}/{name}__{tag}" if tag else f"{folder.rstrip('/')}/{name}"


def write_csv(df: DataFrame, folder: str, name: str, tag: str = "") -> str:
    path = table_path(folder, name, tag)
    df.write.mode("overwrite").csv(path, header=True)
    return path


def write_json(df: DataFrame, folder: str, name: str, tag: str = "") -> str:
    path = table_path(folder, name, tag)
    df.write.mode("overwrite").json(path)
    return path


def write_report(rows: DataFrame, folder: str, name: str = "report", tag: str = "") -> str:
    """``rows(table, row)`` as one folder of JSON lines a table."""
    path = table_path(folder, name, tag)
    rows.write.mode("overwrite").partitionBy("table").text(path)
    return path


def write_panel(panel: DataFrame, path: str) -> None:
    """A panel under the raw headers, as ``read_csv`` takes it."""
    known = {c: h for h, c in HEADERS.items() if c in panel.columns}
    panel.select(*[panel[c].alias(h) for c, h in known.items()]).write.mode("overwrite").csv(path, header=True)
