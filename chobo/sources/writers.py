"""Writers. Tables are written by the executors; only summaries of a few rows pass through the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_registry(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Adds results to an output that readers.remaining() compares with."""
    rows.write.mode("append").parquet(path)


def summary_json(row: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(row, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def report_markdown(title: str, sections: list[str], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f"# {title}\n\n" + "\n\n".join(sections) + "\n", encoding="utf-8")
