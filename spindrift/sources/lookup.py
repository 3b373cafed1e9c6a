"""Lookup lists: inline, JSON array or objects, CSV column, or text lines."""

from __future__ import annotations

import csv
import json
import os
from typing import Any

#: A list is a literal array of the plan, so its length is bounded.
MOST_VALUES = 100_000


def load_values(spark, table: Any, column: str | None = None, base: str = ".") -> list:
    if isinstance(table, (list, tuple)):
        values = list(table)
    else:
        path = str(table)
        path = path if "://" in path or os.path.isabs(path) else os.path.join(base, path)
        if "://" in path and spark is not None:
            text = "\n".join(r.value for r in spark.read.text(path).limit(MOST_VALUES + 1).collect())
        else:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        if path.endswith(".json"):
            got = json.loads(text)
            values = [r[column or next(iter(r))] if isinstance(r, dict) else r for r in got]
        elif path.endswith(".csv"):
            rows = list(csv.DictReader(text.splitlines()))
            name = column or (list(rows[0])[0] if rows else "")
            values = [r[name] for r in rows]
        else:
            values = [line.strip() for line in text.splitlines() if line.strip()]
    if len(values) > MOST_VALUES:
        raise ValueError(f"a lookup list has more than {MOST_VALUES} values; join a table instead")
    return values
