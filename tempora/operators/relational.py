"""Set operators that plans and exchanges share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merge(parts: list[DataFrame], key: str, deduplicate: bool = False) -> DataFrame:
    """All rows of the parts in one order: by key, then by the other columns, nulls first; deduplicate leaves one of equal rows.

    The parts must have one schema. The order is a sort by ranges, so equal inputs give equal rows in equal order however they were cut.
    """
    if not parts:
        raise ValueError("nothing to merge")
    first = [(f.name, f.dataType) for f in parts[0].schema]
    if any([(f.name, f.dataType) for f in p.schema] != first for p in parts[1:]):
        raise ValueError("merge inputs have different schemas")
    if key not in parts[0].columns:
        raise ValueError(f"no column {key}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    out = out.distinct() if deduplicate else out
    return out.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in [key, *(c for c in out.columns if c != key)]])
