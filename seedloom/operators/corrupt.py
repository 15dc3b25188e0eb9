"""Damage for demonstrations: set fixed cells and add rows, as one publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.operators.repair import patched
from seedloom.sources.warehouse import Warehouse


def corrupt(w: Warehouse, cells: dict[tuple[str, str], list[tuple[str, str, str | None]]], rows: dict[str, list[dict]] | None = None) -> int:
    """cells: for (table, key column) a list of (key, column, value). rows: new rows by table, missing columns null; a row
    is added only if no row has the same primary key. Returns how many cells and rows were written."""
    base, folders, n = w.manifest(), {}, 0
    for (table, key), own in cells.items():
        folders[Warehouse.key(table)], _ = patched(w, table, key, own)
        n += len(own)
    for table, own in (rows or {}).items():
        frame, name = w.table(table), Warehouse.key(table)
        schema = frame.schema
        text = w.spark.createDataFrame([tuple(None if r.get(f.name) is None else str(r.get(f.name)) for f in schema.fields) for r in own], ", ".join(f"`{f.name}` string" for f in schema.fields))
        new = text.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        keys = list(w.definition(table).primary_key)
        new = new.join(frame.select(keys), keys, "left_anti").select(schema.names) if keys else new
        n += new.count()
        folders[name] = [*folders.get(name, base.folders[name]), w.stage(name, new)]
    w.publish(base, folders)
    return n


def first_keys(w: Warehouse, table: str, key: str, condition: str, n: int) -> list[str]:
    """The first keys that meet a condition, in order."""
    return [str(r[0]) for r in w.table(table).filter(condition).orderBy(key).limit(n).select(key).collect()]
