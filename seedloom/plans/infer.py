"""Rules from column definitions, and a first rules file for a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import yaml

from seedloom.sources.datasets import DatasetStore
from seedloom.sources.ddl import TEXT_TYPES, ColumnDef, TableDef
from seedloom.sources.rules import ColumnRule


def _any(*words: str) -> Callable[[str], bool]:
    return lambda n: any(w in n for w in words)


#: What a text column's name (lower case, without underscores) says about its content; the first that holds.
BY_NAME: list[tuple[Callable[[str], bool], str]] = [
    (_any("email"), "internet.email"),
    (_any("firstname", "givenname"), "name.firstName"),
    (_any("lastname", "surname"), "name.lastName"),
    (lambda n: n == "name" or _any("fullname", "contactname")(n), "name.fullName"),
    (_any("username", "login"), "internet.userName"),
    (_any("phone", "mobile", "fax"), "phone.phoneNumber"),
    (_any("city"), "address.city"),
    (_any("country"), "address.country"),
    (_any("state", "province"), "address.state"),
    (_any("zip", "postalcode", "postcode"), "address.zipCode"),
    (_any("street", "address"), "address.streetAddress"),
    (_any("company", "organization", "employer"), "company.companyName"),
    (lambda n: "job" in n and "title" in n, "name.jobTitle"),
    (_any("url", "website", "homepage"), "internet.url"),
    (_any("description", "comment", "notes", "summary"), "lorem.sentence"),
    (_any("product"), "commerce.productName"),
    (_any("department"), "commerce.department"),
    (_any("color", "colour"), "commerce.color"),
    (_any("iban"), "finance.iban"),
    (_any("currency"), "finance.currencyCode"),
]

#: Ranges for the numeric types.
RANGES = {"tinyint": ("int", "0", "255"), "smallint": ("int", "0", "32767"), "int": ("int", "1", "100000"), "bigint": ("int", "1", "10000000"), "money": ("decimal", "0", "10000"), "smallmoney": ("decimal", "0", "10000"), "float": ("decimal", "0", "1000"), "real": ("decimal", "0", "1000")}
DAYS = ("2020-01-01", "2025-12-31")
#: Null rate of inferred columns that can be null.
NULL_RATE = 0.1


def capped(length: int | None, cap: int) -> int:
    return cap if length is None or length < 0 else min(length, cap)


def infer(column: ColumnDef, table: TableDef, datasets: DatasetStore | None = None) -> ColumnRule:
    if column.identity is not None or column.db_generated:
        return ColumnRule("skip")
    if column.default is not None and not column.nullable and not column.primary_key:
        return ColumnRule("dbDefault")
    for fk in table.foreign_keys:
        if len(fk.columns) == 1 and fk.columns[0].lower() == column.name.lower():
            other = fk.referenced[0] if len(fk.referenced) == 1 else column.name
            return _nulls(column, ColumnRule("query", query=f"SELECT [{other}] FROM {fk.table}"))
    if column.primary_key and len(table.primary_key) == 1:
        if column.sql_type == "uniqueidentifier":
            return ColumnRule("guid")
        if column.sql_type in ("tinyint", "smallint", "int", "bigint"):
            return ColumnRule("sequence", start=1, step=1)
        if column.length is not None and 0 < column.length < 8:
            return ColumnRule("string", length=column.length, unique=True)
        return ColumnRule("template", template="ID-{row}", unique=True)
    rule = _from_dataset(column, datasets) or _from_name(column) or _from_type(column)
    if column.unique:
        rule = replace(rule, unique=True)
    return _nulls(column, rule)


def _nulls(column: ColumnDef, rule: ColumnRule) -> ColumnRule:
    return replace(rule, null_rate=NULL_RATE) if column.nullable else rule


def _from_dataset(column: ColumnDef, datasets: DatasetStore | None) -> ColumnRule | None:
    for d in datasets.all if datasets else ():
        if (own := d.matching(column.name)) is not None:
            return ColumnRule("dataset", dataset=d.name, dataset_column=own)
    return None


def _from_name(column: ColumnDef) -> ColumnRule | None:
    if column.sql_type not in TEXT_TYPES:
        return None
    name = column.name.lower().replace("_", "")
    return next((ColumnRule("faker", method=key) for holds, key in BY_NAME if holds(name)), None)


def _from_type(column: ColumnDef) -> ColumnRule:
    kind = column.sql_type
    if kind in RANGES:
        strategy, low, high = RANGES[kind]
        return ColumnRule(strategy, min=low, max=high)
    if kind in ("decimal", "numeric"):
        digits = max(1, min((18 if column.precision is None else column.precision) - (column.scale or 0), 6))
        return ColumnRule("decimal", min="0", max=str(10**digits - 1))
    if kind == "bit":
        return ColumnRule("bool", true_rate=0.5)
    if kind in ("date", "datetime", "datetime2", "smalldatetime", "datetimeoffset"):
        return ColumnRule("date" if kind == "date" else "datetime", min=DAYS[0], max=DAYS[1])
    if kind == "time":
        return ColumnRule("time")
    if kind == "uniqueidentifier":
        return ColumnRule("guid")
    if kind in TEXT_TYPES:
        return ColumnRule("string", length=capped(column.length, 20))
    if kind in ("binary", "varbinary", "image"):
        return ColumnRule("bytes", length=capped(column.length, 16))
    if kind == "xml":
        return ColumnRule("constant", value="<data />")
    return ColumnRule("string", length=10)


def scaffold(table: TableDef, rows: int = 100, seed: int = 12345, datasets: DatasetStore | None = None) -> str:
    """A rules file in YAML: a rule and a comment for each column, and evaluations that follow from the schema."""
    quoted = lambda v: yaml.safe_dump(v, default_flow_style=True, width=10**6).strip().removesuffix("\n...").strip()
    lines = [f"# Rules for {table.full_name}.", f"table: {table.full_name}", f"rows: {rows}", f"seed: {seed}", "", "columns:"]
    for c in table.columns:
        rule = infer(c, table, datasets)
        size = "" if c.length is None else "(max)" if c.length == -1 else f"({c.length})"
        size = f"({c.precision},{c.scale or 0})" if c.precision is not None else size
        notes = [c.sql_type + size, "NULL" if c.nullable else "NOT NULL"] + ["primary key"] * c.primary_key + ["identity"] * (c.identity is not None) + ["unique"] * c.unique
        notes += [f"default {c.default}"] if c.default else []
        lines.append(f"  {quoted(c.name)}:  # {', '.join(notes)}")
        lines.append(f"    strategy: {rule.strategy}")
        for key, value in (("min", rule.min), ("max", rule.max), ("trueRate", rule.true_rate), ("length", rule.length), ("template", rule.template), ("start", rule.start), ("step", rule.step),
                           ("method", rule.method), ("query", rule.query), ("value", rule.value), ("dataset", rule.dataset), ("datasetColumn", rule.dataset_column), ("nullRate", rule.null_rate), ("unique", rule.unique)):
            if value is not None:
                lines.append(f"    {key}: {quoted(value)}")
    lines += [f"# Check, not enforced: {' '.join(check.split())}" for check in table.checks]
    name = table.qualified
    lines += ["", "evaluations:", "  - name: row-count", f"    query: {quoted(f'SELECT COUNT(*) FROM {name}')}", "    expect:", f"      equals: {rows}"]
    for c in table.columns:
        if not c.nullable and not c.db_generated:
            lines += [f"  - name: {quoted(c.name + '-not-null')}", f"    query: {quoted(f'SELECT COUNT(*) FROM {name} WHERE [{c.name}] IS NULL')}", "    expect:", "      equals: 0"]
    for c in table.columns:
        if c.unique or (c.primary_key and len(table.primary_key) == 1):
            lines += [f"  - name: {quoted(c.name + '-unique')}", f"    query: {quoted(f'SELECT COUNT([{c.name}]) - COUNT(DISTINCT [{c.name}]) FROM {name}')}", "    expect:", "      equals: 0"]
    return "\n".join(lines) + "\n"
