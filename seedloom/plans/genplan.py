"""Generation plans: which columns are written, by which rules, and what to warn about."""

from __future__ import annotations

from dataclasses import dataclass, replace

from seedloom.errors import GenerationError
from seedloom.plans.infer import infer
from seedloom.sources.datasets import DatasetStore
from seedloom.sources.ddl import ColumnDef, TableDef
from seedloom.sources.rules import ColumnRule, Rules


@dataclass(frozen=True)
class Planned:
    column: ColumnDef
    rule: ColumnRule


@dataclass(frozen=True)
class GenPlan:
    table: TableDef
    columns: tuple[Planned, ...]
    #: Identity columns that the database would number: dense from their seed.
    numbered: tuple[ColumnDef, ...]
    lookups: dict[str, str]
    warnings: tuple[str, ...]
    keep_identity: bool

    @property
    def names(self) -> list[str]:
        return [p.column.name for p in self.columns]


def merged(rule: ColumnRule | None, inferred: ColumnRule) -> ColumnRule:
    """The inferred rule under what an 'auto' rule says explicitly."""
    if rule is None:
        return inferred
    given = {k: v for k in ("null_rate", "unique", "min", "max", "length") if (v := getattr(rule, k)) is not None}
    return replace(inferred, **given)


def build(table: TableDef, rules: Rules, datasets: DatasetStore | None = None) -> GenPlan:
    for name in rules.columns:
        if table.column(name) is None:
            raise GenerationError(f"the rules name column {name!r}, which {table.full_name} doesn't have ({', '.join(c.name for c in table.columns)})")
    columns, numbered, lookups, warnings, keep = [], [], {}, [], False
    for c in table.columns:
        given = rules.rule(c.name)
        if c.db_generated:
            if given is not None and given.strategy != "skip":
                warnings.append(f"column {c.name!r} is {'computed' if c.computed else 'a row version'}: its rule is ignored")
            continue
        rule = merged(given, infer(c, table, datasets)) if given is None or given.strategy in ("", "auto") else given
        if rule.strategy in ("skip", "dbDefault"):
            if c.identity is not None:
                numbered.append(c)
            elif not c.nullable and c.default is None:
                warnings.append(f"column {c.name!r} is NOT NULL without a DEFAULT, but its strategy is {rule.strategy!r}: it stays null")
            continue
        keep = keep or c.identity is not None
        if rule.strategy == "query":
            lookups[c.name] = rule.query or ""
        if rule.null_rate and not c.nullable:
            warnings.append(f"column {c.name!r} is NOT NULL: nullRate {rule.null_rate} is ignored")
            rule = replace(rule, null_rate=0.0)
        columns.append(Planned(c, rule))
    if not columns:
        raise GenerationError("no column is left to generate")
    return GenPlan(table, tuple(columns), tuple(numbered), lookups, tuple(warnings), keep)
