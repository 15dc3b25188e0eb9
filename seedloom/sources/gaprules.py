"""Gap rules: what a bad value is, and where its replacement comes from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

from seedloom.errors import ConfigError
from seedloom.functions import generators as G
from seedloom.plans.dialect import check_predicate, unbracketed
from seedloom.sources.datasets import DatasetStore, parse
from seedloom.sources.rules import Evaluation, Expectation, build

KINDS = ("ephemeral", "identity", "derived")


@dataclass(frozen=True)
class GapRule:
    id: str = ""
    table: str = ""
    key: str = ""
    column: str = ""
    kind: str = ""
    gap: str = ""
    fix: str = ""
    threshold: int = 0
    reason: str = ""
    inputs: tuple[str, ...] | None = None
    on_missing_input: str | None = None
    invariant: str | None = None

    @property
    def table_name(self) -> str:
        return unbracketed(self.table)

    @property
    def floor(self) -> bool:
        return (self.on_missing_input or "block").lower() == "floor"


@dataclass(frozen=True)
class GapRules:
    rules: tuple[GapRule, ...]
    datasets: DatasetStore = field(default_factory=DatasetStore)

    def get(self, rule_id: str) -> GapRule:
        for r in self.rules:
            if r.id.lower() == rule_id.lower():
                return r
        raise ConfigError(f"the plan names rule {rule_id!r}, which is not among the loaded rules ({', '.join(r.id for r in self.rules)})")

    def only(self, ids: list[str] | None) -> GapRules:
        """The named rules, in any case; an unknown id is an error."""
        if not ids:
            return self
        known = {r.id.lower() for r in self.rules}
        if unknown := [i for i in ids if i.lower() not in known]:
            raise ConfigError(f"unknown rule ids: {', '.join(unknown)}; known: {', '.join(r.id for r in self.rules)}")
        wanted = {i.lower() for i in ids}
        return GapRules(tuple(r for r in self.rules if r.id.lower() in wanted), self.datasets)

    def covering(self, table: str, column: str) -> str | None:
        return next((r.id for r in self.rules if r.table_name.lower() == unbracketed(table).lower() and r.column.lower() == column.lower()), None)


def read(source: str, name: str = "gap rules") -> list[GapRule]:
    doc = parse(source, name) or {}
    return [build(GapRule, r, f"{name}, rule {k}") for k, r in enumerate((doc.get("rules") if isinstance(doc, dict) else None) or [], 1)]


def loads(source: str, datasets: DatasetStore | None = None, name: str = "gap rules") -> GapRules:
    rules = GapRules(tuple(read(source, name)), datasets or DatasetStore())
    if not rules.rules:
        raise ConfigError(f"{name}: no rules")
    for message in findings(rules):
        raise ConfigError(message)
    return rules


def load(path: str | Path) -> GapRules:
    p = Path(path)
    if not p.exists():
        raise ConfigError(f"no such rules file: {path}")
    return loads(p.read_text("utf-8"), DatasetStore.beside(p), str(path))


def findings(rules: GapRules, schemas: dict[str, T.StructType] | None = None) -> Iterator[str]:
    """What is wrong with the rules, one message for each rule at most."""
    seen: set[str] = set()
    for r in rules.rules:
        try:
            check(r, seen, rules.datasets, (schemas or {}).get(r.table_name.lower()))
        except ConfigError as e:
            yield str(e)


def check(r: GapRule, seen: set[str], datasets: DatasetStore, schema: T.StructType | None = None) -> None:
    if not r.id.strip():
        raise ConfigError("every rule needs an 'id'")
    where = f"rule {r.id!r}"
    if r.id.lower() in seen:
        raise ConfigError(f"{where}: the id is used twice")
    seen.add(r.id.lower())
    for name in ("table", "key", "column", "kind", "gap", "fix", "reason"):
        if not str(getattr(r, name)).strip():
            raise ConfigError(f"{where}: {name!r} is required")
    if r.kind not in KINDS:
        raise ConfigError(f"{where}: kind {r.kind!r} is none of {', '.join(KINDS)}")
    if r.threshold <= 0:
        raise ConfigError(f"{where}: 'threshold' must be positive")
    if r.kind == "derived":
        if not r.inputs:
            raise ConfigError(f"{where}: derived rules require 'inputs'")
        if (r.on_missing_input or "block").lower() not in ("block", "floor"):
            raise ConfigError(f"{where}: onMissingInput is block or floor, not {r.on_missing_input!r}")
    elif r.inputs is not None or r.on_missing_input is not None:
        raise ConfigError(f"{where}: 'inputs' and 'onMissingInput' are for derived rules only")
    if DatasetStore.is_key(r.fix):
        _check_dataset(r, where, datasets)
    elif r.kind == "derived" and not G.is_derived(r.fix):
        raise ConfigError(f"{where}: {r.fix!r} is no derived generator; there are {', '.join(G.derived_keys())}")
    elif r.kind != "derived" and G.is_derived(r.fix):
        raise ConfigError(f"{where}: {r.fix!r} is a derived generator and needs kind: derived")
    elif r.kind != "derived" and not G.is_random(r.fix):
        raise ConfigError(f"{where}: unknown fix key {r.fix!r}; known: {', '.join(G.random_keys())}")
    elif r.kind == "derived" and (missing := [i for i in G.find(G.DERIVED, r.fix).inputs if i not in {x.lower() for x in r.inputs or ()}]):
        raise ConfigError(f"{where}: {r.fix!r} needs input {', '.join(missing)}")
    for name in ("gap", "invariant"):
        if (text := getattr(r, name)) and text.strip():
            try:
                check_predicate(text, r.table, schema)
            except ConfigError as e:
                raise ConfigError(f"{where}: {name!r} {e}") from e


def _check_dataset(r: GapRule, where: str, datasets: DatasetStore) -> None:
    try:
        d, _ = datasets.resolve(r.fix, r.column)
    except ConfigError as e:
        raise ConfigError(f"{where}: {e}") from e
    if r.kind == "identity":
        raise ConfigError(f"{where}: a dataset can't mint identities: they must be unique and permanent, and a fixed list is neither")
    if r.kind == "derived":
        if r.floor:
            raise ConfigError(f"{where}: datasets have no floor; use onMissingInput: block")
        if unknown := [i for i in r.inputs or () if d.index(i) < 0]:
            raise ConfigError(f"{where}: inputs {', '.join(unknown)} are not columns of dataset {d.name!r} ({', '.join(d.columns)})")
        if not d.keyed_by(r.inputs or ()):
            raise ConfigError(f"{where}: inputs {', '.join(r.inputs or ())} don't tell the rows of dataset {d.name!r} apart")


def consumer_checks(path: str | Path | None) -> list[Evaluation]:
    """Checks of consumers: a scalar that must equal a value. No file: no checks."""
    if path is None or not Path(path).exists():
        return []
    doc = parse(Path(path).read_text("utf-8"), str(path)) or {}
    return [Evaluation(c["name"], c["query"], Expectation(equals=str(c["expected"]))) for c in doc.get("checks") or []]
