"""Rules files: how a table's columns are filled and what must hold afterwards."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from seedloom.errors import ConfigError
from seedloom.sources.datasets import parse


@dataclass(frozen=True)
class ColumnRule:
    strategy: str = "auto"
    min: str | None = None
    max: str | None = None
    true_rate: float | None = None
    length: int | None = None
    template: str | None = None
    values: tuple[str, ...] | None = None
    weights: tuple[float, ...] | None = None
    start: int | None = None
    step: int | None = None
    method: str | None = None
    query: str | None = None
    value: str | None = None
    dataset: str | None = None
    dataset_column: str | None = None
    null_rate: float | None = None
    unique: bool | None = None


@dataclass(frozen=True)
class Expectation:
    equals: str | None = None
    tolerance: float | None = None
    min: str | None = None
    max: str | None = None
    between: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Evaluation:
    name: str
    query: str
    expect: Expectation | None = None


@dataclass(frozen=True)
class Rules:
    table: str | None = None
    rows: int = 100
    seed: int = 12345
    batch_size: int = 10_000
    truncate_before_load: bool = False
    columns: dict[str, ColumnRule] = field(default_factory=dict)
    evaluations: tuple[Evaluation, ...] = ()

    def rule(self, column: str) -> ColumnRule | None:
        """Names are compared without regard to case."""
        return next((r for c, r in self.columns.items() if c.lower() == column.lower()), None)


#: What each strategy can't do without.
REQUIRED = {"pick": "values", "template": "template", "faker": "method", "query": "query", "constant": "value", "dataset": "dataset"}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _typed(kind: str, value: Any, where: str) -> Any:
    if value is None:
        return None
    try:
        if "tuple[float" in kind:
            return tuple(float(v) for v in value)
        if "tuple" in kind:
            return tuple("" if v is None else str(v) for v in value)
        if kind.startswith("int"):
            return int(value)
        if kind.startswith("float"):
            return float(value)
        if kind.startswith("bool"):
            return str(value).strip().lower() in ("true", "yes", "on", "1")
        if isinstance(value, (dict, list)):
            raise ValueError
        return str(value)
    except (TypeError, ValueError):
        raise ConfigError(f"{where}: bad value {value!r}") from None


def build(cls: type, doc: Any, where: str, skip: tuple[str, ...] = ()) -> Any:
    """An instance of a dataclass from camelCase keys; unknown keys are passed over."""
    if not isinstance(doc, dict):
        raise ConfigError(f"{where}: a mapping is needed")
    known = {str(k).lower(): v for k, v in doc.items()}
    got = {f.name: _typed(str(f.type), known[camel(f.name).lower()], f"{where}, {camel(f.name)}") for f in fields(cls) if f.name not in skip and camel(f.name).lower() in known}
    return cls(**{k: v for k, v in got.items() if v is not None})


def loads(source: str, name: str = "rules") -> Rules:
    doc = parse(source, name) or {}
    rules = build(Rules, doc, name, ("columns", "evaluations"))
    columns, evaluations = {}, []
    for column, rule in (doc.get("columns") or {}).items():
        if rule is None:
            raise ConfigError(f"column {column!r}: the rule is empty; remove it or name a strategy")
        columns[str(column)] = build(ColumnRule, rule, f"column {column!r}")
    for e in doc.get("evaluations") or []:
        one = build(Evaluation, {"name": "", "query": "", **{k: v for k, v in e.items() if v is not None}}, "evaluation", ("expect",))
        if e.get("expect") is not None:
            one = replace(one, expect=build(Expectation, e["expect"], f"evaluation {one.name!r}"))
        evaluations.append(one)
    out = replace(rules, columns=columns, evaluations=tuple(evaluations))
    validate(out)
    return out


def load(path: str | Path) -> Rules:
    p = Path(path)
    if not p.exists():
        raise ConfigError(f"no such rules file: {path}")
    return loads(p.read_text("utf-8"), str(path))


def validate(rules: Rules) -> None:
    if rules.rows <= 0:
        raise ConfigError("'rows' must be a positive integer")
    if rules.batch_size <= 0:
        raise ConfigError("'batchSize' must be a positive integer")
    for name, r in rules.columns.items():
        for key, rate in (("nullRate", r.null_rate), ("trueRate", r.true_rate)):
            if rate is not None and not 0 <= rate <= 1:
                raise ConfigError(f"column {name!r}: {key} must be between 0 and 1")
        if r.weights is not None and r.values is not None and len(r.weights) != len(r.values):
            raise ConfigError(f"column {name!r}: as many weights as values are needed")
        need = REQUIRED.get(r.strategy)
        if need and (getattr(r, need) is None or getattr(r, need) in ("", ()) and need != "value"):
            raise ConfigError(f"column {name!r}: strategy {r.strategy!r} requires {need!r}")
    seen: set[str] = set()
    for e in rules.evaluations:
        if not e.name.strip():
            raise ConfigError("every evaluation needs a 'name'")
        if e.name.lower() in seen:
            raise ConfigError(f"duplicate evaluation name {e.name!r}")
        seen.add(e.name.lower())
        if not e.query.strip():
            raise ConfigError(f"evaluation {e.name!r} needs a 'query'")
        x = e.expect
        if x is not None and (x.equals is not None) + (x.min is not None or x.max is not None) + (x.between is not None) > 1:
            raise ConfigError(f"evaluation {e.name!r}: only one of equals, min/max and between can be used")
        if x is not None and x.between is not None and len(x.between) != 2:
            raise ConfigError(f"evaluation {e.name!r}: 'between' needs [low, high]")
