"""Datasets: small reviewed tables of strings whose columns are picked together."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from seedloom.errors import ConfigError


def text(value: object) -> str | None:
    """A YAML scalar as the string it was written as, as far as YAML keeps it."""
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


@dataclass(frozen=True)
class Dataset:
    name: str
    columns: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]
    weights: tuple[float, ...] | None = None
    match: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        n = self.name
        if "." in n:
            raise ConfigError(f"dataset {n!r}: a name can't contain '.'")
        if not self.columns or any(not (c or "").strip() for c in self.columns):
            raise ConfigError(f"dataset {n!r}: columns need names")
        if len({c.lower() for c in self.columns}) < len(self.columns):
            raise ConfigError(f"dataset {n!r}: column names must differ")
        if not self.rows:
            raise ConfigError(f"dataset {n!r}: it has no rows")
        for k, row in enumerate(self.rows, 1):
            if len(row) != len(self.columns):
                raise ConfigError(f"dataset {n!r}: row {k} has {len(row)} values for {len(self.columns)} columns")
        if self.weights is not None and len(self.weights) != len(self.rows):
            raise ConfigError(f"dataset {n!r}: {len(self.weights)} weights for {len(self.rows)} rows")
        if self.weights is not None and any(w <= 0 for w in self.weights):
            raise ConfigError(f"dataset {n!r}: weights must be positive")
        for c in self.match:
            if self.index(c) < 0:
                raise ConfigError(f"dataset {n!r}: 'match' names {c!r}, which is not a column")

    def index(self, column: str) -> int:
        return next((k for k, c in enumerate(self.columns) if c.lower() == column.lower()), -1)

    def matching(self, column: str) -> str | None:
        """The dataset column whose globs cover a table column's name."""
        name = column.lower().replace("_", "")
        for own in sorted(self.match):
            for glob in self.match[own]:
                pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob.lower().replace("_", ""))
                if re.fullmatch(pattern, name):
                    return own
        return None

    def keyed_by(self, columns: Iterable[str]) -> bool:
        at = [self.index(c) for c in columns]
        keys = [tuple((row[k] or "").lower() for k in at) for row in self.rows]
        return len(set(keys)) == len(keys)


class DatasetStore:
    def __init__(self, datasets: Iterable[Dataset] = ()) -> None:
        self.all = sorted(datasets, key=lambda d: d.name)

    def get(self, name: str) -> Dataset:
        for d in self.all:
            if d.name.lower() == name.lower():
                return d
        raise ConfigError(f"unknown dataset {name!r}; known: {', '.join(d.name for d in self.all) or 'none'}")

    def resolve(self, fix: str, column: str) -> tuple[Dataset, str]:
        """dataset.<name> or dataset.<name>.<column>; without one, the column of the same name or the only one."""
        parts = fix.split(".")
        d = self.get(parts[1] if len(parts) > 1 else "")
        wanted = parts[2] if len(parts) > 2 else column
        if d.index(wanted) >= 0:
            return d, d.columns[d.index(wanted)]
        if len(parts) < 3 and len(d.columns) == 1:
            return d, d.columns[0]
        raise ConfigError(f"dataset {d.name!r} has no column {wanted!r} ({', '.join(d.columns)})")

    @staticmethod
    def is_key(fix: str) -> bool:
        return fix.lower().startswith("dataset.")

    @staticmethod
    def beside(rules_path: str | Path) -> DatasetStore:
        """The *.yaml files in the folder 'datasets' beside a rules file; none if there is no such folder."""
        return DatasetStore([load(p) for p in sorted((Path(rules_path).parent / "datasets").glob("*.yaml"))])


def load(path: Path) -> Dataset:
    return from_mapping(path.stem, parse(path.read_text("utf-8"), str(path)))


def from_mapping(name: str, doc: object) -> Dataset:
    if not isinstance(doc, dict):
        raise ConfigError(f"dataset {name!r}: a mapping with 'columns' and 'rows' is needed")
    rows = [r if isinstance(r, list) else [r] for r in doc.get("rows") or []]
    match = {c: tuple(g if isinstance(g, list) else [g]) for c, g in (doc.get("match") or {}).items()}
    weights = doc.get("weights")
    return Dataset(name, tuple(text(c) or "" for c in doc.get("columns") or []), tuple(tuple(text(v) for v in r) for r in rows), None if weights is None else tuple(float(w) for w in weights), match)


class _Loader(yaml.SafeLoader):
    """Numbers, dates and the like stay as they were written; only true, false and null are read."""


_Loader.yaml_implicit_resolvers = {k: [x for x in v if x[0] in ("tag:yaml.org,2002:null", "tag:yaml.org,2002:merge")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def parse(source: str, name: str) -> object:
    """YAML with all scalars as strings."""
    try:
        return yaml.load(source, _Loader)  # noqa: S506
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        where = f", line {mark.line + 1}, column {mark.column + 1}" if mark else ""
        raise ConfigError(f"{name}{where}: {getattr(e, 'problem', e)}") from e
