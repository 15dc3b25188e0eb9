"""Run artifacts: JSON and JSON lines on the driver, bound together by hashes of their bytes."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from pathlib import Path
from typing import Any

from seedloom.errors import ConfigError


def prune(value: Any) -> Any:
    """Without nulls in mappings."""
    if isinstance(value, dict):
        return {k: prune(v) for k, v in value.items() if v is not None}
    return [prune(v) for v in value] if isinstance(value, list) else value


def write_json(path: str | Path, doc: dict) -> None:
    """Indented, fixed order, one line end; a reader sees the old file or the whole new one."""
    write_text(path, json.dumps(prune(doc), indent=2, ensure_ascii=False) + "\n")


def write_text(path: str | Path, text: str) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_name(p.name + ".part")
    part.write_bytes(text.encode("utf-8"))
    os.replace(part, p)


def read_json(path: str | Path) -> dict:
    p = Path(path)
    if not p.exists():
        raise ConfigError(f"no such artifact: {path}")
    return json.loads(p.read_text("utf-8"))


def write_lines(path: str | Path, rows: list[dict]) -> None:
    write_text(path, "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


def read_lines(path: str | Path) -> list[dict]:
    return [json.loads(line) for line in Path(path).read_text("utf-8").splitlines() if line.strip()]


def sha256(path: str | Path) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="seconds").replace("+00:00", "Z")
