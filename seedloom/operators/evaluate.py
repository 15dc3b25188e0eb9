"""Evaluations: scalar queries against expectations. Those that ask one table for aggregates read it together, once."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from seedloom.errors import SeedloomError
from seedloom.plans import fuse
from seedloom.sources.rules import Evaluation, Expectation


@dataclass(frozen=True)
class Result:
    name: str
    value: object
    expected: str | None
    passed: bool
    error: str | None = None
    informational: bool = False


def as_number(value: object) -> Decimal | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        number = Decimal(str(value).strip().replace(",", ""))
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


def describe(x: Expectation | None) -> str | None:
    if x is None:
        return None
    if x.equals is not None:
        return f"= {x.equals}" + (f" (±{x.tolerance:g})" if x.tolerance else "")
    if x.between is not None:
        return f"in [{x.between[0]}, {x.between[1]}]"
    bounds = ([f">= {x.min}"] if x.min is not None else []) + ([f"<= {x.max}"] if x.max is not None else [])
    return " and ".join(bounds) or "(no condition)"


def bound(text: str) -> Decimal:
    number = as_number(text)
    if number is None:
        raise ValueError(f"{text!r} is not a numeric bound")
    return number


def meets(x: Expectation, value: object) -> bool:
    """Numbers compare as decimals, everything else as trimmed text in any case; bounds include their ends."""
    if x.equals is not None:
        if value is None:
            return x.equals.lower() == "null"
        a, b = as_number(value), as_number(x.equals)
        if a is not None and b is not None:
            return abs(a - b) <= Decimal(str(x.tolerance or 0))
        return str(value).strip().lower() == x.equals.strip().lower()
    low, high = x.between if x.between is not None else (x.min, x.max)
    if low is None and high is None:
        return True
    if value is None:
        raise ValueError("the query returned NULL but the expectation is numeric")
    number = as_number(value)
    if number is None:
        raise ValueError(f"the query returned {value!r} but the expectation is numeric")
    return (low is None or number >= bound(low)) and (high is None or number <= bound(high))


def judge(e: Evaluation, value: object) -> Result:
    if e.expect is None:
        return Result(e.name, value, None, True, informational=True)
    try:
        return Result(e.name, value, describe(e.expect), meets(e.expect, value))
    except ValueError as error:
        return Result(e.name, value, describe(e.expect), False, str(error))


#: Fixed value: seconds after which a query is given up.
TIMEOUT = 300.0


def first_within(frame: DataFrame, seconds: float):
    """The first row. Jobs that still run after so many seconds are cancelled, and the query fails."""
    context, tag, late = frame.sparkSession.sparkContext, f"evaluation-{uuid.uuid4().hex}", threading.Event()

    def give_up() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, give_up)
    context.addJobTag(tag)
    timer.start()
    try:
        return frame.first()
    except Exception as error:
        if late.is_set():
            raise SeedloomError(f"given up after {seconds:g} s") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def alone(e: Evaluation, sql: Callable[[str], DataFrame], timeout: float) -> Result:
    try:
        row = first_within(sql(e.query), timeout)
        return judge(e, row[0] if row else None)
    except (PySparkException, SeedloomError) as error:
        return Result(e.name, None, describe(e.expect), False, f"query failed: {str(error).splitlines()[0]}")


def run(evaluations: Iterable[Evaluation], sql: Callable[[str], DataFrame], timeout: float = TIMEOUT) -> list[Result]:
    """Each query's first cell against its expectation. A query that fails or takes too long is a failed result; the others
    go on. Queries of one aggregate over the same table are asked together; if that fails, one by one."""
    evaluations = list(evaluations)
    groups: dict[tuple, list[tuple[int, fuse.Part]]] = {}
    for k, e in enumerate(evaluations):
        if (p := fuse.part(e.query)) is not None:
            groups.setdefault(p.group, []).append((k, p))
    out: dict[int, Result] = {}
    for members in groups.values():
        if len(members) > 1:
            try:
                row = first_within(sql(fuse.fused([p for _, p in members])), timeout)
            except (PySparkException, SeedloomError):
                continue
            out |= {k: judge(evaluations[k], row[i]) for i, (k, _) in enumerate(members)}
    return [out[k] if k in out else alone(e, sql, timeout) for k, e in enumerate(evaluations)]


def report(spark: SparkSession, results: list[Result]) -> DataFrame:
    rows = [(r.name, None if r.value is None else str(r.value), r.expected, r.passed, r.error, r.informational) for r in results]
    return spark.createDataFrame(rows, "name string, value string, expected string, passed boolean, error string, informational boolean")


def lines(results: list[Result]) -> list[str]:
    out = []
    for r in results:
        mark = "INFO" if r.informational else "PASS" if r.passed else "FAIL"
        value = "NULL" if r.value is None else r.value
        out.append(f"{mark} {r.name}: {r.error or value}" + (f" (expected {r.expected})" if r.expected else ""))
    return out
