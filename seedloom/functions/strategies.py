"""Strategies: how a column's raw values come from draws."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.errors import GenerationError
from seedloom.functions import faker
from seedloom.functions.draw import Draw
from seedloom.plans.infer import DAYS, capped
from seedloom.sources.ddl import ColumnDef
from seedloom.sources.rules import ColumnRule

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TOKEN = re.compile(r"\{row\}|\{guid\}|\{rand:(\d+)(?:-(\d+))?\}")


@dataclass(frozen=True)
class Context:
    column: ColumnDef
    rule: ColumnRule
    draw: Draw

    @property
    def where(self) -> str:
        return f"column {self.column.name!r}"


def number(text: str | None, default: str, where: str) -> Decimal:
    try:
        return Decimal(default if text is None else text)
    except InvalidOperation:
        raise GenerationError(f"{where}: {text!r} is not a number") from None


def moment(text: str | None, default: str, where: str) -> dt.datetime:
    try:
        return dt.datetime.fromisoformat(default if text is None else text)
    except ValueError:
        raise GenerationError(f"{where}: {text!r} is not a date") from None


def int_range(c: Context) -> tuple[int, int]:
    low, high = int(number(c.rule.min, "0", c.where)), int(number(c.rule.max, "1000000", c.where))
    if low > high:
        raise GenerationError(f"{c.where}: min {low} is above max {high}")
    return low, high


def day_range(c: Context) -> tuple[dt.datetime, int, int]:
    """The first moment, and the days and seconds to the last."""
    low, high = moment(c.rule.min, DAYS[0], c.where), moment(c.rule.max, DAYS[1], c.where)
    if low > high:
        raise GenerationError(f"{c.where}: min {low} is after max {high}")
    gap = high - low
    return low, gap.days, gap.days * 86_400 + gap.seconds


def int_(c: Context) -> Column:
    low, high = int_range(c)
    return c.draw.below(high - low + 1) + F.lit(low).cast("long")


def decimal(c: Context) -> Column:
    low, high = number(c.rule.min, "0", c.where), number(c.rule.max, "10000", c.where)
    if low > high:
        raise GenerationError(f"{c.where}: min {low} is above max {high}")
    return F.lit(float(low)) + c.draw.unit() * float(high - low)


def bool_(c: Context) -> Column:
    return c.draw.unit() < F.lit(0.5 if c.rule.true_rate is None else c.rule.true_rate)


def date(c: Context) -> Column:
    low, days, _ = day_range(c)
    return F.date_add(F.lit(low.date()), c.draw.below(days + 1).cast("int"))


def datetime(c: Context) -> Column:
    low, _, seconds = day_range(c)
    return F.lit(low.isoformat(" ")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.draw.below(seconds + 1).cast("decimal(18,6)"))


def time(c: Context) -> Column:
    s = c.draw.below(86_400)
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two(s % 3600 / 60), two(s % 60))


def guid_of(hexes: Column) -> Column:
    """32 hexadecimal digits in the form of a version 4 GUID."""
    part = lambda a, n: F.substring(hexes, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def guid(c: Context) -> Column:
    return guid_of(c.draw.text())


#: Characters that one 60-bit draw gives: 62**8 is far below 2**60, so all are nearly equally likely.
CHARACTERS = 8
#: Lengths up to which each character is an expression of its own, which code generation shares draws among.
UNROLLED = 64


def string(c: Context) -> Column:
    n, base = max(1, c.rule.length if c.rule.length is not None else capped(c.column.length, 20)), len(ALPHABET)
    letter = lambda bits, power: F.substring(F.lit(ALPHABET), (F.call_function("div", bits, power) % base + 1).cast("int"), F.lit(1))
    if n <= UNROLLED:
        return F.concat(*[letter(c.draw.bits(k // CHARACTERS, wide=True), F.lit(base ** (k % CHARACTERS)).cast("long")) for k in range(n)])
    powers = F.array(*[F.lit(base**k).cast("long") for k in range(CHARACTERS)])
    blocks = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // CHARACTERS)), lambda b: F.array_join(F.transform(F.array(c.draw.bits(b, wide=True)), lambda v: F.array_join(F.transform(powers, lambda p: letter(v, p)), "")), ""))
    return F.substring(F.array_join(blocks, ""), 1, n)


def bytes_(c: Context) -> Column:
    n = c.rule.length if c.rule.length is not None else capped(c.column.length, 16)
    hexes = F.concat(*[c.draw.text(k) for k in range(-(-n // 16) or 1)])
    return F.unhex(F.substring(hexes, 1, 2 * n))


def template(c: Context) -> Column:
    text, parts, at, slot = c.rule.template or "", [], 0, 0
    for m in TOKEN.finditer(text):
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        at, slot = m.end(), slot + 1
        if m[0] == "{row}":
            parts.append(c.draw.row.cast("string"))
        elif m[0] == "{guid}":
            parts.append(guid_of(c.draw.text(slot)))
        else:
            low, high = int(m[1]), int(m[2] or m[1])
            if low > high:
                raise GenerationError(f"{c.where}: {m[0]} is empty")
            parts.append((c.draw.below(high - low + 1, slot) + low).cast("string"))
    return F.concat(*parts, F.lit(text[at:]))


def alias_table(weights: list[float]) -> tuple[list[float], list[int]]:
    """Walker's tables: a place stays with the given share, else its alias is taken. Any number of weights costs one step."""
    n, total = len(weights), sum(weights)
    if total <= 0 or min(weights) < 0:
        raise GenerationError("weights must add up to more than zero, and none may be below zero")
    share, alias = [w * n / total for w in weights], list(range(n))
    low, high = [k for k in range(n) if share[k] < 1], [k for k in range(n) if share[k] >= 1]
    stay = [1.0] * n
    while low and high:
        a, b = low.pop(), high[-1]
        stay[a], alias[a] = share[a], b
        share[b] -= 1 - share[a]
        if share[b] < 1:
            low.append(high.pop())
    return stay, alias


def chosen(values: list[str | None], weights: list[float] | None, d: Draw, slot: int = 0) -> Column:
    """The index of a value, from 0."""
    if weights is None:
        return d.below(len(values), slot).cast("int")
    stay, alias = alias_table(weights)
    at = d.unit(slot) * F.lit(float(len(weights)))
    place = F.floor(at).cast("int")
    return F.when(at - place < F.get(F.array(*map(F.lit, stay)), place), place).otherwise(F.get(F.array(*map(F.lit, alias)), place))


def pick(c: Context) -> Column:
    values = list(c.rule.values or ())
    return F.element_at(F.array(*[F.lit(v) for v in values]), chosen(values, list(c.rule.weights) if c.rule.weights else None, c.draw) + 1)


def sequence(c: Context) -> Column:
    start, step = (1 if v is None else v for v in (c.rule.start, c.rule.step))
    return F.lit(start).cast("long") + F.lit(step).cast("long") * (c.draw.row - 1)


def faker_(c: Context) -> Column:
    return faker.resolve(c.rule.method or "")(c.draw)


def constant(c: Context) -> Column:
    return F.lit(c.rule.value)


#: Strategies that need nothing but the row; query and dataset need other tables and are resolved by the generator.
SIMPLE: dict[str, tuple[Callable[[Context], Column], T.DataType]] = {
    "int": (int_, T.LongType()), "decimal": (decimal, T.DoubleType()), "bool": (bool_, T.BooleanType()), "date": (date, T.DateType()), "datetime": (datetime, T.TimestampNTZType()),
    "time": (time, T.StringType()), "guid": (guid, T.StringType()), "string": (string, T.StringType()), "bytes": (bytes_, T.BinaryType()), "template": (template, T.StringType()),
    "pick": (pick, T.StringType()), "sequence": (sequence, T.LongType()), "faker": (faker_, T.StringType()), "constant": (constant, T.StringType()),
}
STRATEGIES = [*SIMPLE, "query", "dataset", "skip", "dbDefault", "auto"]
