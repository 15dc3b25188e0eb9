"""Values by their number: which draws make up a value, counted in mixed radix, so that distinct numbers give distinct values.

A value is made of independent draws (the letters of a string in blocks, the numbers of a template, the words of a name).
If different draws give different values, the draws' sizes multiply to the size of the domain, and a number below it has
one draw in each place. A unique column takes a permutation of the numbers, without a shuffle and without trying. Only
as many places are counted as a long holds; draws beyond them are the usual hashes of the row and change nothing about
uniqueness.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.errors import GenerationError
from seedloom.functions import faker
from seedloom.functions.draw import Draw
from seedloom.functions.strategies import ALPHABET, CHARACTERS, TOKEN, UNROLLED, Context
from seedloom.plans.infer import capped

#: Domains are counted up to here: a permutation needs the square of its side in a long.
LARGEST = 1 << 62
#: No vocabulary's value is longer, but those of lorem, which aren't counted.
LONGEST = 80
#: Bytes that one number gives.
BYTES = 7


@dataclass(frozen=True)
class Places:
    """Slots and their sizes, the first place changing fastest."""

    sizes: dict[int, int]

    @property
    def size(self) -> int:
        n = 1
        for s in self.sizes.values():
            n *= s
        return n

    def weights(self) -> dict[int, int]:
        out, at = {}, 1
        for slot, size in self.sizes.items():
            out[slot] = at
            at *= size
        return out


def counted(sizes: dict[int, int]) -> Places | None:
    """The first places whose product a permutation can take."""
    kept, n = {}, 1
    for slot, size in sizes.items():
        if n * size > LARGEST:
            break
        kept[slot] = size
        n *= size
    return Places(kept) if n > 1 else None


class Ranked(Draw):
    """A draw whose places are the digits of a number."""

    def __init__(self, draw: Draw, places: Places, index: Column) -> None:
        self.prefix, self.row, self.attempt = draw.prefix, draw.row, draw.attempt
        self.places, self.weight, self.index = places, places.weights(), index

    def digit(self, slot: int | Column) -> Column | None:
        if not isinstance(slot, int) or slot not in self.weight:
            return None
        return F.call_function("div", self.index, F.lit(self.weight[slot]).cast("long")) % F.lit(self.places.sizes[slot]).cast("long")

    def bits(self, slot: int | Column = 0, wide: bool = False) -> Column:
        own = self.digit(slot)
        return super().bits(slot, wide) if own is None else own

    def below(self, n: int | Column, slot: int | Column = 0) -> Column:
        own = self.digit(slot)
        return super().below(n, slot) if own is None else own


@dataclass
class Recorder(Draw):
    """Notes what a method draws; regular says whether all of it can be counted."""

    sizes: dict[int, int] = field(default_factory=dict)
    regular: bool = True
    row: Column | None = None

    def below(self, n: int | Column, slot: int | Column = 0) -> Column:
        if not isinstance(n, int) or not isinstance(slot, int) or self.sizes.get(slot, n) != n:
            self.regular = False
        else:
            self.sizes[slot] = n
        return F.lit(0).cast("long")

    def bits(self, slot: int | Column = 0, wide: bool = False) -> Column:
        self.regular = False
        return F.lit(0).cast("long")

    def text(self, slot: int | Column = 0) -> Column:
        self.regular = False
        return F.lit("")


def of_template(text: str) -> tuple[dict[int, int], int] | None:
    """A template's numbers by their slots, and the length of its longest text. None if two ways of drawing can give one
    text: a number of changing width must be followed by something that isn't a digit, or by the end."""
    tokens = list(TOKEN.finditer(text))
    sizes, longest = {}, len(TOKEN.sub("", text))
    for slot, m in enumerate(tokens, 1):
        if not m[0].startswith("{rand"):
            return None
        low, high = int(m[1]), int(m[2] or m[1])
        if low > high:
            return None
        rest = text[m.end() :]
        if len(str(low)) != len(str(high)) and rest and (rest[0].isdigit() or TOKEN.match(rest)):
            return None
        sizes[slot] = high - low + 1
        longest += len(str(high))
    return sizes, longest


def places(c: Context, strategy: str) -> Places | None:
    """What a unique column's values are counted by; None if they can't be."""
    kind, length = c.column.spark_type(), c.column.length
    room = length if length is not None and length > 0 else None
    if strategy == "bytes":
        n = c.rule.length if c.rule.length is not None else capped(length, 16)
        return counted({0: 256 ** min(n, BYTES)}) if isinstance(kind, T.BinaryType) and n > 0 and (room is None or room >= min(n, BYTES)) else None
    if not isinstance(kind, T.StringType):
        return None
    if strategy == "time":
        return counted({0: 86_400}) if room is None or room >= 8 else None
    if strategy == "string":
        n = max(1, c.rule.length if c.rule.length is not None else capped(length, 20))
        kept = min(n, room or n)
        return counted({k: len(ALPHABET) ** min(CHARACTERS, kept - k * CHARACTERS) for k in range(-(-kept // CHARACTERS))}) if n <= UNROLLED else None
    if strategy == "template":
        found = of_template(c.rule.template or "")
        return counted(found[0]) if found and (room is None or room >= found[1]) else None
    if strategy == "faker" and not re.match("(?i)lorem[.]", c.rule.method or ""):
        noted = Recorder()
        try:
            faker.resolve(c.rule.method or "")(noted)
        except (GenerationError, TypeError):
            return None
        return counted(noted.sizes) if noted.regular and (room is None or room >= LONGEST) else None
    return None


def value_at(c: Context, strategy: str, found: Places, index: Column, make) -> Column:
    """The value with a number, by the strategy's own function."""
    if strategy == "bytes":
        n = c.rule.length if c.rule.length is not None else capped(c.column.length, 16)
        first = F.unhex(F.lpad(F.hex(index), 2 * min(n, BYTES), "0"))
        return first if n <= BYTES else F.concat(first, F.substring(make(c), BYTES + 1, n - BYTES))
    return make(Context(c.column, c.rule, Ranked(c.draw, found, index)))
