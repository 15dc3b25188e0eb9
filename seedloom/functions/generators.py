"""Repair values by key: random ones, ones derived from the same row, and any faker method."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from seedloom.errors import ConfigError
from seedloom.functions import faker
from seedloom.functions.draw import Draw

#: Fixed value: the characters of the second part of security ids.
ID_ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def security_id(d: Draw) -> Column:
    """DE, three digits, six characters."""
    return F.concat(F.lit("DE"), faker.digits(d, 3, 1), *[faker.pick(d, list(ID_ALPHABET), k) for k in range(20, 26)])


@dataclass(frozen=True)
class Derived:
    inputs: tuple[str, ...]
    value: Callable[[dict[str, Column]], Column]
    floor: int


def bathrooms(inputs: dict[str, Column]) -> Column:
    """One for each three rooms begun, at least one. Kept apart from the rules' invariants, which say the same in SQL."""
    rooms = inputs["rooms"].cast("int")
    return F.when(rooms < 1, F.lit(1)).otherwise(F.expr("cast(0 as int)") + F.floor((rooms + 2) / 3).cast("int"))


RANDOM: dict[str, Callable[[Draw], Column]] = {
    "property.yearBuilt": lambda d: (d.below(71) + 1950).cast("int"),
    "security.securityId": security_id,
}
#: Keys that pick one of the values a query finds.
CANDIDATES = {"adventureworks.personId": "SELECT PersonID FROM Person.Person ORDER BY PersonID"}
DERIVED = {"security.bathroomsFromRooms": Derived(("rooms",), bathrooms, 1)}


def find[V](table: dict[str, V], key: str) -> V | None:
    return next((v for k, v in table.items() if k.lower() == key.lower()), None)


def random_keys() -> list[str]:
    return sorted([*RANDOM, *CANDIDATES, *faker.METHODS], key=str.lower)


def derived_keys() -> list[str]:
    return sorted(DERIVED, key=str.lower)


def is_derived(key: str) -> bool:
    return find(DERIVED, key) is not None


def is_random(key: str) -> bool:
    return any(k.lower() == key.lower() for k in random_keys())


def random_value(key: str, draw: Draw) -> Column:
    method = find(RANDOM, key) or find(faker.METHODS, key)
    if method is None:
        raise ConfigError(f"unknown fix key {key!r}; known: {', '.join(random_keys() + derived_keys())}")
    return method(draw)
