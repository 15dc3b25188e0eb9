"""A reproducible permutation of 0..n-1, computed for each number by itself: Feistel rounds with cycle walking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Steps of the cycle walk that every number takes; what is then still outside goes on as far as a walk can go.
WALK = 4


def noise(x: Column, seed: int | str, round_: Column) -> Column:
    """32 bits of a hash that other SQL engines have as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), round_.cast("string"), x.cast("string"))), 1, 8), 16, 10).cast("long")


def feistel(p: Column, side: Column, seed: int | str) -> Column:
    """A permutation of 0..side * side - 1."""
    halves = F.struct(F.call_function("div", p, side).alias("a"), F.pmod(p, side).alias("b"))
    step = lambda h, k: F.struct(h["b"].alias("a"), F.pmod(h["a"] + noise(h["b"], seed, k), side).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, step, lambda h: h["a"] * side + h["b"])


def side_of(n: Column) -> Column:
    """The side of the smallest square that holds n numbers."""
    return F.ceil(F.sqrt(n.cast("double"))).cast("long")


def permute(p: Column, n: Column, side: Column, seed: int | str) -> Column:
    """A permutation of 0..n-1: walk the cycle of feistel() until it is back below n. A number outside 0..n-1 is an error.

    At most side * side - n numbers lie outside, so no walk is longer; few numbers take more than the first steps."""
    walk = lambda a: F.when(a < n, a).otherwise(feistel(a, side, seed))
    rest = lambda a: F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(side * side - n, F.lit(1).cast("long"))), a, lambda acc, _: walk(acc))
    inside = F.when((p >= 0) & (p < n), p).when(p.isNotNull(), F.raise_error(F.concat(F.lit("not a number to permute: "), p.cast("string"))).cast("long"))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(inside, side, seed), lambda acc, _: walk(acc))
    return F.element_at(F.transform(F.array(near), lambda a: F.when(a < n, a).otherwise(rest(a))), 1)
