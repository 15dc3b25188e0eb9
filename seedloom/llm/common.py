"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.shared import settle, shared_dir  # noqa: F401 - for the operators


def forget(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
a_z = A_Z.lower()

#: Words of the word-based contracts, for text whose A-Z are still upper case (same words as after lower-casing).
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of the white-space contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a text whose words are held at once.
PIECE = 1 << 20


def word_lists(pattern: re.Pattern[bytes], text: bytes) -> Iterator[list[bytes]]:
    """The matches of a pattern (a run of bytes of some kind) in a text, in lists of those of a piece of it."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text) and (m := pattern.match(text, end)):
            end = m.end()
        yield pattern.findall(text, at, end)
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also where body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, A_Z, a_z)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that don't occur in df (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        n, k = name, 0
        while n.lower() in taken:
            k += 1
            n = f"{name}_{k}"
        taken.add(n.lower())
        out.append(n)
    return out


MATCHES = "array<struct<s:int,e:int,m:string>>"
#: Items added to an array at once.
BLOCK = 256


def in_blocks(items: Column) -> Column:
    """A non-empty array cut into arrays of BLOCK items."""
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK)), lambda k: F.slice(items, k + 1, F.lit(BLOCK)))


def fold(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """The arrays (of type out) that step(state, item) gives beside the next state, and last(state), one after the other.

    An array that grows by one item at a time is copied each time, so the result grows in blocks."""
    none = F.expr(f"cast(array() as {out})")
    pair = lambda s, o: F.struct(s.alias("s"), o.cast(out).alias("o"))

    def one(a: Column, x: Column) -> Column:
        s, o = step(a["s"], x)
        return pair(s, F.concat(a["o"], o))

    def more(a: Column, block: Column) -> Column:
        return let(F.aggregate(block, pair(a["s"], none), one), lambda b: pair(b["s"], F.concat(a["o"], b["o"])))

    end = (lambda a: F.concat(a["o"], last(a["s"])).cast(out)) if last else (lambda a: a["o"])
    return let(items, lambda xs: F.when(F.size(xs) == 0, none).otherwise(F.aggregate(in_blocks(xs), pair(state, none), more, end)))


def match_spans(text: Column, pattern: str | Column, measure: Callable[[Column], Column] = F.length) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches, in code points from 0, or in what measure counts.

    The pieces between the matches and the matches themselves alternate, so their lengths add up to the positions."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + measure(x["g"])
        e = s + measure(x["m"])
        return e, F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))

    def positions(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("g"), found.alias("m"))
        return F.when(F.size(found) == 0, F.expr(f"cast(array() as {MATCHES})")).otherwise(fold(pairs, F.lit(0), MATCHES, step))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), positions).cast(MATCHES)


STRETCHES = "array<struct<s:int,e:int>>"


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """text with each stretch of overlapping spans (s, e; sorted by s) replaced by mark; null stays null."""
    stretch = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    none = F.expr(f"cast(array() as {STRETCHES})")

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        joins = x["s"] < a["e"]
        return stretch(F.when(joins, a["s"]).otherwise(x["s"]), F.when(joins, F.greatest(a["e"], x["e"])).otherwise(x["e"])), F.when(joins | (a["e"] < 0), none).otherwise(F.array(a))

    def cut(m: Column) -> Column:
        def piece(block: Column, j: Column) -> Column:
            low = F.coalesce(F.get(m, j * BLOCK - 1)["e"], F.lit(0))
            return let(F.struct(low.alias("low"), F.substring(text, low + 1, F.element_at(block, -1)["e"] - low).alias("t")), lambda b: F.array_join(F.transform(
                block, lambda x, i: let(F.coalesce(F.get(block, i - 1)["e"], b["low"]), lambda at: F.concat(F.substring(b["t"], at - b["low"] + 1, x["s"] - at), F.lit(mark)))), ""))

        return F.concat(F.array_join(F.transform(in_blocks(m), piece), ""), F.substring(text, F.element_at(m, -1)["e"] + 1, F.length(text)))

    whole = fold(spans, stretch(F.lit(-1), F.lit(-1)), STRETCHES, step, F.array)
    return let(whole, lambda m: F.when(F.size(m) == 0, text).otherwise(cut(m)))
