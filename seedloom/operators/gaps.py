"""Gap predicates over tables: counts, coverage by invariants, and what is left of a plan. One pass for all rules of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seedloom.functions.coerce import canonical
from seedloom.plans.dialect import Predicate
from seedloom.sources.gaprules import GapRule

#: Keys shown for each coverage finding.
SAMPLES = 5


def predicate(text: str, table: str, frame: DataFrame, names: dict[str, str] | None = None) -> Column:
    """A predicate as a column: true, false or null (unknown)."""
    return F.expr(Predicate(text, table, frame.schema, names).translated())


def gap(rule: GapRule, frame: DataFrame) -> Column:
    """Whether a row is bad; unknown is not."""
    return F.coalesce(predicate(rule.gap, rule.table_name, frame), F.lit(False))


def invariant(rule: GapRule, frame: DataFrame) -> Column | None:
    return predicate(rule.invariant, rule.table_name, frame) if rule.invariant and rule.invariant.strip() else None


def key_text(rule: GapRule, frame: DataFrame) -> Column:
    field = next(f for f in frame.schema.fields if f.name.lower() == rule.key.lower())
    return canonical(F.col(f"`{field.name}`"), field.dataType)


@dataclass(frozen=True)
class Coverage:
    """Rows that break the invariant outside the gap, that the gap selects although they keep it, that can't be judged."""

    uncovered: int
    selected_valid: int
    indeterminate: int
    uncovered_keys: list[str]
    selected_valid_keys: list[str]
    indeterminate_keys: list[str]


def coverage_columns(bad: Column, holds: Column) -> dict[str, Column]:
    return {"uncovered": F.coalesce(~holds, F.lit(False)) & ~bad, "selected_valid": bad & F.coalesce(holds, F.lit(False)), "indeterminate": holds.isNull()}


def coverage(bad: Column, holds: Column, key: Column, frame: DataFrame) -> DataFrame:
    """One row: the three counts, and the smallest keys of each. Samples are merged as short arrays, never as whole lists."""
    kinds = coverage_columns(bad, holds)
    counts = frame.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    rows = frame.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("kind"), key.alias("key"))
    # A limit by rank: Spark keeps only the first rows of each group before the exchange.
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy("key"))).filter(F.col("r") <= SAMPLES)
    samples = first.groupBy().agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("key")))).alias(f"{k}_keys") for k in kinds])
    return counts.withColumn("one", F.lit(1)).join(samples.withColumn("one", F.lit(1)), "one").drop("one")


def rule_coverage(rule: GapRule, frame: DataFrame) -> Coverage | None:
    """None without an invariant: there is nothing to compare with."""
    holds = invariant(rule, frame)
    return None if holds is None else Coverage(**coverage(gap(rule, frame), holds, key_text(rule, frame), frame).first().asDict())


def gap_counts(rules: list[GapRule], frame: DataFrame) -> dict[str, int]:
    """The gaps of all rules of one table, from one pass."""
    row = frame.agg(*[F.count_if(gap(r, frame)).alias(f"r{k}") for k, r in enumerate(rules)]).first()
    return {r.id: row[f"r{k}"] for k, r in enumerate(rules)}


def gap_rows(rule: GapRule, frame: DataFrame, ordered: bool = True) -> DataFrame:
    """Key, column and inputs of the bad rows, by key if ordered."""
    names = list(dict.fromkeys(next(f.name for f in frame.schema.fields if f.name.lower() == n.lower()) for n in [rule.key, rule.column, *(rule.inputs or ())]))
    rows = frame.filter(gap(rule, frame)).select([f"`{n}`" for n in names])
    return rows.orderBy(f"`{names[0]}`") if ordered else rows


def remaining(rule: GapRule, frame: DataFrame, keys: DataFrame) -> DataFrame:
    """Of planned keys (text, column 'key'), those whose rows are still bad."""
    bad = frame.filter(gap(rule, frame)).select(key_text(rule, frame).alias("key"))
    return bad.join(keys, "key", "left_semi")


def violations(rule: GapRule, frame: DataFrame) -> int:
    return frame.filter(~invariant(rule, frame)).count()
