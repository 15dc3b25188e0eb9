"""Quality classifier: a sparse ensemble of rules over text statistics (after Friedman and Popescu, 2008).

Trees are boosted on labelled rows; each path in them is a rule, a conjunction of conditions on statistics; a logistic
regression with an L1 penalty keeps the rules that matter. What stays is compiled into one Spark column expression.

The model is fitted on the driver on at most SAMPLE labelled rows, those with the smallest hashes of their ids; held-out
rows are never among them. Scores use the text alone. Null text counts as empty and is scored like any other. Without
labels of both classes the score is the share of the one there is (0.5 without any). A doc_id labelled twice counts
once, with its lower label. Repeated rows are scored each on its own. Very long texts are counted whole. Extra columns
are kept; a clash with the added name gives it a suffix. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm import trees
from seedloom.llm.common import fresh, let, table
from seedloom.llm.quality_rules import counts

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.002
LIMIT = 0.7

#: Statistics, and the counts that each is made of.
STATISTICS = {
    "words": ("n_words",), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "marks": ("n_marks", "n_words"), "uppers": ("n_upper", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "line_words": ("n_words", "n_lines"), "digits": ("word_chars",), "stops": ("n_words",), "distinct": ("n_words",),
}
NAMES = list(STATISTICS)


def statistics(text: Column, only: Collection[str] = NAMES) -> Column:
    """A struct of STATISTICS as doubles; all are rates but the logarithm of the number of words. Those that aren't among
    only are zero and cost nothing."""
    text = F.coalesce(text, F.lit(""))
    distinct = let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.size(F.array_distinct(w)))

    def of(c: Column) -> Column:
        words, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
        values = [
            F.log1p(c["n_words"].cast("double")), c["word_chars"] / words, c["n_symbols"] / chars, c["n_marks"] / words, c["n_upper"] / chars,
            c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)), c["n_repeat_words"] / words, c["n_words"] / F.greatest(c["n_lines"], F.lit(1)),
            F.regexp_count(text, F.lit("[0-9]")) / chars, F.regexp_count(text, F.lit(r"[.,;:?]")) / words, distinct / words,
        ]
        return F.struct(*[(F.round(v.cast("double"), 6) if n in only else F.lit(0.0)).alias(n) for n, v in zip(NAMES, values, strict=True)])

    return let(counts(text, {c for n in only for c in STATISTICS[n]}), of)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: list[tuple[trees.Rule, float]]

    def used(self) -> set[str]:
        """The statistics that the rules ask for."""
        return {NAMES[f] for rule, _ in self.rules for f, _, _ in rule}

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for f, low, t in rule:
                x = stats[NAMES[f]]
                met = met & ((x <= F.lit(t)) if low else (x > F.lit(t)))
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(SAMPLE)
    # At most SAMPLE ids and labels: bounded.
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("k")).select("k", F.col("y").cast("double").alias("y"), statistics(F.col(text_col).cast("string")).alias("s"))
    rows = rows.groupBy("k").agg(F.first("y").alias("y"), F.min("s").alias("s")).select("k", "y", "s.*").toPandas().sort_values("k")
    x, y = rows[NAMES].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float)
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(float(np.log(share / (1 - share))), [])
    _, grown = trees.boost(x, y, TREES, DEPTH)
    found = list(dict.fromkeys(r for t in grown for r in trees.rules(t)))
    intercept, weights = trees.lasso(np.column_stack([trees.holds(r, x) for r in found]).astype(float), y, LASSO)
    return Model(intercept, [(r, float(w)) for r, w in zip(found, weights, strict=True) if w])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a score column, and its name."""
    (name,) = fresh(docs, "score")
    of = let(statistics(F.col(text_col).cast("string"), model.used()), model.score)
    return docs.withColumn(name, of), name


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, name = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), F.when(F.col(name) >= LIMIT, 1).otherwise(0).alias("predicted"))
