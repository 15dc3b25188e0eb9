"""License scans: ordered signature rules behind a keyword prefilter, with containment suppression.

Texts become lists of lower-case words. A keyword is a word that every match of a rule has (see license_rules); which
keywords a text has is found in one pass over its words, and a rule runs only where all of its keywords occur. Detections
are resolved from left to right: one inside a longer one goes, of two that overlap the one with the higher priority
stays. Three base phrases are counted besides, whatever the rules say.

Null text counts as empty. Repeated rows are scanned each on its own; of equal detections the first rule's stays. Very
long texts, also with very many detections, are scanned whole. Extra columns are kept; if they clash with added names,
the added ones get a suffix. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import fold, fresh, let, match_spans, table
from seedloom.llm.license_rules import read

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@functools.cache
def rules() -> list[tuple[int, list[str], str, str, float]]:
    """Priority, keywords, pattern over words between spaces, label, confidence."""
    return [(k, keys, f"(?<= )(?:{pattern})(?= )", label, sure) for k, (label, keys, sure, pattern) in enumerate(read())]


def lowered(text: Column) -> Column:
    """In lower case, so that words and their a-z are the same as with A-Z lowered alone: the kelvin sign has no letter k."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("é")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


FOUND = "array<struct<s:int,e:int,rank:int,label:string,sure:double>>"


def detections(normal: Column, present: Column) -> Column:
    """What the rules find in words with a space before and after each, resolved, by start; present: the text's keywords."""
    kind = "array<struct<rank:int,keys:array<string>,p:string,label:string,sure:double>>"
    listed = F.from_json(F.lit(json.dumps([dict(zip(("rank", "keys", "p", "label", "sure"), r, strict=True)) for r in rules()])), kind)
    live = F.filter(listed, lambda r: F.forall(r["keys"], lambda k: F.array_contains(present, k)))
    found = F.flatten(F.transform(live, lambda r: F.transform(match_spans(normal, r["p"]), lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("back"), r["rank"].alias("rank"), r["label"].alias("label"), r["sure"].alias("sure")))))
    ordered = F.transform(F.sort_array(found), lambda x: F.struct(x["s"].alias("s"), (-x["back"]).alias("e"), x["rank"].alias("rank"), x["label"].alias("label"), x["sure"].alias("sure")))
    none = F.expr(f"cast(array() as {FOUND})")

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        apart = x["s"] >= last["e"]
        stays = (x["e"] <= last["e"]) | (x["rank"] > last["rank"])
        return F.when(apart | ~stays, x).otherwise(last), F.when(apart & (last["e"] >= 0), F.array(last).cast(FOUND)).otherwise(none)

    start = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(-1).alias("rank"), F.lit("").alias("label"), F.lit(0.0).alias("sure"))
    return fold(ordered.cast(FOUND), start, FOUND, step, F.array)


PLACES = "array<struct<w:int,label:string>>"


def base_places(normal: Column) -> Column:
    """Where the base phrases stand, by the number of their first word: the spaces before it, which are counted once."""
    none = F.expr(f"cast(array() as {PLACES})")
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    def of(phrase: str, label: str) -> Column:
        places = F.transform(match_spans(normal, f"(?<= ){phrase}(?= )", spaces), lambda x: F.struct((x["s"] - 1).alias("w"), F.lit(label).alias("label")))
        return F.when(F.contains(normal, F.lit(f" {phrase} ")), places.cast(PLACES)).otherwise(none)

    return F.concat(*[of(phrase, label) for phrase, label in BASE.items()])


def scan(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with four more columns and their names: n_words, base places, detections, score."""
    names = fresh(docs, "n_words", "places", "detections", "score")
    (b,) = fresh(docs, "all_found")
    known = sorted({k for _, keys, _, _, _ in rules() for k in keys} | {w for phrase in BASE for w in phrase.split()})
    kind = f"struct<n:bigint,places:{PLACES},found:{FOUND}>"
    none = lambda k: F.expr(f"cast(array() as {k})")
    whole = lambda n, places, found: F.struct(n.cast("long").alias("n"), places.alias("places"), found.alias("found")).cast(kind)

    def found(words: Column, present: Column) -> Column:
        normal = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.when(F.size(present) == 0, whole(F.size(words), none(PLACES), none(FOUND))).otherwise(let(normal, lambda t: whole(F.size(words), base_places(t), detections(t, present))))

    keywords = F.split(F.lit(" ".join(known)), " ")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of = let(words_of(text), lambda words: let(F.array_intersect(words, keywords), lambda present: found(words, present)))
    out = docs.withColumn(b, of).withColumns({names[0]: F.col(b)["n"], names[1]: F.col(b)["places"], names[2]: F.col(b)["found"]}).drop(b)
    best = F.coalesce(F.array_max(F.transform(names[2], lambda x: x["sure"])), F.lit(0.0))
    return out.withColumn(names[3], F.when(F.size(names[1]) > 0, F.greatest(best, F.lit(0.95))).otherwise(best)), names


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, (n, places, found, score) = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform(places, lambda x: x["label"])
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    at = F.transform(places, lambda x: x["w"].cast("long"))
    return rows.select(
        "doc_id", F.col(n).alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform(found, lambda x: x["label"]))).alias("labels"), F.col(score).alias("score"),
    )
