"""Quality rules whose limits follow the data: mergeable quantile sketches for each language and source.

Counts for each text, from built-in functions alone. Rates of them go into histogram sketches (a bucket keeps the leading
bits of an integer, so a quantile is off by less than 1 / 64 of itself); sketches are exact sums of counts, so they merge
in any order, by language and over all, and give the same limits at every partitioning. A language's limits lean on those
of all documents as if WEIGHT documents spoke for these, a source's in the same way on its language's; so small groups
take the limits of what they belong to, and a group that grows moves to its own without a step. The limits are joined to
the documents.

A null or wordless text has zero counts and fails the base rule of ten words. A null language or source is a group like
others. Repeated rows are judged each on its own; rates that tie with a limit pass. Very long texts are handled whole.
Repeated windows inside a text are found by 64-bit hashes. Extra columns are kept; if they clash with added names, the
added ones get a suffix. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import fresh, let, settle, table

#: Documents that a group's parent counts as.
WEIGHT = 50
#: Leading bits that a sketch bucket keeps.
SKETCH_BITS = 7
#: Rate names with the least distance in per mille between the limit and the upper quantile: most texts have rates of zero,
#: and without it any other text would be beyond their limits. For repeats it leaves the limit below the base rule's share.
RATES = {"symbol_rate": 60, "mark_rate": 100, "upper_rate": 200, "dup_line_rate": 400, "repeat_rate": 150}
#: The limit is q_high + max(SPREAD * (q_high - q_mid), the least distance of the rate).
Q_MID, Q_HIGH, SPREAD = 25, 75, 4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"]


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more. Windows are compared by 64-bit hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))

    def places(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"],
        )

    zero = F.lit(0).cast("long")
    count = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(
        windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(covered(places(g)))))
    return F.when(F.size(words) < 5, zero).otherwise(count)


def counts(text: Column, only: Collection[str] = COUNTS) -> Column:
    """A struct of COUNTS; those that aren't among only are zero and cost nothing."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        values = {
            "n_words": lambda: F.size(w), "word_chars": lambda: F.length(F.array_join(w, "")), "n_symbols": lambda: F.regexp_count(text, F.lit(r"[#*$%&|<>]")), "n_dup_lines": lambda: let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": lambda: repeated_words(w), "n_lines": lambda: F.size(lines), "n_marks": lambda: F.regexp_count(text, F.lit("!")), "n_upper": lambda: F.regexp_count(text, F.lit("[A-Z]")),
        }
        return F.struct(*[(values[n]() if n in only else F.lit(0)).cast("long").alias(n) for n in COUNTS])

    return let(words, of)


def rates(c: Column) -> dict[str, Column]:
    """Integers in per mille."""
    per = lambda n, of: F.expr("cast(0 as long)") if of is None else F.floor(c[n] * 1000 / F.greatest(c[of], F.lit(1))).cast("long")
    return {
        "symbol_rate": per("n_symbols", "word_chars"), "mark_rate": per("n_marks", "n_words"), "upper_rate": per("n_upper", "word_chars"),
        "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"),
    }


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 10) | (c["n_repeat_words"] * 100 > c["n_words"] * 20)


def sketch(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys, rate, bucket, n: the sketch of each rate in each group."""
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("v")) for k, v in values.items()])).alias("x"))
    bucket = F.expr(f"x.v - x.v % shiftleft(1L, greatest(length(bin(x.v)) - {SKETCH_BITS}, 0))")
    return rows.groupBy(*keys, F.col("x.rate").alias("rate"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def limits(sketches: DataFrame, lang: str, source: str) -> DataFrame:
    """q_lang, q_source, limits: a map of the rates' limits for each group that the sketches hold."""
    s = sketches.select(F.col(lang).alias("lang"), F.col(source).alias("source"), "rate", "bucket", "n")
    merged = (
        s.select(F.lit(0).alias("level"), "lang", "source", "rate", "bucket", "n")
        .unionByName(s.select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "rate", "bucket", "n"))
        .unionByName(s.select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "rate", "bucket", "n"))
        .groupBy("level", "lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    )
    # A sketch has a bounded number of buckets, so one sorted array for each group and rate is bounded too.
    arrays = merged.groupBy("level", "lang", "source", "rate").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))

    def quantile(q: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("long").alias("at"))
        step = lambda a, x: F.struct(
            (a["cum"] + x["n"]).alias("cum"), F.when(a["at"].isNull() & ((a["cum"] + x["n"]) * 100 >= F.col("total") * q), x["bucket"]).otherwise(a["at"]).alias("at"))
        return F.aggregate("b", start, step, lambda a: a["at"])

    least = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    fence = arrays.withColumn("mid", quantile(Q_MID)).withColumn("high", quantile(Q_HIGH)).select(
        "level", "lang", "source", "total", "rate", (F.col("high") + F.greatest((F.col("high") - F.col("mid")) * SPREAD, least[F.col("rate")])).alias("fence"))
    each = fence.groupBy("level", "lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rate", "fence"))).alias("m"), F.max("total").alias("total"))
    each = settle(each)
    # One map of a limit for each rate.
    whole = each.filter("level = 2").select("m").first()
    whole = F.create_map(*[F.lit(x) for kv in (whole["m"] if whole else {"": 0}).items() for x in kv]).cast("map<string,bigint>")

    def leaning(own: Column, total: Column, parent: Column) -> Column:
        return F.transform_values(own, lambda rate, v: F.call_function("div", v * total + parent[rate] * WEIGHT, total + WEIGHT))

    own = each.filter("level = 0")
    by_lang = each.filter("level = 1").select(F.col("lang").alias("l_lang"), leaning(F.col("m"), F.col("total"), whole).alias("l_m"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")))
    return joined.select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), leaning(F.col("m"), F.col("total"), F.col("l_m")).alias("limits"))


def judged(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, str, Column]:
    """The columns keep of docs, a struct column of COUNTS and its name, and the verdict (true: keep)."""
    name, lang, source = fresh(docs, "counts", "q_lang", "q_source")
    rows = docs.select(*keep, F.col(lang_col).cast("string").alias(lang), F.col(source_col).cast("string").alias(source), counts(F.col(text_col).cast("string")).alias(name))
    rows = settle(rows)
    c = F.col(name)
    # Written first, so that its size is known when the join is planned: broadcast while it is small, a shuffle beyond.
    fences = settle(limits(sketch(rows, [lang, source], rates(c)), lang, source)).select(F.col("q_lang").alias("f_lang"), F.col("q_source").alias("f_source"), F.col("limits").alias("f_limits"))
    out = rows.join(fences, F.col(lang).eqNullSafe(F.col("f_lang")) & F.col(source).eqNullSafe(F.col("f_source")), "left")
    inside = F.lit(True)
    for rate, value in rates(c).items():
        inside = inside & (value <= F.col("f_limits")[rate])
    return out, name, ~base_failed(c) & F.coalesce(inside, F.lit(True))


def quality_filter(docs: DataFrame, **columns: str) -> DataFrame:
    """docs that pass the base rules and the adaptive limits."""
    rows, _, kept = judged(docs, docs.columns, **columns)
    return rows.filter(kept).select(docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name, kept = judged(table(spark, sf_dir, "documents"), ["doc_id"])
    c = F.col(name)
    return rows.select("doc_id", *[c[k].alias(k) for k in COUNTS[:5]], base_failed(c).alias("base_failed"), kept.alias("kept"))


OP10_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r),
c AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             len(ls) AS n_lines, len(regexp_extract_all(text, '!')) AS n_marks, len(regexp_extract_all(text, '[A-Z]')) AS n_upper
      FROM w LEFT JOIN rep USING (r)),
v AS (SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate, n_marks * 1000 // greatest(n_words, 1) AS mark_rate,
             n_upper * 1000 // greatest(word_chars, 1) AS upper_rate, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate,
             n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate FROM c),
u AS (SELECT lang, source, rate, v - v % (1 << greatest(length(bin(v)) - {SKETCH_BITS}, 0)) AS b FROM (
      {" UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, CAST({k} AS BIGINT) AS v FROM v" for k in RATES)})),
lv AS (SELECT 0 AS level, lang, source, rate, b FROM u UNION ALL SELECT 1, lang, NULL, rate, b FROM u UNION ALL SELECT 2, NULL, NULL, rate, b FROM u),
cum AS (SELECT level, lang, source, rate, b, count(*) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS cum,
               count(*) OVER (PARTITION BY level, lang, source, rate) AS total FROM lv),
q AS (SELECT level, lang, source, rate, any_value(total) AS total, min(b) FILTER (WHERE cum * 100 >= total * {Q_MID}) AS mid,
             min(b) FILTER (WHERE cum * 100 >= total * {Q_HIGH}) AS high FROM cum GROUP BY ALL),
f AS (SELECT *, high + greatest((high - mid) * {SPREAD}, CASE rate {" ".join(f"WHEN '{k}' THEN {m}" for k, m in RATES.items())} END) AS fence FROM q),
langs AS (SELECT l.lang, l.rate, CAST(l.fence * l.total + a.fence * {WEIGHT} AS BIGINT) // (l.total + {WEIGHT}) AS fence FROM f l JOIN f a ON a.level = 2 AND a.rate = l.rate WHERE l.level = 1),
chosen AS (SELECT o.lang, o.source, o.rate, CAST(o.fence * o.total + l.fence * {WEIGHT} AS BIGINT) // (o.total + {WEIGHT}) AS fence
           FROM f o JOIN langs l ON l.lang IS NOT DISTINCT FROM o.lang AND l.rate = o.rate WHERE o.level = 0),
p AS (SELECT lang, source, {", ".join(f"max(fence) FILTER (WHERE rate = '{k}') AS f_{k}" for k in RATES)} FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
       NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND {" AND ".join(f"{k} <= f_{k}" for k in RATES)} AS kept
FROM v JOIN p ON v.lang IS NOT DISTINCT FROM p.lang AND v.source IS NOT DISTINCT FROM p.source
"""
