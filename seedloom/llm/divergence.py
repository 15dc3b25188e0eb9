"""Source divergence audit: how far each source's use of words is from its language's and from the other sources'.

1. Sketch. Each task counts in how many of its documents a (language, term) occurs and adds that to a count-min sketch of
   DEPTH rows of 2**WIDTH_BITS counters. A counter stops at the least document frequency, which loses nothing: whether a sum
   reaches it stays the same. Sketches are merged by adding, so they never underestimate; a term that has a counter below
   the least frequency can't be kept, and is left out before anything about it is shuffled. What is broadcast are the bits
   of the counters that reach it, DEPTH * 2**WIDTH_BITS bits however large the corpus is.
2. Exact counts of the terms that are left, summed in each task before the shuffle, by language, source and term.
3. Terms of a source against its language, and pairs of sources. A pair's sum goes over all kept terms, also those that
   neither source has. It is taken as if no term were common, from each source's histogram of counts; then only the
   terms that two sources share are joined, and what they differ by is added.

With p = 1 + floor(SCALE * (count + 1) / (N + V)) the value is floor((p - q) ** 2 / q); all of it is 64-bit integers, and
the quotient is divided out three digits at a time, so it holds up to N + V of 9e15.

Null text, language and source count as empty; empty ones are a language and a source like others. A source without terms
has pairs with all counts 0, a language without kept terms values of 0. Repeated rows count each. Very long texts are read
whole, a piece at a time. Ties are in the order of the terms' UTF-8 bytes. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedloom.llm.common import PIECE, forget, settle, table

#: A term is kept if it is in so many documents of its language.
LEAST_DOCS = 3
SCALE_DIGITS = 9
TOP = 200
DEPTH, WIDTH_BITS = 4, 20
#: Counters in a piece of a sketch, and sketches that are merged at a time.
PIECE_SLOTS, MERGED = 1 << 16, 256
#: Terms that a task holds before it passes them on.
HELD = 400_000
#: Of UTF-8 bytes: A-Z lower-cased, a-z and all beyond ASCII as they are, which make up terms; a space for each other.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of a piece of it."""
    text, at = text.translate(FOLDED), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def slots(lang: bytes, terms: list[bytes], width_bits: int = WIDTH_BITS) -> np.ndarray:
    """The terms' counters, one of each row of the sketch, numbered through all rows."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, terms, repeat(seed)), dtype=np.uint64, count=len(terms))
    rows = np.arange(DEPTH, dtype=np.int64) << width_bits
    return ((h[:, None] * _ODD[:DEPTH]) >> np.uint64(64 - width_bits)).astype(np.int64) + rows


def counted(batches: Iterator[pa.RecordBatch], by_source: bool, most: int) -> Iterator[tuple[dict, dict]]:
    """Occurrences and documents of each term by (language, source), or documents by (language,), some most terms at a time."""
    occurs: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            key = (lang, source) if by_source else (lang,)
            if key not in docs:
                docs[key], occurs[key] = Counter(), Counter()
            own, before = docs[key], len(docs[key])
            seen: set[bytes] = set()
            for words in term_lists(text):
                seen.update(words)
                if by_source:
                    occurs[key].update(words)
            own.update(seen)
            held += len(own) - before
            if held >= most:
                yield occurs, docs
                occurs, docs, held = {}, {}, 0
    yield occurs, docs


def sketcher(least: int, width_bits: int, held: int):
    """A task's sketch, in pieces: piece, counters (a byte each, at most least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(DEPTH << width_bits, dtype=np.int32)
        for _, docs in counted(batches, False, held):
            for (lang,), terms in docs.items():
                n = np.minimum(np.fromiter(terms.values(), dtype=np.int32, count=len(terms)), least)
                np.add.at(counters, slots(lang, list(terms), width_bits), n[:, None])
            np.minimum(counters, least, out=counters)
        pieces = counters.astype(np.uint8).reshape(-1, min(PIECE_SLOTS, len(counters)))
        full = np.flatnonzero(pieces.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pieces[k].tobytes() for k in full], pa.binary())], names=["piece", "counters"])

    return run


def merger(least: int):
    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros(len(rows.column("counters")[0].as_py()), dtype=np.int32)
        for x in rows.column("counters"):
            total = np.minimum(total + np.frombuffer(x.as_py(), dtype=np.uint8), least)
        return pa.table([rows.column("piece")[:1], rows.column("part")[:1], pa.array([total.astype(np.uint8).tobytes()], pa.binary())], names=["piece", "part", "counters"])

    return run


def sketch(rows: DataFrame, least: int, width_bits: int = WIDTH_BITS, held: int = HELD) -> np.ndarray:
    """Packed bits of the merged sketch: which counters reach least. MERGED sketches are merged at a time, in three steps."""
    least = min(least, 255)
    merged = rows.select("lang", "source", "text").mapInArrow(sketcher(least, width_bits, held), "piece int, counters binary").withColumn("part", F.spark_partition_id())
    for _ in range(3):
        merged = merged.withColumn("part", (F.col("part") / MERGED).cast("int")).groupBy("piece", "part").applyInArrow(merger(least), "piece int, part int, counters binary")
    counters = np.zeros(DEPTH << width_bits, dtype=np.uint8)
    for row in merged.collect():  # a byte for each counter
        at = row["piece"] * len(row["counters"])
        counters[at : at + len(row["counters"])] = np.frombuffer(row["counters"], dtype=np.uint8)
    return np.packbits(counters >= least)


def counter(shared, width_bits: int, held: int):
    """lang, source, term, n, docs of the terms that the sketch lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.unpackbits(shared.value).astype(bool)
        for occurs, docs in counted(batches, True, held):
            for (lang, source), own in docs.items():
                terms, count = list(own), occurs[lang, source]
                for k in range(0, len(terms), 1 << 16):
                    part = terms[k : k + (1 << 16)]
                    part = list(compress(part, reached[slots(lang, part, width_bits)].all(axis=1).tolist()))
                    if part:
                        columns = [pa.repeat(x.decode(), len(part)) for x in (lang, source)]
                        columns += [pa.array(part, pa.binary()).cast(pa.string()), *[pa.array(list(map(of.__getitem__, part)), pa.int64()) for of in (count, own)]]
                        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    return run


def p_of(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10 ** SCALE_DIGITS * (count + 1) / (total + kept)), exactly."""
    size = total + kept
    q, r = F.call_function("div", count + 1, size), (count + 1) % size
    for _ in range(SCALE_DIGITS // 3):
        q, r = q * 1000 + F.call_function("div", r * 1000, size), (r * 1000) % size
    return q + 1


def value_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", width_bits: int = WIDTH_BITS, held: int = HELD) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(sketch(rows, least_docs, width_bits, held))
    found = rows.mapInArrow(counter(shared, width_bits, held), "lang string, source string, term string, n long, docs long")
    # One shuffle: all sources of a term are in one place, as many rows as there are sources.
    counts = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    counts = counts.withColumn("lang_docs", F.sum("docs").over(of)).withColumn("lang_n", F.sum("n").over(of)).withColumn("first", F.col("source") == F.min("source").over(of))
    own = settle(counts.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"))
    langs = own.filter("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = settle(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("v", "lang_total", "total", "terms")]).withColumn("p0", F.when(F.col("v") > 0, p_of(zero, F.col("total"), F.col("v")))))

    rated = settle(own.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", p_of(F.col("n"), F.col("total"), F.col("v")).alias("p"), p_of(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"), "p0"))
    forget(own)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value_of(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    # As if sources had no term in common: a's terms against b's p of no occurrence, b's against a's, the rest against both.
    side = lambda df, name: df.select("lang", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "lang"])
    histogram = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    others = side(groups.select("lang", "source", "p0"), "b")
    spread = histogram.join(others, "lang").filter(F.col("source") != F.col("b_source"))
    own_sum = F.sum(F.col("k") * value_of(F.col("p"), F.col("b_p0"))).alias("own_sum")  # a's terms, value of (a, b)
    other_sum = F.sum(F.col("k") * value_of(F.col("b_p0"), F.col("p"))).alias("other_sum")  # a's terms, value of (b, a)
    spread = settle(spread.groupBy("lang", F.col("source").alias("a_source"), "b_source").agg(own_sum, other_sum))
    # Terms that two sources share, each pair of sources once and both ways.
    a, b = side(rated.select("lang", F.col("term"), "source", "p", "p0"), "a"), side(rated.select("lang", "term", "source", "p", "p0"), "b")
    both = a.join(b, (a["lang"] == b["lang"]) & (a["a_term"] == b["b_term"]) & (a["a_source"] < b["b_source"])).drop(b["lang"])

    def more(p: str, p0: str, q: str, q0: str) -> Column:
        p, p0, q, q0 = map(F.col, (p, p0, q, q0))
        return F.sum(value_of(p, q) - value_of(p, q0) - value_of(p0, q) + value_of(p0, q0))

    common = settle(both.groupBy("lang", "a_source", "b_source").agg(more("a_p", "a_p0", "b_p", "b_p0").alias("there"), more("b_p", "b_p0", "a_p", "a_p0").alias("back")))
    common = common.select("lang", "a_source", "b_source", F.col("there").alias("common")).unionByName(common.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), F.col("back").alias("common")))
    pairs = side(groups.select("lang", "source", "v", "terms", "p0"), "a").join(side(groups.select("lang", "source", "terms", "p0"), "b"), "lang").filter(F.col("a_source") != F.col("b_source"))
    mirrored = spread.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), F.col("other_sum").alias("back_sum"))
    keys = ["lang", "a_source", "b_source"]
    pairs = pairs.join(spread.drop("other_sum"), keys, "left").join(mirrored, keys, "left").join(common, keys, "left")
    rest = (F.col("a_v") - F.col("a_terms") - F.col("b_terms")) * value_of(F.col("a_p0"), F.col("b_p0"))
    whole = rest + F.coalesce("own_sum", zero) + F.coalesce("back_sum", zero) + F.coalesce("common", zero)
    pairs = pairs.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), F.coalesce(whole, zero).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (coalesce(s.total, 0) + l.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS q
      FROM grp g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
