"""Ranked lexical search: for each item of a query set the documents with the highest scores, by branch and bound.

1. One pass over the documents keeps of each its length and how often it has each of the query terms. Length sums, and
   each term's document frequency, are counted over all documents.
2. Each task takes its documents in ranges of FAN ** LEVELS. Of each query term a range has a tree of maxima: the leaves are its
   values in blocks of FAN documents, a node holds the maximum of FAN nodes below. An item's bound at a node is the sum of
   its terms' maxima there. The search opens the node with the highest bound first; a block that is opened gets its exact
   scores. It ends at a bound below the k-th best score that the task has found so far, in this range or an earlier one;
   nodes whose bound equals it are opened, since a tie goes to the smaller id.
3. The best k of each task are ranked, first in parts, then all together.

Items come to the executors in blocks of at most BLOCK_TERMS different terms (an item of more is a block of its own), so
that what is broadcast is bounded by that; more items than a block holds take another pass over the documents each.

A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); the score is a sum of 64-bit integers. Null or wordless texts
are found by no item; null or wordless items find nothing. Each row of the items is an item, also if its id is null or
occurs again; each row of documents is a document, null ids rank last among equal scores. Very long texts are read whole, a
piece at a time. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedloom.llm.common import settle, table, word_lists

K = 20
FAN = 16
#: A range has FAN ** LEVELS documents.
LEVELS = 3
BLOCK_TERMS = 50_000
#: Parts in which an item's results are ranked before they are ranked together.
PARTS = 64
#: ASCII letters and digits and all beyond ASCII, in lower-cased UTF-8.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


class Items:
    """A block of items: their terms, numbered through the block, and how often each item has each."""

    def __init__(self) -> None:
        self.numbers: list[int] = []
        self.ids: list = []
        self.words: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.weights = np.zeros(0, dtype=np.int64)

    def add(self, number: int, item_id, counts: Counter) -> None:
        self.numbers.append(number)
        self.ids.append(item_id)
        self.terms.append(np.array([self.words.setdefault(t, len(self.words)) for t in counts], dtype=np.int64))
        self.times.append(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))


def blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    block = Items()
    for number, row in enumerate(items.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator()):
        counts: Counter = Counter()
        for words in word_lists(TERM, (row[1] or "").encode().lower()):
            counts.update(words)
        if block.words and len(block.words) + len(counts) > BLOCK_TERMS:
            yield block
            block = Items()
        if counts:
            block.add(number, row[0], counts)
    if block.words:
        yield block


def indexer(shared):
    """From (doc_id, text): doc_id, n, and the numbers and counts of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.words.get
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n, found = 0, Counter()
                for words in word_lists(TERM, (text or b"").lower()):
                    n += len(words)
                    found.update(map(number, words))
                found.pop(None, None)
                sizes.append(n)
                terms.append(list(found))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "times"])

    return run


class MaxTrees:
    """A range of documents: exact values, and of each term that occurs the maxima of blocks, of blocks of blocks, to the root."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, values: np.ndarray, vocabulary: int, fan: int = FAN) -> None:
        self.fan, self.first, self.terms, self.values = fan, first, terms, values
        self.size = len(first) - 1
        here, own = np.unique(terms, return_inverse=True)
        self.row = np.full(vocabulary, -1, dtype=np.int64)
        self.row[here] = np.arange(len(here))
        n = fan ** (LEVELS - 1)
        leaves = np.zeros((len(here), n), dtype=np.int64)
        doc = np.repeat(np.arange(self.size), np.diff(first))
        np.maximum.at(leaves.reshape(-1), own * n + doc // fan, values)
        #: From the root down.
        self.levels = [leaves]
        while self.levels[0].shape[1] > 1:
            below = self.levels[0]
            self.levels.insert(0, below.reshape(len(here), below.shape[1] // fan, fan).max(axis=2))
        self.opened = 0

    def scores(self, block: int, times: np.ndarray) -> np.ndarray:
        """Exact scores of a block's documents; times: of each term of the vocabulary."""
        low, high = block * self.fan, min((block + 1) * self.fan, self.size)
        at = self.first[low : high + 1]
        sums = np.concatenate(([0], np.cumsum(self.values[at[0] : at[-1]] * times[self.terms[at[0] : at[-1]]])))
        return sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]

    def search(self, terms: np.ndarray, times: np.ndarray, all_times: np.ndarray, best: Best) -> None:
        rows = self.row[terms]
        rows, times = rows[rows >= 0], times[rows >= 0]
        if not len(rows):
            return
        heap = [(-int(self.levels[0][rows, 0] @ times), 0, 0)]
        while heap and -heap[0][0] >= best.least:
            _, depth, node = heapq.heappop(heap)
            self.opened += 1
            if depth == len(self.levels) - 1:
                for k, score in enumerate(self.scores(node, all_times).tolist()):
                    if score >= best.least:
                        best.add(score, node * self.fan + k)
                continue
            for k, bound in enumerate((times @ self.levels[depth + 1][rows, node * self.fan : (node + 1) * self.fan]).tolist()):
                if bound >= best.least:
                    heapq.heappush(heap, (-bound, depth + 1, node * self.fan + k))


class Best:
    """The best k of an item: highest scores, of equal ones the smallest ids, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.found, self.least, self.ids = k, [], 1, []

    def add(self, score: int, at: int) -> None:
        self.found.append((-score, (self.ids[at] is None, self.ids[at])))
        if len(self.found) >= 2 * self.k:
            self.trim()
        elif len(self.found) == self.k:
            self.least = max(1, -max(s for s, _ in self.found))

    def trim(self) -> None:
        self.found = heapq.nsmallest(self.k, self.found)
        if len(self.found) == self.k:
            self.least = max(1, -self.found[-1][0])


def ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def searcher(shared, docs: int, length: int, k: int, item_type: pa.DataType, fan: int):
    """From the rows of indexer(): number, item_id, doc_id, score of each item's best k in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        found = [Best(k) for _ in items.ids]
        times = np.zeros(len(items.words), dtype=np.int64)
        doc_type = pa.null()
        for part in ranges(batches, fan**LEVELS):
            doc_type = part.schema.field(0).type
            ids = part.column(0).to_pylist()
            n = part.column(1).to_numpy()
            lists, counts = (part.column(c).chunk(0) for c in (2, 3))
            first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            terms, tf = (x.flatten().to_numpy().astype(np.int64) for x in (lists, counts))
            m = np.repeat(75 + (25 * n * docs) // max(length, 1), np.diff(first))
            trees = MaxTrees(first, terms, items.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m)), len(items.words), fan)
            for own, own_times, best in zip(items.terms, items.times, found, strict=True):
                times[own] = own_times
                best.ids = ids
                trees.search(own, own_times, times, best)
                best.trim()
                times[own] = 0
        rows = [(number, item, key[1], -score) for number, item, best in zip(items.numbers, items.ids, found, strict=True) for score, key in best.found]
        if rows:
            kinds = [pa.int64(), item_type, doc_type, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["number", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", fan: int = FAN) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents with the highest scores above 0."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    doc_kind, item_kind = docs.select(id_col).schema[0].dataType, items.select(item_col).schema[0].dataType
    schema = f"number long, item_id {item_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score long"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for block in blocks(items, item_col, item_text_col):
        index = settle(rows.mapInArrow(indexer(spark.sparkContext.broadcast(block)), f"doc_id {doc_kind.simpleString()}, n long, terms array<int>, times array<long>"))
        n, length = index.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.words), dtype=np.int64)
        frequency = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most the block's terms
        df[frequency.column(0).to_numpy()] = frequency.column(1).to_numpy()
        block.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        found = index.filter(F.size("terms") > 0).mapInArrow(searcher(spark.sparkContext.broadcast(block), n, length, k, to_arrow_type(item_kind), fan), schema)
        part = Window.partitionBy("number", "part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("part", F.spark_partition_id() % PARTS).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
        parts.append(settle(found.drop("part", "rank")))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
size AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, r, len AS n, term, count(*) AS tf FROM (SELECT doc_id, r, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2.0 * (SELECT n FROM size) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
scored AS (SELECT item_id, i, doc_id, r, CAST(sum(weight.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * (SELECT n FROM size)) // (SELECT l FROM size))))) AS BIGINT) AS score
           FROM b JOIN tf USING (term) JOIN weight USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
