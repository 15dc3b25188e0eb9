"""Benchmark decontamination: hash set of normalised benchmark word windows, scan, exact verification, removal.

Texts are lower-cased in A-Z; words are runs of ASCII letters and digits and of any non-ASCII characters. The windows of
the benchmark go to the executors in blocks of bounded size: a benchmark beyond one block makes further passes over the
documents, each written before the next begins, without any shuffle; an item beyond a block is cut at words into pieces that share their last windows. A block
holds its text, the places of its words, and its windows' hashes in order: some 30 bytes a word. A window is found by its
rolling hash and then compared word by word.

Null or wordless texts have no words and no hits; null or wordless items have no windows; items without an id count as
hits but are not listed; items that share an id or a window count once each; repeated rows are judged each on its own. An
empty table of documents gives an empty result, an empty benchmark no hits. Very long texts are scanned whole, each alone.
Extra columns of the documents are kept; if they clash with the added names, the added ones get a suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.llm.common import forget, fresh, settle, table

WINDOW = 10
#: Words of the benchmark in one broadcast block: some 120 MB in a worker (a test measures it).
BLOCK_WORDS = 4_000_000
#: Windows whose items a task remembers.
REMEMBERED = 1 << 16
#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

_CODE = np.arange(256)
_IS_WORD = ((_CODE >= 0x30) & (_CODE <= 0x39)) | ((_CODE >= 0x41) & (_CODE <= 0x5A)) | ((_CODE >= 0x61) & (_CODE <= 0x7A)) | (_CODE >= 0x80)
_LOWER = np.where((_CODE >= 0x41) & (_CODE <= 0x5A), _CODE + 32, _CODE).astype(np.uint8)
_BYTE = np.uint64(0x100000001B3)
_WORD = np.uint64(0x9E3779B97F4A7C15)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of several texts at once: bytes from/to in the joined text, owner, and a hash."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        edges = np.diff(np.concatenate(([0], _IS_WORD[raw].view(np.int8), [0])))
        self.begin, self.end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.low = _LOWER[raw]
        self.at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.owner = np.searchsorted(self.at, self.begin, side="right") - 1
        self.hash = np.zeros(0, dtype=np.uint64)
        if len(self.begin):
            size = self.end - self.begin
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            values = (self.low[np.repeat(self.begin, size) + inside].astype(np.uint64) + np.uint64(1)) * powers(_BYTE, int(size.max()))[inside]
            h = np.add.reduceat(values, np.cumsum(size) - size)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            self.hash = h ^ (h >> np.uint64(29))

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, for as many words as have n - 1 after them."""
        m = len(self.hash) - n + 1
        out = np.zeros(max(m, 0), dtype=np.uint64)
        for k, p in enumerate(powers(_WORD, n)):
            if m > 0:
                out += self.hash[k : k + m] * p
        return out

    def text(self, i: int, n: int) -> bytes:
        low = self.low
        return b" ".join(low[self.begin[j] : self.end[j]].tobytes() for j in range(i, i + n))


class Windows:
    """A block of the benchmark's windows, by their number of words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.ids = [item_id for item_id, _ in items]
        data, begin, end, found = [], [], [], {}
        size = words_before = start = 0
        while start < len(items):  # a chunk of texts at a time: hashing takes some hundred bytes for each of its own
            stop, n = start, 0
            while stop < len(items) and (stop == start or n + len(items[stop][1]) <= CHUNK_BYTES):
                n += len(items[stop][1])
                stop += 1
            words = Words([text for _, text in items[start:stop]])
            counts = np.bincount(words.owner, minlength=stop - start)
            for k in {min(window, c) for c in counts.tolist() if c}:
                h = words.windows(k)
                at = np.arange(len(h))
                own = words.owner[at]
                # Items with fewer words than the window are one window, of all their words.
                here = (own == words.owner[at + k - 1]) & ((counts[own] == k) if k < window else True)
                found.setdefault(k, []).append((h[here], (at[here] + words_before).astype(np.uint32), (own[here] + start).astype(np.uint32)))
            data.append(words.low.tobytes() + b"\n")
            begin.append((words.begin + size).astype(np.uint32))
            end.append((words.end + size).astype(np.uint32))
            size += len(words.low) + 1
            words_before += len(words.begin)
            start = stop
        self.data = b"".join(data)
        self.begin, self.end = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (begin, end))
        #: For each number of words: sorted hashes, and of each the first word and the item.
        self.hashes: dict[int, np.ndarray] = {}
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, parts in found.items():
            h, at, own = map(np.concatenate, zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.hashes[k], self.places[k] = h[order], (at[order], own[order])

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[self.begin[j] : self.end[j]] for j in range(i, i + n))

    def items(self, n: int, h: int, text: bytes) -> set[str | None]:
        """The items with a window of n words that has this hash and text."""
        low, high = (int(np.searchsorted(self.hashes[n], np.uint64(h), side)) for side in ("left", "right"))
        at, own = self.places[n]
        return {self.ids[own[j]] for j in range(low, high) if self.text(int(at[j]), n) == text}

    def filters(self) -> dict[int, np.ndarray]:
        out = {}
        for n, h in self.hashes.items():
            out[n] = np.zeros(1 << 20, dtype=bool)
            out[n][h >> np.uint64(44)] = True
        return out


def pieces(text: bytes, window: int) -> Iterator[tuple[bytes, int]]:
    """A text and its number of words; in pieces of at most BLOCK_WORDS windows if it has more."""
    edges = np.diff(np.concatenate(([0], _IS_WORD[np.frombuffer(text, dtype=np.uint8)].view(np.int8), [0])))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(begin)
    for k in range(0, max(1, n - window + 1), BLOCK_WORDS) if n else ():
        last = min(k + BLOCK_WORDS + window - 1, n)
        yield text[begin[k] : end[last - 1]], last - k


def blocks(bench: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Windows]:
    items: list[tuple[str | None, bytes]] = []
    words = 0
    for row in bench.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull()).toLocalIterator():
        for text, n in pieces(row[1].encode(), window):
            if items and words + n > BLOCK_WORDS:
                yield Windows(items, window)
                items, words = [], 0
            items.append((row[0], text))
            words += n
    yield Windows(items, window)


SPAN = pa.list_(pa.struct([("w0", pa.int32()), ("w1", pa.int32()), ("b0", pa.int32()), ("b1", pa.int32())]))


def scanner(shared, text_at: int, n_before: int):
    """Appends n_words, hit_spans and items; merges with those of an earlier block, which stand after n_before columns."""

    def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = size = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_pylist()
        for k, n in enumerate(lengths):
            if k > start and size + n > CHUNK_BYTES:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        yield batch.slice(start)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        block: Windows = shared.value
        filters = block.filters()
        known: dict[tuple[int, int, bytes], set] = {}
        for whole in batches:
            for batch in chunks(whole):
                if not batch.num_rows:
                    continue
                words = Words([(t or "").encode() for t in batch.column(text_at).to_pylist()])
                owner, n = words.owner, batch.num_rows
                spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                first = np.searchsorted(owner, np.arange(n))
                if batch.num_columns > n_before:
                    for d, (old, names) in enumerate(zip(batch.column(n_before + 1).to_pylist(), batch.column(n_before + 2).to_pylist(), strict=True)):
                        spans[d] = [(int(first[d]) + s["w0"], int(first[d]) + s["w1"]) for s in old]
                        items[d] = set(names)
                for size, hashes in block.hashes.items():
                    h = words.windows(size)
                    here = np.flatnonzero(filters[size][h >> np.uint64(44)])
                    here = here[owner[here] == owner[here + size - 1]]
                    here = here[hashes[np.minimum(np.searchsorted(hashes, h[here]), len(hashes) - 1)] == h[here]]
                    for i in here.tolist():
                        key = size, int(h[i]), words.text(i, size)
                        if (hit := known.get(key)) is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            hit = known[key] = block.items(*key)
                        if hit:
                            spans[owner[i]].append((i, i + size))
                            items[owner[i]] |= hit
                hits = []
                for d, own in enumerate(spans):
                    merged: list[list[int]] = []
                    for s, e in sorted(own):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    f, at = int(first[d]), int(words.at[d])
                    hits.append([{"w0": s - f, "w1": e - f, "b0": int(words.begin[s]) - at, "b1": int(words.end[e - 1]) - at} for s, e in merged])
                added = [
                    pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(hits, SPAN),
                    pa.array([sorted(x for x in s if x is not None) for s in items], pa.list_(pa.string())),
                ]
                names = [*batch.schema.names[:n_before], "n", "s", "i"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_before], *added], names=names)

    return scan


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with three more columns and their names: n_words, hit_spans (of words w0..w1 and UTF-8 bytes b0..b1), items."""
    spark = docs.sparkSession
    names = fresh(docs, "n_words", "hit_spans", "items")
    kinds = ["long", "array<struct<w0:int,w1:int,b0:int,b1:int>>", "array<string>"]
    added = T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    schema = T.StructType([*docs.schema.fields, *added.fields])
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == text_col.lower())
    out, shared, written = docs, None, None
    for block in blocks(bench, item_col, item_text_col, window):
        if shared is not None:
            # A pass is written before the next block goes out, so that no task holds two of them.
            out, before = settle(out), written
            written = out
            shared.unpersist()
            if before is not None:
                forget(before)
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(scanner(shared, at, len(docs.columns)), schema)
    return out, names


def n_hit(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["w1"] - s["w0"])


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, policy: str = "documents", text_col: str = "text", **kw) -> DataFrame:
    """docs without contaminated documents (policy "documents") or without their hit spans (policy "spans")."""
    found, (_, spans, _) = scan(docs, bench, window, text_col, **kw)
    if policy == "documents":
        return found.filter(F.size(spans) == 0).select(docs.columns)
    if policy != "spans":
        raise ValueError(f"policy is 'documents' or 'spans', not {policy!r}")
    raw = F.col(text_col).cast("binary")
    kept = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda k: F.substring(raw, F.when(k == 0, 1).otherwise(F.get(spans, k - 1)["b1"] + 1), F.coalesce(F.get(spans, k)["b0"], F.octet_length(raw)) - F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["b1"])).cast("string"),
    )
    text = F.when(F.size(spans) == 0, F.col(text_col)).otherwise(F.array_join(kept, ""))
    return found.withColumn(text_col, text).select(docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, (n_words, spans, items) = scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col(n_words).alias("n_words"), n_hit(F.col(spans)).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
