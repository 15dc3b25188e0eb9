"""Links between texts whose sets of word shingles have a Jaccard similarity of SIMILAR percent or more.

Each text gets BANDS keys, each made of ROWS minima of its shingle hashes. Two texts of similarity J share a key with
probability 1 - (1 - J ** ROWS) ** BANDS: 0.995 at 0.8, 0.9994 at 0.85. All texts that share a key, directly or through
others, are compared exactly by the signature trees of signature_tree, however many they are: whole shards in a task,
large ones block by block.

Texts with equal sets count as one. A wordless text has no shingles and no links.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm import signature_tree
from seedloom.llm.common import settle
from seedloom.llm.shingles import class_hash, shingle_hashes  # noqa: F401

#: Least similarity of a link, in percent.
SIMILAR = 80
BANDS, ROWS = 10, 4

_ODD = (np.random.default_rng(11).integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Type of the columns that a signature adds: the set's hash, its size, the keys.
KINDS = "bigint", "bigint", "array<bigint>"


def minima(h: np.ndarray, odd: np.ndarray) -> np.ndarray:
    least = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(h), 4096):
        least = np.minimum(least, (h[k : k + 4096] * odd).min(axis=1))
    return least


def signature(h: np.ndarray) -> tuple[int, int, list[int]]:
    """Of shingle hashes: a hash of their set, its size, and its keys."""
    h = np.unique(h)
    if not len(h):
        return class_hash(h), 0, []
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in minima(h, _ODD).reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(32)
    return class_hash(h), len(h), keys.view(np.int64).tolist()


def similar_links(rows: DataFrame, shingle: int) -> DataFrame:
    """Links a, b between fingerprints, from rows (id, fp, same, n, keys, text): all that similar texts join."""
    classes = settle(rows.filter("n > 0").groupBy("same").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("keys").alias("keys")))
    first = classes.select("same", F.col("fp").alias("first"))
    # Texts with one set but different fingerprints: words repeat in them.
    parts = [rows.filter("n > 0").select("same", "fp").distinct().join(first, "same").filter("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))]
    texts = rows.select(F.col("id").alias("doc_id"), "text")
    links = signature_tree.set_links(texts, classes, signature_tree.shared_keys(classes), shingle, SIMILAR)
    if links is not None:
        of = lambda c: first.select(F.col("same").alias(c), F.col("first").alias(f"fp_{c}"))
        parts.append(links.join(of("a"), "a").join(of("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    return settle(reduce(DataFrame.unionByName, parts).filter("a <> b").distinct())
