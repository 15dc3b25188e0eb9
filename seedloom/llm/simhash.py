"""SimHash near-duplicate groups: BK-trees over fingerprint shards, then distributed connected components.

1. Each text gets a 64-bit fingerprint of its word shingles. A null or wordless text has fingerprint zero.
2. Distinct fingerprints are dealt to shards that agree in parts of the bits. Two fingerprints at distance r or less agree
   in at least one of r + 1 blocks of bits, and again in a block of the remaining bits, and so on; so each shard is
   searched alone and no link is lost. A shard above SHARD_ROWS is dealt again by a block of what bits are left, until
   so few bits are left that the number of distinct fingerprints in a shard is bounded.
3. Each shard is one BK-tree: a child's key is its Hamming distance to the parent, and a search follows the edges
   within the radius of the distance to the node. Trees are built on the executors and written. While they hold at most
   BROADCAST_NODES fingerprints together (those that are alone in their shards have no tree), they are broadcast, and each
   fingerprint searches the trees of its own shards; beyond that bound each shard is searched by the task that holds it,
   for trees that grow with the corpus can't be sent to everyone. Searches go a level at a time over arrays and return
   links that join what they found, never all pairs.
4. Components of the links (see components).

Copies share a fingerprint and so cost one node. Repeated rows, ties and null ids are kept: a component's id is its
smallest non-null id. Very long texts are read whole. Extra columns are kept by near_dedup(), whatever their names; the
columns it adds on the way get other names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.llm.common import fresh, settle, table
from seedloom.llm.components import components
from seedloom.llm.minhash import KINDS, signature, similar_links
from seedloom.llm.shingles import shingle_hashes

RADIUS = 3
SHINGLE = 5
#: Fingerprints in a shard above which it is dealt again.
SHARD_ROWS = 20_000
BITS = 64
#: Dealings by 2, 3 and at last 4 blocks; 43 bits or more are fixed then, so a shard holds at most 2**21 fingerprints.
DEPTHS = (2, 3, 4)
#: Fingerprints in trees that are broadcast, at most: some 40 MB.
BROADCAST_NODES = 1 << 20
#: Rows that near_dedup drops, up to which their ids are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Pairs of query and node that a search holds at once.
_LIMIT = 1 << 21


def fingerprint(h: np.ndarray) -> int:
    """Of shingle hashes: the bits that most of them have, as a signed number."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprinter(shingle: int, name: str = "fp"):
    def one(text: bytes) -> int:
        return fingerprint(shingle_hashes(text, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fp = pa.array((one((t.as_py() or "").encode()) for t in texts), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*batch.schema.names[:-1], name])

    return run


def signer(shingle: int, names: list[str]):
    """The last column, a text, gives way to its fingerprint and signature."""

    def one(text: bytes) -> tuple:
        h = shingle_hashes(text, shingle)
        return fingerprint(h), *signature(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            found = [one((t.as_py() or "").encode()) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array((x[k] for x in found), kind, size=batch.num_rows) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: a signed 64-bit fingerprint for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(fingerprinter(shingle), f"doc_id {kind}, fp long")


class BKTree:
    """Nodes in the order of levels; a node's children are kid[first:last], their distances to it edge[first:last]."""

    def __init__(self, values: np.ndarray, root: int, kid: np.ndarray, edge: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.values, self.root, self.kid, self.edge, self.first, self.last = values, root, kid, edge, first, last
        self.visited = 0

    @classmethod
    def of(cls, values: np.ndarray) -> BKTree:
        n = len(values)
        group = np.zeros(n, dtype=np.int64)  # by its parent and distance
        rest = np.arange(n)
        parents, edges, nodes = [], [], []
        owner = np.array([-1])
        dist = np.array([0])
        while len(rest):
            order = np.argsort(group, kind="stable")
            rest, group = rest[order], group[order]
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            head_of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(rest))))
            node = rest[heads]
            parents.append(owner[group[heads]])
            edges.append(dist[group[heads]])
            nodes.append(node)
            under = np.ones(len(rest), dtype=bool)
            under[heads] = False
            rest, parent = rest[under], node[head_of[under]]
            d = np.bitwise_count(values[rest] ^ values[parent]).astype(np.int64)
            keys, group = np.unique(parent * 128 + d, return_inverse=True)
            owner, dist = keys // 128, keys % 128
        parents, edges, nodes = map(np.concatenate, (parents, edges, nodes))
        order = np.lexsort((edges, parents))
        order = order[parents[order] >= 0]
        first, last = (np.searchsorted(parents[order], np.arange(n), side=side) for side in ("left", "right"))
        return cls(values, int(nodes[0]), nodes[order], edges[order], first, last)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (query, node) within the radius; a level of the tree at a time."""
        q, node = np.arange(len(queries)), np.full(len(queries), self.root)
        while len(q):
            self.visited += len(q)
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            n = self.last[node] - self.first[node]
            at = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, d = np.repeat(q, n), np.repeat(d, n)
            follow = np.abs(self.edge[at] - d) <= radius
            q, node = q[follow], self.kid[at[follow]]


class Joiner:
    """Links between the fingerprints of a tree, only those that join what wasn't joined before."""

    def __init__(self, tree: BKTree) -> None:
        self.tree, self.root = tree, np.arange(len(tree.values))
        self.order = np.argsort(tree.values)

    def links(self, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
        """Of queries, which are among the tree's fingerprints."""
        tree, n = self.tree, len(self.tree.values)
        own = self.order[np.searchsorted(tree.values, queries, sorter=self.order)]
        out: list[tuple[int, int]] = []
        block = max(16, _LIMIT // n)
        for k in range(0, len(queries), block):
            found = list(tree.search(queries[k : k + block], radius))
            a, b = own[k : k + block][np.concatenate([x[0] for x in found])], np.concatenate([x[1] for x in found])
            ra, rb = self.root[a], self.root[b]
            apart = np.flatnonzero(ra != rb)
            if not len(apart):
                continue
            _, once = np.unique(np.minimum(ra, rb)[apart] * n + np.maximum(ra, rb)[apart], return_index=True)
            parent = list(range(n))

            def find(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i in apart[once].tolist():
                x, y = find(int(ra[i])), find(int(rb[i]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(tree.values[a[i]]), int(tree.values[b[i]])))
            self.root = np.array([find(x) for x in range(n)])[self.root]
        return out


def pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


#: A shard's key and its tree.
TREE = "k int, bits long, vals array<long>, root long, kid array<long>, edge array<long>, first array<long>, last array<long>"


def tree_builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From k, bits, fps."""
    for batch in batches:
        made = [BKTree.of(np.unique(fps.values.to_numpy()).view(np.uint64)) for fps in batch.column(2)]
        lists = [pa.array([getattr(t, x).view(np.int64) for t in made], pa.list_(pa.int64())) for x in ("values", "kid", "edge", "first", "last")]
        columns = [batch.column(0), batch.column(1), lists[0], pa.array([t.root for t in made], pa.int64()), *lists[1:]]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TREE.split(", ")])


def read_trees(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, BKTree]]:
    for k, bits, values, root, *rest in zip(*(table.column(x) for x in table.schema.names), strict=True):
        arrays = [x.values.to_numpy(zero_copy_only=False) for x in (values, *rest)]
        yield k.as_py(), bits.as_py(), BKTree(arrays[0].view(np.uint64), root.as_py(), *arrays[1:])


def shard_links(radius: int):
    """Links of shards, each by the task that holds its tree."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pairs_batch([x for _, _, tree in read_trees(batch) for x in Joiner(tree).links(tree.values, radius)])

    return links


def broadcast_links(shared, masks: list[int], radius: int):
    """Links of fingerprints, each by the broadcast trees of its shards."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, tuple[np.ndarray, list[Joiner]]] = {}
        by_mask: dict[int, list[tuple[int, BKTree]]] = {}
        for k, bits, tree in read_trees(shared.value):
            by_mask.setdefault(k, []).append((bits, tree))
        for k, trees in by_mask.items():
            trees.sort(key=lambda x: x[0])
            shards[k] = np.array([b for b, _ in trees], dtype=np.int64), [Joiner(t) for _, t in trees]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            out: list[tuple[int, int]] = []
            for k, (keys, joiners) in shards.items():
                bits = fps & np.int64(masks[k])
                at = np.minimum(np.searchsorted(keys, bits), len(keys) - 1)
                mine = np.flatnonzero(keys[at] == bits)
                mine = mine[np.argsort(at[mine], kind="stable")]
                for own in np.split(mine, np.flatnonzero(np.diff(at[mine])) + 1) if len(mine) else ():
                    out += joiners[at[own[0]]].links(fps[own].view(np.uint64), radius)
            yield pairs_batch(out)

    return links


def masks(depth: int, radius: int) -> list[int]:
    """The choices of blocks of bits at a depth, as signed numbers."""
    blocks = radius + 1

    def split(free: list[int]) -> list[list[int]]:
        edge = [round(k * len(free) / blocks) for k in range(blocks + 1)]
        return [free[a:b] for a, b in zip(edge, edge[1:], strict=False)]

    def chosen(free: list[int], fixed: int, left: int) -> Iterator[int]:
        if not left:
            yield fixed
            return
        for block in split(free):
            yield from chosen([b for b in free if b not in block], fixed | sum(1 << b for b in block), left - 1)

    return [m - (1 << 64) if m >= 1 << 63 else m for m in chosen(list(range(BITS)), 0, depth)]


def deal(depth: int, radius: int) -> Column:
    """The shard keys of a fingerprint at a depth: each is a choice of blocks and their bits."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks(depth, radius))])


def near_links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """a, b: links between the distinct fingerprints of fps, enough to join all within the radius."""
    spark, dealt = fps.sparkSession, fps.select("fp")
    out = None
    for depth in DEPTHS:
        keys = dealt.select("fp", F.explode(deal(depth, radius)).alias("key")).select("fp", "key.k", "key.bits")
        large, own = None, dealt
        if depth < DEPTHS[-1]:
            large = settle(keys.groupBy("k", "bits").count().filter(F.col("count") > shard_rows).select("k", "bits"))
            large = None if large.isEmpty() else large
        if large is not None:
            dealt = settle(keys.join(large, ["k", "bits"], "left_semi").select("fp").distinct())
            keys = keys.join(large, ["k", "bits"], "left_anti")
        # Most shards hold one fingerprint and end here; the others are bounded by shard_rows, or by the bits left.
        shards = keys.groupBy("k", "bits").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("k", "bits", "fps")
        trees = settle(shards.mapInArrow(tree_builder, TREE))
        if (trees.agg(F.sum(F.size("vals"))).first()[0] or 0) <= broadcast_nodes:
            links = own.mapInArrow(broadcast_links(spark.sparkContext.broadcast(trees.toArrow()), masks(depth, radius), radius), "a long, b long")
        else:
            links = trees.mapInArrow(shard_links(radius), "a long, b long")
        out = links if out is None else out.unionByName(links)
        if large is None:
            break
    return out


def group_rows(rows: DataFrame, radius: int, shard_rows: int, signed: DataFrame | None = None, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, fp): fp with its component_id and label; and (doc_id, fp) pairs with their count.

    With signed rows (see minhash) similar texts are joined too, however far apart their fingerprints are."""
    pairs = settle(rows.groupBy("fp", "doc_id").count())
    fps = pairs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_links(settle(fps.select("fp")), radius, shard_rows)
    if signed is not None:
        links = links.unionByName(similar_links(signed, shingle))
    labels = components(links)
    # A node that is the label of its component has no row in labels.
    named = fps.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return settle(named.join(ids, "label").select("fp", "label", "component_id")), pairs


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS, **kw) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    rows = settle(fingerprints(docs, shingle, **kw))
    of, _ = group_rows(rows, radius, shard_rows)
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text", similar: bool = False) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest id, null only where there is no other.

    Of rows with that id and different texts the smaller fingerprint stays, of equal rows one. With similar, texts whose
    shingles have a Jaccard similarity of minhash.SIMILAR percent or more are near duplicates besides those by fingerprint."""
    names = fresh(docs, "fp", "same", "n", "keys")
    fp = names[0]
    last, text = fresh(docs, "text_for_fp")[0], F.col(text_col).cast("string")
    kept = ", ".join(f"`{n.replace('`', '``')}` {kind}" for n, kind in zip(names, ("bigint", *KINDS), strict=True))
    kept = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(kept).fields[: 4 if similar else 1]])
    whole = settle(docs.withColumn(last, text).mapInArrow(signer(shingle, names) if similar else fingerprinter(shingle, fp), kept))
    signed = whole.select(F.col(id_col).alias("id"), *[F.col(n).alias(k) for n, k in zip(names, ("fp", "same", "n", "keys"), strict=True)], text.alias("text")) if similar else None
    of, pairs = group_rows(whole.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp")), radius, shard_rows, signed, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    best = settle(pairs.join(of, "fp").groupBy("label").agg(F.min(order).alias("best")))
    judged = pairs.join(of.join(best, "label").select("fp", "best"), "fp").select(F.col("doc_id").alias("k_id"), F.col("fp").alias("k_fp"), "count", (order != F.col("best")).alias("goes"))
    judged = settle(judged.filter("goes or count > 1"))
    match = F.col(id_col).eqNullSafe(F.col("k_id")) & (F.col(fp) == F.col("k_fp"))

    # The texts stay where they are unless very many rows go: what moves is the ids of those that do.
    def listed(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    kept = whole.join(listed(judged.filter("goes")), match, "left_anti")
    again = listed(judged.filter("not goes"))
    once = kept.join(again, match, "left_anti")
    return once.unionByName(kept.join(again, match, "left_semi").dropDuplicates([id_col, fp])).select(docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), radius=3, shingle=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
