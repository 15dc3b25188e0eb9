"""Exact Jaccard join of documents' shingle sets with signature trees.

1. Texts with equal sets are one class from here on. Classes that can be linked meet in a key: a set's hashes are dealt
   into so many buckets that the differences which a link allows can't touch all of them, so that linked sets agree in a
   whole bucket; a key is a bucket's content. The number of buckets follows from the set's size class; sets near the upper
   end of a size class take the next one's buckets as well. An empty bucket says little, so it is dealt again by other
   bits of the hashes.
2. Classes that share keys, directly or through others, are a shard. A class is in one shard, and its set moves once.
3. Each shard gets a signature tree: a leaf holds a set's bitmap (a bit for each hash, modulo the width), its size, and
   how many hashes share their bit with another; a node holds the OR of its children's bitmaps, the range of their sizes
   and the most shared bits. Two trees (or one with itself) are gone through together: of a pair of nodes the overlap of
   any two sets below is at most the bits they have in common plus the lesser of the shared bits, and the sizes say how
   much is needed; pairs of nodes that can't reach it are left out. Pairs of leaves that remain, and aren't joined yet, are
   compared by their hashes.
4. A shard above PART_DOCS classes or PART_HASHES hashes is cut into blocks by size and hash. Each block is joined with
   itself and with the shard's REPS sets that share most keys, which is where large groups of copies come together. What
   then lies outside the shard's largest group is put into blocks of its own, and those are joined with each other and
   with the blocks of the largest group, as far as sizes allow. So every pair of a shard that could be linked is
   compared, or already joined, and no task holds more than two blocks.

Only links that join something are kept. Sets are compared by 64-bit hashes of the shingles. Copies of a text, repeated
rows and ties are one class; a component's id is its smallest non-null doc_id, null only if it has no other. Null or
wordless texts have an empty set and no links. Very long texts are read whole; beyond 2**16 hashes a leaf's bitmap no
longer grows, which prunes less. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedloom.llm.common import settle, table
from seedloom.llm.components import components
from seedloom.llm.shingles import class_hash, shingle_hashes

SHINGLE = 3
#: Least similarity of a link in percent of the union.
PERCENT = 90
#: Classes and hashes in a block.
PART_DOCS, PART_HASHES = 256, 1 << 18
REPS = 16
FAN = 8
#: Bits of a leaf for each hash, and at most.
SPREAD, WIDEST = 4, 1 << 16
#: Keys or classes up to which a list of them is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Bytes of bitmaps that a step of the traversal holds.
_BYTES = 1 << 25

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def size_classes(percent: int, growth: tuple[int, int] | None = None) -> np.ndarray:
    """First sizes of classes of sets. Without growth a class reaches as far as its first size can be linked; with it by
    that factor at least, from the first size on that can be linked with an unequal set."""
    out = [1 if growth is None else max(1, -(-percent // (100 - percent)))]
    while out[-1] < 1 << 40:
        reach = 100 * out[-1] // percent
        out.append(max(reach, out[-1] * growth[0] // growth[1] if growth else 0) + 1)
    return np.array(out, dtype=np.int64)


def set_of(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


class Keys:
    """The keys of a set: sets linked at percent share one at least."""

    def __init__(self, percent: int) -> None:
        self.percent, self.first = percent, size_classes(percent, (5, 4))

    def buckets(self, h: np.ndarray, tag: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each bucket the number of hashes and a hash of them all, whatever their order."""
        k = int(2 * (self.first[tag + 1] - 1) * (100 - self.percent) // (100 + self.percent)) + 1
        at = (((h >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(k, dtype=np.uint64)
        np.add.at(sums, at, mix(h * _A))
        number = np.arange(k, dtype=np.uint64) + (np.uint64(tag) << np.uint64(32))
        return np.bincount(at, minlength=k), mix(sums + mix(number * _C + np.uint64(shift)))

    def of(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n < self.first[0]:
            return np.zeros(0, dtype=np.int64)
        tag = int(np.searchsorted(self.first, n, side="right")) - 1
        tags = [tag, tag + 1] if 100 * n // self.percent >= self.first[tag + 1] else [tag]
        out = []
        for tag in tags:
            counts, keys = self.buckets(h, tag, 32)
            out.append(keys[counts > 0])
            if len(empty := np.flatnonzero(counts == 0)):
                again = self.buckets(h, tag, 0)[1]
                out.append(mix(again + mix(keys[empty] * _A)[:, None]).ravel())
        return np.concatenate(out).view(np.int64)


def signer(shingle: int, percent: int):
    """doc_id, same (the set's hash), n, keys from doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(percent)
        for batch in batches:
            same, n, found = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                h = set_of(text or b"", shingle)
                same.append(class_hash(h))
                n.append(len(h))
                found.append(keys.of(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "same", "n", "keys"])

    return run


def set_reader(shingle: int, percent: int):
    """same, n, size (the number of its size class), hashes from text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = size_classes(percent)
        for batch in batches:
            sets = [set_of(text or b"", shingle) for text in batch.column(0).cast(pa.binary()).to_pylist()]
            n = np.array([len(h) for h in sets], dtype=np.int64)
            columns = [pa.array([class_hash(h) for h in sets], pa.int64()), pa.array(n), pa.array(np.searchsorted(first, n, side="right").astype(np.int32)), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["same", "n", "size", "hashes"])

    return run


class SignatureTree:
    """Levels from the root to the leaves: bitmaps, smallest and largest size, most hashes that share a bit with another."""

    def __init__(self, sets: list[np.ndarray], width: int, depth: int) -> None:
        bits = np.zeros((len(sets), width // 64), dtype=np.uint64)
        flags = np.zeros(width, dtype=bool)
        for k, h in enumerate(sets):
            at = (h & np.uint64(width - 1)).astype(np.int64)
            flags[at] = True
            bits[k] = np.packbits(flags, bitorder="little").view(np.uint64)
            flags[at] = False
        n = np.array([len(h) for h in sets], dtype=np.int64)
        self.levels = [(bits, n, n, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
        for _ in range(depth):
            bits, low, high, shared = self.levels[0]
            at = np.arange(0, len(low), FAN)
            self.levels.insert(0, (np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(shared, at)))

    @staticmethod
    def shape(*sizes: int) -> int:
        """Levels above the leaves so that each of the trees ends in one root."""
        depth = 0
        while FAN**depth < max(sizes):
            depth += 1
        return depth

    @staticmethod
    def width(sets: list[np.ndarray]) -> int:
        return min(WIDEST, max(64, 1 << (SPREAD * max(len(h) for h in sets) - 1).bit_length()))


def reachable(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets below the nodes i of a level and j of another can be linked."""
    (bits, low, high, shared), (bits_b, low_b, high_b, shared_b) = a, b
    sizes = (100 * high[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low[i])
    out = np.zeros(len(i), dtype=bool)
    at = np.flatnonzero(sizes)
    step = max(1, _BYTES // (8 * bits.shape[1]))
    for k in range(0, len(at), step):
        x, y = i[at[k : k + step]], j[at[k : k + step]]
        most = np.bitwise_count(bits[x] & bits_b[y]).sum(axis=1, dtype=np.int64) + np.minimum(shared[x], shared_b[y])
        most = np.minimum(most, np.minimum(high[x], high_b[y]))
        out[at[k : k + step]] = most * (100 + percent) >= percent * (low[x] + low_b[y])
    return out


def leaf_pairs(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves of the trees (of equal depth) that can be linked; of a tree with itself each pair once."""
    todo = [(0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    fan = np.arange(FAN)
    while todo:
        depth, i, j = todo.pop()
        ok = reachable(a.levels[depth], i, b.levels[depth], j, percent)
        i, j = i[ok], j[ok]
        if depth == len(a.levels) - 1:
            if a is b:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        i = np.repeat(i[:, None] * FAN + fan, FAN, axis=1).ravel()
        j = np.tile(j[:, None] * FAN + fan, (1, FAN)).ravel()
        inside = (i < len(a.levels[depth + 1][1])) & (j < len(b.levels[depth + 1][1]))
        if a is b:
            inside &= i <= j
        i, j = i[inside], j[inside]
        step = max(64, _BYTES // (8 * a.levels[0][0].shape[1]))
        todo += [(depth + 1, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def join(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets of left and of right (numbered after those of left), or among left; only such as join what
    neither they nor groups have joined before."""
    if not left or right is not None and not right:
        return []
    sets = left + (right or [])
    width, depth = SignatureTree.width(sets), SignatureTree.shape(len(left), len(right or ()))
    a = SignatureTree(left, width, depth)
    b = a if right is None else SignatureTree(right, width, depth)
    first: dict[int, int] = {}
    root = list(range(len(sets))) if groups is None else [first.setdefault(g, k) for k, g in enumerate(groups.tolist())]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in leaf_pairs(a, b, percent):
        now = np.array([find(x) for x in range(len(sets))])
        j = j if right is None else j + len(left)
        apart = now[i] != now[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q and linked(sets[x], sets[y], percent):
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def to_stars(links: list[tuple[int, int]]) -> np.ndarray:
    """Links of the same components, each to its component's smallest node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return np.array([(x, find(x)) for x in list(root) if find(x) != x], dtype=np.int64).reshape(-1, 2)


def block_joiner(percent: int):
    """Links a, b of a block's rows (block, side, label, known, same, hashes): side 0 with itself label by label, 1 with 2."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side, label, known, same = (rows.column(c).to_numpy() for c in ("side", "label", "known", "same"))
        lists = rows.column("hashes").chunk(0)
        flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        order = np.lexsort((np.diff(at), label, side))
        order = order[np.concatenate(([True], (np.diff(label[order]) != 0) | (np.diff(same[order]) != 0) | (np.diff(side[order]) != 0)))] if len(order) else order
        out = []

        def joined(x: np.ndarray, y: np.ndarray | None) -> None:
            own = x if y is None else np.concatenate((x, y))
            # Sets of a size lie together; among them such that share their least hash.
            sets = [flat[at[k] : at[k + 1]] for k in own]
            found = join(sets[: len(x)], None if y is None else sets[len(x) :], percent, known[own])
            out.extend((int(same[own[i]]), int(same[own[j]])) for i, j in found)

        if side.any():
            joined(order[side[order] == 1], order[side[order] == 2])
        else:
            for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                if len(own) > 1:
                    joined(own, None)
        links = to_stars(out)
        return pa.table([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return run


def listed(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def shared_keys(classes: DataFrame) -> DataFrame:
    """a, b, shared: classes that share keys, enough to connect all that do; in how many keys b is beside a."""
    dealt = classes.select(F.explode("keys").alias("key"), "same")
    met = settle(dealt.groupBy("key").agg(F.count("*").alias("members"), F.min("same").alias("a"), F.max("same").alias("b")).filter("members > 1"))
    more = dealt.join(listed(met.filter("members > 2").select("key", "a")), "key").select("a", F.col("same").alias("b"))
    pairs = met.filter("members = 2").select("a", "b").unionByName(more).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return settle(pairs)


def parted(rows: DataFrame, *by: str) -> DataFrame:
    """rows with part: those of the same values of by are cut into parts of some PART_DOCS rows and PART_HASHES hashes."""
    share = F.greatest(F.count("*") / PART_DOCS, F.sum("n") / PART_HASHES)
    sizes = rows.groupBy(*by).agg(F.ceil(share).cast("int").alias("parts"))
    return rows.join(sizes, list(by)).withColumn("part", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int"))


def set_links(texts: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """a, b: links that join all that are linked, from texts (doc_id, text), classes (same, id, n, keys) and shared_keys()."""
    shards = components(pairs)
    shards = settle(shards.unionByName(shards.select(F.col("label").alias("fp"), "label").distinct()).select(F.col("fp").alias("same"), "label"))
    if shards.isEmpty():
        return None
    members = settle(classes.select("same", "id", "n", F.size("keys").alias("n_keys")).join(shards, "same").select("same", "label", "n", "id", "n_keys"))
    wanted = listed(members.select("id").distinct())
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["id"]), "left_semi").select("text")
    sets = found.mapInArrow(set_reader(shingle, percent), "same long, n long, size int, hashes array<long>")
    sets = settle(sets.join(listed(members.select("same", "label")), "same"))

    sizes = members.groupBy("label").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    large = settle(sizes.filter((F.col("docs") > PART_DOCS) | (F.col("total") > PART_HASHES)).select("label"))
    kinds = "a long, b long"
    whole = ["block", "side", "label", "known", "same", "hashes"]
    zero = F.lit(0)

    def links_of(rows: DataFrame) -> DataFrame:
        return settle(rows.select(*whole).groupBy("block").applyInArrow(block_joiner(percent), kinds))

    # Shards that a task can hold, many to a block.
    few = sets.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "label", "left_anti")
    blocks = max(1, few.agg(F.coalesce(F.ceil(F.greatest(F.count("*") / PART_DOCS, F.sum("n") / PART_HASHES)), F.lit(1))).first()[0])
    links = links_of(few.select(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("block"), zero.alias("side"), "label", F.col("same").alias("known"), "same", "hashes"))
    if large.isEmpty():
        return links
    many = settle(sets.join(large, "label").dropDuplicates(["same"]))
    cut = settle(parted(many.select("label", "size", "same", "n"), "label", "size"))
    block = lambda *c: F.xxhash64(*c)
    most = Window.partitionBy("label").orderBy(F.desc("share"), "same")
    central = pairs.select(F.col("b").alias("same"), "shared").unionByName(pairs.select(F.col("a").alias("same"), "shared")).groupBy("same").agg(F.sum("shared").alias("shared"))
    central = members.join(large, "label", "left_semi").join(central, "same").select("label", "same", (F.col("shared") / F.col("n_keys")).alias("share"))
    central = central.withColumn("r", F.row_number().over(most)).filter(F.col("r") <= REPS).select("label", "same")
    reps = central.join(cut.select("label", "size", "part").distinct(), "label").select("label", "same", block("label", "size", "part").alias("block"))
    placed = cut.select("label", "same", block("label", "size", "part").alias("block")).unionByName(reps).distinct()
    own = placed.join(many.select("same", "hashes"), "same").select("block", zero.alias("side"), "label", F.col("same").alias("known"), "same", "hashes")
    links = settle(links.unionByName(links_of(own)))

    # The largest group of a shard is joined; the rest is compared with each other and with it.
    joined = components(links)
    named = settle(cut.drop("part", "parts").join(joined.withColumnRenamed("fp", "same").withColumnRenamed("label", "known"), "same", "left").withColumn("known", F.coalesce("known", "same")))
    first = Window.partitionBy("label").orderBy(F.desc("docs"), "known")
    leading = named.groupBy("label", "known").agg(F.count("*").alias("docs")).withColumn("r", F.row_number().over(first)).filter("r = 1").select("label", F.col("known").alias("leading"))
    named = named.join(leading, "label").withColumn("rest", F.col("known") != F.col("leading")).drop("leading")
    open_shards = named.filter("rest").select("label").distinct()
    named = settle(parted(named.join(open_shards, "label", "left_semi"), "label", "size", "rest"))
    if named.isEmpty():
        return links
    cells = settle(named.groupBy("label", "size", "rest", "part").agg(F.count("*").alias("docs")).withColumn("cell", block("label", "size", "rest", "part")))
    x, y = cells.select(*[F.col(c).alias(f"x_{c}") for c in cells.columns]), cells.select(*[F.col(c).alias(f"y_{c}") for c in cells.columns])
    meet = x.filter("x_rest").join(y, (F.col("x_label") == F.col("y_label")) & (F.abs(F.col("x_size") - F.col("y_size")) <= 1) & (~F.col("y_rest") | (F.col("x_cell") <= F.col("y_cell"))))
    pair = block("x_cell", "y_cell").alias("block")
    once = F.col("x_cell") == F.col("y_cell")
    sides = meet.select(pair, F.when(once, 0).otherwise(1).alias("side"), F.col("x_cell").alias("cell")).unionByName(meet.filter(~once).select(pair, F.lit(2).alias("side"), F.col("y_cell").alias("cell")))
    here = named.select("label", "same", "known", block("label", "size", "rest", "part").alias("cell")).join(sides, "cell")
    rest = here.join(many.select("same", "hashes"), "same")
    return settle(links.unionByName(links_of(rest)))


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema[0].dataType.simpleString()
    rows = settle(texts.mapInArrow(signer(shingle, percent), f"doc_id {kind}, same long, n long, keys array<long>"))
    classes = settle(rows.filter("n > 0").groupBy("same").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("keys").alias("keys")))
    links = set_links(texts, classes, shared_keys(classes), shingle, percent)
    named = classes.select("same", "id").withColumn("label", F.col("same"))
    if links is not None:
        labels = components(links).withColumnRenamed("fp", "same")
        named = classes.select("same", "id").join(labels, "same", "left").withColumn("label", F.coalesce("label", "same"))
    ids = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of = settle(named.join(ids, "label").select("same", "component_id"))
    own: Column = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "same", "n").join(of, "same", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), shingle=3, percent=90)


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, r, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, r, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS c FROM s GROUP BY doc_id, r),
reps AS (SELECT c, min(r) AS r, min(n) AS n FROM c GROUP BY c),
rs AS (SELECT reps.c, reps.n, s.g FROM reps JOIN s USING (r)),
met AS (SELECT a.c AS x, b.c AS y, a.n AS n, b.n AS m, count(*) AS k FROM rs a JOIN rs b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM met WHERE 100 * k >= 90 * (n + m - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT c AS x, c AS y FROM reps UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
ids AS (SELECT reach.x AS c, min(c.doc_id) AS component_id FROM reach JOIN c ON c.c = reach.y GROUP BY reach.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN c USING (r) LEFT JOIN ids ON ids.c = c.c
"""
