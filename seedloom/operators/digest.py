"""A hash of a table's rows that doesn't depend on their order or partitioning: a tree of hashes.

A row's hash is that of its JSON text. Hashes that share their last four hexadecimal digits are hashed together in
order, these by the first two of the four, and these to the root; equal rows are counted. Leaves are even, since hashes are, so no
task holds more than some 65,536th of the rows' hashes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_hash(frame: DataFrame) -> Column:
    """Columns by name; nulls are there, maps in the order of their keys."""
    cells = [F.array_sort(F.map_entries(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in sorted(frame.schema.fields, key=lambda f: f.name)]
    return F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)


def rows_digest(*frames: DataFrame) -> str:
    """The root over the rows of one or several tables, in hexadecimal; it also depends on which table a row is in."""
    together = lambda parts: F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(parts))), 256).alias("h")
    hashes = reduce(DataFrame.unionByName, [f.select(F.concat(F.lit("" if k == 0 else f"{k}:"), row_hash(f)).alias("h")) for k, f in enumerate(frames)])
    leaves = hashes.groupBy("h").agg(F.count("*").alias("n"))
    # The last four digits, since a table's number may stand in front.
    nodes = leaves.groupBy(F.right("h", F.lit(4)).alias("p")).agg(together(F.concat_ws(":", "h", F.col("n").cast("string"))))
    for digits in (2, 0):
        nodes = nodes.groupBy(F.substring("p", 1, digits).alias("p")).agg(together(F.concat_ws(":", "p", "h")))
    root = nodes.first()
    return root["h"] if root else hashlib.sha256(b"").hexdigest()
