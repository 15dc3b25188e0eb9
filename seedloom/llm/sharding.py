"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's number is its place in the input: the rows of the files before its own (by path), then its index in the file,
both of which the reader knows, so nothing is shuffled or sorted. The permutation maps numbers 0..n-1 onto themselves; a
permuted number p goes to shard p mod shards, slot p div shards. The rows of two shards differ by one at most, slots have
no gaps, and seed and files decide all, whatever the partitioning.

Input that doesn't come from files is first written to the shared folder. Null texts have no bytes. Repeated rows,
ties, equal texts and null ids don't matter: rows are told apart by their place. An empty table gives an empty result.
Extra columns are kept; if they clash with the added names, the added ones get a suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from seedloom.functions.permute import ROUNDS, permute
from seedloom.llm.common import fresh, settle, table

SHARDS = 24
SEED = 7
#: Input files whose numbers (some 100 bytes each) are sent to every task; beyond, they are joined by a shuffle.
MAX_FILES = 500_000


def placed(docs: DataFrame) -> DataFrame:
    """docs with the hidden place of each row: input whose rows have no place is written first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
        return docs
    except AnalysisException:
        return settle(docs)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """docs with a shard and a slot column, and their names."""
    docs = placed(docs)
    path, index, p, out, slot = fresh(docs, "file_path", "row_index", "place", "shard", "slot")
    # A row for each input file: numbers of rows, and of the rows before.
    files = docs.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count("*").alias("n_file"))
    files = files.select(
        "f", (F.sum("n_file").over(W.orderBy("f")) - F.col("n_file")).alias("before"),
        F.sum("n_file").over(W.orderBy("f").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n_all"),
    ).withColumn("side", F.ceil(F.sqrt("n_all")).cast("long"))
    if len(docs.inputFiles()) <= MAX_FILES:
        files = F.broadcast(files)
    rows = docs.select(*docs.columns, F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    rows = rows.join(files, F.col(path) == F.col("f")).withColumn(p, permute(F.col(index) + F.col("before"), F.col("n_all"), F.col("side"), seed))
    return rows.select(*docs.columns, F.pmod(F.col(p), F.lit(shards)).cast("int").alias(out), F.call_function("div", F.col(p), F.lit(shards).cast("long")).alias(slot)), [out, slot]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, (shard_, slot) = shard(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col(shard_).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


OP4_SQL = f"""
WITH RECURSIVE n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM documents),
bits AS (SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
         UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
r AS (SELECT row_number() OVER () - 1 AS p, doc_id, coalesce(text, '') AS text FROM documents),
walk AS (SELECT p, 0 AS k, p // side AS a, p % side AS b FROM r, n
         UNION ALL
         SELECT p, k + 1, b, (a + CAST('0x' || substr(md5('{SEED}:' || (k % {ROUNDS} + 1) || ':' || b), 1, 8) AS BIGINT)) % side
         FROM walk, n WHERE k = 0 OR k % {ROUNDS} <> 0 OR a * side + b >= n.n),
q AS (SELECT p, a * side + b AS q FROM walk, n WHERE k > 0 AND k % {ROUNDS} = 0 AND a * side + b < n.n)
SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size,
       xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                       lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32,
       'rows' AS law, CAST(q % {SHARDS} AS INTEGER) AS shard, q // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN q USING (p), tab
"""
