"""Bounded-space online packing of tokenized documents into fixed windows.

Each input partition keeps a fixed number of open windows. What is left of a document after its full windows goes into
the open window that it fills best; when it fits in none, the fullest is emitted and a new one opened. The windows still
open at the end of a partition are merged afterwards, best fit in falling order, in groups of partitions.

A null text is an empty one (the end token alone). Empty input gives no pieces. Repeated rows are packed each on its
own, and ids of documents keep their type. Of windows with equal room the oldest is filled first, of leftovers with
equal fill the lower number. Extra columns are ignored, whatever their names. Very long texts, also those of one run of
white space, are tokenized whole and cut at the window size; no id is dropped. The string of a special token in a text is
ordinary text (encode_special_tokens, as the vocabulary's own notes have it): what stands in a document can't end one.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import settle, table

WINDOW = 1024
OPEN_WINDOWS = 64
#: Leftover windows merged by one task.
MERGE_ROWS = 1024

#: After doc_id, which keeps its type.
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, used long, is_open boolean"


def plain_encoder(vocabulary: str) -> Callable[[str], bytes]:
    """Token ids of a whole text by a tokenizers file, as little-endian unsigned 32-bit numbers."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoder(ranks: str) -> Callable[[str], bytes]:
    """The same ids, by the ranks of the same vocabulary, in a sixth of the time (the tests compare both).

    The faster way gives up on runs of hundreds of thousands of spaces; such texts take the tokenizers file beside it."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_to_numpy
    plain = functools.cache(lambda: plain_encoder(ranks.removesuffix(".tiktoken") + ".json"))

    def encode(text: str) -> bytes:
        try:
            return fast(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:
            return plain()(text)

    return encode


def packer(ranks: str, end_id: int, window: int, open_windows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        end = end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 32
        made = 0
        #: Open windows by free room: (room, sequence), and their pieces.
        rooms: list[tuple[int, int]] = []
        held: dict[int, list[tuple]] = {}
        rows: list[tuple] = []
        kind = pa.null()

        def emit(sequence: int, used: int, is_open: bool) -> None:
            rows.extend((*piece, used, is_open) for piece in held.pop(sequence))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            names = ["doc_id", *[f.split()[0] for f in PIECES.split(", ")]]
            types = [kind] + [pa.int64()] * 7 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    n, crc = len(part) // 4, zlib.crc32(part)
                    at = bisect.bisect_left(rooms, (n, -1))
                    if n == window:
                        rows.append((doc_id, start, n, crc, total, base + made, 0, n, False))
                        made += 1
                        continue
                    if at < len(rooms):
                        room, sequence = rooms.pop(at)
                    else:
                        if len(rooms) >= open_windows:
                            room, sequence = rooms.pop(0)
                            emit(sequence, window - room, False)
                        room, sequence = window, base + made
                        made += 1
                        held[sequence] = []
                    held[sequence].append((doc_id, start, n, crc, total, sequence, window - room))
                    if room == n:
                        emit(sequence, window, False)
                    else:
                        bisect.insort(rooms, (room - n, sequence))
            if len(rows) > 10_000:
                yield flush()
        for room, sequence in rooms:
            emit(sequence, window - room, True)
        if rows:
            yield flush()

    return pack


def merger(window: int):
    def merge(t: pa.Table) -> pa.Table:
        """Which window each leftover window joins, and where: the largest first, each where it leaves least room."""
        found = sorted(zip(t["used"].to_pylist(), t["sequence_id"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
        rooms: list[tuple[int, int]] = []
        out = []
        for used, sequence in found:
            at = bisect.bisect_left(rooms, (used, -1))
            room, host = rooms.pop(at) if at < len(rooms) else (window, sequence)
            out.append((sequence, host, window - room))
            if room > used:
                bisect.insort(rooms, (room - used, host))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["sequence_id", "host", "moved"])

    return merge


def pack(docs: DataFrame, ranks: str, end_id: int = 0, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, {PIECES}"
    pieces = settle(rows.mapInArrow(packer(ranks, end_id, window, open_windows), schema))
    left = pieces.filter("is_open").groupBy("sequence_id").agg(F.max("used").alias("used"))
    groups = max(1, -(-left.count() // MERGE_ROWS))
    moves = (
        left.groupBy(F.pmod(F.shiftright("sequence_id", 32), F.lit(groups)).alias("g"))
        .applyInArrow(merger(window), "sequence_id long, host long, moved long")
    )
    merged = (
        pieces.filter("is_open").join(moves, "sequence_id")
        .withColumn("sequence_id", F.col("host")).withColumn("offset", F.col("offset") + F.col("moved"))
    )
    return pieces.filter("not is_open").select(names).unionByName(merged.select(names))


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), ranks_path())
