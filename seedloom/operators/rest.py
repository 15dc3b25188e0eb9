"""Patches over HTTP from the executors: a row is read, then one of its columns set. Only tables with a one-column key.

All old values of a part are read and kept before any of its cells is written, so a task that runs again after an executor
was lost doesn't take a new value for the old one; what it writes again is the same, under the same idempotency key. A
part that is done is in the journal; a run that broke off goes on with the others. Requests that fail are sent again,
RETRIES times at most, each time after twice the wait.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.errors import ConfigError, SeedloomError
from seedloom.sources.warehouse import Files

#: Parts of a run's cells, each read, then written, then journaled.
PARTS = 16
RETRIES, WAIT_S = 6, 0.1
#: Answers that may be others next time, besides those of 500 and more.
AGAIN = (408, 425, 429)

OLD = "table string, keyColumn string, key string, column string, value string, old string"


class RestSink:
    """opener(request): what urlopen does; it goes to the executors."""

    def __init__(self, base_url: str, entities: dict[str, str], headers: dict[str, str] | None = None, opener: Callable | None = None, parts: int = PARTS, retries: int = RETRIES, wait: float = WAIT_S) -> None:
        self.base, self.entities, self.headers, self.open = base_url.rstrip("/"), {k.lower(): v for k, v in entities.items()}, headers or {}, opener or urlopen
        self.parts, self.retries, self.wait = parts, retries, wait

    def _call(self, method: str, url: str, body: dict | None = None, headers: dict[str, str] | None = None) -> dict:
        request = Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers, **(headers or {})}, method=method)
        for attempt in range(self.retries + 1):
            try:
                with self.open(request) as answer:
                    return json.loads(answer.read() or b"{}")
            except (URLError, ConnectionError, TimeoutError) as e:
                final = isinstance(e, HTTPError) and e.code < 500 and e.code not in AGAIN
                if final or attempt == self.retries:
                    raise SeedloomError(f"{method} {url}: {e}") from e
                time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def url(self, table: str, key: str, key_value: str) -> str:
        if table.lower() not in self.entities:
            raise ConfigError(f"no entity is known for table {table}")
        return f"{self.base}/{self.entities[table.lower()]}/{quote(key)}/{quote(key_value, safe='')}"

    def old(self, table: str, key: str, key_value: str, column: str) -> str | None:
        url = self.url(table, key, key_value)
        got = self._call("GET", url)
        rows = got.get("value", [got])
        if len(rows) != 1:
            raise SeedloomError(f"{url}: {len(rows)} rows")
        value = rows[0].get(column)
        return None if value is None else str(value)

    def set(self, run: str, table: str, key: str, key_value: str, column: str, value: str | None) -> None:
        once = hashlib.sha256("\n".join((run, table.lower(), key_value, column.lower())).encode()).hexdigest()[:32]
        self._call("PATCH", self.url(table, key, key_value), {column: value}, {"Idempotency-Key": once})

    def patch(self, table: str, key: str, key_value: str, column: str, value: str | None) -> str | None:
        """One patch from here; its old value."""
        old = self.old(table, key, key_value, column)
        self.set("", table, key, key_value, column, value)
        return old

    def send(self, cells: DataFrame, run: str, root: str) -> DataFrame:
        """Set cells (table, keyColumn, key, column, value); they and their old values, from the journal below root."""
        spark, files = cells.sparkSession, Files(cells.sparkSession, root)
        for table in [r[0] for r in cells.select("table").distinct().collect()]:
            self.url(table, "", "")
        names = [c.split()[0] for c in OLD.split(", ")]
        cells = cells.select(*names[:-1]).withColumn("part", F.pmod(F.xxhash64("table", "key", "column"), F.lit(self.parts)))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                old = [self.old(r["table"], r["keyColumn"], r["key"], r["column"]) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(old, pa.string())], names=names)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    self.set(run, r["table"], r["keyColumn"], r["key"], r["column"], r["value"])
                yield batch

        for k in range(self.parts):
            for step, source, f in (("old", lambda k: cells.filter(F.col("part") == k).drop("part"), read), ("set", lambda k: spark.read.schema(OLD).parquet(f"{root}/old-{k}"), write)):
                if "_SUCCESS" not in files.names(f"{step}-{k}"):
                    source(k).mapInArrow(f, OLD).write.mode("overwrite").parquet(f"{root}/{step}-{k}")
        return spark.read.schema(OLD).parquet(*[f"{root}/set-{k}" for k in range(self.parts)])
