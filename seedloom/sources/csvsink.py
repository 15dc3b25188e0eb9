"""Rows as CSV: a folder of files, or one file that all tasks write.

For one file the tasks write their rows without a header, and the parts are joined in the order of the rows. A file system
that can concatenate (HDFS) does so without moving a byte; in a local or mounted one tasks copy the parts to their places
in the file, and a task that runs again writes the same bytes to the same place. Where neither can be done (object stores)
the path is a folder with the header and the parts, and its parts.json, written last, lists them in order with their sizes.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seedloom.errors import ConfigError, SeedloomError
from seedloom.functions.coerce import printed
from seedloom.sources.warehouse import Files

CONCAT = "fs.capability.paths.concat"
#: Bytes that a task copies at once.
CHUNK = 8 << 20


@dataclass(frozen=True)
class Part:
    name: str
    bytes: int


def parts_of(files: Files, folder: str) -> list[Part]:
    """The files that tasks wrote to a folder, without empty ones, in the order of the rows."""
    place = re.compile(r"part-(\d+)-.*-c(\d+)")  # the task's number can have more digits than its padding, so names don't sort
    found = [(place.match(s.getPath().getName()), s.getLen()) for s in files.fs.listStatus(files.path(folder))]
    return [Part(f"{folder}/{m.string}", n) for m, n in sorted(((m, n) for m, n in found if m and n), key=lambda x: (int(x[0][1]), int(x[0][2])))]


def joining(files: Files) -> str | None:
    """How parts become one file in this file system."""
    # A path that doesn't exist yet has the capabilities of the folder it will be in.
    if files.fs.hasPathCapability(files.path(), CONCAT):
        return "concat"
    return "copy" if files.fs.getScheme() == "file" else None


def concatenated(files: Files, parts: list[Part]) -> str:
    """The first part, with the others behind it."""
    if len(parts) > 1:
        others = files.paths([p.name for p in parts[1:]])
        files.fs.concat(files.path(parts[0].name), others)
    return parts[0].name


def copied(spark: SparkSession, files: Files, parts: list[Part]) -> str:
    """One file, each part copied to its place by a task."""
    name = "whole"
    local = lambda n: files.path(n).toUri().getPath()
    target, at, rows = local(name), 0, []
    for p in parts:
        rows.append((local(p.name), at, p.bytes))
        at += p.bytes
    with open(target, "wb") as f:
        f.truncate(at)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = os.open(target, os.O_WRONLY)
                try:
                    with open(r["path"], "rb") as f:
                        to = r["at"]
                        while chunk := f.read(CHUNK):
                            to += os.pwrite(out, chunk, to)
                    os.fsync(out)
                finally:
                    os.close(out)
                if to != r["at"] + r["bytes"]:
                    raise OSError(f"{r['path']}: {to - r['at']} of {r['bytes']} bytes copied")
            yield batch

    schema = "path string, at long, bytes long"
    spark.createDataFrame(rows, schema).mapInArrow(copy, schema).write.format("noop").mode("overwrite").save()
    return name


class CsvSink:
    """One header, cells as CSV prints them. single: one file at path, else a folder of files with a header each."""

    def __init__(self, path: str, single: bool = False) -> None:
        self.path, self.single = path.rstrip("/"), single

    def load(self, frame: DataFrame, truncate: bool = False) -> int:
        spark, seen = frame.sparkSession, Observation()
        text = frame.select([printed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in frame.schema.fields])
        rows = text.observe(seen, F.count(F.lit(1)).alias("n"))
        if self.single:
            self.join(spark, rows, text.columns, truncate)
        else:
            self.write(rows, self.path, "overwrite" if truncate else "errorifexists", header=True)
        return seen.get["n"]

    @staticmethod
    def write(text: DataFrame, path: str, mode: str = "overwrite", header: bool = False) -> None:
        text.write.mode(mode).csv(path, header=header, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression="none")

    def join(self, spark: SparkSession, rows: DataFrame, names: list[str], truncate: bool) -> None:
        final = Files(spark, self.path)
        there = final.fs.exists(final.path())
        if there and not truncate:
            raise ConfigError(f"{self.path} is there already")
        how = joining(final)
        folder, _, name = self.path.rpartition("/")
        # A name with a dot in front isn't read as data by anyone who reads the folder meanwhile.
        staged = Files(spark, f"{folder or '.'}/.{name}-{uuid.uuid4().hex}") if how else final
        if there and not how:
            final.fs.delete(final.path(), True)
        head = spark.createDataFrame([tuple(names)], ", ".join(f"c{k} string" for k in range(len(names)))).coalesce(1)
        self.write(head, f"{staged.root}/head")
        self.write(rows, f"{staged.root}/rows")
        parts = parts_of(staged, "head") + parts_of(staged, "rows")
        if not how:
            staged.create("parts.json", json.dumps([{"name": p.name, "bytes": p.bytes} for p in parts], indent=1))
            return
        whole = concatenated(staged, parts) if how == "concat" else copied(spark, staged, parts)
        if there:
            final.fs.delete(final.path(), True)
        if not final.fs.rename(staged.path(whole), final.path()):
            raise SeedloomError(f"the file can't be moved to {self.path}")
        final.fs.delete(staged.path(), True)
