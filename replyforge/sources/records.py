"""CSV records of any width: the lines of each file in order, cut into cells with quotes honoured."""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforge.session import folders_listed

if TYPE_CHECKING:
    import pyarrow as pa

RECORDS = "file string, line bigint, cells array<string>, problem string"
# A record longer than this many characters is taken for one whose quote was never closed.
MOST_CHARACTERS = 64 << 20
# Fed after the last line: it comes back as a record of its own unless a quote is still open.
END = "\x00end\n"
BATCH_CELLS = 100_000
BATCH_CHARACTERS = 4 << 20
LINES_AT_ONCE = 256


class Unreadable(Exception):
    """Why a file cannot be cut into records."""


def _texts(lines: Iterator[bytes], held: list[int]) -> Iterator[str]:
    """Lines as text with their line end; ``held`` counts the characters since the last record."""
    for i, line in enumerate(lines):
        try:
            text = line.decode("utf-8-sig" if i == 0 else "utf-8")
        except UnicodeDecodeError as wrong:
            raise Unreadable("not UTF-8 text") from wrong
        held[0] += len(text)
        if held[0] > MOST_CHARACTERS:
            raise Unreadable("a quote is not closed")
        yield text + "\n"
    yield END


def file_records(lines: Iterator[bytes]) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of the records of one file. Blank lines are passed over, but a blank first line counts."""
    csv.field_size_limit(sys.maxsize)
    held, number = [0], 0
    try:
        for cells in csv.reader(_texts(lines, held)):
            held[0] = 0
            if cells == [END[:-1]]:
                return
            if cells and cells[-1].endswith(END):
                raise Unreadable("a quote is not closed")
            if cells or number == 0:
                yield number, cells
                number += 1
    except csv.Error as wrong:
        raise Unreadable(str(wrong)) from wrong


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    kinds = pa.schema([("file", pa.string()), ("line", pa.int64()), ("cells", pa.list_(pa.string())), ("problem", pa.string())])
    # A few lines at a time, and records go out by their number of cells and of characters: long lines do not add up.
    parts = (b.slice(start, LINES_AT_ONCE) for b in batches for start in range(0, b.num_rows, LINES_AT_ONCE))
    stream = (row for b in parts for row in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True))
    out: list[dict] = []
    size = characters = 0
    for file, own in groupby(stream, key=lambda r: r[0]):
        try:
            for number, cells in file_records(value for _, value in own):
                out.append({"file": file, "line": number, "cells": cells, "problem": None})
                size += len(cells) + 1
                characters += sum(map(len, cells))
                if size > BATCH_CELLS or characters > BATCH_CHARACTERS:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out, size, characters = [], 0, 0
        except Unreadable as why:
            out.append({"file": file, "line": -1, "cells": None, "problem": f"unreadable: {why}"})
    if out:
        yield pa.RecordBatch.from_pylist(out, kinds)


def read_records(spark: SparkSession, path: str | Sequence[str], name: Column) -> DataFrame:
    """RECORDS of all files; a file that cannot be cut has a row with ``problem`` and line -1, and its rows do not count.

    Files are read as lines, in as many tasks as their size asks for, then each file's lines come together in
    order in one task, which holds one record at a time. Cells may hold line breaks, and every record has as
    many cells as it was delivered with. One unreadable file does not stop the others.
    """
    with folders_listed(spark):
        found = spark.read.text(path)
    lines = found.select(
        name.alias("file"),
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    ordered = lines.repartition("file").sortWithinPartitions("file", "block", "place")
    return ordered.select("file", "value").mapInArrow(_cut, RECORDS)


def listed_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path`` of every file as a scan names it, also of empty ones, which no scan shows.

    The session lists the files for any read of them.
    """
    with folders_listed(spark):
        files = spark.read.text(path).inputFiles()
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    return listed.select(F.regexp_replace("path", "^([^:/]+):///", "$1:/").alias("path"))
