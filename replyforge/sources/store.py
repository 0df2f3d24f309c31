"""A folder of tables that change together: each write adds new folders, then one small file names what counts.

Readers follow that file alone. A write that stops half-way leaves folders that nobody names and the old state
readable; the file itself is replaced in one rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyforge.operators.joins import MOST_NAMES
from replyforge.session import folders_listed

POINTER = "CURRENT"


@dataclass
class Part:
    """One write, and which of its collections still count."""

    name: str
    collections: list[str]


@dataclass
class State:
    """What a store holds. ``report``: the last write; ``dropped``: collections taken out since then."""

    version: int = 0
    parts: list[Part] = field(default_factory=list)
    report: str | None = None
    dropped: list[str] = field(default_factory=list)

    def without(self, collections: Iterable[str]) -> list[Part]:
        gone = set(collections)
        kept = [Part(p.name, [c for c in p.collections if c not in gone]) for p in self.parts]
        return [p for p in kept if p.collections]

    def names(self) -> list[str]:
        return [c for p in self.parts for c in p.collections]


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop
    where = hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_state(spark: SparkSession, root: str) -> State:
    """The current state; an empty one where nothing was stored."""
    files, path = _file_system(spark, f"{root}/{POINTER}")
    if not files.exists(path):
        return State()
    stream = files.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    raw = json.loads(text)
    return State(raw["version"], [Part(**p) for p in raw["parts"]], raw["report"], raw["dropped"])


def publish(spark: SparkSession, root: str, state: State) -> None:
    """Make ``state`` the current one. It is an error when another write was published since its predecessor was read."""
    if read_state(spark, root).version != state.version:
        raise RuntimeError(f"{root} was changed by another write; nothing was published")
    raw = {
        "version": state.version + 1,
        "parts": [{"name": p.name, "collections": p.collections} for p in state.parts],
        "report": state.report,
        "dropped": state.dropped,
    }
    files, aside = _file_system(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(aside, True)
    try:
        stream.write(bytearray(json.dumps(raw).encode()))
    finally:
        stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    context = fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(aside), files.makeQualified(fs.Path(f"{root}/{POINTER}")), options)


def new_part() -> str:
    return uuid.uuid4().hex


def folder(root: str, table: str, part: str) -> str:
    """Where a write puts its rows of ``table``: beside those of other writes, so that one scan reads them all."""
    return f"{root}/{table}/part={part}"


def read_table(spark: SparkSession, root: str, table: str, schema: str, state: State | None = None) -> DataFrame:
    """The rows of ``table`` that count, from every part, in one scan; only folders of live collections are read."""
    state = read_state(spark, root) if state is None else state
    if not state.parts:
        return spark.createDataFrame([], schema)
    columns = T.StructType.fromDDL(schema).names
    with folders_listed(spark):
        rows = spark.read.schema(f"{schema}, part string").parquet(f"{root}/{table}")
    if len(state.names()) > MOST_NAMES:
        # A long list as a table: the join prunes partitions too, and no plan holds the names.
        named = spark.createDataFrame([(p.name, c) for p in state.parts for c in p.collections], "part string, collection string")
        return rows.join(F.broadcast(named), ["part", "collection"], "left_semi").select(*columns)
    live = [(F.col("part") == p.name) & F.col("collection").isin(p.collections) for p in state.parts]
    return rows.where(reduce(or_, live)).select(*columns)


def read_report(spark: SparkSession, root: str, schema: str, state: State | None = None) -> DataFrame:
    """The report of the last write, without collections dropped since."""
    state = read_state(spark, root) if state is None else state
    if state.report is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(folder(root, "report", state.report))
    if len(state.dropped) > MOST_NAMES:
        return rows.join(F.broadcast(spark.createDataFrame([(c,) for c in state.dropped], "collection string")), "collection", "left_anti")
    return rows.where(~F.coalesce(F.col("collection"), F.lit("")).isin(state.dropped)) if state.dropped else rows


def drop(spark: SparkSession, root: str, collections: Sequence[str] | None = None, published: Callable[[], None] | None = None) -> None:
    """Take collections, or all of them, out of the store; a name that is not stored is passed over.

    They are gone once the state is published (then ``published`` is called); their folders are removed after that.
    """
    state = read_state(spark, root)
    gone = set(state.names()) if collections is None else set(collections)
    before = state.parts
    after = State(state.version, state.without(gone), None if collections is None else state.report, sorted({*state.dropped, *gone}))
    publish(spark, root, after)
    if published is not None:
        published()
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for part in before:
        dropped = set(part.collections) & gone
        for table in ("kb", "fields"):
            own = folder(root, table, part.name)
            # A part that lost all its collections goes as a whole.
            paths = [own] if len(dropped) == len(part.collections) else [f"{own}/collection={names.escapePathName(c)}" for c in dropped]
            for path in paths:
                files, where = _file_system(spark, path)
                files.delete(where, True)
