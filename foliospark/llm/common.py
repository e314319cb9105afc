"""What the corpus operators share: tables in the shared folder, words, row identity."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes to bytes: A-Z lower-cased, everything that belongs to no word becomes a blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
LETTERS = re.compile(rb"[A-Za-z]")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset and driver and executors are one process (tests, a laptop) a folder of
    our own takes its place; on a cluster that would be a folder of one machine, so there an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="foliospark-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Open lists that take down the tables stored meanwhile, innermost last.
_RECORDS: list[list[str]] = []


#: All tables of this process that are still there, and a way to remove them when it ends.
_LEFT: dict[str, object] = {}


def _remove_left() -> None:
    for path, where in list(_LEFT.items()):
        try:
            where.delete(True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


class _Place:
    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def delete(self, deep: bool) -> None:
        self.system.delete(self.path, deep)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there.

    A lost executor costs no recomputation of what went into the table. What nobody dropped before goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/foliospark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _LEFT:
        atexit.unregister(_remove_left)
        atexit.register(_remove_left)
    _LEFT[path] = _Place(spark, path)
    if _RECORDS:
        _RECORDS[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recording(paths: list[str]):
    """Tables stored inside are added to paths, so that drop_tables can remove them when what was made of them is written."""
    _RECORDS.append(paths)
    try:
        yield
    finally:
        for k in reversed(range(len(_RECORDS))):  # by identity: two empty lists are equal
            if _RECORDS[k] is paths:
                del _RECORDS[k]
                break


def drop_tables(spark: SparkSession, paths: list[str], needed_by: DataFrame | None = None) -> None:
    """Removes stored tables, apart from those that needed_by reads; paths then names what is left."""
    used = ""
    if needed_by is not None:
        leaves = needed_by._jdf.queryExecution().analyzed().collectLeaves()
        for k in range(leaves.size()):
            leaf = leaves.apply(k)
            if leaf.getClass().getSimpleName() == "LogicalRelation":
                used += leaf.relation().location().rootPaths().mkString(" ") + " "
    left = []
    for path in paths:
        if path.rsplit("/", 1)[-1] in used:
            left.append(path)
            continue
        _Place(spark, path).delete(True)
        _LEFT.pop(path, None)
    paths[:] = left


#: Rows of two or three short columns that may be broadcast: some 30 MB in each executor.
SMALL_ROWS = 250_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, marked for a broadcast if it has at most so many rows (they are counted); otherwise as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, by Arrow: with a list, createDataFrame starts Python workers of another kind on the executors, which stay there."""
    fields = StructType.fromDDL(schema)
    kinds = to_arrow_schema(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.types)], schema=kinds), fields)


#: Rows of whole texts that a plan sends in an Arrow batch, where the plan runs inside the operator (batch_rows).
TEXT_ROWS = 1024

#: Rows of an Arrow batch that are unpacked into Python objects together.
SLICE_ROWS = 512


def thrifty(function):
    """An Arrow batch function that gets its batches in slices, and whose task gives its memory back at the end.

    Python workers live on between tasks; what their allocators keep would count against the executor.
    """

    def run(batches):
        import ctypes
        import gc

        import pyarrow

        try:
            yield from function(b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS))
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run


@contextlib.contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Plans that run inside send at most n rows in an Arrow batch: for rows that hold many texts, of which the usual number takes memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(text: bytes, n_bytes: int, piece: int = 1024) -> list[bytes]:
    """At most n_bytes of the text in pieces from all over it, by the hash of their number; the whole text if it fits."""
    if len(text) <= n_bytes:
        return [text]
    import xxhash

    piece = max(1, min(piece, n_bytes))
    count = -(-len(text) // piece)
    few = sorted(range(count), key=lambda k: xxhash.xxh64_intdigest(k.to_bytes(8, "little")))[: n_bytes // piece]
    return [text[k * piece : (k + 1) * piece] for k in sorted(few)]


def lowest(rows: DataFrame, group: str, n: int, max_groups: int) -> list:
    """Of the max_groups most frequent groups the distinct rows with the n smallest hashes each. rows: group, h (64-bit hash), and what names a row.

    A bound on the hash that lets about twice n rows of a group through comes from the groups' sizes; only they are sent to the
    driver. No task gets a whole group.
    """
    whole = 1 << 40
    place = F.pmod(F.col("h"), F.lit(whole))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(max_groups).collect()
    bounds = {r[group]: (whole if r["n"] <= 2 * n else -(-whole * 2 * n // r["n"])) for r in sizes}
    kind = rows.schema[group].dataType.simpleString()
    out: list = []
    while bounds:
        table = local_table(rows.sparkSession, list(bounds.items()), f"`{group}` {kind}, _bound long")
        got: dict = {g: [] for g in bounds}
        for r in rows.join(F.broadcast(table), group).where(place < F.col("_bound")).select(*rows.columns).distinct().collect():
            got[r[group]].append(r)
        again = {}
        for g, found in got.items():
            if len(found) < n and bounds[g] < whole:  # repeated rows made the group look larger
                again[g] = min(whole, 8 * bounds[g])
            else:
                out.extend(sorted(found, key=lambda r: (r["h"] % whole, *(str(x) for x in r)))[:n])
        bounds = again
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on an array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], all from one running sum of powers; values are random 64-bit numbers."""
    odd = 0x9E3779B97F4A7C15
    back = pow(odd, -1, 1 << 64)
    n = len(values)
    up = np.cumprod(np.r_[np.uint64(1), np.full(n, odd, np.uint64)], dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], dtype=np.uint64, out=sums[1:])
    down = np.cumprod(np.r_[np.uint64(1), np.full(n, back, np.uint64)], dtype=np.uint64)
    return mix64(mix64((sums[ends] - sums[starts]) * down[starts]) + (ends - starts).astype(np.uint64))


def unit_hash(*parts: Column) -> Column:
    """A number of [0, 1) with 52 bits, from the MD5 of the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
