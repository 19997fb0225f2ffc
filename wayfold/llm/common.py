"""Session and text helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SMALL = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from ``spark.checkpoint.dir``.

    Only a session that runs in one process, on one machine, may be without one.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spent(df: DataFrame) -> DataFrame:
    """``materialize``, and the shuffle files that it took go as soon as the rows are written, not when the driver's memory is next tidied."""
    name, spark = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession
    before = spark.conf.get(name, None)
    spark.conf.set(name, True)
    try:
        return materialize(df.select("*"))  # a frame takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Tables written by scope, for ``release``.
_made: dict[str, list[str]] = {}
_scope: list[str] = []


@contextmanager
def scratch(scope: str):
    """Tables that ``stored`` and ``bucketed`` write meanwhile belong to ``scope``."""
    _scope.append(scope)
    try:
        yield
    finally:
        _scope.pop()


def release(docs: DataFrame, scope: str) -> None:
    """Remove the tables of a scope that ``docs`` does not read."""
    spark = docs.sparkSession
    plan = docs._jdf.queryExecution().analyzed().toString()
    for name in [n for n in _made.get(scope, []) if n not in plan]:
        _made[scope].remove(name)
        if not spark.catalog.tableExists(name):
            continue
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
        spark.sql(f"drop table {name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _table(df: DataFrame, key: str | None = None) -> DataFrame:
    spark = df.sparkSession
    name = f"rows_{uuid.uuid4().hex}"
    writer = df.write.option("path", f"{shared_folder(spark)}/{name}")
    if key:
        writer = writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    writer.saveAsTable(name)
    if _scope:
        _made.setdefault(_scope[-1], []).append(name)
    return spark.table(name)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: later reads take only the columns they need."""
    return _table(df)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a row number ``key``, written in the shared folder in buckets of it: joins on it move only the other side."""
    return _table(df.withColumn(key, F.monotonically_increasing_id()), key)  # once written, a number stays with its row


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` begins with it in any case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = "_" + name
    return name


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written, with its number of rows, taken on the way."""
    seen = Observation()
    df = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return df, seen.get.get("n", 0)


def small(df: DataFrame, bound: int = SMALL) -> DataFrame:
    """``df`` written and counted; marked for broadcast only if it has at most ``bound`` rows, else left to Catalyst."""
    df, n = counted(df)
    return F.broadcast(df) if n <= bound else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs run meanwhile send Python at most ``rows`` rows a batch, for rows too wide for the usual number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the ``n + 1`` offsets; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _fold_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_FOLD = _fold_table()
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def fold(raw: np.ndarray, latin: bool = False) -> np.ndarray:
    """A-Z to lower case; with ``latin`` also the two-byte letters À to Þ."""
    out = _FOLD[raw]
    if latin and len(out) > 1:
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        up = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
        out[up] += 0x20
    return out


def span_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; 0 for an empty one."""
    n = end - start
    total = np.zeros(len(n), np.uint64)
    if not len(n):
        return total
    # eight bytes at a time, as little-endian words with the tail masked off
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    octets = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    live, at, left = np.flatnonzero(n), start[n > 0], n[n > 0]
    while len(live):
        block = np.ascontiguousarray(octets[at]).view(np.uint64)[:, 0]
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        total[live] = mix((total[live] + _ODD) ^ block)
        keep = left > 8
        live, at, left = live[keep], at[keep] + 8, left[keep] - 8
    return mix(total ^ n.astype(np.uint64))


class Words:
    """Words of a batch of texts as flat arrays.

    A word is a run of digits, a-z and non-ASCII characters after folding, or of
    the bytes that ``word`` marks.
    ``first[d]`` to ``first[d + 1]`` are document d's words; ``start`` and
    ``end`` are byte places, ``code`` a 64-bit hash of each word's bytes.
    """

    def __init__(self, column: pa.Array, latin: bool = False, word: np.ndarray = _WORD):
        raw, self.offsets = text_bytes(column)
        self.raw = raw = fold(raw, latin)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = word[raw]
        edge = inside[1:] != inside[:-1]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        joined = np.unique(cuts[inside[cuts] & inside[cuts + 1]])  # a word may not run on into the next text
        begins, ends = inside[1:] & edge, inside[:-1] & edge
        begins[joined] = True
        ends[joined] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, self.offsets)
        self.code = span_codes(raw, self.start, self.end)


def shingle_codes(code: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` codes; the last ``k - 1`` places have none."""
    if len(code) < k:
        return np.zeros(0, np.uint64)
    out = code[: len(code) - k + 1].copy()
    for j in range(1, k):
        out = mix(out * _ODD + code[j : len(code) - k + 1 + j])
    return out


def bounded(batches, column: int, limit: int = 4 << 20):
    """The same rows in record batches of about ``limit`` bytes of text at most; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
