"""Shared plumbing of the training-data operators: tables that cut lineage,
streaming over sorted groups, and vectorised hashing of words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes, which is what ``bytes.split()`` splits at.
SPACE = 32
#: Text bytes that one numpy pass takes; longer texts are taken alone.
PASS_BYTES = 1 << 19
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='waylark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a re-read at most."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What empties the caches that operators keep in a Python worker between tasks.
CACHES: list[Callable[[], None]] = []


def release() -> None:
    """Give a worker's memory back before another operator's work: Python workers are used again, and their caches with them."""
    for clear in CACHES:
        clear()
    trim()


def trim() -> None:
    """Give memory that is free within the process back to the system."""
    gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Rows of a batch for Python where rows hold whole texts.
TEXT_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have TEXT_ROWS rows at most, as a batch of texts is held several times over in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, batches for Python hold so many rows at most; for actions on large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def grouped_batches(it: Iterator[pd.DataFrame], key: str, least_rows: int, least_bytes: int = 0, weigh: str | None = None) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from batches sorted by ``key``; small groups come together, so that numpy works on long arrays."""
    held: list[pd.DataFrame] = []
    rows, size = 0, 0
    for pdf in it:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        last = keys[-1]
        cut = int(np.searchsorted(keys, last, side="left"))
        if held and (cut or held[-1][key].iloc[-1] != last):
            enough = rows + cut >= least_rows or (weigh is not None and size >= least_bytes)
            if enough:
                if cut:
                    held.append(pdf.iloc[:cut])
                yield pd.concat(held, ignore_index=True)
                held, rows, size = [], 0, 0
                pdf = pdf.iloc[cut:]
        held.append(pdf)
        rows += len(pdf)
        if weigh is not None:
            size += int(pdf[weigh].map(lambda x: len(x) if x is not None else 0).sum())
    if held:
        yield pd.concat(held, ignore_index=True)


def map_groups(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, least_rows: int = 2000, weigh: str | None = None, least_bytes: int = 8 << 20, heavy: bool = False) -> DataFrame:
    """Shuffle by ``key``, sort, and hand ``fn`` frames that hold whole groups only.

    ``heavy``: a row takes much time for its size, so that partitions are not to be joined by their bytes.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in grouped_batches(it, key, least_rows, least_bytes, weigh):
            out = fn(pdf)
            if out is not None and len(out):
                yield out

    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key) if heavy else df.repartition(key)
    return dealt.sortWithinPartitions(key).mapInPandas(run, schema)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), for arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = seeds(256, 11)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PASS_BYTES + 65536)
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


class Words:
    """The words of some texts in one buffer, single spaces between them: ``start`` and ``end`` bytes, ``doc`` index and ``h``, a 64-bit hash of each."""

    __slots__ = ("buf", "raw", "start", "end", "doc", "count", "_prefix")

    def __init__(self, texts: list[bytes]):
        flat = [b" ".join(t.split()) for t in texts]
        self.count = np.fromiter((t.count(b" ") + 1 if t else 0 for t in flat), dtype=np.int64, count=len(flat))
        self.raw = b" ".join(t for t in flat if t)
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        cuts = np.flatnonzero(self.buf == SPACE)
        n = len(cuts) + 1 if len(self.buf) else 0
        self.start = np.zeros(n, dtype=np.int64)
        self.end = np.full(n, len(self.buf), dtype=np.int64)
        if n:
            self.start[1:] = cuts + 1
            self.end[:-1] = cuts
        self.doc = np.repeat(np.arange(len(flat)), self.count)
        self._prefix = None

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words, or of the byte ranges given."""
        if self._prefix is None:
            power, _ = _power_tables(len(self.buf) + 1)
            self._prefix = np.zeros(len(self.buf) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.buf] * power[: len(self.buf)], dtype=np.uint64, out=self._prefix[1:])
        _, back = _power_tables(len(self.buf) + 1)
        s, e = (self.start, self.end) if start is None else (start, end)
        return mix((self._prefix[e] - self._prefix[s]) * back[s] + (e - s).astype(np.uint64))


def passes(texts: list[bytes], most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` bytes each; whole texts."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def sliding_sum_hash(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each run of ``n`` hashes; one for each start at which a run fits."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    factors = seeds(n, seed)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * factors[j]
    return mix(out)


# ---------------------------------------------------------------- bounded filters

#: A filter never holds more positions than this (32 MB), however large the corpus: beyond it more rows pass the filter, and results stay the same.
MOST_BITS = 1 << 28


def filter_bits(items: int, per_item: int = 16, least: int = 1 << 20, most: int = MOST_BITS) -> int:
    """A power of two: ``per_item`` positions for each item, between the bounds."""
    return min(most, max(least, 1 << max(0, items * per_item - 1).bit_length()))


def position_bitmap(positions: DataFrame, col: str = "pos") -> DataFrame:
    """Pack positions (long, from 0) into rows (bucket, bitmap of 4096 bytes)."""
    one = F.col(col).cast("long") + 1  # Spark numbers buckets and bits from position 1
    return positions.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))


def bit_is_set(bits, pos):
    """Whether the bit of ``pos`` is set in ``bits``; false for a missing bitmap."""
    at = F.bitmap_bit_position(pos)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def likely(rows: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``col`` may be among the ``keys`` (of one column), by a Bloom filter of bounded size: none of those is missing, and few others are there."""
    key = F.col(keys.columns[0])
    bits = filter_bits(keys.count())
    at = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits))
    maps = written(position_bitmap(keys.select(F.explode(F.array(at(key, 1), at(key, 2))).alias("pos"))), "filter")
    out = rows
    for seed in (1, 2):
        out = out.withColumn("_pos", at(F.col(col), seed) + 1)
        side = F.broadcast(maps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
        out = out.join(side, F.bitmap_bucket_number("_pos") == F.col("_bucket")).where(bit_is_set(F.col("_bits"), F.col("_pos"))).drop("_pos", "_bucket", "_bits")
    return out
