"""Reading tables, bounded Arrow pieces, and vectorised token hashes shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlens.sources.staging import stage

#: Documents are handed to Python in batches of at most so many rows and worked on in pieces of about so many bytes.
BATCH_ROWS = 256
PIECE_BYTES = 2 << 20

#: Label rows are held out when the checksum of the id, modulo 4, is this.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that long texts stay within a worker's memory; shuffle files go once a query has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    _ship(spark)
    return spark


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Hands the package to Python workers that would not find it on their path."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="sessionlens-code-"), "sessionlens.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.glob("sessionlens/**/*.py")):
            out.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


#: Small rows that a file of a written table should hold, where their number is known; files at least.
FILE_ROWS, LEAST_FILES = 500_000, 8


def written(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage, survives lost executors. Of a table known to have no more
    than `most` small rows, no more files than these fill."""
    if most is not None:
        df = df.coalesce(max(LEAST_FILES, most // FILE_ROWS))
    return stage(df, name)[0]


@contextmanager
def joined_by_sorting(spark: SparkSession) -> Iterator[None]:
    """Within it, joins whose rows have been dealt out stay as planned: turned into broadcasts, each would have the driver gather and
    hold a table, by a job with a task for each partition. Only for what is written inside."""
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def held_out(doc_id="doc_id"):
    """Whether a document is kept out of learning; a null id counts as learnable."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Arrow ----------------------------------------------------------------------------------------------------------------


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each; one longer text makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text starts; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# Tokens and hashes ----------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=None)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BASE = 0xD6E8FEB86659FD93  # odd, so that its powers can be inverted modulo 2**64
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """The first `n` powers modulo 2**64, kept by the worker up to the size of an ordinary piece."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, PIECE_BYTES + 2), base, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept)
        if len(kept) <= 2 * PIECE_BYTES:
            _powers[base] = kept
    return kept[:n]


_INVERSE = pow(BASE, -1, 1 << 64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the bytes stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * powers(len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(len(data) + 1, _INVERSE)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


def class_table(inside) -> np.ndarray:
    """Whether each byte value belongs to a token."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words by white space, and terms of letters and digits (every byte of a non-ASCII character counts as a letter).
WORD_BYTES = class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
TERM_BYTES = class_table(lambda b: b >= 0x80 or chr(b).isalnum())

#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def tokens(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each token; tokens never cross documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    within = inside[data]
    first = within.copy()
    first[1:] &= ~within[:-1]
    last = within.copy()
    last[:-1] &= ~within[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = within[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = within[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def bounds(groups: np.ndarray, n: int) -> np.ndarray:
    """Where each of `n` groups begins in ascending group numbers, and the end."""
    return np.searchsorted(groups, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


class Members:
    """Fast exact lookup of many hashes in a sorted array: a table on the low bits turns most away first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(np.asarray(keys, np.uint64))
        bits = min(24, max(12, int(np.ceil(np.log2(len(self.keys) + 1))) + 3))
        self.low = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys & self.low).astype(np.int64)] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the sorted keys, -1 for strangers."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.keys) and len(hashes):
            near = np.flatnonzero(self.table[(hashes & self.low).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[near]
            out[near[hit]] = at[hit]
        return out
