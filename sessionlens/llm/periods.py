"""Operator 13: periodic runs of words by a sparse diagonal table.

A cell (word, lag) of the table is set where a word equals the one `lag` words before, and a diagonal is a stretch of such cells under one
lag: its match length says how long the period lasts, and a diagonal that ends long enough is a run. Setting every earlier occurrence
of each word would take the square of a frequent word's count, so cells are set at scales: at scale s (1, 2, 4, ...) the
cell of a word is the nearest earlier occurrence of the s words that begin with it, if that lies more than s / 2 and at most s
back. No run is lost: inside a run of smallest period q, s >= q words recur exactly q words later and no sooner (two periods
of a stretch as long as their sum share a divisor that is one too), so all of the run's diagonal is set at its scale, and no diagonal of a
multiple of q is. Only words whose block occurs again go on to the next scale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import pieces, text_buffer, tuned

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def diagonals(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start, then period.

    `words` numbers equal words equally, below its length and differently in each document; `longest` is the size of the largest document.
    """
    n = len(words)
    shift = np.int64(max(n, 1).bit_length())
    names, at, size = words.astype(np.int64), np.arange(n), 1
    found = [np.zeros((3, 0), np.int64)]
    while len(at) and size // 2 < longest // LEAST_PERIODS:
        table = np.sort((names << shift) | at)
        place = table & ((np.int64(1) << shift) - 1)
        same = (table[1:] >> shift) == (table[:-1] >> shift)
        lag = np.zeros(n, np.int64)
        lag[place[1:][same]] = (place[1:] - place[:-1])[same]
        cell = np.flatnonzero((lag > size // 2) & (lag <= size))
        head = np.ones(len(cell), bool)
        head[1:] = (cell[1:] != cell[:-1] + 1) | (lag[cell[1:]] != lag[cell[:-1]])
        heads = np.flatnonzero(head)
        period = lag[cell[heads]]
        matched = np.diff(np.append(heads, len(cell))) + size - 1
        long = matched + period >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.array([cell[heads] - period, matched + period, period])[:, long])
        # blocks that occur again, joined with the one behind them
        again = np.zeros(n, bool)
        again[place[1:][same]] = again[place[:-1][same]] = True
        again = again[at]
        left, names = at[again], names[again]
        right = np.minimum(np.searchsorted(left, left + size), max(len(left) - 1, 0))
        whole = np.flatnonzero(left[right] == left + size) if len(left) else left
        at = left[whole]
        _, names = np.unique(names[whole] * np.int64(n) + names[right[whole]], return_inverse=True)
        size *= 2
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _search(alter: Callable[[int | None, list[bytes]], list[bytes]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, offsets = text_buffer(piece.column("text"))
            raw, cuts = data.tobytes(), offsets.tolist()
            ids = piece.column("doc_id").to_pylist()
            texts, numbers, edges = [], [], [0]
            for i, a, b in zip(ids, cuts, cuts[1:]):
                words = raw[a:b].split()  # at the bytes 09-0D and 20
                if alter:
                    words = alter(i, words)
                first: dict[bytes, int] = {}
                numbers.extend(map(first.setdefault, words, range(edges[-1], edges[-1] + len(words))))
                texts.append(words)
                edges.append(len(numbers))
            places, sizes = np.array(edges), np.diff(edges)
            start, length, period = diagonals(np.array(numbers, np.int64), int(sizes.max()))
            owner = np.searchsorted(places, start, side="right") - 1
            change = np.zeros(len(numbers) + 1, np.int64)  # words after the first period of a run go
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            gone = np.cumsum(change)[:-1] > 0
            for i in np.unique(owner):
                texts[i] = [w for w, drop in zip(texts[i], gone[edges[i] : edges[i + 1]].tolist()) if not drop]
            runs = pa.StructArray.from_arrays([pa.array(start - places[owner]), pa.array(length), pa.array(period)], fields=list(RUN))
            bounds = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), runs),
                    pa.array([b" ".join(words) for words in texts], pa.binary()).cast(pa.string()),
                ],
                [c.split()[0] for c in ("doc_id", "n_words", "runs", "collapsed")],
            )

    return run


def periodic_runs(docs: DataFrame, alter: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of `docs` (doc_id, text).

    `runs` lists (start, length, period) by start, then period: stretches of at least LEAST_WORDS words and LEAST_PERIODS times their
    smallest period that no neighbouring word extends. `collapsed` has the words but for those that a run holds after its first period,
    with one space between. Null and blank texts have no word and no run; null and repeated ids are rows like others; other
    columns are ignored. `alter` may change a document's words before the search.
    """
    tuned(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_search(alter), FOUND)


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted periods, in every tenth document by checksum; a null id has none."""
    n = len(words)
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def op13_periods(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, looped)
    # the greatest length, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    period = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        period.alias("period"), F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
