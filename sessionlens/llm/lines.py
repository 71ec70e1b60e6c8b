"""Operator 7: deletion of repeated line runs by winnowing.

The units are lines, and the sentences within longer ones. A run is a stretch of three units, or of one or two with a long unit
among them. Of each run the least unit is its fingerprint, by a hash, long units first: these window minima are the same wherever
the run stands, so every repeated run has a fingerprint that repeats, and only about half of the units are one. Fingerprints that
stand once are left behind; the places of the others are joined and extended both ways to the runs that they are the least of.
Each run's first place stays, and later ones are deleted: a repeated stretch goes as a whole, whichever earlier places its parts
have. Units are compared whole: of a passage that begins or ends within a sentence, those sentences stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import bounds, mix, pieces, signed, span_hashes, text_buffer, tuned, written

#: Units of a run, which are the windows that minima are taken of.
RUN = 3
#: A unit of so many words is a run by itself; a passage of over 50 words in four units or fewer has one.
LONG = 13

#: The runs that a fingerprint can be the least unit of: units of the run, and how many of them stand before the fingerprint.
SLOTS = [(size, before) for size in range(1, RUN + 1) for before in range(size)]
SPOTS = "fp long, doc_id long, digest int, run long, size int, pos int"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Units:
    """Units of a piece: trimmed byte spans, where each unit's bytes begin (the trailing blanks belong to it), owner, words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        blank = _BLANK[data]
        cut = data == 0x0A
        cut[:-1] |= _STOP[data[:-1]] & (data[1:] == 0x20)
        ends = np.union1d(np.flatnonzero(cut) + 1, offsets[1:])
        ends = ends[ends > 0]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        solid = np.concatenate([[0], np.cumsum(~blank)])
        full = solid[ends] > solid[starts] if n else np.zeros(0, bool)
        starts, ends = starts[full], ends[full]
        places = np.flatnonzero(~blank)
        self.first, self.last = places[solid[starts]], places[solid[ends] - 1] + 1
        self.owner = np.searchsorted(offsets, self.first, side="right") - 1
        head = ~blank
        head[1:] &= blank[:-1]
        heads = np.concatenate([[0], np.cumsum(head)])
        self.words = heads[ends] - heads[starts] + (~head[self.first] if n else 0)
        self.hashes = np.maximum(span_hashes(data, self.first, self.last), np.uint64(1))
        self.edges = bounds(self.owner, len(offsets) - 1)


def fingerprints(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """Units that are the least of a run, and by slot the hashes of those runs, 0 where the unit is not the least."""
    n = len(u.owner)
    long = u.words >= LONG
    rank = (u.hashes >> np.uint64(1)) | np.where(long, np.uint64(0), np.uint64(1 << 63))
    runs = np.zeros((len(SLOTS), n), np.uint64)
    for size in range(1, min(RUN, n) + 1):
        starts = np.arange(n - size + 1)
        grams = np.full(len(starts), size, np.uint64) * np.uint64(0x5851F42D4C957F2D)
        some, least = np.zeros(len(starts), bool), starts
        for k in range(size):
            grams = mix(grams * np.uint64(3) + u.hashes[starts + k])
            some |= long[starts + k]
            least = np.where(rank[starts + k] <= rank[least], starts + k, least)
        whole = (u.owner[starts] == u.owner[starts + size - 1]) & (some | (size == RUN))
        for before in range(size):
            at = np.flatnonzero(whole & (least == starts + before))
            runs[SLOTS.index((size, before)), at + before] = np.maximum(grams[at], np.uint64(1))
    at = np.flatnonzero(runs.any(axis=0))
    return at, runs[:, at]


def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        u = Units(*text_buffer(piece.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(signed(u.hashes[fingerprints(u)[0]]))], ["fp"])


def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run that a fingerprint is the least of."""
    sizes, befores = np.array(SLOTS, np.int32).T
    for piece in pieces(batches):
        u = Units(*text_buffer(piece.column("text")))
        at, runs = fingerprints(u)
        slot, of = np.nonzero(runs)
        place = at[of]
        owner = u.owner[place]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(u.hashes[place])),
                pa.array(piece.column("doc_id").to_numpy(zero_copy_only=False)[owner].astype(np.int64)),
                pa.array(piece.column("digest").to_numpy(zero_copy_only=False)[owner].astype(np.int32)),
                pa.array(signed(runs[slot, of])),
                pa.array(sizes[slot]),
                pa.array((place - u.edges[owner]).astype(np.int32) - befores[slot]),
            ],
            [x.split()[0] for x in SPOTS.split(", ")],
        )


def extended(docs: DataFrame) -> DataFrame:
    """The runs around fingerprints that repeat: (run, size, doc_id, digest, pos). Any run that repeats is among them, at all its
    places; the fingerprints are joined as written tables, so that a frequent one is split over tasks."""
    own = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    often = own.select("text").mapInArrow(marks, "fp long").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    places = own.mapInArrow(spots, SPOTS).join(written(often, "fingerprints"), "fp")
    return written(places.select("doc_id", "digest", "run", "size", "pos"), "runs")


def repeats(docs: DataFrame) -> DataFrame:
    """Runs that have stood before: (doc_id, digest, seen), each with the unit that it must not reach back over: one that overlaps
    its own earlier copy would take that copy's units with it."""
    found = extended(docs)
    place = F.struct("doc_id", "pos")
    first = found.groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("run", "first")
    first = written(first, "firsts")  # as a table, so that the join below can split a common run over tasks
    own = F.col("first.doc_id") == F.col("doc_id")
    later = found.join(first, "run").where(
        (F.col("first.doc_id") < F.col("doc_id")) | (own & (F.col("first.pos") < F.col("pos")))
    )
    least = F.when(own, F.col("first.pos") + F.col("size")).otherwise(0)
    seen = F.struct(F.greatest("pos", least).alias("start"), (F.col("pos") + F.col("size")).alias("end"))
    return later.groupBy("doc_id", "digest").agg(F.collect_list(seen).alias("seen"))


def covered(seen: pa.Array, u: Units) -> np.ndarray:
    """Whether each unit lies in one of its document's runs."""
    seen = seen.combine_chunks() if isinstance(seen, pa.ChunkedArray) else seen
    flat, base = seen.flatten(), np.repeat(u.edges[:-1], pc.fill_null(pc.list_value_length(seen), 0).to_numpy(zero_copy_only=False))
    steps = np.zeros(len(u.owner) + 1, np.int64)
    np.add.at(steps, base + flat.field("start").to_numpy(), 1)
    np.add.at(steps, base + flat.field("end").to_numpy(), -1)
    return np.cumsum(steps[:-1]) > 0


def dedup_lines(docs: DataFrame, counts: tuple[str, str] = ("n_units", "n_removed")) -> DataFrame:
    """`docs` with repeated stretches taken out of `text`, and two more columns: units, and units removed.

    Places are ordered by doc_id and unit; the first stays. Rows with a null id are neither searched nor changed, rows that share
    an id are ordered by unit, and of equal places all stay, so equal rows do not empty each other. Null texts stay null. All other
    columns pass; those named as in `counts` give way to the new ones.
    """
    spark = tuned(docs.sparkSession)
    names = docs.columns
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.hash("text").alias("digest"),
        F.struct(*[F.col(f"`{c}`") for c in names if c not in ("text",)]).alias("row"),
    )
    joined = keyed.join(repeats(keyed.select("doc_id", "text", "digest")), ["doc_id", "digest"], "left")
    row_type = keyed.schema["row"].dataType.simpleString()

    def run(batches):
        for piece in pieces(batches):
            data, offsets = text_buffer(piece.column("text"))
            u = Units(data, offsets)
            gone = covered(piece.column("seen"), u)
            texts = piece.column("text").to_pylist()
            removed = np.concatenate([[0], np.cumsum(gone)])
            n_removed = removed[u.edges[1:]] - removed[u.edges[:-1]]
            for i in np.flatnonzero(n_removed):
                mine = range(u.edges[i], u.edges[i + 1])
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                cuts = [int(u.first[j] - offsets[i]) for j in mine] + [len(raw)]
                kept = [raw[cuts[k] : cuts[k + 1]] for k, j in enumerate(mine) if not gone[j]]
                texts[i] = b"".join(kept).decode("utf-8").rstrip() if kept else ""
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), piece.column("row"), pa.array(np.diff(u.edges).astype(np.int64)), pa.array(n_removed.astype(np.int64))],
                ["text", "row", "n_units", "n_removed"],
            )

    done = joined.select("text", "row", "seen").mapInArrow(run, f"text string, row {row_type}, n_units long, n_removed long")
    back = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names if c not in counts]
    return done.select(*back, F.col("n_units").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def op7_lines(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text"))
