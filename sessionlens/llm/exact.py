"""Operator 11: exact duplicates by owners in Patricia tries.

Each task collects its texts in tries, one root for each length: edges carry whole stretches of bytes, and a terminal owns a text and
holds the smallest and largest id seen with it, so a text that many documents share leaves a task once. Tries that outgrow their memory
are spilled by subtree: all terminals under the heaviest lengths are written out, and a later copy gets a new terminal. The
written texts are then dealt by length and content hash and inserted as full byte strings into the tries of their part, whose terminals
merge the owners. Documents reach their class by the owner they met first, so copies of one text are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import LOWER, parts, pieces, text_buffer, tuned, written

#: Bytes that the tries of a task may hold before subtrees are spilled, and what a node counts besides its label.
HOLD, NODE = 32 << 20, 300
#: Bytes of texts sent in one batch.
SEND = 2 << 20

COLLAPSED = (
    "doc_id long, row long, owner long, n_bytes long, content_hash long, text binary, sha string, smallest long, largest long, "
    "first_row long, last_row long, n long"
)
CLASSES = "owner long, smallest long, largest long, first_row long, last_row long, n long, sha string"


class Owner:
    """A terminal: the ids met with one text, and the rows that have the smallest and largest; a null id gives way to any other."""

    __slots__ = ("number", "smallest", "largest", "first_row", "last_row", "n", "sha")

    def __init__(self):
        self.number = self.smallest = self.largest = self.first_row = self.last_row = self.sha = None
        self.n = 0

    def add(self, smallest, largest, first_row: int, last_row: int, n: int) -> None:
        if not self.n or (smallest is not None and (self.smallest is None or smallest < self.smallest)):
            self.smallest, self.first_row = smallest, first_row
        if not self.n or (largest is not None and (self.largest is None or largest > self.largest)):
            self.largest, self.last_row = largest, last_row
        self.n += n


_CHUNK = 256


def _shared_prefix(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of `label` stand in `text` from `at` on."""
    k = 0
    while label[k : k + _CHUNK] == text[at + k : at + k + _CHUNK] and k < len(label):
        k += _CHUNK
    a, b = label[k : k + _CHUNK], text[at + k : at + k + _CHUNK]
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
    return k + (int(differ[0]) if len(differ) else n)


class Tries:
    """A compressed radix trie for each length; strings of one length never end inside each other, so only leaves are terminals.

    An edge is [label, below] under its first byte; below is a dict of edges or an Owner.
    """

    def __init__(self):
        self.roots: dict[int, dict] = {}
        self.held: dict[int, int] = {}
        self.total = 0

    def owner(self, text: bytes) -> Owner:
        """The terminal of `text`, made if it is new."""
        n, at = len(text), 0
        edges = self.roots.setdefault(n, {})
        while True:
            first = text[at] if at < n else -1
            edge = edges.get(first)
            if edge is None:
                edges[first] = [text[at:], new := Owner()]
                self._hold(n, n - at + NODE)
                return new
            label, below = edge
            if text.startswith(label, at):
                if isinstance(below, Owner):
                    return below
                at, edges = at + len(label), below
            else:
                k = _shared_prefix(label, text, at)
                edge[0], edge[1] = label[:k], {label[k]: [label[k:], below]}
                self._hold(n, NODE)
                at, edges = at + k, edge[1]

    def _hold(self, length: int, size: int) -> None:
        self.held[length] = self.held.get(length, 0) + size
        self.total += size

    def spill(self, least: int = 0) -> Iterator[tuple[bytes, Owner]]:
        """Takes out the subtrees of the heaviest lengths until no more than `least` is held."""
        for length in sorted(self.held, key=self.held.get, reverse=True):
            if self.total <= least:
                return
            self.total -= self.held.pop(length)
            open_edges = [(b"", self.roots.pop(length))]
            while open_edges:
                before, edges = open_edges.pop()
                for label, below in edges.values():
                    if isinstance(below, Owner):
                        yield before + label, below
                    else:
                        open_edges.append((before + label, below))


def content_hash(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


def _batch(schema: str, columns: dict) -> pa.RecordBatch:
    """A batch of all columns of the schema, null where `columns` has none."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields], [f[0] for f in fields]
    )


def _collapse(hashed: Callable[[bytes], int], hold: int):
    def texts(found: Iterator[tuple[bytes, Owner]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        names = ("owner", "n_bytes", "content_hash", "text", "sha", "smallest", "largest", "first_row", "last_row", "n")
        for text, o in found:
            digest = hashlib.sha256(text)
            rows.append((o.number, len(text), hashed(digest.digest()), text, digest.hexdigest(), o.smallest, o.largest, o.first_row, o.last_row, o.n))
            size += len(text) + NODE
            if size > SEND:
                yield _batch(COLLAPSED, dict(zip(names, zip(*rows))))
                rows, size = [], 0
        if rows:
            yield _batch(COLLAPSED, dict(zip(names, zip(*rows))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, row = Tries(), TaskContext.get().partitionId() << 33
        for piece in pieces(batches):
            data, offsets = text_buffer(piece.column("text"))
            raw, cuts = LOWER[data].tobytes(), offsets.tolist()
            ids, rows, owners = piece.column("doc_id").to_pylist(), range(row, row + piece.num_rows), []
            for i, a, b, at in zip(ids, cuts, cuts[1:], rows):
                owner = tries.owner(raw[a:b])
                if owner.number is None:
                    owner.number = at
                owner.add(i, i, at, at, 1)
                owners.append(owner.number)
            row += piece.num_rows
            yield _batch(COLLAPSED, {"doc_id": ids, "row": list(rows), "owner": owners})
            if tries.total > hold:
                yield from texts(tries.spill(hold // 2))
        yield from texts(tries.spill())

    return run


def _merge(hold: int):
    """Owners of equal texts merged, from rows sorted by length and content hash; a text is complete where the hash changes."""

    def classes(waiting: list) -> pa.RecordBatch:
        rows = [(number, o.smallest, o.largest, o.first_row, o.last_row, o.n, o.sha) for number, o in waiting]
        return _batch(CLASSES, dict(zip([c.split()[0] for c in CLASSES.split(", ")], zip(*rows))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, waiting, last = Tries(), [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n_bytes", "content_hash", "owner", "smallest", "largest", "first_row", "last_row", "n", "sha")]
            texts = batch.column("text")
            for i, (n_bytes, content, number, smallest, largest, first_row, last_row, n, sha) in enumerate(zip(*columns)):
                if last != (n_bytes, content) and waiting and (last[0] != n_bytes or tries.total > hold or len(waiting) > 10_000):
                    yield classes(waiting)
                    tries, waiting = Tries(), []
                last = (n_bytes, content)
                owner = tries.owner(texts[i].as_py())
                owner.add(smallest, largest, first_row, last_row, n)
                owner.sha = sha
                waiting.append((number, owner))
        if waiting:
            yield classes(waiting)

    return run


def exact_groups(docs: DataFrame, keep: str = "largest", hashed: Callable[[bytes], int] = content_hash, hold: int = HOLD) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, smallest_id, largest_id) of each row of `docs` (doc_id, text).

    Texts are equal when their bytes are, after A-Z has been lower-cased; a null text counts as empty. One row of each group stays:
    that of the largest id, or of the smallest with keep="smallest". A null id loses to any other, and keep_id is null where a group
    has no other; of rows with the same id and text one stays. All other columns are ignored. `hashed` deals texts by their sha256;
    two texts with one hash are still told apart by their bytes.
    """
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    collapsed = written(rows.mapInArrow(_collapse(hashed, hold), COLLAPSED), "collapsed")
    members = collapsed.where("row is not null").select("doc_id", "row", "owner")
    texts = collapsed.where("row is null").drop("doc_id", "row").repartition(parts(spark), "n_bytes", "content_hash")
    classes = written(texts.sortWithinPartitions("n_bytes", "content_hash").mapInArrow(_merge(hold), CLASSES), "classes")
    kept_id, kept_row = ("largest", "last_row") if keep == "largest" else ("smallest", "first_row")
    return members.join(classes, "owner").select(
        "doc_id", F.col(kept_id).alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col(kept_row)).alias("kept"),
        F.col("sha").alias("text_sha256"), F.col("smallest").alias("smallest_id"), F.col("largest").alias("largest_id"),
    )


def op11_exact(docs: DataFrame) -> DataFrame:
    return exact_groups(docs)
