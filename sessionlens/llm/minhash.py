"""Operator 6: near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations give all coordinates of a signature: shingles are permuted once, and coordinate k is the smallest value of the
second permutation shifted round by k. Documents that agree on a band are candidates. Equal shingle sets are collapsed
first, and no bucket is turned into all its pairs: members are compared with their bucket's leader, and what that leaves apart in a
shared bucket is compared only where it shares differences from what most members have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionlens.llm.common import LOWER, WORD_BYTES, bounds, joined_by_sorting, mix, parts, pieces, signed, span_hashes, text_buffer, tokens, tuned, unsigned, written
from sessionlens.llm.components import components
from sessionlens.llm.fingerprint import distinct

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: At a similarity of 0.8 a pair misses all bands with a chance of 3e-6.
BANDS, ROWS = 32, 5
#: One bit of each of the first coordinates; pairs agreeing on fewer are no candidates. At a similarity of 0.8 a pair agrees on 115 of
#: 128 on average, and on fewer than SKETCH_LEAST with a chance below 1e-9.
SKETCH_BITS, SKETCH_LEAST = 128, 92
#: Rounds of labels after which buckets with more than one label are open.
LABEL_ROUNDS = 2
#: Groups of fewer members are never dealt over salts.
LEAST_SHARE = 64

ABOUT = ("n_shingles", "s1", "s2")
SETS = "doc_id long, n_shingles long, s1 long, s2 long, shingles binary"
SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, s1 long, s2 long, bands array<long>"


def shingles(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of each text, sorted."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    starts, ends, owner = tokens(data, offsets, WORD_BYTES)
    words = span_hashes(data, starts, ends)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    length = np.minimum(count, size)[owner]  # words of a shingle of this text
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    first = np.flatnonzero(place + length <= count[owner])
    h = length[first].astype(np.uint64)
    for k in range(size):
        inside = length[first] > k
        part = words[np.minimum(first + k, len(words) - 1)] if len(words) else words
        h = np.where(inside, mix(h * np.uint64(0x9E3779B97F4A7C15) + part), h)
    return distinct(owner[first], h)


def permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit values; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(owner: np.ndarray, hashes: np.ndarray, n: int, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Coordinates of the texts that have shingles (rows in the order of their numbers)."""
    edges = bounds(owner, n)
    starts = edges[:-1][np.diff(edges) > 0]
    out = np.zeros((coordinates, len(starts)), np.uint32)
    if len(starts):
        base = (mix(hashes + np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)  # the first permutation
        for k in range(coordinates):
            out[k] = np.minimum.reduceat(permuted(base + np.uint32(k)), starts)
    return out


def sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            n = piece.num_rows
            owner, hashes = shingles(piece.column("text"), size)
            count = np.bincount(owner, minlength=n)
            some = np.flatnonzero(count)
            sig = signatures(owner, hashes, n)
            digests = np.zeros((2, n), np.uint64)
            edges = bounds(owner, n)
            for k in range(2):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x1B03738712FAD5C9 * (k + 1))))])
                digests[k] = mix(sums[edges[1:]] - sums[edges[:-1]])
            keys = np.zeros((n, BANDS), np.uint64)
            for b in range(BANDS):
                h = np.full(len(some), np.uint64(b + 1))
                for r in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[b * ROWS + r])
                keys[some, b] = h
            sketch = np.zeros((2, n), np.uint64)
            for k in range(SKETCH_BITS):
                bit = (permuted(sig[k].copy()) >> np.uint32(7)).astype(np.uint64) & np.uint64(1)
                sketch[k // 64, some] |= bit << np.uint64(k % 64)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(signed(digests[0])), pa.array(signed(digests[1])),
                    pa.array(signed(sketch[0])), pa.array(signed(sketch[1])),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(signed(keys.ravel()))),
                ],
                [x.split()[0] for x in SIGNED.split(", ")],
            )

    return run


def sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            owner, hashes = shingles(piece.column("text"), size)
            edges = bounds(owner, piece.num_rows)
            packed = [hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in ("doc_id", *ABOUT)], pa.array(packed, pa.large_binary())], ["doc_id", *ABOUT, "shingles"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        common, union = [], []
        for i in range(batch.num_rows):
            p, q = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
            n = len(np.intersect1d(p, q, assume_unique=True))
            common.append(n)
            union.append(len(p) + len(q) - n)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "total"])


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b, common, total): the sizes of intersection and union of the full sets of each pair."""
    sides = pairs.join(full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    sides = sides.join(full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    return sides.select("a", "b", "x", "y").mapInArrow(_overlaps, "a long, b long, common long, total long")


def _likely(x: str, y: str, percent: int) -> Column:
    """Whether the sizes and sketches of two members allow the similarity."""
    col = lambda side, name: F.col(f"{side}.{name}")
    differ = F.bit_count(col(x, "s1").bitwiseXOR(col(y, "s1"))) + F.bit_count(col(x, "s2").bitwiseXOR(col(y, "s2")))
    small, large = F.least(col(x, "n_shingles"), col(y, "n_shingles")), F.greatest(col(x, "n_shingles"), col(y, "n_shingles"))
    return (differ <= SKETCH_BITS - SKETCH_LEAST) & (small * 100 >= large * percent)


# What leaders leave apart --------------------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial numbers of sets by group and shingle."""
    for batch in batches:
        groups = batch.column("g").to_numpy()
        for g in np.unique(groups):
            held = [np.frombuffer(batch.column("shingles")[int(i)].as_buffer(), np.uint64) for i in np.flatnonzero(groups == g)]
            shingle, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g)), pa.array(signed(shingle)), pa.array(n.astype(np.int64))], ["g", "shingle", "n"])


def by_salt(size: DataFrame, total: int, most: int):
    """Two functions that deal the rows of large groups over salts, by a column, and copy a group's row to each of its salts.

    `size` (g, size) counts `total` members. Groups above total / most are large, so there are fewer than `most` of them: their salts
    are a constant in the plan, since a join would pass all rows of all groups and cost the driver a broadcast each time.
    """
    share = max(LEAST_SHARE, total // most)
    large = size.where(F.col("size") > share).select("g", F.ceil(F.col("size") / share).cast("long").alias("salts")).collect()
    listed = [F.array(*[F.lit(r[k]) for r in large]) for k in ("g", "salts")]
    salts = F.coalesce(F.map_from_arrays(*listed)[F.col("g")], F.lit(1)) if large else F.lit(1)

    def dealt(df: DataFrame, by: str) -> DataFrame:
        return df.withColumn("salt", F.pmod(F.xxhash64(by), salts.cast("long")))

    def copied(df: DataFrame) -> DataFrame:
        if not large:
            return df.withColumn("salt", F.lit(0).cast("long"))
        return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))

    return dealt, copied


DIFFERENT = "g long, salt long, doc_id long, component long, n_shingles long, s1 long, s2 long, weight long, differs array<long>"


def _differences(percent: int):
    """What each set lacks of its group's reference, and what it has besides; the weight says how far both take it off.

    With H shingles in the reference, r lacking and a added, two sets share H - r - r' + x shingles, x being the differences they have in
    common. So they are similar just where 2 (100 + percent) x is at least the sum of their weights 200 r + 2 percent a - (100 - percent) H.
    """

    passed = ("g", "salt", "doc_id", "component", *ABOUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, differs = [], []
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("shingles")[i].as_buffer(), np.uint64)
                common = batch.column("reference")[i]
                common = unsigned(common.values.to_numpy(zero_copy_only=False)) if common.is_valid else np.zeros(0, np.uint64)
                lacking = np.setdiff1d(common, own, assume_unique=True)
                added = np.setdiff1d(own, common, assume_unique=True)
                weights.append(200 * len(lacking) + 2 * percent * len(added) - (100 - percent) * len(common))
                differs.append(signed(np.concatenate([mix(lacking + np.uint64(1)), added])))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in passed], pa.array(weights, pa.int64()), pa.array(differs, pa.list_(pa.int64()))],
                [*passed, "weight", "differs"],
            )

    return run


def remaining(apart: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may connect the components left in open buckets; `apart` (key, doc_id, component), `full` the sets
    with their sizes and sketches.

    Buckets that share members make a group. The reference of a group holds what more than half of its sets have. A set whose weight and
    the least weight of the group add up to no more than 0 is similar to that least one. Any other set can be similar only to one
    that shares differences with it, at least as many as the weights ask for; both then share one among their rarest ones (the
    prefix filter of set joins). Nothing is left out, and what all members have in common makes no pair.
    """
    least = apart.groupBy("key").agg(F.min("doc_id").alias("a"))
    group = components(apart.join(least, "key").select("a", F.col("doc_id").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("g"))
    sets_of = apart.select("doc_id", "component").distinct().join(group, "doc_id").join(full, "doc_id")
    sets_of = written(sets_of.select("g", "doc_id", "component", *ABOUT, "shingles"), "apart")
    size = sets_of.groupBy("g").agg(F.count("*").alias("size"))
    dealt, copied = by_salt(size, sets_of.count(), 4 * parts(apart.sparkSession))
    counts = sets_of.select("g", "shingles").mapInArrow(_counted, "g long, shingle long, n long").groupBy("g", "shingle").agg(F.sum("n").alias("n"))
    common = dealt(counts, "shingle").join(copied(size), ["g", "salt"]).where("2 * n > size")
    reference = common.groupBy("g").agg(F.collect_list("shingle").alias("reference"))  # twice a mean set at most
    told = dealt(sets_of, "doc_id").join(copied(reference), ["g", "salt"], "left").mapInArrow(_differences(percent), DIFFERENT)
    told = written(told, "differences")
    best = told.groupBy("g").agg(F.min("weight").alias("best"), F.min_by("doc_id", F.struct("weight", "doc_id")).alias("center"))
    told = told.join(copied(best), ["g", "salt"]).withColumn("far", F.col("weight") + F.col("best") > 0)
    near = told.where("not far").select(F.col("center").alias("a"), F.col("doc_id").alias("b"))
    nearest_far = told.where("far").groupBy("g").agg(F.min("weight").alias("least_far"))
    asked = F.when(F.col("far"), F.col("weight") + F.col("best")).otherwise(F.col("weight") + F.col("least_far"))
    prefix = F.size("differs") - F.greatest(F.lit(1), F.ceil(asked / (2 * (100 + percent)))) + 1
    told = told.join(copied(nearest_far), ["g", "salt"]).withColumn("prefix", prefix.cast("int")).where("prefix > 0")
    row = told.select("g", "doc_id", "component", *ABOUT, "weight", "far", "prefix", F.size("differs").alias("n"), F.xxhash64("differs").alias("row"), F.explode("differs").alias("difference"))
    often = row.groupBy("g", "difference").agg(F.count("*").alias("often")).where("often > 1")  # what one set alone has joins nothing
    alone = F.coalesce("often", F.lit(1))
    by = Window.partitionBy("g", "doc_id", "row").orderBy(alone, "difference")
    kept = row.join(often, ["g", "difference"], "left").withColumn("place", F.row_number().over(by)).where("place <= prefix and often is not null")
    kept = written(kept.select("g", "difference", "doc_id", "component", *ABOUT, "weight", "far", (F.col("n") - F.col("place") + 1).alias("left")), "prefixes")
    side = lambda s: kept.select("g", "difference", "far", F.struct("doc_id", "component", "weight", "left", *ABOUT).alias(s))
    # the first difference that a pair shares must leave as many on both sides as the two weights ask for
    enough = 2 * (100 + percent) * F.least("p.left", "q.left") >= F.col("p.weight") + F.col("q.weight")
    pairs = side("p").where("far").drop("far").join(side("q").drop("far"), ["g", "difference"])
    pairs = pairs.where((F.col("p.component") != F.col("q.component")) & enough & _likely("p", "q", percent))
    return near.union(pairs.select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b")))


def links(signed_docs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all candidates of the similarity; `signed_docs` as made by sign(), `texts` (doc_id, text)."""
    reps = written(
        signed_docs.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2", *ABOUT, "bands").agg(F.min("doc_id").alias("doc_id")),
        "representatives",
    )
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last")
    members = written(keyed.join(shared.select("key", "leader"), "key"), "members")  # of buckets with more than one
    about = reps.select("doc_id", *ABOUT)
    active = about.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    full = written(texts.join(active, "doc_id").select("doc_id", "text", *ABOUT).mapInArrow(sets(size), SETS), "sets")
    node = lambda side: about.select(F.col("doc_id").alias(side), F.struct(*ABOUT).alias(f"{side}_"))

    def once(pairs: DataFrame) -> DataFrame:
        return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def good(known: DataFrame) -> DataFrame:
        return known.where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b")

    led = once(members.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))).join(node("a"), "a").join(node("b"), "b")
    known = written(verified(led.where(_likely("a_", "b_", percent)).select("a", "b"), full), "pairs")
    label = components(good(known), LABEL_ROUNDS)
    marked = members.select("key", "doc_id").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    open_keys = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    marked = written(marked.join(open_keys, "key", "left_semi"), "open")
    if not marked.isEmpty():
        known = known.union(verified(once(remaining(marked, full, percent)), full))
    return good(known)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs` (doc_id, text).

    Rows with a null id are in no component: component_id is null and kept true. Rows with one id are one document, linked by any of
    their texts. Null and empty texts have no shingle and no link; a text of fewer words than a shingle is one shingle.
    """
    tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with joined_by_sorting(docs.sparkSession):
        signed_docs = written(rows.mapInArrow(sign(size), SIGNED), "signatures")
        # equal sets share the smallest id among them, which stands for all in the links
        some = signed_docs.where("doc_id is not null and n_shingles > 0").select("doc_id", "d1", "d2")
        rep = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("a"))
        equal = some.join(rep, ["d1", "d2"]).select("a", F.col("doc_id").alias("b")).where("a != b")
        found = components(links(signed_docs, rows, size, percent).union(equal)).withColumnRenamed("node", "doc_id")
    out = signed_docs.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, size=2, percent=80)
