"""Operator 10: I-Match document fingerprints over randomised lexicons.

Terms within a band of document frequency form the lexicon. A document's distinct lexicon terms, sorted, are hashed once for
each of several random subsets of the lexicon, at four inclusion rates, so that short and long documents both keep
subsets in which a small edit changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import (
    TERM_BYTES, Members, bounds, mix, parts, pieces, signed, span_hashes, text_buffer, tokens, tuned, unsigned,
)

#: A lexicon term stands in this share of all documents, and in two at least. The lower end bounds the lexicon: at most the mean
#: number of distinct terms of a document / LEAST_SHARE.
LEAST_SHARE, MOST_SHARE = 5e-4, 0.02
#: Subsets of the lexicon: so many at each rate of inclusion.
RATES = (1 / 8, 1 / 32, 1 / 128, 1 / 512)
EACH = 16
#: A rate is compared when so many of its subsets hold a term of either document.
ENOUGH = 4
FLUSH = 2_000_000
#: Stands for a null id while rows are dealt out.
NO_ID = -(2**63)

OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_terms long"
)


def text_terms(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each term (letters and digits, lower case)."""
    data, offsets = text_buffer(pc.utf8_lower(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts))
    starts, ends, owner = tokens(data, offsets, TERM_BYTES)
    return span_hashes(data, starts, ends), owner


def distinct(owner: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (owner, term)."""
    order = np.lexsort((terms, owner))
    owner, terms = owner[order], terms[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])
    return owner[new], terms[new]


def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies (term, df), combined within the task."""
    held, waiting = [np.zeros(0, np.uint64), np.zeros(0, np.int64)], []

    def combined():
        terms = np.concatenate([held[0], *waiting])
        n = np.concatenate([held[1], np.ones(len(terms) - len(held[0]), np.int64)])
        terms, at = np.unique(terms, return_inverse=True)
        return [terms, np.bincount(at, n, len(terms)).astype(np.int64)]

    def out():
        return pa.RecordBatch.from_arrays([pa.array(signed(held[0])), pa.array(held[1])], ["term", "df"])

    for piece in pieces(batches):
        terms, owner = text_terms(piece.column("text"))
        waiting.append(distinct(owner, terms)[1])
        if sum(map(len, waiting)) > FLUSH:
            held, waiting = combined(), []
            if len(held[0]) > FLUSH:
                yield out()
                held = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    held = combined()
    yield out()


@dataclass
class Lexicon:
    """Sorted term hashes and, by term, the subsets that include it as bits."""

    members: Members
    subsets: np.ndarray

    @classmethod
    def of(cls, terms: np.ndarray) -> Lexicon:
        members = Members(terms)
        subsets = np.zeros(len(members.keys), np.uint64)
        for k in range(len(RATES) * EACH):
            inside = mix(members.keys ^ mix(np.array([k + 1], np.uint64))) < np.uint64(int(RATES[k // EACH] * 2.0**64))
            subsets |= inside.astype(np.uint64) << np.uint64(k)
        return cls(members, subsets)

    def prints(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A 16-bit hash of each text's terms in each subset, 0 where the subset has none; the number of lexicon terms."""
        terms, owner = text_terms(texts)
        at = self.members.positions(terms)
        owner, at = distinct(owner[at >= 0], at[at >= 0])
        edges = bounds(owner, len(texts))
        out = np.zeros((len(texts), len(RATES) * EACH), np.uint16)
        subsets, values = self.subsets[at], mix(self.members.keys[at])
        for k in range(out.shape[1]):
            inside = ((subsets >> np.uint64(k)) & np.uint64(1)).astype(bool)
            some = np.flatnonzero(inside)
            sums = np.zeros(len(some) + 1, np.uint64)
            np.cumsum(mix(values[some] + np.uint64(k + 1)), out=sums[1:])
            cut = np.searchsorted(some, edges)
            short = (mix(sums[cut[1:]] - sums[cut[:-1]]) >> np.uint64(48)).astype(np.uint16)
            out[:, k] = np.where(cut[1:] > cut[:-1], np.maximum(short, 1), 0)
        return out, np.diff(edges)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets with terms, at the rate where it is highest; -1 if no subset has any."""
    some = ((a > 0) | (b > 0)).reshape(len(a), len(RATES), EACH).sum(2)
    same = ((a == b) & (a > 0)).reshape(len(a), len(RATES), EACH).sum(2)
    by_rate = np.where(some >= ENOUGH, same / np.maximum(some, 1), -1.0).max(1, initial=-1.0)
    pooled = np.where(some.sum(1) > 0, same.sum(1) / np.maximum(some.sum(1), 1), -1.0)
    return np.where(by_rate >= 0, by_rate, pooled)


def _shown(prints: np.ndarray, texts: list[str]) -> list[str]:
    """Fingerprints as text; a document without lexicon terms gets a hash of its whole text."""
    raw = prints.astype(">u2")
    return [
        raw[i].tobytes().hex() if some else "=" + hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()[:32]
        for i, (t, some) in enumerate(zip(texts, prints.any(1)))
    ]


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first characters of the next text, or all of it if that is shorter."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_rows(lexicon: Lexicon, ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, which only follows."""
    own, n_terms = lexicon.prints(texts)
    changed = [edited(t, after) for t, after in zip(texts, texts[1:])]
    new, _ = lexicon.prints(changed)
    shown, shown_new = _shown(own, texts), _shown(new, changed)

    def near(a, b, shown_a, shown_b):
        value = likeness(a, b)
        same = np.array([x == y for x, y in zip(shown_a, shown_b)], bool)
        return np.where(same, 1.0, np.maximum(value, 0.0))

    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array(shown[:-1], pa.string()), pa.array(shown_new, pa.string()),
            pa.array(near(own[:-1], new, shown[:-1], shown_new)), pa.array(near(own[:-1], own[1:], shown[:-1], shown[1:])),
            pa.array(n_terms[:-1].astype(np.int64)),
        ],
        [x.split()[0] for x in OUT.split(", ")],
    )


def lexicon_of(docs: DataFrame) -> Lexicon:
    """Document frequencies of all terms over all documents; the band of them, bounded by LEAST_SHARE, goes to the driver."""
    tuned(docs.sparkSession)
    n = docs.count()
    df = docs.select("text").mapInArrow(count_documents, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    band = df.where((F.col("df") >= max(2.0, LEAST_SHARE * n)) & (F.col("df") <= max(2.0, MOST_SHARE * n)))
    return Lexicon.of(unsigned(band.select("term").toArrow().column("term").to_numpy()))


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, part, extra) such that each part, in the order of extra, doc_id and text, ends with the row that
    follows its last one (marked extra): each text moves once, and no task sees more than its range of ids.

    Null ids come first; equal ids are ordered by text. After the last document comes the first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * parts(spark)
    cuts = sorted(set(rows.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("key"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", part)
    firsts = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())  # a row a part
    before = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    heads = rows.drop("part").join(F.broadcast(spark.createDataFrame(before, "key long, part int")), "key")
    return rows.withColumn("extra", F.lit(0)).unionByName(heads.withColumn("extra", F.lit(1)))


def fingerprints(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of the contract for each document of `docs` (doc_id, text).

    A null text counts as empty. A document without lexicon terms has a hash of its whole text as fingerprint, and likeness 1 to
    an equal one, else 0. A single document is followed by itself; repeated rows are kept and follow each other.
    """
    spark = tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(lexicon)  # bounded by LEAST_SHARE

    def run(batches):
        part, closed, ids, texts = None, False, [], []
        for piece in pieces(batches):
            for p, extra, key, text in zip(*[piece.column(c).to_pylist() for c in ("part", "extra", "key", "text")]):
                if p != part:
                    part, closed, ids, texts = p, False, [], []
                if closed:  # equal ids follow: the first has been taken
                    continue
                ids.append(None if key == NO_ID else key)
                texts.append(text)
                if extra:
                    yield fingerprint_rows(shared.value, ids, texts)
                    closed, ids, texts = True, [], []
            if len(texts) > 1:
                yield fingerprint_rows(shared.value, ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    dealt = with_following(docs)
    return dealt.repartition(parts(spark), "part").sortWithinPartitions("part", "extra", "key", "text").mapInArrow(run, OUT)


def op10_fingerprint(docs: DataFrame) -> DataFrame:
    return fingerprints(docs, lexicon_of(docs))
