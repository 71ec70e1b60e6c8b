"""Operator 5: language identification with bit-sliced Bloom filters of letter trigrams.

Each learned language has a Bloom filter of its trigrams; the filters stand side by side, one bit a language in each slot, so
that a few lookups return every language that holds a trigram. Counts of hits by language, less the hits expected by
chance, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import held_out, mix, pieces, signed, tuned, unsigned

UNDETERMINED = "und"
#: A trigram belongs to a language when it makes up this share of the language's trigrams, and at least this part of its
#: share in the language where it is most common. The first bounds the filters: at most 1 / MIN_SHARE trigrams a language.
MIN_SHARE = 5e-6
MIN_RELATIVE = 0.2
HASHES = 4
SLOTS_PER_GRAM = 12
#: Trigram counts of a task are sent on when so many differ.
FLUSH = 2_000_000

OUT = "doc_id long, lang_pred string, score double, n_grams long"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of lower-cased letters (other characters are blanks, the middle one is a letter) and each one's text."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0x20).astype(np.uint64)
    middle = np.flatnonzero(codes[1:-1] != 0x20) + 1
    packed = (codes[middle - 1] << np.uint64(42)) | (codes[middle] << np.uint64(21)) | codes[middle + 1]
    starts = np.cumsum([1, *(len(t) + 1 for t in lowered)])[:-1]
    return packed, np.searchsorted(starts, middle, side="right") - 1


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, gram, n) of labelled texts."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def batch_of(lang: str):
        grams, n = held[lang]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(signed(grams)), pa.array(n)], ["lang", "gram", "n"])

    for piece in pieces(batches):
        langs = np.array(piece.column("lang").to_pylist(), dtype=object)
        texts = _texts(piece)
        for lang in dict.fromkeys(langs):
            packed, _ = trigrams([texts[i] for i in np.flatnonzero(langs == lang)])
            grams, n = np.unique(packed, return_counts=True)
            if lang in held:
                both, at = np.unique(np.concatenate([held[lang][0], grams]), return_inverse=True)
                grams, n = both, np.bincount(at, np.concatenate([held[lang][1], n]), len(both)).astype(np.int64)
            held[lang] = grams, n.astype(np.int64)
            if sum(len(g) for g, _ in held.values()) > FLUSH:
                yield from [batch_of(x) for x in held]
                held = {}
    yield from [batch_of(x) for x in held]


@dataclass
class SlicedBloom:
    """Bloom filters of all languages; `slots[word][slot]` holds 64 languages' bits."""

    langs: list[str]
    slots: np.ndarray
    by_chance: np.ndarray  # chance of a false hit, by language
    prior: int  # the language with the most trigrams

    @classmethod
    def build(cls, langs: list[str], grams: dict[str, np.ndarray], sizes: dict[str, int]) -> SlicedBloom:
        total = max([1, *(len(g) for g in grams.values())])
        bits = max(10, int(np.ceil(np.log2(total * SLOTS_PER_GRAM))))
        slots = np.zeros((max(1, -(-len(langs) // 64)), 1 << bits), np.uint64)
        for k, lang in enumerate(langs):
            for at in cls.places(grams.get(lang, np.zeros(0, np.uint64)), bits):
                slots[k // 64, at] |= np.uint64(1 << (k % 64))
        filled = np.array([np.mean((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(langs))])
        return cls(langs, slots, filled**HASHES, max(range(len(langs)), key=lambda k: sizes.get(langs[k], 0), default=0))

    @staticmethod
    def places(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        h = mix(grams + np.uint64(0x9E3779B97F4A7C15))
        step = mix(h) | np.uint64(1)
        for _ in range(HASHES):
            yield (h >> np.uint64(64 - bits)).astype(np.int64)
            h = h + step

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that hold each trigram, as bits, by word of 64 languages."""
        bits = int(self.slots.shape[1]).bit_length() - 1
        found = np.full((self.slots.shape[0], len(grams)), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in self.places(grams, bits):
            found &= self.slots[:, at]
        return found

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and number of trigrams of each text."""
        packed, owner = trigrams(texts)
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        n = np.diff(edges)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), n
        masks = self.masks(packed)
        hits = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            running = np.zeros(len(packed) + 1, np.int64)
            np.cumsum((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1), out=running[1:])
            hits[:, k] = running[edges[1:]] - running[edges[:-1]]
        real = np.maximum(0, hits - n[:, None] * self.by_chance) / np.maximum(1e-9, 1 - self.by_chance)
        best, total = real.argmax(1), real.sum(1)
        best = np.where(total > 0, best, self.prior)
        score = np.where(total > 0, real[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 0.0)
        return [self.langs[b] if k else UNDETERMINED for b, k in zip(best, n)], np.where(n > 0, np.clip(score, 0, 1), 0.0), n


def learn(labelled: DataFrame) -> SlicedBloom:
    """Filters from (text, lang) rows: all of them are counted, by map-side partial counts; what reaches the driver is bounded."""
    tuned(labelled.sparkSession)
    counts = (
        labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("text", "lang")
        .mapInArrow(count_trigrams, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("size"))
    shares = counts.join(sizes, "lang").withColumn("share", F.col("n") / F.col("size"))
    common = shares.where(F.col("share") >= MIN_SHARE)
    top = common.groupBy("gram").agg(F.max("share").alias("top"))
    kept = common.join(top, "gram").where(F.col("share") >= MIN_RELATIVE * F.col("top"))
    rows = kept.groupBy("lang").agg(F.first("size").alias("size"), F.collect_list("gram").alias("grams")).collect()
    grams = {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in rows}
    return SlicedBloom.build(sorted(grams), grams, {r["lang"]: r["size"] for r in rows})


def identify(docs: DataFrame, model: SlicedBloom) -> DataFrame:
    """(doc_id, lang_pred, score, n_grams) of each row of `docs` (doc_id, text).

    A null text, or one without a letter, gives `und` and 0; a text with no known trigram gives the language learned from most
    text and 0; ties go to the first name. Repeated rows and null ids are kept as they are; with nothing learned all is `und`.
    """
    spark = tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # bounded by MIN_SHARE

    def run(batches):
        for piece in pieces(batches):
            lang, score, n = shared.value.decide(_texts(piece))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())],
                ["doc_id", "lang_pred", "score", "n_grams"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def op5_language(docs: DataFrame) -> DataFrame:
    """The query: learn from the rows that are not held out, predict all."""
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_grams")
