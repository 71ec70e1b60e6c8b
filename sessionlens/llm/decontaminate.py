"""Operator 1: benchmark decontamination by passages against a BM25 index of test items.

The index holds the test items in blocks of like length, with the largest impact of every term by block. Every passage of every
document is a query. As in block-max WAND a block is opened only where the sum of its terms' largest impacts can reach the
threshold, and only terms that a match cannot do without start the search; what is opened is scored exactly. Hits are
verified by the overlap of the item's question and answer with the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import TERM_BYTES, Members, bounds, pieces, signed, span_hashes, text_buffer, tokens, tuned, written
from sessionlens.llm.fingerprint import distinct

K1, B = 1.2, 0.75
#: An item is retrieved when a passage scores this part of what the item's own text scores.
THRESHOLD = 0.6
#: Share of the question's and of the answer's word n-grams that the passage must hold.
OVERLAP = 0.7
NGRAM = 3
BLOCK = 32
#: Items of one index; more make further indexes, each applied to all documents.
SHARD_ITEMS = 20_000
#: Passages are at least so many words, twice the longest item of the index otherwise, and overlap by half.
PASSAGE = 64

OUT = (
    "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word_start int, word_end int"
)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's question, up to its last question mark, else its sentences but the last; the rest is the answer (may be empty)."""
    text = text.strip()
    mark = text.rfind("?")
    if mark >= 0:
        return text[: mark + 1], text[mark + 1 :]
    ends = [m.end() for m in re.finditer(r"[.!]+(?=\s)", text)]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    data, offsets = text_buffer(pc.utf8_lower(column))
    starts, ends, owner = tokens(data, offsets, TERM_BYTES)
    return span_hashes(data, starts, ends), owner


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-grams of words, or of all words together if they are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return np.unique(out)


@dataclass
class Statistics:
    """Items with a word, their words, the longest one's, and the number of items with each of an index's terms."""

    items: int
    words: int
    longest: int
    df: np.ndarray


@dataclass
class Index:
    """Postings of normalised impacts (an item's own text scores 1), by term and then item; items are in order of length."""

    items: np.ndarray  # ids
    terms: Members
    first: np.ndarray  # postings of each term begin here
    item: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray  # the same for (block, largest impact, whether the term is essential in the block)
    block: np.ndarray
    block_impact: np.ndarray
    essential: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]  # n-grams of question and answer
    passage: int

    @classmethod
    def build(cls, ids: list[int], texts: list[str], threshold: float = THRESHOLD, over: Statistics | None = None) -> Index:
        """Items without a word can match nothing and are left out. `over` has the statistics of all items, if these are not all."""
        hashes, owner = _words(texts)
        lengths = np.bincount(owner, minlength=len(texts))
        order = [i for i in np.lexsort((np.array(ids, np.int64), lengths)) if lengths[i]]
        place = np.full(len(texts), -1)
        place[order] = np.arange(len(order))
        n = len(order)
        terms = Members(np.unique(hashes))
        at = terms.positions(hashes)
        pair, tf = np.unique(at * max(n, 1) + place[owner], return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        length = lengths[order].astype(float)
        if over is None:
            over = Statistics(n, int(length.sum()), int(lengths.max(initial=0)), np.bincount(term, minlength=len(terms.keys)))
        idf = np.log1p((over.items - over.df + 0.5) / (over.df + 0.5))
        mean = over.words / max(over.items, 1)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(mean, 1e-9) if n else 1))
        impact = weight / np.bincount(item, weight, n)[item]
        block_of = item // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block_of[1:] != block_of[:-1])
        at_new = np.flatnonzero(new)
        block, block_term = block_of[at_new], term[at_new]
        top = np.maximum.reduceat(impact, at_new) if n else impact
        # within a block the weakest terms that cannot reach the threshold together are not essential
        essential = np.ones(len(block), bool)
        by = np.lexsort((top, block))
        running = np.cumsum(top[by])
        starts = bounds(block[by], int(block.max(initial=-1)) + 1)[:-1]
        base = np.concatenate([[0.0], running])[starts]
        essential[by] = running - base[block[by]] >= threshold - 1e-9
        parts = []
        for i in order:
            parts.append(tuple(grams(_words([x])[0], NGRAM) for x in question_and_answer(texts[i])))
        edges = lambda groups: bounds(groups, len(terms.keys))
        return cls(
            np.array([ids[i] for i in order], np.int64), terms, edges(term), item, impact, edges(block_term), block, top, essential,
            parts, max(PASSAGE, 2 * over.longest),
        )

    def passages(self, words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end word and document of the passages: windows that overlap by half, the last one ending with the text."""
        edges = bounds(owner, n)
        step = self.passage // 2
        count = np.maximum(1, -(-(np.diff(edges) - self.passage) // step) + 1) * (np.diff(edges) > 0)
        doc = np.repeat(np.arange(n), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = edges[doc] + k * step
        return start, np.minimum(start + self.passage, edges[doc + 1]), doc

    def search(self, words: np.ndarray, owner: np.ndarray, n: int, threshold: float = THRESHOLD):
        """All (first word, end word, document, item, score) whose score reaches the threshold."""
        none = np.zeros(0, np.int64)
        if not len(self.items) or not len(words):
            return none, none, none, none, np.zeros(0)
        at = self.terms.positions(words)
        known = np.flatnonzero(at >= 0)
        start, end, doc = self.passages(words, owner, n)
        # essential terms of any block, by passage: words lie in two passages at most
        blocks = np.zeros(len(self.block), np.int64)
        blocks[:] = self.essential
        essential_of = np.add.reduceat(blocks, self.block_first[:-1]) if len(blocks) else blocks
        hot = known[essential_of[at[known]] > 0]
        running = np.zeros(len(words) + 1, np.int64)
        np.add.at(running, hot + 1, 1)
        running = np.cumsum(running)
        live = np.flatnonzero(running[end] > running[start])
        # the largest score that any block allows, by summing the terms' largest impacts: no pivot, no search
        term_top = np.maximum.reduceat(self.block_impact, self.block_first[:-1])
        value = np.zeros(len(words) + 1)
        value[known + 1] = term_top[at[known]]
        value = np.cumsum(value)
        live = live[value[end[live]] - value[start[live]] >= threshold - 1e-6]
        if not len(live):
            return none, none, none, none, np.zeros(0)
        # distinct terms of the passages that are left
        size = end[live] - start[live]
        which = np.repeat(np.arange(len(live)), size)
        word = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[live][which]
        keep = at[word] >= 0
        which, term = distinct(which[keep], at[word[keep]])
        # sums of block maxima
        reps = np.diff(self.block_first)[term]
        p = np.repeat(which, reps)
        entry = np.arange(len(p)) - np.repeat(np.cumsum(reps) - reps, reps) + self.block_first[term].repeat(reps)
        n_blocks = int(self.block.max()) + 1
        cell, inverse = np.unique(p * n_blocks + self.block[entry], return_inverse=True)
        bound = np.bincount(inverse, self.block_impact[entry], len(cell))
        pivot = np.bincount(inverse, self.essential[entry], len(cell)) > 0
        opened = cell[(bound >= threshold - 1e-6) & pivot]
        if not len(opened):
            return none, none, none, none, np.zeros(0)
        # exact scores in the opened blocks
        reps = np.diff(self.first)[term]
        p = np.repeat(which, reps)
        entry = np.arange(len(p)) - np.repeat(np.cumsum(reps) - reps, reps) + self.first[term].repeat(reps)
        at_cell = p * n_blocks + self.item[entry] // BLOCK
        inside = opened[np.minimum(np.searchsorted(opened, at_cell), len(opened) - 1)] == at_cell
        p, entry = p[inside], entry[inside]
        cell, inverse = np.unique(p * len(self.items) + self.item[entry], return_inverse=True)
        score = np.bincount(inverse, self.impact[entry], len(cell))
        good = score >= threshold - 1e-9
        p, item = live[cell[good] // len(self.items)], cell[good] % len(self.items)
        return start[p], end[p], doc[p], item, score[good]

    def verified(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's and the answer's n-grams among a passage's words; an item without an answer has 1 for it."""
        out = []
        for part in self.parts[item]:
            if not len(part):
                out.append(1.0)
                continue
            held: set[int] = set()
            for n in range(1, NGRAM + 1):  # short parts are hashed as a whole
                held.update(grams(words, n).tolist())
            out.append(sum(g in held for g in part.tolist()) / len(part))
        return out[0], out[1]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item, and its number of words beside a null term."""
    for piece in pieces(batches):
        hashes, owner = _words(piece.column("text"))
        _, terms = distinct(owner, hashes)
        lengths = np.bincount(owner, minlength=piece.num_rows)
        lengths = lengths[lengths > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(signed(terms)), pa.nulls(len(lengths), pa.int64())]),
             pa.concat_arrays([pa.nulls(len(terms), pa.int64()), pa.array(lengths.astype(np.int64))])],
            ["term", "words"],
        )


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of at most SHARD_ITEMS items in the order of their ids, read one after the other. Where there are several, document
    frequencies, mean length and longest item are counted over all items first, so that scores do not depend on the shards."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted, ids, texts = None, [], []

    def over() -> Statistics:
        nonlocal counted
        if counted is None:
            told = written(items.select("text").mapInArrow(_item_terms, "term long, words long"), "item-terms")
            sizes = told.where("term is null").agg(F.count("*"), F.sum("words"), F.max("words")).first()
            counted = sizes, written(told.where("term is not null").groupBy("term").agg(F.count("*").alias("df")), "frequencies")
        sizes, frequencies = counted
        terms = np.unique(_words(texts)[0])
        own = spark.createDataFrame(pa.table({"term": pa.array(signed(terms))}))
        known = {r["term"]: r["df"] for r in frequencies.join(own, "term").collect()}  # the shard's terms
        return Statistics(sizes[0], sizes[1] or 0, sizes[2] or 0, np.array([known[t] for t in signed(terms).tolist()], np.int64))

    first = True
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if len(ids) == SHARD_ITEMS:
            yield Index.build(ids, texts, over=over())
            first, ids, texts = False, [], []
        ids.append(r[0])
        texts.append(r[1])
    if ids:
        yield Index.build(ids, texts, over=None if first else over())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document (doc_id, text) and test item (item_id, text) that it leaks: the best passage's score, the
    overlaps of question and answer, and the passage's words [word_start, word_end).

    Both overlaps must reach OVERLAP. Null and empty texts leak nothing, items without a word or an id are never found; of repeated
    rows with one id the best is returned once; an empty benchmark gives no row.
    """
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for index in _indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)  # bounded by SHARD_ITEMS

        def run(batches, shared=shared):
            index = shared.value
            for piece in pieces(batches):
                words, owner = _words(piece.column("text"))
                edges = bounds(owner, piece.num_rows)
                ids = piece.column("doc_id").to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                for start, end, doc, item, score in zip(*[x.tolist() for x in index.search(words, owner, piece.num_rows)]):
                    question, answer = index.verified(words[start:end], item)
                    if min(question, answer) >= OVERLAP:
                        row = score, question, answer, start - int(edges[doc]), end - int(edges[doc])
                        best[doc, item] = max(best.get((doc, item), row), row)
                out = [(ids[d], int(index.items[i]), *row) for (d, i), row in best.items()]
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(COLUMNS, x)) for x in out], SCHEMA)

        part = rows.mapInArrow(run, OUT)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], OUT)
    best = F.max_by(F.struct("question_overlap", "answer_overlap", "word_start", "word_end"), F.struct("score", "question_overlap", "answer_overlap", "word_start"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best.alias("at")).select("doc_id", "item_id", "score", "at.*")


COLUMNS = [x.split()[0] for x in OUT.split(", ")]
SCHEMA = pa.schema(list(zip(COLUMNS, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()])))


def op1_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
