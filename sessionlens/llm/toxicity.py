"""Operator 2: toxic spans by a linear-chain conditional random field.

Documents carry labels, the field needs labelled tokens: a token of a toxic document is labelled toxic when its word is strongly
tied to toxic documents. The field has two states, with features of the word and of its neighbours; forward-backward
marginals give the offending offsets, and their aggregates, calibrated on the labels, the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import (
    TERM_BYTES, Members, bounds, held_out, pieces, signed, span_hashes, text_buffer, tokens, tuned, unsigned, written,
)
from sessionlens.llm.fingerprint import distinct

#: A word's tie to toxic documents is its smoothed log-odds, kept for words in this share of the toxic training texts at least;
#: that bounds the lexicon by the mean number of distinct words of a text / LEAST_SHARE.
LEAST_SHARE = 0.002
LEAST_TEXTS = 3
#: Log-odds from which a word counts as strongly tied, and the steps between the bins that are the field's features.
STRONG = 3.0
STEPS = (-1.0, 0.5, 1.0, 2.0, STRONG, 4.0, 5.0)
NEUTRAL = 1  # the bin of words without a known tie
#: All is learned from so many labelled documents at most, and the field from so many of their sentences; both are chosen by checksum.
#: Longer sentences are cut into chains of FIT_WORDS words for the fit (not for tagging).
FIT_SENTENCES, FIT_WORDS, FIT_DOCUMENTS = 6_000, 100, 20_000
PREDICT_AT, SPAN_AT = 0.3, 0.5
FLUSH = 2_000_000

OUT = "doc_id long, score double, predicted int, n_tokens long, n_spans int, spans string"


@dataclass
class Words:
    """Words of a piece: hashes, byte offsets, the document and the sentence of each."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    sentence: np.ndarray


_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?\n"]] = True


def words(column) -> Words:
    """Words by letters and digits in lower case; a sentence ends at a full stop, `!`, `?` or line end, or with its text."""
    data, offsets = text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, owner = tokens(data, offsets, TERM_BYTES)
    stops = np.cumsum(_STOPS[data]) if len(data) else np.zeros(0, np.int64)
    chain = stops[starts] + owner if len(starts) else starts
    sentence = np.zeros(len(starts), np.int64)
    if len(starts):
        np.cumsum(chain[1:] != chain[:-1], out=sentence[1:])
    return Words(span_hashes(data, starts, ends), starts, ends, owner, sentence)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial numbers of toxic and other texts by word."""
    held = np.zeros(0, np.uint64), np.zeros((0, 2))

    def out():
        return pa.RecordBatch.from_arrays([pa.array(signed(held[0])), pa.array(held[1][:, 0].astype(np.int64)), pa.array(held[1][:, 1].astype(np.int64))], ["word", "toxic", "other"])

    for piece in pieces(batches):
        w = words(piece.column("text"))
        owner, hashes = distinct(w.owner, w.hashes)
        toxic = piece.column("toxic").to_numpy(zero_copy_only=False)[owner] == 1
        both, at = np.unique(np.concatenate([held[0], hashes]), return_inverse=True)
        n = np.zeros((len(both), 2))
        for k, own in enumerate((toxic, ~toxic)):
            n[:, k] = np.bincount(at, np.concatenate([held[1][:, k], own]), len(both))
        held = both, n
        if len(both) > FLUSH:
            yield out()
            held = np.zeros(0, np.uint64), np.zeros((0, 2))
    yield out()


@dataclass
class Lexicon:
    members: Members
    odds: np.ndarray

    def bins(self, hashes: np.ndarray) -> np.ndarray:
        at = self.members.positions(hashes)
        out = np.full(len(hashes), NEUTRAL, np.int8)
        out[at >= 0] = np.digitize(self.odds[at[at >= 0]], STEPS)
        return out


def learn_words(labelled: DataFrame) -> Lexicon:
    """Smoothed log-odds of the words of labelled texts (text, toxic); equal texts count once."""
    sizes = labelled.agg(F.sum(F.col("toxic")).alias("toxic"), F.sum(1 - F.col("toxic")).alias("other")).first()
    toxic, other = float(sizes["toxic"] or 0), float(sizes["other"] or 0)
    counts = labelled.mapInArrow(count_words, "word long, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (other + 1))
    # half a standard error less, so that rare words need a clearer tie
    odds = odds - 0.5 * F.sqrt(1 / (F.col("t") + 0.5))
    known = counts.where(F.col("t") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)).select("word", odds.alias("odds"))
    rows = known.where((F.col("odds") >= STEPS[NEUTRAL]) | (F.col("odds") < STEPS[0])).toArrow()
    hashes, values = unsigned(rows.column("word").to_numpy()), rows.column("odds").to_numpy()
    return Lexicon(Members(hashes), values[np.argsort(hashes)])


# The field ------------------------------------------------------------------------------------------------------------

N_BINS = len(STEPS) + 1
#: Weights of the toxic state against the other: bias, bins of the word, the word before and after; then the transitions to stay
#: toxic, to enter and to leave it (staying clean is 0), and the start.
N_WEIGHTS = 1 + 3 * N_BINS + 4


def features(bins: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Columns of the active weights of each word."""
    before, after = np.full(len(bins), NEUTRAL), np.full(len(bins), NEUTRAL)
    same = sentence[1:] == sentence[:-1] if len(bins) else np.zeros(0, bool)
    before[1:] = np.where(same, bins[:-1], NEUTRAL)
    after[:-1] = np.where(same, bins[1:], NEUTRAL)
    return np.stack([np.zeros(len(bins), int), 1 + bins, 1 + N_BINS + before, 1 + 2 * N_BINS + after], 1)


def _by_step(sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All chains side by side, longest first: where each word stands when words are ordered by step and chain, where the words of
    each step begin, and how many chains reach it."""
    n = int(sentence[-1]) + 1 if len(sentence) else 0
    edges = bounds(sentence, n)
    lengths = np.diff(edges)
    order = np.argsort(-lengths, kind="stable")
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    step = np.arange(len(sentence)) - edges[sentence]
    reach = n - np.searchsorted(np.sort(lengths), np.arange(1, lengths.max(initial=0) + 1))
    first = np.concatenate([[0], np.cumsum(reach)]).astype(np.int64)
    return first[step] + row[sentence], first, reach


def marginals(emission: np.ndarray, sentence: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Forward-backward over all sentences at once, carried as the odds of the toxic state: its chance by word."""
    stay, enter, leave, start = np.exp(weights[-4:])
    at, first, reach = _by_step(sentence)
    gain = np.empty(len(emission))
    gain[at] = np.exp(np.clip(emission, -50, 50))
    forward, backward = np.empty(len(emission)), np.ones(len(emission))
    for t, n in enumerate(reach):
        now = slice(first[t], first[t] + n)
        if t == 0:
            forward[now] = gain[now] * start
        else:
            odds = forward[first[t - 1] : first[t - 1] + n]
            forward[now] = gain[now] * (enter + stay * odds) / (1 + leave * odds)
    for t in range(len(reach) - 2, -1, -1):
        after = slice(first[t + 1], first[t + 1] + reach[t + 1])
        odds = backward[after] * gain[after]
        backward[first[t] : first[t] + reach[t + 1]] = (leave + stay * odds) / (1 + enter * odds)
    odds = forward * backward
    return (odds / (1 + odds))[at]


def expectations(emission: np.ndarray, sentence: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fitting, in log space: chances by word, and expected transitions (stay toxic, enter, leave) and toxic starts."""
    stay, enter, leave, start = weights[-4:]
    at, first, reach = _by_step(sentence)
    score = np.empty(len(emission))
    score[at] = emission
    fc, ft, bc, bt = (np.zeros(len(emission)) for _ in range(4))  # forward and backward: clean, toxic
    steps = [slice(first[t], first[t] + n) for t, n in enumerate(reach)]
    before = [slice(first[t - 1], first[t - 1] + n) for t, n in enumerate(reach)]  # the same chains a step earlier
    for t, now in enumerate(steps):
        if t == 0:
            ft[now] = score[now] + start
        else:
            was = before[t]
            fc[now] = np.logaddexp(fc[was], ft[was] + leave)
            ft[now] = np.logaddexp(fc[was] + enter, ft[was] + stay) + score[now]
    for t in range(len(reach) - 1, 0, -1):
        now, was = steps[t], before[t]
        toxic = bt[now] + score[now]
        bc[was] = np.logaddexp(bc[now], toxic + enter)
        bt[was] = np.logaddexp(bc[now] + leave, toxic + stay)
    chance = 1 / (1 + np.exp(np.clip((fc + bc) - (ft + bt), -500, 500)))
    expected = np.zeros(4)
    if len(reach):
        total = np.logaddexp(fc[steps[0]] + bc[steps[0]], ft[steps[0]] + bt[steps[0]])
        expected[3] = chance[steps[0]].sum()
        for t in range(1, len(reach)):
            now, was, whole = steps[t], before[t], total[: reach[t]]
            toxic = score[now] + bt[now] - whole
            expected[0] += np.exp(ft[was] + stay + toxic).sum()
            expected[1] += np.exp(fc[was] + enter + toxic).sum()
            expected[2] += np.exp(ft[was] + leave + bc[now] - whole).sum()
    return chance[at], expected


def fit_field(bins: np.ndarray, sentence: np.ndarray, state: np.ndarray, rounds: int = 150, ridge: float = 1.0) -> np.ndarray:
    """Weights by gradient ascent (Adam) on the penalised likelihood of labelled sentences."""
    weights, first, second = np.zeros(N_WEIGHTS), np.zeros(N_WEIGHTS), np.zeros(N_WEIGHTS)
    if not len(bins):
        weights[0] = -20.0  # nothing to learn from: nothing is toxic
        return weights
    columns = features(bins, sentence)
    same = sentence[1:] == sentence[:-1]
    seen = np.zeros(N_WEIGHTS)
    np.add.at(seen, columns, state[:, None].astype(float))
    a, b = state[:-1][same], state[1:][same]
    starts = np.concatenate([[True], ~same])
    seen[-4:] = (a & b).sum(), (~a & b).sum(), (a & ~b).sum(), state[starts].sum()
    for k in range(1, rounds + 1):
        chance, expected = expectations(weights[columns].sum(1), sentence, weights)
        slope = seen - np.bincount(columns.ravel(), np.repeat(chance, columns.shape[1]), N_WEIGHTS)
        slope[-4:] = seen[-4:] - expected
        slope -= ridge * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights = weights + 0.15 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    return weights


@dataclass
class Tagger:
    lexicon: Lexicon
    weights: np.ndarray
    scale: np.ndarray  # calibration of a document's aggregates

    def tag(self, w: Words) -> np.ndarray:
        bins, own = self.lexicon.bins(w.hashes), self.weights
        emission = (own[0] + own[1 : 1 + N_BINS])[bins]
        same = w.sentence[1:] == w.sentence[:-1]
        before, after = own[1 + N_BINS : 1 + 2 * N_BINS], own[1 + 2 * N_BINS : 1 + 3 * N_BINS]
        emission[1:] += before[np.where(same, bins[:-1], NEUTRAL)]
        emission[:-1] += after[np.where(same, bins[1:], NEUTRAL)]
        if len(emission):
            emission[0] += before[NEUTRAL]
            emission[-1] += after[NEUTRAL]
        return marginals(emission, w.sentence, own)

    def score(self, aggregates: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(aggregates @ self.scale, -30, 30)))


def aggregates(chance: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """By document: 1, the chance that any word is toxic, the highest marginal, log of the expected number, and its share."""
    edges = bounds(owner, n)
    length = np.diff(edges)
    running = np.concatenate([[0.0], np.cumsum(chance)])
    none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(chance, 1 - 1e-9)))])
    total = np.maximum(0, running[edges[1:]] - running[edges[:-1]])
    top = np.zeros(n)
    if len(chance):
        some = length > 0
        top[some] = np.maximum.reduceat(chance, edges[:-1][some])
    any_toxic = 1 - np.exp(np.minimum(0, none[edges[1:]] - none[edges[:-1]]))
    return np.stack([np.ones(n), any_toxic, top, np.log1p(total), 10 * total / np.maximum(length, 10)], 1)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights by Newton's steps."""
    w = np.zeros(x.shape[1])
    if not len(x):
        w[0], w[2] = -4.0, 4.0
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return w


def learn(labelled: DataFrame) -> Tagger:
    """A tagger from (text, toxic) rows. Rows with a null text or label are left out, equal texts count once (toxic if any is)."""
    spark = tuned(labelled.sparkSession)
    rows = (
        labelled.where(F.col("text").isNotNull() & F.col("toxic").isNotNull())
        .withColumn("digest", F.xxhash64("text"))
    )
    # one row of equal texts, without moving the texts: the first by id among equal digests
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").cast("int").alias("toxic"))
    texts = rows.drop("toxic", "digest").join(first.drop("digest"), "doc_id").select("text", "toxic")
    lexicon = learn_words(texts)
    shared = spark.sparkContext.broadcast(lexicon)  # bounded by LEAST_SHARE

    def sentences(batches):
        """Bins and labels of sentences: all that hold a word with a tie, and a few of the others."""
        for piece in pieces(batches):
            w = words(piece.column("text"))
            bins = shared.value.bins(w.hashes)
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False)[w.owner] == 1
            state = toxic & (bins > STEPS.index(STRONG))
            n = int(w.sentence[-1]) + 1 if len(w.sentence) else 0
            place = np.arange(len(w.sentence)) - bounds(w.sentence, n)[w.sentence]
            cut = np.flatnonzero(place % FIT_WORDS == 0)
            n, edges = len(cut), np.append(cut, len(place))
            tied = np.bincount(np.repeat(np.arange(n), np.diff(edges)), bins != NEUTRAL, n) > 0
            chosen = np.flatnonzero(tied | (w.hashes[edges[:-1]] % np.uint64(16) == 0)) if n else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bins[edges[i] : edges[i + 1]].astype(np.int8).tobytes() for i in chosen], pa.binary()),
                    pa.array([state[edges[i] : edges[i + 1]].tobytes() for i in chosen], pa.binary()),
                ],
                ["bins", "state"],
            )

    sample = (
        texts.mapInArrow(sentences, "bins binary, state binary")
        .orderBy(F.xxhash64("bins", "state"), "bins", "state").limit(FIT_SENTENCES).toArrow()
    )
    bins = [np.frombuffer(x, np.int8) for x in sample.column("bins").to_pylist()]
    state = [np.frombuffer(x, bool) for x in sample.column("state").to_pylist()]
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    empty = np.zeros(0, np.int8)
    weights = fit_field(np.concatenate([empty, *bins]), number, np.concatenate([empty, *state]).astype(bool))
    tagger = Tagger(lexicon, weights, np.zeros(5))
    shared_tagger = spark.sparkContext.broadcast(tagger)

    def summaries(batches):
        for piece in pieces(batches):
            w = words(piece.column("text"))
            x = aggregates(shared_tagger.value.tag(w), w.owner, piece.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T] + [piece.column("toxic")], [*"abcde", "toxic"])

    fields = "a double, b double, c double, d double, e double"
    sample = texts.mapInArrow(summaries, f"{fields}, toxic int").limit(FIT_DOCUMENTS).toArrow()
    x = np.stack([sample.column(c).to_numpy() for c in "abcde"], 1)
    return Tagger(lexicon, weights, calibrate(x, sample.column("toxic").to_numpy().astype(float)))


def offsets_of(chance: np.ndarray, w: Words, column) -> list[str]:
    """Toxic spans of each text as start:end in code points, neighbouring words joined."""
    out = [""] * len(column)
    hot = np.flatnonzero(chance >= SPAN_AT)
    if not len(hot):
        return out
    data, offsets = text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    new = np.ones(len(hot), bool)
    new[1:] = (hot[1:] != hot[:-1] + 1) | (w.sentence[hot[1:]] != w.sentence[hot[:-1]])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(hot)) - 1
    for a, b in zip(hot[firsts], hot[lasts]):
        doc, base = w.owner[a], points[offsets[w.owner[a]]]
        out[doc] += f"{',' if out[doc] else ''}{points[w.starts[a]] - base}:{points[w.ends[b]] - base}"
    return out


def tag_documents(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, score, predicted, n_tokens, n_spans, spans) of each row of `docs` (doc_id, text); spans are code points of the
    lower-cased text, which lie as in the text but for the few characters whose lower case is longer.

    A null or empty text has the score of a text without toxic words, and no span. Rows are kept one by one, repeated or not;
    with nothing learned all scores are near 0.
    """
    spark = tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(tagger)

    def run(batches):
        for piece in pieces(batches):
            column = piece.column("text")
            w = words(column)
            chance = shared.value.tag(w)
            score = shared.value.score(aggregates(chance, w.owner, piece.num_rows))
            spans = offsets_of(chance, w, column)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32)),
                    pa.array(np.bincount(w.owner, minlength=piece.num_rows).astype(np.int64)),
                    pa.array([s.count(":") for s in spans], pa.int32()), pa.array(spans, pa.string()),
                ],
                ["doc_id", "score", "predicted", "n_tokens", "n_spans", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def without_toxic(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The rows of `docs` (any columns, with text) that `tag_documents` does not predict to be toxic."""
    spark = tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(tagger)

    def run(batches):
        for piece in pieces(batches):
            w = words(piece.column("text"))
            chance = shared.value.tag(w)
            score = shared.value.score(aggregates(chance, w.owner, piece.num_rows))
            yield piece.filter(pa.array(score < PREDICT_AT))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, text, toxic) of at most `most` labelled documents that are not held out, chosen by a checksum of the id; several labels
    of one document count as toxic if any is. So few ids are sent to all tasks, and the other texts stay where they are."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.join(F.broadcast(chosen), "doc_id"), "training")


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return tag_documents(docs, learn(training_rows(docs, labels))).withColumn("held_out", held_out())
