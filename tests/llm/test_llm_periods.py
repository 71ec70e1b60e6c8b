"""Operator 13 against a search over all stretches and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fixtures import DOC, SF, awkward_docs, clashing, sentence
from sessionlens.llm import periods


def all_runs(words):
    """(start, length, period) of each maximal stretch, by comparing words under every lag."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(6, 4 * q) and not any(
                all(words[k] == words[k - d] for k in range(start + d, start + length)) for d in range(1, q)
            ):
                out.append((start, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def test_diagonals_equal_all_stretches():
    rng = random.Random(3)
    texts = []
    for _ in range(1500):
        words = [rng.choice("ab" if rng.random() < 0.5 else "abcde") for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            cycle = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words += (cycle * 12)[: rng.randint(1, 12 * len(cycle))] + [rng.choice("abcd") for _ in range(rng.randint(0, 4))]
        texts.append(words)
    edges = np.cumsum([0] + [len(t) for t in texts])
    numbers = np.array([edges[k] + t.index(w) for k, t in enumerate(texts) for w in t], np.int64)
    start, length, period = periods.diagonals(numbers, max(map(len, texts)))
    owner = np.searchsorted(edges, start, side="right") - 1
    got = [[] for _ in texts]
    for o, s, n, q in zip(owner, start, length, period):
        got[o].append((s - edges[o], n, q))
    assert got == [all_runs(t) for t in texts] and sum(map(len, got)) > 1000


def test_awkward_rows_and_empty(spark):
    docs = awkward_docs(spark).where("doc_id is null or doc_id not in (5, 6)").union(
        spark.createDataFrame([(30 + k, "a b c " * k + "a", None, None, 0) for k in range(40)] + [(99, "x " * 50_000, "", "", 0)], DOC)
    )
    want = sorted((expected(r["doc_id"], r["text"]) for r in docs.where("doc_id is null or doc_id != 99").collect()), key=str)
    assert found(periods.op13_periods(clashing(docs)).where("doc_id is null or doc_id != 99")) == want
    long = periods.op13_periods(docs).where("doc_id = 99").first()
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 50_000, 1, 50_000_000)
    assert periods.op13_periods(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000")
    assert found(periods.op13_periods(docs)) == sorted((expected(r["doc_id"], r["text"]) for r in docs.collect()), key=str)


def test_general_interface(spark):
    docs = spark.createDataFrame([(1, "w x y\tx y x y\nx y z")], "doc_id long, text string")
    row = periods.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 8, 2)] and row["collapsed"] == "w x y z" and row["n_words"] == 10


@pytest.mark.parametrize("n", [100_000])
def test_work_grows_with_the_words(n):
    """A text of one word, and one of a frequent word among others, stay linear up to the logarithm."""
    import time

    rng = random.Random(2)
    for words in (np.zeros(n, np.int64), np.array([0 if i % 2 else rng.randrange(1, n) for i in range(n)])):
        began = time.perf_counter()
        periods.diagonals(words, n)
        assert time.perf_counter() - began < 5
    assert sentence(rng)
