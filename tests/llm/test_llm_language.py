"""Language filters against exact sets, and held-out accuracy."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from fixtures import SF
from sessionlens.llm import language
from sessionlens.llm.common import held_out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_trigrams(text):
    chars = [c if c.isalpha() else " " for c in " " + text.lower() + " "]
    return [tuple(map(ord, chars[k - 1 : k + 2])) for k in range(1, len(chars) - 1) if chars[k] != " "]


def packed(gram):
    return gram[0] << 42 | gram[1] << 21 | gram[2]


def test_trigrams_equal_a_plain_reading():
    texts = ["Ab c", "", "İé1x", "a", " \n", "ß-ß"]
    grams, owner = language.trigrams(texts)
    want = [(packed(g), i) for i, t in enumerate(texts) for g in plain_trigrams(t)]
    assert list(zip(grams.tolist(), owner.tolist())) == want


def test_filters_hold_the_exact_sets_and_little_else(docs):
    learned = docs.where(~held_out())
    model = language.learn(learned)
    counts = defaultdict(Counter)
    for r in learned.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").collect():
        counts[r["lang"]].update(map(packed, plain_trigrams(r["text"])))
    assert model.langs == sorted(counts) and model.langs[model.prior] == max(model.langs, key=lambda x: counts[x].total())
    share = {x: {g: n / c.total() for g, n in c.items()} for x, c in counts.items()}
    top = Counter()
    for x in share.values():
        top |= Counter(x)
    every = np.array(sorted(top), np.uint64)
    masks = model.masks(every)
    for k, lang in enumerate(model.langs):
        bits = (masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1) == 1
        holds = [share[lang].get(g, 0) >= max(language.MIN_SHARE, language.MIN_RELATIVE * top[g]) for g in every.tolist()]
        assert bits[holds].all(), lang
        others = ~np.array(holds)
        assert bits[others].mean() <= model.by_chance[k] + 0.02, lang


def test_more_languages_than_a_word_has_bits():
    langs = [f"l{k:03}" for k in range(130)]
    grams = {x: np.arange(100 * k, 100 * k + 100, dtype=np.uint64) for k, x in enumerate(langs)}
    model = language.SlicedBloom.build(langs, grams, {x: 100 for x in langs})
    for k in (0, 63, 64, 129):
        masks = model.masks(grams[langs[k]])
        assert ((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
        assert sum(bin(int(w)).count("1") for w in masks[:, 0]) < 8


def test_held_out_documents_get_their_language(docs):
    out = language.op5_language(docs)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 10 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
