"""The pipeline's stages: what goes, what stays, and that each works on what the one before has left."""

import corpus_pipeline
from fixtures import SF, awkward_docs
from sessionlens.llm.common import written


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, first = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    left = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = written(stage(spark, left, SF), name)
        before_ids = {r["doc_id"] for r in left.select("doc_id").collect()}
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert set(ids) <= before_ids and len(ids) == len(set(ids)) and ids
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "line_dedup":
            assert all(len(r["text"]) <= len(first[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in after.collect())
        left = after
    same = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert same == {r["doc_id"] for r in left.collect()}


def test_stages_take_awkward_and_no_rows(spark):
    docs = awkward_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        kept = stage(spark, docs, SF)
        assert kept.count() <= docs.count(), name


def test_near_duplicate_stage_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    sets = {}
    for i, text in texts.items():
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in text.split()]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert kept == {i for i in ids if root(i) == i} and len(kept) < len(ids)


def test_toxicity_stage_keeps_what_the_operator_does_not_predict(spark):
    from sessionlens.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in toxicity.op2_toxicity(docs, labels).where("predicted = 0").select("doc_id").collect()}


def test_leaks_go_whatever_their_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "nothing that any test has ever asked stands in this line of plain words"
    rows = [(None, item), (1, item), (1, clean), (None, clean), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_leaks(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(1, clean), (None, clean), (2, None)], key=str)
