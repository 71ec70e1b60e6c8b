"""Every operator on awkward rows, on an empty table and beside clashing columns: the results that the docstrings define."""

import pytest
from pyspark.sql import functions as F

from fixtures import DOC, awkward_docs, clashing
from sessionlens.llm import decontaminate, fingerprint, html, language, lines, minhash, mixing, pii, suffix, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def labels(spark, rows=((1, 0, 0), (2, 1, 1), (None, 1, 1), (7, None, None), (7, 1, 0), (7, 1, 1))):
    return spark.createDataFrame(list(rows), LABELS)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_toxicity_rows_and_empty(spark, docs, empty):
    out = toxicity.op2_toxicity(clashing(docs), labels(spark))
    assert out.count() == docs.count()
    assert out.where("score < 0 or score > 1 or predicted != cast(score >= 0.3 as int)").isEmpty()
    found = by_id(out)
    assert found[3]["score"] == found[4]["score"] and found[3]["n_spans"] == 0
    assert toxicity.op2_toxicity(empty, labels(spark)).count() == 0
    nothing = toxicity.op2_toxicity(docs, labels(spark, []))
    assert nothing.agg(F.max("score")).first()[0] < 0.3
    assert toxicity.without_toxic(clashing(docs), toxicity.learn(toxicity.training_rows(docs, labels(spark, [])))).count() == docs.count()


def test_language_rows_and_empty(spark, docs, empty):
    out = language.op5_language(clashing(docs))
    found = by_id(out)
    assert out.count() == docs.count()
    assert found[3]["lang_pred"] == found[4]["lang_pred"] == found[9]["lang_pred"] == "und" and found[4]["score"] == 0
    assert {found[1]["lang_pred"], found[5]["lang_pred"]} <= {"en", "de", "fr"}
    assert language.op5_language(empty).count() == 0
    assert {r[0] for r in language.op5_language(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").collect()} == {"und"}


def test_bytes_of_tables_with_the_new_columns(spark, docs):
    named = docs.withColumns({c: F.lit("x") for c in ("n_bytes", "n_removed", "n_spans", "kept")})
    out = suffix.dedup_bytes(named)
    assert sorted(out.columns) == sorted([*(c for c in docs.columns if c != "text"), "n_bytes", "n_removed", "n_spans", "kept"])
    assert out.agg(F.sum("n_bytes")).first()[0] == docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_bytes_rows_and_empty(spark, docs, empty):
    out = suffix.op4_suffix(clashing(docs)).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_removed"] for r in by[1]] == [0]
    assert all(r["n_removed"] == r["n_bytes"] > 0 for r in by[2]) and len(by[2]) == 2  # both rows of the id, for document 1's sake
    assert {r["n_removed"] for r in by[None]} == {0} and by[11][0]["n_removed"] == 0 and by[12][0]["n_removed"] >= 200
    assert by[6][0]["n_removed"] > 100_000 and by[6][0]["n_spans"] == 1
    assert by[3][0]["n_bytes"] == by[4][0]["n_bytes"] == 0
    assert suffix.op4_suffix(empty).count() == 0


def test_near_duplicate_rows_and_empty(spark, docs, empty):
    out = minhash.near_duplicates(clashing(docs)).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert len(out) == docs.count()
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert by[6]["component_id"] == 5 and by[8]["component_id"] == 7
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == by[9]["n_shingles"] == 0 and by[4]["component_id"] == 4
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert minhash.near_duplicates(empty).count() == 0


def test_line_rows_and_empty(spark, docs, empty):
    out = lines.dedup_lines(clashing(docs))
    assert set(out.columns) == {*clashing(docs).columns, "n_units", "n_removed"}
    found = {}
    for r in out.collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert found[1][0]["n_removed"] == 0
    assert [r["text"] for r in found[2]] == ["", ""]
    assert {r["n_removed"] for r in found[None]} == {0}
    assert found[3][0]["text"] is None and found[9][0]["text"] == " \n\t " and found[9][0]["n_units"] == 0
    assert found[10][0]["text"] == "\U0001F600 é ß İ 😀 end."
    assert lines.dedup_lines(empty).count() == 0


def test_leaks_rows_and_empty(spark, docs, empty):
    text = docs.where("doc_id = 1").first()["text"]
    items = benchmark(spark, [(1, text[:300]), (2, text[:300]), (3, None), (None, text), (4, ""), (5, "...")])
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(clashing(docs), items).collect()}
    assert {(1, 1), (1, 2), (2, 1), (None, 1)} <= found and {i for _, i in found} == {1, 2}
    assert decontaminate.leaks(docs, benchmark(spark, [])).count() == 0
    assert decontaminate.leaks(empty, items).count() == 0


def test_mixing_rows_and_empty(spark, docs, empty):
    out = mixing.mix(clashing(docs))
    assert out.count() == docs.count() and out.where("probability is null or probability < 0 or probability > 1").isEmpty()
    assert out.where("text is null and n_tokens != 0").isEmpty()
    assert mixing.mix(empty).count() == 0


def test_fingerprint_rows_and_empty(spark, docs, empty):
    out = fingerprint.op10_fingerprint(clashing(docs))
    rows = out.collect()
    assert len(rows) == docs.count()
    one, two = ([r for r in rows if r["doc_id"] == i] for i in (1, 2))
    assert {r["fingerprint"] for r in one + two} == {one[0]["fingerprint"]} and one[0]["near_next"] == 1.0
    assert out.where("near_edited < 0 or near_edited > 1 or near_next < 0 or near_next > 1").isEmpty()
    assert fingerprint.op10_fingerprint(empty).count() == 0
    alone = fingerprint.op10_fingerprint(docs.where("doc_id = 7")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 3


def test_pii_rows_and_empty(spark, docs, empty):
    out = pii.op3_pii(clashing(docs))
    assert out.count() == docs.count() and by_id(out)[3]["spans"] == ""
    assert pii.op3_pii(empty).count() == 0


def test_html_rows_and_empty(spark):
    pages = [(1, "u", "<p>a<p>b"), (1, "u", "<p>a<p>b"), (2, "u", None), (3, "u", ""), (None, None, "x"), (4, "u", "<div>" * 5000 + "deep"), (5, "u", "<" * 2000 + "a" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    rows = html.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["text"][:6]) for r in rows) == [(0, "x"), (1, "a\n\nb"), (1, "a\n\nb"), (2, ""), (3, ""), (4, "deep"), (5, "<<<<<<")]
    assert html.extract(df.limit(0)).count() == 0
