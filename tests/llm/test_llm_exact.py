"""Operator 11 against groups made in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fixtures import DOC, SF, awkward_docs, clashing
from sessionlens.llm import exact

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each row, as a sorted list."""
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        stays = True
        for i in ids:
            out.append((i, best, len(ids), i == best and stays, hashlib.sha256(text.encode()).hexdigest()))
            stays = stays and i != best
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_awkward_rows_and_empty(spark):
    docs = awkward_docs(spark).union(spark.createDataFrame([(20, "ONE", "", "", 3), (None, "Two É", "", "", 5), (None, "two É", "", "", 5), (21, "two é", "", "", 5)], DOC))
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(exact.op11_exact(clashing(docs))) == want
    assert found(exact.op11_exact(docs.repartition(7))) == want
    assert exact.op11_exact(docs.limit(0)).count() == 0


def test_smallest_stays(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "A"), (None, "a"), (2, "b")], "doc_id long, text string")
    out = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.exact_groups(docs, keep="smallest").collect()}
    assert out == {(3, 1, False), (1, 1, True), (None, 1, False), (2, 2, True)}


@pytest.mark.parametrize("hold", [0, 500, exact.HOLD])
def test_colliding_hashes_and_spilled_subtrees(spark, hold):
    """With one hash for all texts the tries alone tell them apart, whatever has been spilled."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB") for _ in range(rng.choice((0, 1, 3, 9, 600)))) for _ in range(60)]
    texts += [t[:-1] + "x" for t in texts if len(t) == 600] + ["x" + t[1:] for t in texts if len(t) == 600]
    rows = [(rng.randrange(400), rng.choice(texts)) for _ in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = exact.exact_groups(docs, hashed=lambda sha: 0, hold=hold)
    want = {(i, k, n, s) for i, k, n, _, s in expected(rows)}
    got = out.collect()
    assert len(got) == len(rows) and {(r[0], r[1], r[2], r[4]) for r in got} == want
    assert out.where("kept").groupBy("text_sha256").count().where("count != 1").isEmpty()
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(exact.op11_exact(docs)) == expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_tries_hold_every_string_once():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice((0, 4, 9, 700)))) for _ in range(500)]
    tries = exact.Tries()
    owners = {s: tries.owner(s) for s in strings}
    assert all(tries.owner(s) is o for s, o in owners.items()) and len({id(o) for o in owners.values()}) == len(owners)
    heavy = max(tries.held, key=tries.held.get)
    some = dict(tries.spill(tries.total - 1))
    assert set(some) == {s for s in owners if len(s) == heavy}
    assert some | dict(tries.spill()) == owners and tries.total == 0


def test_common_text_moves_once_a_task(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text"))
    rows = docs.repartition(8).mapInArrow(exact._collapse(exact.content_hash, exact.HOLD), exact.COLLAPSED)
    assert rows.where("text = cast('hot text' as binary)").count() == 8
