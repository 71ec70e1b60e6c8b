"""Tables with every awkward row: nulls in each column, empty and very long texts, equal rows, equal ids, clashing column names."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def sentence(rng, n=9):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


def awkward_docs(spark):
    rng = random.Random(4)
    text = "\n".join(sentence(rng) for _ in range(12))
    long = " ".join(sentence(rng, 12) for _ in range(2500))
    rows = [
        (1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (None, text, "en", "b"),
        (None, None, None, None), (5, long, "de", "a"), (6, long[:-200] + " other end", "de", "a"), (7, "one", "fr", "b"), (8, "one", "fr", "b"),
        (9, " \n\t ", "en", "b"), (10, "\U0001F600 é ß İ 😀 end.", "en", "b"), (11, "x" * 70_000, "en", "b"), (12, "a" * 60 + " " + text[:200], "en", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOC)


def clashing(docs):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("row", "digest", "key", "part", "extra", "anchors", "seen", "kept", "component", "found", "share", "toxic"):
        docs = docs.withColumn(name, F.lit(name))
    return docs
