"""Operator 9: mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic; the cells' inclusion probabilities are raked until the expected
tokens meet the targets of all three marginals, and documents are sampled by their cell's probability. DataFrame functions only.
What a value cannot hold of its target is shared out among the others first, so the registered query meets its targets.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionlens.llm.common import written

DIMENSIONS = ("source", "lang", "topic")
#: Where no targets are given, shares of tokens are flattened by these powers.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Part of all tokens to keep, and rounds of raking in the query's SQL.
BUDGET = 0.5
ROUNDS = 12
#: Targets are met when no value is off by more than this part of what it should get; so many rounds are tried at most.
TOLERANCE, MOST_ROUNDS = 1e-4, 100
NONE = "(none)"
#: Digits of the sampling hash, a number below 16 ** HASH_DIGITS.
HASH_DIGITS = 12
SALT = "mix"


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit("[^ \\t\\r\\n]+"), 0)), F.lit(0)).cast("long")


def topic(text: str = "text", tokens: str = "n_tokens") -> Column:
    """A coarse topic from the text's form: legal notices, tables, noise, brief texts, prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda signs: F.length(t) - F.length(F.translate(t, signs, ""))
    return (
        F.when(F.contains(F.lower(t), F.lit("license")), "legal")
        .when(without("|") * 50 > F.length(t), "tabular")
        .when(without("%*&$#") * 20 > F.length(t), "noisy")
        .when(F.col(tokens) < 50, "brief")
        .otherwise("prose")
    )


def draw(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) fixed by the id."""
    digits = F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """`cells` (source, lang, topic, tokens) with the probability of each cell.

    A round scales the cells to the targets of each dimension in turn, then cuts probabilities at 1. `targets` gives shares by dimension
    and value (values not named there get nothing); dimensions without are flattened shares. Cells without tokens keep the
    budget as probability.
    """
    wanted = {}
    for d in DIMENSIONS:
        given = (targets or {}).get(d)
        by = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("have"))
        if given:
            share = F.coalesce(F.create_map(*[F.lit(x) for pair in given.items() for x in pair])[F.col(d)], F.lit(0.0))
        else:
            share = F.pow("have", F.lit(FLATTEN[d]))
        by = by.withColumn("share", F.when(F.col("have") > 0, share).otherwise(0.0))
        # one row of sums enters as a scalar subquery, not as a join
        total = by.agg(F.sum("share")).scalar()
        have = by.agg(F.sum("have")).scalar()
        wanted[d] = written(by.select(d, (F.col("share") / total * have * budget).alias("want")), f"targets-{d}")
    now = written(cells.withColumn("probability", F.lit(budget)), "cells")
    for _ in range(rounds):
        for d in DIMENSIONS:
            got = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")).alias("got")).join(wanted[d], d)
            factor = got.select(d, F.when(F.col("got") > 0, F.col("want") / F.col("got")).otherwise(1.0).alias("factor"))
            now = now.join(factor, d).withColumn("probability", F.col("probability") * F.col("factor")).drop("factor")
        now = written(now.withColumn("probability", F.least(F.lit(1.0), F.col("probability"))), "cells")
    return now


def attainable(cells: DataFrame, dimension: str, shares: Mapping[str, float] | None, budget: float) -> DataFrame:
    """(value, want) of a dimension: tokens by share, at most what a value holds; what is over goes to the others by their shares."""
    by = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("have"))
    if shares:
        share = F.coalesce(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("value")].cast("double"), F.lit(0.0))
    else:
        share = F.pow("have", F.lit(FLATTEN[dimension]))
    by = written(by.withColumn("share", F.when(F.col("have") > 0, share).otherwise(0.0)), f"shares-{dimension}")
    level, full = 0.0, F.col("have") <= F.col("share") * F.lit(0.0)
    while True:  # the level only rises, and each turn but the last fills a value
        total, held, left = by.agg(F.sum("have"), F.sum(F.when(full, F.col("have"))), F.sum(F.when(~full, F.col("share")))).first()
        if not left:  # every value with a share is full
            return by.select("value", F.when(F.col("share") > 0, F.col("have")).otherwise(0.0).alias("want"))
        rises = (total * budget - (held or 0.0)) / left
        if rises <= level:
            return by.select("value", F.least(F.col("have"), F.col("share") * level).alias("want"))
        level, full = rises, F.col("have") <= F.col("share") * rises


def meet(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET,
         tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> tuple[DataFrame, list]:
    """`cells` (source, lang, topic, tokens) with the probability of each cell, and what was missed: rows (dimension, value, want, got).

    A cell's probability is its weight cut at 1. A round takes the dimensions in turn and scales the weights of each value by the
    factor with which its cut probabilities give exactly what it should get, so the cut loses nothing. Rounds go on until all
    values are met; targets that no probabilities meet together end after `most` rounds. Cells without tokens keep the budget as probability.
    """
    now = cells.withColumn("weight", F.lit(float(budget)))
    for d in DIMENSIONS:
        want = written(attainable(cells, d, (targets or {}).get(d), budget), f"targets-{d}")
        now = now.join(want.select(F.col("value").alias(d), F.col("want").alias(f"want_{d}")), d)
    now = written(now, "cells")
    counted, missed = F.col("tokens") > 0, []
    kept = F.col("tokens") * F.least(F.lit(1.0), F.col("weight"))
    for _ in range(most):
        for d in DIMENSIONS:
            # cells before this one cut at 1, the others scaled: the largest of these factors is the one that fits
            order = [F.when(counted, F.col("weight")).otherwise(-1.0), *[F.col(x) for x in DIMENSIONS if x != d]]
            above = Window.partitionBy(d).orderBy(*[o.desc() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
            below = Window.partitionBy(d).orderBy(*[o.asc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
            now = now.withColumns({
                "cut": F.coalesce(F.sum("tokens").over(above), F.lit(0)),
                "scaled": F.sum(F.col("tokens") * F.col("weight")).over(below),
            })
            factor = F.when(F.col("scaled") > 0, (F.col(f"want_{d}") - F.col("cut")) / F.col("scaled"))
            factor = F.max(factor).over(Window.partitionBy(d))
            now = now.withColumn("weight", F.when(counted, F.col("weight") * F.coalesce(factor, F.lit(1.0))).otherwise(F.col("weight")))
        now = written(now.drop("cut", "scaled"), "cells")
        # one aggregation for all dimensions: a round asks the driver for few exchanges
        shares = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"want_{d}").alias("want"), kept.alias("kept")) for d in DIMENSIONS]
        sums = now.select(F.explode(F.array(*shares)).alias("s")).groupBy("s.dimension", "s.value").agg(F.max("s.want").alias("want"), F.sum("s.kept").alias("got"))
        off = F.abs(F.col("got") - F.col("want")) > tolerance * F.greatest(F.col("want"), F.lit(1.0))
        missed = sums.where(off).orderBy(F.abs(F.col("got") - F.col("want")).desc(), "dimension", "value").limit(20).collect()
        if not missed:
            break
    return now.select(*cells.columns, F.least(F.lit(1.0), F.col("weight")).alias("probability")), missed


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, rounds: int | None = None) -> DataFrame:
    """`docs` with (topic, n_tokens, probability, sampled) beside their columns (of those names the new ones stand).

    Targets are met as `meet` has it, with a warning that lists the values (20 at most) that could not be; with `rounds`, that many
    rounds of `rake` are made instead.

    Null sources and languages are a value of their own, null and empty texts have no token and count in cells without weight. The
    draw is fixed by doc_id, so equal ids are kept or dropped together where their cells agree. An empty table gives an empty one.
    """
    plain = docs.drop("topic", "n_tokens", "probability", "sampled")
    told = plain.withColumn("n_tokens", n_tokens()).withColumn("topic", topic())
    value = {d: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d in DIMENSIONS}
    cells = told.groupBy(*[value[d].alias(d) for d in DIMENSIONS]).agg(F.sum("n_tokens").alias("tokens"))
    cells = written(cells, "cells")
    if rounds is None:
        raked, missed = meet(cells, targets, budget)
        if missed:
            told_of = "; ".join(f"{r['dimension']} {r['value']}: {r['got']:.0f} of {r['want']:.0f}" for r in missed)
            warnings.warn(f"mixing targets not met, in expected tokens: {told_of}", stacklevel=2)
    else:
        raked = rake(cells, targets, budget, rounds)
    names = {d: f"__cell_{d}" for d in DIMENSIONS}
    raked = raked.select(*[F.col(d).alias(n) for d, n in names.items()], F.col("probability"))
    at = [value[d] == F.col(n) for d, n in names.items()]
    out = told.join(raked, at[0] & at[1] & at[2]).drop(*names.values())
    return out.withColumn("sampled", draw() < F.col("probability"))


def op9_mixing(docs: DataFrame) -> DataFrame:
    """The query: all documents with their cell's probability, rounded, and whether they are in the sample, as its SQL has them."""
    value = [F.coalesce(F.col(d), F.lit(NONE)).alias(d) for d in ("source", "lang")]
    return mix(docs).select("doc_id", *value, "topic", "n_tokens", F.round("probability", 9).alias("probability"), "sampled")


def _wanted(d: str) -> str:
    """What each value of a dimension should get: of the levels that the first values to be full leave, the highest is the one that holds."""
    order = f"ORDER BY CASE WHEN share > 0 THEN have / share ELSE 0 END, {d}"
    return f"""want_{d} AS MATERIALIZED (SELECT {d}, least(have, share * (SELECT max(CASE WHEN left_share > 0 THEN (total * {BUDGET} - held) / left_share END)
 FROM (SELECT sum(have) OVER () AS total, coalesce(sum(have) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
 sum(share) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_share FROM have_{d}))) AS want FROM have_{d})"""


def _scaled(d: str, table: str) -> str:
    """`table` with the weights of each value scaled to what it should get, as a round of `meet` does."""
    rest = [x for x in DIMENSIONS if x != d]
    order = ["CASE WHEN tokens > 0 THEN weight ELSE -1.0 END", *rest]
    above = f"PARTITION BY {d} ORDER BY {', '.join(o + ' DESC' for o in order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    below = f"PARTITION BY {d} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    parts = f"SELECT *, coalesce(sum(tokens) OVER ({above}), 0) AS cut, sum(tokens * weight) OVER ({below}) AS below FROM {table}"
    factor = f"SELECT *, max(CASE WHEN below > 0 THEN (want_{d} - cut) / below END) OVER (PARTITION BY {d}) AS factor FROM ({parts})"
    return f"(SELECT * EXCLUDE (cut, below, factor) REPLACE (CASE WHEN tokens > 0 THEN weight * coalesce(factor, 1.0) ELSE weight END AS weight) FROM ({factor}))"


def oracle() -> str:
    """The query in DuckDB SQL: rounds of a recursive table go on until every value has what it should get."""
    without = lambda signs: f"length(t) - length(translate(t, '{signs}', ''))"
    steps = [
        f"""told AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, n_tokens,
 CASE WHEN contains(lower(t), 'license') THEN 'legal' WHEN ({without('|')}) * 50 > length(t) THEN 'tabular'
 WHEN ({without('%*&$#')}) * 20 > length(t) THEN 'noisy' WHEN n_tokens < 50 THEN 'brief' ELSE 'prose' END AS topic
 FROM (SELECT *, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS BIGINT) AS n_tokens FROM documents))""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM told GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        share = f"CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {FLATTEN[d]}) ELSE 0.0 END"
        steps += [f"have_{d} AS MATERIALIZED (SELECT {d}, sum(tokens) AS have, {share} AS share FROM cells GROUP BY {d})", _wanted(d)]
    wants = ", ".join(f"want_{d}.want AS want_{d}" for d in DIMENSIONS)
    joins = " ".join(f"JOIN want_{d} USING ({d})" for d in DIMENSIONS)
    scaled = "(SELECT * FROM rounds WHERE NOT met AND k < %d)" % MOST_ROUNDS
    for d in DIMENSIONS:
        scaled = _scaled(d, scaled)
    got = lambda d: f"sum(tokens * least(1.0, weight)) OVER (PARTITION BY {d})"
    off = " OR ".join(f"abs({got(d)} - want_{d}) > {TOLERANCE} * greatest(want_{d}, 1.0)" for d in DIMENSIONS)
    steps.append(
        f"""rounds AS (SELECT 0 AS k, false AS met, source, lang, topic, tokens, CAST({BUDGET} AS DOUBLE) AS weight, {wants} FROM cells {joins}
 UNION ALL SELECT k + 1, NOT bool_or(off) OVER (), * EXCLUDE (k, met, off) FROM (SELECT *, {off} AS off FROM {scaled}))"""
    )
    number = f"CAST(('0x' || substr(md5('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_DIGITS})) AS BIGINT)"
    return (
        "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(least(1.0, weight), 9) AS probability, "
        f"{number} / {float(16**HASH_DIGITS)} < least(1.0, weight) AS sampled FROM told JOIN rounds USING (source, lang, topic) WHERE k = (SELECT max(k) FROM rounds)"
    )
