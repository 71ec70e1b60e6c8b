"""Operator 3: personal data by bootstrapped contextual extraction, in DataFrame functions only.

Emails, addresses, card and phone numbers with a fixed form are the seeds. The words around them are patterns; a bipartite graph of
patterns and identifiers is scored in rounds: a pattern by the confidence of its identifiers, an identifier by its patterns.
Confident patterns find identifiers whose form no rule knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The forms of the contract, written so that Java's matcher neither recurses nor tries a run of characters from each of its places:
#: an email's first part begins where such characters begin, or where the match before has ended.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A sign that must stand in a text for the form to be looked for.
SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What may be an identifier of unknown form: a run of these characters with a digit, at least so long without punctuation at its end.
TOKEN = r"(?<![A-Za-z0-9_./@+-])(?=[A-Za-z_./@+-]*+[0-9])[A-Za-z0-9_./@+-]++"
TOKEN_LEAST = 6
#: Code points looked at on either side.
AROUND = 60
#: A pattern counts for a kind when that kind's seeds and found identifiers weigh so much together, and make up this share of what it
#: stands with, where other kinds count in full and identifiers not known yet in part.
LEAST_SUPPORT, LEAST_PATTERN, UNKNOWN = 3.0, 0.6, 0.25
LEAST_CONFIDENCE = 0.7


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str, m: str) -> str:
    """SQL condition on the match `m` of a kind."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "ip":
        part = "coalesce(try_cast(concat('0', trim(LEADING '0' FROM p)) AS INT), 256)"
        return f"forall(split({m}, '[.]'), p -> {part} <= 255)"
    if kind == "card":
        digit = f"cast(substring({digits}, i, 1) AS INT)"
        doubled = f"CASE WHEN (length({digits}) - i) % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END"
        return f"(length({digits}) BETWEEN 16 AND 19 AND aggregate(sequence(1, length({digits})), 0, (s, i) -> s + {doubled}) % 10 = 0)"
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    return "true"


def _spans(form: str, valid: str, size: str = "length(x.m)") -> Column:
    """Array of (start, end) of the valid matches `x.m` of `form` in `text`: lengths of what lies between them add up."""
    none = "cast(array() AS array<struct<start:int,end:int>>)"
    found = f"zip_with(split(text, {_sql(form)}, -1), regexp_extract_all(text, {_sql(form)}, 0), (b, m) -> named_struct('b', b, 'm', m))"
    here = "a.at + length(x.b)"
    step = (
        f"named_struct('at', {here} + length(x.m), 'out', if({valid}, "
        f"concat(a.out, array(named_struct('start', {here}, 'end', {here} + {size}))), a.out))"
    )
    return F.expr(f"aggregate(filter({found}, x -> x.m IS NOT NULL), named_struct('at', 0, 'out', {none}), (a, x) -> {step}, a -> a.out)")


def base_spans(kind: str) -> Column:
    """Array of (start, end), in code points, of the valid matches of a kind in `text`; a match that is not valid is not tried again."""
    none = F.expr("cast(array() AS array<struct<start:int,end:int>>)")
    sign = F.col("text").rlike("[0-9]") if SIGN[kind] is None else F.contains("text", F.lit(SIGN[kind]))
    return F.when(sign, _spans(FORMS[kind], _valid(kind, "x.m"))).otherwise(none)


def _base() -> Column:
    """The base spans of all kinds, as one array of (kind, start, end)."""

    def told(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*[told(k) for k in KINDS])


def _mentions() -> Column:
    """Seeds and identifier-like tokens with the words around them."""
    core = "length(regexp_replace(x.m, '[_./@+-]+$', ''))"
    tokens = F.when(F.col("text").rlike("[0-9]"), _spans(TOKEN, f"{core} >= {TOKEN_LEAST}", core)).otherwise(F.expr("cast(array() AS array<struct<start:int,end:int>>)"))
    seeds = _base()
    free = F.filter(tokens, lambda t: ~F.exists(seeds, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    free = F.transform(free, lambda t: F.struct(F.lit(None).cast("string").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))

    def around(s: Column) -> Column:
        left = F.lower(F.substring(F.col("text"), F.greatest(F.lit(1), s["start"] - AROUND + 1), F.least(F.lit(AROUND), s["start"])))
        right = F.lower(F.substring(F.col("text"), s["end"] + 1, F.lit(AROUND)))
        before = F.regexp_extract_all(left, F.lit(r"\S+"), 0)
        after = F.regexp_extract_all(right, F.lit(r"[\p{L}]+"), 0)
        last = F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit(""))
        return F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.lower(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])).alias("instance"),
            F.array_compact(
                F.array(
                    F.when(F.size(before) > 1, F.concat(F.lit("<"), F.try_element_at(before, F.lit(-2)), F.lit(" "), last)),
                    F.when((last != "") & (F.size(after) > 0), F.concat(last, F.lit(" _ "), F.try_element_at(after, F.lit(1)))),
                )
            ).alias("patterns"),
        )

    return F.transform(F.concat(seeds, free), around)


def bootstrap(mentions: DataFrame) -> DataFrame:
    """(instance, kind, confidence) of identifiers found by the patterns that `mentions` (kind, instance, patterns) induce.

    Seeds have a confidence of 1. Patterns and identifiers are scored in turn, each from a written table of the other, until a round
    finds no identifier and accepts none that no round before has.
    """
    edges = written(mentions.select("instance", F.explode("patterns").alias("pattern")).distinct(), "edges")
    seeds = written(mentions.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("confidence")).distinct(), "seeds")
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    known, ever = seeds, None
    while True:
        support = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("support"))
        weight = support.groupBy("pattern").agg(F.sum("support").alias("weight"))
        scored = support.where(F.col("support") >= LEAST_SUPPORT).join(weight, "pattern").join(size, "pattern")
        unknown = F.greatest(F.lit(0.0), F.col("size") - F.col("weight"))
        scored = scored.select("pattern", "kind", (F.col("support") / (F.col("weight") + UNKNOWN * unknown + 1)).alias("score"))
        scored = scored.where(F.col("score") >= LEAST_PATTERN)
        by = edges.join(scored, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("confidence"))
        best = by.groupBy("instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))
        found = written(best.join(seeds.select("instance").distinct(), "instance", "left_anti"), "found")
        known = seeds.unionByName(found)
        now = found.select("instance", "kind", (F.col("confidence") >= LEAST_CONFIDENCE).alias("accepted"))
        new = now if ever is None else now.join(ever, ["instance", "kind", "accepted"], "left_anti")
        # identifiers only enter `ever`, of which there are finitely many, so the rounds end
        new = written(new, "new")
        if new.isEmpty():
            return found.where(F.col("confidence") >= LEAST_CONFIDENCE)
        ever = new if ever is None else ever.unionByName(new)


def personal_data(docs: DataFrame) -> DataFrame:
    """For each row of `docs` (doc_id, text): arrays of the base spans by kind, and `found`, the spans that patterns added.

    A null text counts as empty. Rows are kept one by one; rows with equal id and text have equal results, null ids too. An empty table
    gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = rows.withColumns({k: base_spans(k) for k in KINDS})
    told = written(base.select("doc_id", F.xxhash64("text").alias("digest"), *KINDS, _mentions().alias("mentions")), "mentions")
    mentions = told.select("doc_id", "digest", F.explode("mentions").alias("m")).select("doc_id", "digest", "m.*")
    accepted = bootstrap(mentions).withColumnRenamed("kind", "as")
    spans = mentions.where("kind is null").join(accepted, "instance").groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set(F.struct(F.col("as").alias("kind"), "start", "end"))).alias("found")
    )
    spans = spans.withColumnsRenamed({"doc_id": "of_doc", "digest": "of_digest"})
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("digest") == F.col("of_digest"))
    none = F.expr("cast(array() AS array<struct<kind:string,start:int,end:int>>)")
    return told.join(spans, same, "left").select("doc_id", *KINDS, F.coalesce("found", none).alias("found"))


def _written_out(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def op3_pii(docs: DataFrame) -> DataFrame:
    found = personal_data(docs)
    base = _base()
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_written_out(base), 256).alias("base_sha256"),
        _written_out(F.concat(base, F.col("found"))).alias("spans"), F.size("found").alias("n_found"),
    )
