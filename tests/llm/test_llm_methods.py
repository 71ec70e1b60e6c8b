"""The operators' methods against brute force on small tables."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st

from fixtures import SF
from sessionlens.llm import bwt, components, decontaminate, fingerprint, html, lines, minhash, mixing, pii, suffix, toxicity
from sessionlens.llm.common import Members, mix, span_hashes, text_buffer, tokens, WORD_BYTES


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").orderBy("doc_id").collect()}


# helpers


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data, offsets = text_buffer(pa.array(["aa bb", None, " bb\taa cc", ""]))
    starts, ends, owner = tokens(data, offsets, WORD_BYTES)
    h = span_hashes(data, starts, ends)
    assert owner.tolist() == [0, 0, 2, 2, 2] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_members_finds_exactly_its_keys():
    keys = mix(np.arange(5000, dtype=np.uint64))
    m = Members(keys)
    assert (m.keys[m.positions(keys)] == keys).all() and (m.positions(mix(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()


# transform


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=7), st.integers(1, 9))
def test_prefix_classes_are_equal_prefixes(strings, least):
    raw = [s.encode() for s in strings]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(s) for s in raw])
    positions, classes = bwt.prefix_classes(data, ends, least)
    assert sorted(positions.tolist()) == list(range(len(data)))
    by_class, by_prefix = defaultdict(set), defaultdict(set)
    for p, c in zip(positions.tolist(), classes.tolist()):
        if p + least <= ends[np.searchsorted(ends, p, side="right")]:
            prefix = data[p : p + least].tobytes()
            by_class[c].add(prefix)
            by_prefix[prefix].add(c)
    assert all(len(v) == 1 for v in [*by_class.values(), *by_prefix.values()])


@pytest.mark.parametrize("text, least", [(b"a", 4), (b"ab", 9), (b"a", 1)])
def test_prefix_classes_of_a_text_shorter_than_a_key(text, least):
    positions, classes = bwt.prefix_classes(np.frombuffer(text, np.uint8), np.array([len(text)]), least)
    assert sorted(positions.tolist()) == list(range(len(text))) and len(classes) == len(text)


def removed_bytes(texts, least):
    seen, out = {}, {}
    for i, text in texts.items():
        raw = text.encode()
        lost = np.zeros(len(raw), bool)
        windows = [raw[p : p + least] for p in range(len(raw) - least + 1)]
        for p, w in enumerate(windows):
            if seen.get(w, i) != i:
                lost[p : p + least] = True
        for w in windows:
            seen.setdefault(w, i)
        kept = np.frombuffer(raw, np.uint8)[~lost].tobytes()
        out[i] = (len(raw), int(lost.sum()), int((np.diff(np.concatenate([[0], lost.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_bytes_equal_brute_force(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_STRETCHES", hot)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.op4_suffix(docs).collect()}
    assert got == removed_bytes(texts, 50)


def test_texts_that_earlier_documents_hold_whole_are_not_sent(spark, monkeypatch):
    r = random.Random(5)
    line = lambda n: "".join(r.choices("abcdefgh ", k=n))
    common = line(20_000)
    texts = {i: line(100) + common + line(100) for i in range(24)}
    sent, make = spark.sparkContext.accumulator(0), suffix.stretch_rows

    def counting(*a):
        run = make(*a)

        def rows(batches):
            for batch in run(batches):
                sent.add(sum((size & ((1 << 40) - 1)) - 40 * (size >> 40) for size in batch.column("size").to_pylist()))
                yield batch

        return rows

    monkeypatch.setattr(suffix, "stretch_rows", counting)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix.op4_suffix(docs).collect()}
    finally:
        spark.conf.unset(key)
    assert got == removed_bytes(texts, 50) and 0 < sent.value < len(common)


@pytest.mark.parametrize("many, hot", [(64, 1000), (1, 1000), (1, 1), (0, 3)])
def test_stretches_of_small_flushes_equal_brute_force(many, hot, monkeypatch):
    monkeypatch.setattr(suffix, "MANY", many)
    monkeypatch.setattr(suffix, "HELD", 40)
    monkeypatch.setattr(suffix, "TRANSFORMED", 3000)
    r = random.Random(many + hot)
    lines = ["".join(r.choices("abc", k=r.randint(10, 90))) for _ in range(12)]
    rows = [(r.randint(-30, 30), " ".join(r.choices(lines, k=r.randint(0, 9))) + r.choice(["", "x" * 70, "ab" * 60])) for _ in range(80)]
    rows.append(rows[0])
    n, holders, hot_anchors = 5, defaultdict(set), []
    for i, text in rows:
        raw = text.encode()
        for p in range(len(raw) - 49):
            holders[raw[p : p + 50]].add(i)
    wanted = set()
    for k, (i, text) in enumerate(rows):
        raw = text.encode()
        wanted |= {(i, k if k < 80 else 0, q) for p in range(len(raw) - 49) if min(holders[raw[p : p + 50]]) < i for q in range(p, p + 50)}

    def dealt(batches):
        table = pa.Table.from_batches(batches)
        return [table.filter(pc.equal(table["bucket"], b)) for b in range(n)]

    def batches(some, **more):
        yield pa.RecordBatch.from_pydict({"doc_id": [i for _, i, _ in some], "text": [t for _, _, t in some], **more})

    numbered = [(k if k < 80 else 0, i, t) for k, (i, t) in enumerate(rows)]
    tasks = [numbered[k::4] for k in range(4)]
    seen = [b for task in tasks for x in task for b in suffix.anchor_rows(n)(batches([x]))]
    seen += [b for task in tasks[:2] for b in suffix.anchor_rows(n)(batches(task))]  # again, in larger flushes
    held = defaultdict(list)
    for table in dealt(seen):
        for i, stretch in zip(*suffix._hits(hot)(table).to_pydict().values()):
            hot_anchors.append(stretch) if i is None else held[i].append(stretch)
    broadcast = type("", (), {"value": np.array(hot_anchors, np.int64).view(np.uint64)})
    sent = []
    for task in tasks:
        task = [x for x in task if x[1] in held]
        digests, known = pa.array([k for k, _, _ in task], pa.int32()), pa.array([held[i] for _, i, _ in task], pa.list_(pa.int64()))
        sent += suffix.stretch_rows(n, broadcast)(batches(task, digest=digests, stretches=known))
    got = set()
    for table in dealt(sent):
        for i, k, a, b in zip(*suffix._gone(table).to_pydict().values()) if len(table) else ():
            got |= {(i, k, q) for q in range(a, b)}
    assert got == wanted and wanted


# near-duplicates


def components_of(sets, percent):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sorted(sets) if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def word_sets(texts, size):
    out = {}
    for i, text in texts.items():
        w = text.encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def test_near_duplicates_equal_brute_force(docs, texts):
    sets = word_sets(texts, 2)
    rows = {r["doc_id"]: r for r in minhash.op6_minhash(docs).collect()}
    assert {i: r["n_shingles"] for i, r in rows.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == components_of(sets, 80)


def test_a_cloud_of_edits_keeps_all_its_links(spark):
    """Edits of one text, each some way off: many pairs are near the threshold and no member is like all others."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 13), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        texts[i] = " ".join(words)
    rows = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == components_of(word_sets(texts, 2), 80)


# lines


def test_runs_go_whole_whichever_earlier_places_their_parts_have(spark):
    filler = " ".join(["many"] * lines.LONG)
    rows, gone = [], {}
    for k in range(30):  # by the hashes, other runs were selected for other k
        s1, s2, s3, s4, b, c, d = (f"{x}{k} short." for x in "efghuvw")
        long = f"l{k} {filler}."
        rows += [
            (10 * k, "\n".join([f"x{k}.", s2, long, s3, f"y{k}."])), (10 * k + 1, "\n".join([s1, s2, long, s3, s4])), (10 * k + 2, "\n".join([s1, s2, long, s3, s4])),
            (10 * k + 3, "\n".join([f"p{k}.", b, c, f"m{k}.", f"q{k}."])), (10 * k + 4, "\n".join([b, c, f"m{k}."])), (10 * k + 5, "\n".join([d, long])), (10 * k + 6, "\n".join([d, long])),
        ]
        gone |= {10 * k: 0, 10 * k + 1: 3, 10 * k + 2: 5, 10 * k + 3: 0, 10 * k + 4: 3, 10 * k + 5: 1, 10 * k + 6: 2}
    found = lines.op7_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == gone


def line_units(text):
    return [u for line in text.split("\n") for u in (x.strip(" \t\r\n\x0b\x0c") for x in re.split(r"(?<=[.!?]) ", line)) if u]


def units_gone(texts):
    """By document, the units that lie in a run with an earlier place: three units, or fewer with a long one."""
    first, out = {}, {}
    for i in sorted(texts):
        units = line_units(texts[i])
        out[i] = set()
        for size in range(1, lines.RUN + 1):
            for p in range(len(units) - size + 1):
                run = tuple(units[p : p + size])
                if size == lines.RUN or any(len(u.split()) >= lines.LONG for u in run):
                    doc, at = first.setdefault(run, (i, p))
                    if (doc, at) != (i, p):
                        out[i] |= set(range(p if doc < i else max(p, at + size), p + size))
    return out


def test_line_runs_equal_brute_force(docs, texts):
    rows = {r["doc_id"]: r for r in lines.op7_lines(docs).collect()}
    gone = units_gone(texts)
    for i in texts:
        kept = [u for p, u in enumerate(line_units(texts[i])) if p not in gone[i]]
        assert (rows[i]["n_units"], rows[i]["n_removed"]) == (len(line_units(texts[i])), len(gone[i])), i
        assert line_units(rows[i]["text"]) == kept or not gone[i]
        assert gone[i] or rows[i]["text"] == texts[i]


def test_line_runs_of_few_repeating_units_equal_brute_force(spark):
    rng = random.Random(7)
    filler = " ".join(["many"] * lines.LONG)
    names = [f"s{k}." for k in range(6)] + [f"l{k} {filler}." for k in range(2)]
    texts = {i: "\n".join(rng.choice(names) for _ in range(rng.randint(0, 9))) for i in range(120)}
    rows = {r["doc_id"]: r["n_removed"] for r in lines.op7_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert rows == {i: len(x) for i, x in units_gone(texts).items()}


def test_a_run_has_one_window_minimum_wherever_it_stands():
    rng = random.Random(5)
    units = [f"u{rng.randint(0, 400)}." for _ in range(2000)]
    u = lines.Units(*text_buffer(pa.array(["\n".join(units)])))
    at, runs = lines.fingerprints(u)
    chosen = {}
    for (size, before), hashes in zip(lines.SLOTS, runs):
        for p, h in zip(at - before, hashes):
            if h:
                assert chosen.setdefault(tuple(units[p : p + size]), (h, before)) == (h, before)
    assert np.count_nonzero(runs) == len(units) - lines.RUN + 1 and len(at) < 0.55 * len(units)


# leaks


def test_leaks_are_the_items_that_stand_in_the_text(spark, docs, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    plain = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
    words = {i: plain(t) for i, t in texts.items()}
    want = {(i, j) for j, item in items.items() for i, t in words.items() if plain(item) in t}
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.op1_decontaminate(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert want <= set(found) and all(min(r["question_overlap"], r["answer_overlap"]) >= decontaminate.OVERLAP for r in found.values())


def test_search_scores_as_plain_bm25():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"t{min(int(x), 60)}" for x in rng.zipf(1.4, rng.integers(3, 30))) for _ in range(80)]
    index = decontaminate.Index.build(list(range(80)), texts)
    queries = [texts[i] + " " + texts[(i * 7) % 80] for i in range(40)]
    words, owner = decontaminate._words(queries)
    start, end, doc, item, score = index.search(words, owner, len(queries))
    got = {(int(d), int(index.items[i])): round(float(s), 9) for d, i, s in zip(doc, item, score)}
    impact = {}
    for t in range(len(index.terms.keys)):
        for e in range(index.first[t], index.first[t + 1]):
            impact[int(index.terms.keys[t]), int(index.item[e])] = index.impact[e]
    want = {}
    for q in range(len(queries)):
        held = set(words[owner == q].tolist())
        for i in range(len(index.items)):
            s = sum(v for (t, j), v in impact.items() if j == i and t in held)
            if s >= decontaminate.THRESHOLD - 1e-9:
                want[q, int(index.items[i])] = round(float(s), 9)
    assert got == want


# tagger


def test_marginals_equal_all_labelings():
    rng = np.random.default_rng(2)
    emission, weights = rng.normal(0, 2, 6), rng.normal(0, 1, toxicity.N_WEIGHTS)
    stay, enter, leave, start = weights[-4:]
    total, mass = 0.0, np.zeros(6)
    for code in range(64):
        y = [(code >> k) & 1 for k in range(6)]
        s = start * y[0] + sum(e for e, t in zip(emission, y) if t)
        s += sum((enter, stay)[a] if b else (0.0, leave)[a] for a, b in zip(y, y[1:]))
        total += np.exp(s)
        mass += np.exp(s) * np.array(y)
    assert np.allclose(toxicity.marginals(emission, np.zeros(6, int), weights), mass / total)
    assert np.allclose(toxicity.expectations(emission, np.zeros(6, int), weights)[0], mass / total)


def test_toxic_words_are_learned_and_marked(spark):
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(400):
        words = [f"w{int(x)}" for x in rng.integers(0, 300, 40)]
        toxic = int(i % 5 == 0)
        if toxic:
            words[7] = words[21] = "vile"
        rows.append((i, " ".join(words) + "."))
        marks.append((i, 0, toxic))
    out = toxicity.op2_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    for r in out.collect():
        assert r["predicted"] == int(r["doc_id"] % 5 == 0)
        text = rows[r["doc_id"]][1]
        assert {text[int(a) : int(b)] for a, b in (s.split(":") for s in r["spans"].split(",") if s)} == ({"vile"} if r["predicted"] else set())


# others


def test_fingerprints_follow_the_contract(docs, texts):
    rows = {r["doc_id"]: r for r in fingerprint.op10_fingerprint(docs).collect()}
    ids = sorted(texts)
    near = []
    for i, after in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - k] + texts[after][:k]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(texts[i])
        near.append((rows[i]["near_edited"], rows[i]["near_next"]))
        if texts[i] == texts[after]:
            assert rows[i]["fingerprint"] == rows[after]["fingerprint"] and rows[i]["near_next"] == 1
    assert np.mean([a > b for a, b in near]) > 0.85


def test_base_spans_equal_python(docs, texts):
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def valid(kind, m):
        d = [int(c) for c in m if c.isascii() and c.isdigit()]
        luhn = sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(p.isdigit() and int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    for r in pii.op3_pii(docs).collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k in forms for m in re.finditer(forms[k], texts[r["doc_id"]]) if valid(k, m.group())]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r["spans"].split(",")) | {""}


def test_patterns_find_identifiers_of_unknown_form(spark):
    rows = [(k, f"some words then member contact: {'u%d@corp.example' % k if k % 2 else 'Q%d-77x' % (k + 100)} and more") for k in range(30)]
    rows += [(100 + k, f"chapter number {k}1234567 of the book") for k in range(30)]
    found = {r["doc_id"]: r["n_found"] for r in pii.op3_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, n in found.items() if n} == {k for k in range(0, 30, 2)}


def test_layout():
    page = "<head><title>t</title></head><h1>A</h1><p>x <b>y</b><p>z<br>w<ul><li>a<li>b<ol><li>c</ol></ul><table><tr><th>k<th>v<tr><td>long<td>1</table><p hidden>n<div style='display: none'>n</div>e"
    assert html.visible_text(page) == "A\n\nx y\n\nz\nw\n\n- a\n- b\n  1. c\n\nk     v\nlong  1\n\ne"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<td>", "<table>", "</table>", "<li>", "<ul>", "</ul>", "<b>", "</div>", "<div>", "word ", "<tr>", "<pre>", "</pre>", "< ", "&amp;"]), max_size=25))
def test_any_markup_keeps_its_words(parts):
    assert html.visible_text("".join(parts)).count("word") == parts.count("word ")


def test_patterns_are_followed_to_the_last_link(spark):
    links = 7
    rows = [(f"seed{k}@x.example", "email", ["p0"]) for k in range(40)]
    for n in range(links):  # identifiers that stand in one pattern and the next
        rows += [(f"id{n}-{k}", None, [f"p{n}", f"p{n + 1}"]) for k in range(40)]
    found = pii.bootstrap(spark.createDataFrame(rows, "instance string, kind string, patterns array<string>")).collect()
    assert {r["instance"] for r in found} == {f"id{n}-{k}" for n in range(links) for k in range(40)}


def test_drawings_and_formulas_are_shown():
    page = "<p>a <svg viewBox='0 0 1 1'><title/><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text>North</text><text>South</text></svg><p>b <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> c"
    assert html.visible_text(page).split() == ["a", "North", "South", "b", "x=", "1", "2", "c"]
    assert html.visible_text("<svg><defs><p>out</p>after") == "out\n\nafter"


def test_cells_stand_under_their_column():
    page = "<table><tr><th>k<th>v<th>w<tr><td rowspan=2>a<td>1<td>2<tr><td>3<td>4<tr><td colspan=2>wide<td>5</table>"
    assert html.visible_text(page) == "k     v  w\na     1  2\n      3  4\nwide     5".replace("k     ", "k  ").replace("a     ", "a  ").replace("      3", "   3").replace("wide     5", "wide  5")
    long = "x" * 60
    assert html.visible_text(f"<table><tr><td>{long}<td>1<tr><td>y<td>2</table>") == f"{long}  1\n{'y':60}  2"
    assert html.visible_text("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>") == "a  b\n   c\nd"
    assert html.visible_text("<table><tr><td colspan=300>a<td>b<tr><td>c</table>") == "a  b\nc"


def test_cells_keep_their_lines():
    page = "<table><tr><td><h1>Title</h1><p>one<p>two<ul><li>a<li>b</ul><td>x<br>y<tr><td>c<td>z</table>"
    assert html.visible_text(page) == "Title  x\n       y\none\n\ntwo\n\n- a\n- b\nc      z"


def test_padding_is_bounded_and_long_cells_stay_whole():
    long = "w" * 50_000
    page = f"<table><tr><td>{long}<td>end" + "<tr><td>k<td>v" * 1000 + "</table>"
    lines = html.visible_text(page).split("\n")
    assert lines[0] == f"{long}  end" and set(lines[1:]) == {"k".ljust(html.WIDEST_COLUMN) + "  v"}
    wide = "<table><tr>" + f"<td>{'c' * 90}" * 900 + "<tr><td colspan=899><td>x" * 2000 + "</table>"
    assert len(html.visible_text(wide)) < 900 * 92 + 2000 * (html.WIDEST_LINE + 2)
    assert len(html.visible_text("<blockquote>a" * 20_000)) < 20_000 * (html.WIDEST_LEAD + 3)


@pytest.mark.parametrize("start", ["<div>", "<p><button>", "<span>", "<li>", "<ul><li>"])
def test_deep_pages_take_time_in_proportion(start):
    began = time.process_time()
    assert html.visible_text(start * 50_000 + "word").endswith("word")
    assert time.process_time() - began < 5


def test_what_is_predicted_toxic_does_not_survive(spark):
    words = ["calm", "green", "river", "stone", "walks", "quiet", "paper", "window"]
    rows = [(i, " ".join(words[(i + k) % 8] for k in range(12)) + (" zorgle." if i % 5 == 0 else ".")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    tagger = toxicity.learn(toxicity.training_rows(docs, marks))
    # first as learned, then with all scores at 0.4, between the thresholds, and no word marked
    for scale in (tagger.scale, np.array([np.log(0.4 / 0.6), 0, 0, 0, 0])):
        shown = toxicity.Tagger(tagger.lexicon, tagger.weights, scale)
        clean = {r["doc_id"] for r in toxicity.tag_documents(docs, shown).where("predicted = 0").collect()}
        assert {r["doc_id"] for r in toxicity.without_toxic(docs, shown).collect()} == clean
        assert scale is tagger.scale or not clean


def test_raking_meets_the_targets(spark):
    cells = [(s, g, t, int(n)) for (s, g, t), n in zip(((s, g, t) for s in "ab" for g in "xy" for t in "pq"), (900, 300, 200, 100, 400, 300, 250, 150))]
    out = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), {"source": {"a": 0.5, "b": 0.5}}, budget=0.3, rounds=30).collect()
    kept = defaultdict(float)
    for r in out:
        kept[r["source"]] += r["tokens"] * r["probability"]
    assert kept["a"] == pytest.approx(0.15 * 2600, rel=1e-3) and kept["b"] == pytest.approx(0.15 * 2600, rel=1e-3)


def test_mixing_meets_the_default_targets(spark, docs):
    out = mixing.mix(docs).select("topic", "source", "lang", "n_tokens", "probability").toPandas()
    out["kept"] = out.n_tokens * out.probability
    total = out.n_tokens.sum()
    assert out.kept.sum() == pytest.approx(mixing.BUDGET * total, rel=1e-3)
    for d in mixing.DIMENSIONS:
        have = out.fillna({d: mixing.NONE}).groupby(d).n_tokens.sum().astype(float)
        share, want, open_ = have ** mixing.FLATTEN[d], have * 0, have > 0
        while True:  # values that cannot hold their part are filled, the others share what is left
            want = have.where(~open_, (mixing.BUDGET * total - have[~open_].sum()) * share / share[open_].sum())
            if not (want > have + 1e-6).any():
                break
            open_ &= want <= have
        got = out.fillna({d: mixing.NONE}).groupby(d).kept.sum()
        assert got.to_numpy() == pytest.approx(want.to_numpy(), rel=1e-3), d


def test_mixing_reports_what_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("b", "y", "p", 100)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}
    met, missed = mixing.meet(cells, targets, budget=0.5, most=3)
    assert {r["dimension"] for r in missed} & {"source", "lang"}
    assert all(0 <= r["probability"] <= 1 for r in met.collect())


def test_a_round_of_mixing_checks_all_targets_in_one_aggregation(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", "p", 60), ("a", "y", "q", 20), ("b", "x", "q", 15), ("b", "y", "p", 20)], "source string, lang string, topic string, tokens long")
    plans, collect = [], type(cells).collect
    monkeypatch.setattr(type(cells), "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or collect(df))
    met, missed = mixing.meet(cells, {"source": {"a": 0.5, "b": 0.5}}, budget=0.3)
    checks = [p for p in plans if "dimension" in p]
    assert not missed and checks and all(p.count("Aggregate [") == 1 and "Union" not in p for p in checks)
    got = met.toPandas().eval("kept = tokens * probability").groupby("source").kept.sum()
    assert got.to_dict() == pytest.approx({"a": 17.25, "b": 17.25}, rel=1e-3)


def test_no_salts_are_joined_where_no_group_is_large(spark):
    size = spark.createDataFrame([(1, 5), (2, 3)], "g long, size long")
    dealt, copied = minhash.by_salt(size, 8, 4)
    for df in (dealt(size, "size"), copied(size)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r["g"], r["size"], r["salt"]) for r in df.collect()) == [(1, 5, 0), (2, 3, 0)]
    many = spark.createDataFrame([(1, minhash.LEAST_SHARE * 8), (2, 3)], "g long, size long")
    dealt, copied = minhash.by_salt(many, minhash.LEAST_SHARE * 8, 8)
    assert copied(many).where("g = 1").count() == 8 and copied(many).where("g = 2").count() == 1


def test_salts_of_large_groups_are_a_constant(spark):
    many = spark.createDataFrame([(1, minhash.LEAST_SHARE * 8), (2, 3), (None, 1)], "g long, size long")
    dealt, copied = minhash.by_salt(many, minhash.LEAST_SHARE * 8, 8)
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 1L, 2L) as g")
    for df in (dealt(rows, "id"), copied(many)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    salts = dealt(rows, "id").groupBy("g").agg({"salt": "max"}).collect()
    assert {tuple(r) for r in salts} == {(1, 7), (2, 0)}
    assert dealt(rows, "id").join(copied(many), ["g", "salt"]).count() == 1000


def test_rounds_of_labels_have_few_tasks_for_few_links(spark, monkeypatch):
    plans, keep = [], components.written
    monkeypatch.setattr(components, "written", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, *a))
    found = components.components(spark.createDataFrame([(1, 2), (2, 3), (7, 5)], "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5)}
    assert all(p.count("Repartition 8, false") >= 4 for p in plans[2:])


def test_near_duplicates_turn_no_join_into_a_broadcast(spark, monkeypatch):
    key, seen, keep = "spark.sql.adaptive.autoBroadcastJoinThreshold", [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, *a: seen.append(spark.conf.get(key, None)) or keep(df, *a))
    before = spark.conf.get(key, None)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z")], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert out == {1: 1, 2: 1, 3: 3} and set(seen) == {"-1"} and spark.conf.get(key, None) == before


def test_suffixes_that_stand_alone_are_not_sorted_again(monkeypatch):
    sizes, stable = [], bwt._stable
    monkeypatch.setattr(bwt, "_stable", lambda key: sizes.append(len(key)) or stable(key))
    text = np.random.default_rng(3).integers(1, 250, 5000)
    symbols = np.concatenate([text, [0], text[:100], [0]])
    order = bwt.sorted_suffixes(symbols, 50)[0]
    upto = [bytes(symbols[i : i + 50].astype(np.uint8)).split(b"\0")[0] for i in order]
    assert sorted(order) == list(range(len(symbols))) and upto == sorted(upto)
    assert sizes[0] == len(symbols) and len(sizes) > 1 and max(sizes[1:]) <= 300


def test_runs_of_a_fingerprint_are_rows_of_their_own(spark, monkeypatch):
    plans, keep = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    text = "one is here.\ntwo is there.\nthree is gone.\nfour comes."
    docs = spark.createDataFrame([(1, text), (2, text), (3, "none of it.")], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_units"], r["n_removed"]) for r in lines.dedup_lines(docs).collect()}
    assert out == {1: (text, 4, 0), 2: ("", 4, 4), 3: ("none of it.", 1, 0)}
    assert len(plans) == 3 and not any("Generate" in p for p in plans)
