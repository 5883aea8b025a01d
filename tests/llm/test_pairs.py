"""Near-duplicates, decontamination and line dedup against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest

from kithgraph.llm import line_dedup, minhash, words
from kithgraph.llm.components import components
from kithgraph.llm.line_dedup import banded_distance, line_classes, line_report, without_repeated_lines
from kithgraph.llm.minhash import near_duplicates, shared
from kithgraph.llm.simhash import leaks, without_leaks

DOCS = "doc_id long, text string, component_id string, rep long"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = split(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def changed(r, words_, n):
    out = list(words_)
    for _ in range(n):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return out


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    base, common = text(120), text(40)
    rows = [" ".join(changed(r, base, r.randrange(6))) for _ in range(260)]
    rows += [" ".join(common + text(20)) for _ in range(90)]
    rows += [" ".join(changed(r, b, k)) for b in (text(60) for _ in range(15)) for k in range(4)]
    rows += ["", None, "one", "ONE", "two words", "two words", "a b c", "Ü ü", " \t\n"] + [" ".join(text(n)) for n in (4, 5, 6, 3000)]
    return [(i, t, "clash", 7) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = corpus()
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, DOCS), size=size, percent=percent, short=16, block=32).collect()}
    sets = {i: shingles(t, size) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert {i: (g.n_shingles, g.component_id, g.kept) for i, g in got.items()} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_least_shared_holds(spark):
    for n in range(1, 200):
        union = n * 100 // 85
        assert 1 <= shared(n, 48, 85) <= min(n, 48) and union >= n
    assert minhash._likely(48, 85) <= 48 * 0.85


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(None, 1), (5, 5)] + [(i, 400) for i in range(400, 460)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {x.node: x.component for x in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["a b", "", None, " x\ty\x0bz\x0c\r\n", "no\xa0break é ü", "end", "A a"]
    held = [w for part in words.words_of(pa.array(texts), limit=4) for w in zip(*[iter([part])])]
    counts = [b - a for (p,) in held for a, b in itertools.pairwise(p.word_at.tolist())]
    assert counts == [len(split(t)) for t in texts]


def test_leaks(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [text(r.randint(12, 60)) for _ in range(12)] + [text(300)]
    docs = []
    for i in range(160):
        item = list(items[i % len(items)])
        if i % 3 == 1:
            item = changed(r, item, 1)
        if i % 3 == 2:
            item = item[2:]
        docs.append(text(r.randint(0, 80)) + (item if i % 4 else []) + text(r.randint(0, 80)))
    rows = [(k, " ".join(d).upper() if k % 5 == 0 else " ".join(d)) for k, d in enumerate(docs)] + [(900, None), (901, ""), (None, " ".join(items[0]))]
    bench = [(k, " ".join(t)) for k, t in enumerate(items)] + [(50, None), (51, "too short"), (52, "")]
    expect = set()
    for d, t in rows:
        w = split(t)
        for k, item in enumerate(items):
            own = Counter(tuple(item[i : i + 5]) for i in range(len(item) - 4))
            for q in range(max(1, len(w) - 4)):
                v = Counter(tuple(w[i : i + 5]) for i in range(q, min(q + len(item), len(w)) - 4))
                n = sum((v & own).values())
                if n and 100 * n >= 80 * (sum(v.values()) + sum(own.values()) - n):
                    expect.add((d, k))
                    break
    frame, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = leaks(frame, tests)
    found = {(x.doc_id, x.item_id) for x in got.collect()}
    assert found <= expect and len(found) >= 0.98 * len(expect)
    assert {(x.doc_id, x.item_id) for x in leaks(frame, tests, most_prints=40).collect()} == found
    clean = {x.doc_id for x in without_leaks(frame.withColumn("item_id", frame.doc_id), tests).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in found}
    assert leaks(frame, tests.limit(0)).count() == 0 and leaks(frame.limit(0), tests).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        k = r.randrange(len(out) + 1)
        kind = r.choice("ids")
        if kind == "i":
            out.insert(k, r.choice("abé"))
        elif out:
            out[min(k, len(out) - 1) :][:1] = []
            out[min(k, len(out) - 1) : min(k, len(out) - 1) + 1] = [] if kind == "d" else [r.choice("abcé")]
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(spark, edits):
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(40))
    lines = [edited(r, base, r.randint(0, 4)) for _ in range(150)] + ["".join(r.choice("ab ") for _ in range(18)) for _ in range(90)] + ["", "  ", "short"] * 3
    rows = [(k, "\n".join(lines[i : i + 3]), "x") for k, i in enumerate(range(0, len(lines), 3))] + [(500, None, "x"), (None, base, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pos string")
    held = [(-1 if d is None else d, p, x) for d, t, _ in rows for p, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    first = {}
    for d, p, x in sorted(held):
        first.setdefault(x, (d, p))
    late = {x: len(x) >= 16 and any(first[y] < first[x] and len(y) >= 16 and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for y in first if y != x) for x in first}
    expect = {(d, p): ((d, p) != first[x], (d, p) == first[x] and late[x]) for d, p, x in held}
    got = {(-1 if x.doc_id is None else x.doc_id, x.pos): (x.repeated, x.near) for x in line_classes(frame, edits=edits, short=8).collect()}
    assert got == expect
    if edits == 1:
        report = {(-1 if x.doc_id is None else x.doc_id): x for x in line_report(frame).collect()}
        assert report[500].n_lines == 0 and len(report) == len(rows)
        rest = {(-1 if x.doc_id is None else x.doc_id): x.text for x in without_repeated_lines(frame).collect()}
        assert rest[500] is None
        for d, t, _ in rows[:30]:
            assert rest[d] == "\n".join(x for p, x in enumerate(t.split("\n")) if not any(expect.get((d, p), (False, False))))


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_when_the_bits_leave_nothing_out(spark, monkeypatch, edits):
    monkeypatch.setattr(line_dedup, "WORDS", 1)
    test_lines(spark, edits)


def shuffled(spark, run):
    """Bytes that run's stages write to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()
    stages = lambda: [(s.stageId(), s.shuffleWriteBytes()) for s in (found.apply(i) for found in [store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)] for i in range(found.size()))]
    before = max((k for k, _ in stages()), default=-1)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages() if k > before)


def test_lines_without_a_like_are_not_shuffled(spark):
    r = random.Random(8)
    lines = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(1000)) for _ in range(500)]
    lines[300] = lines[7][:400] + "x" + lines[7][401:]
    frame = spark.createDataFrame(list(enumerate("\n".join(lines[i : i + 5]) for i in range(0, 500, 5))), "doc_id long, text string")
    got = []
    assert shuffled(spark, lambda: got.extend(line_report(frame).collect())) < 0.2 * sum(len(x.encode()) for x in lines)
    assert {(x.doc_id, x.dropped) for x in got if x.dropped} == {(60, "0")} and sum(x.n_near for x in got) == 1


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    r = random.Random(edits)
    rows = [(a, edited(r, a, r.randint(0, 5))) for a in ("".join(r.choice("abcdé") for _ in range(r.randint(0, 30))) for _ in range(400))]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", banded_distance("a", "b", edits).alias("d")).collect()
    assert all(min(x.d, edits + 1) == min(distance(x.a, x.b), edits + 1) for x in got)
