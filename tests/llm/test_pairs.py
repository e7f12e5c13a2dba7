"""Operators that compare texts or vectors with each other, and the pipeline."""

import random
import re
import string
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import _graph, hnsw_dedup, ngram_join, suffix_dedup
from quillon.llm._graph import components
from quillon.llm.decontaminate import Canonical, contamination, drop_contaminated
from quillon.session import Scratch

LOREM = "plain words of no question at all "
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
CLASH = "doc_id long, text string, comp long, doc string, n int, `__gone` long, `__cuts` string, scope long"


def words(text):
    return [w.translate(LOW) for w in WORD.findall(text or "")]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "d", 2, 3, "c", 4) for i, t in rows], CLASH)


def _corpus(seed, n=120):
    """Random texts, copies, near copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ab", "cd", "ef", "gh", "ij", "kl") for b in ("mn", "op", "qr", "st", "uv")] + ["Über", "naïve"]
    draw = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [draw(70) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = rng.random()
        text = draw(rng.randint(1, 120))
        if kind < 0.2 and rows:
            text = (rng.choice(rows)[1] or "x").split()
        elif kind < 0.5 and rows:
            text = [w if rng.random() > 0.05 else rng.choice(vocabulary) for w in (rng.choice(rows)[1] or "x").split()]
        elif kind < 0.65:
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(shared) + text[at:]
        rows.append((i, " ".join(text)))
    rows += [(n, None), (n + 1, ""), (n + 2, "..."), (None, rows[0][1]), (5, rows[5][1]), (6, "another text of the same id"), (n + 3, "word " * 60_000), (n + 4, "word " * 60_000), (n + 5, "WORD " * 60)]
    return rows


# components


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7), (None, 3), (3, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] and None not in e for e in edges)}


@pytest.mark.parametrize("edges", [1 << 20, 64, 3])
def test_forests_connect_what_their_edges_connect(monkeypatch, edges):
    monkeypatch.setattr(_graph, "EDGES", edges)
    rng = np.random.default_rng(edges)
    for nodes, many in ((40, 30), (300, 200), (300, 5000), (2, 9)):
        u, v = rng.integers(-nodes, nodes, many), rng.integers(-nodes, nodes, many)
        u, v = np.append(u[u != v], 10_000 + np.arange(200)), np.append(v[u != v], 10_001 + np.arange(200))
        batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 50]), pa.array(v[i : i + 50])], names=["u", "v"]) for i in range(0, len(u), 50)]
        got = list(_graph._contract(iter(batches)))
        x, y = np.concatenate([b.column(0).to_numpy() for b in got]), np.concatenate([b.column(1).to_numpy() for b in got])
        assert (x > y).all() and (edges < 1 << 20 or len(x) < len(np.unique(np.append(u, v))))

        def least(a, b):
            label = {int(n): int(n) for n in np.append(u, v)}
            while True:
                before = dict(label)
                for i, j in zip(a.tolist(), b.tolist()):
                    label[i] = label[j] = min(label[i], label[j])
                if label == before:
                    return label

        assert least(x, y) == least(u, v)
    assert list(_graph._contract(iter([]))) == []


# n-gram Jaccard join


def _grams(text, n):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def _slow_join(rows, n, t):
    out = {}
    sets = [(i, _grams(x, n)) for i, x in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i != j and len(a & b) / len(a | b) >= t - 1e-12:
                key = (min(i, j), max(i, j))
                out[key] = max(out.get(key, 0), round(len(a & b) / len(a | b), 9))
    return out


@pytest.mark.parametrize("seed,n,t,docs,grams", [(1, 3, 0.5, 2048, 1 << 21), (2, 2, 0.7, 3, 1 << 21), (3, 1, 0.4, 2048, 150)])
def test_join_is_that_of_brute_force(spark, monkeypatch, seed, n, t, docs, grams):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    rows = _corpus(seed)
    pairs = ngram_join.ngram_jaccard_join(_docs(spark, rows), n, t)
    assert all(r["doc_a"] < r["doc_b"] for r in pairs.collect())
    got = {(r["doc_a"], r["doc_b"]): round(r["jaccard"], 9) for r in ngram_join.expand(pairs).collect()}
    assert got == _slow_join(rows, n, t)


def test_a_short_text_of_a_repeated_id_has_its_copy(spark):
    long, short = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(20))
    rows = [(7, long), (7, short), (9, short), (8, long + " more"), (5, "one two three four"), (5, "one two three four")]
    pairs = ngram_join.ngram_jaccard_join(_docs(spark, rows))
    assert {(r["doc_a"], r["doc_b"]): round(r["jaccard"], 9) for r in pairs.collect()} == _slow_join(rows, 3, 0.5) != {}
    assert {r["doc_id"] for r in ngram_join.drop_near_duplicates(_docs(spark, rows)).collect()} == {5, 7}


def _slow_classes(rows, n, t):
    """{(id, set): (a document of its class with the least id, links, best)}, each id and set a document."""
    units = sorted({(i, _grams(x, n)) for i, x in rows if i is not None and _grams(x, n)}, key=lambda u: (u[0], sorted(u[1])))
    links, best, parent = Counter(), {}, {u: u for u in units}

    def root(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for k, u in enumerate(units):
        for v in units[:k]:
            j = len(u[1] & v[1]) / len(u[1] | v[1])
            if j >= t - 1e-12:
                for w in (u, v):
                    links[w] += 1
                    best[w] = max(best.get(w, 0), j)
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b, key=lambda x: x[0])] = min(a, b, key=lambda x: x[0])
    return {u: (root(u), links[u], round(best[u], 9)) for u in best}


@pytest.mark.parametrize("seed,n,t,docs,grams", [(1, 3, 0.5, 2048, 1 << 21), (2, 2, 0.7, 3, 1 << 21), (3, 1, 0.4, 2048, 150)])
def test_classes_are_those_of_brute_force(spark, monkeypatch, seed, n, t, docs, grams):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    rng = random.Random(seed)
    rows = _corpus(seed)
    rows += [(rng.choice(rows[:100])[0], rng.choice(rows[:100])[1]) for _ in range(40)]  # ids with texts of others, some repeated
    got = ngram_join.near_duplicate_classes(_docs(spark, rows), n, t)
    assert got.columns == ["doc_id", "class_id", "n_links", "jaccard"]
    want = sorted((u[0], c[0], links, best) for u, (c, links, best) in _slow_classes(rows, n, t).items())
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], round(r["jaccard"], 9)) for r in got.collect()) == want


def test_near_duplicates_that_stay(spark):
    rows = _corpus(4)
    rows += [(7, rows[9][1]), (9, rows[7][1] + " more"), (9, rows[7][1])]
    classes = _slow_classes(rows, 3, 0.5)
    kept = ngram_join.drop_near_duplicates(_docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "comp", "doc", "n", "__gone", "__cuts", "scope"]
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert Counter(x for x in left if (x[0], _grams(x[1], 3)) not in classes) == Counter(x for x in rows if (x[0], _grams(x[1], 3)) not in classes)
    stay = Counter(classes[u][0] for u in {(i, _grams(x, 3)) for i, x in left if i is not None} if u in classes)
    assert stay == Counter({c: 1 for c, _, _ in classes.values()})
    assert all(classes[u][0][0] == u[0] for u in {(i, _grams(x, 3)) for i, x in left if i is not None} if u in classes)


def test_join_of_nothing(spark):
    assert ngram_join.near_duplicate_classes(_docs(spark, [])).count() == 0 and ngram_join.drop_near_duplicates(_docs(spark, [])).count() == 0
    assert ngram_join.ngram_jaccard_join(_docs(spark, [])).count() == 0
    assert ngram_join.ngram_jaccard_join(_docs(spark, [(1, None), (2, ""), (None, "a b c")])).count() == 0


# repeated passages


def _covered(rows, m):
    """doc -> positions of words in windows that an earlier document has, for ids with one text."""
    first, seen = {}, defaultdict(set)
    for i, x in rows:
        if i is not None:
            w = words(x)
            for k in range(len(w) - m + 1):
                seen[tuple(w[k : k + m])].add(i)
    for g, ids in seen.items():
        first[g] = min(ids)
    out = Counter()
    for i, x in rows:
        if i is None:
            continue
        w, mark = words(x), set()
        for k in range(len(w) - m + 1):
            f = first[tuple(w[k : k + m])]
            if f != i:
                mark |= {(f, p) for p in range(k, k + m)}
        for f, p in mark:
            out[i, f, p] = 1
    return set(out)


@pytest.mark.parametrize("seed,m,anchor,batch", [(1, 50, 10, 1 << 16), (2, 12, 4, 64), (3, 5, 2, 7)])
def test_passages_are_those_of_brute_force(spark, monkeypatch, seed, m, anchor, batch):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rows = [r for r in _corpus(seed) if r[0] != 6]
    got = set()
    for r in suffix_dedup.repeated_passages(_docs(spark, rows), m, anchor).collect():
        got |= {(r["doc_id"], r["first_doc"], p) for p in range(r["start_word"], r["start_word"] + r["n_words"])}
        assert r["n_words"] >= m
    assert got == _covered(rows, m)


def test_levels_stay_geometric():
    rng = np.random.default_rng(0)
    family = suffix_dedup.Family()
    for i in range(40):
        names = np.sort(rng.integers(0, 2**63, 10).astype(np.uint64))
        family.add(suffix_dedup.Level(names, np.arange(10) + 10 * i))
        sizes = [len(x.keys) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    assert sum(len(x.keys) for x in family.levels) == 400


def test_suffixes_are_in_the_order_of_their_words():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 500).astype(np.uint32) * np.uint32(0x01000100)
    starts = np.arange(490)
    level = suffix_dedup.Level.build(suffix_dedup.suffix_words(tokens, starts, 10, np.zeros(490, dtype=np.uint64)), starts)
    rows = [tuple(tokens[i : i + 10].tolist()) for i in starts]
    assert level.windows.tolist() == sorted(starts.tolist(), key=lambda i: (rows[i], i))
    lcp = [next((k for k in range(10) if rows[a][k] != rows[b][k]), 10) for a, b in zip(level.windows, level.windows[1:])]
    assert (level.lcp()[1:] - 2).tolist() == lcp
    low, high = (suffix_dedup.Level.build(suffix_dedup.suffix_words(tokens, x, 10, np.zeros(len(x), dtype=np.uint64)), x) for x in (starts[:200], starts[200:]))
    assert [rows[i] for i in low.merge(high).windows] == sorted(rows)
    first = {r: i for i, r in reversed(list(enumerate(rows[:200])))}
    assert low.scan(high.keys).tolist() == [first.get(rows[i], -1) for i in high.windows]


def test_batches_give_what_one_run_gives(spark, tmp_path):
    rows = [r for r in _corpus(6) if r[0] != 6]
    family = suffix_dedup.PassageFamily(spark, f"file://{tmp_path}/family", 12, 4)
    assert family.add(_docs(spark, [])).count() == 0
    got, sizes = [], []
    for lo, hi in ((0, 40), (40, 41), (41, 60), (60, 100), (100, 200)):
        got += [tuple(r) for r in family.add(_docs(spark, [r for r in rows if r[0] is None or lo <= r[0] < hi])).collect()]
        sizes = [n for _, n in family.levels()]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    assert sum(sizes) == len({r for r in rows if r[0] is not None})
    assert sorted(got) == sorted(tuple(r) for r in suffix_dedup.repeated_passages(_docs(spark, rows), 12, 4).collect())


def test_cut_leaves_the_first(spark):
    shared = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "before " + shared + " after"), (2, "Other text, " + shared + ". And more."), (3, shared), (4, None), (5, "clean text"), (None, shared)]
    docs = _docs(spark, rows)
    kept = suffix_dedup.cut_repeated_passages(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (2, "Other text, And more."), (4, None), (5, "clean text"), (None, shared)], key=str)
    assert suffix_dedup.cut_repeated_passages(_docs(spark, [])).count() == 0


# benchmark


QUESTIONS = [
    (1, "If Alice buys 12 apples at 3 dollars each and gives 4 apples to Bob, how much did Alice pay for the apples she kept?"),
    (2, "a train travels 60 km in 2 hours and then rests before it travels on to the next town by night"),
    (3, "too short"),
    (4, None),
    (5, "one two three"),
    (5, "one two three"),
]


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame([(i, t, 1) for i, t in QUESTIONS], "item_id long, text string, id int")
    swap = QUESTIONS[0][1].replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "45").replace("3 ", "7 ")
    mixed = "If Ann buys 1 apples at 2 dollars each and gives 3 apples to Ben, how much did Cid pay for the apples she kept?"
    rows = [
        (10, "Intro text. " + QUESTIONS[0][1] + " Outro."),
        (11, "x " + swap),
        (12, QUESTIONS[1][1].upper()),
        (13, QUESTIONS[1][1].replace("60 km", "80 miles")),
        (14, "a train travels 60 km"),
        (15, "nothing of the kind is asked here at all, in spite of its length and of the number 12"),
        (16, "and one two three"),
        (17, None), (18, ""), (None, QUESTIONS[0][1]), (10, "again " + QUESTIONS[0][1]),
        (19, "word " * 50_000 + QUESTIONS[1][1]),
        (20, mixed),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["consistency"]) for r in contamination(_docs(spark, rows), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 2), (13, 2), (16, 5), (19, 2)} | ({(20, 1)} & set(got))
    assert got[10, 1] == (1.0, 1.0) == got[11, 1]
    strict = contamination(_docs(spark, rows), bench, consistency=1.0).collect()
    assert (20, 1) not in {(r["doc_id"], r["item_id"]) for r in strict}
    kept = drop_contaminated(_docs(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} >= {14, 15, 17, 18, None} and "__gone" in kept.columns
    assert contamination(_docs(spark, []), bench).count() == 0 and contamination(_docs(spark, rows), bench.where("false")).count() == 0


def test_refills_of_another_shape(spark):
    item = "Alice walks 250 km in 2 hours while Bob drives 60 km to see what Alice has bought for 3 dollars."
    refills = [("Alice", "Mary Ann"), ("250 km", "1,250km"), ("2 hours", "2.5 hours"), ("3 ", "3.50 ")]
    every = item
    for a, b in refills:
        every = every.replace(a, b)
    docs = [(i, "We ask this. " + item.replace(a, b)) for i, (a, b) in enumerate(refills)] + [(9, "We ask this. " + every)]
    got = contamination(_docs(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["coverage"], r["consistency"]) for r in got} == {(i, 1.0, 1.0) for i in (0, 1, 2, 3, 9)}
    c = Canonical(pa.array(["Mary Ann ran 1,250.5km. Bob", "7", ",5 a 12th", None]))
    assert c.template_kind.tolist() == [2, 0, 1, 3, 2, 1, 1, 0, 1] and c.literal_kind.tolist() == [0, 0, 0, 1, 3, 0, 1, 1, 0, 1]


def test_edited_questions(spark):
    w = [chr(97 + i // 26) + chr(97 + i % 26) + "q" for i in range(59)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, " ".join("z" + x for x in w[:17])), (3, " ".join("y" + x for x in w[:12]))], "item_id long, text string")
    short, least = ["z" + x for x in w[:17]], ["y" + x for x in w[:12]]
    rows = [
        (1, w[:20] + ["new"] + w[20:40] + w[41:]),
        (2, w[15:44]),
        (3, short[:8] + ["new"] + short[9:]),
        (4, least[:6] + ["new"] + least[7:]),
        (5, w[:12] + ["new"] * 300 + short[:7] + least[:4]),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in contamination(_docs(spark, [(i, "so " + " ".join(x) + " it ends") for i, x in rows]), bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_slots():
    c = Canonical(pa.array(["Alice runs 5 km on Monday", "km 7"]))
    assert c.template_kind.tolist() == [2, 0, 1, 3, 0, 2, 0, 1] and c.literal_kind.tolist() == [0, 0, 1, 3, 0, 0, 0, 1]


def _slow_contamination(docs, items, width=8, coverage=0.5, consistency=0.75, passage=20):
    """Windows, lines, chains, coverage and consistency, one at a time; streams come from `Canonical`, which has tests of its own."""

    def streams(rows):
        rows = [(i, t) for i, t in rows if i is not None and t is not None]
        c = Canonical(pa.array([t for _, t in rows], pa.string()))
        for stream in (0, 1):
            x = c.stream(stream)
            yield stream, [(i, x.values[a:b].tolist(), x.kind[a:b].tolist(), x.fill[a:b].tolist()) for (i, _), a, b in zip(rows, x.bounds, x.bounds[1:])]

    def windows(values, kind, size):
        return {k: tuple(values[k : k + size]) for k in range(len(values) - size + 1) if sum(x == 0 for x in kind[k : k + size]) >= min(3, size)}

    best = {}
    for (stream, d), (_, b) in zip(streams(docs), streams(items)):
        index, known = defaultdict(set), {}
        for n, (item, values, kind, fill) in enumerate(b):
            size = len(values) if len(values) <= width else min(max((len(values) - 1) // 2, min(width, 4)), width)
            if size >= 3:
                known[n] = (item, len(values), size, fill, kind, windows(values, kind, size))
                for k, w in known[n][5].items():
                    index[w].add((n, k))
        for doc, values, kind, fill in d:
            lines = defaultdict(lambda: (set(), set()))
            for size in {x[2] for x in known.values()}:
                for p, w in windows(values, kind, size).items():
                    for n, k in index.get(w, ()):
                        at, fills = lines[n, p - k]
                        at.add(k)
                        fills |= {(known[n][3][k + j], fill[p + j]) for j in range(size) if kind[p + j]}
            by_item = defaultdict(dict)
            for (n, off), line in lines.items():
                by_item[n][off] = line
            for n, found in by_item.items():
                item, total, size, _, _, every = known[n]
                chains, last = [], None
                for off in sorted(found):
                    if last is None or off - last > max(size, total // 2):
                        chains.append([])
                    chains[-1].append(found[off])
                    last = off
                tried = [(at, fills, True) for at, fills in found.values()] + [(set().union(*(x[0] for x in c)), set().union(*(x[1] for x in c)), False) for c in chains if len(c) > 1]
                for at, fills, single in tried:
                    covered = sorted({k + j for k in at for j in range(size)})
                    run = longest = 0
                    for x, y in zip([None, *covered], covered):
                        run = run + 1 if x is not None and y == x + 1 else 1
                        longest = max(longest, run)
                    share = max(len(at) / len(every), (len(covered) - size + 1) / (total - size + 1))
                    ratio = min(len({x for x, _ in fills}), len({y for _, y in fills})) / len(fills) if fills else 1.0
                    if ratio >= consistency and (share >= coverage or single and longest >= passage):
                        best[doc, item] = max(best.get((doc, item), (0, 0)), (round(share, 6), round(ratio, 6)))
    return best


def test_contamination_is_that_of_the_slow_way(spark, data):
    rng = random.Random(8)
    names, items = ["Ann", "Bob", "Mary Ann", "Zoë"], []
    draw = lambda k: [rng.choice(["walks", "buys", "gives", "the", "town", "apples", "far", "home", "km", "hours", "dollars"] + names + ["7", "1,250", "2.5", "60km"]) for _ in range(k)]
    for i in range(12):
        items.append((i, " ".join(draw(rng.randint(2, 60)))))
    items += [(12, None), (13, ""), (3, items[3][1])]
    docs = []
    for i in range(120):
        w = (rng.choice(items[:12])[1]).split()
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(w) - 1)
            w[k : k + rng.randint(0, 1)] = rng.choice([[], draw(1), [rng.choice(names)], [str(rng.randint(1, 9))]])
            w = w or ["x"]
        docs.append((i, " ".join(draw(rng.randint(0, 20)) + w + draw(rng.randint(0, 20)))))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, LOREM * 400 + " " + items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["consistency"]) for r in contamination(_docs(spark, docs), bench).collect()}
    want = _slow_contamination(docs, items)
    assert len(want) > 60 and got == want
    table, bench = (spark.read.parquet(f"{data}/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["consistency"]) for r in contamination(table, bench).collect()}
    want = _slow_contamination([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert want and got == want


def test_contamination_is_that_of_brute_force(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    index = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 7):
            index[tuple(w[k : k + 8])].add((i, k))
    want = set()
    for r in docs.select("doc_id", "text").collect():
        lines, w = defaultdict(set), words(r["text"])
        for p in range(len(w) - 7):
            for i, k in index.get(tuple(w[p : p + 8]), ()):
                lines[i, p - k].add(k)
        want |= {(r["doc_id"], i) for (i, _), ks in lines.items() if len(ks) >= 0.5 * (len(items[i]) - 7)}
    got = {(r["doc_id"], r["item_id"]) for r in contamination(docs, bench).collect()}
    assert want and want <= got and len(got - want) == 0


# embeddings


def _vectors(seed, n=1500, d=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(0, 400, 4):
        x[i + 1] = x[i] + rng.normal(0, 0.05, d)
    x[500:700] = x[500] + rng.normal(0, 0.03, (200, d))
    x[700:720] = x[700]
    return x


def _slow_groups(ids, x, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= t
    comp = np.arange(len(x))
    for i in range(len(x)):
        todo = [i] if comp[i] == i else []
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & (comp > i)):
                comp[j] = i
                todo.append(j)
    sizes = Counter(comp.tolist())
    return {ids[i]: ids[comp[i]] for i in range(len(x)) if sizes[comp[i]] > 1}


@pytest.mark.parametrize("shard_rows", [16384, 300])
def test_groups_are_those_of_brute_force(spark, shard_rows):
    x = _vectors(1)
    rows = [(i, [float(v) for v in r], 3, "s") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, shard string")
    got = hnsw_dedup.near_duplicates(df, 0.95, beam=16, shard_rows=shard_rows).collect()
    want = _slow_groups(list(range(len(x))), x.astype(np.float32).astype(np.float64), 0.95)
    found = {r["vec_id"]: r["group_id"] for r in got}
    assert sum(found.get(k) == v for k, v in want.items()) >= 0.98 * len(want) and set(found) <= set(want)
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    small = [r for r in got if links[r["vec_id"]] <= 12]
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got) and sum(r["n_links"] == links[r["vec_id"]] for r in small) >= 0.98 * len(small) > 90
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] >= 19 for i in range(700, 720))
    assert by[705]["nearest_id"] == 700 and by[700]["nearest_id"] == 701 and by[700]["cosine"] == 1.0


def test_groups_of_the_whole_table_are_those_of_brute_force(spark, data):
    """At a threshold that the random vectors of this table reach; at that of the query they have no pair."""
    df = spark.read.parquet(f"{data}/sf0.01/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    order = np.argsort(ids)
    for t in (0.4, 0.9):
        want = _slow_groups([ids[i] for i in order], x[order], t)
        found = {r["vec_id"]: r["group_id"] for r in hnsw_dedup.near_duplicates(df, t, shard_rows=200).collect()}
        assert set(found) <= set(want) and sum(found.get(k) == v for k, v in want.items()) >= 0.95 * len(want)
        assert want or t == 0.9


@pytest.mark.parametrize("n", [1500, 6000])
def test_a_vector_asks_few_shards(spark, monkeypatch, n):
    """As many whatever their number; and the links of a group larger than a beam are whole."""
    x, asked, ask = _vectors(3, n=n), [], hnsw_dedup._asks
    monkeypatch.setattr(hnsw_dedup, "_asks", lambda *a: (asked.append(ask(*a).count()), ask(*a))[1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["group_id"], r["n_links"]) for r in hnsw_dedup.near_duplicates(df, 0.95, beam=16, shard_rows=100).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    want = _slow_groups(list(range(n)), u, 0.95)
    assert sum(got.get(k) == (v, links[k]) for k, v in want.items()) >= 0.97 * len(want) and set(got) <= set(want)
    assert len(asked) == 1 and asked[0] <= 8 * n


def test_a_saved_table_leaves_no_shuffle_files(spark):
    """Even while its plan is still referred to."""
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") if "shuffle_" in x}
    before = files()
    plan = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count().repartition(3, "k")
    saved = Scratch(spark).save(plan)
    end = time.time() + 5
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert saved.count() == plan.count() == 997 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_audit_sees_small_groups(spark):
    truth = spark.createDataFrame([(1, b) for b in range(100, 200)] + [(2, 3), (4, 5)], "a long, b long")
    found = spark.createDataFrame([(1, 100), (5, 9)], "a long, b long")
    groups = spark.createDataFrame([(1, 1)] + [(b, 1) for b in range(100, 200)] + [(5, 5), (9, 5)], "node long, comp long")
    assert abs(hnsw_dedup.audit_recall(truth, found, groups) - 1 / 3) < 1e-9 and hnsw_dedup.audit_recall(truth.where("false"), found, groups) == 1.0
    x = _vectors(2, n=900)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = hnsw_dedup._truth(df, 0.95, 8, 40, 512, Scratch(spark))
    assert got.select("a").distinct().count() >= 40


def test_beams_find_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = hnsw_dedup.Index.load(hnsw_dedup.Index(x).dump())
    found, _ = index.search(x[:300], 64)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), true.tolist())]) >= 0.9
    assert (index.search(x[:20], 3000)[0][:, :10] == true[:20]).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, 1.0]), (1, [1.0, 0.0]), (10, [2.0, 0.01])]
    schema = "vec_id long, embedding array<float>"
    long = [float(i % 7) for i in range(20_000)]
    wide = spark.createDataFrame([(1, long), (2, long), (3, long[1:] + [9.0])], schema)
    assert [r["vec_id"] for r in hnsw_dedup.near_duplicates(wide, 0.99).orderBy("vec_id").collect()] == [1, 2]
    got = [tuple(r) for r in hnsw_dedup.near_duplicates(spark.createDataFrame(rows, schema)).orderBy("vec_id").collect()]
    assert [g[:3] for g in got] == [(1, 1, 2), (2, 1, 1), (10, 1, 1)]
    assert hnsw_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        hnsw_dedup.near_duplicates(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


# pipeline


def test_pipeline_keeps_what_each_stage_should(spark, tmp_path):
    rng = random.Random(1)
    text = lambda k, tag: " ".join(f"{tag}{rng.randint(0, 9999)}x" for _ in range(k))
    shared, item = text(60, "s"), text(30, "q")
    base = text(80, "n")
    rows = [
        (1, text(50, "a")), (2, "You are a stupid idiot. " + text(40, "b")), (3, base), (4, base + " more"), (5, text(70, "c") + " " + shared), (6, text(75, "d") + " " + shared),
        (7, text(20, "e") + " " + item + " " + text(20, "f")), (8, None), (9, ""), (10, "Say no to " + text(5, "g")),
    ]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"]: r for r in docs.collect()})
    every = {i for i, _ in rows}
    assert [set(x) for x in left] == [every - {2}, every - {2, 4}, every - {2, 4}, every - {2, 4, 7}]
    assert shared in left[2][5]["text"] and shared not in left[2][6]["text"] and left[2][6]["n_chars"] == len(left[2][6]["text"])
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == every - {2, 4, 7} and all(r["exact"] for r in out.values())


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, ties, very long texts and columns whose names the stages use themselves, stage by stage."""
    rng = random.Random(3)
    text = lambda k, tag: " ".join(f"{tag}{rng.randint(0, 9999)}x" for _ in range(k))
    long, plain, item = text(30_000, "l"), text(40, "p"), text(30, "q")
    rows = [
        (None, plain), (None, "You are a stupid idiot."), (None, None), (1, long), (2, long), (2, long), (3, "you are a stupid idiot " + text(60, "t")), (3, text(60, "u")), (4, plain), (4, plain), (5, plain + " end"),
        (6, ""), (6, ""), (7, "..."), (8, item + " " + item), (9, "so " + item), (9, text(50, "w")), (10, None),
    ]
    extra = "score double, __gone long, __sig long, __cuts string, __read string, comp long, doc string, tokens string"
    spark.createDataFrame([(i, t, None, "src", None if t is None else len(t), 0.5, 1, 2, "c", "r", 3, "d", "x") for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        left.append(Counter((r["doc_id"], None if r["text"] is None else r["text"][:40]) for r in docs.collect()))
    cut = lambda t: None if t is None else t[:40]
    every = Counter((i, cut(t)) for i, t in rows)
    tame = every - Counter([(None, cut(rows[1][1])), (3, cut(rows[6][1]))])
    assert left[0] == tame
    unique = tame - Counter([(2, cut(long))] * 2 + [(5, cut(plain)), (9, cut("so " + item))])  # the item of 9 is most of 8
    assert left[1] == unique
    assert left[2] == unique
    assert left[3] == unique - Counter([(8, cut(item))])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == sum(left[3].values()) and all(r["exact"] for r in out) and {r["n_tokens"] for r in out if r["doc_id"] in (6, 10)} == {0}


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
