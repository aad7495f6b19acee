from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np

from tests.llm import edge
from tidepool.llm import dartminhash
from tidepool.llm.components import components
from tidepool.llm.dartminhash import Settings, block_links, distinct_documents, near_duplicates, sign, signatures


def by_row(rows: list[tuple]) -> list:
    """Class of each row by all pairs, named by its smallest id: equal word sequences, or sets of five words with a Jaccard similarity of 0.8."""
    words = [(t or "").encode().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in words]
    root = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            n = len(sets[x] & sets[y])
            if (words[x] and words[x] == words[y]) or (sets[x] and n >= 0.8 * (len(sets[x]) + len(sets[y]) - n)):
                old, new = root[x], root[y]
                root = [new if r == old else r for r in root]
    names = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    return [names[r] for r in root]


def brute(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    return {i: c for (i, _), c in zip(rows, by_row(rows))}


def test_signatures_agree_as_often_as_weighted_sets_do():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(40):
        elements = rng.integers(0, 2**63, 250).astype(np.uint64)
        a = 1 + 4 * rng.random(250)
        b = np.where(rng.random(250) < 0.6, a, 1 + 4 * rng.random(250))
        s = signatures(np.repeat([0, 1], 250), np.concatenate([elements, elements]), np.concatenate([a, b]), 2, 256)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2**63, 90).astype(np.uint64)
    w = 1 + rng.random(90)
    whole = signatures(np.repeat([0, 1, 2], 30), e, w, 3, 64)
    assert (whole[1] == signatures(np.zeros(30, np.int64), e[30:60], w[30:60], 1, 64)[0]).all()


def test_one_shingle_fills_every_coordinate():
    s = signatures(np.array([0]), np.array([7], np.uint64), np.array([1.0]), 2, 288)
    assert (s[0] < np.iinfo(np.int64).max).all() and (s[1] == np.iinfo(np.int64).max).all()


def corpus() -> list[tuple[int, str]]:
    rng = random.Random(4)
    rows: list[tuple[int, str]] = []
    for g in range(12):
        base = edge.prose(100 + g, 160).split()
        for k in range(rng.choice([1, 2, 5, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                words[rng.randrange(len(words))] = rng.choice(edge.WORDS)
            rows.append((len(rows) + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(edge.documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_texts_and_their_repeated_selves_are_one_class(spark):
    rows = []
    for g in range(8):
        for times in (1, 2, 4, 16):
            rows.append((len(rows) + 1, " ".join([edge.prose(400 + g, 300)] * times)))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(edge.documents(spark, rows, extra=False)).collect()}
    assert got == brute(rows) and len(set(got.values())) == 8


def test_pairs_of_crowded_buckets_are_compared(spark):
    rng = random.Random(8)
    shared, rows = edge.prose(300, 150).split(), []
    for g in range(16):
        base = shared + edge.prose(301 + g, 50).split()
        for _ in range(40 if g == 0 else 2):
            words = list(base)
            words[rng.randrange(len(words))] = rng.choice(edge.WORDS)
            rows.append((len(rows) + 1, " ".join(words)))
    df, settings = edge.documents(spark, rows, extra=False), Settings(bands=2, rows=1)
    keys = {r["doc_id"]: set(r["keys"]) for r in sign(df, settings, ["doc_id"], "text").collect()}
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df, settings=settings).collect()}
    want = brute(rows)
    assert all(want[got[i]] == want[i] for i in got)
    pairs = [(i, i + 1) for i in range(41, len(rows), 2) if keys[i] & keys[i + 1] and want[i] == want[i + 1]]
    assert len(pairs) > 10 and all(got[i] == got[j] for i, j in pairs)


def test_blocks_equal_all_pairs():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**62, 60) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(b, rng.integers(45, 61), replace=False), rng.integers(0, 2**62, rng.integers(0, 9))])) for b in base for _ in range(25)]
    offsets, grams, node = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets), np.arange(100)
    same = [(a, b) for a in range(100) for b in range(a) if (n := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    for right in (np.zeros(100, bool), rng.random(100) < 0.5):
        both = right.any()

        def classes(links):
            parent = list(range(100))
            for a, b in links * 100:
                parent[a] = parent[b] = min(parent[a], parent[b])
            return parent

        found = block_links(node, node, right, offsets, grams, 0.8)
        assert classes(found) == classes([(a, b) for a, b in same if not both or right[a] != right[b]]) and found


def test_edge_rows(spark):
    rows = near_duplicates(edge.documents(spark)).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in rows) == Counter(zip((i for i, _ in edge.TEXTS), by_row(edge.TEXTS)))
    assert near_duplicates(edge.empty(spark)).count() == 0 and distinct_documents(edge.empty(spark)).count() == 0


def test_ids_of_any_type_that_repeat_or_are_null(spark):
    """Rows are judged each by its own text; ids are strings here, one of them has two texts, some rows have none."""
    rows = [(f"d{i % 30}" if i % 9 else None, t) for i, t in corpus()] + [("x", edge.prose(900, 60)), ("x", edge.prose(901, 60)), ("a", edge.prose(901, 60) + " end"), ("x", edge.prose(901, 60))]
    df = spark.createDataFrame(rows, "name string, text string")
    want = Counter(zip((i for i, _ in rows), by_row(rows)))
    assert Counter((r["name"], r["class_id"]) for r in near_duplicates(df, id_col="name").collect()) == want
    kept = distinct_documents(df, id_col="name")
    assert kept.columns == ["name", "text"]
    named = Counter(r["name"] for r in kept.collect())
    classes = {(c, frozenset(i for (i, _), d in zip(rows, by_row(rows)) if d == c)) for c in by_row(rows) if c is not None}
    assert {n for n in named if n} == {c for c, _ in classes} and named["x"] == 1


def test_a_crowd_in_many_small_blocks(spark, monkeypatch):
    """Blocks of 300 shingles, so that pairs lie across blocks, rungs and labels."""
    rng = random.Random(12)
    base, made = edge.prose(500, 130).split(), []
    for k in range(70):
        words = base[: 60 + 10 * rng.randrange(8)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(edge.WORDS)
        made.append((k, " ".join(words)))
    sets = {k: {hash(tuple(t.split()[i : i + 5])) for i in range(len(t.split()) - 4)} for k, t in made}
    monkeypatch.setattr(dartminhash, "BLOCK", 300)
    apart = spark.createDataFrame([(1 + k % 2, k, k) for k in sets] + [(2, k, k) for k in sets if k % 7 == 0], "key bigint, node bigint, label bigint")
    grams = spark.createDataFrame([(k, sorted(g)) for k, g in sets.items()], "id bigint, grams array<bigint>")
    links = [(r["a"], r["b"]) for r in dartminhash._crowd_links(apart, grams, 0.8).collect()]
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = []
    for pairs in (links, alike):
        root = list(sets)
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        roots.append(root)
    assert set(links) <= set(alike) and roots[0] == roots[1]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = list(range(400))
    for _ in range(400):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: parent[v] for e in edges for v in e}
    groups = defaultdict(set)
    for v, label in got.items():
        groups[label].add(v)
    assert all(min(g) == label for label, g in groups.items())
