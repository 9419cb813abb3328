"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from fieldcast.llm import ngram_join
from fieldcast.llm.components import components
from fieldcast.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, n_links) by comparing all distinct sets."""
    sets = {}
    for d, t in rows:
        sets.setdefault(frozenset(shingles(t)), []).append(d)
    names = [s for s in sets if s]
    root = list(range(len(names)))
    count = [len(sets[s]) - 1 for s in names]

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(names):
        for j in range(i):
            b = names[j]
            if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
                count[i] += len(sets[b])
                count[j] += len(sets[a])
    least = {}
    for i, s in enumerate(names):
        r = find(i)
        least[r] = min([least.get(r, sets[s][0]), *sets[s]], key=lambda d: (d is not None, d or 0))
    comp = {s: least[find(i)] for i, s in enumerate(names)}
    links = dict(zip(names, count))
    return sorted(((d, len(s), comp.get(s, d), links.get(s, 0)) for d, t in rows for s in [frozenset(shingles(t))]), key=str)


def made(seed, n=150):
    """Families of near copies around the threshold, passages that many share, edge texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéXY") for _ in range(rng.randrange(1, 7)))
    passage = [word() for _ in range(30)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "a b c d e"), (7, "a b c d e a b c d e"), (None, "one two")]
    bases = [[word() for _ in range(rng.choice((6, 20, 80, 200)))] for _ in range(12)]
    for i in range(10, n):
        w = list(rng.choice(bases))
        if rng.random() < 0.2:
            w = [word() for _ in range(40)]
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.4:
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append((i, " ".join(w)))
    return rows + rows[20:23]


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"bucket_shingles": 300, "cell_shingles": 500, "few_members": 3, "pair_run": 3}), (3, {"cell_shingles": 2000})])
def test_join_is_exact(spark, seed, more, monkeypatch):
    if more:
        whole = ngram_join.heavy_shingles
        monkeypatch.setattr(ngram_join, "heavy_shingles", lambda t, b, w: whole(t, b, w, least=3))
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, name int").repartition(3)
    got = ngram_join.jaccard_components(df, **more).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    got = ngram_join.jaccard_components(df, **more, links=False).collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:3] for r in brute(rows)), key=str)


def test_join_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = ngram_join.jaccard_components(df).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_tree_finds_all_within_the_bound():
    rng = np.random.default_rng(4)
    base = rng.poisson(5, (20, ngram_join.GROUPS))
    points = np.abs(base[rng.integers(0, 20, 700)] + rng.integers(-1, 2, (700, ngram_join.GROUPS))).astype(np.int32)
    sizes = points.sum(1)
    tree = ngram_join.RTree(points, sizes)
    for i in range(0, 700, 7):
        bound = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero((7 * bound >= 3 * (sizes + sizes[i])))
        assert sorted(tree.search(points[i], int(sizes[i])).tolist()) == want.tolist()


def test_inner_nodes_are_pruned(spark):
    """A large group of near copies of many sizes, with a passage in all: its trees have levels, and nodes go unread."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    sets = []
    for k in range(1500):
        w = base[: rng.choice((60, 90, 140, 220, 330))]
        for _ in range(3):
            w = w[: (at := rng.randrange(len(w)))] + [f"x{rng.randrange(10**6)}"] + w[at + 1 :]
        sets.append(shingle_sets(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w).encode())]))[0])
    cell = ngram_join.TreeCell(np.arange(len(sets)), sets, np.ones(len(sets), np.int64))
    assert len(cell.tree.levels) > 1
    out = cell.own_links(True)
    assert cell.tree.visited > 1500 and cell.tree.pruned > 0.3 * cell.tree.visited
    n = {a: k for a, b, k in out if k}
    full = [set(s.tolist()) for s in sets[:1500]]
    for i in range(0, 1500, 150):
        want = sum(j != i and 7 * len(full[i] & b) >= 3 * (len(full[i]) + len(b)) for j, b in enumerate(full))
        assert n.get(i, 0) == want


def test_very_long_text(spark):
    long = " ".join(f"v{i % 9973}u{i}" for i in range(60_000))
    rows = [(1, long + " end"), (2, "START " + long), (3, "other"), (4, long[: len(long) // 2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_links int")
    assert [tuple(r)[2:] for r in sorted(ngram_join.jaccard_components(df).collect())] == [(1, 1), (1, 1), (3, 0), (4, 0)]


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(-7, 500 + i) for i in range(30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_frequent_shingles_beyond_half_a_million(spark):
    """600,000 shingles of 8 documents each: all are known as frequent, or each would tie its documents unchecked."""
    text = " ".join(map(str, range(600_004)))
    heavy = ngram_join.heavy_shingles(spark.createDataFrame([(text,)] * 8, "_text string").repartition(4), 2, 5)
    s = shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
    assert len(s) == 600_000 and (heavy.of(s) >= 3).all()
