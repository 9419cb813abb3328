"""Circulant MinHash against all pairs, and texts made to defeat polynomial hashes."""

import random
import re

import numpy as np
import pytest

from fieldcast.llm import bwt_dedup, circulant, ngram_join, shingles
from fieldcast.llm.common import keyed_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(shingle_set(t), []).append(d)
    names = [s for s in sets if s]
    root = {s: s for s in names}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(names):
        for b in names[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for s in names:
        least.setdefault(find(s), []).extend(sets[s])
    low = {r: min(m, key=lambda d: (d is not None, d or 0)) for r, m in least.items()}
    out = [(d, len(s), low[find(s)] if s else d) for d, t in rows for s in [shingle_set(t)]]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéXY") for _ in range(rng.randrange(1, 7)))
    passage = [word() for _ in range(30)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "a b c d"), (7, "a b c d a b c d"), (None, "one two")]
    bases = [[word() for _ in range(rng.choice((5, 20, 80, 200)))] for _ in range(12)]
    for i in range(10, n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.4:
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append((i, " ".join(w)))
    return rows + rows[20:23]


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"cell_shingles": 500, "few_members": 3, "pair_run": 3})])
def test_groups_are_exact(spark, seed, more):
    rows = made(seed, 160)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, name int, mark string").repartition(3)
    assert sorted(map(tuple, circulant.near_duplicates(df, **more).collect()), key=str) == brute(rows)
    assert circulant.near_duplicates(df.limit(0)).count() == 0


def test_text_ids_and_a_very_long_text(spark):
    long = " ".join(f"v{i % 997}u{i}" for i in range(30_000))
    rows = [("b", long + " end"), ("a", "START " + long), (None, "other"), ("", "other"), ("c", long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    want = {"a": "a", "b": "a", None: None, "": None, "c": "c"}
    assert {r["doc_id"]: r["component_id"] for r in circulant.near_duplicates(df).collect()} == want
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()} == want


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    for union, common in ((5, 4), (50, 40), (400, 320)):
        a, b = [], []
        for _ in range(400):
            u = rng.integers(0, 1 << 64, union, np.uint64)
            a.append(np.sort(u[: common + (union - common) // 2]))
            b.append(np.sort(np.concatenate([u[:common], u[common + (union - common) // 2 :]])))
        x, y = circulant.signatures(a), circulant.signatures(b)
        agree = (x == y).mean(1)
        assert abs(agree.mean() - common / union) < 0.01 and agree.std() < 0.04 and agree.min() * 200 > circulant.AGREE
        assert ((circulant.band_keys(x) == circulant.band_keys(y)).sum(1) > 0).all()


def thue_morse(k, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << k))


def test_texts_that_share_nothing(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64 for every base."""
    rows = [(1, thue_morse(10, "ab")), (2, thue_morse(10, "ba")), (3, f"p q {thue_morse(11, 'ab')} r s"), (4, f"p q {thue_morse(11, 'ba')} r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(df).collect()) == [(i, i, 0) for i in (1, 2, 3, 4)]
    assert sorted((r["doc_id"], r["component_id"]) for r in circulant.near_duplicates(df).collect()) == [(i, i) for i in (1, 2, 3, 4)]
    got = {r["doc_id"]: r["n_removed"] for r in bwt_dedup.remove_repeats(df).collect()}
    windows = [{t[i : i + 50] for i in range(len(t) - 49)} for _, t in rows]
    for k, (d, t) in enumerate(rows):
        before = set().union(*windows[:k])
        hit = {i + j for i in range(len(t) - 49) if t[i : i + 50] in before for j in range(50)}
        assert got[d] == len(hit)


def test_keyed_words_see_each_byte_and_place():
    text = np.frombuffer(b"x" * 200 + b"y" + b"x" * 200, np.uint8)
    starts = np.concatenate([np.zeros(401, np.int64), np.arange(1, 401)])
    ends = np.concatenate([np.arange(1, 402), np.full(400, 401)])
    h = keyed_words(text, starts, ends, 0)
    strings = [text[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(h.tolist())) == len(set(strings)) and (h != keyed_words(text, starts, ends, 1)).all()


def test_names_that_meet_are_told_apart(spark):
    known = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 2), (4, 8, 3), (5, None, 0)], "doc_id long, name long, check long")
    apart, names = shingles.told_apart(known)
    got = {r["doc_id"]: r["name"] for r in apart.collect()}
    assert got[1] != got[2] == got[3] != 7 and got[4] == 8 and got[5] is None and set(names.moved) == {(7, 1), (7, 2)}
    s = np.array([3, 9], np.uint64)
    first = shingles.Names().of(s, 5)
    assert shingles.Names({(first, 5): 77}).of(s, 5) == 77 and shingles.Names({(first, 5): 77}).of(s, 6) == first
