"""The Merkle manifest against a plain recursive one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldcast.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest int, grp int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, siblings of each node, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute(rows, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r[:5])))
        trees[s] = tree([leaf_of(r[:5]) for r in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(groups[s], trees[s][1]):
            node = leaf_of([*r[:4], changed(r[4])])
            others = ""
            for place, run in path + top:
                others += "".join(run)
                node = H(*run[:place], node, *run[place:])
            out.append((r[0], s, leaf_of(r[:5]), trees[s][0], root, H(others), node, node == root))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "é", "Z", None, "", f"s{i % 40}"]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "Ab", "é x", "same", "A" * 5000]), 1, 2) for i in range(n)]
    return rows + rows[3:6] + [(None, "a", None, None, None, 1, 2), (None, "a", None, None, "t", 1, 2), (2**60 + 1, "a", None, None, "big", 1, 2)]


@pytest.mark.parametrize(("seed", "n", "levels"), [(1, 900, 1), (2, 40, 3), (3, 700, 2)])
def test_manifest_is_exact(spark, seed, n, levels):
    rows = made(seed, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.manifest(df, "doc_id", "source", FIELDS, {"text": F.lower("text")}, levels=levels, proofs=True).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == brute(rows, lambda t: t and t.lower())
    assert not all(r["verified"] for r in got)
    for r in got[::50]:
        assert merkle.fold(r["leaf"], r["places"], r["others"]) == r["root"] and merkle.digest("".join(x) for x in r["others"]) == r["proof_sha256"]


def test_unchanged_rows_verify_and_lone_leaves(spark):
    df = spark.createDataFrame([(1, "a", None, 1, "t", 0, 0)], SCHEMA)
    (r,) = merkle.manifest(df, "doc_id", "source", FIELDS).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == H()
    assert merkle.manifest(df.limit(0), "doc_id", "source", FIELDS).count() == 0
    text_ids = spark.createDataFrame([("x", 7), ("y", None), ("z", 7)], "doc_id string, source int")
    got = {r["doc_id"]: r for r in merkle.manifest(text_ids, "doc_id", "source", ["doc_id"]).collect()}
    assert got["y"]["source"] is None and got["x"]["source"] == 7 and got["x"]["subroot"] == H(leaf_of(["x"]), leaf_of(["z"])) and got["x"]["root"] == H(leaf_of(["y"]), got["x"]["subroot"])
