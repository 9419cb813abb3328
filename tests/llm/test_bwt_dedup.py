"""Repeat removal against direct search of all strings."""

import random

import numpy as np
import pytest

from fieldcast.llm import bwt_dedup


def brute(rows, k):
    least = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    rank = lambda d: (d is not None, d or 0)
    for d, x in data:
        for i in range(len(x) - k + 1):
            s = x[i : i + k]
            if s not in least or rank(d) < least[s]:
                least[s] = rank(d)
    out = []
    for d, x in data:
        gone = [False] * len(x)
        for i in range(len(x) - k + 1):
            if least[x[i : i + k]] < rank(d):
                gone[i : i + k] = [True] * k
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), runs, bytes(c for c, g in zip(x, gone) if not g)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [text(n) for n in (48, 49, 50, 51, 70, 120, 400)]
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 300), (5, "y" + "x" * 120), (None, shared[-1]), (6, "ab" * 100), (7, "ba" * 100)]
    for i in range(8, 70):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(1, 90)) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "".join(parts)))
    rows += [(i + 1000, rng.choice(rows[8:])[1]) for i in range(10)] + [rows[20], (9, "same id " + shared[4])]
    return rows


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"bucket_strings": 200, "few_bytes": 1, "few_rows": 1})])
def test_removal_is_exact(spark, seed, more, monkeypatch):
    if more:
        whole = bwt_dedup._marks
        monkeypatch.setattr(bwt_dedup, "_marks", lambda s, b, g, n: whole(s, b, g, n, shard_strings=64))
    rows = made(seed)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, rk string").repartition(3)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in bwt_dedup.remove_repeats(df, **more).collect()]
    assert sorted(got, key=str) == brute(rows, 50)


def test_removal_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in bwt_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()], 50)
    assert bwt_dedup.remove_repeats(df.limit(0)).count() == 0


def test_merge_is_the_suffix_order():
    rng = np.random.default_rng(0)
    shards, strings = [], []
    for _ in range(5):
        lens = rng.integers(50, 90, 6)
        text = rng.integers(97, 99, lens.sum()).astype(np.uint8)
        text[:50] = 97
        shards.append(bwt_dedup.Shard(text, lens, 50))
        at = 0
        for n in lens:
            strings += [text[at + i : at + i + 50].tobytes() for i in range(n - 49)]
            at += n
    order, interval = bwt_dedup.merge(shards)
    merged = [strings[i] for i in order]
    assert merged == sorted(strings)
    assert [a == b for a, b in zip(interval, interval[1:])] == [a == b for a, b in zip(merged, merged[1:])]


def test_keys_sent_do_not_grow_with_buckets():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 400_000).astype(np.uint8)
    off = np.arange(0, 400_001, 1000)
    _, _, row, key = bwt_dedup.string_runs(text, off, 50, 30)
    sizes = [bwt_dedup._keys_of_batch(bwt_dedup.short(key), row * 7, b).nbytes for b in (8, 64, 512)]
    assert sizes[0] <= 9 * len(key) and sizes[2] <= 16 * len(key) + 512 * 40  # 6 bytes of key, 2 of place, 8 of id at most


def test_hot_key_sends_one_holder_a_batch():
    key = np.repeat(np.arange(1, 4, dtype=np.uint64), [1000, 1, 500])
    ids = np.arange(1501)
    out = bwt_dedup._keys_of_batch(key, ids, 4)
    sent = [(b, np.frombuffer(h, np.int64)[np.frombuffer(p, np.uint16)].tolist()) for b, p, h in zip(*(out.column(c).to_pylist() for c in ("bucket", "holder", "holders")))]
    assert sorted(x for b, own in sent if b >= 0 for x in own) == [0, 1000, 1001]
    assert sorted(x for b, own in sent if b < 0 for x in own) == [*range(1000), *range(1001, 1501)]


@pytest.mark.parametrize("rows", [1500, 2500])
def test_passage_in_every_document(spark, rows, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "_shared_keys", lambda *a, real=bwt_dedup._shared_keys: real(*a, held_keys=50))
    passage = "the very same passage of words that each and every document of this table holds, 86 bytes"
    data = [(i, f"{i * 7919} {passage} {i * 104729}") for i in range(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in bwt_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute(data, 50)


def test_very_long_text(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    data = [(1, long[1000:1200] + "!"), (2, long), (3, long[250_000:250_060]), (4, None)]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, _spans string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in bwt_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute(data, 50)


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(bwt_dedup, "keyed_words", lambda text, a, b, seed: np.zeros(len(a), np.uint64))
    text = np.frombuffer(b"abcabdabcxy", np.uint8)
    part, size, which = bwt_dedup._distinct(text, np.array([3, 3, 3, 2]))
    assert part.tobytes() == b"abcabdxy" and size.tolist() == [3, 3, 2] and which.tolist() == [0, 1, 0, 2]
