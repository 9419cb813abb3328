"""SimHash against a version that counts vote by vote."""

import hashlib
import random
import re

import pytest
import xxhash

from fieldcast.llm import simhash


def chained(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64(p, seed=h).intdigest()
    return h


def brute(text):
    """128 bits, from pairs of words with weights 1 to 4."""
    words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.replace("Σ", "σ").lower()) if w] or [""]
    votes, total = [0] * 128, 0
    for i, a in enumerate(words):
        b = words[i + 1] if i + 1 < len(words) else None
        h0 = chained(a.encode()) if b is None else chained(a.encode(), b.encode())
        h1 = chained(h0.to_bytes(8, "little"))
        w = 1 + min(18, min(15, len(a)) + min(15, len(b or ""))) // 6
        total += w
        for k in range(128):
            votes[k] += w * ((h0 if k < 64 else h1) >> (k % 64) & 1)
    bits = [sum(1 << i for i in range(64) if 2 * votes[64 * k + i] > total) for k in (0, 1)]
    return f"{bits[0]:016x}{bits[1]:016x}"


def check(got, rows):
    """rows: (doc_id, text) in order."""
    assert sorted(((r["doc_id"], r["n_chars"]) for r in got), key=str) == sorted(((d, len(t)) for d, t in rows), key=str)
    want = []
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, x = brute(t), brute(e), brute(nxt)
        like = [1 - (int(a, 16) ^ int(y, 16)).bit_count() / 128 for y in (b, x)]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, *like))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)


def in_order(spark, df):
    """Nulls first, then ids; equal ids by the hash of their text."""
    rows = df.selectExpr("doc_id", "coalesce(text, '') AS text").selectExpr("*", "xxhash64(text) AS h").collect()
    return [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]))]


def test_edge_cases(spark):
    rows = [(3, "One two three, four five six seven!"), (3, "One two three, four five six seven!"), (3, "other words"), (None, "null id"), (None, None), (4, ""), (5, "???"), (6, "ÄÖÜ straße привет"), (9, "word"), (9, "ΑΣ.Β ΑΣ Nd."), (12, "Reorea. Nd."), (10, "x" * 5000), (11, "tail")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, fingerprint string, _b int").repartition(3)
    check(simhash.edited_and_next(df).collect(), in_order(spark, df))


def test_long_text_has_many_chunks(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["aa", "wordy", "internationalization"]) for _ in range(n))) for k, n in enumerate((1, 30, 31, 32, 400, 30_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(simhash.edited_and_next(df).collect(), rows)


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(7, "only this one here")], "doc_id long, text string")
    check(simhash.edited_and_next(df).collect(), [(7, "only this one here")])
    assert simhash.edited_and_next(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows, level", [(7, 1024), (2, 16), (1, 8)])
def test_ranges(spark, rows, level):
    """One and two levels of ranges, with an id that holds a third of all rows."""
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 60) + [500_000] * 30
    texts = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(12)))) for i in ids]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    placed = simhash.with_next(df, rows, level).filter("_x = 0").collect()
    assert len({(r["_b"], r["_r"]) for r in placed}) == len(texts)
    assert max(sum(r["_b"] == b for r in placed) for b in {r["_b"] for r in placed}) <= 24
    check(simhash.edited_and_next(df, rows=rows, level=level).collect(), in_order(spark, df))


def test_shared_terms_give_the_same_as_whole_texts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    check(simhash.edited_and_next(df).collect(), in_order(spark, df))


def brute_near(a, b, radius):
    d = lambda p, q: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(p, q))
    return {(*p, *q): d(p, q) for p in set(a) for q in set(b) if d(p, q) <= radius}


@pytest.mark.parametrize("hot", [1000, 3])
def test_block_tables(spark, hot):
    rng = random.Random(5)
    rows = set()
    for _ in range(20):
        x = rng.getrandbits(128)
        for n in (0, 1, 2, 3, 4, 5, 9):
            y = x
            for i in rng.sample(range(128), n):
                y ^= 1 << i
            rows.add(tuple(v - 2**64 if v >= 2**63 else v for v in (y >> 64, y & (2**64 - 1))))
    same = rng.getrandbits(40)  # a block that many share
    rows |= {(same, rng.getrandbits(63)) for _ in range(30)}
    rows = sorted(rows)
    df = spark.createDataFrame(rows + rows[:5], "f0 long, f1 long")
    asked = spark.createDataFrame(rows[::3], "f0 long, f1 long")
    for radius in (4, 5):
        got = [((r["f0"], r["f1"], r["g0"], r["g1"]), r["distance"]) for r in simhash.near(asked, df, radius, hot).collect()]
        assert len(got) == len(dict(got)) and dict(got) == brute_near(rows[::3], rows, radius)


def test_query_counts_near_rows(spark, sf_dir):
    from fieldcast.llm import queries

    got = queries.op8_simhash(spark, sf_dir).collect()
    prints = [int(r["fingerprint"], 16) for r in got]
    for r, f in zip(got, prints):
        want = sum((f ^ g).bit_count() <= 5 for g in prints) - 1 if r["doc_id"] % 100 == 0 else None
        assert r["n_near"] == want
