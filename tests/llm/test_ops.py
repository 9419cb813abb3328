"""Operators against brute force, round trips and edge rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fieldcast.llm import chat_format, decontamination, packing, queries, secrets, sharding, toxicity, warc

EDGE = [
    (1, "a b c d e f g h i j k l", "x"),
    (2, None, None),
    (3, "", "x"),
    (4, "a b c d e f g h i j k l", "x"),
    (4, "a b c d e f g h i j k l", "x"),
    (5, "Émile ÉMILE straße 漢字 \\ <s> [INST] password: hunter22", None),
    (6, "word " * 30000, "x"),
    (None, "null id", "x"),
]
SCHEMA = "doc_id long, text string, score string"  # score clashes with an added column


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 1
def test_sharding_splits_only_oversized(spark, sf_dir, edge, empty):
    for df, limit in ((docs_of(spark, sf_dir), 20_000), (edge, 30)):
        rows = sharding.extendible_shards(df.select("doc_id", "text"), "doc_id", "text", limit).collect()
        assert len(rows) == df.count()
        by = defaultdict(list)
        for r in rows:
            by[r["shard_id"]].append(r)
        for own in by.values():
            assert own[0]["shard_bytes"] == sum(r["n_bytes"] for r in own) and own[0]["shard_rows"] == len(own)
            assert own[0]["shard_bytes"] <= limit or len({(r["doc_id"], r["text"]) for r in own}) == 1 and own[0]["oversized"]
        parents = defaultdict(int)
        for s, own in by.items():
            d, p = map(int, s.split(":"))
            for up in range(d):
                parents[up, p >> (d - up)] += own[0]["shard_bytes"]
        assert all(v > limit for v in parents.values())  # every bucket that was split had to be
    assert sharding.extendible_shards(empty, "doc_id", "text", 10).count() == 0


def test_sharding_splits_a_hot_key_and_writes(spark, tmp_path):
    df = spark.range(200).select(F.lit("hot").alias("doc_id"), F.concat(F.lit("text"), "id").alias("text"))
    out = sharding.extendible_shards(df, "doc_id", "text", 100)
    assert out.agg(F.max("shard_bytes")).first()[0] <= 100 and out.count() == 200
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 200


# 2
def check_packing(rows, texts, window=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts]
    pieces, seqs, want = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for (d, _), x in zip(texts, ids):
        want[d].append(x)
    for d, xs in want.items():
        if len(xs) == 1:
            at = 0
            for s, k, crc, total in sorted(pieces[d]):
                assert s == at and total == len(xs[0]) and k > 0
                assert crc == zlib.crc32(np.array(xs[0][s : s + k], "<u4").tobytes())
                at += k
            assert at == len(xs[0])
        else:
            assert sum(p[1] for p in pieces[d]) == sum(map(len, xs))
    padding = 0
    for own in seqs.values():
        at = 0
        for o, k in sorted(own):
            assert o == at
            at += k
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_packing_is_whole(spark, sf_dir, edge, empty):
    d = docs_of(spark, sf_dir)
    check_packing(queries.packed(d).collect(), [(r["doc_id"], r["text"]) for r in d.collect()])
    special = edge.unionByName(spark.createDataFrame([(9, "a <|endoftext|> b", None)], SCHEMA))
    check_packing(queries.packed(special).collect(), [(r["doc_id"], r["text"]) for r in special.collect()])
    assert queries.packed(empty).count() == 0


def test_index_scores_are_bm25():
    rng = random.Random(3)
    docs = [[rng.randrange(60) for _ in range(rng.randrange(1, 40))] for _ in range(40)]
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    n, mean = len(docs), off[-1] / len(docs)
    df = np.bincount([t for d in docs for t in set(d)], minlength=1 << 16)
    idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
    index = packing.Index(np.array([t for d in docs for t in d], "<u2"), off, idf, mean)
    used = np.zeros(n, bool)
    used[[0, 5]] = True

    def bm25(q, d):
        return sum(idf[t] * docs[d].count(t) * 2.2 / (docs[d].count(t) + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in set(docs[q]))

    want = sorted((x for x in range(n) if not used[x] and bm25(0, x) > 0), key=lambda x: (-bm25(0, x), x))[:6]
    got = index.neighbours(0, used, 6)
    assert np.allclose([bm25(0, x) for x in got], [bm25(0, x) for x in want])


# 3
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def brute_contamination(docs, items, k=10):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        m = min(k, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            wins[tuple(w[a : a + m])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if (g := tuple(w[a : a + m])) in wins:
                    hit.update(range(a, a + m))
                    found |= wins[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 2000])
def test_decontamination(spark, sf_dir, edge, empty, block_bytes):
    items = spark.createDataFrame([(1, "B-c d"), (2, None), (3, "--"), (None, "a"), (4, "k"), (5, "f g h i j k l a b c d e f"), (6, "émile"), (7, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l")], "item_id long, text string")
    real = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for d, b in ((edge, items), (docs_of(spark, sf_dir), real), (edge, real.limit(0)), (empty, items)):
        got = decontamination.contamination(d, b, keep=["doc_id"], block_bytes=block_bytes).drop("items").collect()
        want = brute_contamination([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in b.collect() if r["item_id"] is not None])
        assert sorted(map(tuple, got), key=str) == want


# 5
def test_secrets(spark, sf_dir, edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = secrets.load_encoding(path)
    key = "q9X2-vLw8Zr4TnBk71mPz0Yd"
    rows = [(10, f"é {key} end"), (11, "API_KEY='abcdef12' Token : short AKIA" + "B" * 16), (12, "d" * 23 + " " + "ab12" * 8), (13, "some_long_identifier_name_2024 123e4567-e89b-12d3-a456-426614174000"), (14, "PASSWD==\"x.y-z=\" secret=")]
    d = edge.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in secrets.secret_spans(d, path).collect()}
    kinds = {k: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for k, r in got.items()}
    assert kinds[10] == [("random", 2, 2 + len(key))]
    assert [k for k, *_ in kinds[11]] == ["assign", "access"] and [k for k, *_ in kinds[12]] == ["hex"] and kinds[13] == [] and kinds[2] == []
    assert kinds[14] == []
    assert got[10]["redacted"] == "é [SECRET] end"
    whole = docs_of(spark, sf_dir)
    want = {r["doc_id"]: [(k, a, b) for a, k, b in secrets.find_spans(r["text"] or "", enc, 2.0)] for r in whole.collect()}
    assert want == {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.secret_spans(whole, path).collect()}
    assert secrets.secret_spans(empty, path).count() == 0


# 7
def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 200
    rows = [(3, "http://a/\r\nb", big), (1, None, big), (2, "u", None), (4, "u", "small"), (5, "u", "small"), (6, "v", big), (7, "w", "y" * 3_000_000), (None, "n", "z" * 120)]
    folder = f"file://{tmp_path}/a"
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "page_id long, url string, html string, digest string, first string")
    written = warc.write_warc(df, folder, file_bytes=300).collect()
    assert sum(r["records"] for r in written) == len(rows)
    back = {r["page_id"]: r for r in warc.read_warc(spark, folder).collect()}
    for i, _, html in rows:
        x = (html or "").encode()
        first = 1 if html == big else i
        assert (back[i]["payload_bytes"], back[i]["payload_digest"]) == (len(x), hashlib.sha256(x).hexdigest())
        assert (back[i]["record_type"], back[i]["refers_to"]) == (("response", None) if first == i else ("revisit", 1))
        assert back[i]["payload"] == (x if first == i else None)


def test_warc_repeated_rows_and_lost_attempts(spark, tmp_path):
    big = "b" * 150
    df = spark.createDataFrame([(1, "u", big), (1, "u", big), (2, "u", big)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/b"
    files = spark.createDataFrame(warc.write_warc(df, folder).collect())
    warc.write_warc(df, folder).collect()  # files of another attempt stay in the folder
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, folder, files).select("page_id", "record_type", "refers_to").collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_warc_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder).count() == 0
    assert warc.read_warc(spark, folder).count() == 0


def test_warc_rejects_damage():
    x = b"payload" * 30
    z = bytearray(warc._gzip(warc._record(1, "u", x, "0" * 64, len(x), None), 6))
    with pytest.raises(ValueError):
        list(warc.Reader(memoryview(z[:-9])))


# 9
def test_toxicity_learns_interactions():
    rng = np.random.default_rng(0)
    sets, y = [], []
    for _ in range(3000):
        x = set(rng.integers(100, 200, 6).tolist())
        a, b = rng.random() < 0.5, rng.random() < 0.5
        x |= ({1} if a else {2}) | ({3} if b else {4})
        sets.append(np.array(sorted(x), np.int32))
        y.append(float(a == b))
    s = toxicity.Settings(bits=10, least_z=0, epochs=40, rate=0.5)
    m = toxicity.train(sets[:2000], np.array(y[:2000]), 0.5, s)
    test = sets[2000:]
    row = np.repeat(np.arange(len(test)), [len(x) for x in test])
    p = m.raw_scores(row, np.concatenate(test).astype(np.int64), len(test)) > 0
    assert (p == np.array(y[2000:])).mean() > 0.95  # no linear model gets over 0.5


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    wrong = sum(r["predicted"] == 1 and r["toxic"] == 0 for r in got)
    found = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got) / sum(r["toxic"] for r in got)
    assert wrong <= 0.005 * len(got) and found > 0.7


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (6, None), (99, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        m = toxicity.fit(edge, lab)
        got = toxicity.score(edge, m).collect()
        assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.score(empty, m).count() == 0


def test_term_sets():
    raw = np.frombuffer("Abcdef x|abcdefyé".encode(), np.uint8)
    off = np.array([0, 8, 9, len(raw)])  # a row ends inside no word; the second row is "|"
    row, bucket = toxicity.term_sets(raw, off, 18)
    by = [set(bucket[row == k].tolist()) for k in range(3)]
    assert not by[1] and len(by[0] & by[2]) == 2  # the two prefixes


# 10
def test_chat_round_trip(spark):
    t = chat_format.Template()
    nasty = ["", "\\", "\\\\<s>", "<\\s>", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>>", "<<s>>", "<<ROLE>>x<<TEXT>>"]
    for x in nasty:
        assert t.unescape(t.escape(x)) == x and not any(c in t.escape(x) for c in t.controls)
    rows = [(1, i, ("user", "assistant")[i % 2], x) for i, x in enumerate(nasty)]
    rows += [(2, 0, "assistant", None), (2, 1, "to<s>ol", "x"), (2, 1, None, "y"), (None, 0, "user", "z"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a"), (3, None, "user", "n")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        said = "".join(x for *_, role, x in own if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["first_bad_turn"] == 0 and not got[3]["valid"]
    assert chat_format.conversation_digests(chat_format.format_turns(df.limit(0))).count() == 0
