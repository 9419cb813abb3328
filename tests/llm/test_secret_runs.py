"""Secret scans: batches against single texts, and keys in longer runs."""

import public_tokenizers
import pytest

from fieldcast.llm import common, secrets

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("rows", [1, 2, 3, 2000])
def test_batches_do_not_matter(spark, monkeypatch, rows):
    """Texts that end in a key character, and texts that begin with, or are, a key."""
    monkeypatch.setattr(common, "BATCH_ROWS", rows)
    key = "q9X2vLw8Zr4TnBk71mPz0Yd"
    texts = ["a text with no full stop at its end", f"{key} is the key.", key, key, None, "", key, "x", f"at the end {key}", f"{key[:10]}", key[10:], f"é{key}", key]
    encoding = secrets.load_encoding(PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.secret_spans(df, PATH).collect()}
    want = {i: [(k, a, b) for a, k, b in secrets.find_spans(x or "", encoding, 2.0)] for i, x in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) == 7


def _covered(text, key, encoding):
    at = text.index(key)
    hit = set()
    for a, _, b in secrets.find_spans(text, encoding, 2.0):
        hit.update(range(a, b))
    return set(range(at, at + len(key))) <= hit


def test_keys_in_longer_runs():
    import random
    import string

    rng, encoding = random.Random(4), secrets.load_encoding(PATH)
    for letters, least in ((string.ascii_letters + string.digits, 0.99), (string.ascii_lowercase + string.digits, 0.97), (string.ascii_letters, 0.99)):
        for before in ("", "production_database_credential=", "/documents/download/reports/"):
            keys = ["".join(rng.choice(letters) for _ in range(20)) for _ in range(300)]
            assert sum(_covered(f"see {before}{k} here", k, encoding) for k in keys) >= least * len(keys)


def test_base_spans_are_subtracted_and_words_stay():
    encoding = secrets.load_encoding(PATH)
    hexa = "0123456789abcdef01234567"
    x = f"Zq9X2vLw8ZrTnBkQ{hexa}XmPz7YdRw3Kt9Lq"
    spans = secrets.find_spans(x, encoding, 2.0)
    assert [k for _, k, _ in spans] == ["random", "hex", "random"] and all(a[2] == b[0] for a, b in zip(spans, spans[1:])) and (spans[0][0], spans[-1][2]) == (0, len(x))
    for word in ("internationalization_of_configuration", "Donaudampfschifffahrtsgesellschaft", "/documents/download/reports/2024/index", "id=123e4567-e89b-12d3-a456-426614174000"):
        assert secrets.find_spans(word, encoding, 2.0) == []


def test_very_long_runs_and_many_spans(spark):
    """A million key characters, and thousands of keys in one text: every character is tested, in time that grows with the text."""
    import random
    import time

    import public_tokenizers

    from fieldcast.llm import secrets

    rng = random.Random(3)
    some = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    enc = secrets.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    key = lambda n: "".join(rng.choice(some) for _ in range(n))
    began = time.time()
    whole = key(1_000_000)
    assert secrets.find_spans(f"a {whole} b", enc, 2.0) == [(2, "random", 1_000_002)]
    assert secrets.find_spans("password_of_the_user/" * 50_000, enc, 2.0) == []
    assert secrets.find_spans("z" * 300_000, enc, 2.0) == []
    many = " ".join(f"token={key(30)} {key(30)}" for _ in range(5000))
    found = secrets.find_spans(many, enc, 2.0)
    assert sum(k == "assign" for _, k, _ in found) == 5000 and sum(k == "random" for _, k, _ in found) > 4900
    assert time.time() - began < 120
    df = spark.createDataFrame([(1, f"a {whole} b", "mine", "mine")], "doc_id long, text string, spans string, redacted string")
    r = secrets.secret_spans(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id", "spans"]).first()
    assert r["redacted"] == "a [SECRET] b" and [tuple(x) for x in r["spans"]] == [("random", 2, 1_000_002)]


def brute_base(text):
    """The three fixed kinds by the contract, from the left, without regular expressions of the module."""
    import re

    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    out, at, low = [], 0, text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    while at < len(text):
        name = next((n for n in names if low.startswith(n, at)), None)
        end = None
        if name:
            for quote in (1, 0):  # an optional sign is taken if it is there
                i = at + len(name)
                i += quote and text[i : i + 1] in ("'", '"')
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] in (":", "=") and i < len(text):
                    i += 1
                    while text[i : i + 1] == " ":
                        i += 1
                    i += text[i : i + 1] in ("'", '"') and i < len(text)
                    j = i
                    while j < len(text) and text[j] in allowed:
                        j += 1
                    if j > i:
                        end = j
                        if j - i >= 6:
                            out.append((at, 0, j))
                        break
        at = end or at + 1
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_query_against_the_contract(spark, sf_dir):
    import hashlib

    from fieldcast.llm import queries, secrets

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op5_secret_scan(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for d, x in texts.items():
        base = brute_base(x)
        r = got[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == (told.split(",") if told else [])
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))
