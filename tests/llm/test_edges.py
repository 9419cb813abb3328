"""Cases of single operators: clashing columns, other key types, ties, very long texts, repeated rows."""

import numpy as np
from pyspark.sql import functions as F

from fieldcast.llm import chat_format, decontamination, queries, sharding, toxicity

WORDS = "one two three four five six seven eight nine ten eleven twelve"


def test_sharding_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(k, "x" * 40, "mine", -1, "kept") for k in range(20)] + [(99, "y" * 5000, "mine", -1, "kept")], "doc_id long, text string, shard_id string, depth int, other string")
    got = sharding.extendible_shards(df, "doc_id", "text", 100).collect()
    assert {r["other"] for r in got} == {"kept"} and all(r["shard_id"].startswith(f"{r['depth']}:") for r in got)
    alone = [r for r in got if r["n_bytes"] == 5000]
    assert len(alone) == 1 and alone[0]["oversized"] and alone[0]["shard_rows"] == 1


def test_items_of_text_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, f"a {WORDS} b", "mine"), (1, f"a {WORDS} b", "mine"), (2, f"{'z ' * 50_000}{WORDS}", "mine"), (3, "short one", "mine")], "doc_id long, text string, n_words string")
    items = spark.createDataFrame([("b-2", WORDS), ("a-10", WORDS.upper()), (None, WORDS), ("c", None)], "item_id string, text string")
    got = sorted(decontamination.contamination(docs, items, keep=["doc_id", "n_words"]).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got] == [(1, 14, 12, ["a-10", "b-2"])] * 2 + [(2, 50_012, 12, ["a-10", "b-2"]), (3, 2, 0, [])]


def test_scores_are_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Model(0.3, rng.normal(size=64).astype(np.float32), rng.normal(size=(64, 3)).astype(np.float32), 6)
    sets = [np.sort(rng.choice(64, n, replace=False)) for n in (0, 1, 2, 7, 30)]
    row = np.repeat(np.arange(5), [len(x) for x in sets])
    got = m.raw_scores(row, np.concatenate(sets).astype(np.int64), 5)
    want = [m.bias + sum(m.linear[i] for i in x) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(x) for j in x[k + 1 :]) for x in sets]
    assert np.allclose(got, want, atol=1e-4)


def test_held_out_of_a_null_id(spark):
    df = spark.createDataFrame([(1,), (None,), (4,)], "doc_id long").select("doc_id", queries.held_out().alias("h"))
    assert all(r["h"] is not None for r in df.collect())


def test_very_long_and_null_texts_score(spark, sf_dir):
    df = spark.createDataFrame([(1, "idle words " * 100_000, 5), (2, None, 5), (None, "", 5)], "doc_id long, text string, score int")
    got = queries.toxicity_scores(spark, df, sf_dir).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)


def test_conversations_with_text_keys_repeats_and_long_texts(spark):
    long = "</s>[INST] \\ " * 100_000
    rows = [("a", 0, "user", long), ("a", 1, "assistant", "yes"), ("a", 1, "assistant", "yes"), (None, 0, "user", None), ("b", 0, "stranger", "<s>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn int, role string, text string, position int")
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    assert got["a"]["n_turns"] == 3 and not got["a"]["valid"] and got["a"]["first_bad_turn"] == 2 and got["a"]["loss_chars"] == 6
    assert got[None]["n_turns"] == 1 and got["b"]["n_turns"] == 1 and not got["b"]["valid"]
    import hashlib

    assert got["a"]["turns_sha256"] == hashlib.sha256(f"user\n{long}\nassistant\nyes\nassistant\nyes\n".encode()).hexdigest()
    assert chat_format.conversation_digests(chat_format.format_turns(df.filter(F.lit(False)))).count() == 0


def test_sharding_keeps_columns_named_like_its_own(spark):
    df = spark.createDataFrame([(k, "x" * 40, f"c{k}", f"d{k}", "r", "h", "p") for k in range(60)], "doc_id long, text string, _cell string, _d string, _row string, _h string, _prefix string")
    got = sharding.extendible_shards(df, "doc_id", "text", 100).collect()
    assert {(r["_cell"], r["_d"], r["_row"], r["_h"], r["_prefix"]) for r in got} == {(f"c{k}", f"d{k}", "r", "h", "p") for k in range(60)}


def test_loss_comes_from_the_flags(spark):
    """A template whose flags aren't those of its roles: marks and user texts carry loss."""

    class Flipped(chat_format.Template):
        def segments(self, role, text):
            return [(s, not loss) for s, loss in super().segments(role, text)]

    import hashlib

    df = spark.createDataFrame([(1, 0, "user", "a\\[INST]"), (1, 1, "assistant", "yes")], "conv_id long, turn int, role string, text string")
    plain, flipped = (chat_format.conversation_digests(chat_format.format_turns(df, t), chat_format.Template()).first() for t in (chat_format.Template(), Flipped()))
    assert (plain["loss_chars"], plain["loss_sha256"]) == (3, hashlib.sha256(b"yes").hexdigest())
    assert flipped["loss_sha256"] == hashlib.sha256(b"[INST]a\\[INST][/INST]<s></s>").hexdigest() and flipped["turns_sha256"] == plain["turns_sha256"]


def test_shift_tables_grow_with_the_patterns():
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)

    def words(n):
        return " ".join(letters[rng.integers(0, 26, k)].tobytes().decode() for k in rng.integers(2, 9, n))

    small, large = (decontamination.Patterns([("i", words(n))], 10).classes[-1] for n in (3_000, 400_000))
    text = np.concatenate([decontamination.normal(np.frombuffer(words(20_000).encode(), np.uint8), np.array([0, 0]))[:0], np.frombuffer((" " + words(20_000) + " ").encode(), np.uint8), np.zeros(8, np.uint8)])
    for c in (small, large):
        mean = c.shift[c.hash(text, np.arange(len(text) - 16))].mean()
        assert mean > 0.5 * (c.m - c.block + 1)
    assert small.bits == 18 < large.bits
