"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt_dedup import remove_repeats
from .chat_format import Template, conversation_digests, format_turns
from .circulant import near_duplicates
from .common import new_folder, table, written
from .decontamination import contamination
from .merkle import manifest
from .ngram_join import jaccard_components
from .packing import pack
from .prefix_trie import prefix_trie, shared_heads, turn_rows
from .secrets import secret_spans, span_text
from .sharding import extendible_shards
from .simhash import edited_and_next
from .toxicity import fit, score
from .warc import read_warc, write_warc

SHARD_BYTES = 1 << 20


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", SHARD_BYTES).drop("text")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary; only the queries that need one import the package that knows it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.drop("items")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    files = written(write_warc(table(spark, sf_dir, "pages"), folder), "warc-files")
    return read_warc(spark, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(table(spark, sf_dir, "documents"))


def held_out() -> F.Column:
    """A null doc_id counts as the text of no character."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of ``docs``, and the score of a model fitted on the rows of labels that aren't held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return score(docs, fit(table(spark, sf_dir, "documents"), labels))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(spark, docs, sf_dir).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return conversation_digests(format_turns(turns.unionByName(extra)))


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row checked against the manifest after some texts were changed."""
    docs = table(spark, sf_dir, "documents")
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed).otherwise(F.col("text"))
    return manifest(docs, "doc_id", "source", FIELDS, {"text": now}).drop("source")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_heads(turn_rows(table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_extendible_sharding": op1_extendible_sharding,
    "op2_retrieval_packing": op2_retrieval_packing,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_join": op4_ngram_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_circulant_minhash": op11_circulant_minhash,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}

_ESCAPED = r"replace(coalesce(text, ''), '\', '\\')"
for _c in Template().controls:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"



def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a short ASCII string."""
    step = "list_reduce(list_prepend(xor({x}, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    bytes_ = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {step.format(x='c')}), 4294967295)"


def _reduced(name: str, first: str, levels: int) -> str:
    """Levels of trees (grp, pos, n, dg) by runs of 16, each with the siblings before and after its nodes."""
    out = [f"{name}0 AS ({first})"]
    for k in range(levels):
        if k:
            out.append(f"{name}{k} AS (SELECT grp, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, sha256(string_agg(dg, '' ORDER BY pos)) AS dg FROM {name}{k - 1} WHERE n > 1 GROUP BY grp, pos // 16)")
        w = "PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(f"{name}s{k} AS (SELECT *, coalesce(string_agg(dg, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(dg, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k} WHERE n > 1)")
    return ",\n".join(out)


def _folded(name: str, node: str, others: str, levels: int) -> list[tuple[str, str]]:
    """(node, siblings so far) after each level, joined as {name}s{k}."""
    out = []
    for k in range(levels):
        s = f"{name}s{k}"
        node, others = f"CASE WHEN {s}.n IS NULL THEN {node} ELSE sha256({s}.b || {node} || {s}.a) END", f"{others} || coalesce({s}.b || {s}.a, '')"
        out.append((node, others))
    return out


def _up(name: str, grp: str, pos: str, levels: int) -> str:
    return " ".join(f"LEFT JOIN {name}s{k} ON {name}s{k}.grp = {grp} AND {name}s{k}.pos = {pos} // {16**k}" for k in range(levels))


_FIELD = "coalesce(strlen({x}) || ':' || {x}, '-')"
_LEAF = " || ".join(_FIELD.format(x=f"CAST({c} AS VARCHAR)") for c in FIELDS)
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op11_circulant_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.k >= 80 * (x.n + y.n - p.k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.k >= 75 * (x.n + y.n - p.k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op1_extendible_sharding": f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT * 268435456)
         + ('0x' || substr(md5(coalesce(text, '')), 1, 7))::BIGINT AS h
  FROM documents),
e AS (SELECT d.*, k.depth, h >> (60 - k.depth) AS prefix FROM d, (SELECT unnest(range(0, 31))::INTEGER AS depth) k),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM e GROUP BY ALL),
f AS (SELECT e.*, s.shard_bytes, s.shard_rows, row_number() OVER (PARTITION BY doc_id, h ORDER BY e.depth) AS r
      FROM e JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {SHARD_BYTES} OR s.shard_rows = 1)
SELECT doc_id, n_bytes, depth, depth || ':' || prefix AS shard_id, shard_bytes, shard_rows,
       shard_bytes > {SHARD_BYTES} AS oversized FROM f WHERE r = 1""",
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d, n)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g USING (d, n)""",
    "op10_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, row_number() OVER w - 1 AS position, lag(role) OVER w AS before,
         length({_ESCAPED}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 25 + length(role) END AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
                 WHEN before = 'user' THEN role = 'assistant' ELSE false END AS ok FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(ok) AND arg_max(role, position) = 'assistant' AS valid,
       min(position) FILTER (NOT ok) AS first_bad_turn
FROM f GROUP BY conv_id""",
    "op12_merkle_manifest": f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, '') AS grp, {_LEAF} AS v, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LEAF.replace("CAST(text AS VARCHAR)", _LOWER_SQL)} ELSE {_LEAF} END AS t FROM documents),
e AS (SELECT doc_id, grp, sha256(v) AS dg, sha256(t) AS now, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, sha256(v)) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
{_reduced("l", "SELECT grp, pos, n, dg FROM e", 5)},
r AS ({" UNION ALL ".join(f"SELECT grp, dg FROM l{k} WHERE n = 1" for k in range(5))}),
{_reduced("u", "SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, dg FROM r", 4)},
g AS (SELECT grp, dg, row_number() OVER (ORDER BY grp) - 1 AS pos FROM r),
root AS ({" UNION ALL ".join(f"SELECT dg AS root FROM u{k} WHERE n = 1" for k in range(4))}),
f AS (SELECT e.doc_id, e.dg AS leaf, e.grp, x0, o0 FROM (SELECT e.doc_id, {_folded("l", "e.now", "''", 5)[-1][0]} AS x0, {_folded("l", "e.now", "''", 5)[-1][1]} AS o0, e.dg, e.grp FROM e {_up("l", "e.grp", "e.pos", 5)}) e),
h AS (SELECT f.doc_id, f.leaf, g.dg AS subroot, {_folded("u", "f.x0", "f.o0", 4)[-1][0]} AS folded_root, sha256({_folded("u", "f.x0", "f.o0", 4)[-1][1]}) AS proof_sha256 FROM f JOIN g USING (grp) {_up("u", "0", "g.pos", 4)})
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM h, root""",
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(x ORDER BY pos) AS own FROM t GROUP BY 1),
h AS (SELECT conv_id, own, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM c),
s AS (SELECT h.conv_id AS m, coalesce(b.own[1:h], []) || h.own[h + 1:] AS x FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT m, d, x[1:d] AS x, len(x) AS n FROM (SELECT m, x, unnest(range(0, len(x) + 1)) AS d FROM s)),
k AS (SELECT d, x, min(m) AS conv_id, count(*) AS n_convs, coalesce(length(x[d].t), 0) AS chars, sha256(coalesce(string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, x),
n AS (SELECT k.*, coalesce(j.n, 0) AS n_children FROM k LEFT JOIN (SELECT d - 1 AS d, x[1:d - 1] AS x, count(*) AS n FROM k WHERE d > 0 GROUP BY ALL) j USING (d, x)),
a AS (SELECT d, x[1:d] AS x, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT x, n_convs, chars, n_children, unnest(range(0, d + 1)) AS d FROM n) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, a.n_leaves, a.saved_tokens, n.ends_sha256
FROM n JOIN a USING (d, x) LEFT JOIN n q ON n.d > 0 AND q.d = n.d - 1 AND q.x = n.x[1:n.d - 1]""",
}
