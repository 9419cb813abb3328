"""Trie of all prefixes of conversations, by ROLLUP over columns of turn ids.

Each turn has an id (112 bits of the SHA-256 of its role and text, and its length). A conversation's turns stand side by side in
columns of a block, eight at a time; GROUP BY ROLLUP over these columns aggregates all prefixes of a block together, and
grouping_id says how deep each group is. A conversation of more turns has further blocks, each keyed by the node that its
earlier blocks lead to. A node's key is its depth and the exclusive or of its turns' ids, each hashed with its position.

Two rollups give everything, without walking the tree level by level:

* The first gives each node's members, smallest member (its owner) and longest member. The nodes that a conversation owns are the end
  of its path. ``lead``, the code points before the first of them, is what it shares with others; it is the owner of at most one
  childless node, the end of its path.
* The second sums over members: childless nodes owned by members are the leaves of a subtree. The tokens saved in a subtree are
  the leads of all members but the owner, less (members - 1) times the code points before the node's own turn.

Turns are numbered in sorted ranges, so a hot conversation is many tasks; its blocks' keys come from sums over runs of 1024
blocks. The ids of conversations that end at a node are joined in pieces of 4096 and streamed through SHA-256.

Defined cases: null role or text is empty; very long texts are hashed whole; null turns stand first, tied turns are in order
of role, then text; repeated rows are all kept; rows with null conv_id belong to no conversation and are left out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, written
from .numbering import numbered

WIDTH, RUN, PIECE = 8, 1024, 4096
COLUMNS = [f"t{k}" for k in range(WIDTH)]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _bits(hexes: Column, start: int) -> Column:
    return F.conv(F.substring(hexes, start, 14), 16, 10).cast("long")


def _placed(a: Column, b: Column, at: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its position."""
    return F.xxhash64(F.lit(1), a, b, at), F.xxhash64(F.lit(2), b, a, at)


def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id): turns in order; the id is (a, b, n) with n code points of text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    h = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    d = d.withColumn("h", h).withColumn("turn_id", F.struct(_bits(F.col("h"), 1).alias("a"), _bits(F.col("h"), 15).alias("b"), F.length("text").cast("long").alias("n")))
    rows, _ = numbered(d.select("conv_id", "turn", "role", "text", "turn_id"), ["conv_id"], ["turn", "role", "text"], "trie-turns")
    return rows.select("conv_id", "pos", "turn_id")


def shared_heads(rows: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its first h; h is crc32(c) % most.

    Those without a turn left have one row without a turn.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    heads = rows.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), F.col("pos").alias("p"), "turn_id")
    convs = rows.filter("pos = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    head = convs.join(heads, "base", "left").select("conv_id", "h", F.when(F.col("p") < F.col("h"), F.col("p")).alias("pos"), "turn_id")
    length = head.groupBy("conv_id").agg(F.count("pos").alias("m"))
    own = rows.withColumn("h", h).filter("pos >= h").join(length, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn_id")
    rebuilt = head.filter("pos IS NOT NULL").select("conv_id", "pos", "turn_id").unionByName(own)
    return rebuilt.unionByName(length.select("conv_id"), allowMissingColumns=True)


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, block, len, total, k1, k2, before, t0..t7): eight turns each, the key and the code points of all turns before them."""
    a, b = (F.when(F.col("pos").isNotNull(), x) for x in _placed(F.col("turn_id.a"), F.col("turn_id.b"), F.col("pos")))
    d = rows.withColumn("block", F.coalesce(F.expr(f"pos DIV {WIDTH}"), F.lit(0).cast("long")))
    columns = [F.max(F.when(F.col("pos") % WIDTH == k, F.col("turn_id"))).alias(c) for k, c in enumerate(COLUMNS)]
    d = d.groupBy("conv_id", "block").agg(
        *columns, F.coalesce(F.bit_xor(a), F.lit(0)).alias("x1"), F.coalesce(F.bit_xor(b), F.lit(0)).alias("x2"), F.coalesce(F.sum("turn_id.n"), F.lit(0)).alias("n"), F.count("pos").alias("len")
    )
    d = written(d.withColumn("run", F.expr(f"block DIV {RUN}")), "trie-columns")
    sums = {"k1": ("x1", F.bit_xor), "k2": ("x2", F.bit_xor), "before": ("n", F.sum)}
    runs = d.groupBy("conv_id", "run").agg(*(f(c).alias(c) for c, f in sums.values()), F.sum("len").alias("len"))
    w = Window.partitionBy("conv_id")
    earlier = w.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", *(F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"r_{k}") for k, (c, f) in sums.items()), F.sum("len").over(w).alias("whole"))
    within = Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = d.select("*", *(F.coalesce(f(c).over(within), F.lit(0)).alias(f"w_{k}") for k, (c, f) in sums.items()))
    both = inner.join(runs, ["conv_id", "run"])
    keys = [F.col(f"w_{k}").bitwiseXOR(F.col(f"r_{k}")).alias(k) for k in ("k1", "k2")]
    return both.select("conv_id", "block", F.col("whole").alias("length"), *keys, (F.col("w_before") + F.col("r_before")).alias("before"), F.col("x1").bitwiseXOR(keys[0]).alias("e1"), F.col("x2").bitwiseXOR(keys[1]).alias("e2"), *COLUMNS)


def _rollup(blocks: DataFrame, sums: str) -> DataFrame:
    """Of each node: depth, key, parent's key, code points of its last turn and before it, and the given aggregates of its members."""
    names = ", ".join(COLUMNS)
    d = blocks.sparkSession.sql(f"SELECT block, k1, k2, before, {names}, {WIDTH} - bit_count(grouping_id()) AS d, {sums} FROM {{blocks}} GROUP BY block, k1, k2, before, ROLLUP({names})", blocks=blocks)
    turns = F.array(*COLUMNS)
    d = d.withColumn("turns", F.slice(turns, 1, F.col("d"))).withColumn("last", F.get("turns", F.col("d") - 1))
    d = d.filter("(d = 0 AND block = 0) OR last IS NOT NULL")  # shorter members have no turn there; depth 0 of a later block is the node before it
    at = F.col("block") * WIDTH

    def key(start: str, k: int, turns: Column) -> Column:
        placed = F.transform(turns, lambda t, i: _placed(t["a"], t["b"], at + i)[k])
        return F.aggregate(placed, F.col(start), lambda x, y: x.bitwiseXOR(y))

    up = F.slice("turns", 1, F.greatest(F.col("d") - 1, F.lit(0)))
    held = [c for c in d.columns if c not in {"block", "k1", "k2", "before", "d", "turns", "last", *COLUMNS}]
    before = F.col("before") + F.aggregate(F.transform(up, lambda t: t["n"]), F.lit(0).cast("long"), lambda x, y: x + y)
    deep = (at + F.col("d")).alias("depth")
    parent = [F.when(F.col("d") + at > 0, key(k, i, up)).alias(f"parent{i + 1}") for i, k in enumerate(("k1", "k2"))]
    return d.select(deep, key("k1", 0, F.col("turns")).alias("key1"), key("k2", 1, F.col("turns")).alias("key2"), *parent, F.coalesce("last.n", F.lit(0)).alias("chars"), before.alias("before"), *held)


def _ends(blocks: DataFrame) -> DataFrame:
    """(depth, key1, key2, ends_sha256) of the nodes where conversations end."""
    ends = blocks.filter(F.col("block") == F.expr(f"greatest(length - 1, 0) DIV {WIDTH}")).select(F.col("length").alias("depth"), F.col("e1").alias("key1"), F.col("e2").alias("key2"), "conv_id")
    keys = ["depth", "key1", "key2"]
    rows, _ = numbered(ends, keys, ["conv_id"], "trie-ends")
    pieces = rows.groupBy(*keys, F.expr(f"pos DIV {PIECE}").alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(c).to_pylist() for c in (*keys, "ids"))):
                if key != now:
                    if h is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
            yield _found(out)
        if h is not None:
            yield _found([(*now, h.hexdigest())])

    def _found(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string() if k == 3 else pa.int64()) for k in range(4)], names=[*keys, "ends_sha256"])

    return lean(pieces.repartition(*keys).sortWithinPartitions(*keys, "piece").select(*keys, "ids"), run, "depth long, key1 long, key2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, pos, turn_id); a conversation without turns has a row with null pos.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = written(_blocks(rows), "trie-blocks")
    first = _rollup(blocks, "min(conv_id) AS conv_id, max(length) AS longest").withColumn("childless", (F.col("longest") == F.col("depth")).cast("long"))
    owned = first.groupBy("conv_id").agg(F.min("before").alias("lead"), F.max("childless").alias("leaf"))
    whole = blocks.filter(F.col("block") == F.expr(f"greatest(length - 1, 0) DIV {WIDTH}"))
    last = F.aggregate(F.transform(F.array(*COLUMNS), lambda t: F.coalesce(t["n"], F.lit(0))), F.lit(0).cast("long"), lambda x, y: x + y)
    lead = whole.select("conv_id", (F.col("before") + last).alias("total")).join(owned, "conv_id", "left")
    lead = lead.select("conv_id", F.coalesce("lead", "total").alias("lead"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = "count(*) AS n_convs, min(conv_id) AS conv_id, min_by(lead, conv_id) AS own_lead, sum(lead) AS leads, sum(leaf) AS n_leaves"
    nodes = written(_rollup(blocks.join(lead, "conv_id"), sums), "trie-nodes")
    parents = nodes.groupBy("depth", "parent1", "parent2").agg(F.count(F.lit(1)).alias("n_children")).select((F.col("depth") - 1).alias("depth"), F.col("parent1").alias("key1"), F.col("parent2").alias("key2"), "n_children").filter("depth >= 0")
    keys = ["depth", "key1", "key2"]
    mine = nodes.join(parents, keys, "left").join(_ends(blocks), keys, "left")
    above = parents.join(nodes, keys).select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    out = mine.join(above, ["depth", "parent1", "parent2"], "left")
    saved = F.col("leads") - F.col("own_lead") - (F.col("n_convs") - 1) * F.col("before")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
