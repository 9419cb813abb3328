"""Merkle manifest of a dataset: leaves, subroots by group, one root, proofs, and a check of rows against it.

A leaf is the SHA-256 of a row's fields. The leaves of a group, in order of their key, are reduced by runs of 16 until one node
is left, the group's subroot; the subroots, in order of their groups, are reduced likewise to the root. Digests are lower-case hex.

1. Each row's text is read once, for its leaf; what follows works on digests. Leaves are numbered within their group in sorted
   ranges with offsets, so a group with most of the rows is many tasks.
2. A superblock is 16**3 consecutive leaves. Each is reduced to one node in a task. These nodes, a row for 4096 leaves, are
   a tree of their own: they get their proofs in the same way, in superblocks of superblocks, and so do the subroots.
3. Subtree exchange: leaves and the outer nodes that their superblock needs (all siblings from its top to the root) are
   cogrouped by superblock. One function then builds the local levels, joins local and outer siblings to each leaf's
   proof, and folds what is given as the present leaf up to the root.

Defined cases: a null field counts as ``-``, an empty one as ``0:``; very long texts are hashed whole; a null group is a group of its own, the
first one; null keys stand first, tied keys are in order of their leaves; repeated rows are leaves each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .numbering import numbered

FANOUT, LEVELS = 16, 3
_PATH = "root string, places array<int>, others array<string>"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def build(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The nodes and the levels above them: so many, or until one node is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        low = out[-1]
        out.append([digest(low[i : i + FANOUT]) for i in range(0, len(low), FANOUT)])
    return out


def fold(node: str, places: list[int], others: list[list[str]]) -> str:
    """The root that a node and its siblings, level by level, lead to; ``places`` are the node's places in its runs."""
    for place, run in zip(places, others):
        node = digest([*run[:place], node, *run[place:]])
    return node


def _path(levels: list[list[str]], i: int) -> tuple[list[int], list[str]]:
    """Places and joined siblings of node i from the lowest level to the highest but one."""
    places, others = [], []
    for nodes in levels[:-1]:
        at = i // FANOUT * FANOUT
        run = nodes[at : at + FANOUT]
        places.append(i - at)
        others.append("".join(run[: i - at] + run[i - at + 1 :]))
        i //= FANOUT
    return places, others


def _within(size: int, levels: int) -> int | None:
    """Levels of a superblock: all that its group has if it is the only one."""
    return None if size <= FANOUT**levels else levels


def _paths(nodes: DataFrame, levels: int) -> DataFrame:
    """Of nodes (grp, pos, digest, size): grp, pos, the group's root, and the path to it. ``nodes`` must be a stored table."""
    block = nodes.withColumn("block", F.expr(f"pos DIV {FANOUT**levels}"))
    large = nodes.filter(F.col("size") > FANOUT**levels)
    if large.isEmpty():
        none = F.array().cast("array<int>"), F.array().cast("array<string>")
        outer = block.select("grp", "block", F.lit(None).cast("string").alias("root"), none[0].alias("places"), none[1].alias("others")).distinct()
    else:
        outer = _outer(block, levels)

    def finish(key: tuple, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        tree = build(own["digest"].tolist(), _within(int(own["size"].iloc[0]), levels))
        up = above.iloc[0]
        paths = [_path(tree, i) for i in range(len(own))]
        root = tree[-1][0] if up["root"] is None else up["root"]
        return pd.DataFrame({"grp": own["grp"], "pos": own["pos"], "root": root, "places": [p + list(up["places"]) for p, _ in paths], "others": [o + list(up["others"]) for _, o in paths]})

    return block.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(finish, f"grp string, pos long, {_PATH}")


def _outer(block: DataFrame, levels: int) -> DataFrame:
    """Of each (grp, block): the group's root, and the path from the block's top node to it."""

    def top(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        size = int(own["size"].iloc[0])
        node = build(own["digest"].tolist(), _within(size, levels))[-1][0]
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "digest": [node], "size": [-(-size // FANOUT**levels)]})

    tops = written(block.select("grp", "pos", "digest", "size", "block").groupBy("grp", "block").applyInPandas(top, "grp string, pos long, digest string, size long"), "merkle-tops")
    return _paths(tops, levels).withColumnRenamed("pos", "block")


def manifest(docs: DataFrame, key: str, group: str, fields: list[str], present: dict[str, Column] | None = None, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """Per row: key, group, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``present`` gives fields as they are now (as columns of ``docs``), if they may have changed since; folded_root is what their
    leaf and the siblings lead to. With ``proofs`` the siblings come too: ``places`` and ``others``, a list for each level.
    """
    now = [(present or {}).get(f, F.col(f"`{f}`")) for f in fields]
    leaf = leaf_digest([F.col(f"`{f}`") for f in fields])
    grp = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit(""))  # the null group first
    leaves = docs.select(F.col(f"`{key}`").alias("_key"), grp.alias("grp"), leaf.alias("digest"), leaf_digest(now).alias("now"))
    leaves = written(leaves.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now"))), "merkle-digests")  # null: unchanged
    rows, sizes = numbered(leaves, ["grp"], ["_key", "digest"], "merkle-leaves")
    rows = rows.join(sizes.hint("broadcast") if sizes.limit(100_001).count() <= 100_000 else sizes, "grp")
    block = rows.withColumn("block", F.expr(f"pos DIV {FANOUT**levels}")).withColumn("_key", F.col("_key").cast("string"))  # pandas has no null integers
    inner = written(_outer(block, levels), "merkle-blocks")
    roots, number = numbered(inner.filter("block = 0").select(F.lit("").alias("all"), "grp", F.col("root").alias("digest")), ["all"], ["grp"], "merkle-subroots")
    roots = written(roots.join(F.broadcast(number), "all").select(F.col("all").alias("grp"), "pos", "digest", "size", F.col("grp").alias("member")), "merkle-roots")
    whole = _paths(roots.drop("member"), levels).drop("grp").join(roots.select("pos", "member"), "pos")
    whole = whole.select(F.col("member").alias("grp"), F.col("root").alias("whole"), F.col("places").alias("p"), F.col("others").alias("o"))
    few = whole.limit(10_001).count() <= 10_000  # of at most some 10 kB
    outer = inner.join(F.broadcast(whole) if few else whole, "grp").select("grp", "block", F.col("root").alias("subroot"), "whole", F.concat("places", "p").alias("places"), F.concat("others", "o").alias("others"))

    def finish(_: tuple, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        tree = build(own["digest"].tolist(), _within(int(own["size"].iloc[0]), levels))
        top = above.iloc[0]
        outer_places, outer_others = [int(p) for p in top["places"]], list(top["others"])
        outer_text = "".join(outer_others)
        # what the leaves of a run share: the way from their parent up
        shared = [_path(tree[1:], i) for i in range(len(tree[1]))] if len(tree) > 1 else []
        out: dict[str, list] = {"proof": [], "folded": [], "places": [], "others": []}
        for i, (leaf, changed) in enumerate(zip(tree[0], own["now"])):
            places, others = [], []
            if len(tree) > 1:
                at = i // FANOUT * FANOUT
                run = tree[0][at : at + FANOUT]
                places, others = [i - at], ["".join(run[: i - at] + run[i - at + 1 :])]
                places, others = places + shared[i // FANOUT][0], others + shared[i // FANOUT][1]
            out["proof"].append(digest(["".join(others), outer_text]))
            node = leaf if changed is None else changed
            for place, run in zip(places + outer_places, others + outer_others):
                node = digest([run[: 64 * place], node, run[64 * place :]])
            out["folded"].append(node)
            if proofs:
                out["places"].append(places + outer_places)
                out["others"].append([[run[k : k + 64] for k in range(0, len(run), 64)] for run in others + outer_others])
        root = top["whole"]
        found = pd.DataFrame({"grp": own["grp"], "_key": own["_key"], "leaf": own["digest"], "subroot": top["subroot"], "root": root, "proof_sha256": np.array(out["proof"], object), "folded_root": np.array(out["folded"], object)})
        found["verified"] = found["folded_root"] == root
        if proofs:
            found["places"], found["others"] = out["places"], out["others"]
        return found

    schema = "grp string, _key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", places array<int>, others array<array<string>>" if proofs else ""
    found = block.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(finish, schema)
    named = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).cast(docs.schema[group].dataType)
    return found.select(F.col("_key").cast(docs.schema[key].dataType).alias(key), named.alias(group), *found.columns[2:])
