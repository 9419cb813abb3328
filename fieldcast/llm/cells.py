"""Exact links within cells of candidate documents, and the components that they make."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, saved, written
from .components import components
from .shingles import Names


class Cell:
    """Members of a cell (or of a block of one) and their exact overlaps; a subclass finds candidates.

    Sets link when ``p`` * |A & B| >= ``q`` * (|A| + |B|).
    """

    p, q = 7, 3

    def __init__(self, names: np.ndarray, sets: list[np.ndarray], copies: np.ndarray):
        self.names, self.sets, self.copies = names, sets, copies
        self.sizes = np.array([len(s) for s in sets])
        self.label = np.arange(len(sets))

    def near(self, i: int, every: bool) -> np.ndarray:
        """Candidates of member i: all, or those of other components."""
        raise NotImplementedError

    def near_set(self, s: np.ndarray) -> np.ndarray:
        """Candidates of a set that isn't a member."""
        raise NotImplementedError

    def links(self, s: np.ndarray, candidates: np.ndarray, every: bool) -> np.ndarray:
        """Candidates that link with the set: all, or one of each component at least."""
        found = []
        order = candidates if every else candidates[np.argsort(-self.sizes[candidates], kind="stable")]
        while len(order):
            part, order = order[:64], order[64:]
            both = np.concatenate([self.sets[i] for i in part])
            at = np.minimum(np.searchsorted(s, both), len(s) - 1)
            overlap = np.add.reduceat((s[at] == both).astype(np.int64), np.concatenate([[0], np.cumsum(self.sizes[part])[:-1]]))
            overlap -= (overlap == len(s)) & (self.sizes[part] == len(s))  # other classes differ in a shingle, whatever its hash
            yes = part[self.p * overlap >= self.q * (len(s) + self.sizes[part])]
            found += yes.tolist()
            if not every and len(yes) and len(order):
                order = order[~np.isin(self.label[order], self.label[yes])]
        return np.array(found, np.int64)

    def own_links(self, every: bool) -> list[tuple[int, int, int]]:
        """(a, b, 0): a spanning set of the links among the members; with ``every``, (a, a, n) too: documents that a links with here."""
        out, count = [], np.zeros(len(self.sets), np.int64)
        for i in range(len(self.sets)):
            near = self.near(i, every)
            linked = self.links(self.sets[i], near, every) if len(near) else ()
            if every and len(linked):
                count[i] += self.copies[linked].sum()
                count[linked] += self.copies[i]
            for j in linked:
                a, b = self.label[i], self.label[j]
                if a != b:
                    out.append((int(self.names[i]), int(self.names[j]), 0))
                    self.label[self.label == b] = a
        return out + [(int(self.names[i]), int(self.names[i]), int(count[i])) for i in np.flatnonzero(count)]

    def links_of(self, name: int, s: np.ndarray, every: bool) -> list[tuple[int, int, int]]:
        """Links of a member of another block."""
        near = self.near_set(s)
        near = self.links(s, near, every) if len(near) else np.zeros(0, np.int64)
        _, first = np.unique(self.label[near], return_index=True)
        out = [(name, int(self.names[j]), 0) for j in near[first]]
        return out + [(name, name, int(self.copies[near].sum()))] if every and len(near) else out


def _link_cells(kind: type[Cell], every: bool) -> Callable:
    """Rows come sorted by cell, block and role: members (0) first, then queries of other blocks (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets, copies, cell, last = None, [], [], [], None, None
        out: list = []

        def close() -> None:
            nonlocal cell
            if cell is None and names:
                cell = kind(np.array(names), sets, np.array(copies))
                out.extend(cell.own_links(every))

        for b in batches:
            for key in zip(*(b.column(c).to_pylist() for c in ("cell", "block", "role", "name", "copies", "shingles"))):
                s = np.frombuffer(key[5], np.uint64)
                if key[:2] != now:
                    close()
                    now, names, sets, copies, cell, last = key[:2], [], [], [], None, None
                if key[2:4] == last:  # equal rows of one id
                    continue
                last = key[2:4]
                if key[2] == 0:
                    names.append(key[3])
                    copies.append(key[4])
                    sets.append(s.copy())
                elif names:
                    close()
                    out += cell.links_of(key[3], s, every)
            if out:
                yield _rows(out)
                out.clear()
        close()
        yield _rows(out)

    return run


def _rows(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(3)], names=["a", "b", "n"])


def class_table(known: DataFrame) -> DataFrame:
    """name, smallest _id, number of shingles, and number of documents of each class."""
    return known.filter("name IS NOT NULL").groupBy("name").agg(F.min("_id").alias("_id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))


MOST_BITS = 1 << 27  # of 16 MB; beyond 8 million members more other rows pass


def of_members(own: DataFrame, members: DataFrame, number: int) -> DataFrame:
    """The rows of ``own`` whose _id may be a member's: all members' rows, and about one of 16 others.

    A bitmap over hashed ids (16 bits a member) travels, so that texts of other rows needn't be dealt out for a join.
    """
    bits = min(MOST_BITS, max(1 << 10, 1 << (16 * number - 1).bit_length()))
    at = members.select(F.xxhash64("_id").bitwiseAND(bits - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1, cast(at % 32 as int))")).alias("bits")).toPandas()
    marks = np.zeros(bits >> 5, np.uint32)
    marks[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int32).view(np.uint32)
    shared = own.sparkSession.sparkContext.broadcast(marks)

    def marked(h: pd.Series) -> pd.Series:
        at = h.to_numpy(np.int64) & np.int64(bits - 1)
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1)

    return own.filter(F.pandas_udf(marked, "boolean")(F.xxhash64("_id")))


def verified(own: DataFrame, cells: DataFrame, classes: DataFrame, names: Names, kind: type[Cell], width: int, cell_shingles: int, few_members: int, links: bool) -> DataFrame:
    """(a, b, n) of ``Cell.own_links`` for cells (node, root) of classes; ``own`` has (_id, _text) of all documents.

    Each member's set travels once, to its cell; a cell over ``cell_shingles`` is cut into blocks that read all its members. What
    such cells deal out grows with their square, so blocks take turns: one turn deals about a quarter of the corpus's shingles.
    """
    members = saved(cells.join(classes, F.col("node") == F.col("name")).select("name", "_id", "n", "copies", F.col("root").alias("cell")))
    number = members.count()
    few = number <= few_members
    sizes = members.groupBy("cell").agg(F.sum("n").alias("_all"), F.ceil(F.sum("n") / cell_shingles).cast("int").alias("blocks"))
    large = sizes.filter("blocks > 1").agg(F.sum(F.col("_all") * F.col("blocks")), F.max("blocks")).first()
    turns = min(large[1], -(-4 * large[0] // classes.agg(F.sum("n")).first()[0])) if large[1] else 1
    members = members.join(sizes.drop("_all"), "cell").drop("n")
    texts = own.select("_id", "_text")
    held = texts.join(F.broadcast(members), "_id") if few else of_members(texts, members, number).join(members.hint("shuffle_hash"), "_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(names.sets(b, width))
            same = [i for i, ((s, got), c) in enumerate(zip(sets, b.column("name").to_pylist())) if len(s) and got == c]
            take = pa.array(same, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in ("cell", "blocks", "name", "copies")] + [pa.array([sets[i][0].tobytes() for i in same], pa.binary())], names=["cell", "blocks", "name", "copies", "shingles"])

    points = lean(held, gather, "cell long, blocks int, name long, copies long, shingles binary")
    if turns > 1:
        points = written(points, "cells")
    block = F.pmod("name", F.col("blocks")).cast("int")
    found = []
    for turn in range(turns):
        own_turn = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k + F.pmod("cell", F.lit(turns))) % turns == turn)
        everywhere = F.transform(own_turn, lambda k: F.struct(k.alias("block"), F.when(k == block, 0).otherwise(1).alias("role")))
        dealt = points.withColumn("_p", F.explode(everywhere)).select("cell", "_p.block", "_p.role", "name", "copies", "shingles")
        found.append(saved(lean(dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "role", "name"), _link_cells(kind, links), "a long, b long, n long")))
    return reduce(DataFrame.unionByName, found)


def component_rows(known: DataFrame, classes: DataFrame, found: DataFrame, restore: Callable[[Column], Column], links: bool) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; with ``links`` also n_links, the number of documents it links with."""
    roots = components(found.filter("n = 0").select("a", "b"))
    best = classes.join(roots, F.col("name") == F.col("node"), "left").select("name", "_id", "copies", F.coalesce("root", "name").alias("root"))
    ids = best.groupBy("root").agg(F.min("_id").alias("_least"))
    to = best.join(ids, "root")
    if links:
        count = found.filter("n > 0").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_n"))
        to = to.join(count, F.col("name") == F.col("_a"), "left")
    to = to.select(F.col("name").alias("_name"), "_least", *([(F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("_links")] if links else []))
    out = known.join(to, F.col("name") == F.col("_name"), "left")
    least = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(restore(F.col("_least")))
    more = [F.coalesce("_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    return out.select("doc_id", "n_shingles", least.alias("component_id"), *more)
