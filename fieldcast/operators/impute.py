"""K-nearest-neighbour imputation and the imputation pipelines."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import scratch
from .ranges import HOT_ROWS, by_parts
from .series import interpolate

LEAF = 64
FEW_BLOCKS = 10_000  # each with 15 quantiles of at most 15 columns: 18 MB
FEW_POINTS = 100_000  # distinct rows with NULLs that are broadcast, with the block, the columns and a map
_SLACK = 1 - 1e-9  # bounds and distances round differently


class BoxTree:
    """Rows of one set of present columns in leaves of near rows, each with its bounding box."""

    def __init__(self, x: np.ndarray, columns: np.ndarray):
        self.columns, self.leaves = columns, []
        stack = [np.arange(len(x))]
        while stack:
            own = stack.pop()
            if len(own) <= LEAF:
                self.leaves.append(own)
                continue
            part = x[np.ix_(own, columns)]
            widest = columns[int((part.max(0) - part.min(0)).argmax())]
            order = own[np.argsort(x[own, widest], kind="stable")]
            stack += [order[len(own) // 2 :], order[: len(own) // 2]]
        self.low = np.stack([x[i].min(0) for i in self.leaves])
        self.high = np.stack([x[i].max(0) for i in self.leaves])


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Least scaled distance of a row from each box, over the columns that both have."""
    gap = np.maximum(np.maximum(low[:, shared] - q[shared], q[shared] - high[:, shared]), 0)
    return np.sqrt(len(q) / len(shared) * (gap * gap).sum(1)) * _SLACK


class Tile:
    """Donors of one tile, a tree for each set of present columns; finds the k nearest rows that have a column."""

    def __init__(self, ids: np.ndarray, y: np.ndarray):
        self.ids, self.y, self.seen = ids, y, 0
        there = ~np.isnan(y)
        self.trees = []
        for mask in np.unique(there, axis=0):
            columns = np.flatnonzero(mask)
            rows = np.flatnonzero((there == mask).all(1))
            if len(columns):
                self.trees.append((rows, BoxTree(y[rows], columns)))

    def nearest(self, own: object, q: np.ndarray, c: int, k: int, within: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest at most ``within`` away, ties by id; ``own`` is the row's own id."""
        present = np.flatnonzero(~np.isnan(q))
        boxes, leaves = [np.zeros(0)], []
        for rows, tree in self.trees:
            shared = np.intersect1d(present, tree.columns)
            if c in tree.columns and len(shared):
                boxes.append(bounds(q, tree.low, tree.high, shared))
                leaves += [(rows, leaf) for leaf in tree.leaves]
        bound = np.concatenate(boxes)
        order = np.argsort(bound, kind="stable")
        order = order[bound[order] <= within]
        at, d = np.zeros(0, np.int64), np.zeros(0)
        done = 0
        while done < len(order) and (len(d) < k or bound[order[done]] <= within):
            upto = done  # enough leaves for k rows, then all that may still hold a nearer one
            if len(d) < k:
                need = k + 1 - len(d)
                while upto < len(order) and need > 0:
                    need -= len(leaves[order[upto]][1])
                    upto += 1
            else:
                upto = int(np.searchsorted(bound[order], within, side="right"))
            found = np.concatenate([leaves[i][0][leaves[i][1]] for i in order[done:upto]])
            done = max(upto, done + 1)
            self.seen += len(found)
            gap = self.y[found] - q
            n = (~np.isnan(gap)).sum(1)
            far = np.sqrt(len(q) / n * np.nansum(gap * gap, axis=1))
            keep = self.ids[found] != own
            at, d = np.concatenate([at, found[keep]]), np.concatenate([d, far[keep]])
            best = np.lexsort((self.ids[at], d))[:k]
            at, d = at[best], d[best]
            if len(d) == k:
                within = min(within, d[-1])
        return at, d


def _block(block: str | None) -> Column:
    return F.coalesce(F.col(block).cast("string"), F.lit("\0")) if block else F.lit("")


def _blocks(df: DataFrame, columns: list[str], row_id: str, block: str | None) -> tuple[DataFrame, list[str]]:
    names = [f"_{i}" for i in range(len(columns))]
    cols = df.select(F.col(row_id).alias("_id"), _block(block).alias("_b"), *(F.col(c).cast("double").alias(n) for n, c in zip(names, columns)))
    return cols.withColumn("_ask", F.greatest(F.lit(False), *(F.col(n).isNull() for n in names))), names


def _z_order(cols: DataFrame, names: list[str], side: str, bits: int = 4) -> DataFrame:
    """``_z``: interleaved bits of each column's place among 16 quantiles of its block, so that near rows get near numbers."""
    used = names[:15]
    shares = F.array(*(F.lit(i / (1 << bits)) for i in range(1, 1 << bits)))
    cuts = cols.groupBy("_b").agg(*(F.percentile_approx(n, shares, 1000).alias(f"_q{n}") for n in used))
    d = cols.join(cuts.withColumnRenamed("_b", "_bq").hint(side), F.col("_b") == F.col("_bq"))

    def below(n: str) -> Column:
        return F.size(F.filter(f"_q{n}", lambda x: x <= F.col(n)))

    place = {n: F.coalesce(below(n), F.lit(1 << (bits - 1))) for n in used}
    d = d.withColumns({f"_p{n}": F.when(F.col(n).isNull(), 1 << (bits - 1)).otherwise(v).cast("long") for n, v in place.items()})
    z = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for n in used:
            z = F.shiftleft(z, 1) + F.shiftright(F.col(f"_p{n}"), bit).bitwiseAND(F.lit(1).cast("long"))
    return d.withColumn("_z", z).drop("_bq", *(f"{s}{n}" for n in used for s in ("_q", "_p")))


def _points(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with NULLs and a number, those of equal numbers as one of them, the one of the lowest id.

    A row is no donor for what it lacks, so equal rows have the same neighbours. A row without any number has none.
    """
    some = F.greatest(F.lit(False), *(F.col(n).isNotNull() for n in names))
    rest = [c for c in rows.columns if c not in {"_b", "_id", *names}]
    low = F.min(F.struct("_id", *rest)).alias("_l")
    return rows.filter(F.col("_ask") & some).groupBy("_b", *names).agg(low).select("_b", *names, *(F.col(f"_l.{c}").alias(c) for c in ("_id", *rest)))


def neighbours(df: DataFrame, columns: list[str], row_id: str, block: str | None = None, k: int = 5, query_rows: int = 5_000, donor_rows: int = 20_000, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(_id, _c, _d, _o, _v) of at least the k nearest rows for each NULL cell; rows with _c = -1 count the rows compared, as _d.

    Rows of a block are laid in tiles of near rows. A row with NULLs is first compared within its own tile; with the k-th
    distance found there it goes to the other tiles whose bounding boxes lie nearer, and nowhere else. Equal rows ask once, by
    the lowest of their ids (``_points``). None without NULLs.
    """
    cols, names = _blocks(df, columns, row_id, block)
    kind = dict(cols.dtypes)["_id"]
    sizes = cols.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.max("_ask").alias("_any")).filter("_any")
    largest = sizes.agg(F.max("_n")).first()[0]
    if largest is None:
        return None
    # few blocks go to the rows: by its own estimate Spark may send the rows to the blocks, and one block's rows sort in one task
    side = "broadcast" if sizes.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS else "merge"
    cols = cols.join(sizes.select("_b").hint(side), "_b", "left_semi")
    if largest <= donor_rows:  # a tile a block
        whole = cols.withColumn("_tile", F.lit(0).cast("long"))
    else:
        near = _z_order(cols, names, side)
        whole = by_parts(near, ["_b"], ["_z", "_id"], lambda d, _: d.withColumn("_tile", F.expr(f"(_i - 1) DIV {donor_rows}")), hot_rows=hot_rows).drop("_z")
    path = scratch(df.sparkSession, "tiles")
    whole.write.parquet(path)
    placed, donors = (df.sparkSession.read.parquet(path) for _ in range(2))  # apart, so that they can be cogrouped
    kth = [f"_k{i}" for i in range(len(names))]
    schema = f"_id {kind}, _c int, _d double, _o {kind}, _v double"

    def search(others: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(others) or not len(asks):
            return pd.DataFrame(columns=["_id", "_c", "_d", "_o", "_v"])
        tile = Tile(others["_id"].to_numpy(), others[names].to_numpy(float))
        out, x, limit = [], asks[names].to_numpy(float), asks[kth].to_numpy(float)
        for i, own in enumerate(asks["_id"].to_numpy()):
            before = tile.seen
            for c in np.flatnonzero(np.isnan(x[i])):
                at, d = tile.nearest(own, x[i], c, k, limit[i, c])
                out += [(own, int(c), far, tile.ids[j], tile.y[j, c]) for j, far in zip(at, d)]
            out.append((own, -1, float(tile.seen - before), own, 0.0))
        return pd.DataFrame(out, columns=["_id", "_c", "_d", "_o", "_v"])

    def dealt(asks: DataFrame) -> DataFrame:
        """Queries meet the donors of their tile, many queries in several groups."""
        groups = asks.groupBy("_b", "_tile").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("_n"))
        own = asks.join(groups, ["_b", "_tile"]).withColumn("_g", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
        others = donors.select("_b", "_tile", "_id", *names).join(groups, ["_b", "_tile"]).withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        by = ["_b", "_tile", "_g"]
        return others.drop("_n").groupBy(*by).cogroup(own.drop("_n").groupBy(*by)).applyInPandas(search, schema)

    path = scratch(df.sparkSession, "asks")
    _points(placed, names).select("_b", "_tile", "_id", *names).write.parquet(path)
    asks = df.sparkSession.read.parquet(path)
    first = dealt(asks.withColumns({c: F.lit(float("inf")) for c in kth}))
    if largest <= donor_rows:
        return first
    path = scratch(df.sparkSession, "near")
    first.write.parquet(path)
    first = df.sparkSession.read.parquet(path)
    box = [F.min(n).alias(f"_lo{n}") for n in names] + [F.max(n).alias(f"_hi{n}") for n in names]
    cells = donors.groupBy("_b", "_tile", *(F.col(n).isNotNull().alias(f"_has{n}") for n in names)).agg(*box)
    several = placed.groupBy("_b").agg(F.max("_tile").alias("_m")).filter("_m > 0").select("_b")
    if several.isEmpty():
        return first
    reach = first.filter("_c >= 0").groupBy("_id").agg(*(F.when(F.count(F.when(F.col("_c") == i, 1)) >= k, F.max(F.when(F.col("_c") == i, F.col("_d")))).alias(n) for i, n in enumerate(kth)))
    far = asks.join(several, "_b", "left_semi").join(reach, "_id", "left").withColumns({n: F.coalesce(n, F.lit(float("inf"))) for n in kth})
    chunks = far.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / (10 * query_rows)).cast("int").alias("_n"))

    def route(_: tuple, own: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(boxes):
            return own.iloc[:0][["_b", "_tile", "_id", *names, *kth]]
        has = boxes[[f"_has{n}" for n in names]].to_numpy(bool)
        low, high, tile = boxes[[f"_lo{n}" for n in names]].to_numpy(float), boxes[[f"_hi{n}" for n in names]].to_numpy(float), boxes["_tile"].to_numpy()
        x, limit, home = own[names].to_numpy(float), own[kth].to_numpy(float), own["_tile"].to_numpy()
        rows, to = [], []
        masks = [(m, np.flatnonzero((has == m).all(1))) for m in np.unique(has, axis=0)]
        for i in range(len(own)):
            present, hit = ~np.isnan(x[i]), []
            for m, at in masks:
                shared = np.flatnonzero(present & m)
                wanted = limit[i][~present & m]
                if len(shared) and len(wanted):
                    hit.append(at[bounds(x[i], low[at], high[at], shared) <= wanted.max()])
            near = np.unique(tile[np.concatenate(hit)]) if hit else np.zeros(0, np.int64)
            near = near[near != home[i]]
            rows.append(np.full(len(near), i))
            to.append(near)
        return own.iloc[np.concatenate(rows)].assign(_tile=np.concatenate(to))[["_b", "_tile", "_id", *names, *kth]]

    own = far.join(chunks, "_b").withColumn("_g", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    every = cells.join(chunks, "_b").withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    doubles = "".join(f", {n} double" for n in [*names, *kth])
    routed = own.drop("_n").groupBy("_b", "_g").cogroup(every.drop("_n").groupBy("_b", "_g")).applyInPandas(route, f"_b string, _tile long, _id {kind}{doubles}")
    path = scratch(df.sparkSession, "routes")
    routed.write.parquet(path)
    return first.unionByName(dealt(df.sparkSession.read.parquet(path)))


def knn_impute(df: DataFrame, columns: list[str], row_id: str, block: str | None = None, k: int = 5, query_rows: int = 5_000, donor_rows: int = 20_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fill NULLs by the inverse-distance mean of the k nearest rows of the block that have the column.

    Distances are Euclidean over the columns both rows have, scaled up by all over shared columns. Donors at distance 0 win
    alone; ties go to the lower row id; a cell without donors gets the column mean. Rows with NULLs are the query set. Without
    NULLs the table comes back as it is. Rows are found through ``neighbours``, so a block may be of any size.
    """
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)  # read many times, and series before it are long
    df = df.sparkSession.read.parquet(path)
    found = neighbours(df, columns, row_id, block, k, query_rows, donor_rows, hot_rows)
    if found is None:
        return df
    near = found.filter("_c >= 0").groupBy("_id", "_c").agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "_o", "_v"))), 1, k).alias("_n"))
    zero = F.filter("_n", lambda x: x["_d"] == 0)

    def mean(a: Column, w) -> Column:
        return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + w(x) * x["_v"]), F.aggregate(a, F.lit(0.0), lambda s, x: s + w(x)))

    value = F.when(F.size(zero) > 0, mean(zero, lambda x: F.lit(1.0))).otherwise(mean(F.col("_n"), lambda x: F.try_divide(F.lit(1.0), x["_d"])))
    cells = near.select("_id", "_c", value.alias("_f")).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_f"))).alias("_m"))
    means = df.agg(*(F.avg(c).alias(f"_a{i}") for i, c in enumerate(columns)))
    rows, names = _blocks(df, columns, row_id, block)
    filled = _points(rows, names).join(cells, "_id").select(F.col("_b").alias("_kb"), *(F.col(n).alias(f"_k{n}") for n in names), "_m")
    path = scratch(df.sparkSession, "filled")
    filled.write.parquet(path)
    filled = df.sparkSession.read.parquet(path)
    few = filled.limit(FEW_POINTS + 1).count() <= FEW_POINTS
    d = df.withColumns({"_b": _block(block), **{n: F.col(c).cast("double") for n, c in zip(names, columns)}})
    same = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"_k{n}")) for n in names), F.col("_b") == F.col("_kb"))
    d = d.join(F.broadcast(filled) if few else filled, same, "left").crossJoin(F.broadcast(means))
    return d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_m")[i], F.col(f"_a{i}")) for i, c in enumerate(columns)}).select(*df.columns)


def impute(df: DataFrame, columns: list[str], row_id: str, key: list[str] | None = None, time: str | None = None, block: str | None = None) -> DataFrame:
    """Time series (``time`` given): linear per series, then neighbours for what remains. Else neighbours only."""
    if time is not None:
        df = interpolate(df, key or [], time, columns)
    return knn_impute(df, columns, row_id, block)
