"""SimHash fingerprints of 128 bits, in DataFrame functions only.

A term is a pair of neighbouring words; its weight (1 to 4) grows with its letters. Each term's hash votes with its weight
on 128 bits; a bit is set where more than half of the weight votes for it. Votes are counted in two steps of generated code:
first in chunks of 31 terms, eight 8-bit lanes to a long (16 sums a term), then over a document's chunks in 32-bit lanes.
A text and its edited text share the words before the cut, so these are split, hashed and counted once.

Documents are dealt once, to ranges of ids; order, votes and the next document's fingerprint all follow from that one shuffle.
``near`` finds all pairs within a Hamming radius by block tables: with radius r, two such fingerprints agree in one of r + 1
blocks at least. Equal fingerprints are one entry; a block value that many share is parted again by blocks of its other bits.

Defined cases: null text is empty; texts without words have one empty term, so they share a fingerprint; very long texts are
counted in chunks like all others; null ids come first in order, and ids must be integers; equal ids are ordered by a hash of their text, then by text;
repeated rows each get a row; the only document is its own next; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

BITS = 128
CHUNK = 31  # of weights up to 4: a lane of the highest byte stays under 128
_BYTES = 0x0101010101010101
_LANES = 0x000000FF000000FF
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
RANGE_ROWS = 256
LEVEL = 1024


def words(text: Column) -> Column:
    """Lower-cased; sigma is the one letter whose lower case depends on what stands beside it."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("Σ"), F.lit("σ"))), f"{_BETWEEN}+"), "")


def pairs(words: Column) -> Column:
    """Structs (0, 1) of each word and the one after it; the last has none."""
    return F.arrays_zip(F.slice(words, 1, 2147483647), F.slice(words, 2, 2147483647))


def votes(rows: DataFrame, keys: list[str], which: str, pair_array: str) -> DataFrame:
    """Per key, ``which`` and chunk of terms: ``_total`` weight and byte lanes ``_c{word}_{i}`` of the bits 8j + i."""
    t = rows.select(*keys, which, F.posexplode(pair_array).alias("_p", "_t"))
    a, b = F.col("_t")["0"], F.col("_t")["1"]
    letters = F.least(F.lit(15), F.length(a)) + F.least(F.lit(15), F.coalesce(F.length(b), F.lit(0)))
    t = t.select(*keys, which, F.expr(f"_p div {CHUNK}").alias("_chunk"), F.xxhash64(a, b).alias("_h0"), (F.least(F.lit(18), letters) / 6).cast("long").alias("_w"))
    t = t.select(*keys, which, "_chunk", "_h0", F.xxhash64("_h0").alias("_h1"), (F.col("_w") + 1).alias("_w"))
    lane = [F.expr(f"sum((shiftright(_h{k}, {i}) & {_BYTES}L) * _w) AS _c{k}_{i}") for k in (0, 1) for i in range(8)]
    return t.groupBy(*keys, which, "_chunk").agg(F.sum("_w").alias("_total"), *lane)


def fingerprints(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with longs ``f0`` and ``f1``."""
    lane = [F.expr(f"sum(shiftright(_c{k}_{m % 8}, {m - m % 8}) & {_LANES}L) AS _v{k}_{m}") for k in (0, 1) for m in range(32)]  # bits m and m + 32
    counted = chunks.groupBy(*keys).agg(F.sum("_total").alias("_total"), *lane)

    def word(k: int) -> Column:
        low = [f"if((_v{k}_{i} & 4294967295L) * 2 > _total, {_signed(1 << i)}L, 0L)" for i in range(32)]
        high = [f"if(shiftrightunsigned(_v{k}_{i}, 32) * 2 > _total, {_signed(1 << (i + 32))}L, 0L)" for i in range(32)]
        return F.expr(" | ".join(low + high))

    return counted.select(*keys, word(0).alias("f0"), word(1).alias("f1"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))).cast("long")


def _upto(bounds: Column, x: Column, most: int) -> Column:
    """How many of the sorted bounds (``most`` or fewer) are at most x, by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(bounds, at + k - 1) <= x, at + k).otherwise(at))


def _ranges(d: DataFrame, rows: int, level: int) -> tuple[DataFrame, int]:
    """Add ``_b``, ascending with (_o, _h), for ranges of about so many rows; and their greatest number.

    Bounds are approximate percentiles of ids. Where these are too many for one list, or one id has whole ranges to itself,
    each range is cut again, by ids or (within one id) by hashes of texts. The second lists are one row for each first range.
    """
    n = d.count()
    first = min(level, max(1, n // rows))
    if first == 1:
        return d.withColumn("_b", F.lit(0).cast("long")), 1
    shares = lambda k: F.array(*(F.lit(i / k) for i in range(1, k)))
    found = d.agg(F.percentile_approx("_o", shares(first), 100 * first)).first()[0]
    hot = {x for x in found if found.count(x) > 1}
    bounds = sorted({*found, *(x + 1 for x in hot)})
    d = d.withColumn("_b", _upto(F.array(*map(F.lit, bounds)), F.col("_o"), len(bounds)).cast("long"))
    if not hot and n // rows <= level:
        return d, first
    second = min(level, max(2, -(-n // (rows * first)), *(-(-n * found.count(x) // (first * rows)) for x in hot)))
    cut = lambda c: F.array_distinct(F.percentile_approx(c, shares(second), 100 * second))
    lists = d.groupBy("_b").agg(F.min("_o").alias("_lo"), F.max("_o").alias("_hi"), cut("_o").alias("_bo"), cut("_h").alias("_bh"))
    one = F.col("_lo") == F.col("_hi")
    lists = lists.select(F.col("_b").alias("_b1"), one.alias("_one"), F.when(one, F.col("_bh")).otherwise(F.col("_bo")).alias("_list"))
    d = d.join(F.broadcast(lists), F.col("_b") == F.col("_b1"))  # at most 2 * level lists of level longs: 16 MB
    at = _upto(F.col("_list"), F.when(F.col("_one"), F.col("_h")).otherwise(F.col("_o")), second)
    return d.withColumn("_b", F.col("_b") * (2 * level) + at).drop("_b1", "_one", "_list"), len(bounds) * second


def with_next(docs: DataFrame, rows: int = RANGE_ROWS, level: int = LEVEL) -> DataFrame:
    """(_b, _r, doc_id, text, next_text, _x): documents in order, by range and place; the next of the last is the first.

    Each range also has a copy of the next range's first row (``_x`` is 1), so no window spans more than a range.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({"_o": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64("text")})
    d, most = _ranges(d, rows, level)
    firsts = d.groupBy("_b").agg(F.min(F.struct("_o", "_h")).alias("_f"))
    before = F.coalesce(F.lag("_b").over(Window.orderBy("_b")), F.max("_b").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("_f._o").alias("_fo"), F.col("_f._h").alias("_fh"), before.alias("_to"))  # one row per range
    same = (F.col("_o") == F.col("_fo")) & (F.col("_h") == F.col("_fh"))
    heads = d.drop("_b").join(F.broadcast(firsts) if most <= 1 << 17 else firsts, same).groupBy("_to").agg(F.min(F.struct("_o", "_h", "text", "doc_id")).alias("_f"))
    extra = heads.select("_f.doc_id", "_f.text", "_f._o", "_f._h", F.col("_to").alias("_b"), F.lit(1).alias("_x"))
    own = Window.partitionBy("_b").orderBy("_x", "_o", "_h", "text")
    both = d.withColumn("_x", F.lit(0)).unionByName(extra)
    return both.select("_b", F.row_number().over(own).alias("_r"), "doc_id", "text", F.lead("text").over(own).alias("next_text"), "_x")


def _as_longs(hex_text: Column) -> list[Column]:
    """Hex digits, 16 to a long."""
    word = lambda i: F.conv(F.substring(hex_text, i, 8), 16, 10).cast("long")
    return [F.shiftleft(word(16 * k + 1), 32).bitwiseOR(word(16 * k + 9)) for k in range(4)]


def _as_hex(*longs: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in longs)))


def edited_and_next(docs: DataFrame, radius: int = 5, rows: int = RANGE_ROWS, level: int = LEVEL) -> DataFrame:
    """Fingerprint of each text, of its edited text and of the next document, with their likeness.

    ``n_near``, for ids divisible by 100 (else null): how many other rows have a fingerprint within ``radius``.
    """
    c = F.col
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    base = with_next(docs, rows, level).withColumns({"n_chars": n.cast("long"), "_kept": F.left("text", n - cut)})
    base = base.withColumn("edited", F.when(c("_x") == 0, F.concat("_kept", F.left("next_text", cut))))
    base = base.withColumn("_head", F.regexp_extract("_kept", f"(?s)^(.*{_BETWEEN})", 1))  # up to the last whole word
    base = base.withColumns({f"s{k}": x for k, x in enumerate(_as_longs(F.sha2("edited", 256)))})
    keys = ["_b", "_r", "_x", "doc_id", "n_chars", "s0", "s1", "s2", "s3"]
    base = base.withColumns({"_shared": words(c("_head")), "_skip": F.length("_head") + 1})

    for side in ("text", "edited"):  # words that begin in the last shared one or after it; one empty word if there is none at all
        base = base.withColumn(f"_{side}", F.concat(F.slice("_shared", -1, 1), words(F.substring(c(side), c("_skip"), F.lit(2147483647)))))
        base = base.withColumn(f"_{side}", pairs(F.when(F.size(f"_{side}") == 0, F.array(F.lit(""))).otherwise(c(f"_{side}"))))
    base = base.withColumn("_shared", F.slice(pairs(c("_shared")), F.lit(1), F.greatest(F.size("_shared") - 1, F.lit(0))))
    parts = base.select(*keys, F.posexplode(F.array("_shared", "_text", "_edited")).alias("_which", "_pairs"))
    chunks = votes(parts, keys, "_which", "_pairs")
    sides = F.when(c("_which") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(c("_which") - 1))
    fp = fingerprints(chunks.withColumn("_side", F.explode(sides)), [*keys, "_side"])
    one = lambda k, f: F.max(F.when(c("_side") == k, c(f)))
    fp = fp.groupBy(*keys).agg(one(0, "f0").alias("a0"), one(0, "f1").alias("a1"), one(1, "f0").alias("e0"), one(1, "f1").alias("e1"))
    order = Window.partitionBy("_b").orderBy("_r")
    fp = saved(fp.withColumns({"x0": F.lead("a0").over(order), "x1": F.lead("a1").over(order)}).filter("_x = 0").drop("_b", "_r", "_x"))
    own = fp.select("doc_id", c("a0").alias("f0"), c("a1").alias("f1"))
    asked = own.filter(c("doc_id") % 100 == 0).select("f0", "f1").distinct()
    copies = own.groupBy(c("f0").alias("g0"), c("f1").alias("g1")).agg(F.count(F.lit(1)).alias("_n"))
    found = near(asked, own, radius).join(copies, ["g0", "g1"]).groupBy(c("f0").alias("_q0"), c("f1").alias("_q1")).agg((F.sum("_n") - 1).alias("_near"))
    query = c("doc_id") % 100 == 0
    out = fp.join(found, query & (c("a0") == c("_q0")) & (c("a1") == c("_q1")), "left")
    return out.select(
        "doc_id",
        "n_chars",
        _as_hex(c("s0"), c("s1"), c("s2"), c("s3")).alias("edited_sha256"),
        _as_hex(c("a0"), c("a1")).alias("fingerprint"),
        _as_hex(c("e0"), c("e1")).alias("edited_fingerprint"),
        (1 - distance(c("a0"), c("a1"), c("e0"), c("e1")) / BITS).alias("near_edited"),
        (1 - distance(c("a0"), c("a1"), c("x0"), c("x1")) / BITS).alias("near_next"),
        c("_near").alias("n_near"),
    )


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [bits[round(k * len(bits) / n) : round((k + 1) * len(bits) / n)] for k in range(n)]


def _value(bits: list[int], f: str) -> str:
    """Hash of these of the 128 bits of f0 and f1 (or g0 and g1), as SQL."""
    mask = [_signed(sum(1 << (b - 64 * w) for b in bits if b // 64 == w)) for w in (0, 1)]
    return f"xxhash64({f}0 & {mask[0]}L, {f}1 & {mask[1]}L)"


def near(queries: DataFrame, corpus: DataFrame, radius: int, hot: int = 1000) -> DataFrame:
    """(f0, f1, g0, g1, distance): all pairs of a query's and a corpus fingerprint within the radius, each once.

    Both sides are made distinct first, so copies aren't paired; join the result with the rows again for members. Where more
    than ``hot`` corpus fingerprints share a block, a pair needs an equal block of its other bits as well, again one of
    radius + 1, so the entries are dealt to these.
    """
    n = radius + 1
    blocks = _blocks(list(range(BITS)), n)
    subs = [_blocks([b for b in range(BITS) if b not in own], n) for own in blocks]

    def tables(df: DataFrame, f: str) -> DataFrame:
        own = df.select(F.col("f0").alias(f"{f}0"), F.col("f1").alias(f"{f}1")).distinct()
        return own.selectExpr("*", f"posexplode(array({', '.join(_value(x, f) for x in blocks)})) AS (_i, _block)")

    def dealt(t: DataFrame, f: str) -> DataFrame:
        by = " ".join(f"WHEN _many AND _i = {i} THEN array({', '.join(_value(x, f) for x in subs[i])})" for i in range(n))
        t = t.join(heavy, ["_i", "_block"], "left").withColumn("_many", F.coalesce("_many", F.lit(False)))
        return t.selectExpr(f"{f}0", f"{f}1", "_i", "_block", "_many", f"posexplode(CASE {by} ELSE array(0L) END) AS (_j, _sub)")

    q, c = tables(queries, "f"), tables(corpus, "g")
    heavy = c.groupBy("_i", "_block").agg((F.count(F.lit(1)) > hot).alias("_many")).filter("_many")
    q, c = dealt(q, "f"), dealt(c, "g").drop("_many")
    d = distance(F.col("f0"), F.col("f1"), F.col("g0"), F.col("g1"))
    pairs = q.join(c, ["_i", "_block", "_j", "_sub"]).withColumn("distance", d).filter(F.col("distance") <= radius)
    same = lambda bits: f"{_value(bits, 'f')} = {_value(bits, 'g')}"
    earlier = [f"_i > {i} AND {same(blocks[i])}" for i in range(n)]
    earlier += [f"_many AND _i = {i} AND _j > {j} AND {same(subs[i][j])}" for i in range(n) for j in range(n)]
    return pairs.filter(f"NOT ({' OR '.join(f'({x})' for x in earlier)})").select("f0", "f1", "g0", "g1", "distance")
