"""Rows by position in id order, from histograms of the key column.

Keys are counted per length and leading characters; the counts say which group holds a position,
and only that group is counted again by more characters. Nothing is sorted but the groups of one
histogram, no other column is read until the keys at the edges are known, and these are a plain
range filter on the table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHARS = 3       # more characters of the key in each pass: at most a thousand groups of digits
FEW = 100_000   # a group of at most so many rows is counted by whole keys at once


class Place(NamedTuple):
    key: str | None
    before: int   # rows with a smaller key
    copies: int   # rows with this key


def places(df: DataFrame, positions: list[int], key: str = "review_id") -> dict[int, Place]:
    """The key at each 0-based position (few of them); positions past the end are left out.

    Null keys come first. A pass scans the key column; a key of n characters takes n / 3 passes
    at most, and two in all when the groups of the first pass are small.
    """
    size = F.coalesce(F.length(key), F.lit(-1))
    keys = df.select(F.coalesce(F.col(key), F.lit("")).alias("k"), size.alias("size"))
    wanted = sorted({p for p in positions if p >= 0})
    groups = {p: None for p in wanted}  # position -> (size, prefix, before, rows); None: the whole table
    found, width = {}, 0
    while groups:
        known = {g for g in groups.values() if g}
        whole = bool(known) and all(rows <= FEW for _, _, _, rows in known)
        seen, width = width, 0 if whole else width + CHARS
        part = keys.where(any_of([(F.col("size") == s) & F.col("k").startswith(p) for s, p, _, _ in known])) if known else keys
        prefix = F.col("k") if whole else F.substring("k", 1, width)
        counts = part.groupBy("size", prefix.alias("prefix")).agg(F.count("*").alias("n"))
        parents = ["size", F.substring("prefix", 1, seen)] if known else []
        running = F.sum("n").over(W.partitionBy(*parents).orderBy("size", "prefix")) - F.col("n")
        base = F.lit(0)
        for s, p, before, _ in known:
            base = F.when((F.col("size") == s) & F.col("prefix").startswith(p), before).otherwise(base)
        ranked = counts.withColumn("before", running + base)
        holds = any_of([(F.col("before") <= p) & (F.col("before") + F.col("n") > p) for p in groups])
        rows, left = ranked.where(holds).collect(), {}
        for p in groups:
            for r in rows:
                if r["before"] <= p < r["before"] + r["n"]:
                    if whole or r["size"] <= width:
                        found[p] = Place(r["prefix"] if r["size"] >= 0 else None, r["before"], r["n"])
                    else:
                        left[p] = (r["size"], r["prefix"], r["before"], r["n"])
        groups = left
    return found


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def compared(key: str, edge: str | None, after: bool, equal: bool) -> Column:
    """Keys after (or before) the edge in id order, with the edge itself or without it; never null."""
    if edge is None:
        return F.col(key).isNull() if equal and not after else F.lit(True) if equal else F.col(key).isNotNull() if after else F.lit(False)
    k, n = F.col(key), F.length(key)
    longer = n > len(edge) if after else n < len(edge)
    same = (k >= edge if equal else k > edge) if after else (k <= edge if equal else k < edge)
    inside = longer | ((n == len(edge)) & same)
    return F.coalesce(inside, F.lit(not after))  # null keys come first


def between(df: DataFrame, start: int, stop: int, key: str = "review_id") -> DataFrame:
    """The rows at positions [start, stop) of the id order; which of several rows with the key of
    an edge is open, their number is not."""
    start = max(start, 0)
    if stop <= start:
        return df.where(F.lit(False))
    edges = places(df, [start, stop - 1], key)
    low, high = edges.get(start), edges.get(stop - 1)
    if low is None:
        return df.where(F.lit(False))
    skipped, spare = start - low.before, high.before + high.copies - stop if high else 0
    above = compared(key, low.key, True, not skipped)
    below = compared(key, high.key, False, not spare) if high else F.lit(True)
    equal = lambda edge: F.col(key).eqNullSafe(F.lit(edge.key).cast("string"))
    if high and low.key == high.key:
        rows = df.where(equal(low))
        return rows if not skipped and not spare else rows.limit(stop - start)
    rows = df.where(above & below)
    if skipped:
        rows = rows.unionByName(df.where(equal(low)).limit(low.copies - skipped))
    if spare:
        rows = rows.unionByName(df.where(equal(high)).limit(high.copies - spare))
    return rows


def first(df: DataFrame, n: int, key: str = "review_id") -> DataFrame:
    """The first n rows in id order, for any n."""
    return between(df, 0, n, key)


def page(df: DataFrame, start: int, size: int, key: str = "review_id", name: str = "row_index") -> DataFrame:
    """The rows [start, start + size) with their positions; only these rows are sorted."""
    order = W.orderBy(F.length(key), key)
    return between(df, start, start + size, key).withColumn(name, F.lit(max(start, 0)).cast("bigint") + F.row_number().over(order) - 1)
