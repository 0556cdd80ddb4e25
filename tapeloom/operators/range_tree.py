"""Compare tables by a tree of digests over ranges of a key, and read only the ranges that differ.

A leaf is a range of the key of about ``rows`` rows; its digest is its rows' number and the xor and sum of two hashes of
them, which add up: a node's digest comes from its children's, not from rows. Two trees over the same ranges are compared from
the root, and only below nodes that differ. A table that is stored in order of its key (`export.write_partitions`, or any sorted Parquet) is then
read in the differing ranges alone, by a filter that reaches the scan.

Rows are compared as a multiset, so that repeated keys and repeated rows are exact; two leaves with different rows pass for
equal with a chance of about 2 ** -128. Null keys are a leaf of their own. Columns of maps cannot be compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.shared import pinned
from tapeloom.operators.grains import ROWS, Grains
from tapeloom.operators.kernels import spare

#: Children of a node, and the most ranges that are told to a scan one by one (beyond them rows are matched to leaves by broadcast).
FAN_OUT, MOST_RANGES = 16, 100
DIGEST = ("n", "xor_hash", "sum_hash")


def _hash(columns: Sequence[str], seed: int) -> Column:
    """Of a row's values; hashes pass nulls over, so which columns are null counts as well."""
    cols = [F.col(f"`{c}`") for c in sorted(columns)]
    return F.xxhash64(F.lit(seed), *cols, *[c.isNull() for c in cols])


@dataclass
class Tree:
    """A table's digests: ``levels[0]`` has a row per leaf (with the least and greatest key), the last has the root."""

    ranges: Grains
    levels: list[DataFrame]


def ranges_of(df: DataFrame, key: str, rows: int = ROWS) -> Grains:
    """Ranges of ``key`` that hold about ``rows`` rows of ``df`` each; any table with such a key can have a tree over them."""
    return Grains(df, key, (), rows)


def _placed(df: DataFrame, ranges: Grains) -> tuple[DataFrame, str]:
    (leaf,) = spare(df.columns, "_leaf")
    own = Grains.like(ranges, df)
    # nulls are leaf 0
    return own.placed(singles=False).withColumn(leaf, (F.col(own.grain) + 1).cast("long")).select(*df.columns, leaf), leaf


def tree_of(df: DataFrame, ranges: Grains) -> Tree:
    """The digests of ``df`` over ``ranges``; one pass over the rows, pre-aggregated before the shuffle."""
    placed, leaf = _placed(df, ranges)
    low, high = F.min(ranges.column), F.max(ranges.column)
    leaves = placed.groupBy(F.col(leaf).alias("node")).agg(F.count("*").alias("n"), F.bit_xor(_hash(df.columns, 1)).alias("xor_hash"),
                                                           F.sum(_hash(df.columns, 2).cast("decimal(38,0)")).alias("sum_hash"), low.alias("low"), high.alias("high"))
    levels, width = [pinned(leaves)], ranges.parts + 2
    while width > 1:
        width = -(-width // FAN_OUT)
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN_OUT).alias("node"))
        levels.append(up.agg(F.sum("n").alias("n"), F.bit_xor("xor_hash").alias("xor_hash"), F.sum("sum_hash").cast("decimal(38,0)").alias("sum_hash")))
    return Tree(ranges, levels)


def differing_leaves(a: Tree, b: Tree) -> DataFrame:
    """(node, low, high) of the leaves whose rows differ, found from the root down; the trees must be over the same ranges."""
    if a.ranges is not b.ranges:
        raise ValueError("the trees are over different ranges")
    found = None
    for level in reversed(range(len(a.levels))):
        x, y = a.levels[level], b.levels[level]
        if found is not None:
            up = F.broadcast(found.select(F.col("node").alias("parent")))
            x, y = (t.join(up, F.floor(t["node"] / FAN_OUT) == F.col("parent"), "left_semi") for t in (x, y))
        ends = [c for c in ("low", "high") if level == 0]
        x, y = (t.select("node", F.struct(*DIGEST).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ends]) for t, side in ((x, "a"), (y, "b")))
        both = x.join(y, "node", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        found = both.select("node", *[f(f"a_{c}", f"b_{c}").alias(c) for c, f in zip(ends, (F.least, F.greatest))])
    return found


def _within(df: DataFrame, ranges: Grains, leaves: DataFrame) -> DataFrame:
    """The rows of ``df`` in ``leaves``, and no others of those leaves' neighbours that matter."""
    few = leaves.limit(MOST_RANGES + 1).collect()
    if len(few) > MOST_RANGES:
        placed, leaf = _placed(df, ranges)
        return placed.join(F.broadcast(leaves.select(F.col("node").alias(leaf))), leaf, "left_semi").select(*df.columns)
    key, asked = F.col(ranges.column), F.lit(False)
    for r in few:
        asked = asked | (key.isNull() if r["node"] == 0 else (key >= F.lit(r["low"])) & (key <= F.lit(r["high"])))
    return df.where(asked)


def diff_rows(a: DataFrame, b: DataFrame, key: str, rows: int = ROWS, trees: tuple[Tree, Tree] | None = None) -> DataFrame:
    """Rows that one table has more often than the other, with ``surplus``: how many more ``a`` has (less than 0: ``b``).

    Both have the same columns. ``trees`` are theirs, if made before, over the same ranges. A key that is changed gives two rows. The
    tables must not change meanwhile.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    if trees is None:
        ranges = ranges_of(a, key, rows)
        trees = tree_of(a, ranges), tree_of(b, ranges)
    leaves = pinned(differing_leaves(*trees))
    (surplus,) = spare(a.columns, "surplus")
    near = [_within(t, trees[0].ranges, leaves).select(*a.columns, F.lit(s).alias(surplus)) for t, s in ((a, 1), (b, -1))]
    return near[0].unionByName(near[1]).groupBy(*a.columns).agg(F.sum(surplus).alias(surplus)).where(F.col(surplus) != 0)
