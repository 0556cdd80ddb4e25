"""Benchmark decontamination by greedy string tiling.

A seed is a run of ``min_match`` consecutive words, hashed by running
Karp-Rabin. The seeds of the benchmark and of the documents are joined; a
filter of the benchmark's seeds, of bounded size, first keeps most of the
documents' seeds out of the join. A document and an item that share seeds are
compared by greedy string tiling: the longest common run of words not yet
marked is marked on both sides, again and again, until no common run of
``min_match`` words is left. The share of the item's words that is marked is
its coverage. Tiles may lie in any order, so a passage whose sentences were
moved around is caught as well.

No tile can lie outside the document's seeds, so only the stretches of words
around them go to the comparison, never whole texts. Tiles of ``k`` words hold
``k - min_match + 1`` seeds, so an item covered to the threshold shares at
least a ``min_match``-th of that many of its seeds: one less of its seeds, those
that most documents hold, can be left out of the join without losing a pair.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import WordHashes, fresh, materialize

#: Characters of scripts that put no spaces between words: each is a word.
_SINGLE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
WORD = re.compile(rf"[{_SINGLE}]|[^\W{_SINGLE}]+")
_HASHES = WordHashes("decontamination", seed=9)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bits of the filter for each seed of the benchmark, and at least and at most.
FILTER_BITS_A_SEED, LEAST_FILTER, MOST_FILTER = 32, 1 << 16, 1 << 27
#: An item's pairs are compared in this many parts, so that one item of a third of all documents is not one task's.
SALTS = 16
#: Matches of single windows that are turned into runs at once.
MATCHES_AT_ONCE = 1 << 20


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of every word, lower-cased, in order."""
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _grown(k: int, base: int, n: int) -> np.ndarray:
    if n > 1 << 20:  # one very long text; not remembered
        return _powers(base, n)
    if len(_POWERS[k]) < n:
        _POWERS[k] = _powers(base, min(1 << 20, 2 * n))
    return _POWERS[k][:n]


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` tokens, modulo 2**64."""
    n = len(tokens)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * _grown(0, _BASE, n), dtype=np.uint64)])
    return (total[size:] - total[:-size]) * _grown(1, _INVERSE, n)[:n - size + 1]


def seeds(tokens: np.ndarray, size: int) -> np.ndarray:
    """Window hashes with their high bits well mixed; windows of different sizes differ."""
    h = window_hashes(tokens, size) + np.uint64(size)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def match_runs(pattern: np.ndarray, text: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(pattern position, text position, length) of all common runs of at least ``size`` tokens that no side extends."""
    hp, ht = window_hashes(pattern, size), window_hashes(text, size)
    order = np.argsort(ht, kind="stable")
    low, high = np.searchsorted(ht[order], hp, "left"), np.searchsorted(ht[order], hp, "right")
    found = np.flatnonzero(high > low)
    out: list[tuple[int, int, int]] = []
    at = 0
    upto = np.cumsum((high - low)[found])
    while at < len(found):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MATCHES_AT_ONCE, "right")))
        i = np.repeat(found[at:end], (high - low)[found[at:end]])
        j = np.concatenate([order[low[k]:high[k]] for k in found[at:end]])
        first = (i == 0) | (j == 0) | (pattern[i - 1] != text[j - 1])
        i, j = i[first], j[first]
        length, going = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(going):
            p, t = i[going] + length[going], j[going] + length[going]
            inside = (p < len(pattern)) & (t < len(text))
            going, p, t = going[inside], p[inside], t[inside]
            going = going[pattern[p] == text[t]]
            length[going] += 1
        out += [m for m in zip(i.tolist(), j.tolist(), length.tolist()) if m[2] >= size]
        at = end
    return out


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (pattern position, text position, length), longest first.

    Of equally long runs the one first in the pattern, then first in the text,
    is marked. A run that a tile has cut goes back into the queue as what is left of it.
    """
    free_p, free_t = np.ones(len(pattern), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    queue = [(-k, i, j) for i, j, k in match_runs(pattern, text, min_match)]
    heapq.heapify(queue)
    while queue:
        k, i, j = heapq.heappop(queue)
        k = -k
        both = free_p[i:i + k] & free_t[j:j + k]
        if both.all():
            tiles.append((i, j, k))
            free_p[i:i + k] = False
            free_t[j:j + k] = False
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, both, False]))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo >= min_match:
                heapq.heappush(queue, (lo - hi, i + lo, j + lo))
    return tiles


def covered(pattern: np.ndarray, text: np.ndarray, min_match: int, threshold: float) -> tuple[float, int] | None:
    """(coverage, tiles) of the pattern if it is covered to the threshold; shorter ones than ``min_match`` match whole."""
    size = min(min_match, len(pattern))
    if np.isin(window_hashes(pattern, size), window_hashes(text, size)).sum() < len(pattern) * threshold / min_match - 1e-9:
        return None
    tiles = greedy_tiles(pattern, text, size)
    coverage = sum(k for _, _, k in tiles) / len(pattern)
    return (coverage, len(tiles)) if tiles and coverage >= threshold else None


def _items(benchmark: DataFrame, id_col: str, text_col: str, min_match: int) -> DataFrame:
    """(item, item_id, words, size, tokens, seeds) of each distinct item with words; ``size`` is its seeds' length."""
    @F.pandas_udf("words int, size int, tokens binary, seeds array<long>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        tokens = [word_hashes(t) for t in texts]
        sizes = [min(min_match, len(t)) for t in tokens]
        return pd.DataFrame({"words": [len(t) for t in tokens], "size": sizes, "tokens": [t.tobytes() for t in tokens],
                             "seeds": [seeds(t, s).view(np.int64) if s else [] for t, s in zip(tokens, sizes)]})

    known = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("t")).distinct()
    return known.select(F.monotonically_increasing_id().alias("item"), "item_id", cut("t").alias("c")).select("item", "item_id", "c.*").where("words > 0")


def _filter(items: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the items' seeds, two bits each, as bytes, and its size as a power of two; at most ``MOST_FILTER`` bits."""
    count = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    power = min(MOST_FILTER, max(LEAST_FILTER, count * FILTER_BITS_A_SEED)).bit_length() - 1
    seed = items.select(F.explode("seeds").alias("seed"))
    bit = F.explode(F.array(F.shiftrightunsigned("seed", 64 - power), F.col("seed").bitwiseAND(F.lit((1 << power) - 1))))
    words = seed.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x"))
    out = np.zeros(1 << (power - 6), np.int64)
    for part in words.toLocalIterator():
        out[part["w"]] = part["x"]
    return out.view(np.uint8), power


def _hits(docs: DataFrame, text_col: str, out: str, items: DataFrame) -> DataFrame:
    """``docs`` with (seeds, words): the text's seeds that pass the filter, and the words around them, stretches parted by zero."""
    flat, power = _filter(items)
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most min_match of them
    shared = docs.sparkSession.sparkContext.broadcast(flat)

    def maybe(bit: np.ndarray) -> np.ndarray:
        return np.flatnonzero(shared.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)

    @F.pandas_udf("seeds array<long>, words binary")
    def hits(texts: pd.Series) -> pd.DataFrame:
        found, around = [], []
        for text in texts:
            tokens = word_hashes(text)
            cover, own = np.zeros(len(tokens) + 1, np.int64), []
            for size in sizes:
                h = seeds(tokens, size)
                at = maybe(h >> np.uint64(64 - power))
                at = at[maybe(h[at] & np.uint64((1 << power) - 1))]
                own.append(h[at])
                cover[at] += 1
                cover[at + size] -= 1
            inside = np.flatnonzero(np.cumsum(cover[:-1]))
            around.append(np.insert(tokens[inside], np.flatnonzero(np.diff(inside) > 1) + 1, 0).tobytes())
            found.append(np.unique(np.concatenate(own)).view(np.int64) if own else [])
        return pd.DataFrame({"seeds": found, "words": around})

    return docs.withColumn(out, hits(F.col(text_col)))


def _covered_pairs(rows: DataFrame, items: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """(row, item_id, coverage, tiles) of all rows (row, seeds, words) and items that are covered to the threshold."""
    found = rows.select("row", F.explode("seeds").alias("seed"))
    often = found.groupBy("seed").agg(F.count("*").alias("rows"))
    each = items.select("item", "words", F.explode("seeds").alias("seed")).groupBy("item", "words", "seed").agg(F.count("*").alias("places"))
    least = F.greatest(F.lit(1), F.ceil(F.col("words") * (threshold / min_match) - 1e-9))
    order = Window.partitionBy("item").orderBy(F.desc("rows"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    rare = each.join(often, "seed").withColumn("sofar", F.sum("places").over(order)).where(F.col("sofar") >= least).select("seed", "item", salts)
    pairs = found.select("row", "seed", salt).join(rare, ["seed", "salt"]).select("row", "item").distinct()

    @F.pandas_udf("coverage double, tiles int")
    def tiled(words: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        both = [covered(np.frombuffer(p, np.uint64), np.frombuffer(t, np.uint64), min_match, threshold) or (None, None) for t, p in zip(words, tokens)]
        return pd.DataFrame(both, columns=["coverage", "tiles"]).astype({"coverage": float, "tiles": "Int32"})

    met = (pairs.join(rows.select("row", F.col("words").alias("around")), "row").select("row", "item", "around", salt)
           .join(items.select("item", "item_id", "tokens", salts), ["item", "salt"]))
    return met.select("row", "item_id", tiled("around", "tokens").alias("t")).where("t.tiles is not null").select("row", "item_id", "t.*")


def _found(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, item_id: str, item_text: str, min_match: int, threshold: float) -> tuple[DataFrame, DataFrame, str]:
    """``docs``' columns ``keep`` with a row number, written once; the pairs found by row number; the row number's name."""
    row, hits = fresh(docs, "row", "hits")
    items = materialize(_items(benchmark, item_id, item_text, min_match), "benchmark-items")
    whole = _hits(docs.withColumn(row, F.monotonically_increasing_id()), text_col, hits, items)
    whole = materialize(whole.select(*keep, row, hits), "benchmark-hits")
    rows = whole.where(F.size(F.col(hits)["seeds"]) > 0).select(F.col(row).alias("row"), f"{hits}.*")
    pairs = materialize(_covered_pairs(rows, items, min_match, threshold), "benchmark-pairs")
    return whole.drop(hits), pairs.withColumnRenamed("row", row), row


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                       min_match: int = 5, threshold: float = 0.5, out_col: str = "contamination") -> DataFrame:
    """``docs`` with an array of (item_id, coverage, tiles) of the items found in each text.

    Null and empty texts hold nothing. Items of fewer than ``min_match`` words
    are found where all their words stand in a row; items with a null id or
    text, or without words, are not looked for. Ids are of any type that can be
    grouped by. Repeated items are reported once; items that share an id but not
    their text are separate. An empty benchmark leaves empty arrays. Rows and
    all other columns stay, repeated rows and ids too.
    """
    base = [c for c in docs.columns if c.lower() != out_col.lower()]
    whole, pairs, row = _found(docs, benchmark, base, text_col, item_id, item_text, min_match, threshold)
    found = pairs.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("item_id", "coverage", "tiles"))).alias(out_col))
    kind = found.schema[out_col].dataType
    return whole.join(found, row, "left").select(*base, F.coalesce(F.col(out_col), F.array().cast(kind)).alias(out_col))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                       min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """(id, item_id, coverage, tiles) for every row and item found in it; see ``mark_contamination``."""
    whole, pairs, row = _found(docs, benchmark, [id_col], text_col, item_id, item_text, min_match, threshold)
    return pairs.join(whole, row).select(id_col, "item_id", "coverage", "tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                      min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """Rows in which no benchmark item was found, with the columns of ``docs``; only row numbers are joined with them."""
    whole, pairs, row = _found(docs, benchmark, docs.columns, text_col, item_id, item_text, min_match, threshold)
    return whole.join(pairs.select(row).distinct(), row, "left_anti").select(*docs.columns)
