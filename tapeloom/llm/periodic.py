"""Periodic runs of words, found by uniting suffix classes in order of falling LCP.

The suffixes of a text's words are ranked by prefix doubling, each round only
among those that still tie. Neighbours in suffix order and their common prefix
(LCP) are the edges of a tree that Kruskal's rule walks from the longest prefix
down: two classes of suffixes become one, and their positions, kept in order,
are merged. Where two positions become neighbours at a distance within the
prefix, the words between them repeat: that seeds a run, exactly at the level
of its own prefix, and with its smallest period (a smaller one would have put
a position of the same class between the two before).

A run of at least four periods and six words has a prefix of at least five
words in common with itself one period on, so suffixes that share fewer
with every other are left out before the walk.

Texts are independent: nothing is shuffled, and a Python worker ranks some
texts at a time, or one that is longer. Time is n log n in a text's words (n log² n
where classes are large and merge evenly; an ordered set is a list, so that single positions
that join a class of m cost moves of m words of memory). Memory is about 60
bytes a word and 4 more per doubling of its longest repeated stretch.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh

#: A run's least length in words and in periods (fixed values of the contract).
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The least prefix that a run's start shares with the position one period on: 5, as the period is 1 or the length 4 periods or more.
LEAST_PREFIX = LEAST_WORDS - 1
#: Words that are ranked together.
BATCH_WORDS = 1 << 17
_RUNS = "array<struct<start:long,length:long,period:long>>"

Run = tuple[int, int, int]


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _sizes(heads: np.ndarray, n: int) -> np.ndarray:
    """Of every element, the size of its group, from the groups' first elements."""
    sizes = np.diff(heads, append=n)
    return np.repeat(sizes, sizes)


def suffix_ranks(words: np.ndarray, text: np.ndarray, stop: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of suffixes by their first 1, 2, 4, ... words, and the positions that share their first four with another.

    ``text`` numbers each word's text and ``stop`` is where that ends. Equal ranks mean equal words, all within one text.
    """
    n = len(words)
    key = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key)
    heads = np.flatnonzero(_changes(key[order]))
    sizes = _sizes(heads, n)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(heads, np.diff(heads, append=n))
    levels, step, tied, four = [rank], 1, order[sizes > 1], order[:0]
    while len(tied):
        if step == 4:
            four = tied
        on = tied + step
        base = rank[tied].astype(np.int64)
        key = base * (n + 1) + np.where(on < stop[tied], rank[np.minimum(on, n - 1)].astype(np.int64) + 1, 0)
        by = np.argsort(key)
        tied, key, base = tied[by], key[by], base[by]
        at = np.arange(len(tied))
        new = _changes(key)
        head = np.maximum.accumulate(np.where(new, at, 0))
        group = np.maximum.accumulate(np.where(_changes(base), at, 0))
        rank = rank.copy()
        rank[tied] = base + head - group
        levels.append(rank)
        tied = tied[_sizes(np.flatnonzero(new), len(tied)) > 1]
        step *= 2
    return levels, four


def falling_edges(levels: list[np.ndarray], positions: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Neighbours in suffix order that share ``LEAST_PREFIX`` words or more, and how many, by falling number."""
    inorder = positions[np.argsort(levels[-1][positions])].astype(np.int64)
    a, b = inorder[:-1], inorder[1:]
    near = levels[2][a] == levels[2][b]
    a, b = a[near], b[near]
    lcp, last = np.zeros(len(a), np.int64), len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        same = (np.maximum(x, y) <= last) & (levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)])
        lcp += same.astype(np.int64) << k
    some = lcp >= LEAST_PREFIX
    a, b, lcp = a[some], b[some], lcp[some]
    fall = np.argsort(-lcp, kind="stable")
    return a[fall].tolist(), b[fall].tolist(), lcp[fall].tolist()


def seed_runs(edges: tuple[list[int], list[int], list[int]], words: list[int], text: list[int]) -> list[Run]:
    """(start, length, period) of all runs, by Kruskal's walk over ``edges``; positions and words are those of the batch."""
    classes: dict[int, list[int]] = {}
    runs: list[Run] = []

    def seed(x: int, y: int, lcp: int) -> None:
        period = y - x
        # long enough, and not the inside of a run that begins further left
        if period * (LEAST_PERIODS - 1) <= lcp and lcp + period >= LEAST_WORDS and not (x and text[x - 1] == text[x] and words[x - 1] == words[y - 1]):
            runs.append((x, lcp + period, period))

    for a, b, lcp in zip(*edges):
        big, small = classes.get(a) or [a], classes.get(b) or [b]
        if len(big) < len(small):
            big, small = small, big
        classes[big[0]] = big
        last = len(small) - 1
        for k, x in enumerate(small):
            classes[x] = big
            at = bisect_left(big, x)
            # a neighbour counts if no other position that joins now lies between
            if at and not (k and small[k - 1] > big[at - 1]):
                seed(big[at - 1], x, lcp)
            if at < len(big) and not (k < last and small[k + 1] < big[at]):
                seed(x, big[at], lcp)
        if last:
            big += small
            big.sort()  # two ordered stretches, merged in one pass
        else:
            insort(big, small[0])
    return runs


def runs_of(words: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each text, by start, then period; a text is an array of word numbers."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    out: list[list[Run]] = [[] for _ in words]
    if not len(words) or not ends[-1]:
        return out
    flat, text = np.concatenate(words).astype(np.int64), np.repeat(np.arange(len(words)), sizes)
    levels, four = suffix_ranks(flat, text, ends[text])
    if len(four):
        starts = (ends - sizes).tolist()
        owner = text.tolist()
        for at, length, period in seed_runs(falling_edges(levels, four), flat.tolist(), owner):
            out[owner[at]].append((at - starts[owner[at]], length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period, compared in whole numbers; ties go to the smallest start, then period. ``runs`` are in that order."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that lie in no run beyond its first period, a space between."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``runs`` (array of start, length, period, in words from 0, by start, then period), ``strongest`` (one of them or null), ``collapsed``.

    Words are what ASCII white space leaves. A run is a longest stretch with a smallest period that it
    holds at least four times, in at least six words. ``collapsed`` is the text with each run cut to its
    first period and one space between words. Null and empty texts have no words and no runs, and an empty
    ``collapsed``. Texts are whole, however long. Repeated rows give repeated results; other columns are
    not read, so their names cannot clash. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            pending: list[list[bytes]] = []
            numbers: list[np.ndarray] = []
            begun, held = 0, 0
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__

            def done(upto: int) -> pa.RecordBatch:
                nonlocal begun, held
                found = runs_of(numbers)
                shown = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in found]
                top = [dict(zip(("start", "length", "period"), r)) if (r := strongest(own)) else None for own in found]
                kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                out = pa.RecordBatch.from_arrays([ids.slice(begun, upto - begun), pa.array(shown, pa.list_(kind)), pa.array(top, kind),
                                                  pa.array([collapse(w, r) for w, r in zip(pending, found)], pa.binary())], ["id", "runs", "strongest", "collapsed"])
                pending.clear()
                numbers.clear()
                number.clear()
                begun, held = upto, 0
                return out

            for k, text in enumerate(texts):
                words = (text.as_py() or b"").split()
                pending.append(words)
                numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                held += len(words)
                if held >= BATCH_WORDS:
                    yield done(k + 1)
            if pending:
                yield done(len(ids))

    text = F.col(text_col) if isinstance(text_col, str) else text_col
    slim = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"))
    found = slim.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, runs {_RUNS}, strongest struct<start:long,length:long,period:long>, collapsed binary")
    runs, top, collapsed = fresh(docs.select(id_col), "runs", "strongest", "collapsed")
    return found.select(F.col("id").alias(id_col), F.col("runs").alias(runs), F.col("strongest").alias(top), F.col("collapsed").cast("string").alias(collapsed))


def plant_period(text: Column, seed: Column) -> Column:
    """``text`` with a stretch to its end made periodic, where ``seed`` (a whole number) is divisible by 10; else as it is. Null stays null.

    With g the seed's tenth and n words, the words from number a = g mod n on repeat the first 1 + floor((n - a) / (3 + g mod 8)) of them.
    """
    def changed(b: Column) -> Column:
        n = F.size(b["words"]).cast("long")
        a = b["g"] % n
        period = 1 + F.floor((n - a) / (3 + b["g"] % 8))
        source = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % period))
        return F.array_join(F.transform(source, lambda i: F.get(b["words"], i.cast("int"))), " ")

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    both = F.transform(F.array(F.struct(words.alias("words"), F.floor(seed / 10).cast("long").alias("g"))), lambda b: F.when(F.size(b["words"]) > 0, changed(b)).otherwise(F.lit("")))[0]
    return F.when((seed % 10 == 0) & text.isNotNull(), both).otherwise(text)
