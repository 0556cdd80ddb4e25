"""Near copies: wide SimHash fingerprints in a binary trie, decided by exact Jaccard similarity.

A text is its set of five-word shingles. Two texts link when the Jaccard
similarity of their sets is at least 0.8, and one document of each component
of links stays. At that similarity fingerprints differ in 15 % of their bits:
too many for 64 bits to tell from chance, so these have 256, and 56 of them
may differ (99.9 % of the pairs at 0.8 stay below that).

The fingerprints form binary tries, one for each of 32 rotations of the bits, and
each trie is joined with itself: pairs of nodes are walked together from the root
down, the bits in which their paths differ are added up, and a pair is left as soon
as it exceeds the error budget of its depth (``error_budget``), or when all its texts
are known to be one group. Spark walks the upper levels: every fingerprint is
dealt to the node pairs that its node takes part in, and pairs that hold too many go
on deeper. Tasks walk the lower ones, down to pairs of single fingerprints, whose
256 bits are then held against the whole budget. Texts are first tried with their
nearest partners, in rounds that each begin from the links found; then every pair
within the budget that is still apart, by 2048 bits of fingerprint as well, is
decided on the whole sets.

The budget of a depth is what makes the walk short, and no pigeonhole holds at 56 of
256 bits: a pair is missed if it breaks that budget in all rotations.
``chance_of_meeting`` gives the chance that it does not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import WordHashes, fresh, join_hot, materialize
from tapeloom.llm.simhash import contract_words, star_components

BITS, MAX_BITS, ROTATIONS, NODE_LIMIT = 256, 56, 32, 8192
#: Leading bits of a rotation in which partners agree; one more may differ down to the first depth, and SPARE besides their share of the budget below it.
LEAD, SPARE = 7, 2
#: Spark takes a node pair apart if it holds more than so many times the node limit; a task stops walking at so many pairs of fingerprints.
LARGE, LEAF_PAIRS = 2, 1024
#: Texts that have partners get longer fingerprints, with the same chance of passing, before their last pairs are decided.
LONG_BITS, MAX_LONG_BITS = 2048, 360
#: Pairs compared at once in a task.
PAIRS_AT_ONCE = 1 << 17
_HASHES = WordHashes("near copies", seed=5)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(LONG_BITS // 64, dtype=np.uint64) * _ODD
#: The bits of a byte as eight counters of a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_PRINT = ["f0", "f1", "f2", "f3"]


def error_budget(texts: int, node_limit: int = NODE_LIMIT) -> np.ndarray:
    """The bits in which a node pair's paths may differ at each depth from 0 to 64; all, if one node can hold the texts."""
    first, depth = _first_depth(texts, node_limit), np.arange(65)
    upper = ((depth > LEAD) & (first > LEAD)).astype(np.int64)
    return np.where(depth > first, upper + SPARE + (depth - first) * MAX_BITS // BITS, upper) if first else depth


def chance_of_meeting(similarity: float, texts: int, rotations: int = ROTATIONS, node_limit: int = NODE_LIMIT) -> float:
    """Chance that two sets of one size at a Jaccard similarity stay within the budget of every depth, in any rotation; these taken as independent."""
    differ = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    at = np.zeros(66)  # by the bits that differ so far
    at[0] = 1
    for most in error_budget(texts, node_limit)[1:]:
        at[1:], at[0] = at[1:] * (1 - differ) + at[:-1] * differ, at[0] * (1 - differ)
        at[most + 1:] = 0
    return 1 - (1 - float(at.sum())) ** rotations


def _first_depth(texts: int, node_limit: int) -> int:
    return min(64, max(0, math.ceil(math.log2(max(1, texts) / node_limit))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a whole text in order; one of all words if they are fewer, none without words."""
    words = contract_words(text)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    size = min(shingle, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _ODD + w[k:len(w) - size + 1 + k]
    return np.unique(_mixed(h))


def wide_print(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """``bits`` as words of 64: a bit is set if it is in over half of the hashes' extensions."""
    counts = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 255 * 32):
        h = hashes[at:at + 255 * 32]
        wide = np.stack([_mixed(h + step) for step in _STEPS[:bits // 64]], 1)
        lanes = np.add.reduceat(_LANES[wide.view(np.uint8)], np.arange(0, len(h), 255), axis=0)
        counts += lanes.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7)


def _sketches(docs: DataFrame, shingle: int, text: str, out: str) -> DataFrame:
    """``docs`` with a struct of (node, n, f0 .. f3) of each text; equal sets are one node."""
    @F.pandas_udf("node long, n long, f0 long, f1 long, f2 long, f3 long")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle) for t in texts]
        prints = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, 4).view(np.int64)
        nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"node": nodes, "n": [len(s) for s in sets], **{f: prints[:, k] for k, f in enumerate(_PRINT)}})

    return docs.withColumn(out, sketch(F.col(text)))


def _rotated(nodes: DataFrame, rotations: int) -> DataFrame:
    """A row for each rotation: ``rot`` and ``v``, the 64 bits that it puts first."""
    turned = []
    for r in range(rotations):
        word, off = divmod(r * BITS // rotations, 64)
        v, nxt = F.col(_PRINT[word]), F.col(_PRINT[(word + 1) % 4])
        turned.append(F.struct(F.lit(r).alias("rot"), (v if off == 0 else F.shiftleft(v, off).bitwiseOR(F.shiftrightunsigned(nxt, 64 - off))).alias("v")))
    return nodes.select("*", F.explode(F.array(*turned)).alias("x")).select(*nodes.columns, "x.*")


def _head(v: Column, bits: int) -> Column:
    return F.shiftrightunsigned(v, 64 - bits) if 0 < bits < 64 else v if bits else F.lit(0).cast("long")


def _dealt(rows: DataFrame, own: Column, other: Column, depth: int) -> DataFrame:
    """``rows`` in the node pair (pa, pb) of ``own`` and ``other``; ``side`` is 1 for the rows of pb."""
    return rows.withColumns({"pa": F.least(own, other), "pb": F.greatest(own, other), "side": (own > other).cast("int"), "depth": F.lit(depth)})


def _node_pairs(nodes: DataFrame, texts: int, rotations: int, node_limit: int, every: bool, step: int = 3) -> DataFrame:
    """Rows (rot, depth, pa, pb, side, v) with the columns of ``nodes``: each in every node pair within the budget that its node takes part in.

    A pair that holds more than ``LARGE`` times ``node_limit`` rows gives way to
    the pairs of its children, until none does or all 64 bits are used; it is
    left if its rows have one root. Unless ``every`` pair is wanted, only
    children whose new bits agree follow a large pair.
    """
    budget, depth, key = error_budget(texts, node_limit), _first_depth(texts, node_limit), ["rot", "pa", "pb"]
    rows = _rotated(nodes, rotations if depth else 1)
    own = _head(F.col("v"), depth)
    if depth > LEAD:
        rows = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in (0, *(1 << k for k in range(depth - LEAD)))])))
        rows = _dealt(rows, own, own.bitwiseXOR(F.col("mask")), depth).drop("mask")
    else:
        rows = _dealt(rows, own, own, depth)
    found = []
    while True:
        sizes = rows.groupBy(*key).agg(F.count("*").alias("size"), (F.min("side") < F.max("side")).alias("both"), (F.min("root") < F.max("root")).alias("apart"))
        large = materialize(sizes.where(F.col("size") > LARGE * node_limit)
                            .select(*key, (F.col("apart") & (F.col("both") | (F.col("pa") == F.col("pb")))).alias("live")), "copies-large")
        if depth == 64 or large.isEmpty():
            found.append(rows)
            break
        found.append(rows.join(large, key, "left_anti"))
        deeper = min(64, depth + step)
        grow = deeper - depth
        # the bits that may differ before, for each way in which the new ones differ
        spare = [min(int(budget[depth + k]) - (t >> (grow - k)).bit_count() for k in range(1, grow + 1)) for t in range(1 << grow)]
        ways = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(x).alias("spare")) for t, x in enumerate(spare) if every or t == 0])
        split = rows.join(large.where("live"), key, "left_semi").withColumn("way", F.explode(ways)).withColumn("mask", F.col("pa").bitwiseXOR(F.col("pb")))
        split = split.where(F.bit_count("mask") <= F.col("way.spare"))
        own = _head(F.col("v"), deeper)
        split = materialize(_dealt(split, own, own.bitwiseXOR(F.shiftleft("mask", grow)).bitwiseXOR(F.col("way.t")), deeper).drop("way", "mask"), "copies-split")
        met = split.groupBy(*key).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("pa = pb or lo < hi").select(*key)
        rows, depth = split.join(met, key, "left_semi"), deeper
    columns = ["rot", "depth", "pa", "pb", "side", "v", *nodes.columns]
    out = found[0].select(*columns)
    for f in found[1:]:
        out = out.unionByName(f.select(*columns))
    return out


def _within(x: np.ndarray, budget: np.ndarray, above: int, depth: int) -> np.ndarray:
    """Which differences of paths, ``x`` of ``depth`` bits, keep the budget of every depth below ``above``."""
    ok = np.ones(len(x), bool)
    for d in range(above + 1, depth + 1):
        if budget[d] < d:
            ok &= np.bitwise_count(x >> np.uint64(depth - d)) <= budget[d]
    return ok


def _rows_of(pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows (i, j) that node pairs (a from, a to, b from, b to) hold, about ``PAIRS_AT_ONCE`` at a time; within one node each once."""
    a0, a1, b0, b1 = pairs.T
    i = np.repeat(a0 - np.cumsum(a1 - a0) + (a1 - a0), a1 - a0) + np.arange((a1 - a0).sum())
    lo, hi = np.repeat(b0, a1 - a0), np.repeat(b1, a1 - a0)
    lo = np.where(np.repeat(a0 == b0, a1 - a0), i + 1, lo)
    width = hi - lo
    ends = np.cumsum(width)
    at = 0
    while at < len(i):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        w = width[at:upto]
        yield np.repeat(i[at:upto], w), np.repeat(lo[at:upto] - np.cumsum(w) + w, w) + np.arange(w.sum())
        at = upto


def _walked(v: np.ndarray, cut: int, depth: int, own: np.ndarray, budget: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) below a node pair that the walk does not leave.

    ``v``: rotated fingerprints in order, those of the first node up to ``cut``,
    then those of the second, if it is another. ``own``: their roots.
    """
    m = len(v)
    todo = [(np.array([[0, cut, 0, m] if cut == m else [0, cut, cut, m]]), depth)]
    levels: dict[int, tuple[np.ndarray, ...]] = {}
    while todo:
        pairs, depth = todo.pop()
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF_PAIRS) | (depth == 64)
        if small.any():
            yield from _rows_of(pairs[small])
            pairs = pairs[~small]
        if not len(pairs):
            continue
        deeper = min(64, depth + 4)
        if deeper not in levels:
            head = v >> np.uint64(64 - deeper)
            starts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (np.arange(1, m) == cut)])
            levels[deeper] = starts, np.r_[starts[1:], m], head[starts], np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
        starts, ends, head, least, most = levels[deeper]
        ca0, ca1, cb0, cb1 = np.searchsorted(starts, pairs.T)
        ways = (ca1 - ca0) * (cb1 - cb0)
        if len(pairs) > 1 and ways.sum() > PAIRS_AT_ONCE // 8:
            half = len(pairs) // 2
            todo += [(pairs[:half], depth), (pairs[half:], depth)]
            continue
        k = np.repeat(np.arange(len(pairs)), ways)
        a, b = np.divmod(np.arange(len(k)) - np.repeat(np.cumsum(ways) - ways, ways), (cb1 - cb0)[k])
        a, b = a + ca0[k], b + cb0[k]
        live = (pairs[k, 0] != pairs[k, 2]) | (a < b) | ((a == b) & (ends[a] - starts[a] > 1))
        live &= (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])  # else one group already
        a, b = a[live], b[live]
        live = _within(head[a] ^ head[b], budget, depth, deeper)
        a, b = a[live], b[live]
        todo.append((np.stack([starts[a], ends[a], starts[b], ends[b]], 1), deeper))


def _in_budget(part: pd.DataFrame, own: np.ndarray, similarity: float, budget: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, bits) of a node pair's rows in order that may be similar enough and have differing roots ``own``: bits added up word by word, sizes compared."""
    v, n, f = part["v"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(), part[_PRINT].to_numpy(np.int64).view(np.uint64)
    cut = len(part) - int(part["side"].sum())
    if not cut or part["pa"].iloc[0] != part["pb"].iloc[0] and cut == len(part):
        return
    for i, j in _walked(v, cut, int(part["depth"].iloc[0]), own, budget):
        left = np.bitwise_count(v[i] ^ v[j]) <= min(MAX_BITS, budget[64])
        i, j = i[left], j[left]
        left = own[i] != own[j]
        i, j = i[left], j[left]
        bits = np.zeros(len(i), np.int64)
        for word in f.T:
            bits += np.bitwise_count(word[i] ^ word[j])
            left = bits <= MAX_BITS
            i, j, bits = i[left], j[left], bits[left]
        left = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
        yield i[left], j[left], bits[left]


def _in_order(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A node pair's rows by side, path and node; their roots as numbers."""
    part = part.iloc[np.lexsort((part["node"].to_numpy(), part["v"].to_numpy(np.int64).view(np.uint64), part["side"].to_numpy()))]
    return part, np.unique(part["root"].to_numpy(), return_inverse=True)[1]


def _nearest_apart(part: pd.DataFrame, similarity: float, budget: np.ndarray) -> pd.DataFrame:
    """(a, b, bits): the nearest partner with another root that every row has in a node pair."""
    part, own = _in_order(part)
    node = part["node"].to_numpy()
    m = len(node)
    best = np.full(m, (BITS + 1) * m, np.int64)  # bits and index of the nearest in one number
    if m > LARGE * NODE_LIMIT and part["depth"].iloc[0] == 64 and len(np.unique(own)) == m:
        # 64 shared bits and no links yet: most are partners of the first, so all are compared with one at a time
        f, left = part[_PRINT].to_numpy(np.int64).view(np.uint64), np.arange(m)
        while len(left) > 1:
            one, rest = left[0], left[1:]
            bits = np.bitwise_count(f[rest] ^ f[one]).sum(1, dtype=np.int64)
            near = bits <= MAX_BITS
            if near.any():
                best[rest[near]], best[one] = bits[near] * m + one, bits[near][0] * m + rest[near][0]
            left = rest[~near]
    else:
        for i, j, bits in _in_budget(part, own, similarity, budget):
            np.minimum.at(best, i, bits * m + j)
            np.minimum.at(best, j, bits * m + i)
    has = np.flatnonzero(best < (MAX_BITS + 1) * m)
    return pd.DataFrame({"a": node[has], "b": node[best[has] % m], "bits": best[has] // m})


def _met_before(f: np.ndarray, i: np.ndarray, j: np.ndarray, rotation: int, rotations: int, budget: np.ndarray) -> np.ndarray:
    """Which pairs keep the budget of every depth, so meet for certain, in an earlier rotation."""
    met = np.zeros(len(i), bool)
    for r in range(rotation):
        word, off = divmod(r * BITS // rotations, 64)
        v = f[:, word] if off == 0 else (f[:, word] << np.uint64(off)) | (f[:, (word + 1) % 4] >> np.uint64(64 - off))
        met |= _within(v[i] ^ v[j], budget, 0, 64)
    return met


def _apart(part: pd.DataFrame, similarity: float, rotations: int, budget: np.ndarray) -> pd.DataFrame:
    """(a, b), a > b: all partners whose roots differ and that meet here first."""
    part, own = _in_order(part)
    node, f = part["node"].to_numpy(), part[_PRINT].to_numpy(np.int64).view(np.uint64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    long = np.frombuffer(b"".join(part["long"]), np.uint64).reshape(len(node), -1)
    for i, j, _ in _in_budget(part, own, similarity, budget):
        bits = np.zeros(len(i), np.int64)
        for word in long.T:
            bits += np.bitwise_count(word[i] ^ word[j])
        i, j = i[bits <= MAX_LONG_BITS], j[bits <= MAX_LONG_BITS]
        here = ~_met_before(f, i, j, int(part["rot"].iloc[0]), rotations, budget)
        i, j = i[here], j[here]
        a.append(np.maximum(node[i], node[j]))
        b.append(np.minimum(node[i], node[j]))
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def _in_each_pair(rows: DataFrame, work: Callable[[pd.DataFrame, float], pd.DataFrame], similarity: float, schema: str) -> DataFrame:
    """What ``work`` gives for the rows of every node pair."""
    key = ["rot", "depth", "pa", "pb"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> list[pd.DataFrame]:
            rows = pd.concat(held) if len(held) > 1 else held[0] if held else []
            held.clear()
            return [work(rows, similarity)] if len(rows) > 1 else []

        for batch in batches:
            out: list[pd.DataFrame] = []
            where = batch[key].to_numpy(np.int64)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            if held and (held[-1][key].to_numpy(np.int64)[-1] != where[0]).any():
                out += done()
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(batch)]):
                if lo:
                    out += done()
                held.append(batch.iloc[lo:hi])
            if out:
                yield pd.concat(out)
        yield from done()

    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(walk, schema)


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both) >= similarity)
        return pd.Series(out, dtype=bool)

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return met.where(similar("x", "y")).select("a", "b")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, set, long): the shingle hashes of each text (node, t) and their long fingerprint, as bytes."""
    @F.pandas_udf("set binary, long binary")
    def whole(text: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle) for t in text]
        return pd.DataFrame({"set": [s.tobytes() for s in sets], "long": [wide_print(s, LONG_BITS).tobytes() for s in sets]})

    return rows.select("node", whole("t").alias("w")).select("node", "w.*")


def _rooted(rows: DataFrame, shingle: int, similarity: float, rotations: int, node_limit: int) -> DataFrame:
    """(node, root, least, size) of each distinct set among rows (row, id, t, s): ``least`` is its least (id, row), ``size`` its rows."""
    nodes = materialize(rows.select("row", "id", "s.*").groupBy("node", "n", *_PRINT)
                        .agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("size")), "copies-nodes")
    known = nodes.where("n > 0").select("node", "n", *_PRINT)
    texts = known.count()
    budget = error_budget(texts, node_limit)

    def nearest(of: DataFrame) -> DataFrame:
        found = _in_each_pair(_node_pairs(of, texts, rotations, node_limit, every=False), partial(_nearest_apart, budget=budget), similarity, "a long, b long, bits long")
        return _ordered(found.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b")))

    # equal fingerprints meet the trie as one; the others are tried with it
    twins = known.groupBy(*_PRINT).agg(F.min(F.struct("node", "n")).alias("one"), F.count("*").alias("size"))
    ones = twins.select("one.*", *_PRINT, F.col("one.node").alias("root"))
    equal = known.join(twins.where("size > 1"), _PRINT).select(F.col("node").alias("a"), F.col("one.node").alias("b")).where("a <> b")
    tried = materialize(nearest(ones).unionByName(_ordered(equal)).distinct(), "copies-tried")
    some = materialize(tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).distinct(), "copies-some")
    firsts = nodes.join(some, "node", "left_semi").select(F.col("least.row").alias("row"))
    sets = materialize(_sets(rows.join(firsts, "row", "left_semi").select("s.node", "t"), shingle), "copies-sets")
    links = materialize(_links(tried, sets, similarity), "copies-links")
    while True:
        # rounds of nearest partners join what is dense with few comparisons; then every pair that is still apart is decided
        placed = known.join(some, "node", "left_semi").join(star_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = materialize(placed, "copies-placed")
        more = materialize(nearest(placed).join(tried, ["a", "b"], "left_anti"), "copies-more")
        found = materialize(_links(more, sets, similarity), "copies-found")
        tried, links = tried.unionByName(more), links.unionByName(found)
        if found.count() * 8 < more.count() or more.isEmpty():
            break
    placed = placed.drop("root").join(sets.select("node", "long"), "node").join(star_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    meeting = _node_pairs(placed, texts, rotations, node_limit, every=True)
    rest = _in_each_pair(meeting, partial(_apart, rotations=rotations, budget=budget), similarity, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    roots = star_components(links.unionByName(_links(rest, sets, similarity)))
    return materialize(nodes.select("node", "least", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "copies-roots")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as a > b, each once."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
                rotations: int = ROTATIONS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(id, component_id) for every row with an id: the least id reachable over links.

    Null text counts as empty; texts without words are one set, shorter texts
    than a shingle one shingle. Repeated rows stay rows. An empty table gives
    an empty result. Other columns are not carried.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = materialize(_sketches(rows, shingle, "t", "s"), "copies-rows")
    found = _rooted(rows, shingle, similarity, rotations, node_limit)
    named = found.join(found.groupBy("root").agg(F.min("least.id").alias("component_id")), "root").select("node", "size", "component_id")
    return join_hot(rows.select("id", F.col("s.node").alias("node")), named, "node", "size").select(F.col("id").alias(id_col), "component_id")


def one_per_copy_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
                       rotations: int = ROTATIONS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """One document of each group of near copies, with the columns of ``docs``.

    The row whose id is the component's least stays; one of them, if rows share
    that id and the text's set of shingles. Rows that share an id but not a
    component are separate. Rows with a null id stay and are no one's copy.
    Only the row numbers to drop are joined with the texts.
    """
    row, made, ident = fresh(docs, "row", "sketch", "ident")
    whole = materialize(_sketches(docs.withColumn(row, F.monotonically_increasing_id()), shingle, text_col, made), "copies-rows")
    rows = whole.where(F.col(id_col).isNotNull()).select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(made).alias("s"))
    found = _rooted(rows, shingle, similarity, rotations, node_limit)
    group = found.groupBy("root").agg(F.min("least").alias("first"), F.sum("size").alias("rows")).where("rows > 1")
    more = found.join(group, "root").select("node", "size", F.col("first.row").alias("stays"))
    drop = materialize(join_hot(rows.select("row", F.col("s.node").alias("node")), more, "node", "size")
                       .where("row <> stays").select(F.col("row").alias(row)), "copies-drop")
    return whole.join(drop, row, "left_anti").select(*docs.columns)
