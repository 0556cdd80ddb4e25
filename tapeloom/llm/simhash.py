"""SimHash near-duplicates: a binary-trie self-join and its components.

Fingerprints are 64 bits over word shingles. Two fingerprints link when they
differ in at most ``max_bits`` bits. The distinct fingerprints form binary
tries; pairs of nodes are traversed together from the root down, adding up the
bits in which their paths differ, and a pair is left as soon as it exceeds the
budget, or when all its leaves are known to be connected already.

To spread the tries over tasks, the bits are rotated so that each of
``max_bits + 1`` blocks comes first once: a linked pair agrees in at least one
block entirely, so it meets in the subtrie below that block. A subtrie that
holds too many fingerprints is taken apart further by node pairs, four bits
deeper at a time. Every task returns the edges of a spanning forest of the
links it found, never all pairs, and the components of those edges are found
by alternating large-star and small-star steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, fresh, join_hot, materialize

#: White space of the fingerprint contract: space and \x09 to \x0D only.
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_OTHER_SPACE = re.compile(r"[^\S\x20\x09-\x0D]|[\x1c-\x1f]")


def contract_words(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased; null is empty."""
    text = text or ""
    text = text.lower() if text.isascii() else text.translate(_LOWER)
    return _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The 64-bit hash of every word shingle of a whole text, in order; of all words if they are fewer."""
    words = contract_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    data = " ".join(words).encode("utf-8", "surrogatepass")
    if len(words) <= shingle:
        ends = [len(data)]
        starts = [0]
    else:
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts = [0, *(gaps[:len(gaps) - shingle + 1] + 1).tolist()]
        ends = [*gaps[shingle - 1:].tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], seed) for a, b in zip(starts, ends)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 without words."""
    h = shingle_hashes(text, shingle, seed)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp", shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a signed long of the same bits; null text counts as empty."""

    @F.pandas_udf("long")
    def fingerprints(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in text], np.uint64).view(np.int64))

    return docs.withColumn(out_col, fingerprints(F.col(text_col)))


def _uniform(labels: np.ndarray) -> np.ndarray:
    """Prefix counts of label changes, to ask in one step whether a range holds one label."""
    return np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])


def _union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the components of every i and j; a label is the least index of its component."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return labels
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (nxt := labels[labels]).tobytes() != labels.tobytes():
            labels = nxt


def trie_forest(v: np.ndarray, pairs: np.ndarray, depth: int, diff: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels after joining node pairs below bit ``depth``.

    ``v``: rotated fingerprints, sorted within each node. ``pairs``: rows of
    (a_from, a_to, b_from, b_to); a node joined with itself has a = b.
    ``diff``: bits by which the paths of each pair differ so far.
    """
    labels = np.arange(len(v))
    self_ = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
    for a, b in pairs[self_][:, :2]:  # neighbours in order are often linked; that lets dense subtries be left early
        near = np.flatnonzero(np.bitwise_count(v[a:b - 1] ^ v[a + 1:b]) <= max_bits) + a
        if len(near):
            labels = _union(labels, near, near + 1)
    while len(pairs):
        a0, a1, b0, b1 = pairs.T
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            ok = np.bitwise_count(v[i] ^ v[j]) <= max_bits
            if ok.any():
                labels = _union(labels, i[ok], j[ok])
            pairs, diff = pairs[~single], diff[~single]
            a0, a1, b0, b1 = pairs.T
        if depth == 64 or not len(pairs):
            break
        change = _uniform(labels)
        done = (labels[a0] == labels[b0]) & (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0])
        pairs, diff = pairs[~done], diff[~done]
        a0, a1, b0, b1 = pairs.T
        ones = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        nxt = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        nxt.append(tuple(x[~same] for x in (am, a1, b0, bm, diff + 1)))
        merged = [np.concatenate(x) for x in zip(*nxt)]
        keep = (merged[1] > merged[0]) & (merged[3] > merged[2]) & (merged[4] <= max_bits)
        alone = (merged[0] == merged[2]) & (merged[1] == merged[3]) & (merged[1] - merged[0] == 1)
        keep &= ~alone
        pairs, diff, depth = np.stack(merged[:4], 1)[keep], merged[4][keep], depth + 1
    return labels


#: Node pairs of a task are handled together until their possible leaf pairs reach this number.
LEAF_PAIRS_AT_ONCE = 1_000_000


def _edges(frame: pd.DataFrame, max_bits: int, depth: int) -> pd.DataFrame:
    """Spanning edges of the links in complete node-pair groups; columns rot, pa, pb, side, diff, v."""
    frame = frame.sort_values(["rot", "pa", "pb", "side", "v"], kind="stable")
    v = frame["v"].to_numpy(np.int64).view(np.uint64)
    key = frame[["rot", "pa", "pb"]].to_numpy(np.int64)
    side = frame["side"].to_numpy()
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
    end = np.r_[new[1:], len(v)]
    first_b = np.searchsorted(np.cumsum(side), np.cumsum(side)[new] - side[new], "right")
    first_b = np.minimum(np.maximum(first_b, new), end)
    own = key[new, 1] == key[new, 2]
    pairs = np.stack([new, np.where(own, end, first_b), np.where(own, new, first_b), end], 1)
    diff = frame["diff"].to_numpy()[new]
    live = (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (end - new > 1)
    pairs, diff = pairs[live], diff[live]
    out_i, out_j = [], []
    cost = np.cumsum((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]))
    at = 0
    while at < len(pairs):
        upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + LEAF_PAIRS_AT_ONCE, "right")))
        lo, hi = pairs[at, 0], pairs[upto - 1, 3]
        labels = trie_forest(v[lo:hi], pairs[at:upto] - lo, depth, diff[at:upto], max_bits)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        out_i.append(moved + lo)
        out_j.append(labels[moved] + lo)
        at = upto
    i = np.concatenate(out_i) if out_i else np.zeros(0, np.int64)
    j = np.concatenate(out_j) if out_j else np.zeros(0, np.int64)
    rot = key[:, 0].astype(np.uint64)

    def back(k: np.ndarray) -> np.ndarray:
        r = rot[k] * np.uint64(64 // (max_bits + 1))
        return np.where(r == 0, v[k], (v[k] >> r) | (v[k] << ((np.uint64(64) - r) & np.uint64(63)))).view(np.int64)

    return pd.DataFrame({"a": back(i), "b": back(j)})


def _groups(batches: Iterator[pd.DataFrame], max_bits: int, depth: int) -> Iterator[pd.DataFrame]:
    """Feed sorted batches to ``_edges`` so that no group is cut."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = rest.iloc[-1]
        whole = ((rest["rot"] != last["rot"]) | (rest["pa"] != last["pa"]) | (rest["pb"] != last["pb"])).to_numpy()
        if whole.any():
            yield _edges(rest[whole], max_bits, depth)
            rest = rest[~whole]
    if rest is not None and len(rest):
        yield _edges(rest, max_bits, depth)


def link_edges(fps: DataFrame, fp_col: str = "fp", max_bits: int = 3, node_limit: int = 1500, step: int = 4) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that links connect.

    ``fps``: one row per distinct fingerprint (signed long). A node pair that
    holds more than ``node_limit`` fingerprints is replaced by the pairs of its
    children ``step`` bits deeper, until none does.
    """
    if not 0 <= max_bits <= 7 or 64 % (max_bits + 1):
        raise ValueError("max_bits must be 0, 1, 3 or 7")
    block = 64 // (max_bits + 1)

    def head(v: Column, bits: int) -> Column:
        return F.shiftrightunsigned(v, 64 - bits) if bits < 64 else v

    v = F.col(fp_col).cast("long")
    turned = [(F.lit(r), v if r == 0 else F.shiftleft(v, r * block).bitwiseOR(F.shiftrightunsigned(v, 64 - r * block))) for r in range(max_bits + 1)]
    rows = (fps.select(F.explode(F.array(*[F.struct(r.alias("rot"), x.alias("v")) for r, x in turned])).alias("x")).select("x.*")
            .withColumn("pa", head(F.col("v"), block)).withColumn("pb", F.col("pa"))
            .withColumn("side", F.lit(0)).withColumn("diff", F.lit(0)))
    depth, found = block, []
    key = ["rot", "pa", "pb"]
    while True:
        sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
        big = materialize(sizes.where(F.col("n") > node_limit).select(*key), "simhash-large")
        more = depth < 64 and not big.isEmpty()
        small = rows.join(big, key, "left_anti") if more else rows
        at = depth
        found.append(small.repartition(*key).sortWithinPartitions(*key)
                     .mapInPandas(lambda it, at=at: _groups(it, max_bits, at), "a long, b long"))
        if not more:
            break
        deeper = min(64, depth + step)
        grow = deeper - depth
        large = materialize(rows.join(big, key, "left_semi").withColumn("c", head(F.col("v"), deeper)), "simhash-split")
        own = F.col("pa") == F.col("pb")
        children = large.groupBy(*key).agg(
            F.collect_set(F.when(F.col("side") == 0, F.col("c"))).alias("ca"),
            F.collect_set(F.when((F.col("side") == 1) | own, F.col("c"))).alias("cb"))
        met = large.join(children, key)
        other = F.when(F.col("side") == 0, F.col("cb")).otherwise(F.col("ca"))
        split = met.select("rot", "v", "pa", "pb", "side", "diff", "c", F.explode(other).alias("o"))
        low, high = F.least("c", "o"), F.greatest("c", "o")
        first = F.when(own, F.col("c") <= F.col("o")).otherwise(F.col("side") == 0)
        rows = materialize(
            split.withColumn("d", F.col("diff") + F.bit_count(F.col("c").bitwiseXOR(F.col("o")))).where(F.col("d") <= max_bits)
            .select("rot", "v",
                    F.when(own, low).when(F.col("side") == 0, F.col("c")).otherwise(F.col("o")).alias("pa"),
                    F.when(own, high).when(F.col("side") == 0, F.col("o")).otherwise(F.col("c")).alias("pb"),
                    F.when(first, 0).otherwise(1).alias("side"), F.col("d").cast("int").alias("diff")), "simhash-nodes")
        depth += grow
    edges = found[0]
    for f in found[1:]:
        edges = edges.unionByName(f)
    return edges.distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least of its component.

    Alternates large-star and small-star. Only minima per node are computed,
    so a node with very many neighbours is a partial aggregate and a joined
    key, never a list. Each round is written to the shared folder, and the one
    before it deleted. It ends: every round but the last moves a node to a lesser root.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def low(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-edges")
    seen = None
    while True:
        two = both(now)
        large = two.join(low(two), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mins = low(large)
        small = (large.join(mins, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(mins.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        old, now = now, materialize(small, "star-edges")
        discard(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def _rooted(prints: DataFrame, max_bits: int, node_limit: int) -> DataFrame:
    """(fp, root, size, first) of each distinct fingerprint of (fp, id, row): ``first`` is its least (id, row) with an id."""
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row")))
    distinct = materialize(prints.groupBy("fp").agg(first.alias("first"), F.count("*").alias("size")), "simhash-distinct")
    roots = star_components(link_edges(distinct, "fp", max_bits, node_limit))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(placed, "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3,
                    node_limit: int = 1500) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the least id reachable over links.

    Null text counts as empty; texts without words have fingerprint zero and
    link like any other. Repeated rows stay rows. A null id gets its
    component's least non-null id, or null when the component has none. Other
    columns are not carried, so their names cannot clash. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("row"), F.col(text_col).alias("t"))
    prints = materialize(with_fingerprint(rows, "t", "fp", shingle).drop("t"), "simhash-prints")
    placed = _rooted(prints, max_bits, node_limit)
    least = placed.groupBy("root").agg(F.min("first.id").alias("component_id"))
    named = materialize(placed.join(least, "root").select("fp", "size", "component_id"), "simhash-named")
    return join_hot(prints.select("id", "fp"), named, "fp", "size").select(F.col("id").alias(id_col), "fp", "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, node_limit: int = 1500) -> DataFrame:
    """One document of each near-duplicate group, with the columns of ``docs``.

    The row whose id is the component's least stays; one of them, if rows share
    that id. Rows that share an id but not a component are separate. Rows with
    a null id stay and are no one's copy.
    """
    row, fp = fresh(docs, "row", "fp")
    whole = materialize(with_fingerprint(docs.withColumn(row, F.monotonically_increasing_id()), text_col, fp, shingle), "simhash-rows")
    prints = whole.where(F.col(id_col).isNotNull()).select(F.col(fp).alias("fp"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    placed = _rooted(prints, max_bits, node_limit)
    groups = placed.groupBy("root").agg(F.min("first").alias("stays"), F.sum("size").alias("rows")).where("rows > 1")
    more = materialize(placed.join(groups, "root").select("fp", "size", F.col("stays.row").alias("stays")), "simhash-more")
    drop = join_hot(prints.select("fp", "row"), more, "fp", "size").where("row <> stays").select(F.col("row").alias(row))
    return whole.join(drop, row, "left_anti").select(*docs.columns)
