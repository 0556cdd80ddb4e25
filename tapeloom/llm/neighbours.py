"""Approximate nearest neighbours: a forest of random-projection trees.

Every inner node splits by the hyperplane between two random sample vectors, at
the median of the sample. A query walks all trees with one shared priority
queue, ordered by the squared distance that the path has had to cross, and
collects leaves until they hold a given number of rows. What the leaves
hold is ranked by the exact inner product in double precision.

Trees are fitted on a bounded sample; every row is indexed. Searches of the
sample also tell how many rows must be visited for the wanted recall: few
where vectors are structured, most where they are not. Largest inner product is
turned into nearest by one extra component, so that all indexed vectors have the
same length. Equal vectors are indexed once, with the smallest ids that any
query could need.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import materialize


@dataclass
class Forest:
    """Per tree: normals (nodes, d), offsets (nodes,); node k has children 2k+1 and 2k+2."""

    depth: int
    normals: list[np.ndarray]
    offsets: list[np.ndarray]

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree: (n, trees)."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t, (w, b) in enumerate(zip(self.normals, self.offsets)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, w[node]) > b[node])
            out[:, t] = node - (self.leaves - 1)
        return out

    def order(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """All (tree, leaf) in order of the shared queue."""
        heap = [(0.0, t, 0) for t in range(len(self.normals))]
        margins = [(w @ q - b).tolist() for w, b in zip(self.normals, self.offsets)]
        inner = self.leaves - 1
        while heap:
            cost, t, node = heapq.heappop(heap)
            while node < inner:
                m = margins[t][node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(heap, (cost + m * m, t, 4 * node + 3 - near))
                node = near
            yield t, node - inner

    def search(self, q: np.ndarray, counts: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """The first (tree, leaf) of the shared queue that together hold ``enough`` rows, by ``counts`` per tree and leaf."""
        found, held = [], 0.0
        for t, leaf in self.order(q):
            if held >= enough:
                break
            if counts[t][leaf]:
                found.append((t, leaf))
                held += counts[t][leaf]
        return found


def leaf_counts(places: np.ndarray, leaves: int) -> np.ndarray:
    """Rows of every leaf, (trees, leaves), from the leaves of rows in every tree."""
    return np.stack([np.bincount(p, minlength=leaves) for p in places.T]).astype(float)


def share_needed(forest: Forest, sample: np.ndarray, k: int, recall: float, tries: int = 100, seed: int = 23) -> float:
    """The rows that searches of the sample visit, as a share of it, until this part of true neighbours is met.

    Rows count once per tree. ``k``: how many of the sample's rows stand for a query's neighbours.
    """
    if len(sample) < 2:
        return float(len(forest.normals))
    places = forest.place(sample)
    counts = leaf_counts(places, forest.leaves)
    picked = np.random.default_rng(seed).permutation(len(sample))[:tries]
    at_share: list[float] = []
    for i in picked.tolist():
        far = ((sample - sample[i]) ** 2).sum(1)
        far[i] = np.inf
        left = set(np.argpartition(far, min(k, len(far) - 1) - 1)[:min(k, len(far) - 1)].tolist())
        wanted = {(t, leaf): [] for j in left for t, leaf in enumerate(places[j].tolist())}
        for j in left:
            for t, leaf in enumerate(places[j].tolist()):
                wanted[t, leaf].append(j)
        held = 0.0
        for spot in forest.order(sample[i]):
            held += counts[spot]
            for j in wanted.get(spot, ()):
                if j in left:
                    left.remove(j)
                    at_share.append(held / len(sample))
            if not left:
                break
    return float(np.quantile(at_share, recall, method="higher"))


def grow_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 17) -> Forest:
    rng = np.random.default_rng(seed)
    normals, offsets = [], []
    for _ in range(trees):
        w, b = np.zeros(((1 << depth) - 1, sample.shape[1])), np.zeros((1 << depth) - 1)
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, own = todo.pop()
            if node >= len(b):
                continue
            x = sample[own]
            v = np.zeros(sample.shape[1])
            if len(own) >= 2:
                i, j = rng.choice(len(own), 2, replace=False)
                v = x[i] - x[j]
            if not v.any():
                v = rng.normal(size=sample.shape[1])
            w[node] = v / np.linalg.norm(v)
            p = x @ w[node]
            b[node] = np.median(p) if len(own) else 0.0
            todo += [(2 * node + 1, own[p <= b[node]]), (2 * node + 2, own[p > b[node]])]
        normals.append(w)
        offsets.append(b)
    return Forest(depth, normals, offsets)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of vectors that are neither null nor zero and hold finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall(v, lambda x: x == 0.0)
    # adding 0.0 makes -0.0 equal to 0.0
    return (vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x + 0.0).alias("v")))


def _stack(column: pd.Series, d: int) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, d))


def deal(counts: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Block of every leaf, number of blocks that it is split over, and blocks in all; no block holds leaves of two trees."""
    block, parts, used = np.zeros(counts.shape, np.int64), np.maximum(1, np.ceil(counts / block_rows)).astype(np.int64), 0
    for t in range(len(counts)):
        held = 0.0
        for leaf, n in enumerate(counts[t].tolist()):
            if held and held + n > block_rows:
                used, held = used + 1, 0.0
            block[t, leaf] = used
            held += n
            if parts[t, leaf] > 1:
                used, held = used + int(parts[t, leaf]), 0.0
        used += held > 0
    return block, parts, used


def _best(score: np.ndarray, k: int, margin: float, exact, least: np.ndarray) -> np.ndarray:
    """Indices of all that may be among the ``k`` best; of very many ties within the margin, the least ids by exact score."""
    if len(score) <= k:
        return np.arange(len(score))
    near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - margin)
    if len(near) <= 4 * k:
        return near
    return near[np.lexsort((least[near], -exact(near)))[:k]]


def nearest(vectors: DataFrame, query_if: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = 4,
            leaf_rows: int = 128, recall: float = 0.96, search_share: float | None = None, sample_rows: int = 20_000, block_values: int = 4_000_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``query_if`` (over ``vec_id``) selects.

    A row is not a candidate for itself, but rows with its vector are. Ties go
    to the smaller id. Rows that repeat id and vector count once; rows that share
    an id but not the vector are candidates and queries of their own. Vectors
    that are null, zero, not finite, or not of the table's most common length take
    no part. With fewer than ``k`` candidates all are returned; an empty table
    gives no rows.

    ``sample_rows`` bounds what the trees are fitted on and how deep they get:
    leaves hold about ``leaf_rows`` rows, or more where the sample is too small.
    A query visits leaves until they hold ``search_share`` times as many rows as
    the table (a row counts once per tree). By default the sample tells that share:
    it is the one at which searches of the sample meet ``recall`` of the true
    neighbours. Only visited leaves are scored. Leaves are dealt to tasks of about
    ``block_values`` vector components, and larger leaves split.
    """
    usable = materialize(usable_vectors(vectors, id_col, vector_col).distinct(), "ann-vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = sizes["d"]
    usable = usable.where(F.size("v") == d)
    order = Window.partitionBy("v").orderBy("vec_id")
    least = usable.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    # rows of one id may differ in their vectors, so a vector is named by a number of its own
    distinct = materialize(least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.monotonically_increasing_id()), "ann-distinct")
    facts = distinct.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    rows, top = facts[0], math.sqrt(facts[1])
    dice = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    sample = (distinct.where(dice < math.ceil(min(1.0, 2 * sample_rows / rows) * (1 << 30))).select("v", dice.alias("dice"))
              .orderBy("dice", "v").limit(sample_rows).toPandas())

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]], 1)

    known = lifted(_stack(sample["v"], d))
    depth = max(0, min(math.ceil(math.log2(max(1, rows / leaf_rows))), int(math.log2(max(1, len(known) / 4)))))
    forest = grow_forest(known, trees, depth)
    if search_share is None:
        search_share = share_needed(forest, known, max(1, round(k * len(known) / rows)), recall)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaves=forest.place(lifted(_stack(b["v"], d))).tolist())

    indexed = materialize(distinct.select("rep", F.col("ids")[0].alias("low"), "v").mapInPandas(index, "rep long, low long, v array<double>, leaves array<int>"), "ann-index")
    counts = np.zeros((trees, forest.leaves))
    for r in indexed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():  # at most trees x leaves of the sample
        counts[r["tree"], r["leaf"]] = r["count"]
    block_of, parts, blocks = deal(counts, max(1, block_values // max(1, d)))

    queries = usable.where(query_if).select(F.col("vec_id").alias("query_id"), "v")
    asked = materialize(queries.select("v").distinct().join(distinct.select("v", "rep"), "v").withColumnRenamed("rep", "q"), "ann-queries")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaves, rep, t = np.array(b["leaves"].to_list()).ravel(), np.repeat(b["rep"].to_numpy(), trees), np.tile(np.arange(trees), len(b))
            yield pd.DataFrame({"block": block_of[t, leaves] + rep % parts[t, leaves], "q": rep, "low": np.repeat(b["low"].to_numpy(), trees), "v": np.repeat(b["v"].to_numpy(), trees), "spots": [[x] for x in leaves.tolist()]})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple[int, int, int, np.ndarray, list[int]]] = []
            for q, v in zip(b["q"], b["v"]):
                by_block: dict[int, list[int]] = {}
                for t, leaf in forest.search(np.append(np.asarray(v, float), 0.0), counts, max(trees * (k + 1), search_share * rows)):
                    for part in range(parts[t, leaf]):
                        by_block.setdefault(int(block_of[t, leaf]) + part, []).append(leaf)
                out += [(block, q, 0, v, spots) for block, spots in by_block.items()]
            yield pd.DataFrame(out, columns=["block", "q", "low", "v", "spots"])

    kind = "block int, q long, low long, v array<double>, spots array<int>"
    spread = vectors.sparkSession.sparkContext.defaultParallelism * 4
    both = (indexed.mapInPandas(store, kind).withColumn("asks", F.lit(0))
            .unionByName(asked.repartition(spread, "q").mapInPandas(route, kind).withColumn("asks", F.lit(1))))

    def rank_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one block come together, the stored ones first."""
        held: list[pd.DataFrame] = []
        block, rep, low, x, at = None, *[np.zeros(0, np.int64)] * 2, np.zeros((0, d)), np.zeros(0, np.int64)
        for b in batches:
            for (own, asks), part in b.groupby(["block", "asks"], sort=True):
                if own != block:
                    block, held = own, []
                    rep, low, x, at = rep[:0], low[:0], x[:0], at[:0]
                if not asks:
                    held.append(part)
                    continue
                if held:
                    whole = pd.concat(held)
                    held, leaf = [], np.array([s[0] for s in whole["spots"]])
                    turn = np.argsort(leaf, kind="stable")
                    rep, low, x, at = whole["q"].to_numpy()[turn], whole["low"].to_numpy()[turn], _stack(whole["v"], d)[turn], leaf[turn]
                for lo in range(0, len(part), 256):
                    yield _rank(part.iloc[lo:lo + 256], rep, low, x, at, k, top, d)

    found = both.repartition(max(blocks, 1), "block").sortWithinPartitions("block", "asks").mapInPandas(rank_block, "q long, rep long, score double, margin double")
    # a vector met in several trees has scores that may differ in the last bits; the exact one is taken below
    once = found.groupBy("q", "rep").agg(F.max("score").alias("score"), F.max("margin").alias("margin"))
    near = Window.partitionBy("q").orderBy(F.desc("score"))
    kth = F.min(F.when(F.col("n") <= k + 1, F.col("score"))).over(Window.partitionBy("q"))
    kept = once.withColumn("n", F.row_number().over(near)).withColumn("kth", kth).where(F.col("score") >= F.col("kth") - F.col("margin")).select("q", "rep")
    scored = kept.join(distinct.select("rep", "ids", F.col("v").alias("x")), "rep").join(asked.select("q", F.col("v").alias("y")), "q")

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([math.fsum(np.asarray(a, float) * np.asarray(b, float)) for a, b in zip(x, y)], dtype=float)

    scored = scored.select("q", "rep", "ids", exact("x", "y").alias("score"))
    rows_of = scored.select("q", (F.col("q") == F.col("rep")).alias("own"), F.explode("ids").alias("vec_id"), "score")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = rows_of.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    answers = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "own"))).alias("best"))
    named = queries.join(asked, "v").select("query_id", "q")
    mine = named.join(answers, "q").select("query_id", F.slice(F.filter("best", lambda s: ~s["own"] | (s["vec_id"] != F.col("query_id"))), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _rank(asked: pd.DataFrame, rep: np.ndarray, least: np.ndarray, x: np.ndarray, at: np.ndarray, k: int, top: float, d: int) -> pd.DataFrame:
    """(q, rep, score, margin): what may be among the ``k`` + 1 best of a block for each query; ``at``: the rows' leaves, in order."""
    y = _stack(asked["v"], d)
    count = np.array([len(s) for s in asked["spots"]])
    spot, who = np.concatenate(asked["spots"].to_list()).astype(np.int64), np.repeat(np.arange(len(asked)), count)
    low, high = np.searchsorted(at, spot, "left"), np.searchsorted(at, spot, "right")
    place = np.r_[0, np.cumsum(high - low)]
    score, row = np.zeros(place[-1]), np.zeros(place[-1], np.int64)
    by_leaf = np.argsort(spot, kind="stable")
    for own in np.split(by_leaf, np.flatnonzero(np.diff(spot[by_leaf])) + 1):
        a, b = low[own[0]], high[own[0]]
        where = place[own][:, None] + np.arange(b - a)
        score[where] = y[who[own]] @ x[a:b].T
        row[where] = np.arange(a, b)
    ends = place[np.r_[0, np.cumsum(count)]]
    qs, reps, scores, margins = [], [], [], []
    for n, (q, lo, hi) in enumerate(zip(asked["q"], ends[:-1], ends[1:])):
        margin = 1e-9 * top * float(np.sqrt(y[n] @ y[n]))
        own = row[lo:hi]
        pick = _best(score[lo:hi], k + 1, margin, lambda some: np.array([math.fsum(y[n] * v) for v in x[own[some]]]), least[own])
        qs.append(np.full(len(pick), q))
        reps.append(rep[own[pick]])
        scores.append(score[lo:hi][pick])
        margins.append(np.full(len(pick), margin))
    return pd.DataFrame({"q": np.concatenate(qs), "rep": np.concatenate(reps), "score": np.concatenate(scores), "margin": np.concatenate(margins)})
