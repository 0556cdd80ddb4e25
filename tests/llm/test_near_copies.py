import random
from functools import partial

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import near_copies, simhash
from tests.llm.helpers import DIR, docs


def slow_sets(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def slow_groups(texts, ids):
    """The least id of each row's component of exact Jaccard links."""
    sets, root = slow_sets(texts), list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both / max(1, len(sets[i] | sets[j])) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(ids))]


def stage(spark, rows):
    return dict(corpus_pipeline.STAGES)["simhash"](spark, rows, DIR)


def test_stage_against_brute_force(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = table.toPandas()
    got = stage(spark, table)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(slow_groups(rows.text, rows.doc_id))) and got.columns == table.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_chains_and_edges(spark, seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(12):  # copies of copies with a few words changed: similarities on both sides of the bound
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(40, 400))]
        texts.append(" ".join(words))
        for _ in range(12):
            words = list(words) if rnd.random() < 0.5 else texts[-1].split()
            for _ in range(rnd.randrange(1, 2 + len(words) // 45)):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(5000)}"
            texts.append(" ".join(words))
    texts += [None, "", "  ", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f"]
    want = slow_groups(texts, list(range(1, len(texts) + 1)))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, texts)).collect()}
    assert [got[k + 1] for k in range(len(texts))] == want
    assert 12 < len(set(want)) < len(texts) - 12


def test_null_ids_and_repeated_ids(spark):
    rows = docs(spark, ["a b c d e f g", "A b c d e f g", "other"]).selectExpr("if(doc_id = 3, null, doc_id) doc_id", "text", "lang", "source", "n_chars")
    got = stage(spark, rows.unionByName(rows))
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 0, 1]
    assert stage(spark, rows.limit(0)).count() == 0


def same(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("one", [near_copies.one_per_copy_group, simhash.one_per_group])
def test_rows_that_share_an_id_are_judged_by_their_texts(spark, one):
    w = [f"{x} b c d e f {x} {x}" for x in "pqrstuvw"]
    rows = same(spark, [(3, w[0]), (5, w[0]), (5, w[1]), (15, w[2]), (15, w[3]), (25, w[4]), (25, w[4]), (31, w[5]), (32, w[5])])
    rows = rows.withColumns({"row": F.lit(1), "fp": F.lit(2), "sketch": F.lit(3), "node": F.lit(4)})
    kept = one(rows)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, w[0]), (5, w[1]), (15, w[2]), (15, w[3]), (25, w[4]), (31, w[5])] and kept.columns == rows.columns


def test_small_trie_nodes_and_one_large_group(spark):
    """Nodes of 8 fingerprints at most give the same groups; so does one of 3,000 texts that share nearly all their bits."""
    rnd = random.Random(3)  # one call for each of the two
    base = [[f"w{rnd.randrange(9000)}" for _ in range(120)] for _ in range(150)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:60], "x", *w[61:]]) for w in base[:50]]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, texts), node_limit=32).collect()}
    assert [got[k + 1] for k in range(200)] == [*range(1, 151), *range(1, 51)]
    words = [f"v{k}" for k in range(900)]
    texts = [" ".join([*words[:450], f"n{k}", *words[450:]]) for k in range(3_000)] + ["other words altogether are in this one"]
    kept = near_copies.one_per_copy_group(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3001]


def test_chance_of_meeting():
    assert near_copies.chance_of_meeting(0.8, 250_000) > 0.9999 and near_copies.chance_of_meeting(0.9, 10 ** 10) > 0.9


def prints(spark, f):
    """Fingerprints as the nodes that the tries are built of, each its own root."""
    table = pd.DataFrame({"node": np.arange(len(f)), "n": 100, **{f"f{k}": f[:, k].view(np.int64) for k in range(4)}, "root": np.arange(len(f))})
    return spark.createDataFrame(table)


def test_partners_whose_leading_bits_differ_in_every_rotation_meet(spark):
    """The eighth bit of every rotation differs, so no node below depth 7 holds both: only a pair of nodes does."""
    f = np.random.default_rng(5).integers(0, 2 ** 64, (602, 4), dtype=np.uint64)
    f[601] = f[600] ^ np.uint64(0x0101010101010101)
    rows = near_copies._node_pairs(prints(spark, f), 602, 32, 1, every=True)
    work = partial(near_copies._nearest_apart, budget=near_copies.error_budget(602, 1))
    found = near_copies._in_each_pair(rows, work, 0.8, "a long, b long, bits long").distinct().collect()
    assert sorted(map(tuple, found)) == [(600, 601, 32), (601, 600, 32)]


def test_large_node_pairs_give_way_to_their_children(spark):
    """Every pair within the budget of all depths meets, though node pairs hold four rows at most; rows of one root do not."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2 ** 64, (12, 4), dtype=np.uint64)
    noise = np.packbits(rng.random((240, 256)) < 0.08, axis=1).view(np.uint64)
    f = base[np.arange(240) % 12] ^ noise
    root = np.where(np.arange(240) % 12 == 0, 0, np.arange(240))
    nodes = prints(spark, f).withColumn("root", F.when(F.col("node") % 12 == 0, 0).otherwise(F.col("node")))
    budget = near_copies.error_budget(240, 2)
    rows = near_copies._node_pairs(nodes, 240, 4, 2, every=True)
    sizes = rows.groupBy("rot", "depth", "pa", "pb").count().where("depth < 64").agg(F.max("count")).first()[0]

    def told(part, similarity):
        part, own = near_copies._in_order(part)
        node, out = part["node"].to_numpy(), [np.zeros((0, 2), np.int64)]
        for i, j, _ in near_copies._in_budget(part, own, similarity, budget):
            out.append(np.stack([node[i], node[j]], 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    found = near_copies._in_each_pair(rows, told, 0.8, "a long, b long")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()}
    i, j = np.triu_indices(240, 1)
    left = (np.bitwise_count(f[i] ^ f[j]).sum(1) <= near_copies.MAX_BITS) & (root[i] != root[j])
    i, j = i[left], j[left]
    meet = np.zeros(len(i), bool)
    for r in range(4):  # rotations of 64 bits: a word leads, and is the path
        meet |= near_copies._within(f[i, r] ^ f[j, r], budget, 0, 64)
    assert sizes <= 4 and set(zip(i[meet], j[meet])) <= got <= set(zip(i, j)) and meet.sum() > 500
    assert near_copies._met_before(f, i, j, 4, 4, budget).tolist() == meet.tolist()


def test_groups_with_small_node_pairs(spark):
    rnd = random.Random(8)
    texts = []
    for _ in range(6):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 300))]
        for _ in range(8):
            texts.append(" ".join(words))
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(5000)}"
    want = slow_groups(texts, list(range(1, len(texts) + 1)))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, texts), node_limit=4).collect()}
    assert [got[k + 1] for k in range(len(texts))] == want


def test_budget_keeps_the_chance_of_meeting():
    """Every pair of few texts; at most a pair in thousands where a shared prefix of log2(texts / 2048) bits loses one in fifty."""
    assert near_copies.error_budget(8192).tolist() == list(range(65))
    assert near_copies.chance_of_meeting(0.8, 12_000_000) > 0.9999 and near_copies.chance_of_meeting(0.8, 10 ** 10) > 0.95
