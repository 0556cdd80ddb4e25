import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import neighbours, registry, simhash, urls
from tests.llm.helpers import DIR, docs


def slow_print(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, ids):
    f = np.array(prints, np.uint64)
    label = np.arange(len(f))
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 3
    while True:
        new = np.array([label[near[k]].min() for k in range(len(f))])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    least = {}
    for k, i in zip(label, ids):
        least[k] = min(least.get(k, i), i)
    return [least[k] for k in label]


def test_simhash_query_against_brute_force(spark):
    table = pd.read_parquet(f"{DIR}/documents.parquet")
    got = registry.op8_simhash(spark, DIR).toPandas().set_index("doc_id")
    prints = [slow_print(t) for t in table.text]
    assert [got.fingerprint[i] for i in table.doc_id] == [f"{p:016x}" for p in prints]
    assert [got.component_id[i] for i in table.doc_id] == slow_components(prints, table.doc_id)


def test_dense_groups_are_taken_apart_exactly(spark):
    rng = np.random.default_rng(3)
    centre, f = rng.integers(0, 2 ** 62), []
    for _ in range(900):
        x = centre
        for b in rng.integers(0, 24, rng.integers(0, 6)):
            x ^= 1 << int(b * 2)
        f.append(x)
    f = sorted(set(f) | set(rng.integers(0, 2 ** 62, 300).tolist()))
    want = slow_components(f, list(range(len(f))))
    frame = spark.createDataFrame([(int(x),) for x in f], "fp long")
    for limit in (50, 10_000):
        roots = {r.node: r.root for r in simhash.star_components(simhash.link_edges(frame, "fp", 3, limit)).collect()}
        pairs = {}
        assert all(pairs.setdefault(w, roots.get(x, x)) == roots.get(x, x) for w, x in zip(want, f))
        assert len(set(want)) == len({roots.get(x, x) for x in f})


def test_simhash_edges_and_one_per_group(spark):
    long = " ".join(f"w{k}" for k in range(20_000)) + " "
    rows = docs(spark, ["a b c d e f g", "A b C d e f g", None, "", "  ", long, long + "x", "one", "a b c d e f g"]).withColumn("component_id", F.lit(-1)).unionByName(
        docs(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("component_id", F.lit(-1)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert got[1] == got[2] == got[9] == 1 and got[3] == got[4] == got[5] == 3 and got[6] == got[7] == 6 and got[8] == 8 and got[None] is None
    kept = simhash.one_per_group(rows)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 8] and kept.columns == rows.columns
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def test_neighbours_recall_and_order(spark):
    table = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute(table.vec_id.to_numpy(), np.stack(table.embedding).astype(float))
    got = registry.op7_neighbours(spark, "/root/testdata/sf0.01").toPandas().sort_values(["query_id", "rank"])
    found = got.groupby("query_id").vec_id.apply(list)
    assert set(found.index) == set(want) and np.mean([len(set(want[q]) & set(found[q])) / 20 for q in want]) >= 0.9
    assert (got.groupby("query_id")["rank"].apply(list).map(lambda r: r == list(range(1, 21)))).all()
    assert (got.groupby("query_id").score.apply(lambda s: (s.diff().dropna() <= 0).all())).all()


def test_neighbours_with_equal_vectors_and_unusable_ones(spark):
    rows = [(k, [1.0, 0.0]) for k in range(0, 60)] + [(k, [0.5, 0.5]) for k in range(60, 65)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == list(range(1, 21)) and got[got.query_id == 40].vec_id.tolist() == list(range(20))
    assert got[got.query_id == 60].vec_id.tolist() == list(range(20)) and set(got.query_id) == {0, 20, 40, 60}
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [1, 2] and neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def clustered(n, seed=6, d=32):
    """Vectors of one length around centres, about 60 each."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 60), d))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_structured_vectors_need_few_rows(spark):
    """On structured vectors the search visits a small part, and a smaller one the more rows there are, at the wanted recall."""
    shares = {}
    for n in (2_000, 16_000):
        x = clustered(n).astype(float)
        forest = neighbours.grow_forest(x, 4, int(np.log2(n / 32)))
        shares[n] = neighbours.share_needed(forest, x, 20, 0.96)
    assert shares[16_000] < 0.5 * shares[2_000] and shares[16_000] < 0.25
    x = clustered(6_000)
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, leaf_rows=32).toPandas().sort_values(["query_id", "rank"]).groupby("query_id").vec_id.apply(list)
    want = brute(np.arange(6_000), x.astype(float))
    assert set(got.index) == set(want) and np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want]) >= 0.9


def test_ties_repeated_ids_and_a_leaf_in_parts(spark):
    rows = [(k, [float(k % 7 == j) for j in range(7)] + [0.0]) for k in range(300)] + [(300 + k, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, k / 64]) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    got = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, block_values=320, search_share=9.0).toPandas().sort_values(["query_id", "rank"]).groupby("query_id").vec_id.apply(list)
    assert {q: got[q] for q in want} == want
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [0.9, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.nearest(twice, F.col("vec_id") % 20 == 0).collect())
    assert got == [(1, 3, 0.8), (1, 4, 0.9), (2, 3, 0.6), (2, 4, 0.1), (3, 20, 0.0), (3, 20, 0.0)]


def test_url_rules(spark):
    cases = [("https://a.example.net/en/5?x", "a.example.net", "/en/5", "example.net/en/", "allow"), ("http://A.NET/x#y", "a.net", "/x", "net/", "block"), ("http://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
             ("http://x.org/fr/2", "x.org", "/fr/2", "org/fr/", "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://planet/a", "planet", "/a", None, "allow"), ("x://h?a://b/c", "h", "", None, "allow"), ("", "", "", None, "allow")]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("mine"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge_urls(rows.unionByName(rows), registry.URL_RULES).collect()}
    assert got == {k: tuple(c[1:4]) for k, c in enumerate(cases)}
    assert urls.judge_urls(rows.limit(0), registry.URL_RULES).count() == 0


def test_url_templates_follow_labels(spark):
    rules = [("block", "x.com", "/spam/1"), ("allow", "x.com", "/ok/1")]
    rows = [(k, f"http://x.com/spam/{k}.html") for k in range(100, 160)] + [(k, f"http://x.com/ok/{k}") for k in range(100, 160)]
    got = urls.judge_urls(spark.createDataFrame(rows + [(900, "http://x.com/spam/777"), (901, "http://x.com/ok/777"), (902, "http://y.com/other")], "page_id long, url string"), rules).where("page_id >= 900")
    by = {r.page_id: (r.template, r.verdict, r.rule) for r in got.collect()}
    assert by[900] == ("spam/*", "block", None) and by[901] == ("ok/*", "allow", None) and by[902][1] == "allow"


def slow_urls(rows, rules, depth=6, least=20, share=0.5, z=1.96, w=4.0):
    """The template tree in plain Python: (host, path, rule, verdict, template, purity) of each url."""
    import re
    out, paths = [], {}
    for url in rows:
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[2]), m[3]) if m else ("", "")
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1:]), default=None)
        segs = []
        for seg in filter(None, path.split("/")):
            stem = re.sub(r"\.[A-Za-z]{1,5}$", "", seg)
            segs.append("*" if re.fullmatch("[0-9]+", stem) or re.fullmatch("[0-9a-fA-F-]{8,}", stem) and re.search("[0-9]", stem) or len(seg) > 40 else seg)
        segs = tuple(segs[:depth] + ["**"] * (len(segs) > depth))
        out.append((host, path, best, segs))
        a = paths.setdefault((host, segs), [0, 0, 0])
        a[0] += 1
        a[1] += best is not None
        a[2] += best is not None and best[0] == "block"
    kids = {}
    for (host, segs), a in paths.items():
        for k, seg in enumerate(segs):
            kids.setdefault((host, segs[:k]), {}).setdefault(seg, []).append(a[0])
    wild = {key for key, c in kids.items() if sum(map(sum, c.values())) >= least and len(c) >= share * sum(map(sum, c.values()))}
    name = {key: tuple("*" if (key[0], key[1][:k]) in wild else s for k, s in enumerate(key[1])) for key in paths}
    tree = {}
    for key, a in paths.items():
        t = tree.setdefault((key[0], name[key]), [0, 0])
        t[0] += a[1]
        t[1] += a[2]
    now = {key: key[1] for key in tree}
    for k in range(depth + 1, 0, -1):
        branch = {}
        for key, m in now.items():
            if len(m) >= k:
                b = branch.setdefault((key[0], m[:k]), [0, 0])
                b[0] += tree[key][0]
                b[1] += tree[key][1]
        whole = {}
        for (host, m), (known, bad) in branch.items():
            p = whole.setdefault((host, m[:-1]), [0, 0])
            p[0] += known
            p[1] += bad
        alike = set()
        for (host, m), (known, bad) in branch.items():
            pk, pb = whole[host, m[:-1]]
            if m[-1] != "*" and (known == 0 or known == pk or abs(bad / known - pb / pk) <= z * (pb / pk * (1 - pb / pk) * (1 / known - 1 / pk)) ** 0.5):
                alike.add((host, m))
        now = {key: m[:k - 1] + ("*",) + m[k:] if len(m) >= k and (key[0], m[:k]) in alike else m for key, m in now.items()}
    known, bad = (sum(t[x] for t in tree.values()) for x in (0, 1))
    corpus, purity = bad / (2.0 + known), {}
    for key, m in now.items():
        sums = lambda k: [sum(tree[o][x] for o, n in now.items() if o[0] == key[0] and len(n) >= k and n[:k] == m[:k]) for x in (0, 1)]
        kn, b = sums(0)
        p = (b + w * corpus) / (kn + w)
        for k in range(1, len(m) + 1):
            kn, b = sums(k)
            p = (b + w * p) / (kn + w)
        purity[key] = p
    done = []
    for host, path, best, segs in out:
        key = (host, name[host, segs])
        done.append((host, path, best and best[1] + best[2], best[0] if best else "block" if purity[key] >= 0.5 else "allow", "/".join(now[key]), purity[key]))
    return done


def test_url_tree_against_plain_python(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()
    rnd = __import__("random").Random(4)
    urls_ = [r.url for r in table] + [None, "none", "http://h", "x://y/" + "a/" * 50, "x://y/" + "b" * 5_000] + ["http://hot.net/same"] * 400
    for k in range(600):
        part = rnd.choice(["en", "de"]) + "/" + rnd.choice(["news", "sport", "shop"])
        urls_.append(f"http://{rnd.choice(['a.example.com', 'b.org', 'c.test'])}/{part}/{rnd.choice(['x', 'y', str(k), f'item{k}'])}")
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls_)], "page_id long, url string")
    rules = [*registry.URL_RULES, ("block", "c.test", "/en/shop/")]
    got = {r.page_id: r for r in urls.judge_urls(frame, rules).collect()}
    for k, (host, path, rule, verdict, template, purity) in enumerate(slow_urls(urls_, rules)):
        r = got[k]
        assert (r.host, r.path, r.rule, r.template) == (host, path, rule, template) and abs(r.purity - purity) < 1e-9, (urls_[k], r, template, purity)
        assert r.verdict == verdict or abs(purity - 0.5) < 1e-9
    assert len(got) == len(urls_)


def test_url_tree_is_as_deep_as_its_paths(spark):
    """Paths that differ at their ninth and tenth levels only (so ten levels keep them apart), some blocked and some allowed; and one path of 3,000 levels."""
    deep = "http://h.test/a/b/c/d/e/f/g/h/"
    urls_ = [f"{deep}good/{x}" for x in "pqr"] * 30 + [f"{deep}bad/{x}" for x in "pqr"] * 30 + ["http://h.test/" + "z/" * 3_000] * 3
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls_)], "page_id long, url string")
    rules = [("block", "h.test", f"/a/b/c/d/e/f/g/h/bad/{x}") for x in "pq"] + [("allow", "h.test", f"/a/b/c/d/e/f/g/h/good/{x}") for x in "pq"]
    got = {r.page_id: r for r in urls.judge_urls(frame, rules).collect()}
    want = slow_urls(urls_, rules, depth=10)
    for k, (host, path, rule, verdict, template, purity) in enumerate(want):
        assert (got[k].rule, got[k].verdict, got[k].template) == (rule, verdict, template) and abs(got[k].purity - purity) < 1e-9
    assert {got[k].verdict for k, u in enumerate(urls_) if u.endswith("bad/r")} == {"block"} and {got[k].verdict for k, u in enumerate(urls_) if u.endswith("good/r")} == {"allow"}
