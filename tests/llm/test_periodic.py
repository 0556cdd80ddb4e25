import hashlib
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import periodic, registry
from tests.llm.helpers import DIR, docs


def by_hand(w):
    """Every stretch for every period, kept if the period is its smallest."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and all(any(w[k] != w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def shown(w, runs):
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in drop)
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def test_walk_against_brute_force():
    rng, seen = random.Random(3), 0
    for _ in range(1500):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, letters = rng.randrange(80), rng.choice([1, 2, 3, 9])
            w = [rng.randrange(letters) for _ in range(n)]
            if n > 8 and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randrange(1, 9)
                w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
                if rng.random() < 0.4:
                    w[rng.randrange(n)] = 99
            texts.append(w)
        want = [by_hand(w) for w in texts]
        assert periodic.runs_of([np.array(w, np.int64) for w in texts]) == want
        seen += sum(map(len, want))
    assert seen > 1500


def test_long_and_repetitive_texts_stay_near_linear():
    rng = random.Random(4)
    for w in ([0] * 200_000, [int(rng.random() < 0.1) for _ in range(100_000)], [rng.randrange(5000) for _ in range(100_000)] * 2):
        began = time.time()
        periodic.runs_of([np.array(w)])
        assert time.time() - began < 20


def test_edges(spark):
    texts = [None, "", " \t\n", "a " * 5, "a " * 6, " a  " * 7, "x a b a b a b a b y", "a b c " * 4 + "z " + "a b c " * 4, "ü 😀 " * 9, "a\x1cb " * 6, "w " * 70_000]
    rows = docs(spark, texts).unionByName(docs(spark, texts[6:7], 7)).withColumns({n: F.lit(1) for n in ("runs", "strongest", "collapsed", "id", "words")})
    got = periodic.find_runs(rows).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        w = words(texts[r.doc_id - 1])
        runs = by_hand(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert [tuple(x) for x in r.runs] == runs
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.collapsed == " ".join(x for k, x in enumerate(w) if k not in drop)
    assert periodic.find_runs(rows.limit(0)).count() == 0
    null = rows.limit(3).withColumn("doc_id", F.lit(None).cast("string"))
    assert periodic.find_runs(null).where("doc_id is null").count() == 3


def test_strongest_is_exact_and_ties_go_left():
    assert periodic.strongest([(0, 9, 2), (5, 18, 4), (30, 8, 2)]) == (0, 9, 2)
    assert periodic.strongest([(0, 8, 2), (0, 12, 3), (9, 13, 3)]) == (9, 13, 3) and periodic.strongest([]) is None


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in registry.queries()["op11_periodic_runs"](spark, DIR).collect()}
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for r in rows:
        w, h = words(r.text), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            planted += 1
        x = got[r.doc_id]
        runs = by_hand(w)
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == shown(w, runs)
    assert planted > 10
