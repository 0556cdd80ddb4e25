import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tapeloom.llm import quality
from tests.llm.helpers import docs


def by_hand(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def shown(r):
    return tuple(r[m] for m in quality.MEASURES)


TRICKY = [None, "", " \t\n\x0b\x0c\r", "a b c d e", "a b c d e a b c d e", "a " * 11, "x y z 😀 ü# *$%&|<>", "one\ntwo\none\n \none \n\n", "a\r\na\r\nb", "\n\n\n", " lead trail ",
          "a b c d e f a b c d e g a b c d e f", "w" * 200_000, "same line here\n" * 3000]


def test_measures_against_brute_force(spark):
    rng = random.Random(5)
    texts = TRICKY + ["".join(rng.choice(["a", "b", " ", "\n", "c ", "#", "a b a b "]) for _ in range(rng.randrange(300))) for _ in range(150)]
    rows = docs(spark, texts).unionByName(docs(spark, texts[:3]))
    got = quality.judge_quality(rows).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        want = by_hand(texts[r.doc_id - 1])
        assert shown(r) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality.judge_quality(rows.limit(0)).count() == 0


def clean(k):
    return " ".join(f"word{k}x{j}" for j in range(14))


def test_hosts_fall_by_shrunk_rates(spark):
    """A host full of failures falls with its good texts, one failure in one text does not; a third of all rows in one host changes nothing."""
    rows = [(k, clean(k), "good") for k in range(200)] + [(1000 + k, "bad", "poor") for k in range(60)] + [(1100 + k, clean(1100 + k), "poor") for k in range(5)]
    rows += [(2000 + k, "short" if k == 0 else clean(k), f"one{k}") for k in range(80)] + [(3000, clean(3000), None), (3001, None, None)]
    got = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k].kept for k in range(200)) and not any(got[1100 + k].kept for k in range(5)) and all(got[1100 + k].host_rejected for k in range(5))
    assert not got[2000].kept and not got[2000].host_rejected and all(got[2000 + k].kept for k in range(1, 80))
    assert got[3000].kept and not got[3001].kept
    # the rates themselves, by hand
    failed, texts = defaultdict(int), defaultdict(int)
    for _, text, host in rows:
        texts[host] += 1
        failed[host] += by_hand(text)[0] < 10
    total = sum(texts.values())
    mean = sum(failed.values()) / total
    spread = sum(n * (failed[h] / n - mean) ** 2 for h, n in texts.items()) - (len(texts) - 1) * mean * (1 - mean)
    between = spread / (total - sum(n * n for n in texts.values()) / total)
    strength = max(4.0, mean * (1 - mean) / between - 1)
    wanted = {h for h in texts if (failed[h] + mean * strength + 0.5) / (texts[h] + strength + 1) > 0.5}
    assert {host for k, _, host in rows if got[k].host_rejected} == wanted == {"poor"}


def test_clashing_names_and_the_filter(spark):
    names = [*quality.MEASURES, "n_lines", "whole", "words", "word_hashes", "hashes", "order", "host", "texts", "rejected", "base", "symbols", "lines", "id", "t", "kept"]
    rows = docs(spark, [clean(1), "short", None, clean(2), "a b c " * 9]).withColumns({n: F.lit(n) for n in names})
    assert {r.doc_id: r.kept for r in quality.judge_quality(rows).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    left = quality.drop_low_quality(rows)
    assert left.columns == rows.columns and left.schema == rows.schema
    assert sorted(left.collect()) == sorted(rows.where("doc_id in (1, 4)").collect())
    assert quality.drop_low_quality(rows.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality.judge_quality(docs(spark, [clean(1)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
