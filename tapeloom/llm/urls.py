"""URL verdicts: explicit rules, and a path-template tree for what they leave open.

Rules are host and path prefixes; the longest that fits decides. The urls that
rules decide are the labelled ones. Per host, paths form a tree of segments:
segments that look variable (numbers, hex, long tokens), or that hardly repeat
under their parent, become wildcards. Sibling branches, inner ones as well as
last segments, whose labelled share does not differ significantly from their
parent's become one wildcard branch, level by level from the bottom. What remains
are templates; one is blocked when the share of blocked urls among its labelled
ones, smoothed towards its parent's, and that towards its own, up to the host
and the corpus, reaches a threshold. So a template without labels follows its
nearest labelled ancestor.

Everything is counts over (host, node), so a host with a third of all urls is
a partial aggregate like any other; urls meet their template by distinct path,
the commonest paths by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import join_hot, materialize

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, host before path at equal length; nulls if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """Segments that are variable by their look."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return (F.when(stem.rlike(r"^[0-9]+$"), "*").when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), "*")
            .when(F.length(segment) > 40, "*").otherwise(segment))


def _levels(lexical: DataFrame, least: int) -> int:
    """The fewest levels, ``least`` or more, at which paths cut to them still differ: doubled, then halved, over counts of hashed prefixes."""
    def merges(k: int) -> bool:
        cut = lexical.where(F.size("segs") > k).groupBy("host", F.xxhash64(F.slice("segs", 1, k))).agg(F.count("*").alias("n"))
        return not cut.where("n > 1").isEmpty()

    low, high = least - 1, least
    while merges(high):
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if merges(mid) else (low, mid)
    return high


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", least_depth: int = 6, distinct_share: float = 0.5,
               least_seen: int = 20, z: float = 1.96, host_weight: float = 4.0, corpus_weight: float = 4.0, prior_weight: float = 2.0,
               threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and an empty
    template. The tree has as many levels as keep all paths apart that differ, and at least
    ``least_depth``: below them each path is alone, and what is left of it counts as one segment.
    A level takes a few jobs. Repeated rows stay rows;
    other columns are not carried, so their names cannot clash. Without any
    labelled url all templates have purity 0 and are allowed.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    base = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, given = rule_for(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("given", given)

    # one row per distinct (host, lexical segments): urls, labelled ones and blocked ones
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    shaped = F.transform(segments, _shape)
    lexical = materialize(base.withColumn("segs", shaped).groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("given").alias("known"), F.count_if(F.col("given") == "block").alias("bad")), "url-paths")
    depth = _levels(lexical, least_depth)

    def cut(path: Column) -> Column:
        return F.when(F.size(path) > depth, F.concat(F.slice(path, 1, depth), F.array(F.lit("**")))).otherwise(path)

    lexical, segs = lexical.withColumn("segs", cut(F.col("segs"))), cut(shaped)

    # a parent whose children hardly repeat gets a wildcard below it
    level = F.transform(F.sequence(F.lit(1), F.size("segs")), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("segs", 1, k - 1), "/").alias("parent"), F.element_at("segs", k).alias("seg")))
    nodes = lexical.where(F.size("segs") > 0).select("host", "n", F.explode(level).alias("l")).select("host", "n", "l.*")
    children = nodes.groupBy("host", "k", "parent", "seg").agg(F.sum("n").alias("n"))
    wild = (children.groupBy("host", "k", "parent").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
            .where((F.col("n") >= least_seen) & (F.col("kinds") >= distinct_share * F.col("n"))).select("host", "k", "parent"))
    marks = (lexical.where(F.size("segs") > 0).select("host", "segs", F.explode(level).alias("l")).select("host", "segs", "l.k", "l.parent")
             .join(wild, ["host", "k", "parent"], "left_semi").groupBy("host", "segs").agg(F.collect_set("k").alias("wild")))
    general = F.transform("segs", lambda s, i: F.when(F.array_contains(F.coalesce("wild", F.array().cast("array<int>")), i + 1), "*").otherwise(s))
    paths = lexical.join(marks, ["host", "segs"], "left").withColumn("template", F.array_join(general, "/"))
    paths = materialize(paths.select("host", "segs", "template", "n", "known", "bad"), "url-templates")

    # branches that do not differ from their parent become one, from the deepest level up
    tree = (paths.groupBy("host", F.col("template").alias("own")).agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
            .withColumn("m", F.when(F.col("own") == "", F.array().cast("array<string>")).otherwise(F.split("own", "/"))))
    for k in range(depth + 1, 0, -1):
        deep = F.size("m") >= k
        up, seg = F.when(deep, F.array_join(F.slice("m", 1, k - 1), "/")).alias("up"), F.when(deep, F.try_element_at("m", F.lit(k))).alias("seg")
        branch = tree.where(deep).groupBy("host", up, seg).agg(F.sum("known").alias("bk"), F.sum("bad").alias("bb"))
        whole = branch.groupBy("host", "up").agg(F.sum("bk").alias("pk"), F.sum("bb").alias("pb"))
        rate, share = F.col("bb") / F.col("bk"), F.col("pb") / F.col("pk")
        error = F.sqrt(share * (1 - share) * (1 / F.col("bk") - 1 / F.col("pk")))
        alike = (F.col("bk") == 0) | (F.abs(rate - share) <= z * error) | (F.col("bk") == F.col("pk"))
        joined = branch.join(whole, ["host", "up"]).where(alike & (F.col("seg") != "*")).select("host", "up", "seg", F.lit(True).alias("joins"))
        wider = F.transform("m", lambda s, i: F.when(i == k - 1, "*").otherwise(s))
        tree = (tree.withColumns({"up": up, "seg": seg}).join(joined, ["host", "up", "seg"], "left")
                .withColumn("m", F.when(F.col("joins"), wider).otherwise(F.col("m"))).drop("up", "seg", "joins"))
        if k % 3 == 1:
            tree = materialize(tree, "url-tree")

    # purity, smoothed from the corpus and the host down the tree
    total = tree.agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).first()
    corpus = (total["bad"] or 0) / (prior_weight + (total["known"] or 0))
    hosts = tree.groupBy("host").agg(((F.sum("bad") + corpus_weight * F.lit(corpus)) / (F.sum("known") + corpus_weight)).alias("purity"), F.count("*").alias("n"))
    tree = join_hot(tree, hosts, "host", "n")
    for k in range(1, depth + 2):
        prefix = F.when(F.size("m") >= k, F.array_join(F.slice("m", 1, k), "/"))
        tree = tree.withColumn("prefix", prefix)
        sums = tree.where("prefix is not null").groupBy("host", "prefix").agg(F.sum("known").alias("pk"), F.sum("bad").alias("pb"))
        own = (F.col("pb") + host_weight * F.col("purity")) / (F.col("pk") + host_weight)
        tree = tree.join(sums, ["host", "prefix"], "left").withColumn("purity", F.when(F.col("prefix").isNotNull(), own).otherwise(F.col("purity"))).drop("prefix", "pk", "pb")
        if k % 3 == 0:
            tree = materialize(tree, "url-purity")
    named = tree.select("host", F.col("own").alias("template"), F.array_join("m", "/").alias("merged"), "purity")
    decided = materialize(paths.join(named, ["host", "template"]).select("host", "segs", "n", F.col("merged").alias("template"), "purity"), "url-verdicts")
    verdict = F.coalesce("given", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return (join_hot(base.withColumn("segs", segs), decided, ["host", "segs"], "n")
            .select(F.col(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity"))
