"""Quality rules per text and per host, in DataFrame functions only.

Every text is measured whole. Rule failures are added up by host (the
documents' owner), the rates are shrunk towards a beta prior that is fitted to
all hosts, and the hosts' verdicts are joined back to their documents: a text is
dropped if it fails the base rule, or if its host's shrunk failure rate
of any rule is over a limit.

Failures are added up before the shuffle, so a host of a third of all rows
costs one row a task. Hosts of over a thousandth of all rows (fewer than a
thousand) are joined back by broadcast, the others by a shuffle without hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh, join_hot, materialize

#: Characters between words, and those that count as symbols (fixed values of the contract).
WHITE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
WINDOW = 5
LEAST_WORDS = 10
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host's rules: its share of texts that break one decides.
RULES = ("base", "symbols", "lines")
#: Least strength of the prior, in texts, so that one text never fells a host, and its strength when hosts differ by no more than chance would have it.
LOOSEST, FIRMEST = 4.0, 10_000.0


def _repeat_cover(hashes: str, order: str, repeated: str, df: DataFrame) -> DataFrame:
    """``repeated``: how many words lie in windows whose hash occurs twice or more.

    Texts without equal hashes are told by one hash set and go no further. In the others the
    windows are sorted by hash, those that equal a neighbour are marked, and the marked
    positions in order tell how many words each adds.
    """
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    pairs = F.when(some, F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn(order, pairs)

    def mark(m: Column, k: Column) -> Column:
        beside = F.coalesce(F.get(F.col(order), k - 1)["h"] == m["h"], F.lit(False)) | F.coalesce(F.get(F.col(order), k + 1)["h"] == m["h"], F.lit(False))
        return F.when(beside, m["i"])

    df = df.withColumn(order, F.sort_array(F.array_compact(F.transform(F.col(order), mark))))
    added = F.transform(F.col(order), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(order), k + 1) - p, F.lit(WINDOW))))
    return df.withColumn(repeated, F.when(F.col(order).isNull(), F.lit(0)).otherwise(F.aggregate(added, F.lit(0), lambda a, x: a + x)).cast("long")).drop(order)


def measure(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a column per measure, and the names that these columns got (clear of the columns of ``docs``).

    Measures: those of ``MEASURES`` (long) and ``n_lines`` (lines that hold a word). Null text has no words.
    Windows are compared by 64-bit hashes of their words.
    """
    *named, lines, text, words, word_hashes, hashes, order = fresh(docs, *MEASURES, "n_lines", "whole", "words", "word_hashes", "hashes", "order")
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    kept = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(words, F.array_remove(F.split(text, WHITE, -1), "")).withColumn(lines, kept)
    df = df.withColumn(word_hashes, F.transform(words, lambda w: F.xxhash64(w)))
    firsts = F.slice(word_hashes, 1, F.size(words) - (WINDOW - 1))
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = named
    df = df.withColumns({
        n_words: F.size(words).cast("long"), word_chars: F.length(F.array_join(words, "")).cast("long"),
        n_symbols: F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        n_dup_lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), lines: F.size(lines).cast("long"),
        hashes: F.when(F.size(words) > WINDOW, F.transform(firsts, lambda h, i: F.xxhash64(h, *[F.get(F.col(word_hashes), i + k) for k in range(1, WINDOW)])))})
    df = _repeat_cover(hashes, order, n_repeat, df)
    return df.drop(text, words, word_hashes, hashes), dict(zip((*MEASURES, "n_lines"), (*named, lines)))


def breaks(names: dict[str, str]) -> dict[str, Column]:
    """Whether a text breaks each of ``RULES``, from its measures: too short or repeating itself, full of symbols, full of equal lines."""
    at = {m: F.col(c) for m, c in names.items()}
    return {"base": (at["n_words"] < LEAST_WORDS) | (100 * at["n_repeat_words"] > 20 * at["n_words"]),
            "symbols": 10 * at["n_symbols"] > at["word_chars"], "lines": 10 * at["n_dup_lines"] > 3 * at["n_lines"]}


def prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """Beta prior (alpha, beta) of a rule's failure rate over hosts, by moments weighted by texts.

    The hosts' spread less what chance gives hosts of their sizes is the prior's; without a spread it has a strength of
    ``FIRMEST`` texts. Half a failure in one text more keeps a rule that nobody breaks off zero.
    """
    n, k = F.col("texts").cast("double"), F.col(rule).cast("double")
    count, texts, failed, squares, sizes = hosts.agg(F.count("*"), F.sum(n), F.sum(k), F.sum(k * k / n), F.sum(n * n)).first()
    if not count:
        return 0.5, 0.5
    mean = failed / texts
    chance, room = mean * (1 - mean), texts - sizes / texts
    between = (squares - failed * mean - (count - 1) * chance) / room if room > 0 else 0.0
    strength = max(LOOSEST, min(FIRMEST, chance / between - 1)) if between > 0 else FIRMEST
    return mean * strength + 0.5, (1 - mean) * strength + 0.5


def host_verdicts(measured: DataFrame, names: dict[str, str], host: Column, limit: float) -> DataFrame:
    """(host, texts, a shrunk failure rate per rule, rejected), one row per host."""
    failed = breaks(names)
    hosts = materialize(measured.groupBy(host.alias("host")).agg(F.count("*").alias("texts"), *[F.sum(c.cast("long")).alias(r) for r, c in failed.items()]), "quality-hosts")
    rates = {}
    for rule in RULES:
        alpha, beta = prior(hosts, rule)
        rates[rule] = (F.col(rule) + alpha) / (F.col("texts") + (alpha + beta))
    judged = hosts.select("host", "texts", *[c.alias(r) for r, c in rates.items()])
    return judged.withColumn("rejected", F.greatest(*RULES) > limit)


def _host(host_col: str) -> Column:
    """Hosts as text; a missing one is a host of its own."""
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000"))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, ``MEASURES``, base_failed, kept, host_rejected.

    Null and empty texts have no words and fail the base rule. Rows without a
    host form one host. Repeated rows give repeated results and count as often
    for their host. Whole texts are measured, in time n log n of their words. Other columns
    are not read, so their names cannot clash. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), _host(host_col).alias("host"))
    measured, names = measure(slim, "t")
    measured = materialize(measured.drop("t"), "quality-measures")
    hosts = host_verdicts(measured, names, F.col("host"), limit)
    joined = join_hot(measured, hosts.select("host", "texts", "rejected"), "host", "texts")
    failed = breaks(names)["base"]
    return joined.select(F.col("id").alias(id_col), *[F.col(names[m]).alias(m) for m in MEASURES], failed.alias("base_failed"),
                         (~failed & ~F.col("rejected")).alias("kept"), F.col("rejected").alias("host_rejected"))


def drop_low_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with the same columns."""
    host, texts, rejected = fresh(docs, "host", "texts", "rejected")
    measured, names = measure(docs.withColumn(host, _host(host_col)), text_col)
    hosts = host_verdicts(measured.select(host, *names.values()), names, F.col(host), limit)
    hosts = hosts.select(F.col("host").alias(host), F.col("texts").alias(texts), F.col("rejected").alias(rejected))
    return join_hot(measured, hosts, host, texts).where(~breaks(names)["base"] & ~F.col(rejected)).select(*[F.col(f"`{c}`") for c in docs.columns])
