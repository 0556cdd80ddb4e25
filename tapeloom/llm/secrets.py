"""Secret scans by corpus-wide ownership, in DataFrame functions only.

Fixed patterns find candidate credentials and their positions in every whole
text. Each candidate's value is hashed, and the distinct owners and
repositories that hold it are counted over the corpus: a value seen under many
owners, or in many repositories of one owner, is a widely copied example; one
that belongs to few of both looks live.
A broader pattern for random-looking tokens adds spans, but only for values
that ownership says are live.

Positions come from pairing the pieces between matches (``split``) with the
matches (``regexp_extract_all``): lengths in code points, added up by a window
over the pieces of a row. Whether an added candidate touches a base span is
told by running ends over the row's sorted spans. So the work grows with the
text and its matches, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh, materialize

#: Base patterns and least lengths (fixed values of the contract), in order of precedence at equal starts.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
#: Added by the method: long tokens with letters and digits mixed, if their owners are few.
OWNED = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value's rows are joined in this many parts, so that one value of a third of all rows is not one task's.
SALTS = 16
#: Without one of these no pattern can match; one pass spares most texts the others.
_MAYBE = r"(?i:passw|secret|token|api_?key)|AKIA|[A-Za-z0-9_-]{16}"
_PIECES = "array<struct<rank:int,k:int,gap:int,hit:int,value:string>>"
_COVER = "array<struct<start:int,end:int>>"
_SPANS = "array<struct<start:int,rank:int,end:int,live:boolean>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` holds lambdas."""
    return F.transform(F.array(value), use)[0]


def _pieces(text: Column) -> Column:
    """Of every pattern, its matches in order: kind, number, lengths of the gap before it and of itself, hashed value (null: fails)."""
    def of(rank: int, pattern: str, value, keep) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        both = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))
        return _let(both, lambda b: F.transform(F.arrays_zip(F.slice(b["gaps"], 1, F.size(b["hits"])).alias("gap"), b["hits"].alias("hit")), lambda p, k: F.struct(
            F.lit(rank).alias("rank"), k.alias("k"), F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"),
            F.when(keep(value(p["hit"])), F.sha2(value(p["hit"]), 256)).alias("value"))))

    whole, every = (lambda h: h), (lambda v: F.lit(True))
    return F.concat(of(0, ASSIGN, lambda h: F.regexp_extract(h, ASSIGN, 1), lambda v: F.length(v) >= ASSIGN_VALUE),
                    of(1, ACCESS, whole, every), of(2, HEX, whole, every),
                    of(3, OWNED, whole, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")))


def find_candidates(rows: DataFrame, row: str, pieces: str) -> DataFrame:
    """(row, start, rank, end, value) of all candidates, from each row's ``_pieces``: base matches, and added ones that touch none."""
    each = rows.select(row, F.explode(pieces).alias("p")).select(row, "p.*")
    so_far = Window.partitionBy(row, "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (each.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far).cast("int")).where(F.col("value").isNotNull())
              .select(row, (F.col("end") - F.col("hit")).alias("start"), "rank", "end", "value"))
    # no match is empty, so the greatest base end among starts up to a candidate's own decides the left side, the least later base start the
    # right; a running minimum from the back, as a frame that ends at the last row is worked out anew for every row
    def running(order):
        return order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    base, by_row = F.col("rank") < 3, Window.partitionBy(row)
    before = F.max(F.when(base, F.col("end"))).over(running(by_row.orderBy("start", F.col("rank") == 3)))
    after = F.min(F.when(base, F.col("start"))).over(running(by_row.orderBy(F.desc("start"), "rank")))
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return placed.withColumn("touched", touched).where(base | ~F.col("touched")).drop("touched")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id",
                 max_owners: int = 2, keep: tuple[str, ...] = (), out_col: str = "spans", max_repositories: int = 8, cover_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, the columns in ``keep``, ``out_col`` and, if named, ``cover_col``.

    ``out_col``: array<struct<start, rank, end, live>>, by start, then kind: the
    base matches (rank 0 to 2: assign, access, hex), each with whether its
    value looks live, and the added ones (rank 3), which are all live. A value
    is live if at most ``max_owners`` distinct owners hold it, in at most
    ``max_repositories`` distinct repositories over all owners; a null owner or
    repository counts as one of its own. Values travel as hashes, never as text.
    ``cover_col``: array<struct<start, end>> of the stretches that live spans
    cover, in order; overlapping spans make one stretch.

    Null text counts as empty. Repeated rows give repeated results. Other
    columns are not carried, so their names cannot clash.
    """
    rid, owner, repo, pieces, judged_spans, covered = fresh(docs, "row", "owner", "repository", "pieces", "judged", "covered")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = [F.col(id_col), *[F.col(c) for c in keep if c != id_col]]
    rows = materialize(docs.select(
        *out, F.monotonically_increasing_id().alias(rid),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\u0000")).alias(owner),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("\u0000")).alias(repo),
        F.when(text.rlike(_MAYBE), _pieces(text)).otherwise(F.array().cast(_PIECES)).alias(pieces)), "secret-pieces")
    some, none = rows.where(F.size(pieces) > 0), F.array().cast(_SPANS)

    # what a row's owner and repository are is joined after the windows, by the same key and without another shuffle
    each = materialize(find_candidates(some, rid, pieces).join(some.select(rid, owner, repo), rid)
                       .select(F.col(rid).alias("row"), F.col(owner).alias("owner"), F.col(repo).alias("repo"), "start", "rank", "end", "value"), "secret-candidates")
    # distinct by shuffles, so that a value's repositories are never a list; a repository is one within its owner
    live = (each.select("value", "owner", "repo").distinct()
            .groupBy("value", "owner").agg(F.count("*").alias("repositories"))
            .groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
            .where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
            .select("value", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("live")))
    marked = (each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(live, ["value", "salt"], "left")
              .withColumn("live", F.coalesce("live", F.lit(False))).where("rank < 3 or live"))
    order = Window.partitionBy("row").orderBy("start", "rank")
    held = F.max(F.when(F.col("live"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("live") & (F.col("start") >= F.coalesce(held, F.lit(0)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stretches = (marked.withColumn("opens", opens).withColumn("stretch", F.sum(F.col("opens").cast("long")).over(upto))
                 .withColumn("until", F.max(F.when(F.col("live"), F.col("end"))).over(Window.partitionBy("row", "stretch"))))
    judged = stretches.groupBy(F.col("row").alias(rid)).agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "live"))).alias(judged_spans),
        F.array_sort(F.collect_list(F.when(F.col("opens"), F.struct(F.col("start"), F.col("until").alias("end"))))).alias(covered))
    no_cover = F.array().cast(_COVER)
    found = some.join(judged, rid, "left")

    def shown(spans: Column, cover: Column) -> list[Column]:
        return [*out, spans.alias(out_col), *([cover.alias(cover_col)] if cover_col else [])]

    return (rows.where(F.size(pieces) == 0).select(*shown(none, no_cover))
            .unionByName(found.select(*shown(F.coalesce(judged_spans, none), F.coalesce(covered, no_cover)))))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of the parts that a text is cut into, so that a span is found without counting from the text's start.
_PART = 1024


def redact(text: Column, cover: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch of ``cover`` replaced by ``mark``."""
    def between(parts: Column, start: Column, end: Column) -> Column:
        """The characters from ``start`` up to ``end``; touches only the parts that they lie in."""
        first, last = F.floor(start / _PART).cast("int"), F.floor((end - 1) / _PART).cast("int")
        some = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(some, start - first * _PART + 1, end - start)).otherwise(F.lit(""))

    def cut(b: Column) -> Column:
        stops = F.concat(F.array(F.lit(0)), F.transform(b["cover"], lambda s: s["end"]))
        kept = F.transform(F.arrays_zip(F.slice(stops, 1, F.size(b["cover"])).alias("from"), b["cover"].alias("s")),
                           lambda z: F.concat(between(b["parts"], z["from"], z["s"]["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), between(b["parts"], F.element_at(stops, -1), b["chars"]))

    parts = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % _PART), F.lit(0))
    whole = F.struct(parts.alias("parts"), cover.alias("cover"), F.length(text).alias("chars"))
    return F.when(F.size(cover) == 0, text).otherwise(_let(whole, cut))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 2,
                   length_col: str | None = "n_chars", max_repositories: int = 8) -> DataFrame:
    """``docs`` with live-looking secrets replaced in the text; the same rows and columns.

    ``length_col``, if present, is set to the new length where the text changed.
    """
    new, spans, cover = fresh(docs, "clean", "spans", "cover")
    scanned = scan_secrets(docs, id_col, text_col, owner_col, id_col, max_owners, tuple(docs.columns), spans, max_repositories, cover)
    clean = redact(F.col(text_col), F.col(cover))
    scanned = scanned.withColumn(new, clean)
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col(new).alias(c))
        elif length_col and c == length_col:
            changed = F.col(new) != F.col(text_col)
            out.append(F.when(changed, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return scanned.select(*out)
