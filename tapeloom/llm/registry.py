"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.session import ship_package
from tapeloom.llm import chat, decontamination, html_text, langid, neighbours, packing, periodic, quality, secrets, simhash, toxicity, turn_repair, urls
from tapeloom.llm.common import crc_fold, in_fold

#: Bytes handed to a Python worker at once (or one longer row); bounds its memory for long texts.
ARROW_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors; lower the session's bytes a batch to ``ARROW_BYTES`` where they are more."""
    ship_package(spark)
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not now.isdecimal() and not now.endswith("b") or not 0 < int(now.rstrip("b")) <= ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train_langid(docs, crc_fold("doc_id", 4) != 2)
    return langid.detect_language(docs, model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


#: The rules that op2 is given.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def n(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                          F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"),
                          F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), byte_bpe_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"), crc_fold("doc_id", 5) != 0)
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages")).select("page_id", "text")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: The conversation that op10 adds to the table: its text holds the template's own control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return chat.read_back_turns(chat.format_turns(rows.unionByName(extra)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic.find_runs(read(spark, sf_dir, "documents"), "doc_id", periodic.plant_period(F.col("text"), seed))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
                        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return turn_repair.repair_digests(turn_repair.damage(rows), rows.schema["conv_id"].dataType.simpleString())


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read(spark, sf_dir, "documents"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_html_text": op6_html_text,
    "op7_neighbours": op7_neighbours,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_turn_repair": op12_turn_repair,
    "op13_quality_rules": op13_quality_rules,
}

def secrets_sql() -> str:
    """op3 in SQL: positions from the lengths of what stands between the matches."""
    def matches(kind: int, pattern: str, value: str, keep: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
SELECT rid, doc_id, owner, {kind} AS rank, pos AS start, pos + length(hit) AS stop, {value} AS value FROM (
  SELECT rid, doc_id, owner, hits[k] AS hit,
    list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS pos
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (
    SELECT rid, doc_id, owner, regexp_extract_all(text, '{quoted}') AS hits, string_split_regex(text, '{quoted}') AS gaps FROM docs)))
WHERE {keep}"""

    assign = "regexp_extract(hit, '" + secrets.ASSIGN.replace("'", "''") + "', 1)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS owner FROM documents),
base AS ({matches(0, secrets.ASSIGN, assign, f"length({assign}) >= {secrets.ASSIGN_VALUE}")}
UNION ALL {matches(1, secrets.ACCESS, "hit", "true")}
UNION ALL {matches(2, secrets.HEX, "hit", "true")}),
more AS ({matches(3, secrets.OWNED, "hit", "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')")}),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.rid = m.rid AND b.start < m.stop AND m.start < b.stop)),
owned AS (SELECT value, count(DISTINCT owner) <= 2 AND count(DISTINCT (owner, doc_id)) <= 8 AS few FROM spans GROUP BY value),
judged AS (SELECT s.*, o.few AS live, ['assign', 'access', 'hex', 'owned'][rank + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS shown
  FROM spans s JOIN owned o USING (value) WHERE rank < 3 OR o.few),
found AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(shown, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(shown, ',' ORDER BY start, rank) AS spans, count(*) FILTER (live) AS n_live
  FROM judged GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM docs d LEFT JOIN found f USING (rid)
"""


def quality_sql() -> str:
    """op13 in SQL: windows as rows, host rates by the same moments."""
    rules = {"base": "base_failed", "symbols": "10 * n_symbols > word_chars", "lines": "10 * n_dup_lines > 3 * n_lines"}
    sums = ", ".join(f"CAST(sum(CAST({x} AS INT)) AS DOUBLE) AS {r}" for r, x in rules.items())
    moments = ", ".join(f"""sum({r}) / sum(texts) AS m_{r}, CASE WHEN sum(texts) - sum(texts * texts) / sum(texts) > 0 THEN
  (sum({r} * {r} / texts) - sum({r}) * (sum({r}) / sum(texts)) - (count(*) - 1) * (sum({r}) / sum(texts)) * (1 - sum({r}) / sum(texts)))
  / (sum(texts) - sum(texts * texts) / sum(texts)) ELSE 0 END AS v_{r}""" for r in rules)
    strength = ", ".join(f"m_{r} AS mean_{r}, CASE WHEN v_{r} > 0 THEN greatest({quality.LOOSEST}, least({quality.FIRMEST}, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE {quality.FIRMEST} END AS s_{r}" for r in rules)
    rates = ", ".join(f"({r} + mean_{r} * s_{r} + 0.5) / (texts + s_{r} + 1)" for r in rules)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS host FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM split)),
marked AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows),
covered AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM marked WHERE n > 1) GROUP BY rid),
measured AS (SELECT doc_id, host, len(s.words) AS n_words, CAST(length(array_to_string(s.words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
  CAST(coalesce(c.words, 0) AS BIGINT) AS n_repeat_words FROM split s LEFT JOIN covered c USING (rid)),
judged AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
hosts AS (SELECT host, CAST(count(*) AS DOUBLE) AS texts, {sums} FROM judged GROUP BY host),
firm AS (SELECT {strength} FROM (SELECT {moments} FROM hosts)),
verdicts AS (SELECT host, greatest({rates}) > 0.5 AS rejected FROM hosts, firm)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept, rejected AS host_rejected
FROM judged JOIN verdicts USING (host)
"""


#: DuckDB SQL for the operators that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op10_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), ':', '\c'), chr(10), '\n')) AS role_chars,
    CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR starts_with(text, '\~')
      THEN 2 + length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l')) ELSE length(text) END AS text_chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(4 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op3_secret_scan": secrets_sql(),
    "op13_quality_rules": quality_sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return run

    return {name: wrap(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
