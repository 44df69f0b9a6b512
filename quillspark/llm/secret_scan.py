"""Operator 6: secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Matches of a pattern and the text between them come from two built-in functions; running sums of their lengths are
the places of the matches, in code points. Every candidate value is hashed and counted over the corpus by distinct
repositories and owners: a value that several owners hold, none of them most of its repositories, is a copied example;
any other looks live, in however many repositories of its owner it lies. Generic tokens that no rule names are
reported only if they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import common

#: Kinds in the order that decides ties: pattern, and the group that holds the value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}"
#: Generic tokens: long runs with a digit, a small and a capital letter.
GENERIC = r"[A-Za-z0-9_+/-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
LEAST_VALUE = 12
#: A value that so many owners hold is a copied example, unless one of them has more than half of its repositories.
COPIED_OWNERS = 3
MATCH = "struct<kind:int,nth:int,gap:int,n:int,value:string>"
SPAN = "struct<start:int,kind:int,end:int,n_owners:bigint,n_repositories:bigint,most_of_one:bigint>"


def matches(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Every leftmost match that does not overlap one before it: its number, the code points between it and the one
    before, its length and its value."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(whole.alias("whole"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), values.alias("value"))
    found = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("n"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{MATCH}>"))


def candidates(found: DataFrame) -> DataFrame:
    """Spans (start, end, kind, value) of the matches of each row, places by running sums: base ones of sufficient
    length, and mixed generic tokens that no base span overlaps."""
    each = found.select("row", "repository", "owner", F.explode("matches").alias("m")).select("row", "repository", "owner", "m.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("nth")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before).cast("int")).withColumn("start", F.col("end") - F.col("n"))
    value = F.col("value")
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    kept = placed.where(F.when(F.col("kind") == 0, F.length("value") >= LEAST_VALUE).when(F.col("kind") == 3, mixed).otherwise(True))
    base = F.col("kind") < 3  # both windows grow row by row: a frame that shrinks would cost the square of the spans
    left = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start"))
    right = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start")))
    ruled = kept.withColumns({"left": left, "right": right})
    apart = ~(F.coalesce(F.col("left") > F.col("start"), F.lit(False)) | F.coalesce(F.col("right") < F.col("end"), F.lit(False)))
    return ruled.where(base | apart).select("row", "repository", "owner", "start", "kind", "end", F.sha2("value", 256).alias("value_hash"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value_hash, and the most repositories of one owner. candidates: value_hash, repository, owner. Nulls count as
    a repository or owner of their own. Each step aggregates before its shuffle, so that a value in a third of all
    documents reaches a task as one row from each other task."""
    repositories = candidates.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = repositories.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.max("repositories").alias("most_of_one"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Secrets of every document.

    docs: doc_id, text and the columns named; other columns are ignored. A null or empty text has no spans; rows
    that share a doc_id are texts of their own. Returns for each row doc_id, text_hash (xxhash64 of the text), the
    base spans, all spans (base ones and generic tokens that look live), each sorted by start, then kind, with the
    numbers of owners and repositories that hold its value and the most of one owner, and how many of all spans are live-looking or copied.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(matches(text, ASSIGN, 2, 0), matches(text, ACCESS, 0, 1), matches(text, HEX, 0, 2), matches(text, GENERIC, 0, 3))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), found.alias("matches"))
    found = common.materialise(found.withColumn("row", F.monotonically_increasing_id()))
    spans = common.materialise(candidates(found))
    live = (F.col("n_owners") < COPIED_OWNERS) | (2 * F.col("most_of_one") > F.col("n_repositories"))
    judged = spans.join(ownership(spans), "value_hash").where((F.col("kind") < 3) | live)
    span = F.struct("start", "kind", "end", "n_owners", "n_repositories", "most_of_one")
    gathered = judged.groupBy("row").agg(F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied"), F.array_sort(F.collect_list(span)).alias("all"))
    every = F.coalesce("all", F.array().cast(f"array<{SPAN}>"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("row", "doc_id", "text_hash").join(gathered, "row", "left").select("doc_id", "text_hash", F.filter(every, lambda x: x["kind"] < 3).alias("base"), every.alias("all"), zero("n_live"), zero("n_copied"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Put a mark in place of every span that the scan reports (overlapping spans: one mark); n_chars follows. The
    columns stay as they are; a text without spans, a null one too, is unchanged."""
    key, own, cuts = (common.fresh(docs, c) for c in ("span_id", "span_hash", "span_cuts"))
    each = scan(docs).where(F.size("all") > 0).select("doc_id", "text_hash", "all").dropDuplicates(["doc_id", "text_hash"])
    # Spans sorted by start: one that begins before an earlier one ends is covered by the mark of that one.
    spans = each.select("doc_id", "text_hash", F.posexplode("all").alias("nth", "x")).select("doc_id", "text_hash", "nth", "x.start", "x.end")
    ahead = Window.partitionBy("doc_id", "text_hash").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("until", F.coalesce(F.max("end").over(ahead), F.lit(0)))
    lead = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("until"), F.struct("start", "until")))).alias(cuts), F.max("end").alias("last"))
    lead = lead.select(F.col("doc_id").alias(key), F.col("text_hash").alias(own), F.struct(F.col(cuts).alias("cuts"), "last").alias(cuts))
    met = docs.join(lead, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(own)), "left")
    kept = F.transform(F.col(cuts)["cuts"], lambda x: F.substring(F.col("text"), x["until"] + 1, x["start"] - x["until"]))
    cleaned = F.array_join(F.concat(kept, F.array(F.substring(F.col("text"), F.col(cuts)["last"] + 1, F.length("text")))), mark)
    text = F.when(F.col(cuts).isNotNull(), cleaned).otherwise(F.col("text"))
    size = F.when(F.col(cuts).isNotNull(), F.length(cleaned).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return met.select(*(text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_live", "n_copied")


def _sql_matches(pattern: str, group: int, kind: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, w.i AS i, w.whole AS whole, v AS value,
      CAST(list_sum(list_transform(gaps[1:w.i], lambda g: length(g))) + COALESCE(list_sum(list_transform(wholes[1:w.i - 1], lambda g: length(g))), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS wholes, regexp_extract_all(t, '{quoted}', {group}) AS vals
          FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents) WHERE regexp_matches(t, '{quoted}')) d,
      LATERAL (SELECT unnest(range(1, len(wholes) + 1)) AS i, unnest(wholes) AS whole, unnest(vals) AS v) w"""


ORACLE_SQL = f"""
WITH found AS (
  SELECT doc_id, kind, start, start + length(whole) AS stop, value FROM (
    {_sql_matches(ASSIGN, 2, 0)} UNION ALL {_sql_matches(ACCESS, 0, 1)} UNION ALL {_sql_matches(HEX, 0, 2)} UNION ALL {_sql_matches(GENERIC, 0, 3)})
  WHERE CASE kind WHEN 0 THEN length(value) >= {LEAST_VALUE} WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') ELSE TRUE END
), apart AS (
  SELECT f.* FROM found f WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = f.doc_id AND b.kind < 3 AND b.start < f.stop AND f.start < b.stop)
), owned AS (
  SELECT value, COUNT(*) >= {COPIED_OWNERS} AND 2 * MAX(n) <= SUM(n) AS copied FROM (
    SELECT value, COALESCE(d.source, chr(1)) AS owner, COUNT(DISTINCT doc_id) AS n FROM apart a JOIN documents d USING (doc_id) GROUP BY ALL) GROUP BY value
), spans AS (
  SELECT a.*, copied, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS span FROM apart a JOIN owned USING (value) WHERE kind < 3 OR NOT copied
), per AS (
  SELECT doc_id, COUNT(*) FILTER (kind = 0) AS n_assign, COUNT(*) FILTER (kind = 1) AS n_access, COUNT(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
    COUNT(*) FILTER (NOT copied) AS n_live, COUNT(*) FILTER (copied) AS n_copied
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256,
  COALESCE(spans, '') AS spans, COALESCE(n_live, 0) AS n_live, COALESCE(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN per USING (doc_id)"""
