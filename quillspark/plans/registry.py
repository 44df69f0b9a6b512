"""The library's queries by name, with the SQL that gives the same rows (the id of the inventory stands in each comment)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates, identifiers, names, text
from quillspark.operators import classify as C
from quillspark.operators import dedupe, enrich, extract, validate
from quillspark.operators import library as L
from quillspark.plans.library import RECORDS_SQL, records
from quillspark.render import families, template
from quillspark.sinks import write
from quillspark.sources import parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; SQL may read the records as `rec`."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            recursive, sql_ = sql.startswith("RECURSIVE "), sql.removeprefix("RECURSIVE ")
            reads = sql_.startswith(",") or "FROM rec" in sql_
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{RECORDS_SQL} {sql_}" if reads else sql_
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


def _name(n: Column) -> Column:
    return F.concat_ws("/", F.coalesce(n["family"], F.lit("")), F.coalesce(n["given"], F.lit("")), F.coalesce(n["non_dropping_particle"], F.lit("")), F.coalesce(n["suffix"], F.lit("")), F.coalesce(n["literal"], F.lit("")))


def _day(d: Column) -> Column:
    return F.array_join(F.transform(dates.parts_of(d), lambda p: p.cast("string")), "-")


# Filters, orders, pages, counts.
@query("flt1_default_project", "SELECT id FROM rec WHERE project IS NULL OR project = 'default'")
def _(s, d):
    return records(s, d).where(L.in_project("default")).select("id")


@query("flt2_search", "SELECT id, title FROM rec WHERE contains(lower(title), 'tion') OR contains(lower(COALESCE(DOI, '')), 'tion') OR contains(replace(type, '-', ' '), 'tion') OR contains(lower(COALESCE(container_title, '')), 'tion') OR contains(lower(keyword), 'tion') OR contains(COALESCE(notes, ''), 'tion') OR (NOT is_group AND (len(list_filter(families, lambda x: contains(lower(x), 'tion'))) > 0 OR len(list_filter(givens, lambda x: contains(lower(x), 'tion'))) > 0)) OR len(list_filter(tags, lambda x: contains(lower(x), 'tion'))) > 0")
def _(s, d):
    return records(s, d).where(L.matches("TION")).select("id", "title")


@query("flt3_chips", "SELECT id FROM rec WHERE starred AND type = 'book'")
def _(s, d):
    return records(s, d).where(L.chips("starred", "book")).select("id")


@query("flt4_tags", "SELECT id FROM rec WHERE list_contains(tags, 'good') AND list_contains(tags, 't2')")
def _(s, d):
    return records(s, d).where(L.has_tags("good", "t2")).select("id")


@query("flt5_export_scope", "SELECT id FROM rec WHERE project = 'src3' AND type = 'thesis'")
def _(s, d):
    return L.export_scope(records(s, d), "thesis", "src3").select("id")


@query("flt6_quick_search", "SELECT id FROM rec WHERE contains(lower(title), 'ro') OR (NOT is_group AND len(list_filter(families, lambda x: contains(lower(x), 'ro'))) > 0) ORDER BY _seq LIMIT 5")
def _(s, d):
    return L.quick_search(records(s, d), "ro").select("id")


for _key, _sql in {
    "date-desc": "date_added DESC", "year-desc": "COALESCE(year, 0) DESC", "year-asc": "COALESCE(year, 9999)", "type": "type", "title-asc": "lower(title)",
    "author-asc": "lower(CASE WHEN len(families) > 0 THEN families[1] ELSE 'zzz' END)",
}.items():

    @query(f"srt1_{_key.replace('-', '_')}", f"SELECT id, _seq FROM rec ORDER BY {_sql}, _seq LIMIT 50 OFFSET 50")
    def _(s, d, key=_key):
        return L.page(records(s, d), key, 2).select("id", "_seq")


@query("agg1_counts", "SELECT COUNT(*) FILTER (starred) AS n_found, COUNT(*) AS n_total FROM rec")
def _(s, d):
    return L.counts(records(s, d), F.col("_starred"))


@query("agg2_affected", "SELECT COUNT(*) AS n_affected FROM rec WHERE project = 'src1'")
def _(s, d):
    return L.affected_by(records(s, d), "src1")


@query("agg8_badge", "SELECT CASE WHEN COUNT(*) = 0 THEN '' WHEN COUNT(*) > 999 THEN '999+' ELSE CAST(COUNT(*) AS VARCHAR) END AS badge FROM rec")
def _(s, d):
    return L.badge(records(s, d))


@query("prj6_summary", "SELECT id, array_to_string(families, ', ') AS authors, CAST(year AS VARCHAR) AS year, replace(type, '-', ' ') AS type_label FROM rec")
def _(s, d):
    return L.summary(records(s, d)).withColumn("year", F.col("year").cast("string"))


def _styles(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select("p_name", "p_type", "p_brand").distinct().select(F.concat_ws("-", "p_name", "p_brand").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("group"), F.col("p_brand").alias("field"))


_STYLES = "styles AS (SELECT DISTINCT p_name || '-' || p_brand AS id, p_name AS name, p_type AS grp, p_brand AS field FROM part)"


@query("agg3_styles_by_group", f"WITH {_STYLES} SELECT grp AS \"group\", string_agg(name, '|' ORDER BY name) AS names, COUNT(*) AS n FROM styles GROUP BY grp")
def _(s, d):
    return L.styles_by_group(_styles(s, d))


@query("flt7_style_search", f"WITH {_STYLES} SELECT id, name FROM styles WHERE contains(lower(name), 'a') AND contains(lower(name), 'e') AND (contains(lower(id), '3') OR contains(lower(grp), 'std'))")
def _(s, d):
    found = L.search_styles(L.search_styles(_styles(s, d), "A", ("name",)), "e", ("name",))
    return found.where(F.lower("id").contains("3") | F.lower("group").contains("std")).select("id", "name")


def _tags(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("t"), "n_nationkey").alias("name"), F.concat(F.lit("#"), "n_name").alias("color"), F.col("n_name").alias("id"))


@query("jn4_tag_colours", "SELECT id, u.tag AS tag, COALESCE('#' || n_name, '#71717a') AS color FROM (SELECT id, unnest(tags) AS tag FROM rec) u LEFT JOIN (SELECT 't' || n_nationkey AS tag, n_name  FROM nation) c ON c.tag = u.tag")
def _(s, d):
    return L.tag_colours(records(s, d), _tags(s, d))


@query("mut8_new_tags", "SELECT name, color FROM (SELECT 't' || n_nationkey AS name, '#' || n_name AS color  FROM nation) UNION ALL SELECT DISTINCT tag, '#71717a' FROM (SELECT unnest(tags) AS tag FROM rec) WHERE tag NOT IN (SELECT 't' || n_nationkey  FROM nation)")
def _(s, d):
    return L.create_tags(_tags(s, d), records(s, d)).select("name", "color")


@query("jn5_project_names", "SELECT r.id, p.s_name AS project_name FROM rec r LEFT JOIN (SELECT 'src' || s_suppkey AS id, s_name FROM supplier) p ON p.id = COALESCE(r.project, 'default')")
def _(s, d):
    projects = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("src"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return L.project_names(records(s, d), projects).select("id", "project_name")


@query("jn9_missing_dois", "SELECT DOI FROM (SELECT '10.' || (1000 + o_orderkey % 60) || '/AB.' || (o_orderkey % 900) AS DOI FROM orders) o WHERE lower(DOI) NOT IN (SELECT lower(DOI) FROM rec WHERE DOI IS NOT NULL)")
def _(s, d):
    wanted = s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("10."), F.lit(1000) + F.col("o_orderkey") % 60, F.lit("/AB."), F.col("o_orderkey") % 900).alias("DOI"))
    return L.missing_dois(wanted, records(s, d))


@query("mut2_bulk_star", "SELECT id, starred OR n % 7 = 0 AS starred FROM rec")
def _(s, d):
    r = records(s, d)
    return L.star(r, r.where("_seq % 7 = 0").select("id"), True).select("id", F.col("_starred").alias("starred"))


@query("mut3_bulk_delete", "SELECT id FROM rec WHERE n % 7 <> 0")
def _(s, d):
    r = records(s, d)
    return L.selected(r, r.where("_seq % 7 = 0").select("id"), "left_anti").select("id")


@query("mut6_leave_project", "SELECT id, CASE WHEN project = 'src2' THEN 'default' ELSE project END AS project FROM rec")
def _(s, d):
    return L.leave_project(records(s, d), "src2").select("id", F.array_join("_projectIds", "|").alias("project"))


@query("snk9_upsert", "SELECT id, CASE WHEN n % 5 = 0 THEN title || '!' ELSE title END AS title FROM rec UNION ALL SELECT 'new' || n, title FROM rec WHERE n % 50 = 1")
def _(s, d):
    r = records(s, d).select("id", "_seq", "title")
    new = r.where("_seq % 5 = 0").withColumn("title", F.concat("title", F.lit("!"))).union(r.where("_seq % 50 = 1").withColumn("id", F.concat(F.lit("new"), "_seq")))
    return L.upsert(r, new).select("id", "title")


# Duplicates.
_K = "rk AS (SELECT id, _seq, lower(DOI) AS k1, regexp_replace(ISBN, '[-\\s]', '', 'g') AS k2, CASE WHEN length(regexp_replace(lower(title), '[^a-z0-9]', '', 'g')) > {m} THEN regexp_replace(lower(title), '[^a-z0-9]', '', 'g') END AS k3, URL AS k4 FROM rec)"


@query("jn1_find_duplicates", f", {_K.format(m=10)}, lib AS (SELECT * FROM rk WHERE _seq % 2 = 0), fresh AS (SELECT * FROM rk WHERE _seq % 2 = 1), hit AS (SELECT f.id, MIN(l._seq) AS s FROM fresh f JOIN (SELECT k1 AS k, 1 AS r, _seq FROM lib UNION ALL SELECT k2, 2, _seq FROM lib UNION ALL SELECT k3, 3, _seq FROM lib UNION ALL SELECT k4, 4, _seq FROM lib) l ON (l.r = 1 AND l.k = f.k1) OR (l.r = 2 AND l.k = f.k2) OR (l.r = 3 AND l.k = f.k3) OR (l.r = 4 AND l.k = f.k4) GROUP BY f.id) SELECT f.id, 'd' || s AS duplicate_of FROM fresh f LEFT JOIN hit USING (id)")
def _(s, d):
    r = records(s, d)
    return dedupe.find_duplicates(r.where("_seq % 2 = 1"), r.where("_seq % 2 = 0")).select("id", "duplicate_of")


@query("jn2_import_new", f", {_K.format(m=10)} SELECT id FROM rk f WHERE _seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM rk l WHERE l._seq % 2 = 0 AND l.k1 = f.k1) AND NOT EXISTS (SELECT 1 FROM rk l WHERE l._seq % 2 = 0 AND l.k2 = f.k2) AND NOT EXISTS (SELECT 1 FROM rk l WHERE l._seq % 2 = 0 AND l.k3 = f.k3)")
def _(s, d):
    r = records(s, d)
    return dedupe.import_new(r.where("_seq % 2 = 1"), r.where("_seq % 2 = 0")).select("id")


@query("jn3_pair_counts", f", {_K.format(m=15)} SELECT COUNT(*) FILTER (a.k1 = b.k1) AS same_doi, COUNT(*) FILTER (a.k2 = b.k2 AND NOT COALESCE(a.k1 = b.k1, FALSE)) AS same_isbn, COUNT(*) FILTER (a.k3 = b.k3 AND NOT COALESCE(a.k1 = b.k1, FALSE) AND NOT COALESCE(a.k2 = b.k2, FALSE)) AS same_title FROM rk a JOIN rk b ON a._seq < b._seq AND (a.k1 = b.k1 OR a.k2 = b.k2 OR a.k3 = b.k3)")
def _(s, d):
    return dedupe.pair_counts(records(s, d))


@query("jn3_duplicate_links", f", {_K.format(m=15)}, m AS (SELECT b.id, a._seq, CASE WHEN a.k1 = b.k1 THEN 1 WHEN a.k2 = b.k2 THEN 2 ELSE 3 END AS r FROM rk a JOIN rk b ON a._seq < b._seq AND (a.k1 = b.k1 OR a.k2 = b.k2 OR a.k3 = b.k3)) SELECT id, 'd' || MIN(_seq) AS first, CASE r WHEN 1 THEN 'Same DOI' WHEN 2 THEN 'Same ISBN' ELSE 'Same title' END AS reason FROM (SELECT *, MIN(r) OVER (PARTITION BY id) AS best FROM m) WHERE r = best GROUP BY id, r")
def _(s, d):
    return dedupe.duplicate_links(records(s, d))


_GROUPS = f""", {_K.format(m=15)},
keyed AS (SELECT _seq, 1 AS r, k1 AS k FROM rk UNION ALL SELECT _seq, 2, k2 FROM rk UNION ALL SELECT _seq, 3, k3 FROM rk),
hung AS (SELECT _seq AS a, MIN(_seq) OVER (PARTITION BY r, k) AS b FROM keyed WHERE k IS NOT NULL),
e AS (SELECT DISTINCT a, b FROM hung WHERE a <> b UNION SELECT DISTINCT b, a FROM hung WHERE a <> b),
reach AS (SELECT _seq AS a, _seq AS b FROM rk UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
grouped AS (SELECT rec.*, g AS grp FROM rec JOIN (SELECT a AS _seq, MIN(b) AS g FROM reach GROUP BY a) USING (_seq))"""


@query("agg4_groups", f"RECURSIVE {_GROUPS} SELECT grp AS \"group\", COUNT(*) AS n FROM grouped GROUP BY grp")
def _(s, d):
    return dedupe.groups(records(s, d)).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("agg4_record_groups", f"RECURSIVE {_GROUPS} SELECT id, grp AS \"group\" FROM grouped")
def _(s, d):
    return dedupe.groups(records(s, d))


_FILLED = " + ".join(f"CAST(({x}) AS INT)" for x in ("title <> ''", "n_authors > 0", "year IS NOT NULL", "container_title IS NOT NULL", "DOI IS NOT NULL", "URL IS NOT NULL"))


@query("agg5_fields_filled", "SELECT id, CAST((title <> '') AS INT) + CAST((n_authors > 0) AS INT) + CAST((year IS NOT NULL) AS INT) + CAST((container_title IS NOT NULL) AS INT) + CAST((DOI IS NOT NULL) AS INT) + CAST((URL IS NOT NULL) AS INT) AS filled FROM rec")
def _(s, d):
    return records(s, d).select("id", dedupe.fields_filled().alias("filled"))


@query("mut9_keep_one", f"RECURSIVE {_GROUPS} SELECT id FROM grouped QUALIFY ROW_NUMBER() OVER (PARTITION BY grp ORDER BY {_FILLED} DESC, _seq) = 1")
def _(s, d):
    return dedupe.keep_one(records(s, d), keep="fullest").select("id")


# Scalar functions.
@query("str11_title_key", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.title_key(F.col("text")).alias("key"))


@query("str3_clean_doi", r"""SELECT id, DOI AS printed, DOI AS linked, DOI AS slashed, trim(regexp_replace(regexp_replace(regexp_replace(DOI || '/' || title, '[?#].*$', ''), '[.,;:)\]}>]+$', ''), '/+$', '')) AS titled FROM rec""")
def _(s, d):
    r, clean = records(s, d), identifiers.clean_doi
    own = lambda *ends: clean(F.concat("DOI", *ends))
    return r.select(
        "id", own(F.regexp_extract("title", r"[.,;:)\]}>]*$", 0)).alias("printed"), own(F.lit("?lang="), "language", F.lit("#"), "keyword").alias("linked"), own(F.lit("//")).alias("slashed"), own(F.lit("/"), F.col("title")).alias("titled")
    )


def _isbn13() -> Column:
    """ISBN of a record with a digit more, so that it has 13."""
    return F.concat("ISBN", (F.col("_seq") % 10).cast("string"))


_IDENTIFIED = "CASE WHEN DOI IS NOT NULL THEN {} WHEN n % 3 = 0 THEN {} WHEN n % 5 = 0 THEN {} WHEN n % 7 = 0 THEN {} WHEN ISBN IS NOT NULL THEN {} END"
_DEPOSITED = "CASE WHEN n % 13 = 0 THEN {} ELSE {} END"


@query("str7_identify", f"""SELECT id, {_IDENTIFIED.format(_DEPOSITED.format("'arXiv'", "'DOI'"), "'arXiv'", "'PMID'", "'PMC'", "'ISBN'")} AS kind,
  {_IDENTIFIED.format(_DEPOSITED.format("'2303.' || (10000 + n % 9000)", "DOI"), "'2301.' || (10000 + n % 9000)", "CAST(1000000 + n AS VARCHAR)", "CAST(2000000 + n AS VARCHAR)", "replace(ISBN, '-', '') || (n % 10)")} AS found,
  {_IDENTIFIED.format(_DEPOSITED.format("'10.48550/arXiv.2303.' || (10000 + n % 9000)", "NULL"), "'10.48550/arXiv.2301.' || (10000 + n % 9000)", "NULL", "NULL", "NULL")} AS doi FROM rec""")
def _(s, d):
    r, n = records(s, d), F.col("_seq")
    number = F.lit(10000) + n % 9000
    deposited = F.when(n % 13 == 0, F.concat(F.lit("doi:10.48550/arXiv.2303."), number)).otherwise(F.concat(F.lit("https://doi.org/"), "DOI"))
    told = F.concat_ws(
        "; ", "title", F.when(F.col("DOI").isNotNull(), F.concat(deposited, F.lit("."))), F.when(n % 3 == 0, F.concat(F.lit("arXiv: 2301."), number)), F.when(n % 5 == 0, F.concat(F.lit("PMID: "), F.lit(1000000) + n)),
        F.when(n % 7 == 0, F.concat(F.lit("see PMC"), F.lit(2000000) + n)), F.concat(F.lit("ISBN "), _isbn13()),
    )
    found = identifiers.identify(told)
    return r.select("id", found["type"].alias("kind"), found["id"].alias("found"), found["doi"].alias("doi"))


@query("str8_doi_in_url", "SELECT id, CASE WHEN DOI IS NOT NULL THEN 'DOI' WHEN n % 8 = 3 THEN 'PMC' END AS kind, CASE WHEN DOI IS NULL THEN CASE WHEN n % 8 = 3 THEN 'PMC' || n END WHEN n % 5 = 3 THEN '10.1038/s' || n WHEN n % 5 = 4 THEN '10.48550/arXiv.2301.' || (10000 + n % 9000) ELSE DOI END AS found FROM rec")
def _(s, d):
    n, own = F.col("_seq"), F.col("DOI")
    url = (
        F.when(own.isNull(), F.when(n % 8 == 3, F.concat(F.lit("https://ncbi.nlm.nih.gov/pmc/articles/PMC"), n, F.lit("/pdf/"))).otherwise(F.concat(F.lit("https://example.org/"), "language")))
        .when(n % 5 == 0, F.concat(F.lit("https://doi.org/"), own, F.lit("?lang="), "language")).when(n % 5 == 1, F.concat(F.lit("https://onlinelibrary.wiley.com/doi/pdf/"), own, F.lit("#page=1")))
        .when(n % 5 == 2, F.concat(F.lit("https://www.sciencedirect.com/science?lang="), "language", F.lit("&doi="), own)).when(n % 5 == 3, F.concat(F.lit("https://www.nature.com/articles/s"), n, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("https://arxiv.org/pdf/2301."), F.lit(10000) + n % 9000))
    )
    r = records(s, d).select("id", identifiers.doi_in_url(url).alias("f"))
    return r.select("id", F.col("f.type").alias("kind"), F.col("f.id").alias("found"))


@query("str13_title_case", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_name || ' and THE ' || p_type, '\\s+'), lambda w: w <> ''), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('a','an','and','as','at','but','by','for','from','in','nor','of','on','or','the','to','up','with') THEN lower(w) ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ') AS title FROM part")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", text.title_case(F.concat("p_name", F.lit(" and THE "), "p_type")).alias("title"))


@query("str15_initials", "SELECT id, array_to_string(list_transform(givens, lambda g: array_to_string(list_transform(list_filter(string_split_regex(g, '[\\s.]+'), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || '.'), ' ')), '|') AS initials FROM rec")
def _(s, d):
    given = F.filter("author", lambda a: a["given"].isNotNull())
    return records(s, d).select("id", F.coalesce(_joined(F.transform(given, lambda a: text.initials(a["given"]))), F.lit("")).alias("initials"))


@query("str17_roman", "SELECT p_size, repeat('m', CAST(p_size // 1000 AS INT)) || (['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'])[CAST(p_size // 100 % 10 AS INT) + 1] || (['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'])[CAST(p_size // 10 % 10 AS INT) + 1] || (['','i','ii','iii','iv','v','vi','vii','viii','ix'])[CAST(p_size % 10 AS INT) + 1] AS roman FROM (SELECT DISTINCT p_size FROM part)")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_size").distinct().select("p_size", text.roman(F.col("p_size")).alias("roman"))


_STYLE_PARTS = ("plain", *(p for _, parts in text.FAMILIES for p in parts))


def _family_sql() -> str:
    each = " ".join(f"WHEN {' OR '.join(f'contains(t, {p!r})' for p in parts)} THEN '{family}'" for family, parts in text.FAMILIES)
    return f"SELECT p_partkey, CASE {each} ELSE 'apa' END AS family FROM (SELECT p_partkey, replace(lower(p_name), ' ', '-' || {list(_STYLE_PARTS)}[CAST(p_partkey % {len(_STYLE_PARTS)} AS INT) + 1] || '-') AS t FROM part)"


@query("str26_style_family", _family_sql())
def _(s, d):
    part = F.get(F.array(*map(F.lit, _STYLE_PARTS)), (F.col("p_partkey") % len(_STYLE_PARTS)).cast("int"))
    style = F.replace(F.initcap("p_name"), F.lit(" "), F.concat(F.lit("-"), part, F.lit("-")))
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", text.style_family(style).alias("family"))


@query("str12_title_similarity", "SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)), 6) AS similarity FROM (SELECT doc_id, list_distinct(string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', '', 'g'), '\\s+')) AS w FROM documents) a, LATERAL (SELECT list_distinct(string_split_regex(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\w\\s]', '', 'g'), '\\s+')) AS w FROM documents d WHERE d.doc_id = a.doc_id) b")
def _(s, d):
    return _docs(s, d).select("doc_id", F.round(text.title_similarity(F.col("text"), F.split("text", "\n")[0]), 6).alias("similarity"))


@query("dt3_dates", "SELECT id, CASE WHEN year IS NOT NULL THEN year || CASE WHEN month IS NOT NULL THEN '-' || month || CASE WHEN day IS NOT NULL THEN '-' || day ELSE '' END ELSE '' END END AS parts FROM rec")
def _(s, d):
    slashed = F.concat_ws("/", *(F.get(dates.parts_of(F.col("issued")), F.lit(i)).cast("string") for i in range(3)))
    return records(s, d).select("id", _day(dates.slash_date(slashed)).alias("parts"))


@query("dt8_check_date", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 6 THEN CASE WHEN l_returnflag = 'R' THEN 'no_date' ELSE 'invalid_year' END WHEN year(l_shipdate) > 1996 THEN 'future_year' WHEN month(l_shipdate) + l_linenumber > 12 THEN 'invalid_month' WHEN day(l_shipdate) + l_quantity::INT > 31 THEN 'invalid_day' END AS code, CASE WHEN year(l_shipdate) - 1995 < 1 THEN 'year_not_positive' END AS counted FROM lineitem")
def _(s, d):
    day = F.col("l_shipdate")
    whole = F.concat_ws("-", F.year(day), F.month(day) + F.col("l_linenumber"), F.dayofmonth(day) + F.col("l_quantity").cast("int"))
    told = F.when(F.col("l_linenumber") % 7 == 6, F.when(F.col("l_returnflag") == "R", "N.D.").otherwise(F.date_format(day, "MMMM yyyy"))).otherwise(whole)
    counted = F.greatest(F.year(day) - 1995, F.lit(0)).cast("string")
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", dates.check_date(told, 1991).alias("code"), dates.check_date(counted, 1991).alias("counted"))


# Rendering: six families.
_INITIALS = "array_to_string(list_transform(list_filter(string_split_regex(givens[i], '[\\s.]'), lambda w: w <> ''), lambda w: substr(w, 1, 1) || '.'), ' ')"


def _authors_sql(one: str, two: str, many: str) -> str:
    return f"CASE WHEN n_authors = 0 THEN '' WHEN is_group THEN families[1] WHEN n_authors = 1 THEN a[1] WHEN n_authors = 2 THEN a[1] || '{two}' || a[2] ELSE {many} END"


_ESC = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_ALL_BUT_LAST = "array_to_string(a[1:n_authors - 1], ', ') || ', & ' || a[n_authors]"
_SIX = {
    "apa": ("families[i] || ', ' || {i}", " & ", _ALL_BUT_LAST), "harvard": ("families[i] || ', ' || {i}", " and ", _ALL_BUT_LAST), "mla": ("families[i] || ', ' || givens[i]", ", and ", "a[1] || ', et al.'"), "chicago": ("families[i] || ', ' || givens[i]", " and ", _ALL_BUT_LAST),
    "ieee": ("{i} || ' ' || families[i]", " and ", _ALL_BUT_LAST), "vancouver": ("{i} || ' ' || families[i]", " and ", "CASE WHEN n_authors > 6 THEN array_to_string(a[1:6], ', ') || ', et al.' ELSE " + _ALL_BUT_LAST + " END"),
}


def _bib_sql(family: str) -> str:
    one, two, many = _SIX[family]
    own = f"b AS (SELECT *, CASE WHEN is_group OR n_authors = 0 THEN [] ELSE list_transform(range(1, n_authors + 1), lambda i: {one.format(i=_INITIALS)}) END AS a FROM rec)"
    e = lambda c: _ESC.format(c=c)
    cols = (
        f", {own}, c AS (SELECT id, type, {e(_authors_sql(one, two, many))} AS esc_a, {_authors_sql(one, two, many)} AS raw_a, COALESCE(CAST(year AS VARCHAR), 'n.d.') AS y, COALESCE(CAST(year AS VARCHAR), '') AS yy, {e('CASE WHEN title = chr(0) OR title = $$$$ THEN $$Untitled$$ ELSE title END')} AS t, "
        f"COALESCE(container_title, '') AS ct, COALESCE(volume, '') AS v, COALESCE(issue, '') AS i, COALESCE(replace(page, '-', '–'), '') AS p, {e('COALESCE(publisher, $$$$)')} AS pub, COALESCE(DOI, '') AS doi, COALESCE(URL, '') AS url, type = 'article-journal' AS journal FROM b)"
    )
    link = "CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE url END"
    j = lambda sep, *ps: f"array_to_string(list_filter([{', '.join(ps)}], lambda s: s <> ''), '{sep}')"
    opt = lambda c, shown: f"CASE WHEN {c} <> '' THEN {shown} ELSE '' END"
    who, pub = "CASE WHEN esc_a <> '' THEN esc_a ELSE 'Unknown' END", "CASE WHEN journal THEN '' ELSE pub END"
    if family == "apa":
        src = opt("ct", f"'<i>' || ct || '</i>' || {opt('v', chr(39) + ', <i>' + chr(39) + ' || v || ' + chr(39) + '</i>' + chr(39))} || {opt('i', chr(39) + '(' + chr(39) + ' || i || ' + chr(39) + ')' + chr(39))} || {opt('p', chr(39) + ', ' + chr(39) + ' || p')}")
        body = j(". ", "CASE WHEN esc_a <> '' THEN esc_a ELSE t END", "'(' || y || ')'", "CASE WHEN esc_a = '' THEN '' WHEN type IN ('book', 'report', 'thesis') THEN '<i>' || t || '</i>' ELSE t END", src, pub, link)
        out = f"replace(replace({body}, '..', '.'), '. .', '.') || '.'"
    elif family == "mla":
        place = j(", ", opt("v", "'vol. ' || v"), opt("i", "'no. ' || i"))
        body = j(", ", who, "CASE WHEN type = 'book' THEN '<i>' || t || '</i>' ELSE '“' || t || '.”' END", opt("ct", "'<i>' || ct || '</i>'"), place, pub, "yy", opt("p", "'pp. ' || p"), link)
        out = f"replace({body}, ',.', '.') || '.'"
    elif family == "chicago":
        src = opt("ct", f"'<i>' || ct || '</i>' || {opt('v', chr(39) + ' ' + chr(39) + ' || v')} || {opt('i', chr(39) + ', no. ' + chr(39) + ' || i')} || {opt('p', chr(39) + ': ' + chr(39) + ' || p')}")
        out = f"replace({j('. ', who, 'y', 'CASE WHEN type IN (' + chr(39) + 'book' + chr(39) + ', ' + chr(39) + 'thesis' + chr(39) + ') THEN ' + chr(39) + '<i>' + chr(39) + ' || t || ' + chr(39) + '</i>' + chr(39) + ' ELSE ' + chr(39) + '“' + chr(39) + ' || t || ' + chr(39) + '”' + chr(39) + ' END', src, 'pub', link)}, '..', '.') || '.'"
    elif family == "harvard":
        src = opt("ct", f"'<i>' || ct || '</i>' || {opt('v', chr(39) + ', ' + chr(39) + ' || v')} || {opt('i', chr(39) + '(' + chr(39) + ' || i || ' + chr(39) + ')' + chr(39))} || {opt('p', chr(39) + ', pp. ' + chr(39) + ' || p')}")
        body = j(". ", who, "'(' || y || ')'", "CASE WHEN type IN ('book', 'thesis') THEN '<i>' || t || '</i>' ELSE '‘' || t || '’' END", src, "pub", "CASE WHEN doi <> '' THEN 'doi:' || doi WHEN url <> '' THEN 'Available at: ' || url ELSE '' END")
        out = f"replace({body}, '..', '.') || '.'"
    elif family == "ieee":
        body = j(", ", "raw_a", "'“' || t || ',”'", opt("ct", "'<i>' || ct || '</i>'"), opt("v", "'vol. ' || v"), opt("i", "'no. ' || i"), opt("p", "'pp. ' || p"), "yy", opt("doi", "'doi: ' || doi"))
        out = f"'[1] ' || {body} || '.'"
    else:
        src = f"CASE WHEN ct <> '' THEN ct || '. ' || y || {opt('v', chr(39) + ';' + chr(39) + ' || v')} || {opt('i', chr(39) + '(' + chr(39) + ' || i || ' + chr(39) + ')' + chr(39))} || {opt('p', chr(39) + ':' + chr(39) + ' || p')} || '.' WHEN yy <> '' THEN yy || '.' ELSE '' END"
        out = f"'1. ' || {j(' ', 'raw_a || ' + chr(39) + '.' + chr(39), 't || ' + chr(39) + '.' + chr(39), src, opt('doi', chr(39) + 'doi: ' + chr(39) + ' || doi'))}"
    return f"{cols} SELECT id, {out} AS entry FROM c"


for _family in families.NAMES:

    @query(f"fmt1_{_family}", _bib_sql(_family))
    def _(s, d, family=_family):
        return parse.conform(records(s, d)).select("id", families.bibliography(family).alias("entry"))


_WHO = "CASE WHEN n_authors > 0 THEN families[1] WHEN title <> '' THEN array_to_string(string_split(title, ' ')[1:3], ' ') ELSE 'Unknown' END"


@query("fmt4_in_text", f"SELECT id, '(' || w || CASE WHEN n_authors >= 3 THEN ' et al.' WHEN n_authors = 2 THEN ' & ' || families[2] ELSE '' END || ', ' || y || ')' AS cited, w || CASE WHEN n_authors >= 3 THEN ' et al.' WHEN n_authors = 2 THEN ' & ' || families[2] ELSE '' END || ' (' || y || ')' AS narrative, '(' || w || CASE WHEN n_authors >= 3 THEN ' et al.' WHEN n_authors = 2 THEN ' and ' || families[2] ELSE '' END || ' ' || COALESCE(page, '') || ')' AS mla FROM (SELECT *, {_WHO} AS w, COALESCE(CAST(year AS VARCHAR), 'n.d.') AS y FROM rec)")
def _(s, d):
    return records(s, d).select("id", families.in_text("apa").alias("cited"), families.in_text("apa", True).alias("narrative"), families.in_text("mla").alias("mla"))


@query("fmt6_template", "SELECT id, regexp_replace(replace(replace(replace(CASE WHEN n_authors > 0 THEN families[1] ELSE '' END || ' (' || COALESCE(CAST(year AS VARCHAR), 'n.d.') || '). <i>' || id2 || '</i> ' || COALESCE(volume, '') || '(' || COALESCE(issue, '') || '), ' || COALESCE(page, '') || '.', '()', ''), ', ,', ','), '..', '.'), ',\\s*\\.', '.', 'g') AS shown FROM (SELECT *, COALESCE(container_title, 'x') AS id2 FROM rec)")
def _(s, d):
    r = records(s, d).withColumn("container_title", F.coalesce("container_title", F.lit("x")))
    return r.select("id", template.render("{author-short} ({year}). *{container}* {volume}({issue}), {page}.").alias("shown"))


# Validation and classification.
@query("val1_warnings", "SELECT id, array_to_string(list_filter([CASE WHEN type = 'article-journal' AND container_title IS NULL THEN 'journal-no-container' END, CASE WHEN type = 'article-journal' AND volume IS NULL AND issue IS NULL THEN 'journal-no-volume-issue' END, CASE WHEN type = 'article-journal' AND DOI IS NULL AND page IS NULL THEN 'journal-no-doi-pages' END, CASE WHEN type = 'book' AND publisher IS NULL THEN 'book-no-publisher' END, CASE WHEN type = 'book' AND container_title IS NOT NULL THEN 'book-has-container' END, CASE WHEN type = 'book' AND volume IS NOT NULL AND issue IS NOT NULL THEN 'book-volume-issue' END, CASE WHEN type = 'chapter' AND container_title IS NULL THEN 'chapter-no-container' END, CASE WHEN type = 'chapter' AND publisher IS NULL THEN 'chapter-no-publisher' END, CASE WHEN type = 'article-newspaper' AND container_title IS NULL THEN 'news-no-container' END, CASE WHEN type = 'article-newspaper' AND volume IS NOT NULL AND issue IS NOT NULL AND DOI IS NOT NULL THEN 'news-looks-journal' END, CASE WHEN type = 'thesis' AND publisher IS NULL THEN 'thesis-no-publisher' END, CASE WHEN type = 'thesis' AND container_title IS NOT NULL THEN 'thesis-has-container' END, CASE WHEN type = 'webpage' AND DOI IS NOT NULL AND container_title IS NOT NULL AND (volume IS NOT NULL OR issue IS NOT NULL) THEN 'webpage-looks-journal' END, CASE WHEN type = 'webpage' AND DOI IS NOT NULL AND container_title IS NOT NULL AND volume IS NULL AND issue IS NULL THEN 'webpage-may-be-journal' END], lambda w: w IS NOT NULL), '|') AS warnings, CASE WHEN (type = 'book' AND volume IS NOT NULL AND issue IS NOT NULL) OR (type = 'article-newspaper' AND volume IS NOT NULL AND issue IS NOT NULL AND DOI IS NOT NULL) OR (type = 'webpage' AND DOI IS NOT NULL AND container_title IS NOT NULL) THEN 'article-journal' WHEN type = 'article-journal' AND container_title IS NULL AND volume IS NULL AND issue IS NULL AND DOI IS NULL AND page IS NULL THEN 'webpage' END AS suggestion FROM rec")
def _(s, d):
    return records(s, d).select("id", _joined(validate.warnings()).alias("warnings"), validate.suggestion().alias("suggestion"))


def _missing_sql() -> str:
    lack = {"title": "title = ''", "author": "n_authors = 0", "issued": "year IS NULL"}
    rows = []
    for kind, (need, _) in validate._NEED.items():
        each = ", ".join(f"CASE WHEN {lack.get(f, f + ' IS NULL')} THEN '{f}' END" for f in need)
        rows.append(f"WHEN '{kind}' THEN concat_ws('|', {each})")
    return f"SELECT id, CASE type {' '.join(rows)} ELSE '' END AS missing FROM rec"


@query("val3_missing", _missing_sql())
def _(s, d):
    return records(s, d).select("id", _joined(validate.missing()).alias("missing"))


def _classify_sql(table: str, key: str, told: str) -> str:
    places = {k: i for i, k in enumerate(C.kinds())}
    quoted = lambda p: p.replace("'", "''")
    each = ", ".join("{'place': " + f"{i}, 'type': '{k}', 'score': " + " + ".join(f"CASE WHEN regexp_matches(t, '{quoted(p)}') THEN {w} ELSE 0 END" for t, w, p in C.RULES if t == k) + "}" for k, i in places.items())
    return f"""scored AS (SELECT {key}, unnest([{each}]) AS s FROM (SELECT {key}, {told} AS t FROM {table})),
  ranked AS (SELECT {key}, s.type AS kind, s.score AS score, row_number() OVER (PARTITION BY {key} ORDER BY s.score DESC, s.place) AS r, SUM(s.score) OVER (PARTITION BY {key}) AS total FROM scored WHERE s.score > 0)
SELECT d.{key}, COALESCE(max(kind) FILTER (r = 1), 'unknown') AS source_type, round(COALESCE(max(score) FILTER (r = 1) / max(total), 0), 6) AS confidence, COALESCE(string_agg(kind || ':' || score, ',' ORDER BY r) FILTER (r <= 5), '') AS ranked
FROM {table} d LEFT JOIN ranked USING ({key}) GROUP BY d.{key}"""


_TOLD_SQL = "concat_ws(', ', title, CASE type WHEN 'thesis' THEN 'a thesis for the PhD' WHEN 'webpage' THEN 'accessed ' || date_added END, container_title, 'vol. ' || volume, 'no. ' || issue, 'pp. ' || page, publisher, 'ISBN ' || ISBN || (n % 10), 'doi ' || DOI, URL, notes)"


@query("ext11_classify", ", " + _classify_sql("rec", "id", _TOLD_SQL))
def _(s, d):
    kind = F.when(F.col("type") == "thesis", "a thesis for the PhD").when(F.col("type") == "webpage", F.concat(F.lit("accessed "), "_dateAdded"))
    tell = lambda label, c: F.concat(F.lit(label), c)
    told = F.concat_ws(", ", "title", kind, "container_title", tell("vol. ", "volume"), tell("no. ", "issue"), tell("pp. ", "page"), "publisher", tell("ISBN ", _isbn13()), tell("doi ", "DOI"), "URL", "_notes")
    return C.classify(records(s, d).select("id", told.alias("text"))).select("id", "source_type", "confidence", "ranked")


@query("ext11_classify_documents", "WITH " + _classify_sql("documents", "doc_id", "COALESCE(text, '')"))
def _(s, d):
    return C.classify(_docs(s, d).select("doc_id", "text")).select("doc_id", "source_type", "confidence", "ranked")


# Pages.
@query("ext7_host_type", """SELECT page_id, CASE WHEN regexp_matches(host, '\\b(nytimes|washingtonpost|theguardian|reuters|apnews|cnn\\.com)\\b') THEN 'article-newspaper' WHEN contains(host, 'ssrn.com') THEN 'report' WHEN contains(host, 'arxiv.org') THEN 'article'
  WHEN regexp_matches(u, '/doi/(abs/|full/|pdf/)?10\\.[0-9]{4,}') THEN 'article-journal' WHEN regexp_matches(u, '/patent/|patents\\.') THEN 'patent' WHEN regexp_matches(u, '/thesis|/dissertation|/etd/') THEN 'thesis' WHEN regexp_matches(u, '/books?/|/isbn/|/works/') THEN 'book' END AS kind
FROM (SELECT page_id, lower(url) AS u, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)""")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", extract.host_type(F.col("url")).alias("kind"))


# Writers, readers and their round trips.
_BIB_NAME = "array_to_string(list_transform(range(1, len(givens) + 1), lambda i: families[i] || ', ' || givens[i]), ' and ')"


@query("snk1_bibtex", f"SELECT id, '@' || (['article', 'book', 'incollection', 'phdthesis', 'online', 'article'])[CAST(n % 6 AS INT) + 1] || '{{' || id || ',' || chr(10) || concat_ws(',' || chr(10), CASE WHEN is_group THEN '  author = {{{{' || families[1] || '}}}}' WHEN n_authors > 0 THEN '  author = {{' || {_BIB_NAME} || '}}' END, '  title = {{' || title || '}}', CASE WHEN container_title IS NOT NULL THEN CASE WHEN type = 'chapter' THEN '  booktitle = {{' ELSE '  journal = {{' END || container_title || '}}' END, '  year = {{' || year || '}}', '  month = ' || (['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'])[CAST(month AS INT)], '  volume = {{' || volume || '}}', '  number = {{' || issue || '}}', '  pages = {{' || page || '}}', '  publisher = {{' || publisher || '}}', '  doi = {{' || DOI || '}}', '  isbn = {{' || ISBN || '}}', '  url = {{' || URL || '}}', '  keywords = {{' || keyword || '}}', '  language = {{' || language || '}}') || chr(10) || '}}' AS entry FROM rec")
def _(s, d):
    return parse.conform(records(s, d)).select("id", write.bibtex().alias("entry"))


@query("snk2_ris", "SELECT id, concat_ws(chr(10), 'TY  - ' || (['JOUR', 'BOOK', 'CHAP', 'THES', 'ELEC', 'NEWS'])[CAST(n % 6 AS INT) + 1], CASE WHEN is_group THEN 'AU  - ' || families[1] WHEN n_authors > 0 THEN array_to_string(list_transform(range(1, len(givens) + 1), lambda i: 'AU  - ' || families[i] || ', ' || givens[i]), chr(10)) END, 'TI  - ' || title, CASE WHEN type = 'chapter' THEN 'BT  - ' ELSE 'JO  - ' END || container_title, 'PY  - ' || year || COALESCE('/' || lpad(CAST(month AS VARCHAR), 2, '0') || COALESCE('/' || lpad(CAST(day AS VARCHAR), 2, '0'), ''), ''), 'VL  - ' || volume, 'IS  - ' || issue, 'SP  - ' || split_part(page, '-', 1), 'EP  - ' || split_part(page, '-', 2), 'PB  - ' || publisher, 'DO  - ' || DOI, 'UR  - ' || URL, 'SN  - ' || ISBN, 'KW  - ' || split_part(keyword, ', ', 1), 'KW  - ' || split_part(keyword, ', ', 2), 'LA  - ' || language, 'ER  - ') AS entry FROM rec")
def _(s, d):
    return parse.conform(records(s, d)).select("id", write.ris().alias("entry"))


_Q = "CASE WHEN contains({c}, ',') OR contains({c}, chr(34)) OR contains({c}, chr(10)) THEN chr(34) || replace({c}, chr(34), chr(34) || chr(34)) || chr(34) ELSE {c} END"


@query("snk3_csv", f"SELECT id, type || ',' || {_Q.format(c='title')} || ',' || {_Q.format(c='people')} || ',' || COALESCE(CAST(year AS VARCHAR), '') || ',' || COALESCE(container_title, '') || ',' || COALESCE(volume, '') || ',' || COALESCE(issue, '') || ',' || COALESCE(page, '') || ',' || COALESCE(DOI, '') || ',' || COALESCE(URL, '') || ',' || COALESCE(publisher, '') || ',' || COALESCE(ISBN, '') || ',,,' || {_Q.format(c='keyword')} || ',' || language AS line FROM (SELECT *, CASE WHEN is_group THEN families[1] ELSE array_to_string(list_transform(range(1, len(givens) + 1), lambda i: families[i] || ', ' || givens[i]), '; ') END AS people FROM rec)")
def _(s, d):
    return parse.conform(records(s, d)).select("id", write.csv_row().alias("line"))


_BACK = """SELECT id, {title} AS title,
  CASE WHEN is_group THEN '////' || families[1] WHEN n_authors > 0 THEN
    array_to_string(list_transform(range(1, len(givens) + 1), lambda i: families[i] || '/' || givens[i] || '///'), '|') END AS people,
  CASE WHEN year IS NOT NULL THEN year || COALESCE('-' || month || {day}, '') END AS issued, volume, issue, {page} AS page, publisher, DOI, URL
FROM rec"""
_DASHED, _TEX = "replace(page, '-', '–')", "trim(replace(replace(title, '--', '–'), '~', ' '))"


def _written(s: SparkSession, d: str) -> DataFrame:
    return parse.conform(records(s, d))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "title", _joined(F.transform("author", _name)).alias("people"), F.nullif(_day(F.col("issued")), F.lit("")).alias("issued"), "volume", "issue", "page", "publisher", "DOI", "URL")


@query("src1_bibtex_round_trip", _BACK.format(title=_TEX, day="''", page=_DASHED))
def _(s, d):
    return _flat(parse.bibtex(_written(s, d).select(write.bibtex(True).alias("content"))))


@query("src2_ris_round_trip", _BACK.format(title="NULLIF(trim(title), '')", day="COALESCE('-' || day, '')", page=_DASHED))
def _(s, d):
    r = _written(s, d).select(F.col("id").alias("own"), F.concat(write.ris(), F.lit("\n")).alias("content"))
    return _flat(parse.ris(r).withColumn("id", F.col("own")))


@query("src3_json_round_trip", _BACK.format(title="title", day="COALESCE('-' || day, '')", page="page"))
def _(s, d):
    r = _written(s, d)
    return _flat(parse.csl_json(r.select(write.csl_json(r).alias("content"))))


_OF_LINE = "CASE WHEN regexp_matches(t, '^@') THEN 'bibtex' WHEN regexp_matches(t, '^[A-Z]{2}  -') THEN 'ris' WHEN regexp_matches(t, '^[\\[{]') THEN 'csljson' WHEN regexp_matches(t, '^<(\\?xml|xml|records)') THEN 'endnote' WHEN regexp_matches(t, '^PMID-') THEN 'medline' WHEN len(string_split(line, chr(9))) >= 3 THEN 'tsv' WHEN len(string_split(line, ',')) >= 3 THEN 'csv' ELSE 'text' END"


@query("src11_sniff", f"SELECT id, CASE WHEN k < 7 THEN (['bibtex', 'ris', 'csljson', 'endnote', 'medline', 'tsv', 'csv'])[k + 1] ELSE told END AS format FROM (SELECT 'd' || doc_id AS id, CAST(doc_id % 8 AS INT) AS k, {_OF_LINE} AS told FROM (SELECT doc_id, t, split_part(t, chr(10), 1) AS line FROM (SELECT doc_id, regexp_replace(COALESCE(text, ''), '^\\s+', '') AS t FROM documents)))")
def _(s, d):
    r, own = _written(s, d), _docs(s, d).select(F.concat(F.lit("d"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("own"), "doc_id")
    head = lambda sep: F.lit(sep.join(write.CSV_COLUMNS) + "\n")
    forms = (write.bibtex(), F.concat(F.lit("\n"), write.ris()), write.csl_json(r), F.concat(F.lit(write.WORD_HEAD + "\n"), write.word_source()), F.concat(F.lit("PMID- 7\nTI  - "), F.col("title")), F.concat(head("\t"), write.csv_row("\t")), F.concat(head(","), write.csv_row()))
    k = F.regexp_extract("id", r"\d+", 0).cast("long") % 8
    content = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        content = F.when(k == i, form).otherwise(content)
    written = r.select("id", content.alias("content"))
    return own.join(written, "id", "left").select("id", parse.sniff(F.when(F.col("doc_id") % 8 == 7, F.col("own")).otherwise(F.col("content"))).alias("format"))


_TOLD_IDS = "concat_ws(chr(10), text, 'See https://doi.org/' || DOI || '. Also ' || DOI || ', again.', CASE WHEN n % 5 = 0 THEN 'wrapped 10.2000/w-' || chr(10) || ' x' || n || ';' END, 'ISBN ' || substr(replace(ISBN, '-', ''), 1, 4) || '-1000-' || lpad(CAST(n % 10000 AS VARCHAR), 4, '0') || '-' || (n % 10))"


@query("src10_identifiers", rf"""SELECT id, unnest(['DOI', 'ISBN']) AS kind, unnest([dois, isbns]) AS found FROM (SELECT id,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(t, '(10\.\d{{4,}}/[^\s]*[-/._])\s*\n\s*', '\1', 'g'), '\b(10\.\d{{4,}}/[^\s<>"{{}}|\\^~\[\]`]+)', 1), lambda x: regexp_replace(x, '[.,;:)\]}}>]+$', '')))), '|') AS dois,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)(?:ISBN[\s:-]*(?:13)?[\s:-]*)?(97[89][\s-]?\d[\s-]?\d{{4}}[\s-]?\d{{4}}[\s-]?\d)', 1), lambda x: regexp_replace(x, '[\s-]', '', 'g')))), '|') AS isbns
FROM (SELECT id, {_TOLD_IDS} AS t FROM rec JOIN documents ON n = doc_id))""")
def _(s, d):
    n = F.col("doc_id")
    r = records(s, d).join(_docs(s, d).select("doc_id", "text"), F.col("_seq") == n)
    isbn = F.concat(F.lit("ISBN "), F.substring(F.replace("ISBN", F.lit("-")), 1, 4), F.lit("-1000-"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit("-"), n % 10)
    told = F.concat_ws("\n", "text", F.concat(F.lit("See https://doi.org/"), "DOI", F.lit(". Also "), "DOI", F.lit(", again.")), F.when(n % 5 == 0, F.concat(F.lit("wrapped 10.2000/w-\n x"), n, F.lit(";"))), isbn)
    told = r.select("id", told.alias("content"))
    got = parse.identifiers_text(told.withColumnRenamed("id", "own")).select("own", F.when(F.col("DOI").isNotNull(), "DOI").otherwise("ISBN").alias("kind"), "title")
    per = got.groupBy("own").pivot("kind", ["DOI", "ISBN"]).agg(F.array_join(F.array_sort(F.collect_list("title")), "|"))
    both = told.select("id").join(per, F.col("id") == F.col("own"), "left")
    return both.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.lit("")).alias("found")) for k in ("DOI", "ISBN")))).alias("x")).select("id", "x.kind", "x.found")


@query("prj4_better_of", "SELECT id, CASE WHEN n % 2 = 0 THEN title || ' more' ELSE title END AS title, 'New ' || n AS container_title, COALESCE(publisher, 'New Press') AS publisher FROM rec")
def _(s, d):
    r = records(s, d)
    new = r.select("id", F.when(F.col("_seq") % 2 == 0, F.concat("title", F.lit(" more"))).otherwise(F.lit("")).alias("title"), "author", "issued", F.concat(F.lit("New "), "_seq").alias("container_title"), F.lit("New Press").alias("publisher"), "volume", "issue", "page", "DOI", "type")
    return enrich.better_of(r, new).select("id", "title", "container_title", "publisher")


@query("prj9_inverted_abstract", "SELECT doc_id, text AS abstract FROM documents WHERE text IS NOT NULL")
def _(s, d):
    index = _docs(s, d).where("text IS NOT NULL").select("doc_id", text.places_of_words(F.split("text", " ")).alias("index"))
    return index.select("doc_id", text.inverted_abstract(F.col("index")).alias("abstract"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a project's records, newest first, as APA entries with their in-text citations."""
    r = records(spark, sf_dir).where(L.in_project("default") | L.in_project("src1"))
    return L.page(r, "year-desc").select("id", "title", families.plain(families.bibliography("apa")).alias("entry"), families.in_text("apa").alias("cited"))
