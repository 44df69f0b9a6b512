"""Queries of operators that build structures: joins of word sets, indexes, stored tables, deep pages, numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import extract, paging, similar, stored, substring_index
from quillspark.plans.library import records
from quillspark.plans.registry import query
from quillspark.render import rules
from quillspark.tables import materialise, shared_dir

_WORDS = "list_sort(list_distinct(string_split_regex(regexp_replace(lower(title), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+')))"
_NAMES = "array_to_string(list_transform(range(1, len(families) + 1), lambda i: CASE WHEN is_group THEN families[i] ELSE families[i] || ', ' || givens[i] END), '; ')"


def _scratch(s: SparkSession) -> str:
    return f"{shared_dir(s)}/library-{uuid.uuid4().hex}"


@query(
    "str12_best_titles",
    f""", w AS (SELECT id, {_WORDS} AS words FROM rec WHERE title IS NOT NULL), sets AS (SELECT row_number() OVER (ORDER BY words) AS s, words FROM (SELECT DISTINCT words FROM w)),
  pairs AS (SELECT a.s AS s, b.s AS t, len(list_intersect(a.words, b.words)) / greatest(len(a.words), len(b.words)) AS similarity FROM sets a, sets b WHERE 100 * len(list_intersect(a.words, b.words)) >= 60 * greatest(len(a.words), len(b.words)))
SELECT id, match, round(similarity, 9) AS similarity FROM (
  SELECT x.id, y.id AS match, similarity, row_number() OVER (PARTITION BY x.id ORDER BY similarity DESC, y.id) AS r
  FROM (SELECT id, s FROM w JOIN sets USING (words)) x JOIN pairs USING (s) JOIN (SELECT id, s AS t FROM w JOIN sets USING (words)) y USING (t) WHERE x.id <> y.id) WHERE r = 1""",
)
def _(s, d):
    r = records(s, d).select("id", "title")
    return similar.best_titles(r, r).select("id", "match", F.round("similarity", 9).alias("similarity"))


_KEY = "COALESCE(year, 0)"


@query("srt2_deep_pages", f"SELECT id, (row_number() OVER (ORDER BY {_KEY} DESC, n) - 1) // 50 AS page, (row_number() OVER (ORDER BY {_KEY} DESC, n) - 1) % 50 AS place FROM rec")
def _(s, d):
    r = records(s, d).select("id", F.coalesce(dates.year_of(F.col("issued")), F.lit(0)).alias("year"), "_seq")
    rows = paging.numbered(r, F.col("year").desc(), F.col("_seq"))
    return rows.select("id", F.floor(F.col("row") / 50).cast("long").alias("page"), (F.col("row") % 50).cast("long").alias("place"))


@query(
    "srt2_page_after",
    """, held AS (SELECT *, date_added AS added FROM rec), last AS (SELECT added AS a, n AS m FROM held ORDER BY added DESC, n LIMIT 1 OFFSET 99)
SELECT id, added, n AS seq FROM held, last WHERE added < a OR (added = a AND n > m) ORDER BY added DESC, n LIMIT 50""",
)
def _(s, d):
    r = records(s, d).select("id", F.col("_dateAdded").alias("added"), F.col("_seq").alias("seq"))
    hundredth = paging.numbered(r, F.col("added").desc(), F.col("seq")).where("row = 99").first()
    if hundredth is None:
        return r.where("false")
    return paging.page_after(r, {"added": hundredth["added"], "seq": hundredth["seq"]}, "added")


@query(
    "srt7_cited_numbers",
    f""", b AS (SELECT n, row_number() OVER (ORDER BY {_NAMES} NULLS FIRST, year NULLS FIRST, n) AS number FROM rec),
  c AS (SELECT DISTINCT l_orderkey AS cluster, number AS k FROM lineitem JOIN b ON n = l_partkey), i AS (SELECT *, k - row_number() OVER (PARTITION BY cluster ORDER BY k) AS island FROM c),
  g AS (SELECT cluster, min(k) AS a, max(k) AS z FROM i GROUP BY cluster, island)
SELECT cluster, string_agg(CASE WHEN z - a >= 2 THEN a || '-' || z WHEN z > a THEN a || ', ' || z ELSE CAST(a AS VARCHAR) END, ', ' ORDER BY a) AS cited FROM g GROUP BY cluster""",
)
def _(s, d):
    r = _named(records(s, d))
    numbers = paging.citation_numbers(r, "names", "year", "_seq", key="_seq")
    cited = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("cluster"), F.col("l_partkey").alias("_seq")).join(numbers, "_seq")
    return paging.collapsed(cited)


def _named(r):
    shown = F.transform("author", lambda n: F.coalesce(n["literal"], F.concat_ws(", ", n["family"], n["given"])))
    return r.select("id", "_seq", "title", F.array_join(F.coalesce(shown, F.array().cast("array<string>")), "; ").alias("names"), dates.year_of(F.col("issued")).alias("year"))


@query(
    "srt7_year_suffixes",
    f"""SELECT id, CASE WHEN year IS NULL OR c < 2 THEN NULL WHEN k < 26 THEN chr(97 + k) WHEN k < 702 THEN chr(97 + (k - 26) // 26) || chr(97 + (k - 26) % 26) ELSE chr(97 + (k - 702) // 676) || chr(97 + (k - 702) // 26 % 26) || chr(97 + (k - 702) % 26) END AS year_suffix
FROM (SELECT id, year, CAST(row_number() OVER (PARTITION BY {_NAMES}, year ORDER BY n) - 1 AS INT) AS k, COUNT(*) OVER (PARTITION BY {_NAMES}, year) AS c FROM rec)""",
)
def _(s, d):
    return paging.year_suffixes(_named(records(s, d)), "_seq")


_FIELDS = ["title", "keyword", "DOI"]


@query("flt2_indexed_search", "SELECT id, needle FROM rec, (SELECT unnest(['tion', 'src1', '10.1007/ab', 'en', 'no such text']) AS needle) WHERE contains(lower(COALESCE(title, '')), needle) OR contains(lower(COALESCE(keyword, '')), needle) OR contains(lower(COALESCE(DOI, '')), needle)")
def _(s, d):
    path = _scratch(s)
    r = materialise(records(s, d).select("id", *_FIELDS))
    substring_index.build(r, "id", _FIELDS, path)
    out = None
    for needle in ("tion", "SRC1", "10.1007/ab", "en", "no such text"):
        found = substring_index.search(r, "id", _FIELDS, path, needle).select("id", F.lit(needle.lower()).alias("needle"))
        out = found if out is None else out.union(found)
    return out


@query(
    "snk9_stored",
    """SELECT id, CASE WHEN n % 50 = 0 THEN 'new title ' || n ELSE title END AS title, CASE WHEN n % 25 = 0 THEN NOT starred ELSE starred END AS starred FROM rec WHERE n % 40 <> 1
UNION ALL SELECT 'x' || n, 'added', FALSE FROM rec WHERE n % 100 = 7""",
)
def _(s, d):
    r = materialise(records(s, d).select("id", F.col("_seq").alias("n"), "title", F.col("_starred").alias("starred")))
    library = stored.Stored(s, _scratch(s), parts=16)
    library.upsert(r)
    changed = r.where("n % 50 = 0").withColumn("title", F.concat(F.lit("new title "), "n"))
    library.upsert(changed.unionByName(r.where("n % 100 = 7").select(F.concat(F.lit("x"), "n").alias("id"), "n", F.lit("added").alias("title"), F.lit(False).alias("starred"))))
    library.delete(r.where("n % 40 = 1"))
    library.update(r.where("n % 25 = 0"), starred=~F.col("starred"))
    return library.read().select("id", "title", "starred")


# Rules by n % 3: all names inverted with initials and a cut, the first inverted, plain names.
_SHOWN_NAMES = """CASE n % 3
  WHEN 0 THEN list_transform(range(1, len(families) + 1), lambda i: CASE WHEN is_group THEN families[i] ELSE families[i] || ', ' || array_to_string(list_transform(list_filter(string_split_regex(givens[i], '[\\s.]+'), lambda w: w <> ''), lambda w: w[1] || '.'), ' ') END)
  WHEN 1 THEN list_transform(range(1, len(families) + 1), lambda i: CASE WHEN is_group THEN families[i] WHEN i = 1 THEN families[i] || ', ' || givens[i] ELSE givens[i] || ' ' || families[i] END)
  ELSE list_transform(range(1, len(families) + 1), lambda i: CASE WHEN is_group THEN families[i] ELSE givens[i] || ' ' || families[i] END) END"""


@query(
    "arr2_names_by_rule",
    f""", s AS (SELECT id, n, n_authors, families, givens, {_SHOWN_NAMES} AS a FROM rec)
SELECT id, CASE WHEN n_authors = 0 THEN NULL
  WHEN n % 3 = 0 THEN CASE WHEN n_authors >= 4 THEN array_to_string(a[1:2], '; ') || CASE WHEN n_authors > 3 THEN '; … ' || givens[n_authors] || ' ' || families[n_authors] ELSE ', et al.' END WHEN n_authors = 2 THEN a[1] || ' & ' || a[2] WHEN n_authors = 1 THEN a[1] ELSE array_to_string(a[1:n_authors - 1], '; ') || '; & ' || a[n_authors] END
  WHEN n % 3 = 1 THEN CASE WHEN n_authors >= 3 THEN a[1] || ', and others' WHEN n_authors = 2 THEN a[1] || ' and ' || a[2] ELSE a[1] END
  ELSE array_to_string(a, ', ') END AS names FROM s""",
)
def _(s, d):
    rule = lambda *v: F.struct(*(F.lit(x).cast(t.split(":")[1]).alias(t.split(":")[0]) for x, t in zip(v, rules.NAME_RULE[7:-1].split(","), strict=True)))
    turn = F.col("_seq") % 3
    own = F.when(turn == 0, rule(4, 2, True, "&", "; ", None, ".", "all")).when(turn == 1, rule(3, 1, False, "and", None, "and others", None, "first")).otherwise(rule(None, None, None, None, None, None, None, None))
    return records(s, d).withColumn("rule", own).select("id", rules.names_by_rule(F.col("author"), F.col("rule")).alias("names"))


@query(
    "dt9_dates_by_rule",
    """, s AS (SELECT id, n, year, month, day, make_date(COALESCE(year, 2000), COALESCE(month, 1), COALESCE(day, 1)) AS d FROM rec)
SELECT id, CASE WHEN year IS NULL THEN NULL
  WHEN n % 4 = 0 THEN '(' || year || CASE WHEN month IS NOT NULL THEN ', ' || CASE month WHEN 5 THEN 'May' ELSE strftime(d, '%b') || '.' END ELSE '' END || CASE WHEN day IS NOT NULL THEN ', ' || day || 'th)' ELSE '' END
  WHEN n % 4 = 1 THEN COALESCE(strftime(CASE WHEN day IS NOT NULL THEN d END, '%d') || '/', '') || COALESCE(strftime(CASE WHEN month IS NOT NULL THEN d END, '%m') || '/', '') || year
  WHEN n % 4 = 2 THEN CASE WHEN day IS NOT NULL THEN strftime(d, '%Y-%m-%d') WHEN month IS NOT NULL THEN strftime(d, '%Y-%m') ELSE CAST(year AS VARCHAR) END
  ELSE CASE WHEN month IS NOT NULL THEN strftime(d, '%B ') ELSE '' END || CASE WHEN day IS NOT NULL THEN day || ' ' ELSE '' END || year END AS shown FROM s""",
)
def _(s, d):
    kind = "array<struct<name:string,form:string,prefix:string,suffix:string>>"
    rule = lambda form, mark, text: F.struct(F.lit(form).cast("string").alias("form"), F.lit(mark).alias("delimiter"), F.from_json(F.lit(text), kind).alias("parts"))
    turn = F.col("_seq") % 4
    parts = '[{"name":"year","prefix":"("},{"name":"month","form":"short"},{"name":"day","form":"ordinal","suffix":")"}]'
    zeros = '[{"name":"day","form":"numeric-leading-zeros"},{"name":"month","form":"numeric-leading-zeros"},{"name":"year"}]'
    own = F.when(turn == 0, rule(None, ", ", parts)).when(turn == 1, rule(None, "/", zeros)).when(turn == 2, rule("numeric", "", "[]")).otherwise(rule("text", "", "[]"))
    return records(s, d).withColumn("rule", own).select("id", rules.date_by_rule(F.col("issued"), F.col("rule")).alias("shown"))


@query(
    "src15_pdf_packets",
    f"""SELECT id, NULLIF(trim(title), '') AS title, CASE WHEN n_authors > 0 THEN {_NAMES} END AS author, container_title, volume, issue, page, DOI, year FROM rec WHERE NOT contains(COALESCE(title, ''), '<')
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM rec WHERE contains(COALESCE(title, ''), '<')""",
)
def _(s, d):
    r = _named(records(s, d)).join(records(s, d).select("id", "container_title", "volume", "issue", "page", "DOI"), "id")
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), text(c), F.lit(f"</{name}>")), F.lit(""))
    pages = F.split("page", "-")
    packet = F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:Description>'), tag("dc:title", F.col("title")), tag("dc:creator", F.nullif("names", F.lit(""))), tag("prism:publicationName", F.col("container_title")), tag("prism:volume", F.col("volume")), tag("prism:number", F.col("issue")),
        tag("prism:startingPage", F.get(pages, F.lit(0))), tag("prism:endingPage", F.get(pages, F.lit(1))), tag("prism:doi", F.col("DOI")), tag("prism:coverDate", F.col("year").cast("string")), F.lit("</rdf:Description></x:xmpmeta>"),
    )
    bytes_ = F.concat(F.unhex(F.lit("255044462D312E37E2E3CFD3FF00")), F.encode(F.when(F.contains(F.coalesce("title", F.lit("")), F.lit("<")), F.lit("no packet")).otherwise(packet), "UTF-8"), F.unhex(F.lit("FFFE00")))
    x = r.select("id", extract.xmp(bytes_).alias("x"))
    return x.select("id", *(F.col(f"x.{c}").alias(c) for c in ("title", "author", "container_title", "volume", "issue", "page", "DOI")), dates.year_of(dates.page_date(F.col("x.date"))).cast("long").alias("year"))
