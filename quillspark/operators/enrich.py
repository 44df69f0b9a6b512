"""Records from forms and resolver payloads, and merges (PRJ1 to PRJ8). Payloads come as a DataFrame: no executor calls out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.functions import dates, names
from quillspark.functions.identifiers import trim_doi
from quillspark.functions.text import blank_to_null, inverted_abstract, lookup, once
from quillspark.operators import extract


def from_form(df: DataFrame) -> DataFrame:
    """PRJ1: columns type, title, authors, date, publisher, container, volume, issue, pages, doi_or_url to a record."""
    raw = F.trim("doi_or_url")
    inside = F.nullif(F.regexp_extract(raw, r"(10\.\d{4,}/[^\s?#]+)", 1), F.lit(""))
    clean = F.trim(trim_doi(F.regexp_replace(raw, r"[?#].*$", "")))
    is_doi = raw.startswith("10.")
    doi = F.when(is_doi, clean).otherwise(trim_doi(inside))
    url = F.when(is_doi, F.concat(F.lit("https://doi.org/"), clean)).when(inside.isNotNull(), F.regexp_replace(raw, r"[?#].*$", "")).otherwise(F.nullif(raw, F.lit("")))
    rest = [c for c in df.columns if c not in ("authors", "date", "container", "pages", "doi_or_url", "publisher", "volume", "issue")]
    return df.select(*rest, names.form_names(F.coalesce("authors", F.lit(""))).alias("author"), dates.form_date(F.coalesce("date", F.lit(""))).alias("issued"), *(blank_to_null(F.col(a)).alias(b) for a, b in (("publisher", "publisher"), ("container", "container_title"), ("volume", "volume"), ("issue", "issue"), ("pages", "page"))), doi.alias("DOI"), url.alias("URL"))


def stamp(df: DataFrame, source: str, project: str | None = None) -> DataFrame:
    """PRJ2: id (a new one where there is none), date added, source of import, project."""
    out = df.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.uuid())).withColumn("_dateAdded", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).withColumn("_importSource", F.lit(source))
    return out if project is None else out.withColumn("_projectIds", F.array(F.lit(project)))


def fill_missing(df: DataFrame, found: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """PRJ3: columns that a record lacks from the resolved row of its key."""
    other = found.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "") | F.col(c).cast("string").isin("[]")
    out = df.join(other, key, "left")
    return out.withColumns({c: F.when(empty(c), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).drop(*(f"_new_{c}" for c in columns))


def better_of(df: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """PRJ4: the longer title (unless the current one holds it), the longer author list, the fuller date; container, volume,
    issue, page, DOI and type of the resolved row win; a publisher only fills."""
    new = lambda c: F.col(f"_new_{c}")
    cols = ("title", "author", "issued", "container_title", "publisher", "volume", "issue", "page", "DOI", "type")
    out = df.join(found.select(key, *(F.col(c).alias(f"_new_{c}") for c in cols)), key, "left")
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    has = lambda c: F.coalesce(new(c) != "", F.lit(False))
    title = F.when(has("title") & ((length(F.col("title")) == 0) | ((length(new("title")) > length(F.col("title"))) & ~F.col("title").contains(new("title")))), new("title")).otherwise(F.col("title"))
    size = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c))
    author = F.when(size(new("author")) > size(F.col("author")), new("author")).otherwise(F.col("author"))
    shown = lambda c: F.coalesce(dates.form_text(c), F.lit(""))
    issued = F.when(F.length(shown(new("issued"))) > F.length(shown(F.col("issued"))), new("issued")).otherwise(F.col("issued"))
    wins = {c: F.when(has(c), new(c)).otherwise(F.col(c)) for c in ("container_title", "volume", "issue", "page", "DOI", "type")}
    publisher = F.when(length(F.col("publisher")) == 0, new("publisher")).otherwise(F.col("publisher"))
    return out.withColumns({"title": title, "author": author, "issued": issued, "publisher": publisher, **wins}).drop(*(f"_new_{c}" for c in cols))


def update_existing(new: DataFrame, library: DataFrame) -> DataFrame:
    """PRJ5: an edited record keeps its date added, notes, quotes and star; tags are united."""
    kept = [c for c in ("_dateAdded", "_notes", "_starred", "_quotes") if c in library.columns]
    old = library.select("id", *(F.col(c).alias(f"_old_{c}") for c in (*kept, "_tags")))
    out = new.join(old, "id", "left")
    tags = F.array_union(F.coalesce("_old__tags", F.array().cast("array<string>")), F.coalesce("_tags", F.array().cast("array<string>")))
    return out.withColumns({"_tags": tags, **{c: F.coalesce(f"_old_{c}", c) if c in new.columns else F.col(f"_old_{c}") for c in kept}}).drop(*(f"_old_{c}" for c in (*kept, "_tags")))


def from_crossref(payload: Column) -> Column:
    """PRJ8: a Crossref work as a record struct."""
    kind = "struct<message:struct<type:string,title:array<string>,author:array<struct<family:string,given:string,name:string>>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,volume:string,issue:string,page:string,publisher:string,DOI:string,URL:string,ISSN:array<string>,ISBN:array<string>,abstract:string>>"
    m = F.from_json(payload, kind)["message"]
    people = F.transform(m["author"], lambda a: names.name(a["family"], a["given"], literal=a["name"]))
    return F.struct(
        lookup(schema.CROSSREF_TYPES, m["type"], "article").alias("type"), F.get(m["title"], F.lit(0)).alias("title"), people.alias("author"), dates.date(F.coalesce(F.get(m["issued"]["date-parts"], F.lit(0)), F.array().cast("array<int>"))).alias("issued"), F.get(m["container-title"], F.lit(0)).alias("container_title"),
        m["volume"].alias("volume"), m["issue"].alias("issue"), m["page"].alias("page"), m["publisher"].alias("publisher"), m["DOI"].alias("DOI"), m["URL"].alias("URL"), F.get(m["ISSN"], F.lit(0)).alias("ISSN"), F.get(m["ISBN"], F.lit(0)).alias("ISBN"), F.regexp_replace(m["abstract"], "<[^>]+>", "").alias("abstract"),
    )


def from_openalex(payload: Column) -> Column:
    """PRJ8, PRJ9: an OpenAlex work as a record struct."""
    kind = "struct<type:string,title:string,doi:string,publication_year:int,publication_date:string,authorships:array<struct<author:struct<display_name:string>>>,biblio:struct<volume:string,issue:string,first_page:string,last_page:string>,primary_location:struct<landing_page_url:string,source:struct<display_name:string,host_organization_name:string>>,abstract_inverted_index:map<string,array<int>>>"

    def made(m: Column) -> Column:
        people = F.transform(m["authorships"], lambda a: names.byline_name(a["author"]["display_name"]))
        return F.struct(
            lookup(schema.OPENALEX_TYPES, m["type"], "article").alias("type"), m["title"].alias("title"), people.alias("author"), dates.page_date(F.coalesce(m["publication_date"], m["publication_year"].cast("string"))).alias("issued"), m["primary_location"]["source"]["display_name"].alias("container_title"),
            m["biblio"]["volume"].alias("volume"), m["biblio"]["issue"].alias("issue"), F.when(m["biblio"]["first_page"] != "", F.concat_ws("-", m["biblio"]["first_page"], F.nullif(m["biblio"]["last_page"], F.lit("")))).alias("page"), m["primary_location"]["source"]["host_organization_name"].alias("publisher"),
            F.replace(m["doi"], F.lit("https://doi.org/"), F.lit("")).alias("DOI"), m["primary_location"]["landing_page_url"].alias("URL"), F.when(m["abstract_inverted_index"].isNotNull(), inverted_abstract(m["abstract_inverted_index"])).alias("abstract"),
        )

    return once(F.from_json(payload, kind), made)


def _people(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), names.plain_name)


def from_open_library(payload: Column, isbn: Column) -> Column:
    """PRJ8: a book of Open Library; the payload holds it under `ISBN:` and its number. Null if it is not there."""
    book = "struct<title:string,authors:array<struct<name:string>>,publish_date:string,publishers:array<struct<name:string>>,publish_places:array<struct<name:string>>,number_of_pages:string,url:string>"
    plain = F.regexp_replace(F.trim(isbn), r"[-\s]", "")
    head = lambda c: F.get(c, F.lit(0))["name"]
    made = lambda b: F.struct(
        F.lit("book").alias("type"), b["title"].alias("title"), _people(b["authors"]["name"]).alias("author"), F.when(b["publish_date"].isNotNull(), dates.fuzzy_date(b["publish_date"])).alias("issued"),
        head(b["publishers"]).alias("publisher"), head(b["publish_places"]).alias("publisher_place"), b["number_of_pages"].alias("number_of_pages"), plain.alias("ISBN"), b["url"].alias("URL"),
    )
    found = F.try_element_at(F.from_json(payload, f"map<string,{book}>"), F.concat(F.lit("ISBN:"), plain))
    return once(found, lambda b: F.when(b.isNotNull(), made(b)))


def from_google_books(payload: Column, isbn: Column) -> Column:
    """PRJ8: the first volume of a Google Books answer; null if there is none."""
    kind = "struct<items:array<struct<volumeInfo:struct<title:string,authors:array<string>,publishedDate:string,publisher:string,pageCount:string,description:string,language:string,infoLink:string>>>>"
    made = lambda v: F.struct(
        F.lit("book").alias("type"), v["title"].alias("title"), _people(v["authors"]).alias("author"), F.when(v["publishedDate"].isNotNull(), dates.fuzzy_date(v["publishedDate"])).alias("issued"), v["publisher"].alias("publisher"),
        v["pageCount"].alias("number_of_pages"), F.regexp_replace(F.trim(isbn), r"[-\s]", "").alias("ISBN"), v["description"].alias("abstract"), v["language"].alias("language"), v["infoLink"].alias("URL"),
    )
    return once(F.get(F.from_json(payload, kind)["items"], F.lit(0))["volumeInfo"], lambda v: F.when(v.isNotNull(), made(v)))


def from_semantic_scholar(payload: Column, arxiv: Column) -> Column:
    """PRJ8: a paper of Semantic Scholar by its arXiv number; null without a title."""
    kind = "struct<title:string,authors:array<struct<name:string>>,year:int,abstract:string,externalIds:struct<DOI:string>,publicationDate:string>"
    day = lambda p: F.when(p["publicationDate"].isNotNull(), dates.form_date(p["publicationDate"])).when(p["year"].isNotNull(), dates.date(F.array(p["year"])))
    made = lambda p: F.struct(
        F.lit("article").alias("type"), p["title"].alias("title"), _people(p["authors"]["name"]).alias("author"), day(p).alias("issued"), p["abstract"].alias("abstract"),
        F.coalesce(p["externalIds"]["DOI"], F.concat(F.lit("10.48550/arXiv."), arxiv)).alias("DOI"), F.concat(F.lit("https://arxiv.org/abs/"), arxiv).alias("URL"), arxiv.alias("number"),
    )
    return once(F.from_json(payload, kind), lambda p: F.when(F.coalesce(p["title"], F.lit("")) != "", made(p)))


def from_citoid(payload: Column, url: Column) -> Column:
    """PRJ8: the first item of a Citoid answer, or the one that it is; null if there is none."""
    item = "struct<itemType:string,title:string,creators:array<struct<creatorType:string,lastName:string,firstName:string,name:string>>,date:string,publicationTitle:string,websiteTitle:string,volume:string,issue:string,pages:string,publisher:string,DOI:string,ISBN:string,ISSN:string,url:string,abstractNote:string,language:string>"
    text = F.trim(payload)
    none = F.array().cast("array<struct<creatorType:string,lastName:string,firstName:string,name:string>>")

    def made(i: Column) -> Column:
        own = lambda *fs: F.coalesce(*(F.nullif(i[f], F.lit("")) for f in fs))
        writers = F.filter(F.coalesce(i["creators"], none), lambda c: c["creatorType"] == "author")
        people = F.transform(writers, lambda c: F.when(F.coalesce(c["lastName"], F.lit("")) != "", names.name(c["lastName"], F.coalesce(c["firstName"], F.lit("")))).otherwise(names.name(literal=F.coalesce(c["name"], F.lit("")))))
        plain = (("volume", "volume"), ("issue", "issue"), ("pages", "page"), ("publisher", "publisher"), ("DOI", "DOI"), ("ISBN", "ISBN"), ("ISSN", "ISSN"), ("abstractNote", "abstract"), ("language", "language"))
        return F.struct(
            lookup(schema.CITOID_TYPES, i["itemType"], "webpage").alias("type"), own("title").alias("title"), people.alias("author"), F.when(own("date").isNotNull(), dates.fuzzy_date(i["date"])).alias("issued"),
            own("publicationTitle", "websiteTitle").alias("container_title"), *(own(a).alias(b) for a, b in plain), F.coalesce(own("url"), url).alias("URL"),
        )

    item_ = F.when(text.startswith("["), F.get(F.from_json(text, f"array<{item}>"), F.lit(0))).otherwise(F.from_json(text, item))
    return once(item_, lambda i: F.when(i.isNotNull(), made(i)))


def from_arxiv_page(html: Column, arxiv: Column) -> Column:
    """PRJ8: a paper by the abstract page of its arXiv number."""
    told = F.regexp_extract(html, r'(?is)<blockquote[^>]*class="abstract[^"]*"[^>]*>.*?<span class="descriptor">[^<]*</span>\s*(.*?)</blockquote>', 1)
    about = blank_to_null(F.trim(F.regexp_replace(F.regexp_replace(told, "<[^>]+>", ""), r"\s+", " ")))

    def made(m: Column) -> Column:
        all_ = lambda name: F.transform(F.filter(m, lambda t: t["name"] == name), lambda t: t["content"])
        one = lambda name: F.get(all_(name), F.lit(0))
        people = F.transform(all_("citation_author"), lambda x: F.when(x.contains(","), names.ris_name(x)).otherwise(names.plain_name(x)))
        day = F.regexp_replace(F.coalesce(one("citation_date"), one("citation_publication_date")), "/", "-")
        return F.struct(
            F.lit("article").alias("type"), one("citation_title").alias("title"), people.alias("author"), dates.form_date(day).alias("issued"), about.alias("abstract"),
            F.coalesce(one("citation_doi"), F.concat(F.lit("10.48550/arXiv."), arxiv)).alias("DOI"), F.concat(F.lit("https://arxiv.org/abs/"), arxiv).alias("URL"), arxiv.alias("number"),
        )

    return once(extract.metas(html), made)


def from_file_name(name: Column) -> Column:
    """PRJ10: a title from a file name."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_url_decode(name), name), r"^.*/", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(base, "[_-]+", " "), r"\s+", " "))


def from_local_file(url: Column, title: Column) -> Column:
    """PRJ10: a record of a local file from its address and the title of its tab: the tab's own title, else one from the
    file name; a DOI in the file name."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), url)
    file = F.regexp_extract(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), "([^/]*)$", 1)
    plain = F.nullif(F.regexp_replace(file, r"\.\w{1,5}$", ""), F.lit(""))
    shown = F.when((title != "") & (title != file) & ~title.startswith("file:"), F.trim(F.regexp_replace(title, r"(?i)\.pdf$", "")))
    return F.struct(
        F.lit("document").alias("type"), F.coalesce(shown, F.trim(F.regexp_replace(F.regexp_replace(plain, "[-_]+", " "), r"\s+", " "))).alias("title"), url.alias("URL"),
        F.nullif(F.regexp_extract(file, r"(10\.\d{4,}\S+)", 1), F.lit("")).alias("DOI"), F.lower(url).endswith(".pdf").alias("is_pdf"),
    )


def first_success(payloads: DataFrame, key: str, priority: str, value: str) -> DataFrame:
    """Fallback chain: of the payloads of a key the one of least priority that is not null."""
    return payloads.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, priority).alias(value))
