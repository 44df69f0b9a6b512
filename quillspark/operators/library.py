"""Library operators: predicates, orders, pages, set operations and mutations (FLT, SRT, AGG, SET, MUT, JN4 to JN11).

Each takes DataFrames and returns a DataFrame; Catalyst joins the predicates of a chain into one filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.dates import year_of
from quillspark.functions.identifiers import doi_key

DEFAULT_PROJECT, GREY = "default", "#71717a"


def in_project(project: str, legacy: Column | None = None) -> Column:
    """FLT1: by the list of projects, or the legacy key; records of neither belong to the default project."""
    legacy = F.lit(None).cast("string") if legacy is None else legacy
    own = F.coalesce(F.array_contains("_projectIds", project), F.lit(False)) | F.coalesce(legacy == project, F.lit(False))
    return own | (F.col("_projectIds").isNull() & legacy.isNull()) if project == DEFAULT_PROJECT else own


def matches(query: str) -> Column:
    """FLT2: case-insensitive substring of title, author, DOI, type, container, keywords, tags or notes."""
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    people = F.coalesce(F.exists("author", lambda a: has(a["family"]) | has(a["given"])), F.lit(False))
    tags = F.coalesce(F.exists("_tags", has), F.lit(False))
    flat = [has(F.col(c)) for c in ("title", "DOI", "container_title", "keyword", "_notes")]
    return reduce(lambda a, b: a | b, [*flat, has(F.replace(F.col("type"), F.lit("-"), F.lit(" "))), people, tags])


def chips(*chosen: str) -> Column:
    """FLT3: all of `starred` and types; two types match nothing."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col("_starred"), F.lit(False)) if c == "starred" else F.col("type") == c for c in chosen], F.lit(True))


def has_tags(*tags: str) -> Column:
    """FLT4: all of the tags."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.array_contains("_tags", t), F.lit(False)) for t in tags], F.lit(True))


def export_scope(df: DataFrame, scope: str = "all", project: str | None = None) -> DataFrame:
    """FLT5: all records, the starred ones, or those of one type, of a project."""
    df = df if project is None else df.where(in_project(project))
    return df if scope == "all" else df.where(chips(scope))


def quick_search(df: DataFrame, query: str, n: int = 5) -> DataFrame:
    """FLT6: the first n records, in library order, whose title or an author's family holds the query."""
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    return df.where(has(F.col("title")) | F.coalesce(F.exists("author", lambda a: has(a["family"])), F.lit(False))).orderBy("_seq").limit(n)


def search_styles(styles: DataFrame, query: str, columns: tuple[str, ...] = ("name", "id", "field")) -> DataFrame:
    """FLT7, FLT8: styles whose name, id or field (or group) holds the query."""
    return styles.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(query.lower()), F.lit(False)) for c in columns)))


def search_remote_styles(styles: DataFrame, query: str, n: int = 30) -> DataFrame:
    """FLT9: up to 30 of the styles whose id, or id with spaces, holds a query of two characters or more."""
    q, spaced = query.lower(), F.replace(F.col("id"), F.lit("-"), F.lit(" "))
    found = styles.where((F.col("id").contains(q) | spaced.contains(q)) & F.lit(len(q) >= 2))
    return found.orderBy("id").limit(n).withColumn("name", F.initcap(spaced))


def already_held(records: DataFrame, library: DataFrame) -> DataFrame:
    """FLT10: for each record the first library row of the same DOI, URL or source URL (as `held`)."""
    keys = [(doi_key(F.col("DOI")), doi_key(F.col("DOI"))), (F.col("URL"), F.col("URL")), (F.col("URL"), F.col("_sourceUrl"))]
    found = None
    for mine, theirs in keys:
        a = records.select("id", mine.alias("key")).where("key IS NOT NULL")
        b = library.select(F.col("id").alias("held"), F.col("_seq").alias("s"), theirs.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("s", "held")).alias("hit"))
        part = a.join(b, "key").select("id", "hit")
        found = part if found is None else found.union(part)
    return records.join(found.groupBy("id").agg(F.min("hit")["held"].alias("held")), "id", "left")


def first_author() -> Column:
    a = F.get("author", F.lit(0))
    return F.lower(F.coalesce(F.nullif(a["family"], F.lit("")), F.nullif(a["literal"], F.lit("")), F.lit("zzz")))


def order(key: str) -> list[Column]:
    """SRT1: seven library orders; rows that tie keep library order."""
    year = F.nullif(year_of(F.col("issued")), F.lit(0))
    added = F.coalesce("_dateAdded", F.lit(""))
    keys = {
        "date-desc": added.desc(), "date-asc": added.asc(), "author-asc": first_author().asc(), "title-asc": F.lower(F.coalesce("title", F.lit(""))).asc(),
        "year-desc": F.coalesce(year, F.lit(0)).desc(), "year-asc": F.coalesce(year, F.lit(9999)).asc(), "type": F.coalesce("type", F.lit("")).asc(),
    }
    return [keys[key], F.col("_seq").asc()]


def page(df: DataFrame, key: str, number: int = 1, size: int = 50) -> DataFrame:
    """SRT2: one page in an order; the scan keeps size * number rows per task at most."""
    return df.orderBy(*order(key)).offset(size * (number - 1)).limit(size) if number > 1 else df.orderBy(*order(key)).limit(size)


def counts(df: DataFrame, predicate: Column) -> DataFrame:
    """AGG1: matching and all records in one pass."""
    return df.agg(F.count_if(predicate).alias("n_found"), F.count(F.lit(1)).alias("n_total"))


def badge(df: DataFrame) -> DataFrame:
    """AGG8: the number of records as a badge shows it."""
    n = F.count(F.lit(1))
    return df.agg(F.when(n == 0, F.lit("")).when(n > 999, F.lit("999+")).otherwise(n.cast("string")).alias("badge"))


def styles_by_group(styles: DataFrame) -> DataFrame:
    """AGG3: names of the styles of each group, sorted."""
    return styles.groupBy("group").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"), F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame) -> DataFrame:
    """PRJ6: authors, year and a readable type of each record."""
    people = F.array_join(F.filter(F.transform("author", lambda a: F.coalesce(a["family"], a["literal"])), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    return df.select("id", F.coalesce(people, F.lit("")).alias("authors"), year_of(F.col("issued")).alias("year"), F.replace(F.col("type"), F.lit("-"), F.lit(" ")).alias("type_label"))


def tag_colours(df: DataFrame, tags: DataFrame) -> DataFrame:
    """JN4: (id, tag, color) by tag name; unknown names are grey. tags is a dimension of one row per name."""
    return df.select("id", F.explode("_tags").alias("tag")).join(tags.select(F.col("name").alias("tag"), "color"), "tag", "left").select("id", "tag", F.coalesce("color", F.lit(GREY)).alias("color"))


def project_names(df: DataFrame, projects: DataFrame) -> DataFrame:
    """JN5: the name of a record's first project, else of the default project."""
    first = F.coalesce(F.get("_projectIds", F.lit(0)), F.lit(DEFAULT_PROJECT))
    return df.withColumn("_first", first).join(projects.select(F.col("id").alias("_first"), F.col("name").alias("project_name")), "_first", "left").drop("_first")


def effective_style(projects: DataFrame, style: str = "apa") -> DataFrame:
    """JN6: the default style of a project, else the global one."""
    return projects.withColumn("style", F.coalesce(F.nullif("default_style", F.lit("")), F.lit(style)))


def resolve_styles(ids: Column, styles: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """JN7: the styles of a list of ids with their place in it; unknown ids go. One list a row, told apart by keys; the
    styles of a single list come in its order."""
    met = rows.select(*keys, F.posexplode(ids).alias("pos", "id")).join(styles, "id")
    return met if keys else met.orderBy("pos")


def with_overrides(files: DataFrame, registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """JN8: metadata of style files from the registry, an override first."""
    over = overrides.select("id", F.col("name").alias("_name"), F.col("group").alias("_group"))
    return files.join(registry, "id", "left").join(over, "id", "left").select("id", F.coalesce("_name", "name", "id").alias("name"), F.coalesce("_group", "group", F.lit("Other")).alias("group"))


def missing_dois(dois: DataFrame, library: DataFrame) -> DataFrame:
    """JN9, SET4: DOIs that no library record has, whatever the case."""
    mine = dois.select("DOI", doi_key(F.col("DOI")).alias("key"))
    return mine.join(library.select(doi_key(F.col("DOI")).alias("key")).where("key IS NOT NULL"), "key", "left_anti").select("DOI")


def unknown_styles(remote: DataFrame, local: DataFrame) -> DataFrame:
    """JN11."""
    return remote.join(local.select("id"), "id", "left_anti")


def append(library: DataFrame, new: DataFrame) -> DataFrame:
    """SET1, SET2: bag union; columns that one side lacks are null."""
    return library.unionByName(new, allowMissingColumns=True)


def selected(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """JN10, MUT3, SNK10: records of (left_semi) or without (left_anti) the ids."""
    return df.join(ids.select("id").distinct(), "id", how)


def star(df: DataFrame, ids: DataFrame, value: bool | None = None) -> DataFrame:
    """MUT1, MUT2: set, or toggle, the star of the records of some ids."""
    mark = ids.select("id", F.lit(True).alias("_hit")).distinct()
    now = F.coalesce("_starred", F.lit(False))
    return df.join(mark, "id", "left").withColumn("_starred", F.when(F.col("_hit"), ~now if value is None else F.lit(value)).otherwise(now)).drop("_hit")


def upsert(library: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """SNK9, MUT10: new rows replace those of the same key; of new rows that share a key the last by `_seq` counts."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*(c for c in new.columns if c != key)), "_seq").alias("_r")).select(key, "_r.*") if "_seq" in new.columns else new.dropDuplicates([key])
    return library.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def create_project(projects: DataFrame, new: DataFrame) -> DataFrame:
    """MUT4, VAL4: names are trimmed to 50 characters; one that exists in any case is refused."""
    named = new.withColumn("name", F.substring(F.trim("name"), 1, 50)).where("name <> ''")
    held = projects.select(F.lower("name").alias("_n"))
    nth = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("id"))  # of new ones of one name the first
    named = named.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return projects.unionByName(named.join(held, F.lower("name") == F.col("_n"), "left_anti"), allowMissingColumns=True)


def rename_project(projects: DataFrame, project: str, name: str) -> DataFrame:
    """MUT5: the new name unless another project has it."""
    clean = name.strip()[:50]
    taken = projects.where((F.lower("name") == clean.lower()) & (F.col("id") != project)).agg((F.count(F.lit(1)) > 0).alias("_taken"))
    ok = (F.col("id") == project) & ~F.col("_taken") & F.lit(clean != "")
    return projects.join(F.broadcast(taken)).withColumn("name", F.when(ok, F.lit(clean)).otherwise(F.col("name"))).drop("_taken")


def leave_project(df: DataFrame, project: str) -> DataFrame:
    """MUT6, SET5: take a project from all lists; an empty list becomes the default project."""
    rest = F.array_remove("_projectIds", project)
    return df.withColumn("_projectIds", F.when(F.array_contains("_projectIds", project), F.when(F.size(rest) == 0, F.array(F.lit(DEFAULT_PROJECT))).otherwise(rest)).otherwise(F.col("_projectIds")))


def affected_by(df: DataFrame, project: str) -> DataFrame:
    """AGG2."""
    return df.where(F.array_contains("_projectIds", project)).agg(F.count(F.lit(1)).alias("n_affected"))


def create_tags(tags: DataFrame, df: DataFrame) -> DataFrame:
    """MUT7, MUT8: a grey tag row for each name on a record that has none."""
    used = df.select(F.explode("_tags").alias("name")).distinct().join(tags.select("name"), "name", "left_anti")
    return tags.unionByName(used.select(F.concat(F.lit("tag-"), "name").alias("id"), "name", F.lit(GREY).alias("color")))


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """VAL4: tags by name; a name that exists as it is written is refused, so is an empty one, and of new ones with one
    name all but that of the smallest id."""
    named = new.withColumn("name", F.trim("name")).where("name <> ''")
    first = named.groupBy("name").agg(F.min(F.struct("id", *(c for c in named.columns if c not in ("id", "name")))).alias("_t")).select("name", "_t.*")
    return tags.unionByName(first.join(tags.select("name"), "name", "left_anti"), allowMissingColumns=True)


def delete_tag(tags: DataFrame, name: str) -> DataFrame:
    """MUT7: a tag row goes; records keep the name."""
    return tags.where(F.col("name") != name)


def import_counts(parsed: DataFrame) -> DataFrame:
    """AGG11: entries, entries with errors and duplicates of an import. parsed: `_errors` and `duplicate_of`."""
    failed = F.coalesce(F.size("_errors") > 0, F.lit(False))
    return parsed.agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(failed).alias("n_errors"), F.count_if(~failed & F.col("duplicate_of").isNotNull()).alias("n_duplicates"))


def edited(df: DataFrame, edits: DataFrame) -> DataFrame:
    """PRJ7: fields of an edit form replace those of the record of their id; a blank one clears, a null one leaves."""
    columns = [c for c in edits.columns if c != "id"]
    new = edits.select("id", F.lit(True).alias("_edited"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = df.join(new, "id", "left")
    value = lambda c: F.when(F.col(f"_new_{c}").isNull(), F.col(c)).otherwise(F.nullif(F.col(f"_new_{c}"), F.lit("")) if dict(edits.dtypes)[c] == "string" else F.col(f"_new_{c}"))
    return out.withColumns({c: F.when(F.col("_edited"), value(c)).otherwise(F.col(c)) for c in columns}).drop("_edited", *(f"_new_{c}" for c in columns))


def lookup_record(df: DataFrame, record: str) -> DataFrame:
    """SRC16: the record of an id."""
    return df.where(F.col("id") == record)


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """SRC18: every table of the library as JSON lines in a folder of its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")


def restore(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """SRC18: the tables of a backup, with the columns of the given ones."""
    return {name: spark.read.schema(table.schema).json(f"{path}/{name}") for name, table in tables.items()}


def migrate(old: DataFrame, target: str) -> bool:
    """SRC17: records of an older store become the table `target` unless it has rows already."""
    spark = old.sparkSession
    if spark.catalog.tableExists(target) and not spark.table(target).isEmpty():
        return False
    old.write.mode("overwrite").saveAsTable(target)
    return True


def drop_quote(df: DataFrame, record: str, position: int) -> DataFrame:
    """MUT13."""
    rest = F.filter("_quotes", lambda _, i: i != position)
    return df.withColumn("_quotes", F.when(F.col("id") == record, rest).otherwise(F.col("_quotes")))


def track_style(tracked: DataFrame, new: DataFrame) -> DataFrame:
    """MUT11: each downloaded style once."""
    return tracked.unionByName(new.dropDuplicates(["id"]).join(tracked.select("id"), "id", "left_anti"))
