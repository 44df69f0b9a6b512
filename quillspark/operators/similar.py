"""Best title matches (STR12 as resolution uses it): a join of sets of words by their similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import title_words
from quillspark.operators.paging import numbered
from quillspark.tables import materialise

#: A title is accepted from this share of common words on, in per cent.
LEAST = 60
#: Longs of a set's sketch.
SKETCH = 4


def _needed(size: Column, percent: int) -> Column:
    """Words that sets of which the larger has `size` share at least."""
    return F.ceil(size * percent / F.lit(100))


def similar_titles(new: DataFrame, held: DataFrame, percent: int = LEAST) -> DataFrame:
    """Pairs (new_set, held_set) of distinct sets of title words whose common words are `percent` or more of the larger
    set, with their similarity. new and held: columns set (a hash) and words (distinct words)."""
    mine, theirs, pairs = numbered_pairs(new, held, percent)
    of = lambda df, side: df.select(F.col("_no").alias(f"{side}_no"), F.col("set").alias(f"{side}_set"))
    return pairs.join(of(mine, "new"), "new_no").join(of(theirs, "held"), "held_no").select("new_set", "held_set", "similarity")


def numbered_pairs(new: DataFrame, held: DataFrame, percent: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of both sides with a number each (set, _no), and the similar pairs by these numbers.

    Sets that share so much share one of their rarest words: of n words all but as many as must be shared, less one.
    Words are counted over both sides and numbered from the rarest on, so that from here on a set is an array of
    numbers; each stands under its rarest words only, and meets sets there whose size can do and of which the words from
    this one on can. Sets that meet so are no rows yet: each carries a sketch of its words, and pairs whose sketches
    differ more than sets that fit can are dropped within the join. What is left is compared number by number.
    Where both sides are one table, a pair is met and compared in one order only, and a set does not meet itself.
    """
    one = new is held
    mine = materialise(new.select("set", "words").withColumn("_no", F.monotonically_increasing_id()))
    theirs = mine if one else materialise(held.select("set", "words").withColumn("_no", F.monotonically_increasing_id()))
    told = mine.select(F.explode("words").alias("word"))
    count = (told if one else told.union(theirs.select(F.explode("words")))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    number = numbered(count, "n", "word").select("word", F.col("row").cast("int").alias("w"))

    def ranked(sets: DataFrame) -> DataFrame:
        each = sets.select("_no", F.explode("words").alias("word")).join(number, "word")
        ranks = each.groupBy("_no").agg(F.sort_array(F.collect_list("w")).alias("w"))  # the words of one title
        return materialise(ranks.select("_no", "w", _sketch(F.col("w")).alias("sketch")))

    def rarest(sets: DataFrame, side: str) -> DataFrame:
        size = F.size("w")
        few = F.slice("w", F.lit(1), (size - _needed(size, percent) + 1).cast("int"))
        each = sets.select("_no", size.alias("size"), "sketch", F.posexplode(few).alias("at", "word"))
        return each.select("word", *(F.col(c).alias(f"{side}_{c.lstrip('_')}") for c in ("_no", "size", "at")), *(F.col("sketch")[i].alias(f"{side}_bits{i}") for i in range(SKETCH)))

    my_words = ranked(mine)
    their_words = my_words if one else ranked(theirs)
    left, right = rarest(my_words, "new"), rarest(their_words, "held")
    need = _needed(F.greatest("new_size", "held_size"), percent)
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"new_bits{i}").bitwiseXOR(F.col(f"held_bits{i}"))) for i in range(SKETCH)))
    fits = (F.least(F.col("new_size") - F.col("new_at"), F.col("held_size") - F.col("held_at")) >= need) & (differ <= F.col("new_size") + F.col("held_size") - 2 * need)
    if one:
        fits = fits & (F.col("new_no") < F.col("held_no"))
    met = left.join(right, (left["word"] == right["word"]) & fits).select("new_no", "held_no").distinct()
    of = lambda df, side, words: df.select(F.col("_no").alias(f"{side}_no"), F.col("w").alias(words))
    both = met.join(of(my_words, "new", "a"), "new_no").join(of(their_words, "held", "b"), "held_no")
    common = F.size(F.array_intersect("a", "b"))
    larger = F.greatest(F.size("a"), F.size("b"))
    pairs = both.where(100 * common >= percent * larger).select("new_no", "held_no", (common / larger).alias("similarity"))
    if one:
        turned = F.array(F.struct("new_no", "held_no"), F.struct(F.col("held_no").alias("new_no"), F.col("new_no").alias("held_no")))
        pairs = pairs.select("similarity", F.inline(turned)).select("new_no", "held_no", "similarity")
        pairs = pairs.union(mine.select("_no", "_no", F.lit(1.0)))
    return mine.select("set", "_no"), theirs.select("set", "_no"), pairs


def _sketch(words: Column) -> Column:
    """An array of SKETCH longs: each word sets or clears one of their bits. Words of one set alone change one bit each at
    most, so that two sketches differ in no more bits than their sets in words."""
    place = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * SKETCH)).cast("int"))
    bits = lambda i: F.aggregate(F.filter(place, lambda p: F.floor(p / 64) == i), F.lit(0).cast("long"), lambda a, p: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)))
    return F.array(*(bits(i) for i in range(SKETCH)))


def best_titles(new: DataFrame, held: DataFrame, key: str = "id", title: str = "title", percent: int = LEAST) -> DataFrame:
    """For each new record the held one of another key whose title is most similar, of equal ones the smallest key:
    (key, match, similarity). Records without one, and those without a title, are left out.

    Records with the same words are one set: of a held set only the two smallest keys can match, as a record is not its
    own match.
    """
    words = title_words(F.col(title))
    sets = lambda df: materialise(df.where(F.col(title).isNotNull()).select(F.col(key), F.array_sort(words).alias("words")).withColumn("set", F.unhex(F.sha2(F.to_json("words"), 256))))
    mine = sets(new)
    theirs = mine if new is held else sets(held)
    one = lambda df: df.groupBy("set").agg(F.first("words").alias("words"))
    groups = one(mine)
    my_sets, their_sets, pairs = numbered_pairs(groups, groups if new is held else one(theirs), percent)
    keys = theirs.select("set", key).join(their_sets.withColumnRenamed("_no", "held_no"), "set").select("held_no", key)
    first = keys.groupBy("held_no").agg(F.min(key).alias("_first"))
    after = keys.join(first, "held_no").where(F.col(key) != F.col("_first")).groupBy("held_no").agg(F.min(key).alias("_second"))
    ends = first.join(after, "held_no", "left")
    offers = pairs.join(ends, "held_no").select("new_no", "similarity", F.explode(F.array_compact(F.array("_first", "_second"))).alias("match"))
    # Of a new set's offers the two best suffice: one of them is not the record itself.
    rank = lambda c: F.struct(-F.col("similarity"), F.col(c))
    best = offers.groupBy("new_no").agg(F.min(rank("match")).alias("_best"))
    rest = offers.join(best, "new_no").where(F.col("match") != F.col("_best")["match"]).groupBy("new_no").agg(F.min(rank("match")).alias("_next"))
    two = best.join(rest, "new_no", "left")
    met = mine.select(key, "set").join(my_sets.withColumnRenamed("_no", "new_no"), "set").join(two, "new_no")
    chosen = F.when(F.col("_best")["match"] != F.col(key), F.col("_best")).otherwise(F.col("_next"))
    found = met.select(key, chosen.alias("_c")).where("_c IS NOT NULL")
    return found.select(key, F.col("_c")["match"].alias("match"), (-F.col("_c")["col1"]).alias("similarity"))
