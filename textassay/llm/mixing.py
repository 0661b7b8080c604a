"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key; rows are range-sorted by it within their
source, prefix sums of sizes are formed in two levels (key ranges of a source,
then rows of a range), and each source is cut at its exact budget. Where a
source's target exceeds its size the source is taken in whole epochs first and
the rest is cut out of one more.

Key ranges keep a source that holds most of the rows spread over groups of about
``RANGE_ROWS`` rows. The only table that meets in one task has a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import text_of

#: Rows of a key range, about, and most ranges of a source (five hexadecimal digits of the key).
RANGE_ROWS, RANGES = 2_000, 1 << 20
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most this many times.
MAX_EPOCHS = 3
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, budget, rounds, rest for a table of (source, source_size) with a row per source.

    Targets share the sum of all sizes by weight; none exceeds ``epochs`` times its
    source. In the order of limit by weight the sources at their limit come first, so
    the level of the others follows from prefix sums.
    """
    named = W.orderBy(F.asc_nulls_last("source"))  # a row a source
    s = sizes.withColumn("nth", F.row_number().over(named))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = s.withColumn("most", (F.col("source_size") * epochs).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    before = W.orderBy("ratio", "nth").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("free", F.col("ratio") > F.col("level"))
    first = W.orderBy(F.desc("free"), "ratio", "nth").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("target", F.when(F.col("free"), F.first("level").over(first) * F.col("weight")).otherwise(F.col("most")))
    s = s.withColumn("budget", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * epochs))
    s = s.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    return s.select("source", "source_size", "target", "budget", "rounds", (F.col("budget") - F.col("rounds") * F.col("source_size")).alias("rest"))


def mix(documents: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``documents`` with __size, __source_size, __target, __rounds and __taken (words taken, repeats counted).

    Null sources form one source that comes last; a null text has no words and is
    never taken. Rows of equal keys are told apart by their text; wholly repeated rows
    are interchangeable, so reruns give the same rows. Rows of sources without words
    have target 0. Other columns pass through.
    """
    body = text_of(text)
    ranges = max(1, min(RANGES, 1 << (documents.count() // RANGE_ROWS).bit_length()))
    rows = documents.withColumn("__size", word_count(body)).withColumn("__key", F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(body))))
    named = F.concat(F.lit("="), F.col(source).cast("string"))  # null becomes "", so that joins need no null-safe key
    rows = rows.withColumn("__source", F.coalesce(named, F.lit(""))).withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 5), 16, 10).cast("long") * ranges / (1 << 20)).cast("int"))
    per_range = rows.groupBy("__source", "__range").agg(F.sum("__size").alias("range_size"))
    earlier = W.partitionBy("__source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    start = per_range.withColumn("__start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).select("__source", "__range", "__start")
    totals = per_range.groupBy("__source").agg(F.sum("range_size").alias("source_size"))
    plan = targets(totals.select(F.when(F.col("__source") != "", F.col("__source")).alias("source"), "source_size"), weights, epochs)
    plan = plan.select(F.coalesce("source", F.lit("")).alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rounds").alias("__rounds"), F.col("rest").alias("__rest"))
    start = start.join(plan, "__source").select("__source", "__range", "__start", "__source_size", "__target", "__rounds", "__rest")
    sorted_ = W.partitionBy("__source", "__range").orderBy("__key", "__size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("__size").over(sorted_), F.lit(0)))
    rows = rows.join(start, ["__source", "__range"])
    extra = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__rest") - F.col("__start") - F.col("__within")))
    rows = rows.withColumn("__taken", F.col("__rounds") * F.col("__size") + extra)
    return rows.drop("__key", "__source", "__range", "__within", "__start", "__rest")


def copies(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: a row for each time a document is taken, in the columns of ``documents``.

    The one document of a source that crosses its budget is taken up to the word at
    the cut, its words then joined by single spaces; every other copy is whole.
    """
    rows = mix(documents, text=text, **options)
    extra = F.col("__taken") - F.col("__rounds") * F.col("__size")
    rows = rows.withColumn("__extra", extra).withColumn("__copies", (F.col("__rounds") * (F.col("__size") > 0).cast("long") + (extra > 0).cast("long")).cast("int"))
    rows = rows.where("__copies > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    part = (F.col("__nth") > F.col("__rounds")) & (F.col("__extra") < F.col("__size"))
    words = F.filter(F.split(text_of(text), SPACE), lambda w: w != "")
    first = F.array_join(F.slice(words, F.lit(1), F.col("__extra").cast("int")), " ")
    rows = rows.withColumn(text, F.when(part, first).otherwise(F.col(text)))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.when(part, F.char_length(text).cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*documents.columns)
