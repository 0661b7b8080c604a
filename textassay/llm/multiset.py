"""Homomorphic multiset fingerprints, with DataFrame functions only.

A text is a multiset of paragraphs (lines). Each paragraph is hashed to a wide
vector and vectors are added lane by lane modulo a power of two, so the order of
paragraphs does not matter and paragraphs can be added or taken away without
reading the rest. The vector has two parts:

* eight lanes of 32 bits: words of the paragraph's SHA-256, added modulo 2**32.
  Two texts with equal lanes hold the same paragraphs.
* ``LANES`` lanes of 16 bits: each sentence of a paragraph adds 1 or -1 to one
  lane chosen by its MD5, modulo 2**16. Both parts of a text are the sums of those of
  its paragraphs, so both follow when paragraphs come or go. The angle between two of these vectors
  estimates the share of sentences that two texts have in common.

A fingerprint is a hexadecimal string: 64 digits of the first part, then four
digits a lane of the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ranges import place_among, quantiles
from .common import cut, text_of

LANES = 64
STRONG = 8
#: Rows of a window group, and ranges of ids that groups divide evenly.
GROUP_ROWS, QUANTILES = 200, 256

_HEX = "0123456789abcdef"
#: Cells in the order of lanes: the one that adds, the one that takes away.
_CELLS = [(f"{_HEX[n // 4]}{2 * (n % 4)}", f"{_HEX[n // 4]}{2 * (n % 4) + 1}") for n in range(LANES)]


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n+"), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda p: F.trim(p)), lambda p: p != "")


def strong_part(text: Column) -> Column:
    """array<bigint> of ``STRONG`` lanes below 2**32."""
    digests = F.transform(paragraphs(text), lambda p: F.sha2(p, 256))
    lane = lambda k: lambda acc, h: (acc + F.conv(h.substr(8 * k + 1, 8), 16, 10).cast("long")).bitwiseAND(0xFFFFFFFF)
    # bound as a lambda's variable, so that each paragraph is hashed once for all lanes
    return F.transform(F.array(digests), lambda ds: F.array(*[F.aggregate(ds, F.lit(0).cast("long"), lane(k)) for k in range(STRONG)]))[0]


def sketch_part(text: Column) -> Column:
    """array<int> of ``LANES`` signed counts, each in [-2**15, 2**15)."""
    cell = lambda h: F.concat(h.substr(1, 1), F.translate(h.substr(2, 1), "89abcdef", "01234567"), F.lit(","))
    row = F.array_join(F.transform(F.transform(sentences(text), F.md5), cell), "")
    count = lambda s, c: ((F.octet_length(s) - F.octet_length(F.replace(s, F.concat(c, F.lit(",")), F.lit("")))) / 3).cast("int")
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _CELLS])
    held = F.transform(F.array(row), lambda s: F.transform(cells, lambda c: _low(count(s, c["a"]) - count(s, c["b"]))))
    return held[0]


def add(a: Column, b: Column) -> Column:
    """The strong lanes of two texts' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(0xFFFFFFFF))


def subtract(a: Column, b: Column) -> Column:
    """The strong lanes of a text's paragraphs without another's."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(0xFFFFFFFF))


def _low(v: Column) -> Column:
    """Modulo 2**16, as a signed number."""
    return ((v + 32768).bitwiseAND(65535) - 32768).cast("int")


def add_sketch(a: Column, b: Column) -> Column:
    """The sketch of two texts' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: _low(x + y))


def subtract_sketch(a: Column, b: Column) -> Column:
    """The sketch of a text's paragraphs without another's."""
    return F.zip_with(a, b, lambda x, y: _low(x - y))


def parts(fingerprint: Column) -> tuple[Column, Column]:
    """Strong lanes and sketch of a fingerprint's string."""
    number = lambda at, n: F.conv(fingerprint.substr(at, F.lit(n)), 16, 10).cast("long")
    strong = F.transform(F.sequence(F.lit(0), F.lit(STRONG - 1)), lambda k: number(k * 8 + 1, 8))
    return strong, F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: _low(number(k * 4 + 8 * STRONG + 1, 4)))


def inserted(fingerprint: Column, paragraphs_: Column) -> Column:
    """The fingerprint of a text with further paragraphs, from both fingerprints alone."""
    (a, x), (b, y) = parts(fingerprint), parts(paragraphs_)
    return as_string(add(a, b), add_sketch(x, y))


def deleted(fingerprint: Column, paragraphs_: Column) -> Column:
    """The fingerprint of a text without some of its paragraphs, from both fingerprints alone."""
    (a, x), (b, y) = parts(fingerprint), parts(paragraphs_)
    return as_string(subtract(a, b), subtract_sketch(x, y))


def as_string(strong: Column, sketch: Column) -> Column:
    wide = F.array_join(F.transform(strong, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    narrow = F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(65535).cast("long"))), 4, "0")), "")
    return F.concat(wide, narrow)


def likeness(strong_a: Column, sketch_a: Column, strong_b: Column, sketch_b: Column) -> Column:
    """1 for equal strong lanes; else the cosine of the sketches, 0 at least."""
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x).cast("double")
    norm = F.sqrt(total(sketch_a, sketch_a) * total(sketch_b, sketch_b))
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(sketch_a, sketch_b) / F.nullif(norm, F.lit(0.0))))
    return F.when(strong_a == strong_b, F.lit(1.0)).otherwise(F.coalesce(cosine, F.lit(0.0)))


def fingerprints(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with __strong and __sketch; null text counts as empty (all lanes 0)."""
    return documents.withColumn("__strong", strong_part(text_of(text))).withColumn("__sketch", sketch_part(text_of(text)))


def _groups(rows: DataFrame, key: str) -> tuple[Column, int]:
    """A group number that rises as ``key`` falls (nulls last), in groups of about ``GROUP_ROWS`` rows.

    Coarse bounds are quantiles of the key, finer groups divide the way between two bounds evenly.
    """
    n = rows.count()
    bounds = quantiles(rows, key, max(1, min(QUANTILES, n // (4 * GROUP_ROWS)))) if n else []
    if len(bounds) < 2:
        return F.when(F.col(key).isNull(), 1).otherwise(0), 2
    fine = max(1, n // GROUP_ROWS // (len(bounds) - 1))
    value = F.col(key).cast("double")
    coarse = place_among(value, bounds)
    low, high = F.get(F.array(*map(F.lit, bounds[:-1])), coarse), F.get(F.array(*map(F.lit, bounds[1:])), coarse)
    part = F.least(F.greatest(F.floor((value - low) / (high - low) * F.lit(fine)), F.lit(0)), F.lit(fine - 1))
    last = (len(bounds) - 1) * fine
    return F.when(F.col(key).isNull(), F.lit(last)).otherwise(F.lit(last - 1) - (coarse * fine + part)).cast("long"), last + 1


def with_next(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, strong, sketch, and next (struct of the same of the following row in descending id; the last row has the first).

    Ids are whole numbers (any integer type). Rows of one id are ordered by their text, null
    ids come last. No task sees more than a group of neighbouring ids; only the numbers of
    groups meet in one.
    """
    if documents.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be an integer column")
    rows = documents.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    group, _ = _groups(rows.select("doc_id"), "doc_id")
    rows = rows.withColumn("strong", strong_part(F.col("text"))).withColumn("sketch", sketch_part(F.col("text"))).withColumn("group", group)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    inside = W.partitionBy("group").orderBy(*order)
    own = F.struct("text", "strong", "sketch")
    rows = rows.withColumn("next", F.lead(own).over(inside))
    first = documents.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("group", group)
    first = first.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("back"), "text"))["text"].alias("text"))
    first = cut(first)
    # only the numbers of groups meet in one task; their first texts are joined
    around = W.orderBy("group")
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = first.select("group").select("group", F.coalesce(F.lead("group").over(around), F.first("group").over(whole)).alias("following"))
    after = follows.join(first.select(F.col("group").alias("following"), "text"), "following").select("group", "text")
    after = after.withColumn("strong", strong_part(F.col("text"))).withColumn("sketch", sketch_part(F.col("text"))).select("group", own.alias("beyond"))
    rows = rows.join(after, "group")
    return rows.select("doc_id", "text", "strong", "sketch", F.coalesce("next", "beyond").alias("next"))


def edited_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the start of the next row's text. A
    table of one row has itself as next; an empty text has all lanes 0 and equals other
    empty texts. Repeated rows follow each other.
    """
    rows = with_next(documents, doc_id, text)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - third), F.left(F.col("next.text"), third)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "strong", "sketch", "next", strong_part(F.col("edited")).alias("e_strong"), sketch_part(F.col("edited")).alias("e_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("strong"), F.col("sketch")).alias("fingerprint"),
        as_string(F.col("e_strong"), F.col("e_sketch")).alias("edited_fingerprint"),
        likeness(F.col("strong"), F.col("sketch"), F.col("e_strong"), F.col("e_sketch")).alias("near_edited"),
        likeness(F.col("strong"), F.col("sketch"), F.col("next.strong"), F.col("next.sketch")).alias("near_next"),
    )
