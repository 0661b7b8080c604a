"""Feature extraction: texts to bags of typed features.

Everything but character references, NFKC and the XXH3 hash is built from Spark's own
string functions. Links, mail addresses and tags are taken out of a text first (each
leaves a space) and marks are counted; what is left is split into clauses, clauses into
words, and each word gives its features. A text, a clause, a word and a feature are each
one row of a chain of generators, so the work on words runs as compiled code, and no row
moves between tasks. Bags of hashes come from numpy instead for plain texts, which no rule
but those for words, numbers and marks concerns (``packed``); the chain takes the others.

Repetitions in the grammar are bounded, as labels of host names are: Java's regular
expressions would otherwise recurse or rescan without end on hostile texts. A text that
goes beyond the bounds gets the feature ``pcre:``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..functions.hashing import feature_hash
from ..functions.plain import Extractor, is_plain
from ..functions.shared import cut, spread
from ..functions.ship import bounded_batches
from ..functions.text import CLAUSE_MARKS, CURRENCY, FROM_THAI, HTML_ELEMENTS, LETTERS, SPACE, UNSPACED, WORD, ascii_lower, chars, entities_decoded, nfkc, visible
from ..params import ExtractParams

# What the grammar of links, mail addresses and tags is made of. White space
# ends a link too, and may follow a domain; a word character may not stand before one.
LINK_STARTS = ("http://", "https://", "www.")
LINK_ENDS = "<>\"'()[]"
LINK_TRIMS = ".,;:!?"
DOMAIN_FOLLOWS = ".,;:!?)]\"'<>/"
NOT_BEFORE_DOMAIN = "@.-"
SHORTEST_SUFFIX, LONGEST_SUFFIX = 2, 10
LOCAL_PART = ".+-"

#: Characters of a host label behind its first, and labels of a host name (but one), at most.
LABEL, LABELS = 62, 126


def _labels(first: str, least: int) -> str:
    """Labels of a host name, each with its dot; a label starts with a letter or digit."""
    return rf"(?:[{first}][{first}-]{{0,{LABEL}}}\.){{{least},{LABELS + 1}}}"


_IN_LINK = rf"[^{SPACE}{chars(LINK_ENDS)}]"
_ADDRESSED = "|".join(rf"\Q{start}\E" for start in LINK_STARTS)
_DOMAIN = rf"(?<![{WORD}{chars(NOT_BEFORE_DOMAIN)}]){_labels('a-z0-9', 1)}[a-z]{{{SHORTEST_SUFFIX},{LONGEST_SUFFIX}}}(?![^{SPACE}{chars(DOMAIN_FOLLOWS)}])"
LINK = rf"(?i:{_ADDRESSED}){_IN_LINK}++|{_DOMAIN}(?:/{_IN_LINK}*+)?"

# a local part starts where none of its characters stands before, or where the last address ended
_LOCAL = rf"[{WORD}{chars(LOCAL_PART)}]"
MAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@({_labels('A-Za-z0-9', 1)}[A-Za-z0-9][A-Za-z0-9-]{{0,{LABEL}}})"

_HEAD, _TAIL = rf"<[{SPACE}]*+/?[{SPACE}]*+", rf"(?=[{SPACE}/>])[^>]*+>"
TAG = rf"{_HEAD}([A-Za-z][A-Za-z0-9]*+){_TAIL}"
#: A tag of another name is matched as a whole and put back, so what stands inside it is not read as a tag.
_KNOWN = "|".join(HTML_ELEMENTS)
TAG_OR_OTHER = rf"({_HEAD}(?!(?i:{_KNOWN}){_TAIL})[A-Za-z][A-Za-z0-9]*+{_TAIL})|{_HEAD}[A-Za-z][A-Za-z0-9]*+{_TAIL}"

_RUN = "[A-Za-z0-9-]"
_BEYOND = rf"(?<!{_RUN})(?:{_RUN}{{{LABEL + 2},}}+\.|(?:{_RUN}{{1,{LABEL + 1}}}+\.){{{LABELS + 1}}})|\.{_RUN}{{{LABEL + 2},}}+"

#: A feature's place: clause, word and feature in so many bits.
_WORD_BITS, _FEATURE_BITS = 24, 16


def _none() -> Column:
    return F.array().cast("array<string>")


def link_features(link: Column) -> Column:
    """url:, host:, tld: and path: features of one matched link."""
    url = F.regexp_replace(link, rf"[{chars(LINK_TRIMS)}]+\z", "")
    url = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*+://"), url).otherwise(F.concat(F.lit("http://"), url))
    rest = F.substring(url, F.locate("://", url) + 3, F.char_length(url))
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    named = F.substring_index(authority, "@", -1)
    port = F.regexp_extract(named, r":[0-9]*\z", 0)
    bare = F.left(named, F.char_length(named) - F.char_length(port))
    host = ascii_lower(F.when(bare.startswith("www."), F.substring(bare, F.lit(5), F.char_length(bare))).otherwise(bare))
    path = ascii_lower(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1))
    steps = F.transform(F.regexp_extract_all(path, F.lit(LETTERS), 0), lambda w: F.concat(F.lit("path:"), w))
    hosts = F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("tld:"), F.substring_index(host, ".", -1)))
    # a port that is not a number leaves no host
    whole = (bare != "") & ~named.rlike(r":[0-9]*[^0-9:][^:]*\z")
    return F.concat(F.array(F.lit("url:")), F.when(whole, F.concat(hosts, steps)).otherwise(_none()))


def _items(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with ``__items``: structs of (whole, part), features met before words (whole) and clauses; and ``__unspaced``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = spread(texts).withColumn("__t", visible(entities_decoded(t)))
    # each costly pattern is tried only on texts that hold what all of its matches hold
    linked = F.col("__t").contains("://") | F.col("__t").rlike(r"[wW]{3}\.") | F.col("__t").rlike(r"\.[a-z][a-z]")
    df = df.withColumn("__links", F.when(linked, F.regexp_extract_all("__t", F.lit(LINK), 0)).otherwise(_none()))
    beyond = F.col("__t").rlike(rf"\.(?:{_RUN}|(?<={_RUN}{{{LABEL + 2}}}\.))") & F.col("__t").rlike(_BEYOND)
    df = df.withColumn("__pcre", F.when(beyond | ~F.is_valid_utf8(t), F.array(F.lit("pcre:"))).otherwise(_none()))
    df = df.withColumn("__t", F.when(F.size("__links") > 0, F.regexp_replace("__t", LINK, " ")).otherwise(F.col("__t")))
    df = df.withColumn("__mails", F.when(F.col("__t").contains("@"), F.regexp_extract_all("__t", F.lit(MAIL), 1)).otherwise(_none()))
    df = df.withColumn("__t", F.when(F.size("__mails") > 0, F.regexp_replace("__t", MAIL, " ")).otherwise(F.col("__t")))
    angle = F.col("__t").contains("<") & F.col("__t").contains(">")
    tags = F.filter(F.transform(F.regexp_extract_all("__t", F.lit(TAG), 1), ascii_lower), lambda n: F.array_contains(F.array(*map(F.lit, HTML_ELEMENTS)), n))
    df = df.withColumn("__tags", F.when(angle, tags).otherwise(_none()))
    df = df.withColumn("__t", F.when(F.size("__tags") > 0, F.regexp_replace("__t", TAG_OR_OTHER, "$1 ")).otherwise(F.col("__t")))
    links = F.flatten(F.transform("__links", link_features))
    mails = F.flatten(F.transform("__mails", lambda m: F.array(F.lit("mail:"), F.concat(F.lit("mail:"), ascii_lower(m)))))
    named = F.transform("__tags", lambda n: F.concat(F.lit("tag:"), n))
    marks = F.array_repeat(F.lit("punct:!"), F.regexp_count("__t", F.lit("!")))
    signs = F.transform(F.regexp_extract_all("__t", F.lit(f"[{CURRENCY}]"), 0), lambda c: F.concat(F.lit("sym:"), c))
    df = df.withColumn("__before", F.concat("__pcre", links, mails, named, marks, signs)).withColumn("__t", nfkc(F.col("__t")))
    clauses = F.filter(F.split("__t", CLAUSE_MARKS), lambda c: c != "")
    item = lambda whole: lambda part: F.struct(F.lit(whole).alias("whole"), part.alias("part"))
    df = df.withColumn("__items", F.concat(F.transform("__before", item(True)), F.transform(clauses, item(False))))
    return df.withColumn("__unspaced", (F.octet_length("__t") > F.char_length("__t")) & F.col("__t").rlike(FROM_THAI) & F.col("__t").rlike(UNSPACED))


def _gram(padded: Column, k: Column, p: ExtractParams) -> Column:
    """The k-th character n-gram of a padded word, shorter ones first."""
    out, before = None, F.lit(0)
    for n in range(p.min_ngram, p.max_ngram + 1):
        many = F.greatest(F.char_length(padded) - (n - 1), F.lit(0))
        one = F.concat(F.lit(f"c{n}:"), padded.substr(k - before + 1, F.lit(n)))
        out = F.when(k < before + many, one) if out is None else out.when(k < before + many, one)
        before = before + many
    return out


def _grams(word: Column, p: ExtractParams) -> Column:
    """Number of character n-grams of a word, padded at both ends."""
    return sum((F.greatest(F.char_length(word) + 2 - (n - 1), F.lit(0)) for n in range(p.min_ngram, p.max_ngram + 1)), F.lit(0))


def met(texts: DataFrame, *keep: str, text: str = "text", params: ExtractParams | None = None, outer: bool = False) -> DataFrame:
    """The columns ``keep``, ord and feature: a row for each time a feature is met; ord rises in the order of the text.

    A null text counts as empty. A text without features gives no row. With ``outer`` every
    text gives one at least, if need be one whose feature is null. The outer form of explode is used throughout, since for
    the other one the optimizer filters on the array first, and would extract twice.
    """
    p = params or ExtractParams()
    bounded_batches(texts.sparkSession)
    base = texts.select(F.struct(*keep).alias("__keep"), F.col(text).alias("__text"))
    df = _items(base, "__text").select("__keep", "__unspaced", F.posexplode_outer("__items").alias("__i", "__item"))
    words = F.when(F.col("__item.whole"), F.array("__item.part")).otherwise(F.regexp_extract_all("__item.part", F.lit(LETTERS), 0))
    df = df.select("__keep", "__unspaced", "__i", F.col("__item.whole").alias("__whole"), words.alias("__words"))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), "__words"), F.lit(1), F.greatest(F.size("__words"), F.lit(0)))
    df = df.select("__keep", "__unspaced", "__i", "__whole", F.posexplode_outer(F.arrays_zip(F.col("__words").alias("w"), before.alias("b"))).alias("__j", "__pair"))
    w, b = F.col("__pair.w"), F.col("__pair.b")
    number = lambda x: x.rlike(r"^\p{N}+\z")
    kept = lambda x: F.char_length(x).between(p.min_word, p.max_word) & ~number(x)
    low, whole = F.lower(w), F.coalesce("__whole", F.lit(True))
    df = df.select("__keep", "__unspaced", "__i", "__j", w.alias("__w"), low.alias("__low"), whole.alias("__whole"), (~whole & kept(w)).alias("__kept"), F.when(~whole & kept(b), F.lower(b)).alias("__b"))
    w, low, kept_, whole = F.col("__w"), F.col("__low"), F.col("__kept"), F.col("__whole")
    shape = F.when(whole, w).when(~kept_ & number(w), F.concat(F.lit("num:"), F.least(F.char_length(w), F.lit(12)).cast("string")))
    shape = shape.when((w != low) & (F.char_length(w) >= 3) & (w == F.upper(w)), F.lit("caps:"))
    slots = [shape, F.when(kept_, F.concat(F.lit("w:"), low))]
    if p.word_bigrams:
        slots.append(F.when(kept_ & F.col("__b").isNotNull(), F.concat(F.lit("w2:"), "__b", F.lit("_"), low)))
    if p.char_ngrams == "none":
        df = df.select("__keep", "__i", "__j", F.posexplode(F.array(*slots)).alias("__k", "feature"))
    else:
        wants = ~whole & ~number(low) if p.char_ngrams == "all" else F.col("__unspaced") & ~whole & low.rlike(UNSPACED) & ~number(low)
        last = F.when(wants, F.lit(len(slots) - 1) + _grams(low, p)).otherwise(F.lit(len(slots) - 1))
        df = df.select("*", F.explode_outer(F.sequence(F.lit(0), last)).alias("__k"))
        k = F.col("__k")
        feature = _gram(F.concat(F.lit("_"), low, F.lit("_")), k - len(slots), p)
        for n, one in reversed(list(enumerate(slots))):
            feature = F.when(k == n, one).otherwise(feature)
        df = df.select("__keep", "__i", "__j", "__k", F.explode(F.array(feature)).alias("feature"))
    place = F.shiftleft(F.coalesce("__i", F.lit(0)).cast("long"), _WORD_BITS + _FEATURE_BITS) + F.shiftleft(F.coalesce("__j", F.lit(0)).cast("long"), _FEATURE_BITS) + F.col("__k")
    first = place == 0  # the first slot of every text, empty or not
    df = df.where(F.col("feature").isNotNull() | first if outer else F.col("feature").isNotNull())
    return df.select("__keep.*", place.alias("ord"), "feature")


def occurrences(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", params: ExtractParams | None = None) -> DataFrame:
    """doc_id, ord, feature: a row for each time a feature is met. No shuffle."""
    return met(texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", params=params)


def bags(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", params: ExtractParams | None = None) -> DataFrame:
    """doc_id, feature, cnt, ord (of the first place): a row per text and feature."""
    return occurrences(texts, doc_id, text, params).groupBy("doc_id", "feature").agg(F.count("*").alias("cnt"), F.min("ord").alias("ord"))


def _decoded(batch: pa.RecordBatch, plain: bool) -> tuple[list[str], pa.Array]:
    """Plain texts of a batch, an empty one in place of others; and those others as they came, null in place of the plain ones."""
    texts, rest = [], []
    for raw in batch.column("__text").to_pylist():
        try:
            text = (raw or b"").decode()
        except UnicodeDecodeError:
            text = None
        fits = plain and text is not None and is_plain(text)
        texts.append(text if fits else "")
        rest.append(None if fits else raw or b"")
    return texts, pa.array(rest, pa.binary())


def by_plainness(texts: DataFrame, keep: tuple[str, ...], text: str, p: ExtractParams, run, *names: str, types: str) -> tuple[DataFrame, DataFrame]:
    """What ``run(extractor, plain texts)`` gives in columns ``names`` for each plain text; and the rows of all others, with __row and __text.

    Each text is looked at once: what comes out is cut off, as both parts are read from it.
    """
    bounded_batches(texts.sparkSession)
    base = spread(texts.select(*keep, F.col(text).cast("string").cast("binary").alias("__text")))
    schema = T.StructType([*base.select(*keep).schema.fields, *T._parse_datatype_string(types).fields, T.StructField("__text", T.BinaryType())])
    args, plain = (p.min_word, p.max_word, p.word_bigrams), p.char_ngrams != "all"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(*args)
        for batch in batches:
            some, rest = _decoded(batch, plain)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *run(extractor, some), rest], names=[*keep, *names, "__text"])

    first = cut(base.mapInArrow(task, schema))
    rest = first.where(F.col("__text").isNotNull()).select(*keep, F.col("__text").cast("string").alias("__text"))
    return first.where(F.col("__text").isNull()).select(*keep, *names), rest.withColumn("__row", F.monotonically_increasing_id())


def pack(h: Column, cnt: Column) -> Column:
    """A hash and its count in one long."""
    return F.shiftleft(h, 32).bitwiseOR(cnt)


def packed(texts: DataFrame, *keep: str, text: str = "text", params: ExtractParams | None = None, mode: str = "xxh3", each: bool = False) -> DataFrame:
    """The columns ``keep`` and bag: a row for each row of ``texts``; hashes with their counts, as ``pack`` joins them.

    Written to the shared folder at once, so that it can be read again without extracting
    again; only texts that are not plain are shuffled, by hash. With ``each``, features that
    share a hash stand apart.
    """
    p = params or ExtractParams()

    def run(extractor: Extractor, some: list[str]) -> list[pa.Array]:
        ends, bags = extractor.hashed(some, mode, each)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bags, pa.int64()))]

    plain, rest = by_plainness(texts, keep, text, p, run, "bag", types="bag array<long>")
    h = feature_hash(F.col("feature"), mode).alias("h")
    found = met(rest, *keep, "__row", text="__text", params=p, outer=True)
    by = [*keep, "__row"]
    bags = found.groupBy(*by, "feature").agg(F.count("*").alias("cnt")).select(*by, h, "cnt") if each else found.select(*by, h).groupBy(*by, "h").agg(F.count("*").alias("cnt"))
    bags = bags.groupBy(*by).agg(F.collect_list(pack(F.col("h"), F.col("cnt"))).alias("bag")).drop("__row")
    return plain.unionByName(cut(bags))


def sizes(texts: DataFrame) -> DataFrame:
    """doc_id, features, occurrences, most: the size of each row's bag, 0 of a text without features."""
    p, names = ExtractParams(), ("features", "occurrences", "most")

    def run(extractor: Extractor, some: list[str]) -> list[pa.Array]:
        return [pa.array(c) for c in extractor.sizes(some).T]

    plain, rest = by_plainness(texts, ("doc_id",), "text", p, run, *names, types=", ".join(f"{n} long" for n in names))
    bags = met(rest, "doc_id", "__row", text="__text", params=p, outer=True).groupBy("doc_id", "__row", "feature").agg(F.count("feature").alias("cnt"))
    found = bags.groupBy("doc_id", "__row").agg(F.count("feature").alias(names[0]), F.sum("cnt").alias(names[1]), F.max("cnt").alias(names[2]))
    return plain.unionByName(found.drop("__row"))


def strongest(texts: DataFrame, rates: np.ndarray, k: int, params: ExtractParams, mode: str, logs: bool = False) -> DataFrame:
    """doc_id, feature, cnt: of each row those features that may be among the ``k`` that weigh most, all of texts that are not plain.

    ``rates``: the ratio by slot, which goes to the tasks; what is left needs no more than
    a small sort. A row's bag is taken by itself, so ids must not repeat.
    """
    held = texts.sparkSession.sparkContext.broadcast(rates)

    def run(extractor: Extractor, some: list[str]) -> list[pa.Array]:
        ends, names, counts = extractor.strongest(some, mode, held.value, k, logs)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values) for values in (pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()))]

    plain, rest = by_plainness(texts, ("doc_id",), "text", params, run, "features", "counts", types="features array<string>, counts array<long>")
    plain = plain.select("doc_id", F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("counts").alias("cnt"))))
    found = met(rest, "doc_id", "__row", text="__text", params=params).groupBy("doc_id", "__row", "feature").agg(F.count("*").alias("cnt"))
    return plain.unionByName(found.drop("__row"))


def unpacked(bags: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, h and cnt of packed bags: a row per text and hash."""
    both = bags.select(*keep, F.explode("bag").alias("__both"))
    return both.select(*keep, F.shiftrightunsigned("__both", 32).alias("h"), F.col("__both").bitwiseAND((1 << 32) - 1).alias("cnt"))


def repeats(rows: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether an id stands in several rows."""
    return not rows.groupBy(doc_id).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def merged(bags: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h, cnt of packed bags: those of one id are added up, which takes a shuffle only if an id stands in several rows."""
    rows = unpacked(bags, doc_id)
    return rows.groupBy(doc_id, "h").agg(F.sum("cnt").alias("cnt")) if repeats(bags, doc_id) else rows


def hashed_bags(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", params: ExtractParams | None = None, mode: str = "xxh3") -> DataFrame:
    """doc_id, h, cnt: features that share a 32-bit hash are added up."""
    return merged(packed(texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", params=params, mode=mode))


def family(feature: Column) -> Column:
    return F.substring_index(feature, ":", 1)
