"""Near-duplicate texts by an exact prefix filter over word shingles, and by SimHash on request.

Neither finds what the other does. At a similarity of 0.8 two fingerprints of 64 bits
differ in seven bits or so, more than any index by positions can promise to find; an
exact filter over hashed shingles finds every such pair. Fingerprints count repeats, so
texts within ``simhash.MAX_BITS`` may share far fewer distinct shingles than that. With
``fingerprints`` the links of both make one set of groups.

All shingles have one order: those seen in few texts of a sample first. Of a text
with n shingles the first ``n - ceil(similarity * n) + 1`` in this order are its
prefix; of any two texts that reach ``similarity``, the prefixes share a shingle.
The texts that have a shingle in their prefix are its list. What the sample says
decides about speed only, never about which texts are linked.

All pairs of a list of ``SHORT`` texts or fewer are candidates. Of longer ones each
member first meets the ``PIVOTS`` members with the fewest rare shingles and the next
one in an order that is another in each list, which links most of a large group; then
all pairs whose texts are not in one group yet are candidates, block by block, so
nothing is left out. Candidates are dropped only by bounds on their overlap (sizes,
positions, number of shared prefix shingles); the rest is compared shingle by shingle.

No list has to fit in one task: members of common shingles are counted by partial sums,
pivots are partial minima, and neighbours and blocks are taken from parts of a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_batches, cut, text_of
from .graph import components
from .simhash import near_duplicates, shingle_hashes

#: Longest list whose pairs are all formed at once, and the members that all others of a longer one meet first.
SHORT, PIVOTS = 48, 2
#: One text of so many is looked at for common shingles: those in so many of them, the most common so many at most.
SAMPLE, OFTEN, COMMON = 16, 3, 1 << 17
#: Members of one block when the pairs of a long list are formed, and of a part in which members meet their neighbours.
BLOCK, PART = 256, 4096
#: Slots of the keys' hash by which texts that no join needs are passed by: a broadcast of so many rows at most.
SLOTS = 1 << 20

def _slot(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(SLOTS)).alias("slot")


def _slots(keys: DataFrame) -> DataFrame:
    """The slots that hold one of the keys: ``SLOTS`` small rows at most, whatever the corpus holds."""
    return F.broadcast(keys.select(_slot("key")).distinct())


def prefix_length(n: int, similarity: float) -> int:
    """Shingles of a text with ``n`` that lead to every text of at least this similarity."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles of a sample of texts, sorted, and their counts."""

    @F.pandas_udf("array<bigint>")
    def every(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch], dtype=object)

    some = texts.where(F.pmod("key", F.lit(SAMPLE)) == 0).dropDuplicates(["key"])
    counts = some.select(F.explode(every.asNondeterministic()("text")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    found = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["n"] for r in top], np.int64)[order]


def in_order(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Distinct shingles, rare ones first, and the number of rare ones."""
    h = np.unique(hashes)
    seen = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        seen = np.where(common[at] == h, counts[at], 0)
    return h[np.argsort(seen, kind="stable")], int((seen == 0).sum())


def _needed(similarity: float) -> Column:
    """Shingles that two texts of ``na`` and ``nb`` must share."""
    return F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-6


def _possible(similarity: float) -> Column:
    """Two texts that share the shingle at positions ``ia`` and ``ib`` can share enough."""
    most = F.least("ia", "ib") + 1 + F.least(F.col("na") - 1 - F.col("ia"), F.col("nb") - 1 - F.col("ib"))
    return most >= _needed(similarity)


def _behind(similarity: float) -> Column:
    """Shingles behind the prefix of the larger text."""
    return F.ceil(F.greatest("na", "nb") * F.lit(similarity) - 1e-9) - 1


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets (64-bit hashes) have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= similarity * (len(x) + len(y) - same))
            yield batch.loc[keep, ["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(compare, "a long, b long")


def groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, fingerprints: bool = False) -> DataFrame:
    """doc_id, key (hash of the text) and root (the same for all rows of a group), a row per row.

    Rows of one text are one group. Null texts count as empty; texts without words
    are linked to equal texts only. With ``fingerprints`` texts are also linked as
    ``simhash.near_duplicates`` links them, those without words among them.
    """
    bounded_batches(documents.sparkSession)
    body = text_of(text)

    held = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"))
    common, counts = _common(held, words)

    @F.pandas_udf("struct<prefix:array<bigint>,n:int,rare:int>")
    def prefixes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [in_order(shingle_hashes(t, words), common, counts) for t in batch]
            cuts = [h[: prefix_length(len(h), similarity)].view(np.int64) for h, _ in made]
            yield pd.DataFrame({"prefix": pd.Series(cuts, dtype=object), "n": np.array([len(h) for h, _ in made], np.int32), "rare": np.array([r for _, r in made], np.int32)})

    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(shingle_hashes(t, words)).astype("<u8").tobytes() for t in batch], dtype=object)

    rows = cut(held.select("doc_id", "key"))
    texts = cut(rows.groupBy("key").agg(F.min("doc_id").alias("id")))
    # a row of each text, in most cases the only one: copies must not fill the lists
    repeated = cut(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    slotted = held.withColumn("slot", _slot("key"))
    single = slotted.join(_slots(repeated), "slot", "left_anti").select("key", "text")
    copied = slotted.join(_slots(repeated), "slot", "left_semi").join(texts.select(F.col("key").alias("t_key"), "id"), (F.col("key") == F.col("t_key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    copied = copied.select("key", "text").dropDuplicates(["key"])
    each = single.unionByName(copied)
    read = cut(each.select("key", prefixes.asNondeterministic()("text").alias("p")).select("key", "p.*"))
    index = read.select("key", "n", "rare", F.posexplode("prefix").alias("i", "list"))
    # shingles that the sample calls common, COMMON at most, are counted by partial sums: their lists may hold any share of the texts
    often = index.where("i >= rare")
    sizes = often.groupBy("list").agg(F.count("*").alias("members")).where("members > 1")
    seldom = index.where("i < rare").withColumn("members", F.count("*").over(W.partitionBy("list"))).where("members > 1")
    lists = cut(seldom.unionByName(often.join(F.broadcast(sizes), "list").select(*seldom.columns)))
    short, long_ = lists.where(F.col("members") <= SHORT), cut(lists.where(F.col("members") > SHORT))
    side = lambda d, x, *more: d.select("list", *more, F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}"))

    # lists that are short: all pairs; shingles in long lists may be shared besides those counted
    pairs = side(short, "a").join(side(short, "b"), "list").where("a < b").where(_possible(similarity))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    beside = long_.groupBy(F.col("key").alias("a")).agg(F.count("*").alias("beside"))
    pairs = pairs.join(beside, "a", "left").where(F.col("shared") + F.coalesce("beside", F.lit(0)) + _behind(similarity) >= _needed(similarity)).select("a", "b")
    # long ones: every member with the pivots and, in each list, with another neighbour
    first = F.min(F.struct(F.col("rare") / F.col("n"), "key", "n", "i")).alias("p")
    pivots = long_.groupBy("list", F.pmod(F.xxhash64("key"), F.lit(PIVOTS))).agg(first).select("list", "p.key", "p.n", "p.i")
    met = side(long_, "a").join(side(pivots, "b"), "list").where("a <> b").where(_possible(similarity))
    near = W.partitionBy("list", "part").orderBy(F.xxhash64("key", "list"), "key")
    parts = F.pmod(F.xxhash64("list", "key"), F.ceil(F.col("members") / PART)).cast("int")
    ahead = long_.withColumn("part", parts).select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.lag(F.struct("key", "n", "i")).over(near).alias("o"))
    ahead = ahead.select("a", "na", "ia", F.col("o.key").alias("b"), F.col("o.n").alias("nb"), F.col("o.i").alias("ib")).where("b IS NOT NULL").where(_possible(similarity))
    met = met.select("a", "b").unionByName(ahead.select("a", "b"))
    pairs = cut(pairs.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())

    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(long_.select("key")).distinct())
    one = texts.join(wanted, "key").select(F.col("key").alias("w_key"), "id")
    held = slotted.join(_slots(wanted), "slot", "left_semi").drop("slot")
    held = held.join(one, (F.col("key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = cut(held.dropDuplicates(["key"]).select("key", shingles.asNondeterministic()("text").alias("shingles")))
    edges = _checked(pairs, sets, similarity)
    if fingerprints:
        near = near_duplicates(each, "key")
        edges = edges.unionByName(near.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).where("a <> b"))
    edges = cut(edges)
    roots = components(edges).select(F.col("node").alias("key"), "root")

    # what long lists hold besides: all pairs of texts that are in different groups so far
    apart = long_.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = apart.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("list")
    apart = cut(apart.join(mixed, "list"))
    if not apart.isEmpty():
        # a pair that also meets in a short list is settled above, any other meets in long ones only: their count is whole
        tokens = long_.groupBy(F.col("key").alias("t_key")).agg(F.collect_list("list").alias("t"))
        apart = cut(apart.join(tokens, F.col("key") == F.col("t_key")).drop("t_key"))
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        one_side = side(apart.withColumn("block", F.pmod("key", blocks).cast("int")), "a", "block", F.col("root").alias("ra"), F.col("t").alias("ta"))
        other = side(apart.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))), "b", "block", F.col("root").alias("rb"), F.col("t").alias("tb"))
        both = F.array_intersect("ta", "tb")
        enough = F.size(both) + _behind(similarity) >= _needed(similarity)
        # each pair once: in the first of the lists that it shares
        x, y = one_side.alias("x"), other.alias("y")
        same = (F.col("x.list") == F.col("y.list")) & (F.col("x.block") == F.col("y.block"))
        rest = x.join(y, same & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _possible(similarity) & enough & (F.array_min(both) == F.col("x.list")))
        more = cut(_checked(cut(rest.select("a", "b")), sets, similarity))
        if not more.isEmpty():
            roots = components(edges.unionByName(more)).select(F.col("node").alias("key"), "root")
    return rows.select("doc_id", "key").join(roots, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, fingerprints: bool = False) -> DataFrame:
    """The rows of ``documents`` that stay: of each group the row with the smallest id, whole and unchanged.

    A row with an id stays before one without; among texts of one id the one of the
    smallest key stays, and of wholly repeated rows one.
    """
    found = cut(groups(documents, doc_id, text, words, similarity, fingerprints))
    stay = cut(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m")).select(F.col("m.key").alias("key"), F.col("m.doc_id").alias("id")))
    # texts of groups of one pass by; the rest meets what stays
    crowds = cut(found.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"))
    many = found.select("root", "key").distinct().join(crowds, "root", "left_semi").select("key")
    touched = _slots(many)
    # the rows travel whole, so their columns may have any names
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.xxhash64(text_of(text)).alias("key"), F.col(doc_id).alias("id"))
    rows = rows.withColumn("slot", _slot("key"))
    free = rows.join(touched, "slot", "left_anti")
    s = stay.select(F.col("key").alias("s_key"), F.col("id").alias("s_id"))
    kept = rows.join(touched, "slot", "left_semi").join(s, (F.col("key") == F.col("s_key")) & F.col("id").eqNullSafe(F.col("s_id")), "left_semi")
    return free.select("row.*").unionByName(kept.dropDuplicates(["key", "id"]).select("row.*"))
