"""SimHash fingerprints and near-duplicate groups by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes, each at its position. Two fingerprints
that differ in at most two bits share at least six positional bytes. Posting lists
of single bytes would hold N / 256 fingerprints each, so a list is keyed by four
positional bytes: the 14 ``BLOCKS`` of the Steiner system S(3, 4, 8), in which every
three positions lie in exactly one block. Of these, two fingerprints share at least
three if they differ in at most two bytes, and at most one if they differ in three or
more. So the tally of the lists in which a pair meets tells whether six positional
bytes are shared: pairs below the guaranteed minimum of three go, and the bits of the
others are counted.

A list longer than ``LIST_CAP`` would give pairs by the square of its length. It is
split by two further positional bytes, in all ways that have four of the six bytes in
a block; each such list of six bytes stands for the three blocks that it holds. If a
list of six bytes is still too long, it is split by bit positions: members send
themselves to their own value and to the 64 values one bit away, and at most 65 meet
at one of these, all within two bits of each other. No member is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, text_of
from .graph import components

#: Longest posting list whose pairs are formed; longer ones are split by further positions.
LIST_CAP = 48
#: Bits that linked fingerprints may differ in, and posting lists in which they then meet at least.
MAX_BITS, MIN_LISTS = 2, 3
SEED = 42


def _blocks() -> list[tuple[int, ...]]:
    """Sets of four of eight positions, numbered as vectors of three bits, that add up to 0 (bitwise)."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


#: Positions of the posting lists, and those of the lists that long ones are split into.
BLOCKS = _blocks()
SIXES = list(combinations(range(8), 6))


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of each run of ``words`` words (repeats included), words lower-cased in A-Z, split at ASCII white space."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    runs = zip(*(w[k:] for k in range(words)), strict=False) if len(w) >= words else [w]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    total = np.zeros(64, np.int64)
    for k in range(0, n, 255):  # sums of 255 ones fit in a byte
        total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def with_fingerprint(documents: DataFrame, text: str = "text", words: int = 3, name: str = "fingerprint") -> DataFrame:
    """``documents`` with a signed 64-bit ``name``; no words give 0."""
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([majority(shingle_hashes(t, words)) for t in batch], np.uint64).view(np.int64))

    return documents.withColumn(name, run.asNondeterministic()(text_of(text)))


def _bytes(name: str, positions: tuple[int, ...]) -> Column:
    """The bytes at these positions; the others are 0."""
    mask = sum(0xFF << 8 * k for k in positions)
    return F.col(name).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def postings(name: str, sets: list[tuple[int, ...]]) -> Column:
    """array of (list, bytes): the lists that hold a fingerprint, one for each set of positions."""
    return F.array(*[F.struct(F.lit(n).alias("list"), _bytes(name, c).alias("bytes")) for n, c in enumerate(sets)])


def _pairs(lists: DataFrame) -> DataFrame:
    """(lists, a, b) of all pairs of the members of each list, a < b."""
    gathered = lists.groupBy("list", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    each = gathered.select("list", "l", F.posexplode("l").alias("k", "a"))
    return each.select("list", "a", F.explode(F.slice("l", F.col("k") + 2, LIST_CAP)).alias("b"))


def _split(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of two members at least, up to ``LIST_CAP`` and longer ones. Counts are made before members meet."""
    sizes = lists.groupBy("list", "bytes").agg(F.count("*").alias("members")).where("members > 1")
    held = cut(lists.join(sizes, ["list", "bytes"]))
    return held.where(F.col("members") <= LIST_CAP).drop("members"), held.where(F.col("members") > LIST_CAP).drop("members")


def tallied(fingerprints: DataFrame, name: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(a, b, lists) of the pairs that meet, with the number of posting lists in which they do; and (at, l): members of
    lists of six bytes that were split by bit positions, met at a value. ``fingerprints`` holds each value once.
    """
    values = fingerprints.select(F.col(name).alias("fp"))
    short, long_ = _split(values.select("fp", F.inline(postings("fp", BLOCKS))))
    met = _pairs(short).select("a", "b", F.expr("shiftleft(1, list)").alias("lists"))
    # each long list by two further positions; lists of six bytes that several blocks lead to are one
    leads = F.array(*[F.array(*[F.lit(n) for n, six in enumerate(SIXES) if set(block) <= set(six)]) for block in BLOCKS])
    further = long_.select("fp", F.explode(F.get(leads, F.col("list"))).alias("n")).distinct()
    further = further.select("fp", F.col("n").alias("list"), F.get(postings("fp", SIXES), F.col("n"))["bytes"].alias("bytes"))
    few, many = _split(further)
    held = F.array(*[F.lit(sum(1 << n for n, block in enumerate(BLOCKS) if set(block) <= set(six))) for six in SIXES])
    met = met.unionByName(_pairs(few).select("a", "b", F.get(held, F.col("list")).alias("lists")))
    tally = met.groupBy("a", "b").agg(F.bit_count(F.bit_or("lists")).alias("lists"))
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]
    crowd = many.select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("at"))
    return tally, crowd.groupBy("at").agg(F.collect_set("fp").alias("l")).where(F.size("l") > 1)


def links(fingerprints: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Edges (a, b) with the same components as all pairs at ``MAX_BITS`` or fewer differing bits.

    ``fingerprints`` holds each value once.
    """
    tally, crowd = tallied(fingerprints, name)
    pairs = tally.where(F.col("lists") >= MIN_LISTS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    stars = crowd.select(F.array_min("l").alias("a"), F.explode("l").alias("b")).where("a <> b")
    return pairs.select("a", "b").unionByName(stars).distinct()


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint (signed), component_id.

    component_id is the smallest doc_id that links reach, own included. Null texts
    count as empty; texts without words have fingerprint 0 and are linked like
    others. Rows with a null id take part; a component of such rows only has a null
    component_id. Repeated rows and copies share one fingerprint and are never paired.
    """
    rows = with_fingerprint(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words)
    rows = cut(rows.select("doc_id", "fingerprint"))
    first = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(first)).select(F.col("node").alias("fingerprint"), "root")
    grouped = cut(first.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    lowest = cut(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")))
    member = cut(grouped.join(lowest, "root").select("fingerprint", "component_id"))
    return rows.join(member, "fingerprint").select("doc_id", "fingerprint", "component_id")
