"""Exact top-k inner products in three phases with a uniform threshold.

Vectors are cut into ``LISTS`` runs of dimensions; each run gives every query a list of
local scores, and a score is the sum over its lists.

1. Each query meets one block of candidates: the local scores are gathered and the k-th
   best full score is a safe cutoff, as at least k candidates reach it.
2. The cutoff t of each query goes to all blocks. A candidate that reaches t has a local
   score of at least t / LISTS in some list, so the entries at or above that uniform
   threshold suffice; a list's entries below it are never looked at again.
3. Only for these entries are the scores of the remaining lists resolved, exactly, and
   the k best stay. ``counted`` tells how many scores were resolved.

A candidate block is placed once and held by its task while the blocks of queries pass
by one at a time: no candidate is sent once per query block, and a task holds one block
of each kind whatever the table's size. Queries are sent to every candidate block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import batches_of, cut, ship

LISTS = 2
#: Queries of a block, and the least and most candidates of one; local scores that are held at once.
QUERY_BLOCK, ROW_BLOCK, MOST_ROWS, AT_ONCE = 512, 4096, 32768, 1 << 22
#: Blocks that a Python worker is given at once.
BATCH = 8
#: Components become floor(SCALE * x).
SCALE = 256
#: Sums of products below this are exact in doubles.
_EXACT = 2.0**53
_LONG = 2**63

_BLOCK = "block int, ids binary, vectors binary, width int, wide boolean"
_FOUND = "query_id long, vec_id long, score long, resolved long, pairs long"


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Usable rows once each: id and vector not null, components present and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.forall("v", fine)).dropDuplicates(["vec_id", "v"])


def whole(x: float) -> int:
    """floor(SCALE * x) without overflow: doubles from 2**53 on are whole numbers."""
    return int(x) * SCALE if abs(x) >= _EXACT else int(np.floor(SCALE * x))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A block as raw numbers; the doubles themselves where a product could leave the range that doubles hold exactly."""
    width = max(len(v) for v in rows["v"])
    m = np.zeros((len(rows), width))
    for k, v in enumerate(rows["v"]):
        m[k, : len(v)] = np.asarray(v, np.float64)
    wide = bool(np.abs(m).max(initial=0) >= 2.0**40)
    m = m if wide else np.floor(SCALE * m)
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [m.tobytes()], "width": [width], "wide": [wide]})


def blocks(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt by the hash of their id over n blocks of raw numbers."""
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("block").applyInPandas(_pack, _BLOCK)


class Block:
    """Ids and components of a block; ``exact`` gives Python integers where doubles would round."""

    def __init__(self, ids: bytes, vectors: bytes, width: int, wide: bool) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.rows, self.wide = np.frombuffer(vectors, np.float64).reshape(len(self.ids), width), wide
        self.most = float(np.abs(self.rows).max(initial=0)) if not wide else np.inf

    def padded(self, width: int) -> np.ndarray:
        return np.pad(self.rows, ((0, 0), (0, width - self.rows.shape[1])))

    def exact(self, width: int) -> np.ndarray:
        turn = whole if self.wide else int
        return np.array([[turn(x) for x in v] for v in self.padded(width)], dtype=object).reshape(len(self.ids), width)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def above(q: Block, r: Block, cutoff: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int], int]]:
    """(place of the query, ids, scores, scores resolved) of up to k rows of a block that may reach each query's cutoff."""
    width = max(q.rows.shape[1], r.rows.shape[1], 1)
    if q.most * r.most * width >= _EXACT:
        a, b = q.exact(width), r.exact(width)
        for n in range(len(q.ids)):
            total = [min(max(int(s), -_LONG), _LONG - 1) for s in b @ a[n]]
            at = sorted((x for x in range(len(total)) if r.ids[x] != q.ids[n]), key=lambda x: (-total[x], r.ids[x]))[:k]
            yield n, r.ids[at], [total[x] for x in at], len(total)
        return
    a, b = q.padded(width), r.padded(width)
    runs = [(c[0], c[-1] + 1) for c in np.array_split(np.arange(width), min(LISTS, width))]
    step = max(1, AT_ONCE // max(len(b), 1))
    for first in range(0, len(a), step):
        some = slice(first, first + step)
        lists = [a[some, x:y] @ b[:, x:y].T for x, y in runs]
        # doubles divide by LISTS with a rounding that must not lose an entry at the threshold
        limit = np.nextafter(cutoff[some] / len(lists), -np.inf)[:, None]
        enough = lists[0] >= limit
        for part in lists[1:]:
            enough |= part >= limit
        enough &= q.ids[some, None] != r.ids[None, :]
        for n in range(len(enough)):
            at = np.flatnonzero(enough[n])
            scores = sum(part[n, at] for part in lists)
            keep = _best(scores, r.ids[at], k)
            keep = keep[scores[keep] >= cutoff[first + n]]
            yield first + n, r.ids[at[keep]], [int(s) for s in scores[keep]], len(at)


def _gather(k: int):
    """Phase 1: the k-th best score of each query within the block that it meets, or none if there are fewer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for row in batch.itertuples():
                block = Block(row.ids, row.vectors, row.width, row.wide)
                if row.kind == 0:
                    held = (row.at, block)
                elif held is not None and held[0] == row.at:
                    found = list(above(block, held[1], np.full(len(block.ids), -np.inf), k))
                    full = [(n, scores[-1]) for n, _, scores, _ in found if len(scores) == k]
                    yield pd.DataFrame({"query_id": block.ids[[n for n, _ in full]], "cutoff": np.array([s for _, s in full], np.int64)})

    return run


def _resolve(k: int):
    """Phases 2 and 3 for the blocks of a task: each candidate block is held while all query blocks pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for row in batch.itertuples():
                block = Block(row.ids, row.vectors, row.width, row.wide)
                if row.kind == 0:
                    held = (row.at, block)
                    continue
                if held is None or held[0] != row.at:
                    continue
                cutoff = np.frombuffer(row.cutoffs, np.float64)
                found = list(above(block, held[1], cutoff, k))
                rows = [(block.ids[n], i, s, 0, 0) for n, ids, scores, _ in found for i, s in zip(ids.tolist(), scores, strict=True)]
                rows.append((0, 0, 0, sum(x[3] for x in found), len(block.ids) * len(held[1].ids)))
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "resolved", "pairs"]).astype("int64")

    return run


def _meet(rows: DataFrame, asked: DataFrame, tasks: int) -> DataFrame:
    """Each candidate block, then the query blocks sent to it, in one task."""
    return rows.unionByName(asked).repartitionById(tasks, F.col("at")).sortWithinPartitions("kind", "block")


def _with_cutoffs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for row in batch.itertuples():
            known = dict(zip(row.c_ids, row.c_scores, strict=True)) if row.c_ids is not None else {}
            made.append(np.array([known.get(i, -np.inf) for i in np.frombuffer(row.ids, np.int64).tolist()], np.float64).tobytes())
        yield batch[["block", "ids", "vectors", "width", "wide"]].assign(cutoffs=made)


def counted(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The entries found, (query_id, vec_id, score), up to k for each query and block; and (resolved, pairs) of the meetings of phase 2.

    Runs at once, since blocks need smaller Arrow batches than a session has for rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows, asked = quantised(vectors, vec_id, embedding), quantised(queries, vec_id, embedding)
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    n_r, n_q = max(1, -(-n // MOST_ROWS), min(-(-n // ROW_BLOCK), 2 * cores)), max(1, -(-asked.count() // QUERY_BLOCK))
    none = F.lit(None).cast("binary")
    held = cut(blocks(rows, n_r)).withColumn("at", F.col("block")).withColumn("kind", F.lit(0)).withColumn("cutoffs", none)
    sets = cut(blocks(asked, n_q))
    with batches_of(spark, BATCH):
        first = sets.withColumn("at", F.pmod("block", F.lit(n_r))).withColumn("kind", F.lit(1)).withColumn("cutoffs", none)
        cutoffs = _meet(held, first, n_r).mapInPandas(_gather(k), "query_id long, cutoff long")
        # vectors of one id share a result, so the best of their cutoffs counts
        best = cutoffs.groupBy("query_id").agg(F.max("cutoff").alias("cutoff")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int"))
        best = best.groupBy("block").agg(F.collect_list("query_id").alias("c_ids"), F.collect_list("cutoff").alias("c_scores"))
        asking = cut(sets.join(best, "block", "left").mapInPandas(_with_cutoffs, f"{_BLOCK}, cutoffs binary"))
        asking = asking.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1)))).withColumn("kind", F.lit(1))
        found = cut(_meet(held, asking, n_r).mapInPandas(_resolve(k), _FOUND))
    return found.where("pairs = 0").select("query_id", "vec_id", "score"), found.where("pairs > 0").select("resolved", "pairs")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries``, its own id left out.

    Vectors that are null or hold null or non-finite components, and rows without an
    id, take no part; a shorter vector counts as padded by zeros. A repeated row
    counts once; rows of one id with different vectors all count, and as queries share
    one result. Ties go to the smaller vec_id. Fewer than k candidates give all. Scores
    beyond the range of a long are clipped to it.
    """
    found, _ = counted(vectors, queries, k, vec_id, embedding)
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
