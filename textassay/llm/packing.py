"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces whose lengths are the limit and the
powers of two in the binary form of the rest. Each piece is a sequence of its
own, so no sequence crosses documents and none needs padding; sequences of one
length form a bucket, from which batches of equal shape are drawn. No row moves
between tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of

MAX_TOKENS = 1024
END_ID = 0

#: Texts of these characters only take the fast byte-pair path; others go to the tokenizers library.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7E\xA1-\xAC\xAE-\xFF" + chr(0x100) + "-" + chr(0x24F) + "]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """text -> token ids as a uint32 array, equal to the tokenizers library's ids without special tokens added.

    Byte-pair ranks of this vocabulary are its ids, so plain texts can be encoded by
    tiktoken, several times faster. Texts that hold other characters or the text of a
    special token are left to the tokenizers library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _PLAIN.search(text) or any(s in text for s in special):
            return np.asarray(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    return encode


def piece_lengths(tokens: int, limit: int = MAX_TOKENS) -> list[int]:
    """Whole limits, then the powers of two of the rest, largest first."""
    rest = tokens % limit
    return [limit] * (tokens // limit) + [1 << b for b in range(limit.bit_length(), -1, -1) if rest >> b & 1]


def pieces(documents: DataFrame, text: str = "text", vocabulary: str | None = None, limit: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """A row per piece: the columns of ``documents`` but the text, then row_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, bucket (log2 of length) and, on demand, ids.

    ``limit`` must be a power of two. A null or empty text has one piece: the end id.
    Each repeated row is packed as a document of its own, and a very long text gives
    many pieces of ``limit``. Columns of ``documents`` that have one of the names
    above are dropped. row_id tells the rows of ``documents`` apart, those that repeat one
    id or text too; it and sequence_id are unique, not dense.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    bounded_batches(documents.sparkSession)
    path = vocabulary or default_vocabulary()
    fields = "start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint" + ",ids:array<int>" * with_ids

    @F.pandas_udf(f"array<struct<{fields}>>")
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for batch in batches:
            out = []
            for t in batch:
                ids = np.append(encode(t), np.uint32(END_ID)).astype("<u4")
                raw, at, rows = ids.tobytes(), 0, []
                for n in piece_lengths(len(ids), limit):
                    row = {"start": at, "length": n, "ids_crc32": zlib.crc32(raw[4 * at : 4 * (at + n)]), "doc_tokens": len(ids)}
                    rows.append(row | ({"ids": ids[at : at + n].tolist()} if with_ids else {}))
                    at += n
                out.append(rows)
            yield pd.Series(out)

    made = ["row_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"]
    keep = [c for c in documents.columns if c not in (text, *made)]
    rows = documents.select(*keep, F.monotonically_increasing_id().alias("row_id"), F.col(text))
    out = rows.select(*keep, "row_id", F.inline(cut_up.asNondeterministic()(text_of(text))))
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences so that each folder holds sequences of one length."""
    packed.write.partitionBy("bucket").parquet(path)
