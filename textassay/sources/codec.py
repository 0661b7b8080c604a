"""Binary forms of count tables and layers, as other implementations exchange them.

A background file is zlib data of: a magic, the hash version (u8), bits (u8), the
total (u64), then 2 ** bits counters (u32), all big-endian. A layer file, plain
or zlib, holds: a magic, hash version, bits, texts of spam and ham (u32), totals
of spam and ham (u64), then the spam and the ham vector. A header is checked and
a length bounded before anything of that size is unpacked.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HASH_VERSION
from ..functions.ship import ship
from ..operators.layers import CountTable, Layer
from ..params import MAX_BITS

# How the two kinds of file begin.
BACKGROUND_MAGIC, LAYER_MAGIC = b"GSFB\x02", b"GSFC\x03"
_BACKGROUND, _LAYER = struct.Struct(">5sBBQ"), struct.Struct(">5sBBIIQQ")
SLICE = 65536


class FormatError(ValueError):
    """The bytes are not what they should be."""


def inflate(data: bytes, limit: int) -> bytes:
    """zlib data of at most ``limit`` bytes; larger, broken or cut-off data is refused early."""
    engine, out, size = zlib.decompressobj(), [], 0
    rest = data
    try:
        while not engine.eof:
            part = engine.decompress(rest, SLICE)
            rest = engine.unconsumed_tail
            size += len(part)
            if size > limit:
                raise FormatError("the data is larger than announced")
            out.append(part)
            if not part and not rest:
                break
    except zlib.error as e:
        raise FormatError("not zlib data") from e
    if not engine.eof or engine.unused_data:
        raise FormatError("the data is cut off or padded")
    return b"".join(out)


@dataclass(frozen=True)
class Vector:
    """A dense table: bits, total and 2 ** bits counters."""

    bits: int
    total: int
    counts: np.ndarray


def vector_of(data: bytes, total: int | None = None) -> Vector:
    size = len(data) // 4
    if not data or len(data) % 4 or size & (size - 1) or size > 1 << MAX_BITS:
        raise FormatError("a table must hold a power of two of counters")
    counts = np.frombuffer(data, ">u4")
    return Vector(size.bit_length() - 1, int(counts.sum(dtype=np.int64)) if total is None else total, counts)


def dense(rows: pd.DataFrame, column: str, bits: int) -> bytes:
    out = np.zeros(1 << bits, ">u4")
    out[rows["slot"].to_numpy(np.int64)] = rows[column].to_numpy(np.int64).astype(np.uint32)
    return out.tobytes()


def _checked(magic: bytes, expected: bytes, version: int, bits: int, least: int) -> None:
    if magic != expected:
        raise FormatError("not a file of this kind")
    if version != HASH_VERSION:
        raise FormatError(f"made with hash version {version}, this is {HASH_VERSION}")
    if not least <= bits <= MAX_BITS:
        raise FormatError(f"{bits} bits are out of range")


def decode_background(data: bytes) -> Vector:
    """The total is taken from the header."""
    head = zlib.decompressobj()
    try:
        start = head.decompress(data, _BACKGROUND.size)
    except zlib.error as e:
        raise FormatError("not zlib data") from e
    if len(start) < _BACKGROUND.size:
        raise FormatError("no header")
    magic, version, bits, total = _BACKGROUND.unpack(start)
    _checked(magic, BACKGROUND_MAGIC, version, bits, 1)
    body = inflate(data, _BACKGROUND.size + (4 << bits))
    if len(body) != _BACKGROUND.size + (4 << bits):
        raise FormatError("wrong length")
    return Vector(bits, total, np.frombuffer(body, ">u4", offset=_BACKGROUND.size))


def encode_background(table: CountTable) -> bytes:
    """On the driver: a table has 2 ** 24 counters at most."""
    rows = table.counts.toPandas()
    return zlib.compress(_BACKGROUND.pack(BACKGROUND_MAGIC, HASH_VERSION, table.bits, table.total) + dense(rows, "cnt", table.bits), 9)


def encode_layer(layer: Layer, compressed: bool = True) -> bytes:
    rows = layer.counts.toPandas()
    head = _LAYER.pack(LAYER_MAGIC, HASH_VERSION, layer.bits, layer.texts_spam, layer.texts_ham, layer.total_spam, layer.total_ham)
    data = head + dense(rows, "count_spam", layer.bits) + dense(rows, "count_ham", layer.bits)
    return zlib.compress(data, 6) if compressed else data


def decode_layer(spark: SparkSession, data: bytes) -> Layer:
    if not data.startswith(LAYER_MAGIC):
        data = inflate(data, _LAYER.size + (8 << MAX_BITS))
    if len(data) < _LAYER.size:
        raise FormatError("no header")
    magic, version, bits, texts_spam, texts_ham, total_spam, total_ham = _LAYER.unpack_from(data)
    _checked(magic, LAYER_MAGIC, version, bits, 0)
    if len(data) != _LAYER.size + (8 << bits):
        raise FormatError("wrong length")
    both = np.frombuffer(data, ">u4", offset=_LAYER.size).reshape(2, 1 << bits)
    at = np.flatnonzero(both.any(axis=0))
    rows = pd.DataFrame({"slot": at.astype(np.int64), "count_ham": both[1, at].astype(np.int64), "count_spam": both[0, at].astype(np.int64)})
    counts = spark.createDataFrame(rows, "slot long, count_ham long, count_spam long")
    return Layer(counts, bits, texts_ham, texts_spam, total_ham, total_spam)


def table_of(spark: SparkSession, v: Vector) -> CountTable:
    at = np.flatnonzero(v.counts)
    rows = pd.DataFrame({"slot": at.astype(np.int64), "cnt": v.counts[at].astype(np.int64)})
    return CountTable(spark.createDataFrame(rows, "slot long, cnt long"), v.bits, v.total)


def read_backgrounds(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """(lang, bits, total, slot, cnt) of the table files at a path, decoded on the executors; a language is a file's name."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("lang"), "content")
    if languages is not None:
        files = files.where(F.col("lang").isin(languages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, content in zip(batch["lang"], batch["content"], strict=True):
                v = decode_background(bytes(content))
                at = np.flatnonzero(v.counts)
                head = pd.DataFrame({"lang": [lang], "bits": [v.bits], "total": [v.total], "slot": [-1], "cnt": [0]})
                yield head
                for k in range(0, len(at), 1 << 16):
                    part = at[k : k + (1 << 16)]
                    yield pd.DataFrame({"lang": lang, "bits": v.bits, "total": v.total, "slot": part.astype(np.int64), "cnt": v.counts[part].astype(np.int64)})

    return files.mapInPandas(run, "lang string, bits int, total long, slot long, cnt long")
