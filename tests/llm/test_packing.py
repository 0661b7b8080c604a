import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from textassay.llm.packing import default_vocabulary, piece_lengths, pieces, write_buckets
from textassay.llm.queries import QUERIES

from .helpers import clashing, documents


def exact():
    return Tokenizer.from_file(default_vocabulary())


def test_lengths():
    for n in range(1, 5000):
        cut = piece_lengths(n)
        assert sum(cut) == n and all(x == 1024 or x & (x - 1) == 0 and x < 1024 for x in cut) and cut == sorted(cut, reverse=True)
        assert len(set(x for x in cut if x < 1024)) == len([x for x in cut if x < 1024])


def test_query_round_trip(spark, small):
    """Every id of every document, as the tokenizers library gives them, lies in exactly one piece."""
    t = exact()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op4_packing"](spark, small).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts) and len({r["sequence_id"] for r in got}) == len(got)
    for i, cut in by.items():
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(cut, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["offset"], 1 << r["bucket"]) == (at, len(ids), 0, r["length"])
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


ODD = ["<|endoftext|> x", "tab\tand  spaces   \n\n end ", "免费赚钱 🙂 é", "\x1c\x85 a　b", "don't we'll I'M 123abc 4½", "﻿​­", "a" * 5000, "퟿"]


def test_odd_texts_encode_alike(spark):
    t = exact()
    df = clashing(documents(spark, list(enumerate(ODD)) + [(100, None), (100, None), (None, "")]))
    got = pieces(df.withColumnRenamed("size", "bucket2"), with_ids=True)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for k, text in enumerate(ODD):
        ids = [x for _, part in sorted(by[k]) for x in part]
        assert ids == [*t.encode(text, add_special_tokens=False).ids, 0], text
    assert by[100] == [(0, [0]), (0, [0])] and by[None] == [(0, [0])]
    copies = pieces(documents(spark, [(1, "one two three")] * 3).repartition(2), limit=2).collect()
    by_row = {}
    for r in copies:
        by_row.setdefault(r["row_id"], []).append((r["start"], r["length"]))
    assert len(by_row) == 3 and len({tuple(sorted(x)) for x in by_row.values()}) == 1
    assert pieces(df.limit(0)).count() == 0


def test_limits_and_buckets(spark, tmp_path):
    with pytest.raises(ValueError):
        pieces(documents(spark, [(1, "x")]), limit=1000)
    packed = pieces(documents(spark, [(1, "one two three four five six")]), limit=4)
    assert {r["length"] for r in packed.collect()} <= {1, 2, 4}
    write_buckets(packed, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == packed.count()
