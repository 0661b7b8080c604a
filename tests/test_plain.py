"""Plain texts in numpy give what the chain of generators gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textassay.functions import plain
from textassay.functions.hashing import feature_hash
from textassay.operators import features as fx
from textassay.params import ExtractParams

from .test_features import LINKS, MAILS, MARKS, NOTHING, TAGS, WORDS

EVERY = [chr(c) for c in range(0x2100) if plain._STABLE_TEXT.match(chr(c))]


def made_up(n):
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "ß", "É", "x1", "42", "Σ", "ς", "日", "ａ", "€", "£", "!", ".", ",", " ", " ", "\n", "_", "-", "'", "’", "@", "&", "&amp;", "<b>", "www.", ".de", "http://h.example/p", "…"]
    return ["".join(rng.choices(alphabet, weights=[6] * 7 + [1] * (len(alphabet) - 7), k=rng.randrange(30))) for _ in range(n)]


def texts(spark):
    some = [t[0] for t in (*WORDS, *MARKS, *LINKS, *MAILS, *TAGS)] + NOTHING + made_up(300)
    some += [f"a{c}b {c} {c}{c}{c} AB{c} {c}. B" for c in EVERY] + ["x" * 70 + " y", "a" * 64 + ".b", "a. " * 100, "Q1." * 200 + " x"]
    return spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")


@pytest.mark.parametrize("mode,params", [("md5", ExtractParams()), ("xxh3", ExtractParams(word_bigrams=False)), ("md5", ExtractParams(char_ngrams="all", min_word=1, max_word=3)), ("md5", ExtractParams(min_word=1, max_word=3))])
def test_packed_bags_are_those_of_the_chain(spark, mode, params):
    rows = texts(spark)
    bags = fx.packed(rows, "doc_id", mode=mode, params=params)
    assert bags.count() == rows.count()
    got = {tuple(r) for r in fx.unpacked(bags, "doc_id").collect()}
    met = fx.met(rows, "doc_id", params=params).groupBy("doc_id", feature_hash(F.col("feature"), mode).alias("h")).agg(F.count("*").alias("cnt"))
    wanted = {tuple(r) for r in met.collect()}
    assert got == wanted


def test_most_characters_are_plain_and_words_are_forgotten(monkeypatch):
    assert len(EVERY) > 500 and all(plain.is_plain(f"a{c}b") for c in EVERY if c not in "@\xad\u019b")
    some = [t for t in made_up(300) if plain.is_plain(t)]
    whole = plain.Extractor(2, 40, True).hashed(some, "md5")
    monkeypatch.setattr(plain, "MOST_WORDS", 3)
    monkeypatch.setattr(plain, "CHUNK", 50)
    parts = plain.Extractor(2, 40, True).hashed(some, "md5")
    assert len(some) > 50 and all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_a_repeated_id_is_one_bag(spark):
    rows = spark.createDataFrame([(1, "tea tea"), (1, "tea"), (2, "tea")], "doc_id long, text string")
    assert sorted(r["cnt"] for r in fx.hashed_bags(rows, mode="md5").collect()) == [1, 1, 3]


def test_bytes_that_are_no_text_go_through_the_chain(spark):
    rows = spark.sql("SELECT 1L AS doc_id, CAST(X'746561FF' AS STRING) AS text")
    wanted = fx.bags(rows).select(feature_hash(F.col("feature"), "md5").alias("h"), "cnt").collect()
    assert len(wanted) > 1 and sorted(fx.hashed_bags(rows, mode="md5").select("h", "cnt").collect()) == sorted(wanted)
