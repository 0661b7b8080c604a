"""License texts by diagonal voting, with DataFrame functions only.

Every word k-gram (k = 2) of every text is hashed and joined to the positions
of the same k-gram in a fixed library of license templates. Hits of a document
and template vote for their offset diagonal (document position less template
position). Neighbouring diagonals of a notice are merged, which bridges
inserted or missing words; a span is accepted when the merged diagonals cover
enough of the template in not too many words. Two- and three-word phrases must
lie on one diagonal without a gap.

The template table has a few hundred rows whatever the corpus holds, so it is
broadcast. All hits of a document meet by one shuffle on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import literal_rows, text_of

#: What separates words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases, counted at every place, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Public license notices, as lower-case words, and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("gnu affero general public license as published by the free software foundation", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("released under the mit license", "mit"),
    ("boost software license version 1 0", "boost"),
    ("eclipse public license version 2 0", "epl"),
]

# Words so common that a pair of them votes for nothing.
COMMON = ("a and any as at be by for free in is it may not of or that the this to with you".split())

#: Share of a notice's k-grams that a span must cover.
MIN_COVER = 0.75
#: A notice of at most this many words must be covered whole.
WHOLE_WORDS = 16
#: Diagonals at most this far apart belong to one notice.
MERGE_GAP = 3
#: A span may be this many times as long as its notice: its diagonals are at most the rest apart.
MAX_STRETCH = 1.5


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def template_positions(spark) -> DataFrame:
    """template, label, kind, n_words, n_grams, tpos, gram: a row for each voting k-gram.

    Template -1 stands for the end mark of a document: its diagonal is the word count.
    """
    rows = [(k, label, kind, text) for k, (kind, text, label) in enumerate([("phrase", *p) for p in PHRASES] + [("notice", *n) for n in NOTICES])]
    t = literal_rows(spark, rows, ["template", "label", "kind", "text"]).withColumn("words", F.split("text", " "))
    t = t.select("template", "label", "kind", F.size("words").cast("long").alias("n_words"), F.posexplode(bigrams(F.col("words"))).alias("tpos", "gram"))
    w = F.split("gram", " ")
    t = t.where((F.col("kind") == "phrase") | ~(w[0].isin(COMMON) & w[1].isin(COMMON)))
    t = t.withColumn("n_grams", F.count("*").over(W.partitionBy("template")))
    ends = literal_rows(spark, [(-1, "", "end", 0, 1, 0, " 0"), (-1, "", "end", 0, 1, -1, " 1")], ["template", "label", "kind", "n_words", "n_grams", "tpos", "gram"])
    return t.select("template", "label", "kind", "n_words", "n_grams", "tpos", "gram").unionByName(ends)


def votes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, template, ..., diagonal, tset (template positions), copies of the row."""
    words = words_of(text_of(text))
    base = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), words.alias("words"))
    end = F.when(F.size("words") == 0, F.lit(" 0")).otherwise(F.lit(" 1"))
    grams = base.select("doc_id", "text_hash", F.posexplode(F.concat(bigrams(F.col("words")), F.array(end))).alias("dpos", "gram"))
    positions = F.broadcast(template_positions(documents.sparkSession).withColumn("h", F.xxhash64("gram")).withColumnRenamed("gram", "tgram"))
    hits = grams.withColumn("h", F.xxhash64("gram")).join(positions, "h").where(F.col("gram") == F.col("tgram"))
    hits = hits.select("doc_id", "text_hash", "template", "label", "kind", "n_words", "n_grams", "tpos", "dpos").repartition("doc_id", "text_hash")
    key = ["doc_id", "text_hash", "template", "label", "kind", "n_words", "n_grams", (F.col("dpos") - F.col("tpos")).cast("long").alias("diagonal")]
    return hits.groupBy(*key).agg(F.collect_set("tpos").alias("tset"), F.count("*").alias("hits"))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans: start (in words), cover, kind, label; the end mark of each document stays.

    Each diagonal of a run opens a span that takes in the diagonals up to half a notice's
    length behind it (``MAX_STRETCH``), so its words cannot exceed the stretch; the best
    covered span of the run stands for it.
    """
    near = W.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = (F.col("kind") != "notice") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > MERGE_GAP, F.lit(True))
    v = voted.withColumn("run", F.sum(apart.cast("int")).over(near))
    # diagonals of a run are whole numbers in order, so no more rows than the widest slack are near enough
    slack = F.floor(F.col("n_words") * (MAX_STRETCH - 1))
    ahead = near.rowsBetween(W.currentRow, max(int(len(text.split()) * (MAX_STRETCH - 1)) for text, _ in NOTICES))
    part = F.collect_list(F.struct("run", "diagonal", "tset")).over(ahead)
    inside = F.filter("ahead", lambda x: (x["run"] == F.col("run")) & (x["diagonal"] <= F.col("diagonal") + slack))
    several = (F.col("kind") == "notice") & (F.lead("run").over(near) == F.col("run"))
    v = v.withColumn("several", F.coalesce(several, F.lit(False))).withColumn("ahead", part)
    covered = F.when(F.col("several"), F.size(F.array_distinct(F.flatten(F.transform(inside, lambda x: x["tset"]))))).otherwise(F.size("tset"))
    v = v.withColumn("cover", covered / F.col("n_grams")).withColumn("start", F.col("diagonal") + F.array_min("tset"))
    v = v.groupBy("doc_id", "text_hash", "template", "label", "kind", "n_words", "run").agg(F.max("cover").alias("cover"), F.min("start").alias("start"), F.min("diagonal").alias("diagonal"), F.max("hits").alias("hits"))
    enough = F.when((F.col("kind") == "phrase") | (F.col("n_words") <= WHOLE_WORDS), F.lit(1.0)).otherwise(F.lit(MIN_COVER))
    return v.where((F.col("kind") == "end") | (F.col("cover") >= enough))


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text counts as empty: no words, null places, empty labels, score 0.
    Repeated rows give repeated results; rows of one id with different texts are
    told apart by text. Columns beyond id and text play no part. Ties cannot
    occur: labels are sorted sets and score is a maximum.
    """
    s = spans(votes(documents, doc_id, text))
    phrase, found = F.col("kind") == "phrase", F.col("kind") != "end"
    joined = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    out = s.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(~found, F.col("diagonal"))).alias("n_words"),
        F.max(F.when(~found, F.col("hits"))).alias("copies"),
        F.sum(F.when(phrase, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(phrase, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.col("start"))).cast("long").alias("last_word"),
        joined(phrase).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("cover"))), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
