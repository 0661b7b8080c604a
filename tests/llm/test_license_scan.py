import random
import re

from textassay.llm.license_scan import COMMON, MAX_STRETCH, MERGE_GAP, MIN_COVER, NOTICES, WHOLE_WORDS, scan

from .helpers import clashing, documents, rows

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None,
    "",
    "!!!",
    "word",
    "MIT License",
    "mit license mit license, MIT\nLicense",
    "mit-license/apache_license general public license",
    "general public, license. general public public license",
    "Émit license mitlicense mit licenses",
    NOTICES[0][0].upper(),
    "x " * 3000 + "Released under the MIT License. " + "y " * 3000,
    "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    # one word missing, two others put in between
    NOTICES[0][0].replace("associated ", "").replace("publish", "publish print sell"),
    "redistribution and use in source and binary forms",
    # verbatim, among words of its own that stand again and again
    "the software " * 30 + NOTICES[0][0] + " the software" * 30,
    NOTICES[3][0] + " of the license" * 200,
    # the same words, never a notice
    "the software " * 200 + "of this software " * 50,
]


def test_base_places_against_brute_force(spark):
    got = scan(documents(spark, list(enumerate(TEXTS)))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_notices(spark):
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan(documents(spark, list(enumerate(TEXTS)))).collect()}
    assert got[0] == got[3] == ("", 0.0)
    assert got[9] == ("mit", 1.0) and got[10] == ("mit", 1.0) and got[11] == ("cc-by-nc", 1.0)
    assert got[12][0] == "apache" and got[13][0] == "gpl"
    assert got[14][0] == "mit" and 0.75 <= got[14][1] < 1
    assert got[15] == ("", 0.0)
    assert got[16] == ("mit", 1.0) and got[17][0] == "gpl" and got[18] == ("", 0.0)


def test_spans_against_brute_force(spark):
    """Notices with words put in, left out and said again: the best covered span within the stretch, by trying them all."""
    rng = random.Random(6)
    texts = []
    for k in range(60):
        words = NOTICES[k % 9][0].split()
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(0, 3)] = rng.choice([[], ["word"], ["the", "software"], words[at : at + 4]])
        texts.append(" ".join(["x"] * rng.randrange(5) + words + words[: rng.randrange(0, 20)]))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in scan(documents(spark, list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        assert got[k] == brute_labels(text), text


def brute_labels(text):
    words = text.split()
    labels, best = set(), 0.0
    for template, kind in [(p, "phrase") for p in PHRASES.items()] + [(n, "notice") for n in NOTICES]:
        t = template[0].split()
        grams = [(k, a, b) for k, (a, b) in enumerate(zip(t, t[1:], strict=False)) if kind == "phrase" or not (a in COMMON and b in COMMON)]
        hits = {}
        for d, pair in enumerate(zip(words, words[1:], strict=False)):
            for k, a, b in grams:
                if pair == (a, b):
                    hits.setdefault(d - k, set()).add(k)
        slack = int(len(t) * (MAX_STRETCH - 1)) if kind == "notice" else 0
        for first in hits:
            seen, last = set(), first
            for d in sorted(x for x in hits if first <= x <= first + slack):
                if d - last > MERGE_GAP:
                    break
                seen, last = seen | hits[d], d
            cover = len(seen) / len(grams)
            if cover >= (1.0 if kind == "phrase" or len(t) <= WHOLE_WORDS else MIN_COVER):
                labels.add(template[1])
                best = max(best, cover)
    return ",".join(sorted(labels)), round(best, 9)


def test_awkward_rows(spark):
    df = documents(spark, [(1, "mit license"), (1, "mit license"), (1, "apache license"), (None, "mit license"), (None, None)])
    got = rows(scan(clashing(df)), "doc_id", "n_base", "labels")
    assert got == sorted([(1, 1, "mit"), (1, 1, "mit"), (1, 1, "apache"), (None, 1, "mit"), (None, 0, "")], key=repr)
    assert scan(df.limit(0)).count() == 0


def test_no_python_on_the_executors(spark, small):
    df = scan(spark.read.parquet(f"{small}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
