import pytest

from textassay.functions.text import CLAUSE_ENDS, HTML_ELEMENTS, chars, decode_entities
from textassay.operators import features as fx
from textassay.params import ExtractParams

#: (text, what its bag holds, what it lacks) with default parameters.
WORDS = [
    ("Tea tea TEA", {"w:tea": 3, "caps:": 1, "w2:tea_tea": 2}, ["w:TEA", "w:Tea"]),
    ("crème brûlée / crème brûlée", {"w:crème": 2, "w:brûlée": 2}, []),
    ("red wine; red wine", {"w2:red_wine": 2}, ["w2:wine_red"]),
    ("room 42 is free", {"num:2": 1, "w2:is_free": 1}, ["w2:room_is", "w:42"]),
    ("99999999999999 1", {"num:12": 1, "num:1": 1}, ["num:14"]),
    ("A4 is B2B, not b2b", {"w:a4": 1, "w:b2b": 2, "caps:": 1}, []),
    ("we're off", {"w:we": 1, "w:re": 1, "w2:we_re": 1}, []),
    ("go a way", {"w:go": 1, "w:way": 1}, ["w:a", "w2:go_way"]),
    ("tom-and_jerry", {"w2:tom_and": 1, "w2:and_jerry": 1}, []),
    ("end.Start (and) [so] {on}", {"w:end": 1, "w:start": 1}, ["w2:end_start", "w2:start_and"]),
    ("left\nright", {"w:left": 1}, ["w2:left_right"]),
    ("left\tright", {"w2:left_right": 1}, []),
    ("y" * 40 + " " + "z" * 41, {"w:" + "y" * 40: 1}, ["w:" + "z" * 41]),
    ("ПРИВЕТ мир", {"w:привет": 1, "caps:": 1, "w2:привет_мир": 1}, []),
]
MARKS = [
    ("Stop! Now!! £3 and ¥4", {"punct:!": 3, "sym:£": 1, "sym:¥": 1}, []),
    ("what？really！", {"w:what": 1, "w:really": 1}, ["punct:!", "w2:what_really"]),
    ("one…two", {"w:one": 1, "w:two": 1}, ["w2:one_two"]),
    ("dis​count co­operate", {"w:discount": 1, "w:cooperate": 1}, []),
    ("ﬁne ２０", {"w:fine": 1, "num:2": 1}, []),
    ("salt &amp; pepper &Eacute;t&eacute; &#x263A;", {"w:été": 1, "w:salt": 1}, ["w:amp"]),
    ("&amp;gt;&amp;copy;", {"w:gt": 1, "w:copy": 1}, []),
]
LINKS = [
    ("Look at HTTP://WWW.Old-Shop.example.org/new/Hats.html?c=3#top please", {"url:": 1, "tld:org": 1, "path:new": 1, "path:hats": 1, "path:html": 1, "w2:at_please": 1}, ["w:shop", "path:c", "path:top"]),
    ("from www.a-b.example:8443/x%20y", {"url:": 1, "host:a-b.example": 1, "path:x": 1, "path:20y": 1}, []),
    ("ask docs.example.net. Then rest.example.net/api!", {"url:": 2, "host:docs.example.net": 1, "host:rest.example.net": 1, "tld:net": 2, "path:api": 1}, ["punct:!"]),
    ("mine (foo.example) yours", {"host:foo.example": 1, "w:mine": 1}, ["w2:mine_yours"]),
    ("open http://ann@site.example/p now", {"host:site.example": 1, "w2:open_now": 1}, ["mail:site.example"]),
    ("http://site.example:99x/p", {"url:": 1}, ["host:site.example", "path:p"]),
    ("go to Site.Example or site.Example", {"w:site": 2}, ["url:"]),
    ("file.extensionlonger and a.b1", {"w:file": 1}, ["url:"]),
    ("x@y.example is no link; -y.example neither", {"mail:y.example": 1}, ["url:"]),
]
MAILS = [
    ("write to Ann_B.c+list@Mail.Example.ORG today", {"mail:": 1, "mail:mail.example.org": 1, "w2:to_today": 1}, ["w:ann", "url:"]),
    ("p@q.example_r@s.example", {"mail:": 2, "mail:q.example": 1, "mail:s.example": 1}, []),
    ("me@host and @name", {"w:me": 1, "w:host": 1, "w:name": 1}, ["mail:"]),
]
TAGS = [
    ("<P Class='x'>bold</ p ><hr/>", {"tag:p": 2, "tag:hr": 1, "w:bold": 1}, ["w:class"]),
    ("big <u\n>under</u> line", {"tag:u": 2, "w2:big_under": 1, "w2:under_line": 1}, []),
    ("<blink a='1'>old</blink><em>new</em>", {"tag:em": 2, "w:blink": 2}, ["tag:blink"]),
    ("<wrap <em> in>", {"w:wrap": 1, "w:em": 1}, ["tag:em"]),
    ("5 < 6 and 7 > 3; <- and ->", {"w:and": 2}, ["tag:and"]),
    ("Bob <bob@post.example> on <www.post.example/a>", {"mail:post.example": 1, "host:post.example": 1}, ["tag:bob"]),
]
NOTHING = ["", " \r\n\t", None, "​", "-- // ''"]
#: (text, parameters, what its bag holds, families it lacks).
GRAMS = [
    ("cat", {"char_ngrams": "all", "min_ngram": 2, "max_ngram": 4}, {"c2:_c": 1, "c2:at": 1, "c2:t_": 1, "c3:cat": 1, "c4:_cat": 1, "c4:cat_": 1, "w:cat": 1}, ["c5"]),
    ("i 77", {"char_ngrams": "all", "min_ngram": 3, "max_ngram": 5}, {"c3:_i_": 1, "num:2": 1}, ["c4", "w"]),
    ("東京 tower ไทย", {"min_ngram": 2, "max_ngram": 2}, {"c2:_東": 1, "c2:東京": 1, "c2:京_": 1, "w:東京": 1, "c2:ไท": 1, "w:tower": 1}, ["c3"]),
    ("水", {}, {"c2:_水": 1, "c2:水_": 1, "c3:_水_": 1}, ["c4", "w"]),
    ("東京 tower", {"char_ngrams": "none"}, {"w:東京": 1, "w2:東京_tower": 1}, ["c2", "c3", "c4"]),
    ("one two", {"word_bigrams": False}, {"w:one": 1, "w:two": 1}, ["w2"]),
    ("a bc def", {"min_word": 1, "max_word": 2}, {"w:a": 1, "w:bc": 1, "w2:a_bc": 1}, ["c2"]),
]
#: Shapes on which patterns recurse, or start again from every character: label chains, marks without an end, runs.
HOSTILE = ["q-" * 30_000, "z.y-" * 20_000, "http://" * 9_000, "b@b." * 18_000, "@" * 60_000, "</" * 30_000 + "<p", "<b " * 20_000 + ">", "&lt;" * 12_000, "(" * 80_000, "é" * 50_000, "w" * 90_000]


def bags(spark, rows, **options):
    got = {k: {} for k, _ in rows}
    for r in fx.bags(spark.createDataFrame(rows, "doc_id long, text string"), params=ExtractParams(**options)).collect():
        got[r["doc_id"]][r["feature"]] = r["cnt"]
    return got


def test_texts(spark):
    cases = WORDS + MARKS + LINKS + MAILS + TAGS
    got = bags(spark, list(enumerate(c[0] for c in cases)))
    for k, (text, there, absent) in enumerate(cases):
        assert {f: got[k].get(f) for f in there} == there, (text, got[k])
        assert not set(absent) & set(got[k]), (text, got[k])
    assert not any(bags(spark, list(enumerate(NOTHING))).values())


def test_parameters(spark):
    for text, options, there, absent in GRAMS:
        bag = bags(spark, [(0, text)], **options)[0]
        assert {f: bag.get(f) for f in there} == there, (text, bag)
        assert not {f.split(":")[0] for f in bag} & set(absent), (text, bag)


def test_a_bag_holds_nothing_else(spark):
    text = "Mail me@x.example or see http://x.example/a. I paid $5 to ACME!"
    want = {"mail:": 1, "mail:x.example": 1, "url:": 1, "host:x.example": 1, "tld:example": 1, "path:a": 1, "punct:!": 1, "sym:$": 1, "num:1": 1, "caps:": 1}
    words = ["mail", "or", "see", "paid", "to", "acme"]
    want |= {f"w:{w}": 1 for w in words} | {"w2:mail_or": 1, "w2:or_see": 1, "w2:to_acme": 1}
    assert bags(spark, [(0, text)])[0] == want


def test_order_columns_and_texts_without_features(spark):
    rows = spark.createDataFrame([(1, "bb aa! bb", "x"), (2, "?", "y"), (3, None, "z")], "doc_id long, text string, other string")
    got = sorted((tuple(r) for r in fx.met(rows, "doc_id", "other").collect()), key=lambda r: r[2])
    assert [r[3] for r in got] == ["punct:!", "w:bb", "w:aa", "w2:bb_aa", "w:bb"] and {r[:2] for r in got} == {(1, "x")}
    outer = fx.met(rows, "doc_id", "other", outer=True).collect()
    assert {r["doc_id"] for r in outer} == {1, 2, 3} and sum(r["feature"] is not None for r in outer) == 5
    assert fx.met(rows, "doc_id", "other").columns == ["doc_id", "other", "ord", "feature"]
    firsts = {r["feature"]: r["ord"] for r in fx.bags(rows).collect()}
    assert sorted(firsts, key=firsts.get) == ["punct:!", "w:bb", "w:aa", "w2:bb_aa"]


def test_hostile_texts(spark):
    rows = [(k, f"{t} plain words follow") for k, t in enumerate(HOSTILE)]
    got = bags(spark, rows)
    assert all({"w:words", "w2:words_follow"} <= set(got[k]) for k, _ in rows)
    assert "pcre:" in got[1]
    edges = ["x" * 64 + ".", "x" * 63 + ".", "end." + "y" * 64, "end." + "y" * 63, "a." * 127, "a." * 126, "z" * 70 + " done."]
    marked = bags(spark, list(enumerate(edges)))
    assert ["pcre:" in marked[k] for k in range(len(edges))] == [True, False, True, False, True, False, False]


def test_entities_are_decoded_once():
    assert decode_entities("&amp;quot; &Auml; &#x2f; &#47; &reg &unknown; &#8;") == "&quot; Ä / / &reg &unknown; &#8;"


def test_fixed_values_and_params():
    import re

    assert len(HTML_ELEMENTS) == len(set(HTML_ELEMENTS)) == 117
    assert all(re.fullmatch(f"[{''.join(f'{chr(92)}U{int(x, 16):08X}' for x in re.findall('{([0-9A-F]+)}', chars(CLAUSE_ENDS)))}]", c) for c in CLAUSE_ENDS)
    with pytest.raises(ValueError):
        ExtractParams(char_ngrams="some")


def test_hashed_bags_add_up(spark):
    rows = spark.createDataFrame([(1, "aa bb aa"), (2, None)], "doc_id long, text string")
    for mode in ("xxh3", "md5"):
        got = fx.hashed_bags(rows, mode=mode).collect()
        assert sum(r["cnt"] for r in got) == 5 and {r["doc_id"] for r in got} == {1}
