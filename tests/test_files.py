import hashlib
import json
import tracemalloc
import zlib

import pytest

from textassay.cli import main
from textassay.operators.language import LanguageSet
from textassay.operators.layers import CountTable
from textassay.sources import background, codec
from textassay.sources.catalog import Catalog, CatalogError, is_code, local_rows, manifest_rows, outdated_rows

from .test_layers import held, layer, table


def test_vector_bytes(spark):
    v = codec.vector_of(bytes.fromhex("0000000001020304"))
    assert (v.bits, v.total, list(v.counts)) == (1, 0x01020304, [0, 0x01020304])
    for bad in (b"", b"123", b"\0" * 12):
        with pytest.raises(codec.FormatError):
            codec.vector_of(bad)
    assert list(codec.table_of(spark, v).counts.first()) == [1, 0x01020304]


def test_layer_round_trip(spark):
    site = layer(spark, {1: 4, 200: 1}, {1: 3}, 8, (5, 6))
    for compressed in (True, False):
        back = codec.decode_layer(spark, codec.encode_layer(site, compressed))
        assert held(back.counts, "count_ham", "count_spam") == {1: (3, 4), 200: (0, 1)}
        assert (back.bits, back.texts_ham, back.texts_spam, back.total()) == (8, 5, 6, 8)
    with pytest.raises(codec.FormatError):
        codec.decode_layer(spark, codec.encode_layer(site, False)[:-1])
    empty = layer(spark, {}, {}, 20)
    assert len(codec.encode_layer(empty)) < 20_000


def test_background_files(spark, tmp_path):
    en, fr = table(spark, [(1, 5), (2, 1)], 8), table(spark, [(1, 1)], 10)
    background.write(en, f"{tmp_path}/bg/en.bin")
    background.write(fr, f"{tmp_path}/bg/fr.bin")
    langs = background.load(spark, f"{tmp_path}/bg")
    assert langs.meta == {"en": (8, 6), "fr": (10, 1)} and held(langs.select("en").counts, "cnt") == {1: 5, 2: 1}
    assert list(background.load(spark, f"{tmp_path}/bg", ["fr"]).meta) == ["fr"]
    assert list(background.load(spark, f"{tmp_path}/bg/en.bin").meta) == ["en"]
    assert held(background.read(spark, f"{tmp_path}/bg/fr.bin").counts, "cnt") == {1: 1}
    one = background.cached(spark, f"{tmp_path}/bg/fr.bin")
    assert background.cached(spark, f"{tmp_path}/bg/fr.bin") is one
    with pytest.raises(FileNotFoundError):
        background.load(spark, f"{tmp_path}/bg", ["xx"])
    background.write_parquet(langs, f"{tmp_path}/pq")
    again = background.read_parquet(spark, f"{tmp_path}/pq", ["en"])
    assert again.meta == {"en": (8, 6)} and held(again.select("en").counts, "cnt") == {1: 5, 2: 1}


def test_header_total_is_taken(spark):
    data = codec.encode_background(CountTable(table(spark, [(1, 5)], 8).counts, 8, 999))
    assert codec.decode_background(data).total == 999


def test_corrupt_backgrounds(spark):
    good = codec.encode_background(table(spark, [(1, 5)], 8))
    raw = zlib.decompress(good)
    bad = [good[:-3], good + b"x", b"junk", zlib.compress(b"OTHER" + raw[5:]), zlib.compress(raw[:5] + b"\x07" + raw[6:]), zlib.compress(raw + b"\0"), zlib.compress(raw[:-4]), zlib.compress(raw[:6] + b"\x19" + raw[7:]), b""]
    for data in bad:
        with pytest.raises(codec.FormatError):
            codec.decode_background(data)


def test_a_bomb_is_refused_early():
    head = codec._BACKGROUND.pack(codec.BACKGROUND_MAGIC, 1, 26, 0)
    engine = zlib.compressobj(9)
    data = engine.compress(head) + b"".join(engine.compress(b"\0" * (1 << 20)) for _ in range(256)) + engine.flush()
    assert len(data) < 1 << 20
    tracemalloc.start()
    with pytest.raises(codec.FormatError):
        codec.decode_background(data)
    with pytest.raises(codec.FormatError):
        codec.inflate(data, 1 << 20)
    assert tracemalloc.get_traced_memory()[1] < 192 << 20
    tracemalloc.stop()


@pytest.fixture
def release(spark, tmp_path):
    folder, languages = tmp_path / "release", {}
    folder.mkdir()
    for lang, cnt in (("en", 5), ("fr", 7)):
        data = codec.encode_background(table(spark, [(1, cnt)], 8))
        (folder / f"{lang}.bin").write_bytes(data)
        languages[lang] = {"name": lang.upper(), "file": f"{lang}.bin", "url": f"file://{folder}/{lang}.bin", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    languages["fr"]["sentences"] = 700
    write(folder, languages)
    return folder, languages


def write(folder, languages, **more):
    (folder / "manifest.json").write_text(json.dumps({"hash_version": 1, "version": "", "generated": "2026", "languages": languages} | more))
    return Catalog(f"file://{folder}/manifest.json")


def test_catalog(spark, release, tmp_path):
    folder, languages = release
    catalog = Catalog(f"file://{folder}/manifest.json")
    assert catalog.available() == {"en": "EN", "fr": "FR"} and catalog.sentences() == {"en": 0, "fr": 700}
    assert catalog.version() is None and catalog.generated() == "2026"
    to = f"{tmp_path}/to"
    assert catalog.download(["en", "fr"], to) == [f"{to}/en.bin", f"{to}/fr.bin"] and catalog.outdated(to) == {}
    (tmp_path / "to/en.bin").write_bytes(b"old")
    (tmp_path / "to/xx.bin").write_bytes(b"own")
    assert catalog.outdated(to) == {"en": "changed", "xx": "unpublished"}
    rows = outdated_rows(local_rows(spark, to), manifest_rows(spark, json.loads((folder / "manifest.json").read_text())))
    assert {r["code"]: r["state"] for r in rows.collect()} == {"en": "changed", "xx": "unpublished"}
    assert catalog.update(to) == [f"{to}/en.bin"] and catalog.update(to) == []
    assert (tmp_path / "to/xx.bin").exists()


def test_catalog_refuses(release, tmp_path):
    folder, languages = release
    catalog = Catalog(f"file://{folder}/manifest.json")
    for code in ("../etc/x", "EN", "zz"):
        with pytest.raises(ValueError):
            catalog.download([code], f"{tmp_path}/to")
    for change in ({"sha256": "0" * 64}, {"bytes": 10}, {"bytes": "many"}, {"url": "http://example.org/x"}):
        with pytest.raises(CatalogError):
            write(folder, {"en": languages["en"] | change}).download(["en"], f"{tmp_path}/to")
    with pytest.raises(CatalogError):  # the first is right: all or none
        write(folder, {"en": languages["en"], "fr": languages["fr"] | {"sha256": "0" * 64}}).download(["en", "fr"], f"{tmp_path}/to")
    junk = b"no table"
    (folder / "zz.bin").write_bytes(junk)
    entry = {"url": f"file://{folder}/zz.bin", "bytes": len(junk), "sha256": hashlib.sha256(junk).hexdigest()}
    with pytest.raises(CatalogError):
        write(folder, languages | {"zz": entry}).download(["zz"], f"{tmp_path}/to")
    assert not list(tmp_path.glob("to/*")) and not list(tmp_path.glob("to/.*"))
    assert [c for c in ("en", "pt-br", "zh_hant", "abc", "e", "abcd", "EN", "en-", "en-x", "en-a-b", "é1", "../x", "en-123456789") if is_code(c)] == ["en", "pt-br", "zh_hant", "abc"]
    with pytest.raises(CatalogError):
        write(folder, languages, hash_version=2).outdated(f"{tmp_path}/to")
    (folder / "manifest.json").write_text("{}")
    with pytest.raises(CatalogError):
        Catalog(f"file://{folder}/manifest.json").available()
    with pytest.raises(CatalogError):
        Catalog("https://127.0.0.1:1/m").fetch(f"file://{folder}/manifest.json")


def test_command_line(release, tmp_path, capsys):
    folder, languages = release
    manifest, to = f"--manifest=file://{folder}/manifest.json", f"--to={tmp_path}/cli"
    assert main([manifest, "--list"]) == 0 and "FR\t700" in capsys.readouterr().out
    assert main([manifest, to, "en"]) == 0 and main([manifest, to, "--check"]) == 0
    (tmp_path / "cli/en.bin").write_bytes(b"old")
    assert main([manifest, to, "--check"]) == 1 and main([manifest, to, "--update"]) == 0
    assert main([manifest, to, "nope!"]) == 1 and main([manifest]) == 2


def test_language_set_of_tables_keeps_order(spark):
    langs = LanguageSet.of({"zz": table(spark, [(1, 1)], 8), "aa": table(spark, [(1, 1)], 8)})
    assert list(langs.meta) == ["zz", "aa"]
    bag = spark.createDataFrame([(1, 1, 1)], "doc_id long, h long, cnt long")
    assert langs.detect(bag, bag).first()["language"] == "zz"
