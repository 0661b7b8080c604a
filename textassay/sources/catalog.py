"""Published background tables: a release with its manifest, what has changed since, and how to get it.

A manifest is read once into checked records. What is to be fetched is decided before the
first byte moves; tables are then written to a folder beside their place while their length
and digest are followed, and moved to it together once all of them have proved right, so a
call that fails leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import urllib.request
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HASH_VERSION
from .codec import FormatError, decode_background

# The largest manifest in bytes, seconds to wait for a server, letters of a code and of its variant.
MANIFEST_LIMIT, TIMEOUT = 4 << 20, 120
CODE_LETTERS, VARIANT_LETTERS = (2, 3), (2, 8)
CHANGED, UNPUBLISHED = "changed", "unpublished"
_CHUNK = 1 << 16


class CatalogError(RuntimeError):
    """The manifest or a table is not what it should be."""


def is_code(code: str) -> bool:
    """A language code in lower case, as en, or with a variant behind a hyphen or underscore, as pt-br."""
    language, *variant = code.replace("_", "-").split("-")
    plain = code.isascii() and code == code.lower() and len(variant) <= 1
    fits = lambda part, lengths: lengths[0] <= len(part) <= lengths[1]
    return plain and language.isalpha() and fits(language, CODE_LETTERS) and all(v.isalnum() and fits(v, VARIANT_LETTERS) for v in variant)


@dataclass(frozen=True)
class Entry:
    """A table of a release. Without address, digest and size it can be listed, not fetched."""

    code: str
    name: str
    sentences: int
    sha256: str | None
    address: tuple[str, str, int] | None

    @staticmethod
    def read(code: str, raw: dict) -> Entry:
        url, digest, size = raw.get("url"), raw.get("sha256"), raw.get("bytes")
        whole = isinstance(url, str) and isinstance(digest, str) and isinstance(size, int)
        return Entry(code, str(raw.get("name") or ""), int(raw.get("sentences") or 0), digest if isinstance(digest, str) else None, (url, digest, size) if whole else None)


@dataclass(frozen=True)
class Release:
    """A manifest's contents; empty names count as none."""

    hash_version: int
    version: str | None
    generated: str | None
    entries: dict[str, Entry]

    @staticmethod
    def read(manifest: dict) -> Release:
        languages = manifest.get("languages") if isinstance(manifest, dict) else None
        if languages == []:  # how some writers put an empty map
            languages = {}
        if not isinstance(languages, dict) or manifest.get("hash_version") is None:
            raise CatalogError("the manifest lacks languages or a hash version")
        named = lambda key: str(manifest.get(key) or "") or None
        return Release(manifest["hash_version"], named("version"), named("generated"), {code: Entry.read(code, raw) for code, raw in languages.items()})

    def fitting(self) -> Release:
        """The release, if this engine can use its tables."""
        if self.hash_version != HASH_VERSION:
            raise CatalogError(f"the tables are made for hash version {self.hash_version}, this is {HASH_VERSION}")
        return self

    def state(self, code: str, sha256: str) -> str | None:
        """How a local table stands to the release: none if they are the same."""
        entry = self.entries.get(code)
        return UNPUBLISHED if entry is None else None if entry.sha256 == sha256 else CHANGED

    def wanted(self, codes: list[str]) -> list[Entry]:
        """The entries of these languages, all of which can be fetched."""
        for code in codes:
            if not is_code(code) or code not in self.entries:
                raise ValueError(f"{code!r} is no language of this release")
        found = [self.entries[code] for code in codes]
        if broken := [e.code for e in found if e.address is None]:
            raise CatalogError(f"the manifest lacks address, digest or size of {', '.join(broken)}")
        return found


def _digests(folder: str) -> dict[str, str]:
    """Digests of the tables of a folder, in the order of their names."""
    return {f.stem: hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(Path(folder).glob("*.bin"))}


@dataclass
class Catalog:
    """A manifest at an https address, or a local one at a file:// address."""

    manifest_url: str

    def _chunks(self, url: str, limit: int) -> Iterator[bytes]:
        """The bytes at an address, ``limit`` at most. Local files are read for a local manifest only."""
        schemes = ("https://", "file://") if self.manifest_url.startswith("file://") else ("https://",)
        if not url.startswith(schemes):
            raise CatalogError(f"{url} is not an https address")
        left = limit
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT) as source:
                while chunk := source.read(_CHUNK):
                    left -= len(chunk)
                    if left < 0:
                        raise CatalogError(f"{url} has more than {limit} bytes")
                    yield chunk
        except OSError as e:
            raise CatalogError(f"{url} cannot be read") from e

    def fetch(self, url: str, limit: int = MANIFEST_LIMIT) -> bytes:
        return b"".join(self._chunks(url, limit))

    @cached_property
    def release(self) -> Release:
        try:
            return Release.read(json.loads(self.fetch(self.manifest_url)))
        except ValueError as e:
            raise CatalogError("the manifest is not JSON") from e

    def version(self) -> str | None:
        return self.release.version

    def generated(self) -> str | None:
        return self.release.generated

    def available(self) -> dict[str, str]:
        return {e.code: e.name for e in self.release.entries.values()}

    def sentences(self) -> dict[str, int]:
        return {e.code: e.sentences for e in self.release.entries.values()}

    def outdated(self, folder: str) -> dict[str, str]:
        """Local tables that the release has changed or no longer has, by name."""
        release = self.release.fitting()
        return {code: state for code, digest in _digests(folder).items() if (state := release.state(code, digest))}

    def _save(self, entry: Entry, path: str) -> None:
        """A table's bytes at a path, proved against its entry and as a table."""
        url, digest, size = entry.address
        seen = hashlib.sha256()
        with open(path, "wb") as out:
            for chunk in self._chunks(url, size):
                seen.update(chunk)
                out.write(chunk)
        if seen.hexdigest() != digest:
            raise CatalogError(f"what is published for {entry.code!r} has another digest than its entry")
        try:
            decode_background(Path(path).read_bytes())
        except FormatError as e:
            raise CatalogError(f"what is published for {entry.code!r} is not a table: {e}") from e

    def download(self, codes: list[str], folder: str) -> list[str]:
        """Put the tables of these languages into a folder, all of them or none; the paths written."""
        entries = self.release.fitting().wanted(codes)
        os.makedirs(folder, 0o755, exist_ok=True)
        with _beside(folder) as stage:
            for entry in entries:
                self._save(entry, os.path.join(stage, f"{entry.code}.bin"))
            places = [os.path.join(folder, f"{entry.code}.bin") for entry in entries]
            for place in places:
                os.replace(os.path.join(stage, os.path.basename(place)), place)
        return places

    def update(self, folder: str) -> list[str]:
        """Download again what the release has changed."""
        changed = [code for code, state in self.outdated(folder).items() if state == CHANGED]
        return self.download(changed, folder) if changed else []


@contextmanager
def _beside(folder: str) -> Iterator[str]:
    """A folder on the same file system that is gone afterwards, whatever happens."""
    stage = tempfile.mkdtemp(prefix=".stage-", dir=folder)
    try:
        yield stage
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def manifest_rows(spark: SparkSession, manifest: dict) -> DataFrame:
    """(code, name, sha256, sentences) of a manifest."""
    entries = Release.read(manifest).entries.values()
    return spark.createDataFrame([(e.code, e.name, e.sha256, e.sentences) for e in entries], "code string, name string, sha256 string, sentences long")


def outdated_rows(local: DataFrame, published: DataFrame) -> DataFrame:
    """(code, state) of local (code, sha256) rows against a manifest's rows."""
    p = published.select("code", F.col("sha256").alias("p_sha256"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), F.lit(UNPUBLISHED)).when(~F.col("sha256").eqNullSafe(F.col("p_sha256")), F.lit(CHANGED))
    return local.join(p, "code", "left").select("code", state.alias("state")).where("state IS NOT NULL")


def local_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(code, sha256) of the table files in a folder that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("code"), F.sha2("content", 256).alias("sha256"))
