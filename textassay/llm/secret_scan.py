"""Secrets in texts: fixed patterns, and a token-efficiency test.

A byte-pair vocabulary encodes words and names in long tokens and random strings
in short ones. A run of key-like characters that has a low ratio of characters
to tokens is taken for a secret, unless it is a digest of a known length, a
UUID, or an identifier: its parts between digits, punctuation and changes of case
are, taken for themselves, words of the vocabulary.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of

# The patterns of the base kinds, in the order of the kinds, and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Characters of a run that the token test looks at, and the ratio under which it is random.
MIN_RUN, MAX_RATIO = 20, 1.9
#: Characters to tokens from which the parts of a run are words, and the share of the run that they make up.
WORD_RATIO, WORD_SHARE = 3.0, 0.6
# Hexadecimal lengths of common digests.
DIGESTS = frozenset((32, 40, 48, 56, 64, 96, 128))

_ASSIGN = re.compile(ASSIGN.replace("(password|passwd|secret|token|api_?key)", "((?ai:password|passwd|secret|token|api_?key))"))
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}+"), re.compile(r"[0-9a-f]{24,}+")
_HINT = re.compile(r"[:=]")
_RUN = re.compile(rf"(?<![^\W_])[A-Za-z0-9+/_-]{{{MIN_RUN},}}+={{0,2}}(?![^\W_])")
_HEX_ANY = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests and UUIDs, and runs without letters."""
    return (_HEX_ANY.fullmatch(run) and len(run) in DIGESTS) or bool(_UUID.fullmatch(run)) or not any(c.isalpha() for c in run)


def named(run: str, vocabulary: str) -> bool:
    """Identifiers: most of the run are parts that the vocabulary has as words, alone or after a space, as written or in lower case."""
    parts = [p for p in _PARTS.findall(run) if p.isalpha()]
    chars = sum(map(len, parts))
    if chars < WORD_SHARE * len(run):
        return False
    encode = encoding(vocabulary).encode_ordinary
    return chars >= WORD_RATIO * sum(min(len(encode(form)) for form in (p, f" {p}", p.lower(), f" {p.lower()}")) for p in parts)


def spans(text: str, vocabulary: str, min_run: int = MIN_RUN, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, end exclusive, by start and then kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _RUN.finditer(text):
        run = m[0].rstrip("=")
        if len(run) < min_run or known(run):
            continue
        if len(run) / len(encoding(vocabulary).encode_ordinary(run)) < max_ratio and not named(run, vocabulary):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def with_spans(documents: DataFrame, text: str = "text", vocabulary: str | None = None, name: str = "__spans") -> DataFrame:
    """``documents`` with ``name``: array of struct(kind, start, end), sorted by start, then kind.

    A null or empty text has none. Spans of different kinds may overlap. Repeated rows
    get equal spans; other columns pass through.
    """
    bounded_batches(documents.sparkSession)
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t, path)] for t in batch])

    return documents.withColumn(name, run.asNondeterministic()(text_of(text)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, found: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at, reach = [], 0, -1
    for a, _, b in sorted(found):
        if a >= reach:
            out += [text[at:a], mark] if a >= at else []
        reach = max(reach, b)
        at = max(at, reach)
    return "".join(out) + text[at:]


def mask(documents: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``documents`` with secrets in the text replaced by a mark; texts without secrets, null ones too, stay as they are."""
    bounded_batches(documents.sparkSession)
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([t if t is None or not (s := spans(t, path)) else masked(t, s) for t in batch], dtype=object)

    return documents.withColumn(text, run.asNondeterministic()(F.col(text)))
