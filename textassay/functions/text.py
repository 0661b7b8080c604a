"""Text functions that Spark lacks, and the word and mark classes of extraction."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that make a tag.
HTML_ELEMENTS = (
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption center cite code "
    "col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark "
    "marquee menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s "
    "samp script section select slot small source span strike strong style sub summary sup table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()

# Characters that take no room, by code point.
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xFEFF)))
# Currency signs that are features, marks that end a clause, scripts written without spaces.
CURRENCY = "€$£¥₹"
CLAUSE_ENDS = ".,;:!?()[]{}\"«»\r\n"
UNSPACED_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Khmer", "Lao", "Myanmar")


def chars(some: str) -> str:
    """Characters as members of a class in a regular expression."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in some)


#: White space as Unicode has it; Java's \s is ASCII.
SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"
CLAUSE_MARKS = f"[{chars(CLAUSE_ENDS)}]+"
LETTERS = r"[\p{L}\p{N}]+"
UNSPACED = "[" + "".join(rf"\p{{Is{name}}}" for name in UNSPACED_SCRIPTS) + "]"
#: All of these scripts' characters and more, much faster to look for: what comes before Thai is none of them.
FROM_THAI = r"[\x{E01}-\x{10FFFF}]"

#: Characters that NFKC cannot change: texts of these only skip the normaliser.
STABLE = (
    r"[\x00-\x9F\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}"
    r"\x{14A}-\x{17E}\x{180}-\x{1C3}\x{1CD}-\x{1F0}\x{1F4}-\x{24F}\x{2012}-\x{2016}\x{2018}-\x{201F}\x{20AC}]"
)

_REFERENCE = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]{1,31}));")


def _referred(m: re.Match) -> str:
    if m[3]:
        return html5.get(m[3] + ";", m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    allowed = code in (9, 10, 12, 13) or 32 <= code < 127 or 160 <= code < 0xD800 or 0xE000 <= code <= 0x10FFFF
    if not allowed or 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE:
        return m[0]
    return chr(code)


def decode_entities(text: str) -> str:
    """Named and numeric references that end in a semicolon, once; others stay as they are."""
    return _REFERENCE.sub(_referred, text)


@F.pandas_udf(T.StringType())
def _decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(decode_entities, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


# Marked as not deterministic so that the optimizer evaluates their inputs once, instead of
# copying them into every expression that uses the results.
_decode_once, _nfkc_once = _decode.asNondeterministic(), _nfkc.asNondeterministic()


def entities_decoded(text: Column) -> Column:
    """Only texts with something like a reference go through Python."""
    return F.coalesce(_decode_once(F.when(text.rlike(r"&[#A-Za-z][A-Za-z0-9]*;"), text)), text)


def nfkc(text: Column) -> Column:
    """Only texts with a character that may change go through Python."""
    return F.coalesce(_nfkc_once(F.when((F.octet_length(text) > F.char_length(text)) & ~text.rlike(f"^{STABLE}*+$"), text)), text)


def visible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
