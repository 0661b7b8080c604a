"""Parameters of extraction and scoring, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

#: Largest feature space: 2 ** MAX_BITS slots.
MAX_BITS = 24
MIN_STORE_BITS = 8
#: Counters held in tables are unsigned 32-bit.
MAX_COUNT = 4294967295

CHAR_MODES = ("none", "unspaced", "all")


@dataclass(frozen=True)
class ExtractParams:
    """What features a text gives.

    char_ngrams: "none", "unspaced" (words with a character of a script written
    without spaces) or "all".
    """

    min_word: int = 2
    max_word: int = 40
    char_ngrams: str = "unspaced"
    min_ngram: int = 2
    max_ngram: int = 4
    word_bigrams: bool = True

    def __post_init__(self) -> None:
        if self.char_ngrams not in CHAR_MODES:
            raise ValueError(f"char_ngrams must be one of {', '.join(CHAR_MODES)}")


@dataclass(frozen=True)
class ModelParams:
    """Weights of the score.

    pretrained_weight: how much a pretrained count weighs against a site count.
    background_weight: lift that counts as much as the background itself.
    alpha: smoothing of the background; language_alpha: of language detection.
    log_counts: repeated features weigh 1 + ln(count) instead of count.
    """

    pretrained_weight: float = 0.5
    background_weight: float = 10.0
    alpha: float = 0.2
    language_alpha: float = 0.2
    log_counts: bool = False

    def __post_init__(self) -> None:
        if self.pretrained_weight < 0:
            raise ValueError("pretrained_weight must not be negative")
        if self.background_weight <= 0 or self.alpha <= 0 or self.language_alpha <= 0:
            raise ValueError("background_weight, alpha and language_alpha must be above 0")


def check_bits(bits: int, least: int = 0) -> int:
    if not least <= bits <= MAX_BITS:
        raise ValueError(f"bits must be between {least} and {MAX_BITS}")
    return bits
