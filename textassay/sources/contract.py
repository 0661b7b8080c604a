"""What every store must do: rules to hold an own implementation against.

``check(make)`` calls ``make`` for a new, installed store of 2 ** 10 slots per rule
and raises ``ContractError`` with the name of the first rule that is broken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.layers import Layer
from .codec import encode_layer
from .store import Storage

BITS = 10
SIZE = 1 << BITS


class ContractError(AssertionError):
    """A store breaks a rule."""


class _Probe:
    def __init__(self, spark: SparkSession, store: Storage) -> None:
        self.spark, self.store = spark, store

    def bag(self, counts: dict[int, int]) -> DataFrame:
        return self.spark.createDataFrame(list(counts.items()), "h long, cnt long")

    def apply(self, counts: dict[int, int], label: str = "spam", sign: int = 1, archive: bool = False) -> int:
        return self.store.apply(self.bag(counts), label, sign, 1, archive)

    def held(self) -> dict[int, tuple[int, int]]:
        return {r["slot"]: (r["count_ham"], r["count_spam"]) for r in self.store.load().counts.collect()}


def _empty(p: _Probe) -> bool:
    layer = p.store.load()
    return layer.bits == BITS and p.held() == {} and p.store.tally().generation == 0 and layer.texts_ham == layer.texts_spam == 0


def _accumulate(p: _Probe) -> bool:
    p.apply({1: 2, 5: 1})
    p.apply({1: 3})
    more = p.held()
    p.apply({1: 3}, sign=-1)
    return more == {1: (0, 5), 5: (0, 1)} and p.held() == {1: (0, 2), 5: (0, 1)} and p.store.load().texts_spam == 1


def _clamp(p: _Probe) -> bool:
    p.apply({1: 2}, "ham")
    p.apply({1: 10, 2: 5}, "ham", -1)
    p.apply({}, "ham", -1)
    return p.held() == {} and p.store.load().texts_ham == 0


def _recover(p: _Probe) -> bool:
    p.apply({5: 3}, sign=-1)
    p.apply({5: 3})
    return p.held() == {5: (0, 3)}


def _fold(p: _Probe) -> bool:
    p.apply({7: 1, 7 + SIZE: 2, 7 + 3 * SIZE: 4}, "ham")
    return p.held() == {7: (7, 0)}


def _identity(p: _Probe) -> bool:
    return bool(p.store.identity()) and p.store.identity() == p.store.identity()


def _as_in_memory(p: _Probe) -> bool:
    layer = Layer.empty(p.spark, BITS)
    for counts, label, sign in (({1: 4, 9: 2}, "spam", 1), ({1: 1, 2000: 3}, "ham", 1), ({9: 1}, "spam", -1)):
        p.apply(counts, label, sign)
        layer = layer.apply(p.bag(counts), label, sign)
    return encode_layer(p.store.load(), False) == encode_layer(layer, False)


def _version(p: _Probe) -> bool:
    seen = [p.store.version()]
    for sign, archive in ((1, False), (-1, False), (1, True)):
        p.apply({1: 1}, "ham", sign, archive)
        seen.append(p.store.version())
    return len(set(seen)) == len(seen)


def _generations_apart(p: _Probe) -> bool:
    p.apply({1: 4})
    p.apply({1: 6}, archive=True)
    both = p.held()
    p.apply({1: 9}, sign=-1, archive=True)
    return both == {1: (0, 10)} and p.held() == {1: (0, 4)}


def _rotate(p: _Probe) -> bool:
    p.apply({1: 4})
    p.apply({1: 6, 2: 1}, archive=True)
    p.apply({4: 5}, "ham", archive=True)
    before = p.store.version()
    p.store.rotate()
    t = p.store.tally()
    return p.held() == {1: (0, 7), 4: (2, 0)} and t.generation == 1 and t.recent_spam == t.recent_ham == 0 and p.store.version() != before and p.apply({}) == 1


def _lifetime(p: _Probe) -> bool:
    for label in ("spam", "spam", "ham"):
        p.apply({1: 1}, label)
    p.store.rotate()
    p.store.rotate()
    kept = p.store.tally()
    p.apply({1: 1}, "ham", -1)
    p.apply({1: 1}, "ham", -1)
    return (kept.learned_spam, kept.learned_ham) == (2, 1) and p.store.tally().learned_ham == 0


RULES: dict[str, Callable[[_Probe], bool]] = {
    "empty": _empty,
    "accumulate": _accumulate,
    "clamp": _clamp,
    "recover": _recover,
    "fold": _fold,
    "identity": _identity,
    "as in memory": _as_in_memory,
    "version": _version,
    "generations apart": _generations_apart,
    "rotate": _rotate,
    "lifetime texts": _lifetime,
}


def check(spark: SparkSession, make: Callable[[], Storage], rules: list[str] | None = None) -> None:
    """Hold new stores against the rules, or some of them; two new stores must have different identities."""
    for name in rules or RULES:
        if not RULES[name](_Probe(spark, make())):
            raise ContractError(f"the store breaks the rule {name!r}")
    if (rules is None or "identity" in rules) and make().identity() == make().identity():
        raise ContractError("two stores have the same identity")
