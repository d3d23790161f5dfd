"""Named builders: tokenizers, vocabularies, noisers and metrics chosen by configuration."""

from __future__ import annotations

from collections.abc import Callable

from seqspark.consts import GENERAL_MOLECULE_TOKENS, MOLECULE_SPECIALS, SHORT_MOLECULE_TOKENS
from seqspark.functions import text as tx
from seqspark.operators import metrics as mt, noise as nz
from seqspark.operators.vocab import fixed_vocab

_BUILDERS: dict[str, dict[str, Callable]] = {
    "tokenizer": {
        "words": tx.words,
        "characters": tx.characters,
        "short_molecule": tx.short_molecule,
        "general_molecule": tx.general_molecule,
    },
    "vocabulary": {
        "short_molecule": lambda spark: fixed_vocab(spark, MOLECULE_SPECIALS, SHORT_MOLECULE_TOKENS),
        "general_molecule": lambda spark: fixed_vocab(spark, MOLECULE_SPECIALS, GENERAL_MOLECULE_TOKENS),
    },
    "noise": {"dropout": nz.word_dropout, "shuffle": nz.word_shuffle},
    "metric": {"cross_entropy": mt.cross_entropy, "bleu": mt.bleu_stats, "exact_match": mt.exact_match},
}


def register(kind: str, name: str):
    """Decorator adding a builder; a name can be taken only once."""

    def add(fn: Callable) -> Callable:
        known = _BUILDERS.setdefault(kind, {})
        if name in known:
            raise ValueError(f"{kind} {name!r} is already registered")
        known[name] = fn
        return fn

    return add


def get(kind: str, name: str) -> Callable:
    try:
        return _BUILDERS[kind][name]
    except KeyError:
        raise ValueError(f"unknown {kind} {name!r}; known: {sorted(_BUILDERS.get(kind, {}))}") from None


def names(kind: str) -> list[str]:
    return sorted(_BUILDERS.get(kind, {}))
