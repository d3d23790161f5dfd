"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

A model holds, per language, smoothed probabilities of hashed letter trigrams (inside
words, with word borders). A document is a mixture: its trigrams come from language l with
proportion pi_l. EM estimates the proportions for a language set; the set is chosen by
likelihood minus ``penalty * log(trigrams) / 2`` per language after the first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import fold, lean, slices, table

BITS = 15
SMOOTH = 0.5
STEPS = 15
CHUNK = 1 << 20
#: Languages tried together after a first pass over all of them.
SET_LIMIT = 8


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _chunks(text: str) -> Iterator[str]:
    """Whole text in parts that end after a non-letter where one is near."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and end < at + CHUNK + 1000 and text[end - 1].isalpha():
            end += 1
        yield text[at:end]
        at = end


def grams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams with their counts; word borders count as one blank."""
    total = None
    for part in _chunks(text.lower()):
        code = np.frombuffer(part.encode("utf-32-le"), "<u4")
        code = np.where(letters()[code], code, 0)
        code = np.concatenate([[0], code[(code != 0) | np.concatenate([[False], code[:-1] != 0])], [0]]).astype(np.uint32)
        mid = code[1:-1] != 0
        mixed = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1]) * np.uint32(0x85EBCA77) + code[2:]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
        count = np.bincount((mixed >> np.uint32(32 - bits))[mid], minlength=1 << bits)
        total = count if total is None else total + count
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class MixtureModel:
    """Languages and, per hashed trigram, the probability under each."""

    languages: list[str]
    chance: np.ndarray  # (2**bits, languages)
    bits: int = BITS
    penalty: float = 1.0

    def mixture(self, text: str) -> dict[str, float]:
        """Selected languages with proportions; empty without letters or languages."""
        gram, count = grams(text, self.bits)
        if not len(gram) or not self.languages:
            return {}
        chance, count = self.chance[gram], count.astype(float)
        price = self.penalty * np.log(count.sum() + 1) / 2
        single = count @ np.log(chance)
        best = int(np.argmax(single))
        share, top = _fit(chance, count)
        if top - single[best] <= price:  # no set can gain more than all languages together
            return {self.languages[best]: 1.0}
        chosen, value = {best: 1.0}, single[best]
        left = np.argsort(-share)[:SET_LIMIT]
        while len(left) > 1:
            share, likelihood = _fit(chance[:, left], count)
            if likelihood - price * (len(left) - 1) > value:
                value, chosen = likelihood - price * (len(left) - 1), dict(zip(left.tolist(), share.tolist()))
            left = np.delete(left, np.argmin(share))
        return {self.languages[i]: p for i, p in chosen.items()}


def _fit(chance: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """EM for the proportions of a fixed set; returns them with the log-likelihood."""
    share = np.full(chance.shape[1], 1 / chance.shape[1])
    for _ in range(STEPS):
        share = share * ((count / (chance @ share)) @ chance) / count.sum()
    return share, float(count @ np.log(chance @ share))


def gram_counts(df: DataFrame, text: str, language: str, bits: int = BITS) -> DataFrame:
    """``(language, gram, n)`` over all rows with text and language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            for name, n in sums.items():
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"language": pa.array([name] * len(found), pa.string()), "gram": pa.array(found, pa.int32()), "n": pa.array(n[found], pa.int64())})
            sums.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for name, t in zip(part.column("language").to_pylist(), part.column("text").to_pylist()):
                    if name not in sums:
                        if len(sums) >= 64:
                            yield from out()
                        sums[name] = np.zeros(1 << bits, np.int64)
                    found, n = grams(t, bits)
                    sums[name][found] += n
        yield from out()

    rows = df.select(F.col(language).alias("language"), F.col(text).alias("text")).dropna()
    parts = rows.mapInArrow(lean(count), "language string, gram int, n bigint")
    return parts.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str, language: str, bits: int = BITS, penalty: float = 1.0) -> MixtureModel:
    """Model of all rows with text and language.

    What reaches the driver is at most languages x 2**bits sums, whatever the corpus.
    Rows with a null text or language teach nothing; without any the model is empty.
    """
    counts = gram_counts(df, text, language, bits).toArrow()
    names = sorted(set(counts.column("language").to_pylist()))
    table_ = np.full((1 << bits, len(names)), SMOOTH)
    place = {n: i for i, n in enumerate(names)}
    column = np.array([place[n] for n in counts.column("language").to_pylist()], int)
    table_[counts.column("gram").to_numpy(), column] += counts.column("n").to_numpy()
    return MixtureModel(names, table_ / table_.sum(axis=0), bits, penalty)


def predict(df: DataFrame, key: list[str], text: str, model: MixtureModel) -> DataFrame:
    """``key`` columns with ``lang_pred``, ``score`` and ``mixture`` (map of proportions).

    The prediction is the language with the largest share of the selected set, the score
    its share. A null text, an empty one or one without letters is ``und`` with score 0,
    and so is every text under an empty model. Equal texts get equal predictions.
    """
    source = df.select(*key) if text in key else df.select(*key, F.col(text))
    kinds = [source.schema[k] for k in key]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                found = [model.mixture(t) if t else {} for t in part.column(text).to_pylist()]
                best = [max(m.items(), key=lambda x: (x[1], x[0])) if m else ("und", 0.0) for m in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(k) for k in key],
                        pa.array([b[0] for b in best], pa.string()),
                        pa.array([min(1.0, max(0.0, b[1])) for b in best], pa.float64()),
                        pa.array([list(m.items()) for m in found], pa.map_(pa.string(), pa.float64())),
                    ],
                    names=[*key, "lang_pred", "score", "mixture"],
                )

    schema = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds)
    return source.mapInArrow(lean(run), f"{schema}, lang_pred string, score double, mixture map<string, double>")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(fold("doc_id") != 1)


def op2_language_mixture(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs), "text", "lang")
    found = predict(docs, ["doc_id"], "text", model)
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score", "mixture")
