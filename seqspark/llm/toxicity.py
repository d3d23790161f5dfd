"""Toxicity from subword bags: averaged embeddings under a linear softmax, trained in numpy.

A word is the mean of the vectors of its hashed character n-grams (and of itself), so a
misspelling shares most of a known word's vectors. A window of ``WINDOW`` words is the mean
of its words; a linear softmax over it is trained jointly with the vectors on windows that
carry their document's label. A document's score is the calibrated largest window logit, so a
few toxic words count the same in a short and in a very long text.

At scoring time the softmax is linear in the words: each distinct word has one number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import fold, slices, stored, table

BITS, DIM, WINDOW = 17, 8, 5
SIZES = (3, 4, 5, 6, 7)
CHUNK = 1 << 20
CACHE = 600_000
#: Bounds of the training sample: labelled documents, and windows taken from one of them
#: (evenly spread; fewer from a clean one).
MAX_LABELLED, MAX_WINDOWS, CLEAN_WINDOWS = 6000, 400, 32
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Word values of the last model this process used.
WORDS: dict[str, dict[str, float]] = {}
EDGE = "\"'`.,;:!?()[]{}<>|*%#$&-_~^/\\=+"
EPOCHS, BATCH, RATE = 4, 256, 0.2
THRESHOLD = 0.7


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and their character n-grams, word after word, with the start of
    each word's. Punctuation at the ends of a word is dropped; ``<`` and ``>`` mark them."""
    cores = [f"<{w.strip(EDGE)}>" for w in words]
    code = np.frombuffer("".join(cores).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, cores), np.int64, len(cores))
    owner, first = np.repeat(np.arange(len(cores)), size), np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max()), PRIME, np.uint64))
    whole = np.add.reduceat(code * power[np.arange(len(code)) - first[owner]], first)
    hashes, owners = [whole], [np.arange(len(cores))]
    for n in SIZES:
        if n <= len(code):
            h = np.zeros(len(code) - n + 1, np.uint64)
            for i in range(n):
                h = h * PRIME + code[i : len(code) - n + 1 + i]
            inside = owner[: len(h)] == owner[n - 1 :]
            hashes.append(h[inside] + np.uint64(n))
            owners.append(owner[: len(h)][inside])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    h = (h ^ (h >> np.uint64(31))) * PRIME
    order = np.argsort(owner, kind="stable")
    buckets = (h >> np.uint64(64 - BITS)).astype(np.int32)[order]
    return buckets, np.searchsorted(owner[order], np.arange(len(cores)))


def _chunks(text: str) -> Iterator[str]:
    """Whole text in parts that end at a blank where one follows."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            blank = text.find(" ", end)
            end = len(text) if blank < 0 else blank
        yield text[at:end]
        at = end


def _bags(windows: list[list[str]]) -> tuple[np.ndarray, ...]:
    """Buckets of the distinct words with their starts; words of the windows with theirs."""
    number: dict[str, int] = {}
    words = np.array([number.setdefault(w, len(number)) for window in windows for w in window], np.int32)
    grams, first = ngrams(list(number))
    return grams, np.append(first, len(grams)), words, np.cumsum([0, *map(len, windows)])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + sizes[i] - 1`` for each i, in one array."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def train(words: list[list[str]], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Logit per bucket and bias (last), from windows of words with 0/1 labels.

    Vectors and softmax are updated together by Adagrad on mini-batches of windows.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.3, (1 << BITS, DIM)).astype(np.float32)
    output = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full_like(vectors, 1e-6), np.full_like(output, 1e-6), np.full_like(bias, 1e-6)]
    grams, first, numbers, start = _bags(words)
    for _ in range(EPOCHS):
        order = rng.permutation(len(words))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            size = start[pick + 1] - start[pick]
            number = numbers[_runs(start[pick], size)]
            each = first[number + 1] - first[number]
            ids = grams[_runs(first[number], each)]
            w = np.repeat(1 / (each * np.repeat(size, size)), each).astype(np.float32)[:, None]
            owner = np.repeat(np.arange(len(pick)), size)
            local = np.repeat(owner, each)
            heads = np.searchsorted(local, np.arange(len(pick)))
            mean = np.add.reduceat(vectors[ids] * w, heads, axis=0)
            logit = mean @ output + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            flat = (p @ output.T)[local] * w
            used, place = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(place, flat[:, d], len(used)) for d in range(DIM)], axis=1)
            seen[0][used] += grad**2
            vectors[used] -= RATE * grad / np.sqrt(seen[0][used])
            for i, (value, g) in enumerate(((output, mean.T @ p / len(pick)), (bias, p.mean(axis=0))), 1):
                seen[i] += g**2
                value -= 0.2 * RATE * g / np.sqrt(seen[i])
    side = output[:, 1] - output[:, 0]
    return np.append(vectors @ side, bias[1] - bias[0])


@dataclass
class ToxicityModel:
    """Bucket logits with bias, and the calibration ``slope * logit + shift``."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def values(self, words: list[str]) -> dict[str, float]:
        """One number per word; those met before by this process are remembered."""
        known = WORDS.setdefault(self.name, {})
        if len(known) > CACHE or len(WORDS) > 1 and not known:
            WORDS.clear()
            known = WORDS.setdefault(self.name, {})
        fresh = list(set(words).difference(known))
        if fresh:
            buckets, first = ngrams(fresh)
            total = np.add.reduceat(self.weights[buckets], first)
            known.update(zip(fresh, (total / np.diff(np.append(first, len(buckets)))).tolist()))
        return known

    def logit(self, text: str) -> float:
        """Largest mean over ``WINDOW`` neighbouring words (all words of a shorter text)."""
        top, rest, any_ = -np.inf, np.zeros(0), False
        for part in _chunks(text.lower()):
            words = part.split()
            known = self.values(words)
            value = np.concatenate([rest, np.fromiter(map(known.__getitem__, words), float, len(words))])
            if not len(value):
                continue
            any_ = True
            total = np.concatenate([[0], np.cumsum(value)])
            if len(value) >= WINDOW:
                top = max(top, float((total[WINDOW:] - total[:-WINDOW]).max()) / WINDOW)
            rest = value[max(0, len(value) - WINDOW + 1) :]
        if any_ and top == -np.inf:
            top = float(rest.mean())
        return (top if any_ else 0.0) + self.weights[-1]

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(text) + self.shift, -30, 30))))


def calibration(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by Newton steps with a small ridge."""
    mean, spread = logits.mean(), logits.std() or 1.0
    x = np.stack([(logits - mean) / spread, np.ones(len(logits))], axis=1)
    theta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - labels) + 1e-2 * theta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        theta -= np.linalg.solve(hessian, gradient)
    return theta[0] / spread, theta[1] - theta[0] * mean / spread


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int = MAX_LABELLED) -> DataFrame:
    """``(key, text, label)`` of at most ``bound`` labelled documents, picked by hash.

    A document with several labels is toxic if one of them says so; null labels, keys and
    texts are left out; of rows that share a key one is taken.
    """
    known = labels.dropna(subset=[key, label]).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    picked = known.orderBy(F.xxhash64(F.col(key), F.lit(1)), key).limit(bound)
    rows = docs.select(key, F.col(text).alias("_text")).dropna()
    # At most ``bound`` short rows.
    return stored(rows.join(F.broadcast(stored(picked, "picked")), key).dropDuplicates([key]), "labelled")


def fit(sample: DataFrame, key: str) -> ToxicityModel:
    """Model of a ``labelled_sample``: three quarters (by hash) for the vectors, one for the
    calibration. With labels of one kind only, every score is that kind's smoothed rate."""
    part = F.pmod(F.xxhash64(F.col(key), F.lit(2)), F.lit(4))

    def windows(batches):
        for batch in batches:
            for piece in slices(batch, "_text"):
                out, kept = [], []
                for t, y in zip(piece.column("_text").to_pylist(), piece.column("_label").to_pylist()):
                    words = [w for p in _chunks(t.lower()) for w in p.split()]
                    cuts = [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]
                    most = MAX_WINDOWS if y else CLEAN_WINDOWS
                    step = max(1, -(-len(cuts) // most))
                    for c in cuts[::step]:
                        out.append(" ".join(c))
                        kept.append(y)
                yield pa.RecordBatch.from_pydict({"words": pa.array(out, pa.string()), "label": pa.array(kept, pa.int32())})

    found = sample.filter(part != 0).mapInArrow(windows, "words string, label int").toArrow()
    labels = found.column("label").to_numpy()
    if not len(labels) or labels.min() == labels.max():
        seen = float(labels.mean()) if len(labels) else 0.0
        return ToxicityModel(np.zeros((1 << BITS) + 1), 0.0, float(np.log((0.05 + seen) / (1.05 - seen))))
    words = found.column("words").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (labels[i], words[i]))
    model = ToxicityModel(train([words[i].split(" ") for i in order], labels[order]))
    held = sample.filter(part == 0)
    seen = scores(held, [key, "_label"], "_text", model, raw=True).toArrow()
    y = seen.column("_label").to_numpy()
    if len(y) and y.min() < y.max():
        model.slope, model.shift = calibration(seen.column("score").to_numpy(), y)
    return model


def scores(df: DataFrame, key: list[str], text: str, model: ToxicityModel, raw: bool = False) -> DataFrame:
    """``key`` columns and ``score`` (0 to 1; ``raw``: the logit before calibration).

    Null and empty texts score as a window without words. Equal texts score alike.
    """
    source = df.select(*key, F.col(text).alias("_scored"))
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in key)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_scored"):
                value = model.logit if raw else model.score
                found = [value(t or "") for t in part.column("_scored").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in key], pa.array(found, pa.float64())], names=[*key, "score"])

    return source.mapInArrow(run, f"{schema}, score double")


def op9_subword_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels.filter(fold("doc_id") != 1), "doc_id", "text", "toxic")
    found = scores(docs, ["doc_id"], "text", fit(sample, "doc_id"))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", predicted.alias("predicted"))
