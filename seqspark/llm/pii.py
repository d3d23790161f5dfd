"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field then labels every token that holds a digit or an
``@``; all other tokens are outside by construction. Neighbouring tokens share a potential, and
so do distant ones that are equal or of equal shape (each linked to its next occurrence, so
links are linear in tokens). Tokens under a base span are observed; loopy sum-product message
passing spreads their labels, so a number or address that a pattern knows in one place is
found in the others. Weights are learned from base spans by pseudo-likelihood in numpy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import lean, sampled, slices, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is tried once: what fails at its start fails inside it too.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
EDGE = "\"'`.,;:!?[]{}<>|*%#$&_~^/\\="
#: Documents with personal data from which the weights are learned, picked by hash.
MAX_TRAINING = 3000
ROUNDS, SURE, GAP = 8, 0.9, 2


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: the run of local characters before an ``@`` and its domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches ``(kind, start, end)`` in code points, by kind and start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub("[^0-9]", "", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def nodes(text: str) -> list[tuple[int, int]]:
    """Blank-separated tokens with a digit or ``@``, without punctuation at their ends."""
    out, at = [], 0
    while m := DIGIT.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        gap = SPACE.search(text, m.end())
        at = gap.start() if gap else len(text)
        end = at
        while start < end and text[start] in EDGE:
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def shape(token: str) -> str:
    """Digits as 9, letters as a, repeated letters once."""
    return re.sub("a+", "a", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", token)))


FEATURES = 24


def features(tokens: list[str], gaps: list[bool]) -> np.ndarray:
    """0/1 features of each token; ``gaps[i]``: token i follows token i-1 closely."""
    x = np.zeros((len(tokens), FEATURES))
    for i, t in enumerate(tokens):
        digits = sum(c.isdigit() for c in t)
        letters = any(c.isalpha() for c in t)
        dots = t.count(".")
        x[i, 0] = 1
        x[i, 1 + min(6, (0, 1, 1, 2, 3, 3, 3, 4)[min(digits, 7)] + (digits > 7) + (digits > 15))] = 1
        x[i, 8] = "@" in t
        x[i, 9] = "@" in t and "." in t.rpartition("@")[2]
        x[i, 10] = letters
        x[i, 11] = t.startswith("+")
        x[i, 12] = "(" in t or ")" in t
        x[i, 13] = "-" in t
        x[i, 14 + min(dots, 4)] = 1
        x[i, 19] = digits == len(t)
        x[i, 20] = 16 <= digits <= 19 and not letters and luhn(re.sub("[^0-9]", "", t))
        x[i, 21] = dots == 3 and not letters and "@" not in t
        x[i, 22] = gaps[i] and tokens[i - 1].startswith("+")
        x[i, 23] = gaps[i] and "(" in tokens[i - 1]
    return x


#: Kinds of links: neighbours in the text, equal tokens, tokens of equal shape.
NEXT, EQUAL, ALIKE = range(3)


def links(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[bool], np.ndarray]:
    """Tokens, whether each follows closely, and links ``(i, j, kind)`` with i < j."""
    tokens = [text[s:e] for s, e in spans]
    gaps = [i > 0 and s - spans[i - 1][1] <= GAP for i, (s, _) in enumerate(spans)]
    found = [(i - 1, i, NEXT) for i, g in enumerate(gaps) if g]
    last: dict = {}
    for i, t in enumerate(tokens):
        core = re.sub(r"[^0-9a-z]", "", t.lower())
        for kind, name in ((EQUAL, core if len(core) > 3 else None), (ALIKE, shape(t) if len(core) > 6 else None)):
            if name is not None:
                j = last.get((kind, name))
                if j is not None and not (kind == ALIKE and re.sub(r"[^0-9a-z]", "", tokens[j].lower()) == core):
                    found.append((j, i, kind))
                last[kind, name] = i
    return tokens, gaps, np.array(found, np.int64).reshape(-1, 3)


def observed(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> np.ndarray:
    """Label of each token under a base span (1 + kind), else -1. Tokens are in text order and
    apart, so those under a span are a range."""
    label = np.full(len(spans), -1)
    place = np.array(spans, np.int64).reshape(-1, 2)
    for kind, s, e in base:
        first, last = np.searchsorted(place[:, 1], s, side="right"), np.searchsorted(place[:, 0], e, side="left")
        label[first:last] = 1 + KINDS.index(kind)
    return label


@dataclass
class SkipChain:
    """Weights of features per label, and of label pairs per kind of link."""

    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, x: np.ndarray, edges: np.ndarray, seen: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities by loopy message passing; ``seen`` labels are clamped."""
        score = x @ self.unary
        known = np.flatnonzero(seen >= 0)
        score[known] = -30.0
        score[known, seen[known]] = 0.0
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        if not len(edges):
            return _softmax(score)
        weight = np.concatenate([self.pair[edges[:, 2]], self.pair[edges[:, 2]].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), score.shape[1]))
        for _ in range(rounds):
            belief = score.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            peak = out.max(axis=1, keepdims=True)
            new = np.log(np.einsum("nl,nlm->nm", np.exp(out - peak), np.exp(weight)))
            message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        belief = score.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


#: Where learning starts for links of each kind: equal tokens tend to have equal labels.
PRIOR = np.array([0.0, 4.0, 0.5])


def _taught(tokens: list[str], seen: np.ndarray) -> np.ndarray:
    """Labels to learn from: outside where no base span is, but unknown (-1) for a token that
    is equal to one under a base span."""
    cores = [re.sub(r"[^0-9a-z]", "", t.lower()) for t in tokens]
    named = {c for c, k in zip(cores, seen) if k > 0}
    return np.array([k if k > 0 else -1 if c in named else 0 for c, k in zip(cores, seen)], np.int64)


def train(texts: list[str], steps: int = 300, rate: float = 0.3, seed: int = 5) -> SkipChain:
    """Pseudo-likelihood fit to base spans (tokens under none are outside).

    In each step the features of some tokens are hidden, so that the links learn to carry
    labels on their own. Without texts all weights but an outside bias are zero.
    """
    labels = len(KINDS) + 1
    xs, ys, edges, at = [], [], [], 0
    for text in texts:
        spans = nodes(text)
        tokens, gaps, e = links(text, spans)
        xs.append(features(tokens, gaps))
        ys.append(_taught(tokens, observed(spans, base_spans(text))))
        edges.append(e + [at, at, 0])
        at += len(spans)
    unary, pair = np.zeros((FEATURES, labels)), PRIOR[:, None, None] * np.eye(labels)
    if not at:
        unary[0, 0] = 5.0
        return SkipChain(unary, pair)
    x, y, e = np.concatenate(xs), np.concatenate(ys), np.concatenate(edges)
    rng, one = np.random.default_rng(seed), np.eye(labels)
    near = np.zeros((3, at, labels))
    e = e[(y[e[:, 0]] >= 0) & (y[e[:, 1]] >= 0)]
    for kind in range(3):
        of = e[e[:, 2] == kind]
        np.add.at(near[kind], of[:, 0], one[y[of[:, 1]]])
        np.add.at(near[kind], of[:, 1], one[y[of[:, 0]]])
    known = y >= 0
    y = np.maximum(y, 0)
    square_u, square_p = np.full_like(unary, 1e-6), np.full_like(pair, 1e-6)
    balance = (1 / np.sqrt(np.bincount(y, minlength=labels) + 1))[y] * known
    balance = balance / balance.sum()
    for _ in range(steps):
        shown = x * np.where(rng.random(at) < 0.3, 0, 1)[:, None]
        shown[:, 0] = 1
        score = shown @ unary + np.einsum("knl,klm->nm", near, pair)
        gap = (_softmax(score) - one[y]) * balance[:, None]
        grad_u = shown.T @ gap + 1e-4 * unary
        grad_p = np.einsum("knl,nm->klm", near, gap)
        grad_p = grad_p + grad_p.transpose(0, 2, 1) + 1e-3 * (pair - PRIOR[:, None, None] * np.eye(labels))
        square_u += grad_u**2
        square_p += grad_p**2
        unary -= rate * grad_u / np.sqrt(square_u)
        pair -= rate * grad_p / np.sqrt(square_p)
    return SkipChain(unary, pair)


def added_spans(text: str, base: list[tuple[str, int, int]], model: SkipChain) -> list[tuple[str, int, int]]:
    """Spans of tokens outside the base ones whose label is at least ``SURE``.

    Only in a text with a base span: a text in which the patterns find nothing has nothing
    to be consistent with. Neighbouring tokens of one kind make one span.
    """
    if not base:
        return []
    spans = nodes(text)
    seen = observed(spans, base)
    if (seen >= 0).all():
        return []
    tokens, gaps, edges = links(text, spans)
    p = model.marginals(features(tokens, gaps), edges, seen)
    best, out, before = p.argmax(axis=1), [], -2
    for i in np.flatnonzero((seen < 0) & (best > 0) & (p.max(axis=1) >= SURE)):
        kind, (s, e) = KINDS[best[i] - 1], spans[i]
        if out and i == before + 1 and gaps[i] and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], e)
        else:
            out.append((kind, s, e))
        before = i
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def training_texts(df: DataFrame, key: str, text: str, bound: int = MAX_TRAINING) -> list[str]:
    """At most ``bound`` texts that look like having base spans, of up to 20 000 characters: the
    sample fits weights only, it decides no span."""
    rows = df.select(key, text).filter(F.char_length(text) <= 20_000).filter(F.col(text).rlike(r"@|\+[0-9]|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]|[0-9]{12}"))
    return sorted(sampled(rows, [key, text], bound, 3).select(text).toArrow().column(0).to_pylist())


def fit(df: DataFrame, key: str, text: str, bound: int = MAX_TRAINING) -> SkipChain:
    return train(training_texts(df, key, text, bound))


def detect(df: DataFrame, keep: list[str], text: str, model: SkipChain, masked: bool = False) -> DataFrame:
    """``keep`` columns with ``n_email .. n_phone`` (base spans), ``base_sha256``, ``spans`` (all,
    as text) and, if ``masked``, ``masked`` (the text with each span as ``[KIND]``).

    A null text counts as empty and stays null when masked; overlapping spans are masked as
    one, under the first kind. Equal texts get equal spans.
    """
    source = df.select(*keep) if text in keep else df.select(*keep, F.col(text))
    schema = source.select(*keep).schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    if masked:
        schema = schema.add("masked", "string")
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                base = [base_spans(t or "") for t in texts]
                every = [b + added_spans(t or "", b, model) for t, b in zip(texts, base)]
                cols = [part.column(k) for k in range(len(keep))]
                cols += [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                cols.append(pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()))
                cols.append(pa.array([joined(s) for s in every], pa.string()))
                if masked:
                    cols.append(pa.array([None if t is None else mask(t, s) for t, s in zip(texts, every)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return source.mapInArrow(lean(run), schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op6_skip_chain(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, ["doc_id"], "text", fit(docs, "doc_id", "text"))
