import random
import re
import zlib

import numpy as np
import pytest
from helpers import awkward, empty, frame

from seqspark.llm import packing as pk, sharding as sh

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_byte_shards_are_contiguous_balanced_and_gapless(spark):
    rows = awkward()
    for parts in (1, 5):
        got = sh.byte_shards(frame(spark, rows, parts), ["doc_id"], "text", 5).collect()
        assert len(got) == len(rows)
        size = sorted((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == size
        order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
        assert [r["shard"] for r in order] == sorted(r["shard"] for r in order)
        total, at, seen = sum(r["size"] for r in order), 0, {}
        for r in order:
            assert r["shard"] == (2 * at + r["size"]) * 5 // (2 * total)
            at += r["size"]
            seen.setdefault(r["shard"], []).append(r["slot"])
        assert all(s == list(range(len(s))) for s in seen.values())
    assert sh.byte_shards(empty(spark), ["doc_id"], "text", 5).count() == 0


def one_by_one(lengths, capacity):
    """Best-two-fit packing of single pieces."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        used = []
        for n in list(left):
            if n <= capacity - sum(used):
                used.append(n)
                left.remove(n)
        gap = capacity - sum(used)
        if gap and len(used) > 1:
            best = max(((a + b, a) for i, a in enumerate(left) for b in left[i + 1 :] if used[-1] < a + b <= gap + used[-1]), default=None)
            if best:
                least = used.pop()
                for n in (best[1], best[0] - best[1]):
                    left.remove(n)
                    used.append(n)
                left = sorted([*left, least], reverse=True)
        bins.append(sorted(used))
    return bins


def test_histogram_packing_equals_packing_one_by_one():
    rng = random.Random(4)
    for capacity, n in ((20, 60), (37, 80), (64, 40)):
        lengths = [min(capacity, int(rng.expovariate(0.15)) + 1) for _ in range(n)]
        counts = np.bincount(lengths, minlength=capacity + 1)
        plan = pk.best_two_fit(counts, capacity)
        used = np.zeros(capacity + 1, int)
        for sizes, copies in plan:
            assert sum(s * p for s, p in sizes.items()) <= capacity
            for s, p in sizes.items():
                used[s] += p * copies
        assert (used == counts).all()
        assert sum(c for _, c in plan) == len(one_by_one(lengths, capacity))


def test_ids_are_those_of_whole_texts():
    encoder = pk.WordEncoder(TOKENIZER)
    rng = random.Random(2)
    parts = ["a", "B", "é", "ß", "'", "'s", "d", ".", ",", "..", " ", " ", "\n", "1", "23", "_", "<|endoftext|>", "́", "Σ", "ς", "\xa0", "中", "🙂", "\x0b", "ª", "&&&"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["long " * 300_000]
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want


def test_packing_places_every_piece_once(spark):
    rows = awkward()
    got = pk.pack_documents(frame(spark, rows), TOKENIZER, 256).toPandas()
    encoder = pk.WordEncoder(TOKENIZER)
    want = []
    for i, t in rows:
        data = encoder.encode([t or ""])[0] + np.array([1], "<u4").tobytes()
        want += [(i, p, s // 4, len(data[s : s + 1024]) // 4, zlib.crc32(data[s : s + 1024])) for p, s in enumerate(range(0, len(data), 1024))]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda r: (-1 if r[0] is None or r[0] != r[0] else r[0], *r[1:])
    assert sorted(map(key, got[columns].itertuples(index=False, name=None))) == sorted(map(key, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert pk.pack_documents(empty(spark), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        pk.pack(spark.createDataFrame([(1, 300)], "doc_id bigint, length bigint"), ["doc_id"], 256)


def test_words_met_once_are_not_kept():
    """What a worker remembers is for words that come again: short texts form groups, and a word
    stays from its second group on."""
    short = ["ab cd", "ef", ""] * 50
    assert [[t for _, t in g] for g in pk._parts(short)] == [[t for t in short if t]]
    words = pk.WordEncoder(TOKENIZER)
    plain = words.tokenizer
    for n in range(40):
        texts = [f"the house {'xyzzy' * (i % 7)}q{n}w{i} of" for i in range(200)]
        ids = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert words.encode(texts) == ids
        assert len(words.known) < 200  # of up to 8000 words; a few share a place
    assert {"the", "house", "of"} <= words.known.keys()


def test_forgotten_words_keep_their_ids(monkeypatch):
    monkeypatch.setattr(pk, "CACHE", 20)
    monkeypatch.setattr(pk, "CHUNK", 64)
    words = pk.WordEncoder(TOKENIZER)
    plain = words.tokenizer
    texts = [" ".join(f"ka{i % 9}lo{j}" for j in range(i % 30)) + ("\tÜber-All. " if i % 2 else " éa x") for i in range(300)]
    ids = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode(texts) == ids and words.encode(texts[::-1]) == ids[::-1]


def test_plain_words_need_the_merges_only(monkeypatch):
    """Lower-case Latin-1 words, most of what is new, skip the steps before the merges, with the
    same ids; signs are cut off at the same places as by the general pattern."""
    words = pk.WordEncoder(TOKENIZER)
    plain, whole = words.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            whole.extend(texts)
            return plain.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(words.known, "tokenizer", Counted())
    rng = random.Random(6)
    letters = [c for c in map(chr, range(256)) if c.isalpha() and c == c.lower()]
    low = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 64))) for _ in range(2000)] + letters + ["house", "\xb5\xaa\xba\xff\xdf"]
    texts = [" ".join(low), "House, \xc9T\xc9. " + " ".join(low[:50])]
    ids = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode(texts) == ids
    assert set(whole) <= {",", "."}
    general = re.compile(r"[^\w\s'](?<=[^\W\d_][^\w\s'])[^\w\s']*(?=[ \n\t\r]|\Z)")
    for _ in range(3000):
        t = "".join(rng.choice("aB\xe91_'.,;-\xa0\xad\xb2\x85\n\t (\xbf\xd7") if rng.random() < 0.8 else chr(rng.randrange(256)) for _ in range(rng.randint(0, 20))).lower()
        assert pk.TAIL.sub(r" \g<0>", t) == general.sub(r" \g<0>", t)
