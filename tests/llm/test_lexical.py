import math
import random
import re
from collections import Counter

from helpers import awkward, empty, frame, words

from seqspark.llm import lexical as lx


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top=20):
    bags = [(i, Counter(split(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = set()
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, []).extend(split(t))
    for item, query in wanted.items():
        found = []
        for (doc, bag), n in zip(bags, sizes):
            score = 0
            for t in query:
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * (75 + 25 * n * n_docs // total)))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out |= {(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_terms():
    for t in ["", None, "A b_c É x-9 Éa\x00b ıI", words(random.Random(1), 300)]:
        assert [x.decode() for x in lx.terms(t.encode() if t else None)] == split(t)


def test_ranking_equals_brute_force_also_in_blocks(spark):
    rng = random.Random(4)
    docs = awkward() + [(100 + i, words(rng, 12)) for i in range(60)] + [(200 + i, "same words here") for i in range(40)] + [(None, "same words here")]
    items = [(0, "same words Words here"), (1, words(rng, 30)), (2, ""), (3, None), (None, words(rng, 5)), (1, "ka lo"), (7, "zzz unknown"), (8, docs[3][1])]
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id bigint, text string, rank int, number int, term int")
    want = brute(docs, items)
    assert got(lx.rank_documents(frame(spark, docs), table)) == want
    assert got(lx.rank_documents(frame(spark, docs, 7), table, postings=5)) == want
    assert got(lx.rank_documents(frame(spark, docs), table, top=3)) == brute(docs, items, 3)


def test_small_cells_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lx, "CELLS", 8)
    monkeypatch.setattr(lx, "AT_ONCE", 10)
    docs, items = awkward(3), [(1, "ka lo mi ter"), (2, "su vor")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert got(lx.rank_documents(frame(spark, docs), table)) == brute(docs, items)
    assert got(lx.rank_documents(empty(spark), table)) == set()
    assert got(lx.rank_documents(frame(spark, docs), table.limit(0))) == set()
