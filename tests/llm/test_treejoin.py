import random
import re

import numpy as np
from helpers import awkward, empty, frame, words
from test_duplicates import roots

from seqspark.llm import treejoin as tj


def sets_of(rows, k=5):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(rows, k=5, percent=80):
    sets = sets_of(rows, k)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    found = roots(pairs, range(len(rows)))
    groups = {}
    for i, r in found.items():
        groups.setdefault(r, []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in groups[r] if x is not None), default=None)) for i, r in found.items()), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, base, edits, block=0):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    at = rng.randrange(len(w))
    return " ".join(w[:at] + w[at + block :])


def family(rng, n, start, size=300):
    """Near copies around the limit: scattered edits, blocks cut and appended, common vocabulary."""
    base = words(rng, size).split(" ")
    rows = []
    for i in range(n):
        text = edited(rng, base, rng.randint(0, 12), rng.choice([0, 0, 20, 40]))
        rows.append((start + i, text + (" " + words(rng, rng.randint(1, 90)) if rng.random() < 0.3 else "")))
    return rows


def test_shingles_follow_the_definition():
    rng = random.Random(1)
    for t in ["", None, "One", "a b c", "Éa éA\xa0b c d e", "x\x1cy z  w\x0bv\tu", words(rng, 500), "a b c d e " * 50]:
        assert len(tj.shingle_set(t.encode() if t else None, 5)) == len(sets_of([(0, t)])[0])
    one, two = (tj.shingle_set(t.encode(), 5) for t in ("One two THREE four five six", "one Two three four  five\nsix"))
    assert (one == two).all() and tj.shingle_set("Éa".encode(), 5) != tj.shingle_set("éa".encode(), 5)


def test_tree_walk_finds_what_comparison_finds():
    rng = np.random.default_rng(2)
    for levels in (1, 6):
        tj.LEVELS = levels
        base = np.arange(60)
        sets = [np.unique(np.concatenate([base[rng.random(60) > 0.1 * rng.random()], rng.integers(0, 200, rng.integers(1, 12))])) for _ in range(80)]
        sets += [np.arange(n) for n in range(1, 30)] + [np.array([500])]
        sets = list({tuple(s.tolist()): s for s in sets}.values())
        tree = tj.PrefixTree(sets)
        for x in sets + [np.array([7, 900]), np.array([999])]:
            for percent in (50, 80, 100):
                least, most = -(-percent * len(x) // 100), 100 * len(x) // percent
                want = {i for i, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))}
                assert {tree.order[n] for n in tree.walk(x, least, most, percent).tolist()} == want
    assert not tree.place.any()


def test_components_equal_brute_force_also_in_small_cells(spark):
    rng = random.Random(3)
    rows = awkward() + family(rng, 40, 100) + family(rng, 25, 200, 60) + [(300 + i, "form " * 3 + words(rng, 2)) for i in range(10)]
    rows += [(None, rows[40][1]), (7, rows[41][1]), (400, "one two"), (401, "One  two"), (402, "ONE TWO THREE")]
    want = brute(rows)
    assert got(tj.similar_sets(frame(spark, rows), "doc_id", "text")) == want
    assert got(tj.similar_sets(frame(spark, rows, 7), "doc_id", "text", cell=1500)) == want


def test_rounds_are_for_blocks_and_for_links_across_chunks_only(spark, monkeypatch):
    """What a task has linked it names itself: a table of links is gone over in rounds once for
    the blocks, and once more only where sets of large blocks are apart from the largest group."""
    rng = random.Random(5)
    rows = family(rng, 40, 100) + family(rng, 25, 200, 200) + awkward(3)
    seen, before = [], tj.components
    monkeypatch.setattr(tj, "components", lambda links: seen.append(links.count()) or before(links))
    want = brute(rows)
    assert got(tj.similar_sets(frame(spark, rows), "doc_id", "text")) == want
    assert len(seen) == 1
    assert got(tj.similar_sets(frame(spark, rows, 5), "doc_id", "text", cell=1500)) == want
    assert len(seen) == 3 and seen[2] < seen[1]


def test_another_similarity_and_empty_tables(spark):
    rng = random.Random(4)
    rows = family(rng, 30, 0, 80) + awkward(2)
    assert got(tj.similar_sets(frame(spark, rows), "doc_id", "text", k=3, percent=60)) == brute(rows, 3, 60)
    assert got(tj.similar_sets(empty(spark), "doc_id", "text")) == []
    blank = [(1, None), (2, ""), (3, " \n"), (None, "")]
    assert got(tj.similar_sets(frame(spark, blank), "doc_id", "text")) == brute(blank)


def test_blocks_do_not_grow_with_the_number_of_shared_shingles(spark, monkeypatch):
    """However many shingles are shared, texts that have most of theirs alone are in no block. A
    list of the most frequent shingles that holds a part only had them linked by the others."""
    monkeypatch.setattr(tj, "LISTED", 8, raising=False)
    rng = random.Random(6)
    passages = [" ".join(f"p{i}x{n}" for n in range(12)) for i in range(40)]
    rows = [(i, " ".join(f"{passages[p]} " + " ".join(f"own{i}x{p}x{n}" for n in range(20)) for p in rng.sample(range(40), 8))) for i in range(60)]
    seen, before = [], tj.components
    monkeypatch.setattr(tj, "components", lambda links: seen.append(links.count()) or before(links))
    assert got(tj.similar_sets(frame(spark, rows, 6), "doc_id", "text")) == brute(rows)
    assert seen == [0]
    near = [(100 + i, edited(rng, rows[i][1].split(" "), 3)) for i in range(5)]
    assert got(tj.similar_sets(frame(spark, rows + near + near[:2], 6), "doc_id", "text")) == brute(rows + near + near[:2])
    assert 0 < seen[1] <= 20


def test_pairs_of_chunks_are_sent_in_parts_of_bounded_size(spark, monkeypatch):
    """Forms that agree in most of their text, but not enough: one block, whose sets all meet all
    chunks. What is sent at once stays under a share of all shingles and one more pair."""
    monkeypatch.setattr(tj, "SHARE", 1, raising=False)
    rng = random.Random(9)
    form = words(rng, 100).split(" ")
    rows = [(i, " ".join(form + [f"own{i}x{n}" for n in range(rng.randint(16, 24))])) for i in range(30)]
    rows += [(200 + i, edited(rng, rows[10 * i][1].split(" "), 1)) for i in range(3)]
    sent, before = [], tj.tree_links
    monkeypatch.setattr(tj, "tree_links", lambda df, percent: sent.append(df.selectExpr("sum(size(own))").first()[0]) or before(df, percent))
    assert got(tj.similar_sets(frame(spark, rows, 5), "doc_id", "text", cell=800)) == brute(rows)
    total = sum(len(x) for x in sets_of(rows))
    assert len(sent) > 4 and sum(sent[2:]) > 2 * total
    assert max(sent[2:]) <= total + 4 * 800


def test_first_shingles_are_those_of_the_whole_order():
    rng = np.random.default_rng(7)
    for percent in (0, 50, 80, 100):
        sets = [rng.choice(60, rng.integers(1, 40)) for _ in range(30)]  # places may repeat in a set
        count = np.bincount(np.concatenate(sets), minlength=60)
        size, text, place = np.array(list(map(len, sets))), np.repeat(np.arange(30), list(map(len, sets))), np.concatenate(sets)
        shared = np.flatnonzero(count[place] > 1)
        found = shared[tj.first_shingles(size, text[shared], place[shared], count[place[shared]], percent)]
        want = []
        for n, x in enumerate(sets):
            first = sorted(x.tolist(), key=lambda p: (count[p], p))[: len(x) - -(-percent * len(x) // 100) + 1]
            want += [(n, p) for p in first if count[p] > 1]
        assert sorted(zip(text[found].tolist(), place[found].tolist())) == sorted(want)


def test_set_numbers_come_back_as_they_were():
    for x in ([0], [5, 5, 700, 65535], [0, 65535, 65535], sorted(random.Random(8).choices(range(1 << 16), k=999))):
        assert tj._numbers(tj._steps(np.array(x))).tolist() == x
