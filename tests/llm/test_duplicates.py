import random

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from helpers import awkward, empty, frame, words

from seqspark.llm import components as cc, decontam as dc, simhash as sim, sketches as sk


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_loops_and_nothing(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(500, 600 + i) for i in range(50)] + [(7, 7), (8, 9), (9, 8), (8, 9)]
    pairs += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(70)]
    df = spark.createDataFrame(pairs + [(None, 3)], "a bigint, b bigint").repartition(4)
    want = roots(pairs, {n for p in pairs for n in p})
    assert {r["node"]: r["root"] for r in cc.components(df).collect()} == want
    assert cc.components(df.limit(0)).count() == 0


def by_definition(text, k=4):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = [x for x in (text or "").encode().translate(table).split()]
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_follow_the_definition():
    rng = random.Random(5)
    for t in ["", "One", "a b c", "Éa éA\xa0b c d e", "x\x1cy z  w\x0bv\tu", words(rng, 200), words(rng, 300_000)]:
        assert sim.fingerprint(t) == by_definition(t)


def test_covering_reaches_every_close_pair():
    rng = np.random.default_rng(1)
    for blocks, r, distance in ((3, 4, 4), (4, 4, 3), (2, 5, 4)):
        reach = 1 + distance // blocks
        codes = [(lo, c, c.patterns(reach)) for lo, c in sim.block_codes(blocks, r)]

        def reached(x):
            out = set()
            for n, (lo, c, patterns) in enumerate(codes):
                v = np.array([(x >> lo) & ((1 << c.bits) - 1)], np.uint64)
                out |= {(n, int(a)) for a in v ^ patterns[int(c.syndromes(v)[0])]}
            return out

        for _ in range(40):
            x = int(rng.integers(0, 2**63))
            y = x
            for b in rng.choice(64, distance, replace=False):
                y ^= 1 << int(b)
            assert reached(x) & reached(y)


def test_simhash_links_equal_brute_force_also_with_small_tiles(spark):
    rng = random.Random(6)
    base = words(rng, 400).split(" ")
    rows = awkward()
    for i in range(60):  # a crowd of near copies
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(400)] = "new"
        rows.append((100 + i, " ".join(w)))
    fps = [(i, by_definition(t)) for i, t in rows]
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a[1] ^ b[1]).bit_count() <= 4]
    index = {n: f for n, f in enumerate(fps)}
    want = roots([(i, j) for i in index for j in index if i < j and (index[i][1] ^ index[j][1]).bit_count() <= 4], index)
    smallest = {}
    for n, root in want.items():
        ids = [i for i in (fps[n][0],) if i is not None]
        smallest[root] = smallest.get(root, []) + ids
    expected = sorted((fps[n][0] if fps[n][0] is not None else -1, f"{fps[n][1]:016x}", min(smallest[root], default=-1)) for n, root in want.items())
    got = sim.near_duplicates(frame(spark, rows), "doc_id", "text").collect()
    show = lambda x: -1 if x is None else x
    assert sorted((show(r[0]), r[1], show(r[2])) for r in got) == expected
    assert pairs
    prints = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in {f for _, f in fps}], "fp bigint").repartition(4)
    want_links = roots([(a, b) for a in {f for _, f in fps} for b in {f for _, f in fps} if a < b and (a ^ b).bit_count() <= 4], {f for _, f in fps})
    linked = {int(np.int64(r["node"]).view(np.uint64)): int(np.int64(r["root"]).view(np.uint64)) for r in cc.components(sim.links(prints, tile=8)).collect()}
    groups = {}
    for node, root in linked.items():
        groups.setdefault(root, set()).add(node)
    brute = {}
    for node, root in want_links.items():
        brute.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in brute.values() if len(g) > 1)
    assert sim.near_duplicates(empty(spark), "doc_id", "text").count() == 0


def test_similar_groups_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [r for r in awkward() if r[0] is not None]
    base = words(rng, 200).split(" ")
    for i in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(200)] = words(rng, 1)
        rows.append((200 + i, " ".join(w)))
    ids = sorted({i for i, _ in rows})
    text = {i: t or "" for i, t in rows}
    sets = {i: set(sim.shingle_set(text[i], 5).tolist()) for i in ids}
    pairs = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = roots(pairs, ids)
    got = {r["doc_id"]: r["group"] for r in sim.similar_groups(frame(spark, rows), "doc_id", "text").collect()}
    assert got == want
    assert sim.similar_groups(empty(spark), "doc_id", "text").count() == 0


def grouped_by_definition(rows):
    text = {i: t or "" for i, t in rows}
    sets = {i: set(sim.shingle_set(t, 5).tolist()) for i, t in text.items()}
    ids = sorted(text)
    pairs = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    return pairs, roots(pairs, ids)


def test_similar_groups_find_appended_cut_and_replaced_blocks(spark):
    rng = random.Random(12)
    rows = []
    for i in range(90):
        n = rng.randint(60, 500)
        w = words(rng, n).split(" ")
        m = rng.randint(n // 20, n // 5)
        at = rng.randrange(n - m)
        other = [w + words(rng, m).split(" "), w[: n - m], w[:at] + words(rng, m // 2 + 1).split(" ") + w[at + m // 2 :]][i % 3]
        rows += [(1000 + i, " ".join(w)), (2000 + i, " ".join(other))]
    pairs, want = grouped_by_definition(rows)
    assert len(pairs) > 60
    got = {r["doc_id"]: r["group"] for r in sim.similar_groups(frame(spark, rows), "doc_id", "text").collect()}
    assert got == want


def test_similar_groups_in_families_of_one_vocabulary_and_of_templates(spark):
    rng = random.Random(13)
    base, rows = words(rng, 150).split(" "), []
    for i in range(150):
        w = rng.sample(base, 150)
        rows.append((1000 + i, " ".join(w)))
        if i % 5 == 0:  # the same words, a block moved
            rows.append((2000 + i, " ".join(w[40:] + w[:40])))
    form = words(rng, 100).split(" ")
    for i in range(150):  # forms whose fields leave them about the similarity apart
        rows.append((3000 + i, " ".join(form[: 80 + i % 20] + words(rng, rng.randint(4, 14)).split(" "))))
    _, want = grouped_by_definition(rows)
    got = {r["doc_id"]: r["group"] for r in sim.similar_groups(frame(spark, rows), "doc_id", "text", tile=16, light=8).collect()}
    assert got == want


def jaccard(a, b):
    from collections import Counter

    a, b = Counter(sk.paragraphs(a)), Counter(sk.paragraphs(b))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_sketch_differences_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    a = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 5, 40, 3000)]
    b = [np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, m).astype(np.uint64)]) for x, m in zip(a, (0, 0, 3, 100, 10))]
    for x, y, (p, m) in zip(a, b, sk.differences(a, b)):
        assert set(p.tolist()) == set(x.tolist()) - set(y.tolist()) and set(m.tolist()) == set(y.tolist()) - set(x.tolist())


def test_revisions_equal_brute_force(spark):
    import hashlib

    rng = random.Random(9)
    rows = awkward() + [(300 + i, ". ".join(words(rng, 8) for _ in range(12)) + ".\nsame line\nsame line") for i in range(10)]
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for parts in (1, 4):
        got = sk.revisions(frame(spark, rows, parts), "doc_id", "text").collect()
        want = []
        for n, (i, t) in enumerate(rows):
            nxt = rows[(n + 1) % len(rows)][1]
            k = len(t) // 4
            e = t[: len(t) - k] + nxt[:k]
            want.append((i or -1, len(t), hashlib.sha256(e.encode()).hexdigest(), sk.fingerprints([sk.digests(t)])[0], sk.fingerprints([sk.digests(e)])[0], round(jaccard(t, e), 12), round(jaccard(t, nxt), 12)))
        assert sorted((r[0] or -1, *r[1:5], round(r[5], 12), round(r[6], 12)) for r in got) == sorted(want)
    assert sk.revisions(empty(spark), "doc_id", "text").count() == 0
    changed = sk.changed_paragraphs(frame(spark, [(1, "a\nb"), (2, "x"), (None, "n")]), frame(spark, [(1, "a\nc"), (3, "y"), (None, "n")]), "doc_id", "text")
    assert {r["key" if "key" in r else "doc_id"]: (len(r["removed"]), len(r["added"])) for r in changed.collect()} == {1: (1, 1), 2: (1, 0), 3: (0, 1), None: (0, 0)}


def test_containment_equals_sql(spark):
    rng = random.Random(10)
    items = [(n, words(rng, m)) for n, m in enumerate((3, 5, 9, 20, 40, 70))] + [(6, None), (7, ""), (None, "a b c d e f"), (8, "Same Item, of words five six!"), (9, "same item of words five six")]
    rows = awkward()
    for i, (_, t) in enumerate(items):
        w = (t or "").split(" ")
        rows.append((400 + i, words(rng, 50) + " " + (t or "").upper() + ", " + words(rng, 3000)))
        if len(w) > 30:  # one changed word of many, and too many
            rows.append((500 + i, " ".join([*w[:2], "x", *w[3:], words(rng, 9)])))
            rows.append((600 + i, " ".join(x if n % 6 else "y" for n, x in enumerate(w))))
    docs = frame(spark, rows)
    bench = spark.createDataFrame([(i, t, i) for i, t in items], "item_id bigint, text string, hits bigint")
    got = dc.contaminated(docs, bench).toPandas().sort_values(["doc_id", "item_id"], ignore_index=True)
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    db.register("benchmark", pa.table({"item_id": pa.array([r[0] for r in items], pa.int64()), "text": [r[1] for r in items]}))
    want = db.execute(dc.SQL).df().sort_values(["doc_id", "item_id"], ignore_index=True)
    assert len(want) >= 7 and got[want.columns].values.tolist() == want.values.tolist()
    kept = {r["doc_id"] for r in dc.decontaminate(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - set(want.doc_id)
    assert dc.contaminated(empty(spark), bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0


def test_crowded_shingles_are_paired_whole_whatever_was_expected_of_them(spark):
    """A shingle of a third of the rows, one on the limit and small ones, each expected to be
    crowded or not, rows repeated, and texts that have a root already."""
    sizes = {7: 200, -3: 8, 5: 9, 11: 2, 12: 1, 13: 3, 2**62: 40}
    for often in (set(), {7}, set(sizes)):
        rows, node = [], 0
        for anchor, n in sizes.items():
            rows += [(anchor, node + i, 20 + i % 7, i % 3, anchor in often) for i in range(n)]
            node += n // 2  # half of a shingle's texts have the next one too
        roots = [(i, i % 2) for i in range(0, node, 5)]
        table = spark.createDataFrame(rows + rows[:30], "anchor bigint, node bigint, size int, at int, often boolean")
        rooted = spark.createDataFrame(roots, "node bigint, root bigint")
        got = {tuple(r) for r in sim.prefix_pairs(table, rooted, 0.8, 16, 8).collect()}
        root, crowded = dict(roots), {a for a, n in sizes.items() if n > 8} | often
        want = set()
        for anchor in sizes:
            own = [r for r in rows if r[0] == anchor]
            for x in own:
                for y in own:
                    fits = min(x[2] - x[3], y[2] - y[3]) * 1.8 >= 0.8 * (x[2] + y[2]) - 1e-6
                    apart = root.get(x[1], x[1]) != root.get(y[1], y[1]) or anchor not in crowded
                    if x[1] < y[1] and fits and apart:
                        want.add((x[1], y[1]))
        assert got <= want
        # Repeated rows may take a shingle on the limit over it; pairs of one root may go then.
        assert {(a, b) for a, b in want if root.get(a, a) != root.get(b, b)} <= got


def test_parities_of_sets_of_any_sizes_bound_their_difference(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng, rows, bounds = np.random.default_rng(3), [], []
    for i, (n, m, common) in enumerate([(1, 1, 0), (1024, 1025, 900), (3000, 2500, 2400), (5000, 900, 100), (4096, 4097, 4096), (9000, 8800, 50), (7, 7, 7)]):
        pool = rng.integers(-(2**62), 2**62, n + m - common)
        a, b = np.unique(pool[:n]), np.unique(pool[n - common :])
        rows.append((i, sim.parities(a).tolist(), sim.parities(b).tolist()))
        bounds.append(len(np.setxor1d(a, b)))
    table = spark.createDataFrame(rows, "i int, _a array<bigint>, _b array<bigint>")
    words = F.least(F.size("_a"), F.size("_b"))
    apart = F.zip_with(sim.folded("_a", words), sim.folded("_b", words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    got = {r["i"]: sum(r["n"]) for r in table.select("i", apart.alias("n")).collect()}
    for i, (_, a, b) in enumerate(rows):
        size = 64 * min(len(a), len(b))
        flat = [np.unpackbits(np.array(x, np.int64).view(np.uint8)).reshape(-1, size).sum(axis=0) % 2 for x in (a, b)]
        assert got[i] == int((flat[0] != flat[1]).sum()) <= bounds[i]
    assert got[6] == 0 and got[5] > 0.2 / 1.8 * 17800


def test_frequent_shingles_are_counted_in_all_texts(spark):
    source = spark.range(60_000).selectExpr("id AS _key", "concat('one two three four five ', id) AS _text").coalesce(1)
    shingle, n = sim.frequent(source, 5)
    assert shingle.tolist() == sim.shingle_set("one two three four five", 5).tolist()
    assert n.tolist() == [60_000]
