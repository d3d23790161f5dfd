import random

import pytest
from pyspark.sql import functions as F

from seqspark.functions import arrays as ar
from seqspark.functions.hashing import base, unit
from seqspark.operators import examples as ex, noise as nz
from seqspark.operators.ordering import ranked, running


def sizes_table(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "i bigint, size bigint")


def greedy(sizes, limit):
    out, cur, block = [], 0, 0
    for s in sizes:
        if not (cur + s <= limit or cur == 0):
            cur, block = 0, block + 1
        cur += s
        out.append(block)
    return out


@pytest.mark.parametrize("buckets", [1, 3, 6])
def test_complete_blocks_equal_the_sequential_greedy(spark, buckets):
    rng = random.Random(buckets)
    for limit in (4, 13):
        sizes = [3, 1, 2, 7] + [rng.choice([1, 1, 2, 3, 5, 9, 20]) for _ in range(400)]
        got = ex.pack_sentences(sizes_table(spark, sizes).repartition(5), ["i"], "size", limit, buckets)
        assert [r["block_id"] for r in got.orderBy("i").collect()] == greedy(sizes, limit)


def test_running_sums_with_hot_group_and_any_partitioning(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaaabcd"), i, rng.randint(0, 9)) for i in range(500)]
    want, acc = {}, {}
    for g, i, v in rows:
        acc[g] = acc.get(g, 0) + v
        want[i] = acc[g]
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint")
    for parts, buckets in ((1, 1), (4, 5), (16, 8)):
        out = running(df.repartition(parts), ["i"], {"s": F.col("v")}, ["g"], buckets)
        assert {r["i"]: r["s"] for r in out.collect()} == want
        order = ranked(df.repartition(parts), ["g", "i"], buckets=buckets).orderBy("rank").collect()
        assert [(r["g"], r["i"]) for r in order] == sorted((g, i) for g, i, _ in rows)
        assert [r["rank"] for r in order] == list(range(500))


def test_null_keys_come_first(spark):
    df = spark.createDataFrame([(2, 5), (None, 7), (1, 1), (None, 7)], "k bigint, v bigint").repartition(3)
    out = running(df, ["k"], {"s": F.col("v")}, buckets=3).orderBy("k", "s").collect()
    assert [(r["k"], r["s"]) for r in out] == [(None, 7), (None, 14), (1, 15), (2, 20)]
    per = running(df, ["v"], {"s": F.col("v")}, ["k"], buckets=3).collect()
    assert sorted((r["k"] or 0, r["s"]) for r in per) == [(0, 7), (0, 14), (1, 1), (2, 5)]


def test_token_blocks_and_targets(spark):
    sents = [[10, 11, 2], [2], [12, 2], [13, 14, 15, 16, 17, 18, 2]]
    rows = [(i, s, list(range(len(s)))) for i, s in enumerate(sents)]
    df = spark.createDataFrame(rows, "i bigint, ids array<int>, off array<int>")
    flat = [t for s in sents for t in s]
    got = [r["item"] for r in ex.token_blocks(df, ["i"], "ids", 4).orderBy("block_id").collect()]
    assert got == [flat[i : i + 4] for i in range(0, len(flat), 4)]
    t = ex.block_targets(df, ["i"], "ids", "off", 4).orderBy("block_id").collect()
    assert [r["source"] for r in t] == [[2, 10, 11, 2], [2, 12, 2, 13], [14, 15, 16, 17], [18]]
    # Blocks start at offsets 0, 0, 2 and 6 of their sentences.
    assert [r["past"] for r in t] == [[1, 2, 10, 11], [1, 2, 12, 2], [13, 14, 15, 16], [17]]
    # With five tokens the second block starts at offset 1.
    t = ex.block_targets(df, ["i"], "ids", "off", 5).orderBy("block_id").collect()
    assert t[1]["source"] == [12, 2, 13, 14, 15] and t[1]["past"] == [2, 12, 2, 13, 14]
    eos = ex.sentence_blocks(df.withColumn("n", F.size("ids")), ["i"], F.col("n")).orderBy("block_id")
    assert [(r["block_id"], r["i"]) for r in eos.collect()] == [(0, 0), (1, 2), (2, 3)]


def test_masked_example_invariants(spark):
    rows = [(i, [5 + (i + j) % 40 for j in range(i % 30)] + [2]) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, ids array<int>")
    out = ex.masked_example(df, "ids", base(3, F.col("i")), vocab_size=50).orderBy("i").collect()
    kinds = {"mask": 0, "keep": 0, "other": 0}
    for r in out:
        x = [4] + list(r["ids"])
        picked = [k for k, t in enumerate(r["target"]) if t != 1]
        assert len(picked) == min(max(1, round(0.15 * len(x))), len(x) - 2)
        for k, t in enumerate(x):
            if k in picked:
                assert r["target"][k] == t and t not in (2, 4)
                kinds["mask" if r["source"][k] == 0 else "keep" if r["source"][k] == t else "other"] += 1
            else:
                assert r["source"][k] == t
    assert kinds["mask"] / sum(kinds.values()) > 0.7 and kinds["other"] > 0 and kinds["keep"] > 0


def test_property_pair_and_eos_examples(spark):
    df = spark.createDataFrame([([5, 6, 7, 2], [5, 2])], "source array<int>, target array<int>")
    r = ex.property_example(df.withColumnRenamed("source", "ids").drop("target"), "ids").collect()[0]
    assert r["source"] == [4, 7, 6, 5] and r["target"] == [4, 5, 6, 7, 2]
    r = ex.pair_example(df, append_eos_to_target=True, remove_eos_from_source=True).collect()[0]
    assert r["source"] == [5, 6, 7] and r["target"] == [5, 2]
    r = ex.transform_eos(df, remove_src=True, remove_tgt=True).collect()[0]
    assert r["source"] == [5, 6, 7] and r["target"] == [5]
    with pytest.raises(Exception, match="unexpected EOS"):
        ex.transform_eos(df, append_src=True).collect()
    with pytest.raises(ValueError):
        ex.transform_eos(df, append_src=True, remove_src=True)
    assert ex.eos_violations(df, "source", True).collect()[0]["violations"] == 0


def test_select_targets(spark):
    df = spark.createDataFrame([([2, 7, 8], [7, 8, 9], [1, 2, 7])], "source array<int>, future array<int>, past array<int>")
    r = ex.select_targets(df, ["self", "future", "past"], add_eos=True).collect()[0]
    assert r["source"] == [2, 7, 8, 2] == r["target_self"]
    assert r["target_future"] == [7, 8, 9, 1] and r["target_past"] == [1, 2, 7, 8]
    assert ex.select_targets(df, None).collect()[0]["target_future"] == [7, 8, 9]


def test_corpus_mixing(spark, monkeypatch):
    rows = [("a", i) for i in range(5)] + [("b", i) for i in range(2)] + [("c", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i bigint")
    for limit in (1 << 16, 2):
        monkeypatch.setattr(ex, "REPEATS_PER_ROW", limit)
        got = {r["new_id"]: (r["k"], r["i"]) for r in ex.concat_corpora(df, "k", ["i"], {"a": 2, "c": 3}).collect()}
        want = rows[:5] * 2 + rows[5:7] + rows[7:] * 3
        assert got == dict(enumerate(want))
        z = {(r["step"], r["k"]): r["i"] for r in ex.round_robin(df, "k", ["i"]).collect()}
        assert z == {(s, k): s % n for s in range(5) for k, n in (("a", 5), ("b", 2), ("c", 3))}
    assert ex.round_robin(df, "k", ["i"], eval_key="b").count() == 2
    pairs = spark.createDataFrame([("en-de",), ("de-en",)], "p string").select(ex.canonical_pair(F.col("p")).alias("p"))
    assert {r["p"] for r in pairs.collect()} == {"de-en"}


SENTS = [["he@@", "llo", "n@@", "ew", "y@@", "or@@", "k", "</s>"], ["how", "are", "y@@", "ou", "</s>"]]


def test_word_index_modes(spark):
    df = spark.createDataFrame([(s,) for s in SENTS], "p array<string>")
    got = [r["w"] for r in df.select(nz.word_index(F.col("p")).alias("w")).collect()]
    assert got == [[0, 0, 1, 1, 2, 2, 2, 3], [0, 1, 2, 2, 3]]
    marked = spark.createDataFrame([(["he", "llo_EOW", "n", "ew_EOW"],)], "p array<string>")
    assert marked.select(nz.word_index(F.col("p"), None, "_EOW").alias("w")).collect()[0]["w"] == [0, 0, 1, 1]
    assert marked.select(nz.word_index(F.col("p"), None, None).alias("w")).collect()[0]["w"] == [0, 1, 2, 3]


def words(pieces):
    return (" ".join(pieces)).replace("@@ ", "@@").split(" ")


def test_noise_keeps_words_whole_and_the_end(spark):
    rows = [(i, SENTS[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, p array<string>").withColumn("a", base(9, F.col("i")))
    acc = F.col("a")
    out = df.select(
        "p",
        nz.word_dropout(F.col("p"), 0.4, acc).alias("drop"),
        nz.word_dropout(F.col("p"), 0.4, acc, blank="<unk>").alias("blank"),
        nz.word_shuffle(F.col("p"), 3, acc).alias("shuffle"),
        nz.word_shuffle(F.col("p"), 0, acc).alias("same"),
    ).collect()
    dropped = 0
    for r in out:
        original = words(r["p"])
        assert r["drop"][-1] == "</s>" and len(r["drop"]) >= 2
        if len(r["drop"]) > 2:
            it = iter(original)
            assert all(w in it for w in words(r["drop"]))
        dropped += len(original) - len(words(r["drop"]))
        assert len(r["blank"]) == len(r["p"]) and r["blank"][-1] == "</s>"
        assert r["same"] == r["p"]
        moved = words(r["shuffle"])
        assert sorted(moved) == sorted(original) and moved[0] == original[0] and moved[-1] == "</s>"
        assert all(abs(moved.index(w) - original.index(w)) < 3 for w in original)
    assert 0.2 < dropped / sum(len(words(r["p"])) - 1 for r in out) < 0.55
    with pytest.raises(ValueError):
        nz.word_shuffle(F.col("p"), 1, acc)
    noisy = df.transform(nz.noise("p", "a", 3, 0.1, 0.1)).collect()
    assert all(r["p"][-1] == "</s>" for r in noisy)


def test_draws_are_uniform_and_replayable(spark):
    u = spark.range(20000).select(unit(5, F.col("id"), F.lit(3)).alias("u"))
    s = u.agg(F.avg("u").alias("m"), F.stddev("u").alias("s")).collect()[0]
    assert abs(s["m"] - 0.5) < 0.01 and abs(s["s"] - 12**-0.5) < 0.01
    assert u.repartition(7).orderBy("u").head(5) == u.orderBy("u").head(5)


def test_back_translation_swaps_sides(spark):
    samples = spark.createDataFrame([(0, [4, 5, 2]), (1, [4, 5, 2])], "id bigint, source array<int>")
    best = spark.createDataFrame([(0, [4, 2]), (1, [4, 5, 4, 2])], "id bigint, tokens array<int>")
    got = {r["id"]: (r["source"], r["target"]) for r in ex.back_translate(samples, best).collect()}
    assert got == {0: ([4, 2], [4, 5, 2]), 1: ([4, 5, 4, 2], [4, 5, 2])}
    from seqspark.operators.batching import collate

    pairs = ex.back_translate(samples, best).withColumn("batch_id", F.lit(0))
    r = collate(pairs, "source", "target").collect()[0]
    assert r["src_tokens"] == [[4, 5, 4, 2], [1, 1, 4, 2]] and r["target"] == [[4, 5, 2], [4, 5, 2]]
    assert r["prev_output_tokens"] == [[2, 4, 5], [2, 4, 5]] and r["ntokens"] == 6


def test_padding_functions(spark):
    left = [[2, 3, 4, 5, 6], [1, 7, 8, 9, 10], [1, 1, 1, 11, 12]]
    right = [[2, 3, 4, 5, 6], [7, 8, 9, 10, 1], [11, 12, 1, 1, 1]]
    df = spark.createDataFrame(list(zip(left, right)), "l array<int>, r array<int>")
    got = df.select(ar.flip_padding(F.col("l"), False).alias("a"), ar.flip_padding(F.col("r"), True).alias("b"), ar.strip_pad(F.col("l")).alias("c")).collect()
    assert [x["a"] for x in got] == right and [x["b"] for x in got] == left and got[2]["c"] == [11, 12]
    pos = spark.createDataFrame([([9] * 5, [9] * 5), ([1, 9, 9, 9, 9], [9, 9, 9, 9, 1]), ([1, 1, 1, 9, 9], [9, 9, 1, 1, 1])], "l array<int>, r array<int>")
    got = pos.select(ar.position_ids(F.col("l")).alias("l"), ar.position_ids(F.col("r")).alias("r")).collect()
    assert [x["l"] for x in got] == [[2, 3, 4, 5, 6], [1, 2, 3, 4, 5], [1, 1, 1, 2, 3]]
    assert [x["r"] for x in got] == [[2, 3, 4, 5, 6], [2, 3, 4, 5, 1], [2, 3, 1, 1, 1]]


def test_any_number_of_corpora_in_a_chosen_order(spark):
    df = spark.range(6000).select(F.col("id").alias("i"), F.concat(F.lit("c"), F.col("id") % 3000).alias("name"))
    rows = ex.concat_corpora(df, "name", ["i"], {"c7": 2}, ["c9", "c7"]).collect()
    assert sorted(r["new_id"] for r in rows) == list(range(6002))
    first = sorted((r["new_id"], r["i"]) for r in rows)[:6]
    assert [i for _, i in first] == [9, 3009, 7, 3007, 7, 3007]
    assert ex.round_robin(df.filter("name in ('c1', 'c2')"), "name", ["i"]).count() == 4


def _stream(rows):
    """Tokens in the order (key, nulls first), equal keys as written; (token, offset in its row)."""
    return [(t, i) for _, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i, t in enumerate(ids or [])]


@pytest.mark.parametrize("parts, sampled", [(1, 32), (3, 2)])
def test_blocks_of_repeated_and_null_keys(spark, monkeypatch, parts, sampled):
    import random

    rng, rows = random.Random(parts), []
    for n in range(200):
        key = rng.choice([None, 1, 2, 2, rng.randint(0, 9)])
        rows.append((key, None if n % 17 == 0 else [1000 * n + i for i in range(rng.randint(0, 9))] + [2]))
    monkeypatch.setattr(ex, "SAMPLED", sampled)
    df = spark.createDataFrame([(k, ids, ids and list(range(len(ids))), 1) for k, ids in rows], "k int, ids array<int>, off array<int>, _bucket int").coalesce(1)
    want = _stream(rows)
    for size in (1, 4, 7, 5000):
        blocks = {r["block_id"]: r["item"] for r in ex.token_blocks(df.repartition(parts) if size == 7 else df, ["k"], "ids", size).collect()}
        got = [t for b in sorted(blocks) for t in blocks[b]]
        assert sorted(blocks) == list(range(-(-len(want) // size))) and all(len(blocks[b]) == size for b in sorted(blocks)[:-1])
        if size == 7:  # dealt anew: rows of one key in any order, but whole and in the order of keys
            assert sorted(got) == sorted(t for t, _ in want)
        else:
            assert got == [t for t, _ in want]
    targets = ex.block_targets(df, ["k"], "ids", "off", 4).orderBy("block_id").collect()
    flat = [t for t, _ in want]
    for r in targets:
        g, off = r["block_id"] * 4, want[r["block_id"] * 4][1]
        before = 2 if off == 0 else flat[g - 1]
        assert r["source"] == [before, *r["item"]][:-1] and r["past"][:1] == [1 if off == 0 else 2 if off == 1 else flat[g - 2]]
    index = {r["block_id"]: r for r in ex.block_index(df, ["k"], "ids", "off", 4).collect()}
    assert [(index[b]["start"]["line"], index[b]["start"]["offset"]) for b in sorted(index)] == want[::4]


def test_blocks_of_an_empty_stream(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert ex.token_blocks(df, ["k"], "ids", 4).count() == 0 and ex.token_blocks(df.limit(0), ["k"], "ids", 4).count() == 0


def test_closest_equals_all_pairs(spark):
    rng = random.Random(8)
    values = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(0, 60, 3)]), n) for n in range(150)]
    asked = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(-5, 70)]), n, "x") for n in range(150)]
    got = ex.closest(
        spark.createDataFrame(asked, "g int, size int, id int, _name string").repartition(3), spark.createDataFrame(values, "g int, size int, hyp int"), ["g"], "size", "hyp"
    ).collect()
    best = {}
    for r in got:
        best[r["id"]] = min(best.get(r["id"], (99, 999)), (r["distance"], r["hyp"]))
    want = {}
    for g, size, n, _ in asked:
        found = [(abs(size - s), h) for k, s, h in values if k == g and s is not None] if size is not None else []
        if found:
            want[n] = min(found)
    assert best == want


def test_masked_example_equals_a_plain_loop(spark):
    from seqspark.functions.hashing import folds, units

    rng = random.Random(5)
    rows = [(i, [rng.randrange(2, 50) for _ in range(rng.randrange(40))] + [2]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [7, None, 9]), (203, [4, 2]), (None, [7, 8])]
    df = spark.createDataFrame(rows, "i bigint, ids array<int>").coalesce(1)
    hashes = {r["i"]: r["h"] for r in df.select("i", base(3, F.col("i")).alias("h")).collect()}
    for go in (4, None):
        out = ex.masked_example(df, "ids", base(3, F.col("i")), vocab_size=50, go=go)
        # Draws are made in Arrow batches, not by functions over elements.
        assert "sort_array" not in out.select("source", "target")._jdf.queryExecution().optimizedPlan().toString()
        for r in out.collect():
            if r["ids"] is None:
                assert r["source"] is None and r["target"] is None
                continue
            x, acc = ([] if go is None else [go]) + r["ids"], hashes[r["i"]]
            able = [] if acc is None else [k for k, t in enumerate(x) if t is not None and t not in (2, go)]
            picked = sorted(able, key=lambda k: (int(folds(acc, k)), k))[: max(1, round(len(x) * 0.15))]
            source, target = list(x), [1] * len(x)
            for k in picked:
                u = units(acc, k + 1_000_000_007)
                target[k] = x[k]
                source[k] = 0 if u < 0.8 else x[k] if u < 0.9 else int(units(acc, k + 1_500_000_001) * 50)
            assert (r["source"], r["target"]) == (source, target)
