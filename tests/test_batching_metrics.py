import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark import registry
from seqspark.operators import batching as bt, metrics as mt, ranking as rk


def literal_greedy(sizes, max_tokens, max_sentences, mult):
    """One sample at a time, straight from the rule."""
    batch, lens, out = [], [], []
    for i, m in enumerate(sizes):
        longest = max([*lens, m])
        full = batch and (len(batch) == max_sentences or (len(batch) + 1) * longest > max_tokens)
        if full:
            cut = max(mult * (len(batch) // mult), len(batch) % mult)
            out.append(batch[:cut])
            batch, lens = batch[cut:], lens[cut:]
        batch.append(i)
        lens.append(m)
    return out + ([batch] if batch else [])


def expand(runs):
    out = []
    for first, length, repeat, number in runs:
        for k in range(repeat):
            assert number + k == len(out)
            out.append(list(range(first + k * length, first + (k + 1) * length)))
    return out


def test_fold_equals_the_literal_greedy():
    rng = random.Random(0)
    for _ in range(400):
        n, order = rng.randint(1, 60), rng.choice(["sorted", "mixed"])
        sizes = [rng.choice([1, 2, 2, 2, 3, 5, 8, 40]) for _ in range(n)]
        if order == "sorted":
            sizes.sort()
        tokens = rng.choice([None, 6, 12, 30])
        sentences = rng.choice([None, 1, 4, 7])
        mult = rng.choice([1, 2, 3, 8])
        coded = []
        for s in sizes:
            if coded and coded[-1][0] == s:
                coded[-1][1] += 1
            else:
                coded.append([s, 1])
        want = literal_greedy(sizes, tokens or math.inf, sentences or math.inf, mult)
        assert expand(bt.fold_batches([tuple(c) for c in coded], tokens, sentences, mult)) == want


def test_batches_cover_every_sample_once_and_fit(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([3, 3, 3, 3, 7, 9, 12]), rng.randint(1, 12)) for i in range(800)]
    df = spark.createDataFrame(rows, "id bigint, s bigint, t bigint")
    for parts in (1, 9):
        out = bt.batch_by_size(df.repartition(parts).withColumn("h", bt.length_key(1, "id")), ["s", "t"], ["h", "id"], F.greatest("s", "t"), 48, 16, 4)
        got = out.collect()
        assert sorted(r["id"] for r in got) == list(range(800))
        ordered = sorted(got, key=lambda r: r["rank"])
        want = literal_greedy([max(r["s"], r["t"]) for r in ordered], 48, 16, 4)
        assert [r["batch_id"] for r in ordered] == [b for b, rows_ in enumerate(want) for _ in rows_]


def test_size_filters(spark):
    df = spark.createDataFrame([(0, 3, 9), (1, 8, 2), (2, 12, 12)], "id bigint, s bigint, t bigint")
    kept, ignored = bt.filter_by_size(df, (F.col("s"), F.col("t")), (10, None))
    assert {r["id"] for r in kept.collect()} == {0, 1}
    assert bt.ignored_report(ignored, "id").collect()[0].asDict() == {"n_ignored": 1, "first_ids": "2"}
    with pytest.raises(Exception, match="longer than the size limit"):
        bt.filter_by_size(df, F.col("s"), 5, raise_exception=True)[0].collect()
    assert bt.resolve_limits((5, None), 7, None, (None, 3)) == (5, 3) and bt.resolve_limits(None) is None


def test_shards_and_resume(spark):
    batches = spark.range(10).select(F.col("id").alias("batch_id"), F.col("id").alias("position"))
    got = sorted((r["shard"], r["step"], r["batch_id"]) for r in bt.shard(batches, 4).filter("batch_id is not null").collect())
    assert got == sorted((b % 4, b // 4, b) for b in range(10))
    assert {(r["shard"], r["step"]) for r in bt.shard(batches, 4).filter("batch_id is null").collect()} == {(2, 2), (3, 2)}
    assert bt.shard(batches, 5).filter("batch_id is null").count() == 0
    one = bt.shard(spark.range(150).select(F.col("id").alias("batch_id"), F.col("id").alias("position")), 1)
    assert bt.resume(one, 50).agg(F.min("batch_id")).collect()[0][0] == 50
    assert bt.resume_point(2, 150, 150) == (3, 0) and bt.resume_point(1, 50, 150) == (1, 50)
    e1, e2 = (bt.epoch_order(batches.select("batch_id"), 1, e).orderBy("position") for e in (1, 2))
    assert [r[0] for r in e1.select("batch_id").collect()] == [r[0] for r in e1.select("batch_id").collect()]
    assert e1.collect() != e2.collect()
    groups = bt.grouped_steps(bt.shard(batches, 4), 2).filter("shard = 0").orderBy("group").collect()
    assert [r["batches"] for r in groups] == [[0, 4], [8]]


def brute_bleu(pairs, order=4):
    ref_len = hyp_len = 0
    count, match = [0] * order, [0] * order
    for ref, hyp in pairs:
        ref_len, hyp_len = ref_len + len(ref), hyp_len + len(hyp)
        for n in range(1, order + 1):
            r = [tuple(ref[i : i + n]) for i in range(len(ref) - n + 1) if 3 not in ref[i : i + n]]
            h = [tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1)]
            count[n - 1] += len(h)
            match[n - 1] += sum(min(h.count(g), r.count(g)) for g in set(h))
    return ref_len, hyp_len, count, match


def test_trimming_of_many_rows_at_once():
    def one(row):
        first = next((i for i, x in enumerate(row) if x != 1), len(row) - 1)
        row = row[max(first, 0):]
        while len(row) > 1 and row[-1] in (1, 2):
            row = row[:-1]
        return row

    rng = np.random.default_rng(3)
    rows = [rng.choice([1, 2, 5], rng.integers(0, 7)).tolist() for _ in range(500)] + [[1, 1], [2], [1, 2], []]
    values, sizes = mt.trimmed(np.array(sum(rows, []), np.int64), np.array([len(r) for r in rows]))
    want = [one(r) for r in rows]
    assert values.tolist() == sum(want, []) and sizes.tolist() == [len(r) for r in want]


def test_bleu_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [([4, 5, 6, 7, 8], [4, 5, 6, 7, 8]), ([4, 5], [9, 10]), ([4, 4, 5], [4, 4, 4, 4]), ([3, 5, 3], [3, 5, 3]), ([5, 6, 7], [5]), ([7], [])]
    pairs += [([rng.randint(3, 7) for _ in range(rng.randint(1, 15))], [rng.randint(3, 7) for _ in range(rng.randint(1, 15))]) for _ in range(120)]
    raw = [(i, [1, 1] + r + [2], h + [2, 1] if h else h) for i, (r, h) in enumerate(pairs)]
    df = spark.createDataFrame(raw, "id bigint, r array<int>, h array<int>").repartition(3)
    monkeypatch.setattr(mt, "TOKENS_PER_CHUNK", 50)
    got = mt.bleu_stats(df, ["id"], "r", "h", by=[]).collect()[0]
    ref_len, hyp_len, count, match = brute_bleu(pairs)
    assert (got["ref_len"], got["hyp_len"]) == (ref_len, hyp_len)
    assert [got[f"count{k}"] for k in range(1, 5)] == count and [got[f"match{k}"] for k in range(1, 5)] == match
    r = mt.bleu(mt.bleu_stats(df, ["id"], "r", "h", by=[])).collect()[0]
    p = [m / c for m, c in zip(match, count)]
    want = 100 * min(1, math.exp(1 - ref_len / hyp_len)) * math.exp(sum(map(math.log, p)) / 4)
    assert abs(r["bleu"] - want) < 1e-9
    none = mt.bleu(mt.bleu_stats(df.filter("id = 1"), ["id"], "r", "h", by=[])).collect()[0]
    assert none["bleu"] == 0.0
    # Only end marks: one element is kept on each side.
    edge = spark.createDataFrame([(0, [2, 2], [1, 1])], "id bigint, r array<int>, h array<int>")
    assert mt.bleu_stats(edge, ["id"], "r", "h").collect()[0]["ref_len"] == 1


def test_sequence_score_and_label_smoothing(spark):
    probs = {0: [0.6, 0.7, 0.5, 0.9], 1: [0.6, 0.8, 0.15], 2: [0.3, 0.7]}
    rows = [(s, i, 4, math.log(p)) for s, ps in probs.items() for i, p in enumerate(ps)] + [(1, 3, 1, -9.0)]
    df = spark.createDataFrame(rows, "sample int, pos int, target int, logp double")
    got = {r["sample"]: r for r in mt.sequence_score(df, ["sample"]).collect()}
    for s, ps in probs.items():
        assert abs(got[s]["score"] - sum(map(math.log, ps)) / len(ps)) < 1e-12
        assert got[s]["positional"] == [math.log(p) for p in ps]
    table = [[0.05, 0.05, 0.1, 0.05, 0.3, 0.4, 0.05], [0.05, 0.10, 0.2, 0.05, 0.2, 0.3, 0.10], [0.05, 0.15, 0.3, 0.05, 0.1, 0.2, 0.15]]
    rows = [(s, t, [math.log(p) for p in table[i]]) for s, ts in ((0, [4, 2, 1]), (1, [4, 4, 2])) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "sample int, target int, l array<double>")
    plain = mt.label_smoothed(df, "l", "target", 0.0).agg(F.sum("loss"), F.sum("nll"), F.count(F.lit(1))).collect()[0]
    assert abs(plain[0] - plain[1]) < 1e-12 and plain[2] == 5
    smooth = mt.label_smoothed(df, "l", "target", 0.1).collect()
    want = sum(0.9 * -l[t] + 0.1 / 7 * -sum(l) for _, t, l in rows if t != 1)
    assert abs(sum(r["loss"] for r in smooth) - want) < 1e-9


def test_snapshots(spark):
    rows = [("checkpoint1.pt", "a", 0, 100.0, False), ("checkpoint2.pt", "a", 0, 1.0, False)]
    rows += [("checkpoint1.pt", "c", i, v, True) for i, v in enumerate([7.0, 8.0, 9.0])]
    rows += [("checkpoint2.pt", "c", i, 2.0, True) for i in range(3)] + [("checkpoint10.pt", "a", 0, 5.0, False)]
    df = spark.createDataFrame(rows, "snapshot string, key string, pos int, value double, is_int boolean")
    two = df.filter("snapshot <> 'checkpoint10.pt'")
    got = {(r["key"], r["pos"]): r["value"] for r in mt.average_snapshots(two).collect()}
    assert got == {("a", 0): 50.5, ("c", 0): 4.0, ("c", 1): 5.0, ("c", 2): 5.0}
    last = mt.last_snapshots(df, 2)
    assert {r[0] for r in last.select("snapshot").distinct().collect()} == {"checkpoint2.pt", "checkpoint10.pt"}
    assert not mt.average_snapshots(last).filter("key = 'c'").agg(F.bool_and("complete")).collect()[0][0]


def test_losses_and_merges(spark):
    df = spark.createDataFrame([(0, -1.0), (0, -2.0), (1, -3.0)], "s int, logp double")
    a = mt.cross_entropy(df, []).collect()[0]
    assert abs(a["loss"] - 2 / math.log(2)) < 1e-12 and a["nll_loss"] is None
    b = mt.cross_entropy(df, [], sample=["s"], sentence_avg=True).collect()[0]
    assert abs(b["loss"] - 3 / math.log(2)) < 1e-12 and abs(b["ppl"] - math.exp(2)) < 1e-9
    parts = spark.createDataFrame([("p", 0, 0.0), ("p", 3, 2.0), ("q", 0, 0.0), ("p", 1, 6.0)], "prop string, num bigint, loss double")
    got = {r["prop"]: (r["num"], r["loss"]) for r in mt.merge_weighted(parts, ["prop"], ["loss"]).collect()}
    assert got == {"p": (4, 3.0), "q": (0, 0.0)}
    rows = spark.createDataFrame([(0, 4, 4), (0, 9, 1), (1, 4, 5)], "s int, pred int, target int")
    assert mt.exact_match(rows, ["s"], "pred", "target").collect()[0]["accuracy"] == 0.5
    inf = mt.perplexity(F.lit(5000.0))
    assert spark.range(1).select(inf.alias("p")).collect()[0]["p"] == math.inf


def test_word_scores(spark):
    rows = [(0, ["a@@", "b", "c", "d@@", "e", "</s>"], [-1.0, -2.0, 0.0, -math.inf, -1.0, -4.0])]
    df = spark.createDataFrame(rows, "s int, p array<string>, l array<double>")
    got = [(r["word"], r["logp"], r["is_bpe"], r["next"]) for r in mt.word_scores(df, "p", "l", ["s"]).orderBy("word_idx").collect()]
    assert got == [("ab", -3.0, True, -4.0), ("c", 0.0, False, -4.0), ("</s>", -4.0, False, None)]


def test_histogram_like_numpy(spark):

    values = [float(v) for v in np.random.default_rng(0).normal(size=500)]
    h = mt.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 20).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r["cnt"] for r in h] == counts.tolist() and np.allclose([r["edge"] for r in h], edges[1:])


HYPS = [(0, 0, [0.9, 1.0]), (0, 1, [0.1, 0.9, 0.9, 1.0]), (1, 0, [0.7, 0.4, 0.4, 1.0]), (1, 1, [0.7, 0.4, 0.6])]


def hyps(spark):
    rows = []
    for s, h, ps in HYPS:
        cum = 0.0
        for i, p in enumerate(ps):
            cum += math.log(p)
            rows.append((s, h, i, 2 if i == len(ps) - 1 else 4, cum))
    return spark.createDataFrame(rows, "sample bigint, hyp bigint, pos int, token int, cum double")


@pytest.mark.parametrize("lenpen,normalize,best", [(1.0, True, [0, 0]), (0.6, True, [0, 1]), (5.0, True, [1, 0]), (1.0, False, [0, 1])])
def test_hypothesis_order_by_length_penalty(spark, lenpen, normalize, best):
    scored = rk.hypothesis_scores(hyps(spark), lenpen, normalize)
    for r in scored.collect():
        ps = next(p for s, h, p in HYPS if (s, h) == (r["sample"], r["hyp"]))
        assert abs(r["pos_score"] - math.log(ps[r["pos"]])) < 1e-9
    top = rk.n_best(scored.select("sample", "hyp", "score").distinct(), ["sample"], 1)
    assert [r["hyp"] for r in top.orderBy("sample").collect()] == best


def test_candidate_rules(spark):
    rows = [(0, b, t, -(1.0 + t + 0.1 * b), -b * 1.0) for b in range(2) for t in range(6)]
    cand = spark.createDataFrame(rows, "sample bigint, beam bigint, token bigint, lprob double, cum double")
    top = rk.beam_candidates(cand, 2, 1, 6).orderBy("rank").collect()
    assert [(r["beam"], r["token"]) for r in top] == [(0, 0), (0, 1), (1, 0), (0, 2)]
    assert {r["beam"] for r in rk.beam_candidates(cand, 2, 0, 6).collect()} == {0}
    free = rk.diverse_candidates(cand, 2, 2, 0.0, 1, 6).collect()
    assert sorted((r["grp"], r["token"]) for r in free) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    costly = rk.diverse_candidates(cand, 2, 2, 10.0, 1, 6).collect()
    assert sorted((r["grp"], r["token"]) for r in costly) == [(0, 0), (0, 1), (1, 2), (1, 3)]
    prefix = spark.createDataFrame([(0, 0, [4, 5, 4, 3, 4]), (0, 1, [4])], "sample bigint, beam bigint, tokens array<bigint>")
    left = {(r["beam"], r["token"]) for r in rk.ban_repeats(cand, prefix, 2).collect()}
    assert left == {(b, t) for b in range(2) for t in range(6)} - {(0, 5), (0, 3)}
    eos = {r["src"]: r["lprob"] for r in rk.constrain_length(cand.filter("token = 2 and beam = 0").crossJoin(spark.range(1, 6).toDF("src")), 3, F.col("src"), 1, 0, 1, 2).collect()}
    assert eos == {1: 0.0, 2: -3.0, 3: -3.0, 4: -math.inf, 5: -math.inf}
    drawn = rk.sample_candidates(cand, 2, 1, 7, topk=2).collect()
    assert len(drawn) == 2 and all(r["token"] in (2, 3) for r in drawn)
    done = spark.createDataFrame([(0, True, -1.0), (0, True, -2.0), (0, False, -30.0), (1, True, -1.0), (1, False, -0.1), (2, True, -5.0), (2, True, -1.0), (2, False, -6.0)], "sample bigint, is_final boolean, score double")
    assert {r["sample"]: r["finished"] for r in rk.finished(done, 2, 10).collect()} == {0: True, 1: False, 2: False}


def test_registry():
    assert "words" in registry.names("tokenizer")
    with pytest.raises(ValueError):
        registry.get("tokenizer", "nope")
    with pytest.raises(ValueError):
        registry.register("tokenizer", "words")(len)


def _greedy(sizes, max_tokens, max_sentences, multiple):
    """The batches of sizes in order, one sample at a time."""
    out, batch = [], []
    for i, size in enumerate(sizes):
        longest = max([size, *[sizes[j] for j in batch]])
        if batch and (len(batch) == max_sentences or max_tokens is not None and (len(batch) + 1) * longest > max_tokens):
            cut = max(multiple * (len(batch) // multiple), len(batch) % multiple)
            out.append(batch[:cut])
            batch = batch[cut:]
        batch.append(i)
    return out + [batch] if batch else out


@pytest.mark.parametrize("limits", [(60, None, 1), (60, 7, 1), (None, 5, 1), (90, 13, 4), (60, None, 8), (25, 6, 8), (3, None, 2), (10**6, 1000, 3)])
def test_batches_over_a_given_order(spark, limits):
    rng = random.Random(str(limits))
    sizes = [rng.choice([1, 2, 3, 9, 20, 55, 80]) if i % 50 < 40 else 2 for i in range(400)]
    rows = [(i, s, "x", 0) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, n int, batch string, _nth_ int").repartition(3)
    want = {i: b for b, batch in enumerate(_greedy(sizes, *limits)) for i in batch}
    for buckets in (1, 5, 60):
        got = bt.batch_in_order(df, ["i"], F.col("n"), *limits, buckets=buckets).collect()
        assert [r["rank"] for r in sorted(got, key=lambda r: r["i"])] == list(range(400))
        assert {r["i"]: r["batch_id"] for r in got} == want
    assert bt.batch_in_order(df.limit(0), ["i"], F.col("n"), *limits).count() == 0


def test_collate_fields_of_null_empty_and_equal_rows(spark):
    from seqspark.operators import batching as bt

    rows = [(0, 3, [5, 2], [1.5]), (0, 1, [5, 2], None), (0, 2, None, [2.5]), (0, 4, [], [0.5]), (1, 5, [7, 8, 2], [3.5])]
    df = spark.createDataFrame(rows, "batch_id bigint, id bigint, t array<int>, props array<double>")
    fields = {"same": bt.Field("t", left=True, pad=0), "past": bt.Field("t", shift=True), "props": bt.Field("props", pad=None)}
    got = {r["batch_id"]: r for r in bt.collate_fields(df, fields, by="t").collect()}
    assert got[0]["ids"] == [1, 3, 2, 4] and got[0]["lengths"] == [2, 2, 0, 0]
    assert got[0]["same"] == [[5, 2], [5, 2], [0, 0], [0, 0]] and got[0]["past"] == [[2, 5], [2, 5], [1, 1], [1, 1]]
    assert got[0]["props"] == [None, [1.5], [2.5], [0.5]] and got[1]["past"] == [[2, 7, 8]]
    assert bt.collate_fields(df.limit(0), fields, by="t").count() == 0


def test_sequence_texts_equal_the_scores_of_single_tokens(spark):
    rows = [(0, [5, 6, 1, 5]), (0, [6]), (1, []), (2, None), (None, [5]), (3, [1]), (4, [6, 9])]
    df = spark.createDataFrame(rows, "s int, ids array<int>")
    model = spark.createDataFrame([(5, -0.5), (6, -1.25), (1, -9.0)], "token_id int, logp double")
    single = df.select("s", F.posexplode("ids").alias("pos", "token_id")).join(model, "token_id")
    want = mt.sequence_score(single, ["s"], target="token_id").collect()
    out = mt.sequence_texts(df, ["s"], "ids", model.withColumn("shown", F.format_string("%.2f", "logp")))
    assert {(r["s"], r["score"], r["positional"]) for r in out.collect()} == {
        (r["s"], r["score"], " ".join(f"{x:.2f}" for x in r["positional"])) for r in want
    }
