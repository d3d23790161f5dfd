import random

from pyspark.sql import functions as F

from seqspark.consts import GENERAL_MOLECULE_TOKENS, MOLECULE_SPECIALS, SHORT_MOLECULE_TOKENS
from seqspark.functions import arrays as ar, text as tx
from seqspark.operators import bpe, vocab as vb
from seqspark.session import scratch_dir
from seqspark.sources import corpus, molecules, text as src

CORPUS = ["A B C D", "B C D", "C D", "D"]


def lines(spark, rows=CORPUS):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")


def ids(df, col="ids"):
    return [list(r[col]) for r in df.orderBy("doc_id").collect()]


def test_growing_and_final_vocabulary(spark):
    docs = lines(spark).withColumn("words", tx.words(F.col("text")))
    key = vb.first_key((F.col("doc_id"), 0), (F.lit(0), 31))
    tok = docs.select(key.alias("k"), F.posexplode("words").alias("pos", "token"))
    grown = vb.first_seen_vocab(tok.select("token", (F.col("k") + F.col("pos")).cast("decimal(38,0)").alias("first")))
    eos = ar.append_eos(F.col("ids"))
    assert ids(vb.encode(docs, "words", grown).withColumn("ids", eos)) == [[4, 5, 6, 7, 2], [5, 6, 7, 2], [6, 7, 2], [7, 2]]
    final = vb.finalize(vb.count_text(docs, "doc_id", "text"))
    expected = [[7, 6, 5, 4, 2], [6, 5, 4, 2], [5, 4, 2], [4, 2]]
    assert ids(vb.encode(docs, "words", final).withColumn("ids", eos)) == expected
    path = scratch_dir(spark, "vocab")
    corpus.save_vocab(final, path)
    again = corpus.load_vocab(spark, path)
    assert ids(vb.encode(docs, "words", again).withColumn("ids", eos)) == expected
    by_join = vb.encode(docs, "words", final, key=["doc_id"], limit=2)
    assert ids(by_join.withColumn("ids", eos)) == expected
    decoded = vb.decode_rows(vb.encode(docs, "words", final), "ids", final)
    assert [r["text"] for r in decoded.orderBy("doc_id").collect()] == CORPUS


def test_finalize_limits_threshold_padding_and_ties(spark):
    counts = vb.count_text(lines(spark, ["b a c", "a b <unk>", "d"]), "doc_id", "text")
    rows = {r["token"]: (r["token_id"], r["cnt"]) for r in vb.finalize(counts, padding_factor=8).collect()}
    assert rows["b"] == (4, 2) and rows["a"] == (5, 2) and rows["c"] == (6, 1) and rows["d"] == (7, 1)
    assert rows["<unk>"] == (3, 1) and rows["</s>"] == (2, 3) and len(rows) == 8
    kept = {r["token"] for r in vb.finalize(counts, threshold=2, nwords=5, padding_factor=4).collect()}
    assert kept == {"<Lua heritage>", "<pad>", "</s>", "<unk>", "b", "madeupword0000", "madeupword0001", "madeupword0002"}
    assert vb.finalize(counts, nwords=100).count() == 8
    assert vb.finalize(counts.filter("false"), nwords=100).count() == 8


def test_report_counts_literal_unknown_as_known(spark):
    docs = lines(spark, ["a <unk> z", "a"]).withColumn("words", tx.words(F.col("text")))
    vocab = spark.createDataFrame([(3, "<unk>"), (4, "a")], "token_id bigint, token string")
    r = vb.encode_report(vb.encode(docs, "words", vocab), []).collect()[0]
    assert (r["nseq"], r["ntok"], r["nunk"]) == (2, 6, 1)


def test_molecule_tokenizers_and_vocabularies(spark):
    smiles = ["CCO", "c1ccccc1", "ClCCBr", "C[C@H](N)C(=O)O", "[Na+].[Cl-]", "C%12", "xyz", "CC10"]
    df = lines(spark, smiles)
    short = {r["text"]: r["t"] for r in df.select("text", tx.short_molecule(F.col("text")).alias("t")).collect()}
    assert short["ClCCBr"] == ["Cl", "C", "C", "Br"] and short["CC10"] == ["C", "C", "10"]
    general = df.withColumn("t", tx.general_molecule(F.col("text")))
    found = {r["text"]: (r["t"], r["ok"]) for r in general.withColumn("ok", tx.is_lossless(F.col("text"), F.col("t"))).collect()}
    assert found["C[C@H](N)C(=O)O"][0] == ["C", "[C@H]", "(", "N", ")", "C", "(", "=", "O", ")", "O"]
    assert found["[Na+].[Cl-]"] == (["[Na+]", ".", "[Cl-]"], True)
    assert found["C%12"][0] == ["C", "%12"] and not found["xyz"][1]
    assert len(MOLECULE_SPECIALS + SHORT_MOLECULE_TOKENS) == 46
    assert len(MOLECULE_SPECIALS + GENERAL_MOLECULE_TOKENS) == 193


def test_property_lines(spark):
    raw = ["CCO,1.5,NaN", "", "C,2", "N,NaN,0.25", "O,x,1"]
    parsed = molecules.parse_properties(spark.createDataFrame([(s,) for s in raw], "line string"), 2)
    good = {r["smiles"]: (r["props"], r["present"]) for r in molecules.good_rows(parsed).collect()}
    assert good == {"CCO": ([1.5, 0.0], [True, False]), "N": ([0.0, 0.25], [False, True])}
    assert {r["smiles"] for r in molecules.quarantine(parsed).collect()} == {"C", "O"}


def test_numbered_lines_follow_file_order(spark):
    path = scratch_dir(spark, "text")
    rows = spark.range(0, 5000, 1, 7).select(F.col("id"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    src.write_lines(rows, path, F.col("line"), ["id"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        got = [(r["line_no"], r["line"]) for r in src.read_numbered(spark, path).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, f"line {i}") for i in range(5000)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("he@@ llo w’ \x1cx y ",)], "t string")
    r = df.select(tx.remove_bpe(F.lit("he@@ llo n@@ ew")).alias("b"), tx.words(F.col("t")).alias("w"), tx.byte_ids(F.lit("é"), 4).alias("i")).collect()[0]
    assert r["b"] == "hello new" and r["w"] == ["he@@", "llo", "w’", "x", "y"] and r["i"] == [0xC3 + 1, 0xA9 + 1, 0, 0]


def sequential_bpe(words, merges):
    state = {tuple(w[:-1]) + (w[-1] + "</w>",): c for w, c in words.items()}
    out = []
    for _ in range(merges):
        pairs = {}
        for s, c in state.items():
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + c
        pairs = {p: c for p, c in pairs.items() if c >= 2}
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        out.append((*best, pairs[best]))
        merged = {}
        for s, c in state.items():
            t, i = [], 0
            while i < len(s):
                if s[i : i + 2] == best:
                    t.append(best[0] + best[1])
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            merged[tuple(t)] = merged.get(tuple(t), 0) + c
        state = merged
    return out


def test_bpe_equals_sequential_learning(spark):
    words = {"low": 5, "lower": 2, "newest": 6, "widest": 3, "aaaa": 4, "aaa.b": 2, "$x$x": 3, "\\\\n": 2, "été": 2}
    df = spark.createDataFrame(list(words.items()), "token string, cnt bigint")
    for top in (256, 3):
        learned = bpe.learn(df, 25, top=top, checkpoint_every=3)
        got = [(r["left"], r["right"], r["cnt"]) for r in learned.orderBy("rank").collect()]
        assert got == sequential_bpe(words, 25)
    docs = spark.createDataFrame([(0, ["lowest", "newer", "a", ""]), (1, [])], "doc_id bigint, words array<string>")
    docs = docs.withColumn("words", F.filter("words", lambda w: w != ""))
    pieces = [r["pieces"] for r in bpe.apply(docs, "words", bpe.learn(df, 10)).orderBy("doc_id").collect()]
    assert " ".join(pieces[0]).replace("@@ ", "") == "lowest newer a" and pieces[1] == []
    ranks = {(a, b): i for i, (a, b, _) in enumerate(sequential_bpe(words, 10))}
    assert pieces[0] == [p for w in ["lowest", "newer", "a"] for p in bpe.segment(w, ranks)]


def test_bpe_of_random_words_with_rewritten_lists(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("abc", weights=[5, 3, 1], k=rng.randint(1, 9))): rng.randint(1, 30) for _ in range(120)}
    df = spark.createDataFrame([*words.items(), ("", 9), (None, 9)], "token string, cnt bigint")
    want = sequential_bpe(words, 40)
    got = bpe.learn(df, 40, top=40, checkpoint_every=4).orderBy("rank")
    assert [(r["left"], r["right"], r["cnt"]) for r in got.collect()] == want
    assert bpe.learn(df.limit(0), 5).count() == 0


def test_replace_unknown_and_alignment(spark):
    links = spark.createDataFrame([("x", "A", 0), ("x", "B", 1), ("x", "B", 2), ("y", "C", 3), ("y", "D", 4)], "src string, tgt string, first bigint")
    align = vb.alignment_dict(links)
    assert {r["src"]: r["tgt"] for r in align.collect()} == {"x": "B", "y": "C"}
    hyp = spark.createDataFrame([(0, 0, "<unk>", 0), (0, 1, "k", 0), (0, 2, "<unk>", 1), (0, 3, "<unk>", 2)], "id bigint, pos int, token string, src_pos bigint")
    source = spark.createDataFrame([(0, ["x", "z"])], "id bigint, words array<string>")
    assert vb.replace_unk(hyp, source, align).collect()[0]["text"] == "B k z <eos>"


def test_part_files_beyond_99999_are_in_number_order(spark):
    from seqspark.sources.text import _file_order

    names = [f"file:/x/part-{n:05d}-a.txt" for n in (0, 9, 99998, 99999, 100000, 1000000)]
    assert sorted(names, key=_file_order) == names
    assert sorted(["f:/b.txt", "f:/a.txt"], key=_file_order) == ["f:/a.txt", "f:/b.txt"]


def test_lookups_without_key_beyond_the_limit(spark):
    df = spark.createDataFrame([(["a", "b", "zz"],), ([],), (["b"],)], "words array<string>")
    vocab = spark.createDataFrame([(4, "a"), (5, "b"), (6, "x" * 2000)], "token_id bigint, token string")
    for limit in (1, 10):  # too many rows, and a token too long to ship
        ids = vb.encode(df, "words", vocab, limit=limit)
        assert sorted(r["ids"] for r in ids.collect()) == [[], [4, 5, 3], [5]]
        assert sorted(r["text"] for r in vb.decode_rows(ids, "ids", vocab, limit=limit).collect()) == ["", "a b <unk>", "b"]


def test_vectors_skip_the_header_and_keep_the_last(spark):
    from seqspark.sources.corpus import read_vectors

    path = scratch_dir(spark, "vectors")
    spark.createDataFrame([("3 1",), ("a 1.5",), ("b 2.5",), ("a 3.5",)], "v string").coalesce(1).write.text(path)
    assert {r["token"]: r["vector"] for r in read_vectors(spark, path).collect()} == {"a": [3.5], "b": [2.5]}


def test_property_files_have_a_header_by_default(spark):
    from seqspark.sources import molecules as mol

    path = scratch_dir(spark, "molecules")
    spark.createDataFrame([("smiles,p",), ("CCO,1",), ("",), ("C,NaN",), ("bad",)], "v string").coalesce(1).write.text(path)
    got = mol.read_properties(spark, path, 1).orderBy("line_no").collect()
    assert [(r["smiles"], r["ok"]) for r in got] == [("CCO", True), ("C", True), ("bad", False)]
    assert mol.read_unlabelled(spark, path).count() == 3 and mol.read_unlabelled(spark, path, header=False).count() == 4


def test_alignment_dictionary_of_known_words(spark):
    links = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4)], "src string, tgt string, first bigint")
    source = spark.createDataFrame([(3, "<unk>"), (4, "a")], "token_id bigint, token string")
    target = spark.createDataFrame([(4, "y")], "token_id bigint, token string")
    assert [tuple(r) for r in vb.alignment_dict(links, source, target).collect()] == [("a", "y")]
    assert {tuple(r) for r in vb.alignment_dict(links).collect()} == {("a", "x"), ("b", "x")}


def test_blank_lines_are_encoded_as_empty(spark):
    df = spark.createDataFrame([(0, "a b"), (1, ""), (2, "  ")], "i bigint, line string").withColumn("words", tx.words(F.col("line")))
    vocab = spark.createDataFrame([(4, "a"), (5, "b")], "token_id bigint, token string")
    ids = vb.encode(df, "words", vocab)
    assert {r["i"]: r["ids"] for r in ids.collect()} == {0: [4, 5], 1: [], 2: []}
    assert {r["i"]: r["text"] for r in vb.decode_rows(ids, "ids", vocab).collect()} == {0: "a b", 1: "", 2: ""}


def test_batched_noise_equals_the_steps(spark):
    import random

    from seqspark.functions.hashing import base, fold
    from seqspark.operators import noise as nz

    rng = random.Random(3)
    rows = [(i, [rng.choice(["a@@", "b", "c@@", "d", "e"]) for _ in range(rng.randint(0, 9))] + ["</s>"] * rng.randint(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows + [(999, None)], "i bigint, pieces array<string>").withColumn("acc", base(7, F.col("i")))
    got = {r["i"]: r["pieces"] for r in df.transform(nz.noise("pieces", "acc", 3, 0.4, 0.4)).collect()}
    p = nz.word_shuffle(F.col("pieces"), 3, fold(F.col("acc"), 101))
    steps = df.withColumn("pieces", p)
    steps = steps.withColumn("pieces", nz.word_dropout(F.col("pieces"), 0.4, fold(F.col("acc"), 102)))
    steps = steps.withColumn("pieces", nz.word_dropout(F.col("pieces"), 0.4, fold(F.col("acc"), 103), nz.UNKNOWN))
    assert got == {r["i"]: r["pieces"] for r in steps.collect()}


def test_bpe_by_joins_equals_shipped_merges(spark):
    rng = random.Random(12)
    rows = [(i, ["".join(rng.choice("aabé</w>\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 6))], "x") for i in range(60)]
    rows += [(60, None, "y"), (61, [], "z"), (7, ["aaaaaaa", "abab", "a"], "x"), (7, ["aaaaaaa", "abab", "a"], "x")]
    df = spark.createDataFrame(rows, "i int, words array<string>, word string").repartition(3)
    pairs = [("a", "a"), ("a", "b"), ("aa", "a"), ("b", "a</w>"), ("ab", "ab"), ("é", "a"), ("aa", "aa"), ("a", "a</w>"), ("<", "/")]
    merges = spark.createDataFrame([(n, a, b, 1) for n, (a, b) in enumerate(pairs)], "rank bigint, left string, right string, cnt bigint")
    want = sorted(map(str, bpe.apply(df, "words", merges).select("i", "words", "word", "pieces").collect()))
    got = bpe.apply(df, "words", merges, limit=1)
    assert sorted(got.columns) == sorted(["i", "words", "word", "pieces"])
    assert sorted(map(str, got.select("i", "words", "word", "pieces").collect())) == want


def test_values_beyond_the_limit_join_only_what_was_not_shipped(spark):
    rows = [(1, ["a", "b", "zz", None]), (1, ["a"]), (None, ["c", "c", "b"]), (2, []), (3, None), (4, ["d", "a"])]
    df = spark.createDataFrame(rows, "i int, words array<string>").repartition(3)
    table = spark.createDataFrame([("a", 0.5, 9), ("b", 1.5, 3), ("c", float("-inf"), 2), ("d", 2.5, 1)], "token string, v double, n bigint")
    want = sorted(map(str, vb.attach_values(df, "words", table, "v", "x").select("i", "words", "x").collect()))
    for limit in (1, 2, 3):
        got = vb.attach_values(df, "words", table, "v", "x", limit=limit, often="n")
        assert sorted(map(str, got.select("i", "words", "x").collect())) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "missing" in plan and "posexplode" not in plan  # rows of shipped tokens are not exploded
    some = table.filter("n > 1")
    for limit in (1, 2, 9):
        got = vb.attach_values(df.filter("i <> 1 or size(words) = 1"), "words", some, "v", "x", limit=limit, often="n", default=-1.0)
        assert sorted(str(r["x"]) for r in got.collect()) == sorted(["[0.5]", "[]", "[]", "[-1.0, 0.5]"])


def test_words_are_counted_in_the_task_before_they_are_aggregated(spark):
    texts = [(5, "b a\nb \x1c　a\x85c"), (2, "a a </s>\n"), (2, "c a"), (None, "d a"), (7, None), (9, "")]
    docs = spark.createDataFrame(texts, "id bigint, text string").coalesce(1)
    counts = vb.count_text(docs, "id", "text")
    got = {r["token"]: (r["cnt"], None if r["first"] is None else int(r["first"])) for r in counts.collect()}
    at = lambda i, pos: i * 2**31 + pos
    assert got == {"a": (6, at(2, 0)), "b": (2, at(5, 0)), "c": (2, at(2, 0)), "d": (1, None), "</s>": (8, at(2, 2))}
    assert "posexplode" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_encoded_like_their_words(spark):
    rows = [(0, "a b\n zz"), (1, ""), (2, None), (3, "b\x1da </s>"), (0, "a\n\n")]
    df = spark.createDataFrame(rows, "i bigint, text string")
    vocab = spark.createDataFrame([(2, "</s>"), (4, "a"), (5, "b")], "token_id bigint, token string")
    want = sorted(map(str, vb.encode(df.withColumn("words", tx.words(F.col("text"))), "words", vocab).select("i", "text", "ids").collect()))
    for limit in (1, 10):
        assert sorted(map(str, vb.encode_text(df, "text", vocab, limit=limit).select("i", "text", "ids").collect())) == want
    whole, joined = (sorted(map(str, vb.encode_lines(df, "text", vocab, limit=n).select("i", "ids", "line", "off", "size").collect())) for n in (10, 1))
    assert whole == joined
    first = vb.encode_lines(df.filter("text like 'a b%'"), "text", vocab).first()
    assert (first["ids"], first["line"], first["off"], first["size"]) == ([4, 5, 2, 3, 2], [0, 0, 0, 1, 1], [0, 1, 2, 0, 1], 5)


def test_ids_are_gathered_before_they_are_named(spark):
    long = spark.createDataFrame([(1, 1, 5), (1, 0, 4), (1, 2, 2), (1, 3, 99), (2, 0, 2), (3, 0, 3)], "k int, pos int, token_id bigint")
    vocab = spark.createDataFrame([(2, "</s>"), (3, "<unk>"), (4, "a@@"), (5, "b")], "token_id bigint, token string")
    for limit in (1, 10):
        got = vb.decode(long, vocab, ["k"], escape_unk=True, bpe=True, limit=limit)
        assert {r["k"]: r["text"] for r in got.collect()} == {1: "ab <<unk>>", 3: "<<unk>>"}
    plan = vb.decode(long, vocab, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_words_are_parted_in_arrow_like_str_split():
    import pyarrow as pa

    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [None, "", " ", "a", " a\tb ", "x\x85y　", "".join(f"w{s}" for s in spaces), "a​b ﻿c"]
    tokens, sizes = vb._words(pa.array([*texts, "before"]).slice(0, len(texts)))
    assert sizes.tolist() == [len((t or "").split()) for t in texts]
    assert tokens.to_pylist() == [w for t in texts for w in (t or "").split()]
    assert vb._spaced(pa.array([[1, None, 20], None, [], [3]])).to_pylist() == ["1 20", None, "", "3"]


def test_a_frequent_source_word_gathers_no_rows(spark):
    align = spark.createDataFrame([("<eos>", "E"), ("x", "X"), ("y", None), ("zz", "Z")], "src string, tgt string")
    tokens = ["<unk>", "k", "<unk>", "<unk>", "<unk>"]
    rows = [(i, p, t, at) for i in (0, 1, 2, None) for p, (t, at) in enumerate(zip(tokens, [0, 0, 1, 3, None]))]
    hyp = spark.createDataFrame(rows, "id bigint, pos int, token string, src_pos bigint")
    source = spark.createDataFrame([(0, ["x", "y", "z"]), (1, ["zz", "w", "x"]), (1, ["x", "zz", "y"]), (3, ["x"])], "id bigint, words array<string>")
    for limit in (1, 100):  # of the table, only the most frequent word is shipped, or all
        out = vb.replace_unk(hyp, source, align, limit=limit)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_salt" not in plan
        assert {r["id"]: r["text"] for r in out.collect()} == {0: "X k y E", 1: "X Z k k Z w E E"}
