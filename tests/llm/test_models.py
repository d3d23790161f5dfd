import hashlib
import random
import re
import zlib

import numpy as np
from helpers import awkward, empty, frame, words

from seqspark.llm import langid as li, pii, toxicity as tox

EN, DE = "the of and thing with over".split(), "der und schön nicht über ein".split()


def mixed(rng, n):
    return [(1000 + i, " ".join(rng.choice(EN if i % 2 else DE) for _ in range(30)), "en" if i % 2 else "de") for i in range(n)]


def test_languages_and_mixtures(spark):
    rng = random.Random(1)
    rows = mixed(rng, 60)
    df = spark.createDataFrame([*rows, (98, None, "en"), (99, "no label", None)], "doc_id bigint, text string, lang string")
    model = li.fit(df, "text", "lang")
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in li.predict(frame(spark, [(i, t) for i, t, _ in rows] + awkward()[-9:]), ["doc_id", "_text"], "text", model).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["score"] == 1.0 for i, _, lang in rows)
    assert got[30]["lang_pred"] == got[31]["lang_pred"] == got[33]["lang_pred"] == got[35]["lang_pred"] == "und" and got[33]["score"] == 0
    half = model.mixture(" ".join(rng.choice(EN) for _ in range(100)) + " " + " ".join(rng.choice(DE) for _ in range(50)))
    assert set(half) == {"de", "en"} and half["en"] > half["de"] > 0.2
    assert li.fit(df.limit(0), "text", "lang").mixture("some text") == {}
    assert li.predict(empty(spark), ["doc_id"], "text", model).count() == 0


def test_em_finds_the_best_proportions():
    rng = np.random.default_rng(3)
    chance = rng.dirichlet(np.ones(50), 2).T
    count = rng.multinomial(3000, chance @ [0.3, 0.7]).astype(float)
    share, value = li._fit(chance, count)
    grid = [count @ np.log(chance @ [p, 1 - p]) for p in np.linspace(0.01, 0.99, 99)]
    assert value >= max(grid) - 0.5 and abs(share[0] - 0.3) < 0.08


def test_long_texts_are_counted_whole():
    text = "abc défg " * 300_000
    gram, count = li.grams(text)
    assert count.sum() == 7 * 300_000
    assert (li.grams(text[:9])[0] == gram).all()


def toxic_rows(rng, n):
    rows = []
    for i in range(n):
        w = words(rng, 40).split(" ")
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["zmoronz", "xidiotic", "qscumbag"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rng = random.Random(2)
    rows = toxic_rows(rng, 500)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(1, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = tox.fit(tox.labelled_sample(docs, labels, "doc_id", "text", "toxic"), "doc_id")
    got = {r["doc_id"]: r["score"] for r in tox.scores(docs, ["doc_id"], "text", model).collect()}
    held = [(got[i], y) for i, _, y in rows if i >= 400]
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95
    clean = words(rng, 40)
    long = (clean + " ") * 5_000
    assert model.score(clean) < 0.5 and model.score(clean + " xidi0tic zmorronz ") > model.score(clean) + 0.2
    assert model.score(long) < 0.7 < model.score(long + " zmoronz qscumbag " + long)
    edge = tox.scores(frame(spark), ["doc_id"], "text", model)
    assert all(0 <= r["score"] <= 1 for r in edge.collect()) and edge.count() == len(awkward())
    none = tox.fit(tox.labelled_sample(docs, labels.limit(0), "doc_id", "text", "toxic"), "doc_id")
    assert 0 <= none.score("anything") < 0.7
    assert tox.scores(empty(spark), ["doc_id"], "text", model).count() == 0


def plain_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(7)
    parts = ["a", "Z", "9", "1", "25", "255", "256", ".", "@", "+", "-", " ", "(", ")", "%", "é", "4111111111111111", "x.y@b-c.de", "+1 (377) 555-0271", "\n", "007"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 22)))
        assert pii.base_spans(t) == plain_base(t), t
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


def test_skip_links_spread_labels(spark):
    rng = random.Random(11)
    texts = []
    for i in range(80):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        texts.append(f"{words(rng, 20)} {phone} {words(rng, 15)} a.{i}@mail.example.com {words(rng, 9)} {rng.randint(1, 99)} {words(rng, 5)} {phone[3:]} {phone}")
    model = pii.train(texts)
    text = "call +1 (377) 555-0271 now or later then maybe some day 555-0271 in 2024 or 12"
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, model)
    assert all(text[s:e] != "2024" for _, s, e in added)
    assert [(k, text[s:e]) for k, s, e in added] == [("phone", "555-0271")]
    assert pii.added_spans("only 2024 and 12 here 2024", [], model) == []
    masked = pii.mask(text, base + added)
    assert masked == "call [PHONE] now or later then maybe some day [PHONE] in 2024 or 12"
    rows = awkward() + [(700, text)]
    got = pii.detect(frame(spark, rows), ["doc_id", "text"], "text", model, masked=True).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain_base(r["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (r["masked"] is None) == (r["text"] is None) and r["n_phone"] == sum(k == "phone" for k, _, _ in base)
    assert pii.detect(empty(spark), ["doc_id"], "text", pii.fit(empty(spark), "doc_id", "text")).count() == 0


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(4)
    model = pii.SkipChain(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(3, 5, 5)))
    x = rng.integers(0, 2, (3, pii.FEATURES)).astype(float)
    edges = np.array([[0, 1, 0], [1, 2, 1]])
    got = model.marginals(x, edges, np.full(3, -1), rounds=60)
    score = x @ model.unary
    total = score[0][:, None, None] + score[1][None, :, None] + score[2][None, None, :] + model.pair[0][:, :, None] + model.pair[1][None, :, :]
    p = np.exp(total - total.max())
    p /= p.sum()
    assert np.allclose(got, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=1e-6)


def test_fold_is_crc32_mod_3(spark):
    from seqspark.llm.common import fold

    got = {r[0]: r[1] for r in spark.range(50).select("id", fold("id")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


def test_tokens_under_base_spans_equal_the_definition():
    import random

    from seqspark.llm import pii

    rng = random.Random(5)
    for _ in range(200):
        cuts = sorted(rng.sample(range(120), 2 * rng.randint(0, 20)))
        tokens = list(zip(cuts[::2], cuts[1::2]))
        base = [(rng.choice(pii.KINDS), s, s + rng.randint(1, 30)) for s in (rng.randint(0, 110) for _ in range(rng.randint(0, 6)))]
        want = [-1] * len(tokens)
        for kind, s, e in base:
            for i, (a, b) in enumerate(tokens):
                if a < e and s < b:
                    want[i] = 1 + pii.KINDS.index(kind)
        assert pii.observed(tokens, base).tolist() == want
