import duckdb
import pyarrow as pa

from seqspark.llm import chat, htmltext as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">home</a></li><li><a href="/b">news</a></li></ul></nav><div class="ad">Buy now.</div>
<article><h1>Head {n} &amp; more</h1><p>First <b>bold</b> text, with commas, and stops. It goes on for a while. <br>Then more text.
<p>Second paragraph &lt;here&gt; of number {n}, which says something. And so on.</p>{extra}</article><footer>Copyright 2020 by us</footer></body></html>"""
WANT = "Head {n} & more First bold text, with commas, and stops. It goes on for a while. Then more text. Second paragraph <here> of number {n}, which says something. And so on."
OTHER = """<html><body><div id="sidebar"><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div><div class="cookie-notice">We use cookies. Accept?</div>
<div id="content"><p>A long enough paragraph, with several commas, and some stops. It is the text. Readers like it.</p>
<p>Another one follows, not shorter, with words. It ends here.</p></div><div class="comments"><p>First! Great post, thanks, really.</p></div>
<form><label>Name</label><input><button>Send</button></form></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in rows], "page_id bigint, url string, html string, text string").repartition(3)


def test_main_text_of_known_and_unnamed_pages(spark):
    rows = [(i, PAGE.replace("{n}", str(i)).replace("{extra}", "<aside>related links</aside>" if i % 2 else "")) for i in range(40)]
    df = pages(spark, rows)
    model = ht.fit(df, "page_id", "html")
    odd = [(50, None), (51, ""), (52, "just text"), (53, "<p>unclosed <b>and <i>nested"), (54, "<" * 50), (55, "<div " * 3000), (56, OTHER), (57, "<script>x"), (None, PAGE), (0, rows[0][1])]
    got = {}
    for r in ht.extract(df.union(pages(spark, odd)), ["page_id", "url"], "html", model).collect():
        got.setdefault(r["page_id"], r)
        assert r["n_chars"] == len(r["text"])
    for i in range(40):
        assert got[i]["text"] == WANT.replace("{n}", str(i))
    assert got[50]["text"] == got[51]["text"] == got[57]["text"] == ""
    text = got[56]["text"]
    assert text.startswith("A long enough") and text.endswith("It ends here.")
    assert ht.extract(df.limit(0), ["page_id"], "html", ht.fit(df.limit(0), "page_id", "html")).count() == 0


def test_decoding_keeps_nothing_below_a_dropped_node():
    import numpy as np

    page = ht.parse("<div><p>kept text</p><div class=ad><p>inner words here</p></div></div>")
    _, own = ht.features(page)
    logit = np.array([1.0, 1.0, 2.0, -4.0, 1.0])[: len(own)]
    chosen = ht.decode(page, logit, own)
    for i in range(1, len(own)):
        assert not chosen[i] or chosen[page.parent[i]]
    best = max(
        (sum((v if c else -v) for v, c in zip(np.clip(logit, -6, 6)[1:] * (0.1 + np.sqrt(own[1:])), pick)), pick)
        for pick in np.ndindex(*[2] * (len(own) - 1))
        if all(not c or page.parent[i] == 0 or pick[page.parent[i] - 1] for i, c in enumerate(pick, 1))
    )
    assert list(best[1]) == chosen[1:].astype(int).tolist()


def test_boosting_learns_an_interaction():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = ht.boost(x, y)
    assert np.mean((trees.logit(x) > 0) == y) > 0.97
    assert len(set(ht.boost(x, np.ones(2000)).logit(x))) == 1


def talk():
    first = "Shall we meet on Monday?\nI can bring the maps."
    return [
        (1, 0, "user", first),
        (1, 1, "assistant", "Tuesday is better for me."),
        (1, 2, "user", "On Mon, A wrote:\n> Shall we meet on Monday?\n> I can bring the maps.\nYes, please do."),
        (1, 3, "user", "> tuesday is better, for me\nFine."),
        (1, 4, "assistant", ">> Shall we meet on Monday?\n> Yes, please do.\nGood then."),
        (1, 5, None, "> never said by anyone\nWhat?"),
        (1, 6, "user", "> Fine.\nok\n> What?\nno"),
        (1, 6, "user", "> Fine.\nok\n> What?\nno"),
        (2, 0, "system", "Shall we meet on Monday?"),
        (2, 1, "user", ">"),
        (2, 2, "user", None), (2, 3, "user", ""), (None, 0, "user", "> Fine."), (3, None, "user", "> Fine."), (4, 0, "user", "> own\nown"),
    ]


def test_quotations_link_replies(spark):
    df = spark.createDataFrame([(*r, 1) for r in talk()], "conv_id bigint, turn bigint, role string, text string, thread int").repartition(4)
    got = chat.conversations(df).collect()
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert [one[t]["reply_to"] for t in range(7)] == [None, None, 0, 1, 2, None, 5]
    assert [one[t]["thread"] for t in range(7)] == [0, 1, 0, 1, 0, 5, 5]
    assert one[2]["content"] == "Yes, please do." and one[4]["content"] == "Good then." and one[6]["content"] == "ok\nno"
    assert one[4]["quotes"] == 2 and one[4]["linked"] == 2 and one[5]["linked"] == 0
    assert one[5]["chat"] == "<|user|>\nWhat?"
    assert len(got) == len(talk())
    db = duckdb.connect()
    db.register("conversations", pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*talk()))))))
    want = db.execute(chat.SQL).fetchall()
    names = [c[0] for c in db.description]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[n] for n in names) for r in got), key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
    assert chat.conversations(df.limit(0)).count() == 0


def test_long_chains_of_answers(spark):
    rows = [(1, 0, "user", "message 0")] + [(1, i, "user", f"> message {i - 1}\nmessage {i}") for i in range(1, 40)]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert {r["thread"] for r in got.collect()} == {0}
