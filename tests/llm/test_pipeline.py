import os

import duckdb
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from seqspark.llm import decontam, langid, pii, simhash
from seqspark.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    from pyspark.sql import functions as F

    # Extra rows and columns: nulls, an empty text, a copy, and names the stages use inside.
    first = docs.limit(1)
    extra = first.withColumn("doc_id", F.lit(9000).cast("bigint")).union(first.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(9001).cast("bigint")))
    extra = extra.union(first.withColumn("text", F.lit("")).withColumn("doc_id", F.lit(9002).cast("bigint")))
    docs = docs.union(extra).withColumns({"score": F.lit(1), "masked": F.lit("m"), "_c0": F.lit(2), "_gone": F.lit(3), "_found": F.lit(4), "lang_pred": F.lit("zz")})
    for name, stage in cp.STAGES:
        out.append((docs, stored(stage(spark, docs, SF), name)))
        docs = out[-1][1]
    return out


def test_stages_keep_columns_and_rows(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema["text"] == before.schema["text"]
    ids = [{r[0] for r in after.select("doc_id").collect()} for _, after in stages]
    assert not {9001, 9002} & ids[0] and 9000 not in ids[1] and ids[2] <= ids[1] and ids[3] == ids[2] == ids[4]


def test_stages_equal_plain_python(spark, stages):
    rows = [r.asDict() for r in stages[0][0].collect()]
    model = langid.fit(langid.learnable(stages[0][0]), "text", "lang")
    found = {r["doc_id"]: model.mixture(r["text"] or "") for r in rows}
    assert {r[0] for r in stages[0][1].select("doc_id").collect()} == {i for i, m in found.items() if m and max(m.values()) >= 0.5}
    text = {r["doc_id"]: r["text"] for r in stages[1][0].collect()}
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in text.items()}
    group = {i: i for i in text}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in text:
        for b in text:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    assert {r[0] for r in stages[1][1].select("doc_id").collect()} == {i for i in text if find(i) == i}
    db = duckdb.connect()
    db.register("documents", stages[2][0].select("doc_id", "text").toArrow())
    db.register("benchmark", pq.read_table(f"{SF}/benchmark.parquet"))
    hit = {r[0] for r in db.execute(decontam.SQL).fetchall()}
    assert {r[0] for r in stages[2][1].select("doc_id").collect()} == set(text) & {r[0] for r in stages[2][0].select("doc_id").collect()} - hit
    field = pii.fit(stages[3][0], "doc_id", "text")
    after = {r["doc_id"]: r for r in stages[3][1].collect()}
    for r in stages[3][0].collect():
        base = pii.base_spans(r["text"])
        assert after[r["doc_id"]]["text"] == pii.mask(r["text"], base + pii.added_spans(r["text"], base, field))
        assert not pii.base_spans(after[r["doc_id"]]["text"])


def test_run_and_empty_table(spark):
    assert set(cp.run(spark, SF).columns) >= {"doc_id", "sequence_id", "offset"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
