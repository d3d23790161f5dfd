import pytest
from pyspark.sql import functions as F

from seqspark.session import scratch_dir
from seqspark.sources import corpus, text as src


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(x + "\n" for x in lines))


def test_ordinals_do_not_depend_on_how_scans_pack_splits(spark, tmp_path):
    files = {f"f{i}.txt": [f"{i} {j} " + "x" * (j % 70) for j in range(300 * (i % 3) + 1)] for i in range(7)}
    for name, lines in files.items():
        write(tmp_path / "in", name, lines)
    want = [x for name in sorted(files) for x in files[name]]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "7k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = src.read_numbered(spark, str(tmp_path / "in"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")  # a second scan would pack otherwise
            assert [(r["line_no"], r["line"]) for r in rows.orderBy("line_no").collect()] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_splits_are_loaded_until_a_number_is_missing(spark, tmp_path):
    folder = tmp_path / "corpus"
    for n in ["", *range(1, 12), 13]:
        write(folder, f"train{n}.de-en.de", [f"{n or 0}:{i}" for i in range(3)])
    write(folder, "train.de-en.en", ["other side"])
    write(folder, "valid.de-en.de", ["v"])
    write(folder, "test1.de-en.de", ["no first part"])
    rows = src.load_split(spark, str(folder), "train", "de", "en", "de", upsample=2).orderBy("position").collect()
    want = [f"0:{i}" for i in range(3)] * 2 + [f"{n}:{i}" for n in range(1, 12) for i in range(3)]
    assert [(r["position"], r["line"]) for r in rows] == list(enumerate(want))
    alone = src.load_split(spark, str(folder), "train", "de", "en", "de", combine=False).orderBy("position").collect()
    assert [r["line"] for r in alone] == want[:3]
    assert src.load_split(spark, str(folder), "valid", "de", "en", "de").collect()[0]["line"] == "v"
    with pytest.raises(FileNotFoundError):
        src.load_split(spark, str(folder), "test", "de", "en", "de")
    assert src.find_splits(spark, str(folder)).filter(~F.col("used")).count() == 2


def test_lookup_reads_only_files_with_the_keys(spark):
    rows = [(i if i % 50 else None, [i, i + 1]) for i in range(400)] + [(7, [0])] * 30
    path = scratch_dir(spark, "clustered")
    corpus.write_clustered(spark.createDataFrame(rows, "k bigint, ids array<bigint>"), path, "k", 16)
    everything = len(corpus.read_encoded(spark, path).inputFiles())
    for keys in ([7, 7, 390, 5000, None], [5000], [None], []):
        wanted = spark.createDataFrame([(k,) for k in keys], "k bigint")
        want = sorted(r for r in rows if r[0] is not None and r[0] in keys)
        for most in (100, 1):
            found = corpus.lookup(spark, path, wanted, "k", most)
            assert sorted((r["k"], r["ids"]) for r in found.collect()) == want
        assert len(corpus.lookup(spark, path, wanted, "k").inputFiles()) <= 8 < everything or not want
