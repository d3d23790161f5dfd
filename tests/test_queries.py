"""A sample of the registered queries against their SQL; check.py runs all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from seqspark import plans

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "s02_line_ordinals", "s04_property_source", "s05_unlabelled_source", "s15_decode_corpus", "t14_apply_bpe", "v05_encode_lines", "s06_encoded_round_trip", "t07_clean_markup_lines", "v03_joined_vocab",
    "v08_encode_report", "e01_token_blocks", "e02_complete_blocks", "e05_block_targets", "e08_property_example", "e11_concat_corpora", "e07_masked_example", "e19_noise_pipeline", "b05_batch_multiple",
    "b10_collate", "a02_corpus_bleu", "a10_running_average", "a16_word_stats", "d02_match_source_length", "d03_diverse_beams", "a12_histogram", "d04_sampling",
    "r01_buffered_lines", "r02_running_meters",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    got = check.canonical(entry.queries()[name](spark, SF).toPandas())
    want = check.canonical(db.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_query_is_registered_with_sql():
    missing = set(plans.queries()) - set(plans.oracle_sql())
    assert not missing


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4
