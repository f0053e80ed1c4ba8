"""The stages of the pipeline on the smallest tables, each against a plain version of what it decides."""

from collections import Counter

import pytest

import corpus_pipeline
from test_operators import SMALL, check_near, packed_ok, plain_line_dedup
from tremorgrid.llm import jaccard_join
from tremorgrid.llm.queries import vocabulary


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, SMALL).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_work(stages):
    first = stages[0][0]
    for before, after in stages[:-1]:
        assert after.columns == first.columns and after.count() > 0
    assert stages[1][1].count() == stages[1][0].count()


def test_lines(stages):
    before, after = stages[1]
    docs = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert Counter((r["doc_id"], r["text"]) for r in after.collect()) == Counter(
        (i, t) for i, t, _ in plain_line_dedup(docs))


def test_near(stages):
    before, after = stages[2]
    check_near(before)
    assert after.count() == jaccard_join.near_duplicates(before).filter("kept").count()


def test_mix_and_pack(stages):
    before, after = stages[3]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    from tokenizers import Tokenizer

    rows = stages[4][1].collect()
    packed_ok(rows, [(r["doc_id"], r["text"]) for r in stages[4][0].collect()],
              Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 4096)
