"""Every query of the subpackage over whole tables: against its SQL, or against other libraries."""

import compare
import pytest
from pyspark.sql import functions as F

from tabletrust.llm import QUERIES, SQL
from tabletrust.llm.text import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


def test_pieces_agree_with_sentencepiece(spark):
    rows = QUERIES["op5_pieces"](spark, FOLDER).collect()
    assert len(rows) == table(spark, FOLDER, "documents").count()
    assert all(r.parity and r.round_trip for r in rows)


def test_counts_agree_with_the_unigram_tokenizer(spark):
    from tabletrust.llm import pieces

    with open(pieces.MODEL_FILE, "rb") as f:
        model = pieces.parse_model(f.read())
    model.kind = pieces.UNIGRAM
    made = pieces.build(model)
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    for r in QUERIES["op7_token_counts"](spark, FOLDER).collect():
        assert r.n_tokens == len(made.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_quality_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    scores = QUERIES["op10_quality"](spark, folder)
    known = scores.join(table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in known)
    assert len(known) > 100 and right / len(known) >= 0.97
    assert scores.where("score < 0 or score > 1 or score is null").isEmpty()


def test_url_verdicts_are_whole(spark):
    pages = table(spark, FOLDER, "pages")
    out = QUERIES["op3_url_trust"](spark, FOLDER)
    assert out.count() == pages.count()
    assert out.where(~F.col("verdict").isin("allow", "block")).isEmpty()
