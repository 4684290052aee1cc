"""The pipeline's stages on awkward rows, and on planted copies, passages and lines."""

import brute
import odd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabletrust.llm import decontaminate, line_crf
from tabletrust.llm.text import table

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_takes_awkward_and_empty_rows(spark, name):
    docs = odd.documents(spark)
    out = STAGES[name](spark, docs, FOLDER)
    assert out.count() <= docs.count()
    if name != "tokens":
        assert out.columns == docs.columns
    assert STAGES[name](spark, docs.where("false"), FOLDER).count() == 0


def test_run_step_by_step(spark):
    docs = table(spark, FOLDER, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = line_crf.fit(docs, table(spark, FOLDER, "labels"))
    good = [
        r.doc_id for r in line_crf.score(docs, model).where("score >= 0.5").select("doc.doc_id").collect()
    ]
    lines = {i: texts[i] for i in good}
    lines = _first_lines(lines)
    kept = {i for i, _, c in brute.components(sorted(lines.items())) if i == c}
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    found = {r[0]: r for r in brute.leaks([(i, lines[i]) for i in sorted(kept)], items)}
    left = {i for i in kept if found[i][2] <= 0.5 * found[i][1]}
    got = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in got.collect()} == left
    assert got.where(~(F.col("parity") & F.col("round_trip"))).isEmpty()


def _first_lines(texts, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    having, out, met = {}, {}, set()
    for i in sorted(texts):
        for x in texts[i].split("\n"):
            having.setdefault(key(x), set()).add(i)
    for i in sorted(texts):
        own, kept = texts[i].split("\n"), []
        for x in own:
            k = key(x)
            if not k or len(having[k]) < least or k not in met:
                kept.append(x)
            met.add(k)
        if len(kept) == len(own) or any(map(key, kept)):
            out[i] = "\n".join(kept)
    return out


def test_planted_cases(spark):
    docs = table(spark, FOLDER, "documents").limit(60)
    clean = "A calm and simple sentence that nobody else has written about the {} of the house."
    item = table(spark, FOLDER, "benchmark").first().text
    words = [f"word{k} of the day number {k * 7} is fine" for k in range(12)]
    near = ". ".join(words)
    planted = [
        (900_001, near), (900_002, near), (900_003, near + " again"),
        (900_010, " ".join(clean.format(k) for k in ("roof", "door", "garden", "cellar")) + " " + item
         + " " + " ".join(clean.format(k) for k in ("wall", "attic", "stairs", "gate"))),
        (900_020, clean.format("kitchen") + " " + clean.format("window")),
    ]
    extra = spark.createDataFrame(planted, "doc_id bigint, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("src1").alias("source"),
        F.length("text").cast("bigint").alias("n_chars"),
    )
    out = docs.unionByName(extra)
    for name in ("line_dedup", "near_duplicates", "decontamination"):
        out = STAGES[name](spark, out, FOLDER)
    left = {r.doc_id: r.text for r in out.where("doc_id > 900000").collect()}
    assert set(left) == {900_001, 900_010, 900_020}
    assert left[900_020] == planted[-1][1]
    assert item[:40] not in left[900_010]
    assert decontaminate.report(out, table(spark, FOLDER, "benchmark")).where("contaminated").isEmpty()
