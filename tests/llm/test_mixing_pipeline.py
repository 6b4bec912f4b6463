import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import mixing
from tests.llm.helpers import ODD, frame, prose

SF = "/root/testdata/sf0.001"
TARGETS = {"en": 0.5, "de": 0.25, "fr": 0.25}


def corpus(spark):
    rnd = np.random.default_rng(2)
    parts = {"en": ["the", "and", "thing", "of"], "de": ["der", "und", "schn", "zu"], "fr": ["les", "été", "que", "eau"]}
    rows = []
    for i in range(150):
        lang = ("en", "en", "en", "de", "fr")[i % 5]
        rows.append((i, " ".join(rnd.choice(parts[lang], 60)), lang, "s", 1))
    rows += [(500 + i, t, None, "s", 0) for i, t in enumerate(ODD)] + [(None, "the and of", "xx", "s", 1), (3, rows[3][1], rows[3][2], "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(i,) for i in range(0, 150, 2)] + [(None,)], "doc_id long")


def test_rates_meet_the_targets(spark):
    docs, labels = corpus(spark)
    rows = mixing.rates(docs, labels, TARGETS).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and r.copies >= 1 for r in rows)
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 150]
    langs = dict(zip(range(150), ("en", "en", "en", "de", "fr") * 30))
    assert np.mean([r.domain == langs[r.doc_id] for r in known]) > 0.98
    member = mixing.members(docs.select("doc_id", "text"), mixing.fit(docs, labels, TARGETS))
    model = mixing.fit(docs, labels, TARGETS)
    moves = mixing.solve(member, model.domains, TARGETS)
    got = member.withColumn("r", mixing.rate(moves)).agg(*(F.sum(F.col("r") * F.col("__tokens") * F.col("__p")[j]) for j in range(3))).first()
    share = np.array(got) / sum(got)
    assert np.abs(share - [TARGETS[d] for d in model.domains]).max() < 0.002


def test_spread_keeps_columns_and_every_document(spark):
    docs, labels = corpus(spark)
    more = docs.withColumns({"rate": F.lit("x"), "copies": F.lit(7), "ids": F.lit("y")})
    out = mixing.spread(more, labels, TARGETS)
    assert out.columns == more.columns and out.where("rate <> 'x' or copies <> 7 or ids <> 'y'").count() == 0
    got, copies = out.groupBy("doc_id").count().collect(), mixing.rates(docs, labels, TARGETS).groupBy("doc_id").agg(F.sum("copies").alias("c")).collect()
    assert {r.doc_id: r["count"] for r in got} == {r.doc_id: r.c for r in copies}


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark)
    assert {r.rate for r in mixing.rates(docs, labels.limit(0), TARGETS).collect()} == {1.0}
    assert {r.rate for r in mixing.rates(frame(spark, [None, ""]), labels, {"en": 1.0}).collect()} == {1.0}
    assert mixing.rates(docs.limit(0), labels, TARGETS).collect() == []


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = frame(spark, ODD, [None, *range(10**6, 10**6 + len(ODD) - 1)]).select(docs.columns)
    now = docs.unionByName(odd).unionByName(odd.where("doc_id = 1000003")).cache()
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        last = stage(spark, now, SF)
        if name != "BPE":
            assert last.columns == docs.columns, name
        now = last.cache()
        counts.append(now.count())
    good, distinct, clean, mixed, ids = counts[1:]
    assert counts[0] > good > distinct == clean <= mixed == ids
    assert now.where("n_tokens <> size(ids)").count() == 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_pipeline_runs_as_a_query(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
