"""What Python workers hold between stages."""

import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import decontaminate, packing, tokens
from vellum.llm.entry import word_vocabulary


def test_rows_of_the_driver_need_no_python_worker(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"))
    items = spark.range(2).select(F.col("id").alias("item_id"), F.lit("words of a text that is long enough").alias("text"))
    for found in (packing.pack(docs, word_vocabulary()), decontaminate.occurrences(docs, items), decontaminate.occurrences(docs, items.limit(0))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "ExternalRDD" not in plan
    assert found.isEmpty() and found.schema == decontaminate.occurrences(docs, items).schema


def test_passages_are_cut_without_pandas(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 60))) for i in (0, 3)] + [(7, None)], "doc_id long, text string")
    found = corpus_pipeline.repeated_passages(spark, docs, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # 250: a function of Arrow arrays; 200: of pandas series.
    assert re.findall(r"ArrowEvalPython .*, (\d+)\n", plan) == ["250"]
    assert {r.doc_id: r.text for r in found.collect()} == {0: "w0 w1 w2 ", 3: "w60 w61 w62", 7: None}


def test_idle_worker_lets_its_encoder_go(monkeypatch):
    monkeypatch.setattr(tokens, "IDLE_SECONDS", 0.2)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["Some words", None])], ["doc_id", "text"])
    encode = lambda: [x for _, ids in tokens.encoded_batches([batch], word_vocabulary()) for x in ids]
    first, held = encode(), dict(tokens._ENCODERS)
    assert held and encode() == first and tokens._ENCODERS == held
    time.sleep(1)
    assert not tokens._ENCODERS and encode() == first
