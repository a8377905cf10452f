"""What the operators must not spend: turns over short texts, words cut twice, large batches, new memory in every step."""
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

import corpus_pipeline
from courtside.llm import lm_scoring, near_dedup
from courtside.llm.common import BATCH_ROWS
from pyspark.sql import functions as F


def _one_by_one(shingle, weight, registers):
    """The registers of one text: all arrivals of each shingle, one after another, until far more than enough came."""
    first, owner = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    for s, w in zip(shingle, weight):
        t = 0.0
        for turn in range(1, 60 * registers):
            draw = near_dedup._mix(np.array([s + np.uint64(turn * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)]))
            t -= np.log(((draw[0] >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
            r = int(near_dedup._mix(draw)[0] % np.uint64(registers))
            if t < first[r]:
                first[r], owner[r] = t, s
    return owner


def test_short_texts_take_few_turns(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [1, 3, 9]
    text = np.repeat(np.arange(3), sizes)
    shingle, weight = rng.integers(1, 2**63, len(text)).astype(np.uint64), rng.integers(1, 4, len(text))
    with np.errstate(over="ignore"):
        want = [_one_by_one(shingle[text == k], weight[text == k], 24) for k in range(3)]
    assert (near_dedup.signatures(text, shingle, weight, 3, 24) == np.array(want)).all()
    calls, mix = [], near_dedup._mix
    monkeypatch.setattr(near_dedup, "_mix", lambda x: calls.append(1) or mix(x))
    near_dedup.signatures(text[:1], shingle[:1], weight[:1], 1, 2048)  # over 10,000 arrivals of one shingle
    assert len(calls) < 500


def test_words_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    other = spark.createDataFrame([(1, bytearray(b"x"))], "n long, text_key binary")
    plan = near_dedup._keyed(docs, "id").join(F.broadcast(other), "text_key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_pipeline_hands_on_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for _, stage in corpus_pipeline.STAGES[-1:]:
            stage(spark, spark.createDataFrame([], "doc_id long, text string"), "")
        rows = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["id"]) for b in batches), "id long")
        assert rows.agg(F.max("id")).first()[0] <= BATCH_ROWS
    finally:
        spark.conf.set(key, before)


def test_pipeline_reads_small_batches(spark, tmp_path):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(k) for k in keys]
    spark.range(0, 5000, 1, 1).write.parquet(f"file://{tmp_path}/rows")
    try:
        corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame([], "doc_id long, text string"), "")
        plan = spark.read.parquet(f"file://{tmp_path}/rows")._jdf.queryExecution().executedPlan()
        while plan.children().nonEmpty():
            plan = plan.children().head()
        batches = plan.executeColumnar().count()
        assert batches >= 5000 / BATCH_ROWS
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_training_takes_no_new_memory():
    """Steps of op8's training, and its scores, use the memory that the steps before had."""
    code = """
import resource
import numpy as np
from courtside.llm import lm_scoring as lm
net = lm.Attention(np.arange(lm.VOCAB) % lm.LEAVES, np.zeros(lm.VOCAB))
ids, sizes = np.random.default_rng(1).integers(2, 40_000, 200_000).astype(np.uint16), np.full(400, 500)
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for f in (lambda: net.learn(ids, sizes, 0.01, 1), lambda: net.scores(ids, sizes)):
    f()
    before = faults()
    f()
    print(faults() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"OMP_NUM_THREADS": "1"}, check=True).stdout
    assert max(map(int, out.split())) < 200, out


def test_large_weights_do_not_overflow():
    net = lm_scoring.Attention(*lm_scoring.tree(np.arange(lm_scoring.VOCAB)[::-1].astype(float), np.arange(50)))
    net.w["b1"] += 100  # beyond what exp can take in single precision
    rng = np.random.default_rng(4)
    y = rng.integers(0, lm_scoring.LEAVES, (6, lm_scoring.WIDTH)).astype(np.int16)
    x = np.concatenate([np.full((6, 1), lm_scoring.LEAVES, np.int16), y[:, :-1]], 1)
    logs, at = net.leaf_logs(x, y)
    loss, gradient = net.gradient(x, y)
    assert np.isfinite(logs).all() and np.isfinite(loss) and all(np.isfinite(g).all() for g in gradient.values()) and sorted(at) == list(range(y.size))
