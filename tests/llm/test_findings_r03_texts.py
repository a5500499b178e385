"""Texts of the quality rules stay where they are: ids are told by bitmaps, and only what these leave open is joined."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from fragx.llm import common, quality


def _documents(spark):
    ids = [*range(1, 60), *range(130, 160), 2**24 + 5, 2**24 + 6, 2**60 + 1, 2**60 + 2, None]
    texts = [" ".join(f"w{(k * j) % 50}" if k % 3 else f"v{(k + j * j) % 70}" for j in range(1, 40)) for k in range(len(ids))]
    return spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")


def _labels(spark):
    return spark.createDataFrame([*((i, i % 2, 0) for i in range(1, 40)), (2**60 + 1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


def test_ids_are_told_exactly(spark, monkeypatch):
    docs, labels = _documents(spark), _labels(spark)
    trusted = quality.labelled_ids(labels, True)
    wanted = {r.doc_id for r in trusted.collect()}
    for bits in (common.BITS, 128):
        monkeypatch.setattr(common, "BITS", bits)
        trust = quality.Trust(docs, trusted)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        told = trust(pa.array(ids, pa.int64())).tolist()
        assert all(t in ((quality.Trust.YES if i in wanted else quality.Trust.NO), quality.Trust.OPEN) for i, t in zip(ids, told))
        assert trust.all_told == (quality.Trust.OPEN not in told)


def test_no_text_is_shuffled(spark):
    """Before, texts met the labelled ids in a join, which shuffled every labelled text."""
    docs = _documents(spark).filter("doc_id < 60")
    model = quality.fit(docs, _labels(spark))
    plan = quality.keep(docs, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    assert plan.count("ArrowEvalPython") == 1  # each step has a worker of its own, so two need twice the memory


def test_open_ids_give_the_same(spark, monkeypatch):
    """With bitmaps so small that many ids stay open, counts, verdicts and rows are the same."""
    docs, labels = _documents(spark), _labels(spark)
    model, rows = quality.fit(docs, labels), sorted(map(str, quality.quality_rules(docs, labels).collect()))
    kept = sorted(map(str, quality.keep(docs, model).collect()))
    monkeypatch.setattr(common, "BITS", 128)
    assert not quality.Trust(docs, model.ids(spark)).all_told
    again = quality.fit(docs, labels)
    assert (again.raw == model.raw).all() and (again.target == model.target).all() and model.target.any()
    assert again.threshold == pytest.approx(model.threshold) and np.isfinite(model.threshold)
    assert sorted(map(str, quality.quality_rules(docs, labels).collect())) == rows
    assert sorted(map(str, quality.keep(docs, again).collect())) == kept and kept


def test_tokenizer_of_a_worker_stays_small():
    """It lives on while later stages run; before, it held 800 000 runs, more than a quarter of a gigabyte in every worker."""
    import tracemalloc

    import public_tokenizers

    from fragx.llm.packing import RunTokenizer

    tokenizer = RunTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    tracemalloc.start()
    for i in range(45):
        tokenizer(["x " + " ".join(f"{k:x}" for k in range(i * 10_000, (i + 1) * 10_000))])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 80e6
