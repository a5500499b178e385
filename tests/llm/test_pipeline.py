"""The pipeline stage by stage against plain Python on a small table, and on odd input."""

from __future__ import annotations

import collections

import corpus_pipeline
import numpy as np
import pytest
from tests.llm.test_llm import CLASHES, LONG, brute_classes, brute_passages, check_packing

from fragx.llm import quality, repeats, secrets

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id: r.asDict() for r in docs.collect()}

    model = quality.fit(docs, labels)
    judge = quality.Judge(model)
    want = {i: r for i, r in want.items() if judge(r["text"] or "", bool(model.trusts([i])[0]))[-2]}
    now = stage("quality")(spark, docs, SF)
    assert {r.doc_id: r.asDict() for r in now.collect()} == want

    classes = brute_classes({i: r["text"] for i, r in want.items()})
    want = {i: r for i, r in want.items() if classes[i] == i}
    now = stage("near_duplicates")(spark, now, SF)
    assert {r.doc_id: r.asDict() for r in now.collect()} == want

    passages = brute_passages({i: r["text"] for i, r in want.items()})
    for i, (_, later) in passages.items():
        text = repeats.without(want[i]["text"], [{"start": a, "end": b} for a, b in later])
        if later:
            want[i] |= {"text": text, "n_chars": len(text)}
    now = stage("passages")(spark, now, SF)
    assert {r.doc_id: r.asDict() for r in now.collect()} == want

    counts = collections.Counter(w for r in want.values() for w in r["text"].split() if 3 <= len(w) <= 40)
    least = min(m for m in set(counts.values()) if m > 1 and sum(n >= m for n in counts.values()) <= secrets.DICTIONARY_WORDS)
    top = sorted((-n, w) for w, n in counts.items() if n >= least)
    dictionary = "\n".join(w for _, w in reversed(top)).encode()[-secrets.DICTIONARY_BYTES :]
    assert dictionary == secrets.identifier_dictionary(now)
    novelty = secrets.Novelty(dictionary)
    for r in want.values():
        text = secrets.mask(r["text"], novelty)
        if text != r["text"]:
            r |= {"text": text, "n_chars": len(text)}
    now = stage("secrets")(spark, now, SF)
    assert {r.doc_id: r.asDict() for r in now.collect()} == want

    rows = stage("packing")(spark, now, SF).collect()
    ids, _ = check_packing(rows, {i: r["text"] for i, r in want.items()})
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    end = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, end)) == sorted(map(key, rows))


@pytest.fixture
def odd(spark):
    rows = [(None, LONG, "x"), (1, None, None), (2, "", None), (3, "short", None), (4, LONG, None), (4, LONG, None), (5, LONG, None), (6, LONG + " and a last few words", None)]
    rows += [(7, " ".join(np.random.default_rng(1).choice(["tree", "house", "river", "stone", "cloud", "field", "bread"], 60)) + ' password = "hunter2hunter2"', None)]
    return spark.createDataFrame([(*r, None, None, *[None] * 14) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}, _gone_id long, _later_found int")


def test_every_stage_takes_odd_input(spark, odd):
    for name, fn in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = fn(spark, docs, SF)
            rows = out.collect()
            if name != "packing":
                assert out.columns == odd.columns and out.dtypes == odd.dtypes
            if name == "near_duplicates" and rows:
                assert collections.Counter(r.doc_id for r in rows) == {None: 1, 1: 1, 2: 1, 3: 1, 4: 2, 7: 1}
            if name == "passages" and rows:
                got = {r.doc_id: r.text for r in rows}
                assert got[None] == got[4] == LONG and got[5] == "" and got[6] == " and a last few words" and got[1] is None
            if name == "secrets" and rows:
                assert '"<assign>"' in {r.doc_id: r.text for r in rows}[7]
