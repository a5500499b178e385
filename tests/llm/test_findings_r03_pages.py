"""Minimisers of pages travel as a few packed rows, and still name every one that two streams share."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from fragx.llm import common, extract

SF = "/root/testdata/sf0.001"


def _blocks(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").repartition(3, "page_id")
    return common.stored(extract.parsed(pages))


def _held(blocks):
    """Minimisers as they are kept, with their streams, page by page without the packing."""
    held, runs = collections.defaultdict(set), extract.Runs(extract.RUN)
    for r in blocks.select("host", "kinds", "texts").collect():
        for inside in (False, True):
            data = " ".join(t for k, t in zip(r.kinds, r.texts) if (k == extract.ARTICLE) == inside).encode()
            _, leads, whole = runs(r.host, int(inside), common.token_hashes(data))
            for x in leads.view(np.uint64) >> np.uint64(extract.TAG):
                held[int(x)].add(whole)
    return held


@pytest.mark.parametrize("few", [0, 10])
def test_shared_leads_are_all_found(spark, monkeypatch, few):
    monkeypatch.setattr(extract, "FEW", few or 8)
    blocks = _blocks(spark)
    want = {x for x, streams in _held(blocks).items() if len(streams) > 1}
    assert {r.value for r in extract.shared_leads(blocks, extract.RUN).collect()} == want and want


def test_minimisers_travel_packed(spark):
    """Before, each was a row of its own."""
    blocks = _blocks(spark)
    rows = extract.lead_rows(blocks, extract.RUN, 64 - extract.TAG - 8).collect()
    number = sum(len(r.owners) // 2 for r in rows)
    assert number >= len(_held(blocks)) and len(rows) <= 3 * 2**8 < number / 4
    assert all(len(r.leads) == 2 * len(r.owners) for r in rows)
    low = np.sort(np.random.default_rng(1).integers(0, 2**30, 1000).astype(np.uint32))
    assert (extract._unpacked(extract._packed(low)) == low).all()


def test_streams_hashed_together_are_the_same():
    pages = [("h", [(extract.ARTICLE, "a b c"), (extract.OTHER, "d"), (extract.ARTICLE, "é f")]), ("i", []), ("h", [(extract.PART, "x y")])]
    for together in (0, 10**6):
        got = list(extract._streams(pages, together))
        assert [g[:2] for g in got] == pages
        assert [[len(w) for w in g[2]] for g in got] == [[1, 5], [0, 0], [2, 0]]
        assert (got[0][2][1] == common.token_hashes("a b c é f".encode())).all()
