"""Registered queries: every operator on the test tables, with the same result in SQL."""

from __future__ import annotations

import importlib

from fragx.catalog.registry import ORACLES, QUERIES

FAMILIES = ["reads", "intervals", "bins", "endmotif", "methylation", "variants", "pileup", "scoring", "cna", "features", "shaping", "streams", "sources"]

for _family in FAMILIES:
    importlib.import_module(f"fragx.catalog.{_family}")


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)


def flagship(spark, sf_dir):
    return QUERIES["dense_bin_share"](spark, sf_dir)
