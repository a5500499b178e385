"""Findings of the third round on time: what several branches of a plan read is computed once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fragx import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sbs_spectrum", "pair_adjacent", "genome_order", "merge_intervals", "mark_duplicates"])
def test_derived_tables_are_not_computed_again(spark, name):
    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "LogicalRDD" in plan


def test_template_ends_are_computed_once(spark):
    """Only the rows that get their flag are read besides the stored ends."""
    plan = catalog.queries()["mark_duplicate_templates"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ROW_NUMBER") + plan.count("row_number") <= 1


def test_allele_type_label_grows_no_copies_of_its_terms(spark):
    from fragx.functions import genotype as G

    df = spark.createDataFrame([(0, 1, ["A", "AT", "*"]), (2, 2, ["AC", "A", "T"])], "a int, b int, alleles array<string>")
    out = df.select(G.allele_type_label("a", "b", "alleles").alias("at"))
    assert out._jdf.queryExecution().analyzed().toString().count("slice(") < 4
    assert [r["at"] for r in out.orderBy(F.col("at")).collect()] == ["DD", "II"]
