"""The genome of the test inputs is derived once, however many rows lie on it."""

from __future__ import annotations

from fragx.fixtures import table

SMALL = "/root/testdata/sf0.001"


def test_genome_is_spelled_before_it_meets_other_rows(spark):
    plan = table(spark, SMALL, "loci")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "regexp_replace" not in above and "octet_length" in above
    spelled = below.split("regexp_replace", 1)[0]
    assert "Repartition 16" in spelled
