"""Composite disequilibrium reads the genotypes as words, not row by row."""

from strandlake.operators import outgroups


def test_alleles_are_told_from_distinct_genotypes(spark):
    rows = [("g", m, i, a, b) for i in range(90) for m, a, b in ((1, "AC"[i % 2], "C"), (2, "GT"[i % 2], "T"), (3, "A", None))]
    found = outgroups.composite_ld(spark.createDataFrame(rows, "grp string, marker int, individual long, a string, b string"), ("grp",))
    plan = [x.strip(" +-:") for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    at = [k for k, x in enumerate(plan) if x.startswith("Generate explode")]
    assert at and all(plan[k + 1].startswith("Aggregate") for k in at)
    (row,) = found.collect()
    assert (row.marker1, row.marker2, row.n) == (1, 2, 90)
    assert abs(row.delta - 0.125) < 1e-12
