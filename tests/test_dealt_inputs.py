"""Small rows from which much is made are dealt out, so that a file of a few MB isn't one task."""

import pytest

from screentone import fixtures as fx
from screentone.plans import settings_queries as sq


@pytest.mark.parametrize("made", [fx.path_strings, fx.pixels, sq._presets, sq.a18_document_union])
def test_rows_are_dealt_to_all_partitions(spark, sf_dir, made):
    # the optimized plan keeps the given number; adaptive plans don't join such partitions
    plan = made(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and f", {spark.conf.get('spark.sql.shuffle.partitions')}" in plan
