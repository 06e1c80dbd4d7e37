"""Peak labels pick the traces' peaks once, and ask nothing of lineitem's rows that is asked of tuples."""

import pytest

from retentia.plans import q_pedigree as Q


@pytest.mark.parametrize("query", [Q.t18, Q.t18_score_first])
def test_labels_read_stored_peaks_and_tuples(spark, sf, query):
    plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    assert "l_partkey" not in plan
