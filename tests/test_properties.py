"""Property checks of the sequential funnel against a direct count."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dialogscope import constants as K
from dialogscope.operators import funnel

TAGS = [None, K.TAG_EMPTY, K.TAG_TASK, K.TAG_NOT_MATH, K.TAG_OUT_OF_GRADES, K.TAG_LEFT_AFTER_MATCH,
        K.TAG_SUCCESS, K.TAG_MATCH_FAILED, K.TAG_COMING_SOON, "unknown"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(TAGS), max_size=60))
def test_matching_funnel_matches_direct_count(spark, statuses):
    df = spark.createDataFrame([(s,) for s in statuses], "status string")
    rows = funnel.matching_funnel(df).orderBy("stage_no").collect()
    counts = {t: statuses.count(t) for t in TAGS}
    survivors = len(statuses)
    assert rows[0].n_dialogs == survivors and rows[0].n_drop == 0
    for row, (_, tag) in zip(rows[1:-1], K.MATCHING_STEPS):
        survivors -= counts[tag]
        assert (row.n_dialogs, row.n_drop) == (survivors, -counts[tag])
    residual = survivors - counts[K.TAG_SUCCESS]
    assert rows[-1].n_dialogs == counts[K.TAG_SUCCESS]
    assert rows[-1].n_drop == (-residual if residual > 0 else 0)
    # Everything that left plus the successes accounts for every dialog.
    assert sum(-r.n_drop for r in rows) + rows[-1].n_dialogs == len(statuses)
