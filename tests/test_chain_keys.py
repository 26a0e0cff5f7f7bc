from __future__ import annotations

from pulse.operators import similarity


def test_groups_may_share_keys(spark):
    rows = spark.createDataFrame(
        [(g, k, 10 - k, [1.0, float(k)]) for g in ("a", "b") for k in (1, 2, 3)],
        "g string, id long, facebook_interactions long, vector array<double>",
    )
    whole = similarity.similarity_chain(rows, "g", "id").collect()
    steps = similarity.similarity_chain(rows, "g", "id", chain_rows=2).collect()
    assert sorted(whole) == sorted(steps) and len(steps) == 6
