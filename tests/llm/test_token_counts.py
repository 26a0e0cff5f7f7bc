from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from pulse.llm import token_counts as tc
from pulse.session import settle


def test_histogram_against_brute_force(spark):
    sizes = [0, 0, 3, 5, 5, 1023, 1024, 1025, 2_000_000, 2_000_000, 5_000_000]
    frame = spark.createDataFrame([(n,) for n in sizes], "n_tokens long")
    got = {r.n_tokens: r for r in tc.with_totals(settle(tc.length_histogram(frame))).collect()}
    assert set(got) == set(sizes)
    for n, count in Counter(sizes).items():
        row = got[n]
        assert row.n_docs == count and row.docs_longer == sum(x > n for x in sizes)
        assert row.tokens_longer == sum(x for x in sizes if x > n)
        assert row.truncated_total == sum(min(x, n) for x in sizes)


def test_nulls_empty_and_long_texts(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    texts = [None, "", "a b", "x" * 50_000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert sorted(r[0] for r in tc.encoded_lengths(frame).collect()) == want
    assert tc.with_totals(tc.length_histogram(tc.encoded_lengths(frame.limit(0)))).count() == 0


def test_any_limit_and_quantile(spark):
    sizes = [0, 0, 3, 5, 5, 5, 40, 900]
    histogram = tc.length_histogram(spark.createDataFrame([(n,) for n in sizes], "n_tokens long"))
    limits = [0, 1, 4, 5, 6, 39, 1_000, 1]
    got = {r.limit: r for r in tc.at_limits(histogram, limits).collect()}
    assert set(got) == set(limits)
    for limit, row in got.items():
        assert row.docs_upto == sum(x <= limit for x in sizes) and row.docs_longer == sum(x > limit for x in sizes)
        assert row.truncated_total == sum(min(x, limit) for x in sizes)
    found = {r.share: r.n_tokens for r in tc.quantiles(histogram, [0.1, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert found == {0.1: 0, 0.25: 0, 0.5: 5, 0.9: 900, 1.0: 900}
    assert tc.at_limits(histogram, []).count() == 0 and tc.quantiles(histogram.limit(0), [0.5]).count() == 0


def test_texts_are_encoded_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = tc.length_histogram(tc.encoded_lengths(docs))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    rows = tc.with_totals(tc.length_histogram(tc.encoded_lengths(docs.unionAll(docs).withColumn("n_tokens", F.lit(1))))).collect()
    once = tc.with_totals(tc.length_histogram(tc.encoded_lengths(docs))).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {r.n_tokens: 2 * r.n_docs for r in once}
    assert max(r.docs_upto for r in once) == docs.count() and max(r.quantile for r in once) == 1.0
