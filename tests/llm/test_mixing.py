import pytest

from archiveloom.llm.mixing import mixture, rates, shares
from archiveloom.llm.tokens import token_sizes

TARGETS = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 4), ("gone", 0.1, 3)]


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def sizes(spark):
    rows = [(i, "a", 50 + i % 100) for i in range(2000)] + [(10_000 + i, "b", 30 + i % 50) for i in range(1500)] + [(20_000 + i, "c", 100 + i % 10) for i in range(60)]
    rows += [(30_000 + i, "other", 10) for i in range(50)] + [(40_000, None, 10), (0, "a", 50), (None, "a", 60), (50_000, "a", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")


def test_shares_and_repeats(spark, targets, clashing):
    mixed = mixture(clashing(sizes(spark)), targets).cache()
    got = {r["source"]: r for r in shares(mixed, targets).collect()}
    for source, share, most in TARGETS[:3]:
        assert abs(got[source]["actual_share"] - share) < 0.004 and 0 < got[source]["most_repeats"] <= most * (2 if source == "a" else 1)
    assert got["gone"]["actual_share"] == 0 and got["gone"]["uses"] == 0
    assert {r["source"] for r in mixed.select("source").distinct().collect()} == {"a", "b", "c"}
    assert got["c"]["most_repeats"] == 4


def test_same_mixture_every_time(spark, targets):
    a = sorted(map(str, mixture(sizes(spark), targets).collect()))
    b = sorted(map(str, mixture(sizes(spark).repartition(7), targets).collect()))
    assert a == b


def test_wanted_total(spark, targets):
    total = sum(r["tokens"] for r in mixture(sizes(spark), targets, total_tokens=20_000).collect())
    assert abs(total - 20_000) < 400
    most = {}
    for r in mixture(sizes(spark), targets, total_tokens=1e12).collect():
        most[r["source"]] = max(most.get(r["source"], 0), r["repeat_no"])
    assert most == {"a": 2, "b": 1, "c": 4}


def test_rates(spark, targets):
    totals = spark.createDataFrame([("a", 10, 1000), ("b", 10, 1000), ("c", 10, 100)], "source string, records bigint, tokens bigint")
    plan = {r["source"]: r["rate"] for r in rates(totals, targets)}
    assert plan["c"] == 4 and plan["gone"] == 0 and plan["a"] * 1000 / (plan["c"] * 100) == pytest.approx(0.5 / 0.2)


def test_empty(spark, targets):
    assert mixture(sizes(spark).limit(0), targets).collect() == []
    assert mixture(sizes(spark), targets.limit(0)).collect() == []
    assert {r["actual_share"] for r in shares(mixture(sizes(spark).limit(0), targets), targets).collect()} == {0.0}


def test_tokens(spark, clashing):
    df = clashing(spark.createDataFrame([(1, "The wells were repaired."), (2, None), (3, ""), (4, "<|endoftext|>"), (1, "é" * 5000), (None, "a")], "doc_id bigint, text string"))
    got = token_sizes(df).collect()
    assert len(got) == 5 and {r["tokens"] for r in got if r["doc_id"] == 3} == {0}
    assert [r["tokens"] for r in got if r["doc_id"] == 4][0] > 1
    assert token_sizes(df.limit(0)).collect() == []
