import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from archiveloom.llm.packing import best_fit_decreasing, lower_bound, pack, packing_report


def fewest(sizes, capacity):
    """The least number of containers, by trying all."""
    sizes = sorted((s for s in sizes if s), reverse=True)
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= sizes[i]:
                left = list(rooms)
                left.remove(k)
                go(i + 1, [*left, k - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=9))
def test_bound_never_exceeds_the_fewest(sizes):
    x = np.array(sizes, dtype=np.int64)
    best = fewest(sizes, 20)
    box = best_fit_decreasing(x, 20)
    assert lower_bound(x, 20) <= best <= max(1 if any(sizes) else 0, box.max() + 1 if any(sizes) else 0)
    assert not len(x) or np.bincount(box, weights=x).max() <= 20


def test_bounds_beyond_the_total_size():
    assert lower_bound(np.array([11] * 5), 20) == 5
    assert lower_bound(np.array([7] * 4), 20) == 2
    assert lower_bound(np.array([], dtype=np.int64), 20) == 0


def test_operator(spark, clashing):
    rng = np.random.default_rng(3)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(0, 700, 800))] + [(9000, 2500), (9001, 512), (9002, None), (0, 17), (None, 30)]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, tokens bigint"))
    kinds = spark.createDataFrame([("small", 512), ("medium", 2048), ("none", 0), (None, None)], "container_kind string, capacity_tokens int")
    packed = pack(df, kinds, partition_items=200).cache()
    got = packed.collect()
    for kind, capacity in (("small", 512), ("medium", 2048)):
        own = [r for r in got if r["container_kind"] == kind]
        assert sum(r["tokens"] for r in own) == sum(t for _, t in rows if t)
        by = {}
        for r in own:
            by.setdefault(r["container_id"], []).append(r)
        assert all(sum(r["tokens"] for r in x) <= capacity for x in by.values())
        pieces = sorted((r["piece_no"], r["start_token"], r["tokens"]) for r in own if r["doc_id"] == 9000)
        assert [t for *_, t in pieces] == [capacity] * (2500 // capacity) + [2500 % capacity]
        assert all(r["piece_no"] == 0 for r in own if r["doc_id"] not in (0, 9000) and dict(rows).get(r["doc_id"], 0) <= capacity)
    report = {r["container_kind"]: r for r in packing_report(packed).collect()}
    assert set(report) == {"small", "medium"} and report["medium"]["unused_share"] < 0.03
    assert pack(df.limit(0), kinds).collect() == [] and pack(df, kinds.limit(0)).collect() == []
