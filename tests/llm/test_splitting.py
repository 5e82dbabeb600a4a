from hypothesis import given, settings
from hypothesis import strategies as st

from archiveloom.llm.splitting import balanced_cuts, split_oversized


def check(text, limit, overlap):
    spans = balanced_cuts(text, limit, overlap)
    if not text:
        assert spans == []
        return spans
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(q[0] == p[1] - overlap for p, q in zip(spans, spans[1:]))
    assert text[: spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:]) == text
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n,é", max_size=900), st.integers(60, 300))
def test_round_trip(text, limit):
    check(text, limit, 20)


def test_boundaries_and_balance():
    text = "\n\n".join(["The wells were repaired in June. The road was opened." * 8] * 20)
    spans = check(text, 2048, 20)
    assert all(text[b - 2 : b] == "\n\n" for _, b in spans[:-1])
    assert len(check("x" * 10_000, 2048, 20)) == 5
    assert len(check("x" * 2049, 2048, 20)) == 2
    check("é" * 5000, 2048, 20)
    check("\r\n" * 3000, 2048, 20)


def test_operator(spark, clashing):
    rows = [(1, "short"), (2, "word " * 1000), (3, None), (4, ""), (5, "word " * 1000), (None, "none"), (7, "x" * 300_000)]
    df = clashing(spark.createDataFrame(rows, "rec_no bigint, content string"))
    got = split_oversized(df, "rec_no", "content").collect()
    by = {}
    for r in got:
        by.setdefault(r["item_key"], []).append(r)
    assert set(by) == {1, 2, 5, 7, None} and by[1][0]["piece"] == "short" and by[1][0]["n_pieces"] == 1
    whole = dict(rows)
    for k in (2, 5, 7):
        pieces = sorted(by[k], key=lambda r: r["piece_no"])
        assert len(pieces) == pieces[0]["n_pieces"] and all(r["piece"] == whole[k][r["start_pos"] : r["end_pos"]] and len(r["piece"]) <= 2048 for r in pieces)
    assert split_oversized(df.limit(0), "rec_no", "content").collect() == []


@given(st.integers(2, 60), st.data(), st.text("ab .\n", min_size=1, max_size=700))
@settings(max_examples=300, deadline=None)
def test_any_overlap_keeps_the_limits_and_prefers_boundaries(limit, data, text):
    overlap = data.draw(st.integers(0, limit - 1))
    spans = balanced_cuts(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= limit for a, b in spans)
    assert all(b - c == overlap for (_, b), (c, _) in zip(spans, spans[1:]))
