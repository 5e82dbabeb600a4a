from itertools import permutations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from archiveloom.llm.duplicates import collapse_duplicates, duplicate_members

CARD = "Shelfmark: B 1-2\nPlace: Lyon\nDate: 4 May 1960"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def members(spark, rows):
    return sorted(map(tuple, duplicate_members(frame(spark, rows)).collect()))


def test_formatting_case_and_field_order(spark):
    rows = [
        (5, "The wells, repaired."), (3, "  the WELLS\nrepaired!"), (9, "The wells, repaired."), (4, "repaired the wells"),
        (20, CARD), (21, "DATE = 4 May 1960 ; PLACE = Lyon ; SHELFMARK = B 1-2"), (22, "place:\tlyon | shelfmark:\tb 1-2 | date:\t4 may 1960"),
        (23, "Shelfmark: B 1-2\nPlace: 4 May 1960\nDate: Lyon"), (24, "Shelfmark B 1-2 Place Lyon Date 4 May 1960"),
        (30, "Die Straße"), (31, "DIE STRASSE"), (40, None), (41, ""), (42, "..!"), (43, "?!"), (None, "The wells, repaired."),
    ]
    assert members(spark, rows) == [(3, 5), (3, 9), (20, 21), (20, 22), (20, 24), (30, 31)]


def test_counts_ties_and_repeats(spark, clashing):
    rows = [(1, "a b"), (1, "a b"), (2, "A-B"), (3, "c" * 200_000), (4, "C" * 200_000)]
    got = {r["keep_id"]: r["copies"] for r in collapse_duplicates(clashing(frame(spark, rows))).collect()}
    assert got == {1: 3, 3: 2}
    assert sorted(map(tuple, duplicate_members(clashing(frame(spark, rows))).collect())) == [(1, 2), (3, 4)]


def test_hot_group(spark):
    rows = [(i, "the same text") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(50)]
    got = members(spark, rows)
    assert got == [(0, i) for i in range(1, 3000)]


def test_empty(spark):
    assert members(spark, []) == []
    assert collapse_duplicates(frame(spark, [])).collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aB1 ,.\n", max_size=6), min_size=1, max_size=12))
def test_against_brute_force(spark, texts):
    rows = list(enumerate(texts))
    got = {r["keep_id"]: r["copies"] for r in collapse_duplicates(frame(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        if s := "".join(c for c in t.lower() if c.isalnum()):
            groups.setdefault(s, []).append(i)
    assert got == {min(g): len(g) for g in groups.values()}


def test_every_order_of_fields_is_one(spark):
    rows = list(enumerate("; ".join(p) for p in permutations(CARD.split("\n"))))
    assert len(members(spark, rows)) == 5


def test_one_text_spelled_in_100_000_ways(spark):
    """A third of all rows and more are spellings of one canonical text: the hot key goes by the broadcast."""
    rows = spark.range(160_000).selectExpr("id as doc_id", "case when id < 100000 then regexp_replace(concat('the same words', repeat(' ', cast(id % 7 as int)), lpad(bin(id), 17, '0')), '[01]', '.') else concat('text ', id) end as text")
    spelled = rows.selectExpr("doc_id", "case when doc_id < 100000 then concat(text, repeat('-', cast(doc_id div 17 as int) % 97), repeat('!', cast(doc_id % 89 as int))) else text end as text")
    got = duplicate_members(spelled)
    assert got.where("keep_id = 0").count() == 99_999 and got.count() == 99_999
    assert {r["keep_id"]: r["copies"] for r in collapse_duplicates(spelled).where("copies > 1").collect()} == {0: 100_000}
