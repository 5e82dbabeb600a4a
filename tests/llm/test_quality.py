import numpy as np
import pytest

from archiveloom.llm import quality
from archiveloom.llm.quality import EXAMPLES, KINDS, STATS, line_kinds, statistics, text_quality

COMMON = frozenset("the of and to in a was were by at it that no one why".split()) | frozenset("la le les de des et en".split())
PROSE = "The committee met in the spring to review the work of the year. No one could say why the road was closed. It was noted that the boats were late."


@pytest.mark.parametrize("kind, text", EXAMPLES)
def test_examples_by_lines(kind, text):
    total, _ = line_kinds(text, COMMON)
    assert max(total, key=total.get) == kind


def test_mixed():
    total, _ = line_kinds(PROSE + "\n\n• ropes\n• lamps, 40", COMMON)
    assert max(total, key=total.get) == "prose" and total["list"] > 0
    total, _ = line_kinds("The boats were late.\n" + "\n".join(f"{i}. ropes" for i in range(30)), COMMON)
    assert max(total, key=total.get) == "list"
    wrapped = PROSE.replace(" ", "\n", 1).replace("of the year", "of the\nyear")
    assert line_kinds(wrapped, COMMON)[0]["prose"] > 0.9 * len(wrapped.replace(" ", "").replace("\n", ""))


def test_statistics():
    s = dict(zip(STATS, statistics("The cat.\nA dog, 12", COMMON)))
    assert s["word_count"] == 4 and s["mean_word_length"] == 2.5 and s["punctuated_lines"] == 0.5 and s["common_words"] == 0.5
    assert statistics("", COMMON)[:6] == [0.0] * 6


def records(spark, clashing):
    rows = [(i, f"{PROSE} Number {i} was the last of them.") for i in range(150)]
    other = [(1000 + i, t + ("\n" + t) * (i % 3)) for i, (k, t) in enumerate(e for e in EXAMPLES * 3 if e[0] != "prose")]
    want = {1000 + i: k for i, (k, t) in enumerate(e for e in EXAMPLES * 3 if e[0] != "prose")}
    odd = [(5000, None), (5001, ""), (5002, " \n\t"), (5003, PROSE * 2000), (1000, other[0][1]), (None, PROSE)]
    df = clashing(spark.createDataFrame(rows + other + odd, "rec_no bigint, content string"))
    return df, want, spark.createDataFrame([(w,) for w in sorted(COMMON)] + [(None,)], "word string"), len(rows + other) + 3


def test_operator(spark, clashing):
    df, want, words, n = records(spark, clashing)
    got = text_quality(df, words).collect()
    by = {r["rec_no"]: r["kind"] for r in got}
    assert len(got) == n and all(by[k] == v for k, v in want.items()) and all(by[i] == "prose" for i in range(150)) and by[5003] == "prose"
    assert set(by.values()) == set(KINDS)
    # the mixture finds them without the check after it
    assert {r["rec_no"] for r in got if r["mixture_kind"] != want.get(r["rec_no"], "prose")} == set()
    assert text_quality(df.limit(0), words).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 130])
def test_any_number_of_records_takes_the_same_path(spark, clashing, n):
    df, want, words, _ = records(spark, clashing)
    some = df.where("rec_no >= 1000 and rec_no < 5000").dropDuplicates(["rec_no"]).orderBy("rec_no").limit(n)
    got = text_quality(some, words).collect()
    assert len(got) == min(n, len(want)) and all(r["component"] is not None and r["mixture_kind"] == want[r["rec_no"]] for r in got)


def test_rows_come_out_of_the_mixture(spark, clashing, monkeypatch):
    """A mixture of one kind only leaves nothing to be found: no other path gives rows."""
    df, _, words, _ = records(spark, clashing)

    def of_prose(model, inspected):
        return np.eye(len(KINDS))[[0] * len(model.mean)]

    monkeypatch.setattr(quality, "component_kinds", of_prose)
    assert {r["kind"] for r in text_quality(df, words).collect()} == {"prose"}


def test_steps_of_the_mixture_raise_the_likelihood(spark, clashing):
    df, _, words, _ = records(spark, clashing)
    rows = quality.measured(df, words)
    common = quality.known_words(words)
    stats = np.array([r["stats"] for r in rows.collect()])
    fitted = quality.fit_mixture(rows, common)
    loose = quality.Mixture(fitted.centre, fitted.scale, np.full(len(EXAMPLES), 1 / len(EXAMPLES)), fitted.standardised(np.array([statistics(t, common) for _, t in EXAMPLES])), np.full(fitted.var.shape, 0.5), fitted.kind)
    like = lambda m: m.posteriors(m.standardised(stats))[1].mean()
    assert like(fitted) > like(loose) + 1 and abs(fitted.weight.sum() - 1) < 1e-9
