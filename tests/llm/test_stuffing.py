import random

import pytest

from archiveloom.llm.stuffing import sentence_share, spam_scores

rng = random.Random(5)
PLACES = ["Lyon", "Bern", "Turin", "Geneva", "Basel", "Milan", "Nice", "Ghent"]
THINGS = "wells ropes lamps boats pumps roads carts tents bricks seeds books maps wires tools nails pipes doors bells".split()
MORE = "broken woollen copper winter spare painted oiled heavy eastern folded sealed signed iron rusted garden cellar kitchen church".split()
VERBS = "delayed limited replaced reached closed opened passed covered".split()


def prose(n, seed=0):
    r = random.Random(seed)
    forms = ["It was noted that the {} {} the {} near {}.", "No one in {3} could say why the {0} {1} the {2}.", "The note of {4} May says that the {0} {1} the {2}.", "Although the {0} {1} the {2}, the {5} came first.", "Of the {4} files opened in {3}, some concerned the {0}."]
    return " ".join(r.choice(forms).format(r.choice(THINGS), r.choice(VERBS), r.choice(THINGS), r.choice(PLACES), r.randint(1, 999), r.choice(THINGS)) for _ in range(n))


SPAM = {
    "phrases": " | ".join(rng.choice(["cheap tents", "solar lamp sale"]) for _ in range(60)),
    "salad": " ".join(" ".join(rng.choice("buy water filter camp deal".split()) for _ in range(5)).capitalize() + rng.choice(".!") for _ in range(40)),
    "links": "\n".join(f"https://www.shop{rng.randint(1, 99)}.test/p/{rng.randint(1, 9999)}" for _ in range(30)),
    "labelled": "\n".join(f"{rng.choice(['cheap tents', 'water pumps', 'road maps'])}: http://kit{rng.randint(1, 99)}.test/go/{rng.randint(1, 999)}" for _ in range(25)),
    "markdown links": "\n".join(f"* [cheap tents](www.kit{rng.randint(1, 99)}.test/c/{rng.randint(1, 999)})" for _ in range(25)),
    "hashtags": " ".join(rng.choice(["#cheap_tents", "#solarlamp", "#watersale"]) + str(rng.randint(1, 50)) for _ in range(60)),
    "tags": "\n".join(f"{rng.choice(['cheap tents', 'solar lamp'])} {rng.choice(['XL', '4P', 'new'])} {rng.choice(['hot', 'SALE'])} {rng.randint(1, 9999)}.99" for _ in range(40)),
    "shaped": " ".join(f"For cheap tents in {p}, our cheap tents page has cheap tents and solar lamp. Find cheap tents, cheap tents {p} and cheap tents here." for p in PLACES),
    "half prose": prose(6) + "\n" + "\n".join(f"http://kit{rng.randint(1, 99)}.test/go/{rng.randint(1, 999)}" for _ in range(60)),
}
HAM = {
    "prose": prose(30, 1),
    "prose and tags": prose(30, 2) + "\n#tents #lamps #water",
    "inventory": "\n".join(f"{a.capitalize()} {b}: {rng.randint(1, 9999)} {rng.choice(PLACES)}" for a, b in zip(THINGS, MORE)),
    "bibliography": "\n".join(f"[{i}] {a.capitalize()} {b}. {rng.choice(PLACES)}, {1950 + i}. https://archive.example/{i}" for i, (a, b) in enumerate(zip(THINGS, MORE))),
    "resolution": "\n".join(f"{i}. The Assembly {v} the {b} {a} near {rng.choice(PLACES)};" for i, (a, b, v) in enumerate(zip(THINGS, MORE, ["calls upon the parties to respect", "urges all states to support", "asks for a report on", "takes note of"] * 5))),
    "card": "Shelfmark: B 1-2\nPlace: Lyon\nDate: 4 May 1960\nExtent: 12 ff",
    "noise": prose(10, 3) + " " + "".join(rng.choice("ACDEFGHKMNPQRTVWXY34679") for _ in range(3000)),
}


IN_SENTENCES = {"prose", "prose and tags", "bibliography", "resolution"}


@pytest.mark.parametrize("name", SPAM)
def test_spam_stands_in_no_sentences(name):
    assert sentence_share(SPAM[name]) < 0.5


@pytest.mark.parametrize("name", HAM)
def test_sentences(name):
    assert (sentence_share(HAM[name]) >= 0.5) == (name in IN_SENTENCES)


def test_odd_texts():
    assert sentence_share("") == 0.0 and sentence_share(" \n") == 0.0 and sentence_share("x" * 200_000) == 0.0 and sentence_share("http://" * 9000) == 0.0


def pages(spark, clashing):
    texts = [*SPAM.values(), *HAM.values(), *[prose(20, 100 + i) for i in range(60)]]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(900, None, "en"), (901, "", "en"), (902, " \n", None), (903, SPAM["salad"] * 300, "en"), (0, SPAM["phrases"], "en"), (None, prose(9), None), (904, "".join(chr(97 + rng.randrange(26)) for _ in range(200_000)), "en")]
    return clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")), len(rows) - 3


def test_operator(spark, clashing):
    df, n = pages(spark, clashing)
    got = spam_scores(df).collect()
    assert len(got) == n
    assert {r["doc_id"] for r in got if r["spam"]} == {*range(len(SPAM)), 903}
    assert spam_scores(df.limit(0)).collect() == []


def test_both_stages_decide(spark, clashing):
    """Neither redundancy nor the density of sentences alone gives the rows."""
    df, _ = pages(spark, clashing)
    want = {*range(len(SPAM)), 903}
    assert not any(r["spam"] for r in spam_scores(df, redundant=0.0).collect())
    lists = {len(SPAM) + i for i, name in enumerate(HAM) if name not in IN_SENTENCES}
    found = {r["doc_id"] for r in spam_scores(df, redundant=99.0).collect() if r["spam"]}
    assert found >= want | lists


def test_few_texts_of_a_language_lean_on_the_others(spark):
    """One page of a rare language is held against the usual ratio of all, by the same rule as the many."""
    rows = [(i, prose(20, 100 + i), "en") for i in range(200)] + [(900, SPAM["phrases"], "xx"), (901, prose(20, 7), "yy")]
    by = {r["doc_id"]: r for r in spam_scores(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert by[900]["spam"] and not by[901]["spam"]
    assert abs(by[901]["usual"] - by[0]["usual"]) < 0.1
