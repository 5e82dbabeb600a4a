import pytest
from pyspark.sql import functions as F

from archiveloom.llm.language import label_language, language_segments, mislabelled, record_languages

EN = "The committee met in the spring to review the work of the year. No one could say why the road was closed. It was noted that the boats had come late. "
FR = "La commission a examiné les comptes de l'année. Personne ne savait pourquoi la route était fermée. Il a été noté que les bateaux étaient en retard. "
DE = "Die Kommission prüfte im Frühling die Arbeit des Jahres. Niemand wusste, warum die Strasse am 8. März gesperrt war. Es zeigte sich, dass die Boote zu spät kamen. "


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("en", EN * 3 + "While the harbour was open, they waited for the ropes and the lamps."), ("fr", FR * 3 + "Tandis que le port était ouvert, ils attendaient les cordes et les lampes."), ("de", DE * 3 + "Während der Hafen offen war, warteten sie auf die Seile und die Lampen.")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sample_id bigint, lang string, text string")


def test_labels(spark):
    said = ["en", "ENG", "English", "en-GB", "fr_CH", "français", "Deutsch", "русский", None, "", "  ", "und", "xx", "?", "unknown", "Dutch", "pt-BR"]
    rows = spark.createDataFrame([(s,) for s in said], "l string").select("l", label_language(F.col("l")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["en", "en", "en", "en", "fr", "fr", "de", "ru", "", "", "", "", "", "", "", "dutch", "pt"]


def test_found(spark, samples, clashing):
    rows = [
        (1, EN, "en"), (2, EN, "fr"), (3, FR, None), (4, EN + FR, "en"), (5, EN + "La route était fermée depuis longtemps.", "en"), (6, None, "fr"), (7, "", None), (8, " \n", "x"),
        (9, "• ropes\n• lamps, 40\n• water pumps", "fr"), (10, DE, "ger"), (11, "xkq zvb%% ?; 0 wq!. kj xx!", None), (12, EN * 400, "de"), (2, EN, "fr"), (None, EN, None), (13, "Only one sentence stands here in the end.", None),
    ]
    df = clashing(spark.createDataFrame(rows, "rec_no bigint, content string, lang_label string"))
    got = sorted((r["rec_no"], r["lang"]) for r in mislabelled(df, samples).collect() if r["rec_no"] is not None)
    assert got == [(2, "en"), (3, "fr"), (4, "en"), (4, "fr"), (12, "en")]
    assert mislabelled(df.limit(0), samples).collect() == []


def test_segments_keep_all_and_have_confidence(spark, samples):
    df = spark.createDataFrame([(1, EN + "\n\n" + FR), (2, "12 34")], "rec_no bigint, content string")
    rows = sorted(language_segments(df, samples).collect(), key=lambda r: (r["rec_no"], r["seg_no"]))
    assert [r["lang"] for r in rows] == ["en", "fr", ""] and all(0 <= r["confidence"] <= 1 for r in rows)
    assert [r["n_sentences"] for r in rows] == [3, 3, 0]
    per = {(r["rec_no"], r["lang"]): r["share"] for r in record_languages(language_segments(df, samples)).collect()}
    assert abs(sum(v for (k, _), v in per.items() if k == 1) - 1) < 1e-9


def test_held_out_accuracy(spark, samples):
    held = [("en", "They had to wait for the water until the end of the week."), ("fr", "Ils ont dû attendre l'eau jusqu'à la fin de la semaine."), ("de", "Sie mussten bis zum Ende der Woche auf das Wasser warten.")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(held)], "rec_no bigint, content string")
    assert [r["lang"] for r in sorted(language_segments(df, samples).collect(), key=lambda r: r["rec_no"])] == ["en", "fr", "de"]


def test_no_samples(spark, samples):
    df = spark.createDataFrame([(1, EN)], "rec_no bigint, content string")
    assert [r["lang"] for r in language_segments(df, samples.limit(0)).collect()] == [""]


def test_numbered_entries_are_no_sentences(spark, samples):
    text = "\n".join(f"{i}. the {w} of the harbour guards, 40" for i, w in enumerate(["ropes", "lamps", "boats", "pumps"] * 5, 1))
    df = spark.createDataFrame([(1, text, "fr")], "rec_no bigint, content string, lang_label string")
    assert mislabelled(df, samples).collect() == []


def test_fragments_of_another_language_are_stretches(spark, samples):
    verse = "Personne ne savait pourquoi la route était fermée\n\nil a été noté que les bateaux étaient en retard"
    df = spark.createDataFrame([(1, EN + "\n\n" + verse + "\n\n" + EN), (2, EN + "\n\nlamps, 40\n\n" + EN)], "rec_no bigint, content string")
    rows = sorted(language_segments(df, samples).collect(), key=lambda r: (r["rec_no"], r["seg_no"]))
    assert [(r["rec_no"], r["lang"], r["n_sentences"]) for r in rows] == [(1, "en", 3), (1, "fr", 0), (1, "en", 3), (2, "en", 6)]
    assert {r["lang"] for r in record_languages(language_segments(df, samples)).where("rec_no = 1").collect()} == {"en", "fr"}


def by_definition(profiles, words):
    """Out-of-place distances, n-gram by n-gram."""
    from archiveloom.llm.language import PROFILE_SIZE, ranked

    grams = ranked(words)[:PROFILE_SIZE]
    out = []
    for k in range(len(profiles.langs)):
        place = lambda g: int(profiles.place[profiles.row.get(g, 0), k])
        away = [PROFILE_SIZE if place(g) > PROFILE_SIZE else abs(place(g) - i * PROFILE_SIZE // len(grams)) for i, g in enumerate(grams)]
        out.append(sum(away) / (PROFILE_SIZE * len(grams)) if grams else 1.0)
    return out


@pytest.mark.parametrize("at_once", [1, 300, 1 << 19])
def test_distances_of_many_sentences_are_those_of_each(monkeypatch, at_once):
    import random

    from archiveloom.llm import language

    profiles = language.Profiles.fit([("en", EN * 9), ("fr", FR * 9), ("de", DE * 9)])
    monkeypatch.setattr(language, "_AT_ONCE", at_once)
    monkeypatch.setattr(language, "_REMEMBERED", 900)
    rng = random.Random(7)
    vocabulary = [w.lower() for t in (EN, FR, DE) for w in language._WORD.findall(t)] + ["zzz", "x", "aaaaaaaa", "ж" * 50]
    sents = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 9, 40, 700]))] for _ in range(60)]
    found = profiles.distances_of(sents)
    for words, got in zip(sents, found):
        assert all(abs(a - b) < 1e-12 for a, b in zip(got, by_definition(profiles, words)))
    assert profiles.distances_of([]).shape == (0, 3)
