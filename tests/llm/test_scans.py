import numpy as np
import pytest
from pyspark.sql import functions as F

from archiveloom.llm.scans import CONTEXTS, NEGATIVES, context_vectors, corrections, fits, glyph_links, in_sieve, is_furniture, lexicon, observed, plausible, repair_scans, repaired, sieve, without_furniture, word_vectors

SENTENCE = "The committee met in the spring and reviewed the work of the year, while the harbour was closed to all the boats from Saint-Orvin."


@pytest.mark.parametrize("line", ["[31]", "- 31 -", "113/240", "Page 58", "page 12", "39", "RELIEF BULLETIN  V0L. 7   [65]", "[116]   MINUTES 0F THE COUNCIL  - DOLVAZ", "Report of the Delegation  1951", "Rapport d'activité  No. 3450"])
def test_furniture(line):
    assert is_furniture(line)


@pytest.mark.parametrize("line", ["", "The wells were repaired in 1951.", "• ropes, 40", "Lyon;40;2", "of the year", "1. ropes", "1995."])
def test_no_furniture(line):
    assert not is_furniture(line)


def test_sentence_goes_on_over_a_page():
    text, n = without_furniture("The boats waited until the\n\nPage 24\nRELIEF BULLETIN  - LYON\n\nend of the month.")
    assert (text, n) == ("The boats waited until the\nend of the month.", 2)


def test_glyphs():
    assert plausible("modu1es", "modules") and plausible("siiperabari", "superaban") and plausible("concemed", "concerned") and plausible("wliile", "while") and plausible("ограпичили", "ограничили")
    assert not plausible("load", "road") and not plausible("poi", "por") and not plausible("cat", "dog")


def test_repair_joins_and_reflows():
    text = "The boats wait-\ned until the end of\nthe moritli. Those of Saint-\nOrvin came first."
    fixed, broken, misread, furniture = repaired(text, {"moritli": "month"}, {"waited", "saint-orvin"})
    assert fixed == "The boats waited until the end of the month. Those of Saint-Orvin came first." and (broken, misread, furniture) == (1, 1, 0)


def test_vectors_fit_the_contexts_a_word_stands_in():
    """Two halves of the contexts that never meet: a word of the one fits it and not the other."""
    pairs = np.zeros((40, 40))
    pairs[:20, :20] = pairs[20:, 20:] = 5.0
    np.fill_diagonal(pairs, 0)
    context, negative = context_vectors(pairs)
    counts = np.zeros((2, 40))
    counts[0, :20] = counts[1, 20:] = 3.0
    logits = word_vectors(counts, context, negative) @ context.T + np.log(NEGATIVES)
    assert logits[0, :20].min() > 0 > logits[0, 20:].max() and logits[1, 20:].min() > 0 > logits[1, :20].max()
    assert abs(negative.sum() - 1) < 1e-9 and context_vectors(np.zeros((0, 0)))[0].shape == (0, 32)


def test_sieve_lets_all_through_that_went_in(spark):
    words = [f"w{i}ж" for i in range(5000)]
    bits, packed = sieve(spark.createDataFrame([(w,) for w in words], "word string"))
    assert all(in_sieve(w, bits, packed) for w in words) and sum(in_sieve(w + "q", bits, packed) for w in words) < 250
    assert not in_sieve("a", *sieve(spark.createDataFrame([], "word string")))


def corpus():
    """Texts of two kinds of sentence. Frequent: dear, east, eats, ears (of the harbour's kind). Rare but true words of the garden's kind that scanning could
    have made of them: clear, cast, cats, cars. Misread words of either kind."""
    rows = []
    for i in range(400):
        rows.append(f"On that long evening number{i % 20} the old crew and their dear friends left the harbour east of town where one eats with open ears and sings about boats.")
        rows.append(f"In spring the garden number{i % 20} needs water and seeds and the young roses grow beside green beans under warm rain.")
    rows += ["In spring the garden needs clear water and seeds and cast roses grow beside cats and green beans under warm cars."] * 4
    rows.append("On that long cvening the old crew and their dcar friends left the liarbour cast of town where one eats with open ears and sings about boats.")
    return [*rows, "In spring the gardcn needs water and seeds and the young roses grow besicle green beans under warm rain."]


#: Links by looks alone, and whether they are right where the rare word stands.
LABELLED = {("clear", "dear"): False, ("cats", "eats"): False, ("cars", "ears"): False, ("cvening", "evening"): True, ("dcar", "dear"): True, ("liarbour", "harbour"): True, ("gardcn", "garden"): True, ("besicle", "beside"): True}


def linked(spark, rows, least_fit):
    texts = spark.createDataFrame(list(enumerate(rows)), "rec_no bigint, body string")
    lex = lexicon(texts.select("body"))
    contexts = [r["word"] for r in lex.orderBy(F.desc("n"), "word").limit(CONTEXTS).collect()]
    links = glyph_links(lex)
    found = corrections(fits(links, observed(texts, links, contexts).persist(), len(contexts)).persist(), least_fit)
    return {(r["word"], r["right"]) for r in found.collect()}


def test_vectors_refuse_links_that_glyphs_allow(spark):
    """Without the fit of the vectors, true rare words are taken for misread ones; with it, misread ones only are linked."""
    rows = corpus()
    by_looks, by_fit = linked(spark, rows, -1e9), linked(spark, rows, -0.5)
    assert set(LABELLED) <= by_looks
    right = {k for k, v in LABELLED.items() if v}
    assert right <= by_fit and not (by_fit & (set(LABELLED) - right))


def test_context_of_the_record_picks_among_corrections(spark):
    """'f1at' may be 'flat' or 'fiat': the words beside it say which."""
    rows = [f"The small flat number{i % 9} has windows over the quiet yard." for i in range(60)] + [f"By royal fiat number{i % 9} were taxes raised in every town." for i in range(60)]
    texts = [*enumerate(rows), (900, "The small f1at has windows over the quiet yard.")]
    texts.append((901, "By royal f1at were taxes raised in every town."))
    words = spark.createDataFrame([(w,) for w in "the over has by were in".split()], "word string")
    by = {r["rec_no"]: r["repaired_text"] for r in repair_scans(spark.createDataFrame(texts, "rec_no bigint, content string"), words).collect()}
    assert by[900] == "The small flat has windows over the quiet yard." and by[901] == "By royal fiat were taxes raised in every town."


def test_lists_keep_their_lines(spark):
    text, broken, misread, furniture = repaired("• ropes for the liarbour\n39\n• lamps for the com-\nmittee", {"liarbour": "harbour"}, {"committee"}, prose=False)
    assert text == "• ropes for the harbour\n39\n• lamps for the committee" and (broken, misread, furniture) == (1, 1, 0)


def test_operator(spark, clashing):
    clean = [(i, f"{SENTENCE} Number {i} was the last.") for i in range(60)]
    rows = [
        *clean, (100, SENTENCE.replace("harbour", "liarbour").replace("reviewed", "rcviewed")), (101, SENTENCE.replace("committee", "com-\nmittee")), (102, SENTENCE.replace(" and reviewed", "\n\nPage 12\n\nand reviewed")),
        (103, SENTENCE.replace(" ", "\n", 5)), (104, SENTENCE.replace("Saint-Orvin", "Saint-\nOrvin")), (105, "0 a il ii rn t a il ii c c 0 i1 il a t\n39\na vv 0 ii rn il c t"), (106, None), (107, ""), (108, "• ropes\n39\n• lamps"), (None, SENTENCE.replace("committee", "com¬\nmittee")),
        (109, "x" * 100_000), (101, SENTENCE.replace("committee", "com-\nmittee")),
    ]
    df = clashing(spark.createDataFrame(rows, "rec_no bigint, content string"))
    words = spark.createDataFrame([(w,) for w in "the in and of to was all from while".split()], "word string")
    got = repair_scans(df, words).collect()
    assert len(got) == len(rows)
    by = {r["rec_no"]: r for r in got}
    found = {k for k, r in by.items() if r["n_broken"] + r["n_misread"] + r["n_furniture"] > 0}
    assert found == {100, 101, 102, None}
    assert by[100]["repaired_text"] == SENTENCE and by[101]["repaired_text"] == SENTENCE and by[102]["repaired_text"] == SENTENCE
    assert by[104]["repaired_text"] == SENTENCE and by[106]["repaired_text"] is None and by[107]["repaired_text"] == "" and by[105]["junk"]
    assert repair_scans(df.limit(0), words).collect() == []
