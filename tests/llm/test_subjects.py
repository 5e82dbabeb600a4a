import random

from archiveloom.llm.subjects import SubjectModel, assigned, buckets, composition, sentence_words, subject_scores

TERMS = {"law": ["treaty clauses", "appeal hearings", "court rulings", "sworn statements"], "water": ["pumping stations", "filter beds", "reservoir dams", "deep wells"], "sport": ["football games", "marathon medals", "league tables", "swimming races"]}
PLAIN = ["weekly notes", "field visits", "open questions", "local plans"]


def sentence(rng, a, b):
    return rng.choice(["It was noted that the {} delayed the {}.", "No one could say why the {} limited the {}.", "The {} came before the {} in the spring.", "Both the {} and the {} were discussed at the office."]).format(a, b)


def corpus(n, seed):
    """Texts of one subject and plain sentences; terms beyond the second stand in no seed."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        subject = rng.choice([*TERMS, None])
        out = []
        for k in range(8):
            if subject and k % 2 == 0:
                out.append(sentence(rng, rng.choice(TERMS[subject]), rng.choice(PLAIN)))
            else:
                out.append(sentence(rng, *rng.sample(PLAIN, 2)))
        rows.append((f"n{i}", " ".join(out), subject))
    return rows


def seeds(seed=1):
    rng = random.Random(seed)
    return [(s, " ".join(sentence(rng, t, rng.choice(PLAIN)) for t in rng.sample(TERMS[s][:2], 2))) for s in TERMS for _ in range(8)]


def test_learns_terms_no_seed_holds():
    rows = corpus(400, 2)
    model = SubjectModel.fit(seeds(), [t for _, t, _ in rows])
    held = corpus(200, 3)
    right = 0
    for _, text, subject in held:
        share = (model.probabilities([buckets(w) for w in sentence_words(text)]) > model.thresholds).mean(0)
        right += {s for s, x in zip(model.subjects, share) if x >= 0.25} == ({subject} if subject else set())
    assert right >= 0.97 * len(held)


def test_operator(spark, clashing):
    rows = [(n, t) for n, t, _ in corpus(300, 4)]
    want = {n: s for n, _, s in corpus(300, 4)}
    extra = [("n0", rows[0][1].replace(". ", ".\n")), ("null", None), (None, rows[1][1]), ("empty", ""), ("long", rows[1][1] * 500), ("tie", "12 34.")]
    df = clashing(spark.createDataFrame(rows + extra, "node_id string, text string"))
    seed = spark.createDataFrame([(i, s, "en", t) for i, (s, t) in enumerate(seeds())] + [(99, None, "en", "x"), (98, "law", "en", None)], "seed_id bigint, subject string, lang string, text string")
    scores = subject_scores(df, seed).cache()
    got = {}
    for r in assigned(scores).collect():
        got.setdefault(r["node_id"], set()).add(r["subject"])
    assert sum(got.get(n, set()) == ({s} if s else set()) for n, s in want.items()) >= 0.97 * len(want)
    assert "null" not in {r["node_id"] for r in scores.collect()} and "empty" not in got and None not in got
    areas = spark.createDataFrame([("law", "Law"), ("water", "Water"), ("sport", "Sport"), ("music", "Music")], "subject string, name_en string")
    made = {r["subject"]: r for r in composition(scores, areas).collect()}
    assert set(made) == {"law", "water", "sport", "music", None} and made["music"]["n_texts"] == 0 and made["music"]["weight"] is None
    assert sum(r["n_texts"] for r in made.values()) == scores.select("node_id").distinct().count()


def test_empty(spark):
    seed = spark.createDataFrame([(1, "law", "en", "The treaty clauses delayed the field visits.")], "seed_id bigint, subject string, lang string, text string")
    none = spark.createDataFrame([], "node_id string, text string")
    assert subject_scores(none, seed).collect() == []
    one = spark.createDataFrame([("a", "The treaty clauses delayed the field visits.")], "node_id string, text string")
    assert [r["subject"] for r in subject_scores(one, seed.limit(0)).collect()] == [None]


def test_terms_outside_of_the_sample(spark):
    """The gradient's sample is a tenth of the texts; n-grams and thresholds come from all, also from a long text."""
    rows = corpus(300, 5)
    rng = random.Random(6)
    # a rare term beside known ones, in few texts and in one long text
    rare = [(f"r{i}", " ".join(sentence(rng, t, rng.choice(PLAIN)) for _ in range(400 if i == 0 else 4) for t in ("reservoir dams", "desalination membranes")), "water") for i in range(6)]
    # texts of the rare term with too little else, so that they are found only if it is learnt
    bare = [(f"b{i}", " ".join(sentence(rng, "desalination membranes" if k == 0 else "weekly notes", rng.choice(PLAIN)) for k in range(3)), "water") for i in range(4)]
    texts = rows + rare + bare
    df = spark.createDataFrame([(n, t) for n, t, _ in texts], "node_id string, text string")
    seed = spark.createDataFrame([(i, s, "en", t) for i, (s, t) in enumerate(seeds())], "seed_id bigint, subject string, lang string, text string")
    got = {}
    for r in assigned(subject_scores(df, seed, sections=30)).collect():
        got.setdefault(r["node_id"], set()).add(r["subject"])
    assert all(got.get(n) == {"water"} for n, *_ in rare + bare)
    assert sum(got.get(n, set()) == ({s} if s else set()) for n, _, s in rows) >= 0.97 * len(rows)
