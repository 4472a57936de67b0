import random

from pyspark.sql import functions as F

from collatio.llm import p05_consensus as c

LABELS = ["visual_misrecognition", "content_omission", "repetition", "other", "ambiguous"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "annotation_id string, annotator string, primary_label string, labelled_at long, loaded_at long")


def book(spark, labels=LABELS):
    return spark.createDataFrame([(x,) for x in labels], "label string")


def test_recovers_truth_against_spammers(spark):
    rng = random.Random(3)
    truth = {f"i{k}": rng.choice(LABELS) for k in range(150)}
    skill = {"good1": 0.9, "good2": 0.85, "good3": 0.8, "mid": 0.6}
    rows, majority = [], 0
    for item, t in truth.items():
        votes = {}
        for w, p in skill.items():
            if rng.random() < 0.6:
                votes[w] = t if rng.random() < p else rng.choice(LABELS)
        for w in ("spam1", "spam2", "spam3"):
            if rng.random() < 0.7:
                votes[w] = "visual_misrecognition"
        rows += [(item, w, v, 1, 1) for w, v in votes.items()]
        if len(votes) >= 3:
            counts = {v: list(votes.values()).count(v) for v in votes.values()}
            majority += max(sorted(counts), key=counts.get) == t
    got = c.consensus(frame(spark, rows), book(spark), 3).collect()
    right = sum(r.primary_label == truth[r.annotation_id] for r in got)
    assert right > majority + 15 and right / len(got) > 0.8
    who = {r.annotator: r for r in c.annotators(frame(spark, rows), book(spark)).collect()}
    assert min(who[w].reliability for w in ("good1", "good2")) > max(who[f"spam{i}"].reliability for i in (1, 2, 3)) + 0.3
    assert who["spam1"].usual_guess == "visual_misrecognition"


def test_readings_and_edges(spark):
    rows = [
        ("1", " Ann", "Content-Omission ", 1, 1), ("1", "ann", "REPETITION", 2, 1), ("1", "ann", "REPETITION", 2, 1), ("1", "ann", "todo", 9, 9), ("1", "bob", "repetition", 1, 1), ("1", "cy", "content omission", 1, 1), ("1", None, "other", 1, 1),
        ("2", "ann", "other", 1, 1), ("2", "bob", "other", 1, 1), ("3", "ann", None, 1, 1), ("3", "bob", " ", 1, 1), ("3", "cy", "nonsense", 1, 1), (None, "bob", "other", 1, 1),
        ("4", "ann", "other", 1, 1), ("4", "bob", "other", 1, 1), ("4", "cy", "other", None, None), ("4", "cy", "ambiguous", 5, None),
    ]
    df = frame(spark, rows).withColumns({"label": F.lit("x"), "theta": F.lit(1), "p": F.lit(2)})
    got = {r.annotation_id: r for r in c.consensus(df, book(spark)).collect()}
    assert set(got) == {"1", "2", "4"} and got["2"].primary_label == "other" and got["2"].n_annotators == 2  # every item with a vote
    assert {r.annotation_id for r in c.found(df, book(spark)).collect()} == {"1", "4"}
    assert got["1"].primary_label == "repetition" and got["1"].n_annotators == 3
    assert round(got["4"].agreement, 3) == 0.667
    assert c.found(df.limit(0), book(spark)).count() == 0
    assert c.found(df, book(spark, [])).count() == 0


def test_many_annotators_take_the_other_join(spark, monkeypatch):
    rows = [(str(i), f"w{j}", LABELS[i % 5] if j else "other", 1, 1) for i in range(20) for j in range(4)]
    a = {tuple(r) for r in c.found(frame(spark, rows), book(spark)).collect()}
    who = {r.annotator: r.reliability for r in c.annotators(frame(spark, rows), book(spark)).collect()}
    items = c.votes(frame(spark, rows), LABELS)
    monkeypatch.setattr(c, "MOST_PARAMETERS", 10)
    assert {tuple(r) for r in c.found(frame(spark, rows), book(spark)).collect()} == a
    p, _, converged = c.fit_table(items, len(LABELS))
    assert converged and all(abs(r.theta - who[r.annotator]) < 1e-3 for r in p.collect())


def test_convergence_is_reported(spark):
    rows = [(str(i), f"w{j}", LABELS[(i * j) % 5], 1, 1) for i in range(30) for j in range(4)]
    assert all(r.converged for r in c.annotators(frame(spark, rows), book(spark)).collect())
    items = c.votes(frame(spark, rows), LABELS).groupBy("annotation_id").agg(F.collect_list(F.lit(0)).alias("who"), F.collect_list("label").alias("label"))
    assert not c.fit(items, ["all"], len(LABELS), iterations=1).converged


def test_many_votes_do_not_overflow(spark):
    rows = [("1", f"w{j}", "other" if j % 3 else "repetition", 1, 1) for j in range(900)]
    r = c.consensus(frame(spark, rows), book(spark)).first()
    assert r.primary_label == "other" and r.n_annotators == 900 and 0 < r.posterior <= 1
