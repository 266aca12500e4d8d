import datetime as dt

import numpy as np
import pytest

from marginalia.llm import consensus as cs

LABELS = ("yes", "no", "unsure")
T0 = dt.datetime(2025, 1, 1)


def run(spark, rows, schema="run string, judge string, verdict string, at timestamp"):
    df = spark.createDataFrame(rows, schema)
    return cs.consensus(df, item=["run"], annotator="judge", label="verdict", labels=LABELS, at="at")


def test_reliable_minority_beats_spammers(spark):
    rng = np.random.default_rng(0)
    rows, truth = [], {}
    for i in range(400):
        t = truth[f"i{i}"] = LABELS[rng.choice(3, p=[0.5, 0.4, 0.1])]
        for j in range(3):
            said = t if rng.random() < 0.9 else LABELS[rng.integers(3)]
            rows.append((f"i{i}", f"good{j}", said, T0))
        for j in range(4):
            rows.append((f"i{i}", f"spam{j}", "yes" if rng.random() < 0.85 else "no", T0))
    items, judges = run(spark, rows)
    right = np.mean([r.consensus == truth[r.run] for r in items.collect()])
    majority = np.mean([t == "yes" for t in truth.values()])
    assert right > 0.93 > majority
    reliability = {r.annotator: r.reliability for r in judges.collect()}
    assert min(v for k, v in reliability.items() if k.startswith("good")) > max(v for k, v in reliability.items() if k.startswith("spam")) + 0.3


def test_expectation_equals_brute_force():
    model = cs.Model(["a", "b"], LABELS)
    model.competence = np.array([0.8, 0.3])
    model.guess = np.array([[0.2, 0.5, 0.3], [0.6, 0.3, 0.1]])
    model.prior = np.array([0.5, 0.3, 0.2])
    post, truthful, _ = model.expect(np.array([0, 4, 1]), np.array([2, 1]))
    like = lambda j, said, t: model.competence[j] * (said == t) + (1 - model.competence[j]) * model.guess[j, said]
    first = np.array([model.prior[t] * like(0, 0, t) * like(1, 1, t) for t in range(3)])
    assert np.allclose(post[0], first / first.sum())
    assert np.isclose(truthful[0], post[0, 0] * 0.8 / like(0, 0, 0))


def test_latest_usable_label_counts_and_spelling_does_not(spark):
    later = T0 + dt.timedelta(days=1)
    rows = [("a", "j1", " YES. ", T0), ("a", "j1", "no", later), ("a", "j1", "", later + dt.timedelta(days=1)), ("a", "j2", "No", T0), ("a", "j2", "No", T0), ("b", "j1", None, T0), ("c", None, "unsure", None), (None, "j2", "yes\n", T0)]
    items, judges = run(spark, rows)
    got = {r.run: (r.consensus, r.n_votes, r.agreement) for r in items.collect()}
    assert got["a"] == ("no", 2, 1.0) and "b" not in got and got["c"][1] == 1 and got["c"][2] is None and None in got
    assert {r.annotator for r in judges.collect()} == {"j1", "j2", ""}


def test_empty_and_clashing_columns(spark):
    items, judges = run(spark, [])
    assert items.collect() == [] and judges.collect() == []
    df = spark.createDataFrame([("a", "j", "yes", T0, 1, "x")], "run string, judge string, verdict string, at timestamp, codes int, who string")
    items, _ = cs.consensus(df, item=["run"], annotator="judge", label="verdict", labels=LABELS, at="at")
    assert [r.consensus for r in items.collect()] == ["yes"]


def test_a_fit_cut_short_says_so(spark):
    rows = [([0, 3], 5), ([1, 3], 2), ([0, 4], 9), ([1, 4], 4)]
    patterns = spark.createDataFrame(rows, "codes array<int>, n long")
    with pytest.warns(UserWarning):
        assert not cs.fit(patterns, ["a", "b"], ("x", "y", "z"), rounds=1).converged
    assert cs.fit(patterns, ["a", "b"], ("x", "y", "z"), rounds=400).converged
