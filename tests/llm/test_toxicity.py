"""Toxicity against held-out labels, and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import TESTDATA

from pulseplan.llm import registry, toxicity

DOCS = "doc_id long, text string, lang string, toxic int, score double, share double"
LABELS = "doc_id long, quality int, toxic int, text string"


def area(labels, scores):
    """The chance that a toxic text scores above a clean one."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for s in np.unique(scores):
        ranks[scores == s] = ranks[scores == s].mean()
    n1 = labels.sum()
    return (ranks[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(spark, sf):
    """Labels, scores and predictions of the held-out rows."""
    sf_dir = str(TESTDATA / sf)
    got = registry.op6_toxicity(spark, sf_dir)
    labels = registry.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    return (np.array([r[c] for r in rows]) for c in ("toxic", "score", "predicted"))


def test_held_out_labels(spark):
    y, s, p = labelled(spark, "sf0.1")
    print("area", area(y, s), "precision", y[p == 1].mean(), "recall", p[y == 1].mean())
    assert area(y, s) > 0.93 and y[p == 1].mean() > 0.85 and p[y == 1].mean() > 0.75


def test_a_word_put_in_front_changes_nothing(spark):
    """All passages are scored, so a text is not cut anew."""
    sf_dir = str(TESTDATA / "sf0.1")
    docs, labels = (registry.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    texts = [r.text or "" for r in docs.join(labels.filter("toxic = 1"), "doc_id").select("text").collect()]
    scorer = toxicity.Scorer(model)
    plain, moved = (scorer.score(pa.array(t, pa.large_string())) >= 0.3 for t in (texts, ["the " + t for t in texts]))
    assert (plain != moved).mean() <= 0.01


def planted(n=400):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abehnrst"), 5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choice(words, 60).tolist()
        if i % 4 == 0:
            text[int(rng.integers(60))] = ["grumblox", "zwackel"][i % 8 // 4]
        docs.append((i, " ".join(text)))
        labels.append((i, 0, int(i % 4 == 0), None))
    return docs, labels


def scores(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "en", 9, 0.5, 0.5) for d in docs], DOCS)
    got = toxicity.toxicity(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == held_out(r.doc_id)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    return got


def test_misspellings_share_subwords(spark):
    docs, labels = planted()
    plain = docs[1][1].split()
    odd = [(1000, " ".join([*plain[:30], "Grumbloox", *plain[30:]])), (1001, " ".join([*plain[:30], "zwackkel!", *plain[30:]])), (1002, " ".join(plain))]
    by_id = {r.doc_id: r.score for r in scores(spark, docs + odd, labels)}
    assert by_id[1000] > 0.3 and by_id[1001] > 0.3 and by_id[1002] < 0.3


def test_odd_rows(spark):
    docs, labels = planted(200)
    docs += [(None, "grumblox"), (500, None), (501, ""), (502, " \n\t"), (3, docs[3][1]), (503, "x" * 100_000), (504, "é ß 日本 😀")]
    labels += [(None, 0, 1, None), (700, 0, 1, None), (0, 0, 1, None), (5, 0, None, None), (6, 0, 7, None)]
    got = scores(spark, docs, labels)
    empty = {r.score for r in got if r.doc_id in (500, 501, 502)}
    assert len(empty) == 1


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_labels_of_one_class(spark, toxic):
    docs, labels = planted(40)
    got = scores(spark, docs, [(i, 0, toxic, None) for i, *_ in labels])
    assert {round(r.score, 6) for r in got} == {1.0 if toxic else 0.0}


def test_nothing(spark):
    docs, labels = planted(8)
    assert scores(spark, [], labels) == []
    assert scores(spark, [], []) == []
    assert len(scores(spark, docs, [])) == 8


def test_scores_do_not_depend_on_the_batch():
    model = toxicity.train(["aa bb cc", "dd ee ff gg", "aa dd", "ee xx"], [0, 1, 0, 1], 0.5)
    texts = ["aa bb dd ee ff", "", "gg", "cc " * 50, "zz yy ee"]
    whole = toxicity.Scorer(model).score(pa.array(texts, pa.large_string()))
    each = [toxicity.Scorer(model).score(pa.array([t], pa.large_string()))[0] for t in texts]
    assert np.allclose(whole, each)


def test_rows_that_train(spark):
    docs, labels = planted(40)
    frame = spark.createDataFrame([(*d, "en", 9, 0.5, 0.5) for d in docs], DOCS)
    rows = toxicity.training_rows(frame, spark.createDataFrame(labels, LABELS), ~toxicity.held_out()).collect()
    assert sorted(r.doc_id for r in rows) == [i for i in range(40) if not held_out(i)]
