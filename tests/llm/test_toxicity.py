import random
import zlib

import pytest
from helpers import ODD, frame, prose
from pyspark.sql import functions as F

from quarry.llm import toxicity

BAD = ["idiotic", "worthless", "scumbag", "vermin"]


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(900):
        words = prose(rng, rng.randint(20, 60)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return rows, {i: t for i, _, t in labels}, lab


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_brute_force():
    rng = random.Random(7)
    words = {"abcab": 2.0, "bbbbb": 3.0, "abc": 1.0, "cabbage": 4.0}
    stems = {"caa": 5.0}
    own = toxicity.FuzzyLexicon(words, stems, {w for w in words if len(w) >= 5})
    for _ in range(20_000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        exact = max([words.get(w, 0.0), *(x for s, x in stems.items() if w.startswith(s))])
        fuzzy = max([x for t, x in words.items() if len(t) >= 5 and brute_edits(w, t) == 1], default=0.0)
        got = own.match(w)
        assert got[0] == exact
        assert got[1] == fuzzy or (exact and got[1] <= max(fuzzy, words.get(w, 0.0)))


def test_held_out_accuracy(spark, corpus):
    rows, truth, labels = corpus
    got = {r["doc_id"]: r for r in toxicity.score_documents(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    held = [i for i in truth if fold(i) == 2]
    assert all(got[i]["held_out"] == (fold(i) == 2) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.3) for i in truth)
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.98


def test_misspellings_count_and_quotations_are_told_apart(spark, corpus):
    rows, _, labels = corpus
    model = toxicity.fit(frame(spark, rows), labels, toxicity.train_rows(F.col("doc_id")))
    own = toxicity.Scorer(model)
    clean = "the oftion and eren that"
    assert own.score(clean) < 0.3 < own.score(f"{clean} worthles {clean} idiottic")
    assert own.score(f"{clean} worthless") > 0.3
    assert [inside for _, inside in own.windows('they said "worthless" today', own.hits('they said "worthless" today'))] == [True]
    assert own.features('they said "worthless" today')[1] > 0 == own.features("they said worthless today")[1]


def test_only_training_labels_are_learned_from(spark, corpus):
    rows, truth, labels = corpus
    held = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.score_documents(frame(spark, rows), labels)
    b = toxicity.score_documents(frame(spark, rows), held)
    assert sorted((r["doc_id"], r["score"]) for r in a.collect()) == sorted((r["doc_id"], r["score"]) for r in b.collect())


def test_odd_rows(spark, corpus):
    rows, _, labels = corpus
    got = toxicity.score_documents(frame(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD)
    empty = {r["score"] for r in got if r["doc_id"] in (7001, 7002, 7003)}
    assert len(empty) == 1 and empty.pop() < 0.3
    kept = toxicity.keep_clean(frame(spark, rows + ODD), labels)
    assert kept.columns == frame(spark, []).columns
    want = sorted(r["doc_id"] for r in got if r["doc_id"] is not None and not r["predicted"])
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want


def test_no_labels_or_one_class(spark):
    rows = [(i, f"some words {i}") for i in range(20)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_documents(frame(spark, rows), none).collect()} == {0.5}
    clean = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.score_documents(frame(spark, rows), clean).collect()} == {0}
    assert toxicity.score_documents(frame(spark, []), clean).count() == 0
