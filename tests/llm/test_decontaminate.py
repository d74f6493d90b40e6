import random

import numpy as np
import pytest
from helpers import ODD, frame, prose

from quarry.llm import decontaminate as dc


def nearest(item, words):
    """Least edit distance of item to any passage of words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(words, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return min(row)


def split(t):
    return dc.symbols_of(t)


def edited(rng, words, k, pool):
    out = list(words)
    for _ in range(k):
        p, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[p] = rng.choice(pool)
        elif kind < 0.7 and len(out) > 2:
            del out[p]
        else:
            out.insert(p, rng.choice(pool))
    return out


def passage(item, words):
    """(distance, start, end) of the nearest passage by the whole edit table; least distance, then start, then end."""
    row = [(0, j) for j in range(len(words) + 1)]
    for i, a in enumerate(item, 1):
        last, row = row, [(i, 0)]
        for j, b in enumerate(words, 1):
            row.append(min((last[j - 1][0] + (a != b), last[j - 1][1]), (last[j][0] + 1, last[j][1]), (row[-1][0] + 1, row[-1][1])))
    (d, start), end = min((x, j) for j, x in enumerate(row))
    return d, start, end


def test_nearest_passage():
    rng = random.Random(1)
    for _ in range(800):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 8))]
        words = [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        want, most = passage(item, words), len(item) - 1
        assert dc.nearest_passage(item, words, most) == (want if want[0] <= most else None)


def test_symbols():
    assert dc.symbols_of("The cat_2, naïve") == ["the", "cat_2", "naïve"]
    assert dc.symbols_of("猫が好き is ok") == ["猫", "が", "好", "き", "is", "ok"]
    assert dc.symbols_of("abc漢字x") == ["abc", "漢", "字", "x"]
    assert dc.symbols_of(None) == dc.symbols_of("。、 !") == []


@pytest.mark.parametrize("letters", ["的一是不了人我在有他这中大来上国", "あいうえおかきくけこさしすせそ漢字仮名"])
def test_scripts_without_spaces(letters):
    rng = random.Random(7)
    sentence = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, sentence(rng.randint(14, 40))) for i in range(25)]
    index, found, total = dc.Index(items), 0, 0
    for i, t in items * 4:
        copy = edited(rng, list(t), dc.edits_allowed(len(t)), list(letters))
        text = sentence(30) + "".join(copy) + "。" + sentence(20)
        want = {j for j, u in items if nearest(list(u), split(text)) <= dc.edits_allowed(len(u))}
        got = {x[0] for x in index.leaks(text)}
        assert got <= want
        total += len(want)
        found += len(got)
    assert total >= 100 and found / total >= 0.98


def test_very_long_items():
    """Items of thousands of words: found at the bound, in memory that follows their size."""
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(5000))) for i in range(3)]
    index = dc.Index(items)
    for i, kind in enumerate(("insert", "delete", "substitute")):
        copy = kinds_of_edits(rng, split(items[i][1]), 1000, kind)
        text = " ".join(f"w{rng.randrange(9000)}" for _ in range(200)) + " " + " ".join(copy)
        assert [x[0] for x in index.leaks(text)] == [i]
    held = sum(len(p) for of in index.pieces.values() for p in of.values()) + sum(len(k) for k, _ in index.tables.values())
    assert held < 3 * 2000


def test_candidates_come_from_the_embedding(monkeypatch):
    """Without the sampled places nothing is found: no other way leads to verification."""
    items = [(1, "the quick brown fox jumps over the lazy dog today")]
    assert dc.Index(items).leaks(items[0][1])
    monkeypatch.setattr(dc.Embedding, "keys", lambda self, words, starts: np.zeros((len(starts), len(self.walk)), dtype=np.uint64))
    assert dc.Index(items).leaks(items[0][1]) == []


def test_reaches_target_recall_without_false_hits():
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(4, 50))) for i in range(60)]
    index = dc.Index(items)
    found = total = 0
    for _ in range(400):
        i, t = rng.choice(items)
        words = split(t)
        k = rng.randint(0, dc.edits_allowed(len(words)))
        text = " ".join(prose(rng, 60).split() + edited(rng, words, k, split(prose(rng, 30))) + prose(rng, 60).split())
        want = {j for j, u in items if nearest(split(u), split(text)) <= dc.edits_allowed(len(split(u)))}
        got = {x[0]: x for x in index.leaks(text)}
        assert set(got) <= want
        assert all(x[3] == nearest(split(dict(items)[j]), split(text)) for j, x in got.items() if x[3] == 0 or k == 0)
        total += len(want)
        found += len(want & set(got))
    assert found / total >= 0.98


def test_exact_copies_are_always_found(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(1, 30))) for i in range(40)] + [(90, "one"), (91, None), (92, ""), (93, "a b c"), (93, "a b c")]
    docs = [(i, prose(rng, 40) + " " + (items[i % 40][1] or "").upper() + "\n" + prose(rng, 40)) for i in range(80)]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.find_leaks(frame(spark, docs), table).collect()}
    assert all(got[i, i % 40]["distance"] == 0 and got[i, i % 40]["similarity"] == 1.0 for i in range(80))


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_odd_rows_and_item_blocks(spark, block):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "lazy dogs sleep all day long now")], "item_id long, text string")
    rows = ODD + [(1, "The quick, brown fox jumps over!"), (None, "see: lazy dogs sleep all day long now"), (2, "the quick brown"), (3, "quick brown fox jumps over")]
    got = dc.find_leaks(frame(spark, rows), items, block_bytes=block).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in got), key=repr) == [(1, 1, 0), (3, 1, 1), (None, 2, 0)]
    assert next(r for r in got if r["doc_id"] == 1)["start_word"] == 0
    kept = dc.drop_leaks(frame(spark, rows), items, block_bytes=block)
    assert kept.columns == frame(spark, []).columns
    assert kept.count() == len(rows) - 3


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(frame(spark, [(1, "a b c")]), items).count() == 0
    assert dc.drop_leaks(frame(spark, [(1, "a b c")]), items).count() == 1
    assert dc.find_leaks(frame(spark, []), items).count() == 0


def kinds_of_edits(rng, words, k, kind):
    """words with k edits of one kind at k different places."""
    places, out = set(rng.sample(range(len(words)), k)), []
    for p, w in enumerate(words):
        if p in places and kind == "insert":
            out.append(f"new{p}")
        out.append(f"new{p}" if p in places and kind == "substitute" else w)
        if p in places and kind == "delete":
            out.pop()
    return out


@pytest.mark.parametrize("kind", ["insert", "delete", "substitute"])
@pytest.mark.parametrize("size", [5, 15, 30, 59, 65, 150])
def test_copies_at_the_bound_are_found(kind, size):
    rng = random.Random(size)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(size))) for i in range(40)]
    index, found = dc.Index(items), 0
    for i, t in items:
        words = kinds_of_edits(rng, split(t), dc.edits_allowed(size), kind)
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(80)) + " " + " ".join(words) + " " + prose(rng, 80)
        found += i in {x[0] for x in index.leaks(text)}
    assert found / len(items) >= 0.97
