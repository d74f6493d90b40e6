import random
from collections import defaultdict

from helpers import LOW, ODD, WHITE, frame, prose, untouched

from quarry.llm import line_dedup


def brute(rows, least=20, docs=3):
    at = defaultdict(set)
    smallest = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(WHITE).translate(LOW)
            if len(key) >= least:
                at[key].add(smallest(i))
    out = []
    for i, t in rows:
        keep = [x for x in (t or "").split("\n") if len(at.get(key := x.strip(WHITE).translate(LOW), ())) < docs or smallest(i) == max(at[key])]
        out.append((i, "\n".join(keep)))
    return sorted(out, key=repr)


def run(spark, rows):
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert got.columns == frame(spark, []).columns
    got = got.collect()
    assert untouched(got)
    return sorted(((r["doc_id"], r["text"]) for r in got), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(rng, 6) for _ in range(15)] + ["  THE SAME LONG LINE OF WORDS\t", "the same long line of words", "é" * 20, "É" * 20, "short line", "x" * 19, "x" * 20]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 140)))) for i in range(60)]
    rows += [(100 + i, "a line that a third of all documents hold\n" + prose(rng, 4)) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    line = "a line of more than twenty letters"
    rows = ODD + [(None, line), (1, line), (2, line + "\n" + line), (2, line), (3, "\r" + line + " ")]
    assert run(spark, rows) == brute(rows)


def test_two_documents_are_not_enough(spark):
    rows = [(1, "x" * 30), (1, "x" * 30), (2, "x" * 30)]
    assert run(spark, rows) == brute(rows) == [(1, "x" * 30), (1, "x" * 30), (2, "x" * 30)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_bitmaps_reach_far_lines(spark):
    rows = [(i, "\n" * (64 * i) + "the very same line of words") for i in range(5)]
    assert run(spark, rows) == brute(rows)


def test_no_python_runs(spark):
    plan = line_dedup.dedup_lines(frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_bitmaps_leave_empty_words_out(spark):
    rows = [(i, "\n" * 64_000 + "the very same line of words") for i in range(4)]
    found = line_dedup.drop_bitmaps(frame(spark, rows)).collect()
    assert [[tuple(x) for x in r["dropped"]] for r in found] == [[(1000, 1)]] * 3
