import random

from helpers import ODD, frame, prose

from quarry.llm import license_scan as ls


def brute(rows, templates=ls.TEMPLATES):
    """Every (row, license) whose shingles some window of the class's cut holds."""
    out = []
    for i, t in rows:
        words = ls.words_of(t or "")
        for name, text in templates.items():
            own = ls.words_of(text)
            want, size = set(ls.shingles_of(own)), 1 << (len(own) - 1).bit_length()
            best = max((len(want & set(ls.shingles_of(words[a : a + 2 * size]))) / len(want) for a in range(0, len(words), size)), default=0)
            if best >= 0.8:
                out.append((i, name, round(best, 6)))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    return sorted(((r["doc_id"], r["license"], round(r["containment"], 6)) for r in ls.scan_licenses(frame(spark, rows), **more).collect()), key=repr)


def noisy(rng, text, share):
    words = text.split()
    for _ in range(int(share * len(words))):
        words[rng.randrange(len(words))] = "noise"
    return " ".join(words)


def test_matches_brute_force(spark):
    rng = random.Random(10)
    rows = []
    for i in range(120):
        name, text = rng.choice(sorted(ls.TEMPLATES.items()))
        rows.append((i, prose(rng, rng.randint(0, 90)) + "\n" + noisy(rng, text, rng.choice([0, 0, 0.02, 0.05])).upper() + "\n" + prose(rng, rng.randint(0, 90))))
    want = brute(rows)
    assert len(want) > 60 and run(spark, rows) == want


def test_every_copy_lies_whole_in_a_window(spark):
    text = ls.TEMPLATES["isc-grant"]
    rows = [(i, "pad " * i + text) for i in range(0, 140, 7)]
    got = run(spark, rows)
    assert [(i, "isc-grant", 1.0) for i, _ in rows] == sorted(x for x in got if x[1] == "isc-grant")


def test_must_words_cannot_all_be_missing():
    for text in ls.TEMPLATES.values():
        words = ls.words_of(text)
        chosen = ls.must_words(words)
        held = [s for s in ls.shingles_of(words) if chosen & set(s.split(" "))]
        assert len(held) > 0.2 * len(ls.shingles_of(words)) - 1e-9


def test_odd_rows_and_clean_texts(spark):
    line = ls.TEMPLATES["mit-line"]
    rows = ODD + [(1, line), (1, line), (None, line), (2, "license to kill, licensed driver, permission denied"), (3, "released under the mit")]
    assert run(spark, rows) == [(1, "mit-line", 1.0), (1, "mit-line", 1.0), (None, "mit-line", 1.0)]


def test_short_templates_and_empty_table(spark):
    assert run(spark, [(1, "All rights: reserved!"), (2, "all rights"), (3, "x all rights reserved y z")], templates={"rights": "All rights reserved"}) == [(1, "rights", 1.0)]
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark):
    plan = ls.scan_licenses(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_short_lines_inside_long_texts_are_all_found(spark):
    """Each line at every offset to the windows, deep in running text."""
    rng = random.Random(12)
    lines = [ls.TEMPLATES[k] for k in ("mit-line", "cc-by-nc-4.0-line", "apache-2.0-line")]
    rows = [(i, prose(rng, 60 + i % 32) + " " + lines[i // 32 % 3] + " " + prose(rng, 60)) for i in range(960)]
    want = brute(rows)
    assert len(want) >= len(rows) and run(spark, rows) == want


def test_only_windows_that_hold_a_word_sought_are_made(spark):
    """Two windows of a class for each such word, wherever the text goes on; they are all that brute force would cut."""
    must = {8: {"licensed", "released"}, 64: {"license"}}
    rows = [(0, ["pad"] * 5000 + ["licensed"] + ["pad"] * 5000), (1, ["released"]), (2, ["license"] * 200 + ["pad"] * 300), (3, ["pad"] * 100), (4, [])]
    got = spark.createDataFrame(rows, "doc_id long, words array<string>").select("doc_id", ls.F.explode(ls._windows(ls.F.col("words"), must)).alias("w"))
    found = [(r["doc_id"], r["w"]["size"], r["w"]["at"], r["w"]["words"]) for r in got.collect()]
    want = [(i, size, at, w[at : at + 2 * size]) for i, w in rows for size, own in must.items() for at in range(0, len(w), size) if own & set(w[at : at + 2 * size])]
    assert sorted(found) == sorted(want) and len(want) == 2 + 1 + 4


def test_texts_are_lowered_once_and_shingles_hashed_once(spark):
    plan = ls.scan_licenses(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    conditions = [line.strip(" :+-") for line in plan.splitlines() if "Filter" in line.split("(")[0]]
    assert sum(line.count("lower(") for line in conditions) == 1  # as many texts as there are; the rest is made for the few that pass
    assert plan.count("xxhash64(") == 2 + ls.ROUNDS  # shingles of windows and of templates, and each round


def test_count_and_first_of_the_windows_match_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(prose(rng, rng.randint(0, 300)) + " " + rng.choice(sorted(ls.TEMPLATES.values())) for _ in range(3))) for i in range(40)]
    want = []
    for i, t in rows:
        words = ls.words_of(t)
        for name, text in ls.TEMPLATES.items():
            own = ls.words_of(text)
            need, size = set(ls.shingles_of(own)), 1 << (len(own) - 1).bit_length()
            shares = [(len(need & set(ls.shingles_of(words[a : a + 2 * size]))) / len(need), -a) for a in range(0, len(words), size)]
            if held := [s for s in shares if s[0] >= ls.CONTAINMENT]:
                want.append((i, name, -max(held)[1], len(held)))
    got = [(r["doc_id"], r["license"], r["first_word"], r["n_windows"]) for r in ls.scan_licenses(frame(spark, rows)).collect()]
    assert len(want) > 60 and sorted(got) == sorted(want)
