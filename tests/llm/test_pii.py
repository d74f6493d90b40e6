import random
import re

import pytest
from helpers import ODD, frame, prose
from pyspark.sql import functions as F

from quarry.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for k, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


SECRET = pii.KINDS.index("secret")
PIECES = ["a@b.c", "_d@e.f", "%x+y@h-i.j.k", "1.2.3.4", "256.1.1.1", "001.02.3.004", ".5.6.7.8", "4337166598464399", "4242 4242 4242 4242", "4242-4242-4242-4242", "+1 (988) 555-2485", "+44-20", "+", "@", "..", "é", "\U0001f600", " ", "\n", "12345678901234567890", "--", "1.1.1.1.1.1", "a", "0"]


def run(spark, rows):
    return pii.find_spans(frame(spark, rows)).collect()


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))) for i in range(1500)] + ODD
    texts = dict(rows)
    got = run(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert [tuple(s) for s in r["base"]] == base(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_very_long_runs_end(spark):
    rows = [(1, "a" * 300_000 + "@"), (2, "1" * 200_000), (3, "+1" + "-" * 100_000), (4, "1 " * 50_000), (5, "a.b-" * 50_000 + "@x.y")]
    got = {r["doc_id"]: r for r in run(spark, rows)}
    assert [tuple(s) for s in got[5]["base"]] == [(0, 0, 200_004)]


@pytest.fixture(scope="module")
def secrets():
    rng = random.Random(9)
    rows, places = [], {}
    for i in range(200):
        a = prose(rng, 12) + " "
        value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40])))
        kind = i % 4
        if kind == 0:
            text = f'{a}token = "{value}" {prose(rng, 5)}'
        elif kind == 1:
            text = f"{a}password={value} {prose(rng, 5)}"
        else:
            text = f"{a}{prose(rng, 3)} model-number-12x and section12b of chapter3 2024edition"
        rows.append((i, text))
        places[i] = [(text.index(value), text.index(value) + len(value))] if kind < 2 else []
    return rows, places


def test_secrets_are_added_and_clean_texts_left_alone(spark, secrets):
    rows, places = secrets
    for r in run(spark, rows):
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == SECRET] == places[r["doc_id"]]
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_em_finds_the_labelers_that_agree():
    patterns = {0b1111: 50.0, 0b1110: 10.0, 0b0111: 10.0, 0b0000: 200.0, 0b1000: 40.0, 0b0001: 5.0}
    share, rates = pii.estimate(patterns)
    assert share[0b1111] > 0.9 > 0.1 > share[0b0000] and share[0b1000] < 0.5
    assert all(a > b for a, b in rates)


def test_added_spans_never_overlap_base_spans(spark):
    rows = [(i, f"password=abcdef123456@mail{i}.example.com token=abcdef0123456789abcdef") for i in range(20)]
    for r in run(spark, rows):
        spans = sorted((s["start"], s["end"]) for s in r["spans"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and len(r["base"]) == 1


def test_span_text_and_mask(spark):
    docs = frame(spark, [(1, "é a@b.c and 1.2.3.4"), (2, None), (3, "clean")])
    found = pii.find_spans(docs)
    texts = {r["doc_id"]: r["t"] for r in found.select("doc_id", pii.span_text(F.col("base")).alias("t")).collect()}
    assert texts == {1: "email:2:7,ip:12:19", 2: "", 3: ""}
    assert {r["doc_id"]: r["text"] for r in pii.mask(docs, found).collect()} == {1: "é * and *", 2: "", 3: "clean"}


def test_empty_table_and_no_python_in_the_plan(spark):
    assert run(spark, []) == []
    plan = pii.scan(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_many_matches_end(spark):
    """Places are summed up in blocks: a hundred thousand matches take seconds."""
    n = 100_000
    rows = [(1, "1.2.3.4 " * n), (2, "a@b.c 5.6.7.8 token=abc123def456ghi7 " * 3000)]
    got = {r["doc_id"]: r for r in run(spark, rows)}
    assert [tuple(s) for s in got[1]["base"]] == [(8 * i, 1, 8 * i + 7) for i in range(n)]
    assert [tuple(s) for s in got[2]["base"]] == base(rows[1][1])


def iban(country, rest):
    digits = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{rest}"


@pytest.fixture(scope="module")
def planted():
    """Texts with one added span each, its kind and place, and texts with lookalikes only."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, want = [], {}
    for i in range(400):
        a, b = prose(rng, 10), prose(rng, 6)
        if i % 8 == 0:
            kind, value, lead = "secret", "".join(rng.choice("0123456789abcdef") for _ in range(40)), "token = "
        elif i % 8 == 1:
            kind, value, lead = "secret", rng.choice(["hunter", "letmein", "correcthorse"]) + str(rng.randint(1, 9)), "password: "
        elif i % 8 == 2:
            kind, value, lead = "secret", "".join(rng.choice(letters) for _ in range(39)) + "=", "api_key="
        elif i % 8 == 3:
            kind, value, lead = "iban", iban("DE", "".join(rng.choice("0123456789") for _ in range(18))), "IBAN "
        elif i % 8 == 4:
            kind, value, lead = "name", rng.choice(pii.GIVEN_NAMES) + " " + prose(rng, 1).capitalize() + "son", "my name is "
        else:
            rows.append((i, f"{a} model 12x, section12b of chapter3, AB12 CDEF GHIJ and New Order. {b}"))
            continue
        rows.append((i, f"{a} {lead}{value} {b}"))
        want[i] = (kind, rows[-1][1].index(value), rows[-1][1].index(value) + len(value))
    return rows, want


def test_recall_and_precision_of_added_spans(spark, planted):
    rows, want = planted
    got = {r["doc_id"]: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"] if s["kind"] >= len(pii.BASE)] for r in run(spark, rows)}
    for kind in pii.ADDED:
        own = {i: w for i, w in want.items() if w[0] == kind}
        hits = sum(w in got[i] for i, w in own.items())
        said = sum(s[0] == kind for spans in got.values() for s in spans)
        assert hits / len(own) >= 0.95, (kind, hits, len(own))
        assert hits / said >= 0.95, (kind, hits, said)


def test_account_numbers_are_checked(spark):
    good, bad = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"
    rows = [(1, good), (2, bad)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select(pii._mod97(F.col("text")).alias("r")).collect()
    assert [r["r"] == 1 for r in got] == [True, False]


def test_spans_that_overlap_are_told_over_many_blocks(spark):
    of = [(10 * i, 0, 10 * i + 4) for i in range(500)]
    spans = [(x, 5, x + 2) for x in range(0, 5200, 3)]
    df = spark.createDataFrame([(spans, of)], f"s array<{pii.SPAN}>, o array<{pii.SPAN}>")
    got = [tuple(x) for x in df.select(pii._free(F.col("s"), F.col("o"), pii.SPAN).alias("x")).first()["x"]]
    assert got == [s for s in spans if not any(s[0] < o[2] and o[0] < s[2] for o in of)]
