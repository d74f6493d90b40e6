"""run() against the same stages by brute force on a small corpus with known toxic rows, copies and leaks."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import prose
from test_byte_bpe import ORACLE
from test_decontaminate import nearest, split
from test_line_dedup import brute as brute_lines
from test_simhash import slow_print, union
from test_toxicity import BAD

import __spark_entry__
import corpus_pipeline
from quarry.llm.decontaminate import edits_allowed

assert tiktoken and public_tokenizers


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, root = random.Random(21), tmp_path_factory.mktemp("pipeline")
    shared = [prose(rng, 8) for _ in range(3)]
    items = [(i, prose(rng, rng.randint(12, 30))) for i in range(12)]
    docs, labels = [], []
    for i in range(500):
        lines = [prose(rng, rng.randint(8, 30)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 1:
            lines.insert(0, rng.choice(shared))
        if i % 6 == 0:
            words = lines[-1].split()
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
            lines[-1] = " ".join(words)
        if i % 25 == 3:
            lines.append(prose(rng, 3) + " " + rng.choice(items)[1] + " " + prose(rng, 3))
        docs.append((i, "\n".join(lines)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(1000 + k, docs[7 * k + 1][1]) for k in range(20)]  # copies
    docs += [(2000, None), (2001, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs, items


def brute(docs, items):
    docs = [(i, t) for i, t in docs if not any(w in (t or "") for w in BAD)]
    docs = brute_lines(docs)
    prints = {t: slow_print(t) for _, t in docs}
    comp = union(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for i, t in docs:
        low[comp[prints[t]]] = min(i, low.get(comp[prints[t]], i))
    docs = [(i, t) for i, t in docs if low[comp[prints[t]]] == i]
    leaks = lambda t: any(nearest(split(u), split(t)) <= edits_allowed(len(split(u))) for _, u in items)
    out = []
    for i, t in docs:
        if not leaks(t):
            ids = ORACLE.encode_ordinary(t)
            out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_run_matches_brute_force(spark, folder):
    root, docs, items = folder
    assert sorted(map(tuple, corpus_pipeline.run(spark, root).collect())) == brute(docs, items)


def test_stages_keep_the_columns_of_documents(spark, folder):
    root, _, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()
    none = docs.limit(0)
    assert all(stage(spark, none, root).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_registered(spark):
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names
