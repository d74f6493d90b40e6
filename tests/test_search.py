"""Filters, dedup, pool, spelling, engine."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import spell
from quarry.functions.encoders import HashingEncoder, PrecomputedEncoder
from quarry.functions.vectors import l2_normalize
from quarry.operators import ann, dedup, filters, knn, present
from quarry.plans import catalog, engine
from quarry.schema import SearchRequest, SearchResponse

NAN = float("nan")
PRODUCTS = "row_id long, asin string, id long, url string, title string, category_name string, price double, stars double, isBestSeller boolean"


@pytest.fixture(scope="module")
def goods(spark):
    rows = [
        (0, None, 0, "u", "Red shoe", "Luggage Sets", NAN, 4.0, True),
        (1, "X", 7, "v", "Blue shoe", "Shoes", None, 3.0, False),
        (2, None, 7, "w", "Adidas cap", "Hats", 15.0, None, None),
        (3, "", 0, "", 'Café "mug"', None, 12.0, 5.0, False),
        (4, "X", 9, "z", "Blue shoe two", "Shoes", 11.0, 4.5, True),
    ]
    return spark.createDataFrame(rows, PRODUCTS)


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


@pytest.mark.parametrize(
    "wanted, found",
    [
        (None, [0, 1, 2, 3, 4]),
        ({}, [0, 1, 2, 3, 4]),
        ({"price_min": 10, "price_max": 12}, [0, 3, 4]),
        ({"price_min": 1}, [0, 2, 3, 4]),
        ({"price_max": 0}, [0, 1]),
        ({"stars_min": 1}, [0, 1, 3, 4]),
        ({"stars_max": 3.5}, [1, 2]),
        ({"category_name": "luggage"}, [0]),
        ({"category_name": ["SHOE", "hat"]}, [1, 2, 4]),
        ({"category_name": []}, []),
        ({"category_name": ""}, [0, 1, 2, 3, 4]),
        ({"category_name": 5}, [0, 1, 2, 3, 4]),
        ({"isBestSeller": True}, [0, 4]),
        ({"isBestSeller": False}, [1, 2, 3]),
        ({"brand": "x", "category": "y", "price_min": None}, [0, 1, 2, 3, 4]),
    ],
)
def test_filters(goods, wanted, found):
    assert ids(filters.apply_filters(goods, wanted)) == found


def test_dedup_keys(goods):
    keys = [r["k"] for r in goods.withColumn("k", dedup.dedup_key(goods)).orderBy("row_id").collect()]
    assert keys == ["s:u", "s:X", "n:7", 's:"Caf\\u00e9 \\"mug\\""', "s:X"]


def test_title_prefix_escapes_beyond_the_basic_plane(spark):
    import json

    titles = ["\U0001f600 smile", "tab\tand\nline", "x" * 100, "\u007f", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    found = [r["k"] for r in rows.select("i", dedup.json_title_prefix(F.col("t")).alias("k")).orderBy("i").collect()]
    assert found[:3] == [json.dumps(t)[:64] for t in titles[:3]] and found[4] == '""'


def test_dedup_keeps_best_rank_and_limit_keeps_one(goods):
    ranked = goods.withColumn("_rank", 10 - F.col("row_id"))
    assert ids(dedup.keep_best(ranked, dedup.dedup_key(goods))) == [0, 2, 3, 4]
    assert ids(dedup.first_k(ranked, 0)) == [4]
    assert ids(dedup.first_k(ranked, -3)) == [4]


def test_pool_is_drawn_before_filters(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 1000], float(i)) for i in range(200)], "row_id long, embedding array<double>, price double")
    hits = knn.search(rows, [0.0, -1.0], knn.candidate_pool(5))
    assert hits.count() == 100 and knn.candidate_pool(1) == 50
    assert engine.ranked_results(rows.drop("embedding").withColumn("id", F.col("row_id") + 1), hits, {"price_min": 150}, 5).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [2.0])], "row_id long, embedding array<double>")
    assert [(r["row_id"], r["_rank"]) for r in knn.search(rows, [1.0], 3).orderBy("_rank").collect()] == [(2, 1), (1, 2), (3, 3)]
    assert [r["row_id"] for r in knn.search(rows, [1.0], 3, "l2").orderBy("_rank").collect()] == [1, 3, 2]


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("block", [2000, 2])
def test_batch_search_equals_single_searches(spark, monkeypatch, metric, block):
    monkeypatch.setattr(knn, "BATCH_QUERIES", block)
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)] + [(999, None)], "row_id long, embedding array<double>").repartition(5)
    queries = [(10, [1.0, 0.0, 0.0]), (11, [0.0, 2.0, 1.0]), (12, [3.0, 1.0, 0.0]), (13, [6.0, 4.0, 1.0]), (14, [0.0, 0.0, 0.0])]
    got = knn.search_batch(rows, spark.createDataFrame(queries, "query_id long, query_vector array<double>"), 4, metric).collect()
    want = [(q, r["row_id"], r["_rank"]) for q, v in queries for r in knn.search(rows.where("embedding IS NOT NULL"), v, 4, metric).collect()]
    assert sorted((r["query_id"], r["row_id"], r["_rank"]) for r in got) == sorted(want)
    assert knn.search_batch(rows, spark.createDataFrame([], "query_id long, query_vector array<double>"), 4, metric).count() == 0


def test_zero_vector_stays(spark):
    got = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(l2_normalize(F.col("v")).alias("u")).collect()
    assert [list(r["u"]) for r in got] == [[0.0, 0.0], [0.6, 0.8]]


VOCAB = ["adidas", "shoe", "shoes", "furniture", "hat", "cat"]


@pytest.fixture(scope="module")
def corrector(spark):
    return spell.SpellCorrector(spark, spell.normalize_vocabulary(spark.createDataFrame([(v,) for v in [*VOCAB, " HAT ", ""]], "token string")))


@pytest.mark.parametrize("word, fixed", [("adibas", "adidas"), ("shoos", "shoes"), ("furntiure", "furniture"), ("SHOES", "shoes"), ("zzz", "zzz"), (" Qq ", "qq"), ("", ""), (None, None), ("xat", "xat")])
def test_correct_word(corrector, word, fixed):
    assert corrector.correct_word(word) == fixed


def test_ties_take_the_least_token(spark):
    vocab = spark.createDataFrame([("abcdx",), ("abcdw",), ("abcd",)], "token string")
    words = spark.createDataFrame([("abcdq",)], "word string")
    assert spell.correct_words(words, vocab.where("token <> 'abcd'")).first()["corrected"] == "abcdw"
    assert spell.correct_words(words, vocab).first()["corrected"] == "abcd"


def test_correct_query(corrector):
    assert corrector.correct_query("adibas  shoos") == "adidas shoes"
    assert corrector.correct_query("") == "" and corrector.correct_query(None) is None
    assert corrector.correct_query("   ") == ""


def test_copies_of_many_words_are_not_broadcast(spark, tmp_path):
    spark.range(3000).selectExpr("concat('supplier#', lpad(id, 9, '0')) AS word").union(spark.createDataFrame([("shoos",), ("adibas",)], "word string")).repartition(1).write.parquet(str(tmp_path / "words"))
    spark.range(9000).selectExpr("CASE WHEN id % 2 = 0 THEN 'shoes' ELSE 'adidas' END AS token", "uuid() AS other").repartition(1).write.parquet(str(tmp_path / "tokens"))
    vocab = spell.normalize_vocabulary(spark.read.parquet(str(tmp_path / "tokens")).selectExpr("CASE WHEN other = '' THEN other ELSE token END AS token"))
    fixed = spell.correct_words(spark.read.parquet(str(tmp_path / "words")), vocab)
    assert "BuildLeft" not in fixed._jdf.queryExecution().executedPlan().toString()  # by the planner's estimate it holds 3000 words, not their copies
    got = {r["word"]: r["corrected"] for r in fixed.collect()}
    assert len(got) == 3002 and got.pop("shoos") == "shoes" and got.pop("adibas") == "adidas"
    assert all(word == corrected for word, corrected in got.items())


def test_empty_vocabulary(spark):
    assert spell.SpellCorrector(spark, spark.createDataFrame([], "token string")).correct_query("Some Words") == "some words"


@pytest.mark.parametrize("a, b", [("adibas", "adidas"), ("", "x"), ("abc", "cba"), ("kitten", "sitting"), ("été", "ete"), ("aaaa", "aa")])
def test_fuzz_ratio(spark, a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = spark.range(1).select(spell.fuzz_ratio(F.lit(a), F.lit(b))).first()[0]
    assert math.isclose(got, 200 * table[-1][-1] / (len(a) + len(b)))


def test_index_kinds(spark):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(100)], "row_id long, embedding array<double>")
    exact = [r["row_id"] for r in ann.build_index(rows, "flat").search([1.0, 0.0], 5).orderBy("_rank").collect()]
    assert [r["row_id"] for r in ann.build_index(rows, "hnsw").search([1.0, 0.0], 5).orderBy("_rank").collect()] == exact
    ivf = ann.build_index(rows, "ivf", nlist=4)
    ivf.probes = 4
    assert [r["row_id"] for r in ivf.search([1.0, 0.0], 5).orderBy("_rank").collect()] == exact
    assert ann.cell_count(100) == 64 and ann.cell_count(10**6) == 1000 and ann.cell_count(10, 3) == 3
    with pytest.raises(ValueError):
        ann.build_index(rows, "tree")


@pytest.fixture(scope="module")
def built(goods):
    return engine.Engine.build(goods, HashingEncoder(32), "flat")


def test_search_corrects_filters_and_ranks(built):
    found = built.search("Blue shoes", 3, {"category_name": "Shoes", "price_min": 1})
    assert found.corrected_query == "blue shoe"
    assert found.corrected_filters == {"category_name": ["shoe"], "price_min": 1}
    assert [r["row_id"] for r in found.results.collect()] == [4]
    assert "_score" not in found.results.columns


def test_handle(built):
    out = engine.handle(built, {"query": "cap", "top_k": 1, "filters": {"price_max": 20}})
    assert out["query"] == "cap" and [r["row_id"] for r in out["results"]] == [2]
    assert out["corrected_filters"]["price_max"] == 20 and out["corrected_filters"]["brand"] is None
    assert engine.handle(built, {"query": "cap"})["corrected_filters"] == {}
    with pytest.raises(ValueError):
        SearchRequest.parse({"top_k": 3})


def test_injected_searcher(spark):
    class Fixed:
        def search(self, query, top_k=5, wanted=None):
            return SearchResponse(spark.createDataFrame([(1, "Mock Product")], "id int, title string"), query)

    assert engine.handle(Fixed(), {"query": "mock"})["results"] == [{"id": 1, "title": "Mock Product"}]
    page = engine.DocumentRetriever(Fixed()).similarity_search("mock")
    assert page == [{"page_content": "Mock Product", "metadata": {"id": 1, "title": "Mock Product"}}]


def test_precomputed_encoder(spark):
    known = spark.createDataFrame([("a", [3.0, 4.0])], "text string, embedding array<double>")
    rows = PrecomputedEncoder(known).encode(spark.createDataFrame([("a",), ("b",)], "t string"), "t").orderBy("t").collect()
    assert [round(x, 5) for x in rows[0]["embedding"]] == [0.6, 0.8] and rows[1]["embedding"] is None


def test_embedding_text(spark):
    rows = spark.createDataFrame([(1, None, "Red Shoes", None, 5), (2, "Caps", None, "Hats & Caps", None), (3, None, None, None, 0)], "row_id int, title string, name string, category_name string, category_id long")
    kinds = spark.createDataFrame([(5, "Men's Shoes")], "category_id long, category_name string")
    got = [r["text"] for r in present.embedding_text(rows, "text", kinds).orderBy("row_id").collect()]
    assert got == ["red shoe | man s shoe", "cap | hat cap", ""]


def test_form_helpers():
    assert filters.parse_multi(" ") is None and filters.parse_multi(",") is None
    assert filters.parse_multi("a") == "a" and filters.parse_multi("a, b,") == ["a", "b"]
    form = filters.form_filters("a,b", price_max=9, best_only=True)
    assert form == {"category_name": ["a", "b"], "price_min": None, "price_max": 9, "stars_min": None, "stars_max": None, "isBestSeller": True}
    assert present.filter_summary({"category_name": ["x"], "price_min": 1, "price_max": 5, "isBestSeller": True}) == "Category → ['x'] | Price → 1 to 5 | Best Seller only"
    assert present.filter_summary({}) == ""


@pytest.mark.parametrize("kind", ["flat", "hnsw", "ivf"])
def test_stored_engine_answers_as_built_without_normalizing(spark, goods, tmp_path, kind):
    root = str(tmp_path / kind)
    engine.build_artifacts(spark, goods, root, HashingEncoder(32), kind, 2, links=7)
    loaded = engine.Engine.load(spark, root)
    assert loaded.index.settings()["kind"] == kind
    assert kind != "hnsw" or (loaded.index.links, loaded.index.metric) == (7, "l2")
    found = loaded.search("Blue shoes", 3, {"category_name": "Shoes", "price_min": 1})
    assert found.corrected_query == "blue shoe" and [r["row_id"] for r in found.results.collect()] == [4]
    for plan in (found.results, loaded.corrector.vocab):
        said = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in said and "PythonUDF" not in said and "md5" not in said
    if kind == "ivf":
        again = engine.Engine.load(spark, root).index
        assert (again.centroids == loaded.index.centroids).all() and len(again.centroids) == 2


def test_batch_search_of_an_inverted_file_equals_single_searches(spark):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(200)], "row_id long, embedding array<double>")
    index = ann.build_ivf(rows, nlist=6, probes=2)
    queries = [(7, [1.0, 0.0]), (8, [0.0, -1.0]), (9, [0.6, 0.8])]
    got = sorted((r["query_id"], r["_rank"], r["row_id"]) for r in index.search_batch(queries, 4).collect())
    assert got == sorted((q, r["_rank"], r["row_id"]) for q, v in queries for r in index.search(v, 4).collect())
    with pytest.raises(ValueError):
        index.search_batch([(i, [0.0, 0.0]) for i in range(knn.BATCH_QUERIES + 1)], 1)


def test_an_inverted_file_searches_more_queries_than_a_batch_holds(spark, monkeypatch):
    monkeypatch.setattr(knn, "BATCH_QUERIES", 7)
    rows = spark.createDataFrame([(i, [math.cos(i % 150), math.sin(i % 150)]) for i in range(200)], "row_id long, embedding array<double>").repartition(3)
    index = ann.build_ivf(rows, nlist=6, probes=2)
    queries = [(i, [math.cos(i / 3), math.sin(i / 3)]) for i in range(20)]
    asked = spark.createDataFrame([*queries, (99, None)], "query_id long, query_vector array<double>")
    got = sorted((r["query_id"], r["_rank"], r["row_id"]) for r in index.search_many(asked, 5).collect())
    want = [(r["query_id"], r["_rank"], r["row_id"]) for k in range(0, 20, 7) for r in index.search_batch(queries[k : k + 7], 5).collect()]
    assert got == sorted(want) and len(got) == 100
    assert index.search_many(asked.where("query_id = 99"), 5).count() == 0


def test_recall_of_an_inverted_file_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(knn, "BATCH_QUERIES", 4)
    assert tuple(catalog.kmeans_ivf_recall(spark, "/root/testdata/sf0.001").first()) == (10, 100, True)
