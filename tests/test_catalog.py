"""Sources, sinks, preparation, artifacts, command line, shards, entry module, plan shapes."""

import json
import math
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry.functions import sql
from quarry.functions.encoders import HashingEncoder
from quarry.operators import ann, etl, filters, knn
from quarry.operators.shard import shard_rows
from quarry.plans import cli, engine
from quarry.sources import artifacts, readers, sinks, storage
from quarry.sources.config import Config, get_logger

CSV = 'asin,title,price,stars,category_id,isBestSeller,extra\nA1,"Big ""red"" bag,\nlarge",9.5,4.1,1,True,x\n,Cap,,,2,False,y\n'


@pytest.fixture
def files(tmp_path):
    (tmp_path / "p.csv").write_text(CSV)
    (tmp_path / "c.csv").write_text("id,category_name\n1,Backpacks\n2,Toys\n2,Toys again\n")
    (tmp_path / "p.jsonl").write_text('{"id": "1", "title": "Étui"}\n\n{"id": "2", "title": "Cap", "price": 3}\n')
    (tmp_path / "p.json").write_text(json.dumps([{"id": "1", "title": "A"}]))
    (tmp_path / "w.json").write_text(json.dumps({"products": [{"id": "1", "title": "A"}, {"id": "2"}]}))
    (tmp_path / "bad.json").write_text(json.dumps({"rows": []}))
    (tmp_path / "e.json").write_text(json.dumps({"ids": ["a", "b"], "embeddings": [[1.0], [2.0]]}))
    return tmp_path


def test_csv_keeps_blank_prices_apart_from_absent_ones(spark, files):
    rows = readers.load_products(spark, str(files / "p.csv")).orderBy(F.desc_nulls_last("asin")).collect()
    assert rows[0]["title"] == 'Big "red" bag,\nlarge' and rows[0]["isBestSeller"] is True
    assert rows[1]["asin"] is None and math.isnan(rows[1]["price"])
    frame = readers.load_products(spark, str(files / "p.csv"))
    assert filters.apply_filters(frame, {"price_min": 1}).count() == 2
    assert filters.apply_filters(readers.load_products(spark, str(files / "p.jsonl")), {"price_min": 1}).count() == 1


def test_json_sources(spark, files):
    assert [r["title"] for r in readers.load_products(spark, str(files / "p.jsonl")).orderBy("id").collect()] == ["Étui", "Cap"]
    assert readers.load_products(spark, str(files / "p.json")).count() == 1
    assert readers.load_products(spark, str(files / "w.json")).count() == 2
    with pytest.raises(ValueError):
        readers.load_products(spark, str(files / "bad.json"))
    assert readers.explode_embedding_json(spark, str(files / "e.json")).count() == 2


def test_source_errors(spark, files):
    with pytest.raises(FileNotFoundError):
        readers.load_products(spark, str(files / "none.csv"))
    (files / "p.pkl").write_bytes(b"")
    with pytest.raises(ValueError):
        readers.load_products(spark, str(files / "p.pkl"))
    assert readers.load_sample_catalog(spark, str(files), "none.json").count() == 0
    assert readers.load_sample_catalog(spark, str(files), "p.json").count() == 1
    assert readers.load_fashion_catalog(spark, str(files), "none.csv").count() == 0
    assert readers.load_fashion_catalog(spark, str(files), "p.csv").count() == 2


def test_prepare_catalog(spark, files):
    goods, kinds = readers.load_raw_products(spark, str(files / "p.csv")), readers.load_categories(spark, str(files / "c.csv"))
    kept, seen = etl.prepare_catalog(goods, kinds)
    assert [r["category_name"] for r in kept.collect()] == ["Backpacks"]
    assert [seen[k].get["rows"] for k in ("products", "merged", "kept")] == [2, 3, 1]
    sinks.write_csv(kept, str(files / "out.csv"))
    assert readers.load_fashion_catalog(spark, str(files), "out.csv").first()["title"] == 'Big "red" bag,\nlarge'
    assert len(etl.FASHION_CATEGORIES) == 35


def test_null_keys_meet_and_names_get_suffixes(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "id int, category_id int")
    b = spark.createDataFrame([(None, "none"), (6, "six")], "id int, category_name string")
    rows = {r["id_x"]: r["category_name"] for r in etl.left_join_categories(a, b).collect()}
    assert rows == {1: "none", 2: None}


def test_value_counts(spark):
    rows = etl.value_counts(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string"), "c").collect()
    assert [(r["c"], r["count"]) for r in rows] == [("b", 2), ("a", 1)]


@pytest.mark.parametrize("n, k", [(10, 3), (3, 7), (0, 2), (8, 8), (2000, 7)])
def test_shards_are_contiguous_and_even(spark, n, k):
    rows = shard_rows(spark.range(n).repartition(3), k, "id").orderBy("id").collect()
    short, longer = divmod(n, k)
    assert [r["shard"] for r in rows] == [s for s in range(k) for _ in range(short + (s < longer))]


def test_no_shards(spark):
    with pytest.raises(ZeroDivisionError):
        shard_rows(spark.range(1), 0, "id")


@pytest.mark.parametrize("kind", ["flat", "ivf"])
def test_command_line_builds_what_the_engine_loads(spark, files, kind):
    root = str(files / f"art-{kind}")
    cli.main(["--products", str(files / "p.csv"), "--output", root, "--index-type", kind, "--nlist", "2", "--model-name", "hashing-16"], spark)
    found = engine.Engine.load(spark, root).search("big bag", 1)
    assert found.results.first()["asin"] == "A1"
    cli.main(["--output", root, "--index-type", kind, "--nlist", "2", "--rebuild-index-only"], spark)
    assert any(p.name.startswith("index.bak.") for p in (files / f"art-{kind}").iterdir())
    assert engine.Engine.load(spark, root).search("cap", 1).results.count() == 1


def test_artifact_errors(spark, files):
    with pytest.raises(FileNotFoundError):
        engine.build_artifacts(spark, None, str(files / "none"), rebuild_index_only=True)
    with pytest.raises(FileNotFoundError):
        artifacts.load_artifacts(spark, str(files / "none"))
    products = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, title string")
    one = spark.createDataFrame([(0, [1.0])], "row_id long, embedding array<float>")
    with pytest.raises(ValueError):
        artifacts.check_alignment(products, one)
    with pytest.raises(ValueError):
        artifacts.check_alignment(products, one.union(spark.createDataFrame([(9, [1.0])], one.schema)))


def test_legacy_embeddings(spark, files):
    rows = spark.createDataFrame([("1", "Red cap", None), ("2", "Bag", "Acme")], "id string, title string, brand string")
    assert engine.legacy_embeddings(rows, str(files / "legacy"), HashingEncoder(8))
    assert readers.explode_embedding_json(spark, str(files / "legacy")).count() == 2
    assert not engine.legacy_embeddings(rows.limit(0), str(files / "nothing"))
    assert not (files / "nothing").exists()


def test_legacy_l2_index(spark, files):
    spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 1.0])], "row_id long, embedding array<float>").write.parquet(str(files / "v"))
    assert engine.legacy_l2_index(spark, str(files / "v"), str(files / "l2")) == 2
    hits = ann.FlatIndex(spark.read.parquet(str(files / "l2")), "l2").search([0.0, 0.0], 2).orderBy("_rank").collect()
    assert [(r["row_id"], r["_score"]) for r in hits] == [(1, -1.0), (0, -25.0)]
    with pytest.raises(FileNotFoundError):
        engine.legacy_l2_index(spark, str(files / "none"), str(files / "l2"))


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("""SELECT vector_dot(array(1D, 2D), array(3D, 4D)) AS d, vector_l2_squared(array(1D), array(4D)) AS l,
        vector_normalize(array(3D, 4D)) AS u, vector_normalize(array(0D)) AS z, vector_norm(array(3D, 4D)) AS n,
        round(fuzz_ratio('furntiure', 'furniture'), 2) AS f, fuzz_ratio('', '') AS e, fuzz_ratio('', 'a') AS o""").first()
    assert (row["d"], row["l"], row["u"], row["z"], row["n"], row["f"], row["e"], row["o"]) == (11.0, 9.0, [0.6, 0.8], [0.0], 5.0, 88.89, 100.0, 0.0)


def test_config_and_logger(monkeypatch):
    monkeypatch.setenv("DATA_DIR", "/x")
    assert Config.from_env().data_dir == "/x"
    assert len(get_logger("quarry.t").handlers) == len(get_logger("quarry.t").handlers) == 1


def test_entry_module(spark):
    assert __spark_entry__.entry(spark).columns == ["row_id", "title", "category_name", "price", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    p = part.select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("title"))
    text = plan(p.where(F.col("price") > 920).select("row_id"))
    assert "PushedFilters: [IsNotNull(p_retailprice), GreaterThan(p_retailprice,920.0)]" in text and "p_name" not in text
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    assert "TakeOrderedAndProject" in plan(knn.search(v, [0.0] * 64, 10).select("row_id"))
    kinds = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("category_name"))
    goods = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").withColumnRenamed("s_nationkey", "category_id")
    assert "BroadcastHashJoin" in plan(etl.keep_categories(etl.left_join_categories(goods, kinds), ["NATION_1"]))


def test_shared_folder_off_local_mode_must_be_named():
    class Conf:
        def get(self, *_):
            return None

    class Found:
        isDefined = staticmethod(lambda: False)

    class Context:
        master = "yarn"
        getConf = staticmethod(Conf)
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Found)}))})

    session = type("Session", (), {"sparkContext": Context, "conf": Conf()})
    with pytest.raises(RuntimeError):
        storage.shared_dir(session)


def test_stored_tables_can_be_discarded(spark):
    kept = storage.materialize(spark.range(5).toDF("x"), "test")
    path = kept._quarry_path
    assert kept.count() == 5 and storage.path_exists(spark, path)
    storage.discard(kept)
    assert not storage.path_exists(spark, path)


def test_entry_lives_without_the_packages_of_the_corpus_operators(tmp_path):
    """With a module missing that only they need, the other queries are still there."""
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e\nassert 'knn_exact_ip' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"})


def test_large_json_objects_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_JSON_ROWS", 3)
    rows = spark.range(4).select(F.col("id"), F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(ValueError):
        sinks.write_embedding_json(rows, str(tmp_path / "x"))
