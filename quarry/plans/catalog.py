"""Registered queries of the catalog engine, over the driver's tables, and the same in DuckDB's SQL.

The product view stands in for a catalog: parts with their name as title, type as category, retail price, size / 10 as
stars and every tenth key a bestseller, joined to the vector of their key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import spell, textnorm
from quarry.functions.encoders import HashingEncoder
from quarry.functions.vectors import cosine, l2_normalize, norm
from quarry.operators import ann, dedup, etl, filters, knn, present
from quarry.operators.shard import shard_rows
from quarry.plans.engine import Engine, build_artifacts, catalog_vocabulary, ranked_results
from quarry.sources import readers, sinks
from quarry.sources.artifacts import corpus_stats
from quarry.sources.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out to all of them; for work that costs far more than the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        key.alias("row_id"), key.alias("id"), F.when(key % 3 == 0, F.concat(F.lit("A"), (key % 50).cast("string"))).alias("asin"),
        F.concat(F.lit("u"), key.cast("string")).alias("url"), F.col("p_name").alias("title"), F.col("p_type").alias("category_name"),
        F.col("p_retailprice").alias("price"), (F.col("p_size") / 10.0).alias("stars"), (key % 10 == 0).alias("isBestSeller"),
    )


PRODUCT_SQL = """
    SELECT p_partkey AS row_id, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'A' || CAST(p_partkey % 50 AS VARCHAR) END AS asin,
        'u' || CAST(p_partkey AS VARCHAR) AS url, p_name AS title, p_type AS category_name, p_retailprice AS price,
        CAST(p_size AS DOUBLE) / 10.0 AS stars, p_partkey % 10 = 0 AS "isBestSeller" FROM part"""
KEY_SQL = """coalesce('s:' || nullif(asin, ''), CASE WHEN id <> 0 THEN 'n:' || CAST(id AS VARCHAR) END, 's:' || nullif(url, ''))"""
DOT_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
L2_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))"


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(vectors(spark, sf_dir).where("row_id = 0").first()["embedding"])


# ---------- nearest neighbours ----------


@query(f"""
    SELECT vec_id AS row_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM (SELECT e.vec_id, {DOT_SQL.format(a="e.embedding", b="q.embedding")} AS score
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    ORDER BY score DESC, row_id LIMIT 10""")
def knn_exact_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.search(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10)
    return found.select("row_id", F.round("_score", 6).alias("score"), F.col("_rank").alias("rank"))


@query(f"""
    SELECT vec_id AS row_id, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank
    FROM (SELECT e.vec_id, {L2_SQL.format(a="e.embedding", b="q.embedding")} AS d
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    ORDER BY d, row_id LIMIT 10""")
def knn_exact_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.search(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, "l2")
    return found.select("row_id", F.round(-F.col("_score"), 6).alias("distance"), F.col("_rank").alias("rank"))


@query(f"""
    SELECT query_id, row_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (
            SELECT q.vec_id AS query_id, e.vec_id AS row_id, {DOT_SQL.format(a="e.embedding", b="q.embedding")} AS score
            FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 3""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    found = knn.search_batch(vectors(spark, sf_dir), own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 3)
    return found.select("query_id", "row_id", F.round("_score", 6).alias("score"), F.col("_rank").alias("rank"))


FLAGSHIP = {"price_min": 905.0, "category_name": "n", "stars_min": 0.5, "brand": "ignored"}


@query(f"""
    WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
    p AS ({PRODUCT_SQL}),
    pool AS (
        SELECT e.vec_id AS row_id, {DOT_SQL.format(a="e.embedding", b="q.embedding")} AS score FROM embeddings e, q
        ORDER BY score DESC, row_id LIMIT 100),
    ranked AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM pool),
    passed AS (
        SELECT p.*, rank, {KEY_SQL} AS k FROM p JOIN ranked USING (row_id)
        WHERE coalesce(price, 0) >= 905 AND contains(lower(category_name), 'n') AND stars >= 0.5),
    best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank) AS n FROM passed)
    SELECT row_id, title, category_name, price, CAST(rank AS INTEGER) AS rank FROM best WHERE n = 1 ORDER BY rank LIMIT 5""")
def search_pool_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ann.FlatIndex(vectors(spark, sf_dir)).search(first_vector(spark, sf_dir), knn.candidate_pool(5))
    found = ranked_results(products(spark, sf_dir), hits, FLAGSHIP, 5, keep_rank=True)
    return found.select("row_id", "title", "category_name", "price", F.col("_rank").alias("rank"))


# ---------- filters ----------


def _filter_query(name: str, wanted: dict, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.apply_filters(products(spark, sf_dir), wanted).select("row_id", "title", "price", "stars")

    run.__name__ = name
    query(f"SELECT row_id, title, price, stars FROM ({PRODUCT_SQL}) WHERE {where}")(run)


_filter_query("filter_price_range", {"price_min": 920, "price_max": 960.5}, "coalesce(price, 0) BETWEEN 920 AND 960.5")
_filter_query("filter_category_substr", {"category_name": "MALL"}, "contains(lower(category_name), 'mall')")
_filter_query("filter_category_anyof", {"category_name": ["Promo", "arge"]}, "contains(lower(category_name), 'promo') OR contains(lower(category_name), 'arge')")
_filter_query("filter_category_none", {"category_name": []}, "false")
_filter_query("filter_stars", {"stars_min": 1.5, "stars_max": 3.0}, "stars BETWEEN 1.5 AND 3.0")
_filter_query("filter_bestseller", {"isBestSeller": True}, '"isBestSeller"')
_filter_query("filter_not_bestseller", {"isBestSeller": False}, 'NOT "isBestSeller"')
_filter_query("filter_unknown_keys", {"brand": "x", "category": "y", "price_max": None}, "true")


@query(f"""
    SELECT row_id, price IS NULL AS missing, isnan(coalesce(price, 0)) AS blank FROM (
        SELECT row_id, CASE WHEN row_id % 4 = 0 THEN CAST('NaN' AS DOUBLE) WHEN row_id % 4 = 1 THEN NULL ELSE price END AS price
        FROM ({PRODUCT_SQL}))
    WHERE NOT (coalesce(price, 0) < 950) AND NOT (coalesce(price, 0) > 980 AND NOT isnan(coalesce(price, 0)))""")
def filter_nan_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    price = F.when(F.col("row_id") % 4 == 0, F.lit(float("nan"))).when(F.col("row_id") % 4 == 1, None).otherwise(F.col("price"))
    found = filters.apply_filters(p.withColumn("price", price), {"price_min": 950, "price_max": 980})
    return found.select("row_id", F.col("price").isNull().alias("missing"), F.isnan(F.coalesce("price", F.lit(0.0))).alias("blank"))


# ---------- catalog preparation ----------

NATIONS = ("NATION_1", "NATION_4", "NATION_7", "NATION_13", "NATION_20")
_IN = ", ".join(f"'{n}'" for n in NATIONS)


def _supplier_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    goods = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("long").alias("category_id"))
    kinds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("category_name"))
    return goods, kinds


@query(f"""
    SELECT s_suppkey AS id_x, s_name AS title, CAST(s_nationkey AS BIGINT) AS category_id, CAST(n_nationkey AS BIGINT) AS id_y, n_name AS category_name
    FROM supplier LEFT JOIN nation ON s_nationkey IS NOT DISTINCT FROM n_nationkey WHERE n_name IN ({_IN})""")
def catalog_left_join_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.keep_categories(etl.left_join_categories(*_supplier_catalog(spark, sf_dir)), NATIONS)


@query("SELECT n_name AS category_name, count(*) AS count FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_name IS NOT NULL GROUP BY ALL")
def category_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").alias("category_id"))
    kinds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("category_name"))
    return etl.value_counts(etl.left_join_categories(goods, kinds), "category_name")


@query("""
    WITH p AS (SELECT s_suppkey AS sid, nullif(s_nationkey, 3) AS category_id FROM supplier),
    c AS (SELECT nullif(n_nationkey, 5) AS id, n_name AS category_name FROM nation)
    SELECT sid, category_id, id, category_name FROM p LEFT JOIN c ON category_id IS NOT DISTINCT FROM id""")
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), F.nullif("s_nationkey", F.lit(3)).alias("category_id"))
    kinds = table(spark, sf_dir, "nation").select(F.nullif("n_nationkey", F.lit(5)).alias("id"), F.col("n_name").alias("category_name"))
    return etl.left_join_categories(goods, kinds)


@query("SELECT count(*) AS n, max(len(embedding)) AS dim FROM embeddings")
def corpus_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats(vectors(spark, sf_dir))


@query(f"""
    WITH p AS (SELECT *, {KEY_SQL} AS k FROM ({PRODUCT_SQL})),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY price DESC, row_id) AS n FROM p)
    SELECT row_id, k AS key FROM r WHERE n = 1""")
def dedup_first_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    ranked = p.withColumn("key", dedup.dedup_key(p)).withColumn("_rank", F.struct(-F.col("price"), "row_id"))
    return dedup.keep_best(ranked, F.col("key")).select("row_id", "key")


@query("""
    WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY pos) - 1 AS INTEGER) AS shard FROM o""")
def shard_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return shard_rows(rows, 7, "o_orderdate", "o_orderkey").select("o_orderkey", "shard")


# ---------- vectors ----------


@query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 3)) AS v FROM embeddings),
    n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v)
    SELECT vec_id, round(norm, 6) AS norm, round(abs(CASE WHEN norm = 0 THEN v[1] ELSE v[1] / norm END), 6) AS first,
        CAST(CASE WHEN norm = 0 THEN 0 ELSE 1 END AS DOUBLE) AS unit FROM n""")
def l2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", raw.alias("v")).withColumn("u", l2_normalize(F.col("v")))
    return rows.select("vec_id", F.round(norm(F.col("v")), 6).alias("norm"), F.round(F.abs(F.col("u")[0]), 6).alias("first"), F.round(norm(F.col("u")), 6).alias("unit"))


@query(f"""
    WITH p AS (
        SELECT {DOT_SQL.format(a="a.embedding", b="b.embedding")} / sqrt({DOT_SQL.format(a="a.embedding", b="a.embedding")})
            / sqrt({DOT_SQL.format(a="b.embedding", b="b.embedding")}) AS cos, CAST(a.label = b.label AS INTEGER) AS label
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT round(avg(pow(cos - label, 2)), 6) AS loss FROM p""")
def pair_cosine_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    pairs = e.join(other, "vec_id").withColumn("pair", (F.col("label") == F.col("other_label")).cast("double"))
    return knn.pair_loss(pairs, cosine(F.col("embedding"), F.col("other")), "pair").select(F.round("loss", 6).alias("loss"))


_CENTROIDS = """
    c AS (SELECT label AS cell, list(m ORDER BY i) AS centroid FROM (
        SELECT label, i, round(avg(x), 6) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
        GROUP BY label, i) GROUP BY label),
    a AS (SELECT e.vec_id, e.embedding, c.cell, row_number() OVER (
            PARTITION BY e.vec_id ORDER BY {dot} DESC, c.cell) AS n FROM embeddings e, c)""".format(dot=DOT_SQL.format(a="e.embedding", b="c.centroid"))


def _label_index(spark: SparkSession, sf_dir: str) -> ann.IvfIndex:
    """An inverted file whose centroids are the mean vectors of the labels."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    rows = each.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m")).collect()  # labels x dimensions
    centroids = np.zeros((max(r["label"] for r in rows) + 1, max(r["i"] for r in rows) + 1))
    for r in rows:
        centroids[r["label"], r["i"]] = r["m"]
    return ann.IvfIndex(ann.assign_cells(vectors(spark, sf_dir), centroids), centroids)


@query(f"WITH {_CENTROIDS} SELECT vec_id AS row_id, CAST(cell AS INTEGER) AS cell FROM a WHERE n = 1")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_index(spark, sf_dir).cells.select("row_id", "cell")


@query(f"""
    WITH {_CENTROIDS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
    probe AS (SELECT c.cell FROM c, q ORDER BY {DOT_SQL.format(a="c.centroid", b="q.embedding")} DESC, c.cell LIMIT 1)
    SELECT a.vec_id AS row_id, round({DOT_SQL.format(a="a.embedding", b="q.embedding")}, 6) AS score
    FROM a, q WHERE n = 1 AND cell = (SELECT cell FROM probe) ORDER BY score DESC, row_id LIMIT 10""")
def ivf_probe1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _label_index(spark, sf_dir).search(first_vector(spark, sf_dir), 10)
    return found.select("row_id", F.round("_score", 6).alias("score"))


#: Cells of the KMeans file and how many of them a search reads: the vectors are nearly uniform on the sphere.
RECALL_CELLS, RECALL_PROBES, RECALL = 16, 13, 0.9


@query("SELECT count(*) AS queries, 10 * count(*) AS wanted, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def kmeans_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a KMeans inverted file finds the wanted share of the exact ten nearest, over every vector whose id is divisible by 50."""
    v = vectors(spark, sf_dir)
    index = ann.build_ivf(v, nlist=RECALL_CELLS, probes=RECALL_PROBES)
    asked = v.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = knn.search_batch(v, asked, 10).select("query_id", "row_id")
    found = index.search_many(asked, 10).select("query_id", "row_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "row_id"], "left")
    share = F.count("hit") / F.count("*")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (share >= RECALL).alias("reached"))


@query("""
    WITH w AS (SELECT p_partkey, unnest(string_split_regex(p_name, '\\s+')) AS w FROM part),
    h AS (SELECT p_partkey, CAST(('0x' || substr(md5(w), 1, 8)) AS UBIGINT) % 64 AS place,
        CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1.0 ELSE -1.0 END AS s FROM w WHERE w <> ''),
    t AS (SELECT p_partkey, place, sum(s) AS s FROM h GROUP BY ALL),
    n AS (SELECT p_partkey, sqrt(sum(s * s)) AS norm FROM t GROUP BY ALL)
    SELECT p_partkey AS row_id, CAST(place AS INTEGER) AS place, round(CAST(s / norm AS DOUBLE), 5) AS x FROM t JOIN n USING (p_partkey) WHERE s <> 0""")
def encode_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = HashingEncoder(64).encode(products(spark, sf_dir).select("row_id", "title"), "title")
    return rows.select("row_id", F.posexplode("embedding").alias("place", "x")).where("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 5))


# ---------- spelling ----------

LCS_SQL = """list_reduce(list_concat([[CAST(0 AS INTEGER) for i in range(len({b}) + 1)]], [[CAST(unicode(ch) AS INTEGER)] for ch in string_split({a}, '')]),
    lambda row, ch: list_reduce(list_concat([[CAST(0 AS INTEGER)]], [[CAST(j AS INTEGER)] for j in range(1, len({b}) + 1)]),
        lambda acc, j: list_append(acc, CASE WHEN unicode({b}[j[1]]) = ch[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[j[1]]) END)))[-1]"""
#: Misspellings made by rule from the names' words: a letter dropped, doubled or replaced.
_WORDS_SQL = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part"
_TYPOS_SQL = f"""
    SELECT DISTINCT unnest([w, substr(w, 1, 1) || substr(w, 3), w || substr(w, length(w)), 'x' || substr(w, 2), upper(w), substr(w, 1, 2)]) AS word FROM ({_WORDS_SQL})"""


def _name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()


def _typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("token")
    n = F.char_length(w)
    forms = F.array(w, F.concat(F.substring(w, 1, 1), F.substring(w, F.lit(3), n)), F.concat(w, F.substring(w, n, F.lit(1))), F.concat(F.lit("x"), F.substring(w, F.lit(2), n)), F.upper(w), F.substring(w, 1, 2))
    return _name_words(spark, sf_dir).select(F.explode(forms).alias("word")).distinct()


@query(f"SELECT DISTINCT lower(trim(w)) AS token FROM ({_WORDS_SQL}) WHERE trim(w) <> ''")
def vocab_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spell.normalize_vocabulary(_name_words(spark, sf_dir))


@query(f"""
    SELECT a, b, round(200.0 * {LCS_SQL.format(a="a", b="b")} / (length(a) + length(b)), 4) AS ratio
    FROM (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part)""")
def fuzz_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.withColumn("ratio", F.round(spell.fuzz_ratio(F.col("a"), F.col("b")), 4))


_CORRECT_SQL = f"""
    best AS (SELECT word, token, row_number() OVER (PARTITION BY word ORDER BY lcs / n DESC, token) AS r FROM (
        SELECT t.word, v.w AS token, {LCS_SQL.format(a="lower(t.word)", b="v.w")} AS lcs, length(t.word) + length(v.w) AS n
        FROM typos t, ({_WORDS_SQL}) v WHERE t.word <> '') WHERE 200 * lcs >= 80 * n)"""


@query(f"""
    WITH typos AS ({_TYPOS_SQL}), {_CORRECT_SQL}
    SELECT t.word, coalesce(b.token, lower(t.word)) AS corrected FROM typos t LEFT JOIN best b ON b.word = t.word AND r = 1""")
def spell_correct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spell.correct_words(_typos(spark, sf_dir), spell.normalize_vocabulary(_name_words(spark, sf_dir)))


@query(f"""
    WITH q AS (SELECT s_suppkey AS query_id, 'Red  xlue ' || lower(s_name) || ' grren' AS query FROM supplier),
    ws AS (SELECT query_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT query_id, list_filter(string_split_regex(query, '\\s+'), lambda x: x <> '') AS w FROM q)),
    typos AS (SELECT DISTINCT w AS word FROM ws), {_CORRECT_SQL},
    f AS (SELECT query_id, string_agg(coalesce(b.token, lower(ws.w)), ' ' ORDER BY pos) AS corrected FROM ws LEFT JOIN best b ON b.word = ws.w AND r = 1 GROUP BY query_id)
    SELECT query_id, query, corrected, corrected <> query AS changed FROM q JOIN f USING (query_id)""")
def spell_correct_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    queries = s.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Red  xlue "), F.lower("s_name"), F.lit(" grren")).alias("query"))
    return spell.correct_queries(queries, spell.normalize_vocabulary(_name_words(spark, sf_dir)))


# ---------- text normalization ----------


#: Texts and what each stage makes of them, written down by hand from the rules; {w} stands for a part's name, {v} for the name
#: without the word "new". Every part takes one of the cases, by its key.
GOLDENS: dict[str, tuple[Callable, list[tuple[str, str]]]] = {
    "clean_entities": (textnorm.strip_html, [
        ("<b>{w}</b> &amp; more", " {w}  & more"), ("{w} &lt;i&gt;x&lt;/i&gt;", "{w}  x "), ("5 &gt; 3 {w}", "5 > 3 {w}"),
        ("&quot;{w}&quot; &#39;q&#39; &eacute;", "\"{w}\" 'q' é"), ("{w}&nbsp;<br/>end &#x41;", "{w}  end A"),
    ]),
    "clean_unicode": (textnorm.unicode_lower, [
        ("ＡＢＣ {w}", "abc {w}"), ("ﬁne {w} Ⅳ", "fine {w} iv"), ("{w} ½", "{w} 1⁄2"), ("É {w} ÀB", "é {w} àb"), ("{w} X²", "{w} x2"), ("Plain {w}", "plain {w}"),
    ]),
    "clean_quotes": (textnorm.normalize_units, [
        ("24” {w}", "24 inch {w}"), ("6’ {w}", "6 feet {w}"), ("“{w}”", '"{w}"'), ("5′ x 7\" {w}", "5 feet x 7 inch {w}"), ("{w} it’s", "{w} it's"),
    ]),
    "clean_units": (textnorm.normalize_units, [
        ("3.5inches {w} 12 ounces", "3.5 inch {w} 12 oz"), ("{w} 500millilitre", "{w} 500 ml"), ("2lbs {w} 1 pound", "2 lb {w} 1 lb"), ("1.5 terabyte {w}", "1.5 tb {w}"),
        ("10cm x 20mm {w}", "10 cm x 20 mm {w}"), ("2 in 1 {w}", "2 inch 1 {w}"), ("3kilograms {w} 40gms", "3 kg {w} 40 g"), ("8gigabytes 16mb {w} 2litre", "8 gb 16 mb {w} 2 l"),
    ]),
    "clean_slash_groups": (textnorm.expand_groups, [
        ("{w} 20/24/28", "{w} 20 inch 24 inch 28 inch"), ("sizes 3-5 {w}", "sizes 3 5 {w}"), ("{w} 100/300", "{w} 100 300"), ("7/8 {w}", "7 inch 8 inch {w}"), ("{w} 200/9 a", "{w} 200 inch 9 inch a"),
    ]),
    "clean_parentheses": (textnorm.unwrap_parentheses, [
        ("{w} ()", "{w}  "), ("{w} (AB12-34X)", "{w}  "), ("{w} (20/24)", "{w}  20 inch 24 inch "), ("({w})x", " {w} x"), ("{w} ( in box ) y", "{w}  in box  y"),
    ]),
    "clean_abbreviations": (textnorm.expand_abbreviations, [
        ("{w} w/lid", "{w} withlid"), ("{w} w/o lid", "{w} without lid"), ("w/ {w}", "w/ {w}"), ("3 pcs blk {w}", "3 pieces black {w}"), ("qty 2 tsp {w}", "quantity 2 teaspoon {w}"),
        ("5 pkg grn {w}", "5 package green {w}"), ("2 fl oz wht {w} 4 tbsp", "2 fl_ounce white {w} 4 tablespoon"), ("cts {w} pc blks", "counts {w} piece blks"),
    ]),
    "clean_packs": (textnorm.normalize_packs, [
        ("6-pack {w}", "6 pack {w}"), ("3pcs {w}", "3 pieces {w}"), ("12 ct {w}", "12 count {w}"), ("set of 4 {w}", "4 pieces set {w}"), ("2p {w}", "2 pack {w}"), ("{w} 5 pk", "{w} 5 pack"),
    ]),
    "clean_noise": (textnorm.drop_noise, [
        ("4.5 stars {w} 20 reviews", "  {w}  "), ("bestseller {w} top-rated", "  {w}  "), ("{w} save 10% free shipping", "{w}  %  "), ("{w} limited edition hot deal", "{w}    "),
        ("x bought 12 times {w}", "x   {w}"), ("starship {w}", "starship {w}"),
    ]),
    "clean_prices": (textnorm.drop_prices, [
        ("$1,299.00 {w}", "  {w}"), ("{w} usd 30 price", "{w}    "), ("spinners 20 inch {w}", "spinne  inch {w}"), ("{w} mrp 5", "{w}   5"), ("€9.5 {w} ₹ 12", "  {w}  "),
    ]),
    "clean_colors": (textnorm.normalize_colors, [("grey {w} greyish", "gray {w} greyish"), ("{w} black", "{w} black")]),
    "clean_roman": (textnorm.normalize_roman, [("mark ii {w}", "mark 2 {w}"), ("{w} viii", "{w} 8"), ("x {w} i", "x {w} i"), ("v-neck {w} xi", "5-neck {w} 11"), ("vivid {w} ix", "vivid {w} 9")]),
    "clean_punctuation": (textnorm.strip_punctuation, [("  {w}!! a_b, 50% 2.0 é ", "{w} a_b 50% 2.0 é"), ("a-b/c {w}\t|", "a b c {w}"), ("#{w}#", "{w}")]),
    "clean_tokens": (lambda t: F.array_join(textnorm.tokenize(t), " "), [("50% {w} wait... cannot", "50 % {w} wait ... can not"), ("a  b.c {w}", "a b.c {w}"), ("{w} gonna 2.0", "{w} gon na 2.0")]),
    "clean_stopwords": (lambda t: F.array_join(textnorm.drop_stopwords(F.split(t, " ")), " "), [("the {w} in a new box of our own", "{v} in box own"), ("{w} for and with", "{v}"), ("theme {w} its an on by", "theme {v}")]),
    "clean_sku_tokens": (lambda t: F.array_join(textnorm.drop_skus(F.split(t, " ")), " "), [("b08xyz1234 {w} 12345678 abcdefgh ab12-cd34 a1", "{w} 12345678 abcdefgh a1"), ("{w} abc1234 abcd1234", "{w} abc1234")]),
    "clean_final_filter": (lambda t: textnorm.join_tokens(F.split(t, " ")), [(". {w} x, s 1234567890123 123456789012 50%, %", "{w} s 123456789012 50"), ("m. l {w} 7 ..a.. b", "m l {w}"), ("{w}, 3", "{w}")]),
}


def _filled(template: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{w}"), F.col("p_name")), F.lit("{v}"), F.replace(F.col("p_name"), F.lit("new "), F.lit("")))


def _golden_query(name: str, stage: Callable, cases: list[tuple[str, str]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = F.array(*[F.lit(text) for text, _ in cases])
        rows = table(spark, sf_dir, "part").select("p_partkey", _filled(F.get(texts, F.pmod("p_partkey", F.lit(len(cases))).cast("int"))).alias("t"))
        return rows.select(F.col("p_partkey").alias("row_id"), stage(F.col("t")).alias("cleaned"))

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    run.__name__ = name
    expected = ", ".join(quoted(want) for _, want in cases)
    query(f"""SELECT p_partkey AS row_id, replace(replace([{expected}][p_partkey % {len(cases)} + 1], '{{w}}', p_name), '{{v}}', replace(p_name, 'new ', '')) AS cleaned FROM part""")(run)


for _name, (_stage, _cases) in GOLDENS.items():
    _golden_query(_name, _stage, _cases)


#: Whole titles through all stages, lemmas included, and what must come out.
TITLES = [
    ("Brand {w}s, 24” Grey &amp; 3 pcs", "brand {v} 24 inch gray piece"), ("<p>{w}</p> (AB12-34X) Set of 5 - $20", "{v} piece set"), ("ﬁne {w} b08xyz1234 4.5 stars", "fine {v}"),
    ("The {w} 12/24 w/lid", "{v} 12 inch 24 inch withlid"), ("50% {w} Mark II", "50 {v} mark"), ("", ""),
]


@query(f"""
    SELECT p_partkey AS row_id, replace([{', '.join("'" + want + "'" for _, want in TITLES)}][p_partkey % {len(TITLES)} + 1], '{{v}}', replace(p_name, 'new ', '')) AS cleaned FROM part""")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(text) for text, _ in TITLES])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), _filled(F.get(texts, F.pmod("p_partkey", F.lit(len(TITLES))).cast("int"))).alias("t"))
    return textnorm.clean_text(rows, "t", "cleaned").select("row_id", "cleaned")


@query("""
    SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), '<[^>]+>', ' ', 'g') AS plain FROM pages""")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", textnorm.strip_html(F.col("html")).alias("plain"))


@query()
def clean_text_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textnorm.clean_text(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", "cleaned").select("doc_id", "cleaned")


#: A name loses its stop word, categories are single plain words.
_MADE_SQL = "replace(p_name, 'new ', '') || ' | ' || lower(p_type)"


@query(f"SELECT p_partkey AS row_id, {_MADE_SQL} AS text FROM part")
def make_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.embedding_text(products(spark, sf_dir)).select("row_id", "text")


@query("""
    SELECT p_partkey AS row_id, replace(p_name, 'new ', '') || CASE WHEN p_size % 5 > 0 THEN ' | ' || lower(r_name) ELSE '' END AS text
    FROM part LEFT JOIN region ON r_regionkey = p_size % 5""")
def make_text_by_category_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("title"), (F.col("p_size") % 5).cast("long").alias("category_id"))
    kinds = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("category_id"), F.col("r_name").alias("category_name"))
    return present.embedding_text(goods, categories=kinds).select("row_id", "text")


_VOCABULARY_SQL = f"SELECT DISTINCT w FROM (SELECT unnest(string_split(replace({_MADE_SQL}, ' | ', ' '), ' ')) AS w FROM part)"


@query(f"SELECT w AS token FROM ({_VOCABULARY_SQL})")
def vocabulary_of_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_vocabulary(products(spark, sf_dir))


@query("SELECT p_partkey AS row_id, coalesce(p_name, '') || ' ' || coalesce(nullif(p_brand, 'Brand#1'), '') AS text FROM part")
def legacy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.nullif("p_brand", F.lit("Brand#1"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), present.legacy_text(F.col("p_name"), brand).alias("text"))


# ---------- presentation ----------


@query("""SELECT p_partkey AS row_id, CASE WHEN p_partkey % 7 = 0 THEN 'N/A' ELSE CAST(round(round(p_retailprice * 85, 2), 2) AS VARCHAR) END AS inr FROM part""")
def price_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), present.price_inr(price).alias("inr"))


@query(f"""SELECT coalesce(title, '') AS page_content, row_id, url FROM (SELECT row_id, url, CASE WHEN row_id % 5 > 0 THEN title END AS title FROM ({PRODUCT_SQL}))""")
def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).withColumn("title", F.when(F.col("row_id") % 5 > 0, F.col("title")))
    return present.page_content(p).select("page_content", "metadata.row_id", "metadata.url")


@query(f"""SELECT row_id, coalesce(title, 'Unknown Product') AS title, coalesce(category_name, 'N/A') AS category, coalesce(price, 0) AS price_usd
    FROM (SELECT row_id, CASE WHEN row_id % 5 > 0 THEN title END AS title, CASE WHEN row_id % 4 > 0 THEN category_name END AS category_name, CASE WHEN row_id % 3 > 0 THEN price END AS price FROM ({PRODUCT_SQL}))""")
def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    holes = {"title": 5, "category_name": 4, "price": 3}
    for c, m in holes.items():
        p = p.withColumn(c, F.when(F.col("row_id") % m > 0, F.col(c)))
    cards = present.card(p.withColumn("imgUrl", F.col("row_id").cast("string")))
    return cards.select(F.col("imgUrl").cast("long").alias("row_id"), "title", "category", "price_usd")


# ---------- a whole search ----------

SEARCH_TEXT, SEARCH_FILTERS = "Smal rinng", {"category_name": ["econom", "mediu"], "price_min": 905.0}


def _hashed_sql(name: str, text: str, key: str, source: str) -> str:
    """CTEs that encode texts as the hashing encoder does: (key, place, x)."""
    return f"""
    {name}_w AS (SELECT {key}, unnest(list_filter(string_split({text}, ' '), lambda x: x <> '')) AS w FROM {source}),
    {name}_t AS (SELECT {key}, CAST(('0x' || substr(md5(w), 1, 8)) AS UBIGINT) % 64 AS place, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1.0 ELSE -1.0 END) AS s FROM {name}_w GROUP BY ALL),
    {name} AS (SELECT {key}, place, CAST(CAST(s AS DOUBLE) / sqrt(CAST(sum(s * s) OVER (PARTITION BY {key}) AS DOUBLE)) AS FLOAT) AS x FROM {name}_t)"""


@query(f"""
    WITH ws AS (SELECT unnest(string_split('{SEARCH_TEXT}', ' ')) AS w, unnest([1, 2]) AS pos),
    known AS ({_VOCABULARY_SQL}),
    fits AS (SELECT pos, v.w AS token, 200.0 * {LCS_SQL.format(a="lower(ws.w)", b="v.w")} / (length(ws.w) + length(v.w)) AS ratio FROM ws, known v),
    fixed AS (SELECT pos, token FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY ratio DESC, token) AS r FROM fits WHERE ratio >= 80) WHERE r = 1),
    asked AS (SELECT 0 AS qid, string_agg(coalesce(token, lower(ws.w)), ' ' ORDER BY pos) AS text FROM ws LEFT JOIN fixed USING (pos)),
    made AS (SELECT p_partkey AS row_id, {_MADE_SQL} AS text FROM part),
    {_hashed_sql("q", "text", "qid", "asked")},
    {_hashed_sql("d", "text", "row_id", "made")},
    scored AS (
        SELECT row_id, coalesce(list_sum(list(CAST(d.x AS DOUBLE) * CAST(q.x AS DOUBLE) ORDER BY place) FILTER (q.x IS NOT NULL)), 0) AS score
        FROM d LEFT JOIN q USING (place) GROUP BY row_id),
    pool AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM scored ORDER BY score DESC, row_id LIMIT 100),
    p AS ({PRODUCT_SQL}),
    passed AS (
        SELECT p.*, rank, {KEY_SQL} AS k FROM p JOIN pool USING (row_id)
        WHERE coalesce(price, 0) >= 905 AND (contains(lower(category_name), 'econom') OR contains(lower(category_name), 'mediu'))),
    best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank) AS n FROM passed)
    SELECT row_id, title, category_name, price, (SELECT text FROM asked) AS corrected_query FROM best WHERE n = 1 ORDER BY rank LIMIT 5""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search from text to rows: spelling against the catalog's vocabulary, encoding, pool, filters, dedup."""
    found = Engine.build(products(spark, sf_dir), HashingEncoder(64), "flat").search(SEARCH_TEXT, 5, SEARCH_FILTERS)
    return found.results.select("row_id", "title", "category_name", "price", F.lit(found.corrected_query).alias("corrected_query"))


@query(f"""
    WITH ws AS (SELECT unnest(['economi', 'smal', 'zzz', 'ring']) AS given, unnest([0, 1, 2, 3]) AS pos),
    known AS ({_VOCABULARY_SQL}),
    fits AS (SELECT pos, v.w AS token, 200.0 * {LCS_SQL.format(a="given", b="v.w")} / (length(given) + length(v.w)) AS ratio FROM ws, known v),
    fixed AS (SELECT pos, token FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY ratio DESC, token) AS r FROM fits WHERE ratio >= 80) WHERE r = 1)
    SELECT CAST(pos AS BIGINT) AS pos, coalesce(token, given) AS category FROM ws LEFT JOIN fixed USING (pos)""")
def filter_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that a response says were searched: each corrected like a word of a query."""
    corrector = spell.SpellCorrector(spark, catalog_vocabulary(products(spark, sf_dir)))
    echoed = filters.echo_filters({"category_name": ["Economi", "SMAL", "zzz", "ring"], "price_min": 5, "brand": None}, corrector.correct_words)
    if set(echoed) != {"category_name", "price_min", "brand"} or echoed["price_min"] != 5:
        raise ValueError(f"an echo keeps all keys: {echoed}")
    return spark.createDataFrame(list(enumerate(echoed["category_name"])), "pos long, category string")


@query("""
    SELECT * FROM (VALUES
        (0, 'Category → a | Price → 1 to 5 | Best Seller only'), (1, 'Category → [''a'', ''b'']'), (2, ''), (3, 'Stars → 2 to')) v(form, summary)""")
def form_filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search form's entries become, in words."""
    forms = [("a", 1, 5, 0, 0, True), (" a, b,", 0, 0, 0, 0, False), ("", 0, 0, 0, 0, False), ("", 0, 0, 2, 0, False)]
    said = []
    for i, entries in enumerate(forms):
        asked = {k: v for k, v in filters.form_filters(*entries).items() if v is not None}
        said.append((i, present.filter_summary(asked)))
    return spark.createDataFrame(said, "form int, summary string")


@query("""
    SELECT row_id, 's:' || substr('"' || replace(title, 'é', chr(92) || 'u00e9') || ' a rather long title that goes past the end of the key"', 1, 64) AS key
    FROM (SELECT p_partkey AS row_id, 'é ' || p_name AS title FROM part)""")
def dedup_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of products without asin, id and url: the title as a JSON string, cut."""
    title = F.concat(F.lit("é "), F.col("p_name"), F.lit(" a rather long title that goes past the end of the key"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.lit("").alias("asin"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("string").alias("url"), title.alias("title"))
    return p.select("row_id", dedup.dedup_key(p).alias("key"))


# ---------- sources and sinks ----------

_STORED = ("id", "asin", "title", "category_name", "price", "stars", "isBestSeller", "url")
_STORED_SQL = f"""SELECT CAST(id AS VARCHAR) AS id, asin, '"' || title || '", é' AS title, category_name, price, stars, "isBestSeller", url FROM ({PRODUCT_SQL})"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit('"'), F.col("title"), F.lit('", é'))
    return products(spark, sf_dir).withColumn("title", title).withColumn("id", F.col("id").cast("string")).select(*_STORED)


def _round_trip(name: str, suffix: str, write: Callable[[DataFrame, str], None]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "round-trip") + suffix
        write(_stored(spark, sf_dir), path)
        return readers.load_products(spark, path).select(*_STORED)

    run.__name__ = name
    query(_STORED_SQL)(run)


def _write_object(df: DataFrame, path: str) -> None:
    """One JSON object that holds all products as an array; the format is for small catalogs."""
    df.agg(F.collect_list(F.struct(*_STORED)).alias("products")).coalesce(1).write.json(path)


_round_trip("round_trip_csv", ".csv", sinks.write_csv)
_round_trip("round_trip_jsonl", ".jsonl", sinks.write_products_json)
_round_trip("round_trip_json", ".json", _write_object)
_round_trip("round_trip_parquet", ".parquet", sinks.write_parquet)


@query("SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(len(embedding) AS INTEGER) AS dim, 'ivf' AS kind, CAST(16 AS INTEGER) AS nlist FROM embeddings")
def artifacts_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact folder whose index is built, built again as another kind with the old one backed up, and loaded."""
    root, v = scratch_path(spark, "artifacts"), vectors(spark, sf_dir)
    sinks.write_parquet(v.select("row_id", F.concat(F.lit("part "), F.col("row_id").cast("string")).alias("title")), f"{root}/{sinks.PRODUCTS}")
    sinks.write_parquet(v, f"{root}/{sinks.VECTORS}")
    for kind in ("hnsw", "ivf"):
        build_artifacts(spark, None, root, index_kind=kind, nlist=16, rebuild_index_only=True)
    found = Engine.load(spark, root).index
    kept = found.settings()
    return found.cells.select("row_id", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("dim"), F.lit(kept["kind"]).alias("kind"), F.lit(kept["nlist"]).alias("nlist"))
