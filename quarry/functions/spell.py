"""Fuzzy correction of query words against the catalog's vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD, SALTS = 80, 16


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one dynamic-programming row folded over the letters of a."""
    letters, other = F.split(a, ""), F.split(b, "")

    def next_row(row: Column, ch: Column) -> Column:
        start = F.array(F.lit(0))

        def cell(acc: Column, j: Column) -> Column:
            hit = F.get(row, j - 1) + 1
            miss = F.greatest(F.get(row, j), F.get(acc, j - 1))
            return F.concat(acc, F.array(F.when(F.get(other, j - 1) == ch, hit).otherwise(miss)))

        return F.aggregate(F.sequence(F.lit(1), F.size(other)), start, cell)

    zero = F.array_repeat(F.lit(0), F.size(other) + 1)
    length = F.element_at(F.aggregate(letters, zero, next_row), -1)
    return F.when((F.char_length(a) == 0) | (F.char_length(b) == 0), 0).otherwise(length)


def fuzz_ratio(a: Column, b: Column) -> Column:
    """Normalized Indel similarity in percent; two empty words are alike."""
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs_length(a, b) / total)


def normalize_vocabulary(tokens: DataFrame, col: str = "token") -> DataFrame:
    """Distinct stripped, lower-cased, non-empty tokens."""
    return tokens.select(F.lower(F.trim(col)).alias("token")).where(F.col("token") != "").distinct()


def vocabulary(products: DataFrame, cleaned: list[str]) -> DataFrame:
    """Tokens of the cleaned text columns."""
    words = F.explode(F.split(F.concat_ws(" ", *cleaned), " "))
    return normalize_vocabulary(products.select(words.alias("token")))


def correct_words(words: DataFrame, vocab: DataFrame, threshold: int = THRESHOLD, col: str = "word") -> DataFrame:
    """words with `corrected`: the vocabulary token of best ratio (least token among equals) at or above threshold.

    A pair can reach the threshold t only if the longer word has at most (200 - t) / t times the letters of the shorter one, so
    words meet the vocabulary by length instead of in all pairs. There are few lengths, so the vocabulary is dealt over
    SALTS cells for each, and a distinct word goes to those cells of its lengths that hold a token. The planner knows nothing
    of these copies, so it is told to sort and merge: by its estimate it would broadcast them all.
    """
    plain = words.select(F.lower(F.trim(col)).alias("_w")).where(F.col("_w") != "").distinct()
    n = F.char_length("_w")
    most = (200 - threshold) / max(threshold, 1)
    lengths = F.sequence(F.greatest(F.ceil(n / most - 1e-9), F.lit(1)).cast("int"), F.greatest(F.floor(n * most + 1e-9), F.lit(1)).cast("int"))
    known = vocab.withColumn("_n", F.char_length("token")).withColumn("_salt", F.pmod(F.xxhash64("token"), F.lit(SALTS)).cast("int"))
    cells = known.groupBy("_n", "_salt").count().where("count > 0")  # at most SALTS a length; counted, so that the tokens' shuffle is used twice
    asked = plain.withColumn("_n", F.explode(lengths)).join(F.broadcast(cells.drop("count")), "_n")
    pairs = asked.hint("merge").join(known, ["_n", "_salt"])
    scored = pairs.withColumn("_lcs", F.when(F.col("_w") == F.col("token"), n).otherwise(lcs_length(F.col("_w"), F.col("token"))))
    both = n + F.char_length("token")
    near = scored.where(200 * F.col("_lcs") >= threshold * both)
    best = near.groupBy("_w").agg(F.max_by("token", F.struct(200.0 * F.col("_lcs") / both, _descending("token"))).alias("_best"))
    joined = words.join(best, F.lower(F.trim(F.col(col))) == F.col("_w"), "left")
    same = F.when(F.coalesce(F.col(col), F.lit("")) == "", F.col(col)).otherwise(F.lower(F.trim(F.col(col))))
    return joined.withColumn("corrected", F.coalesce("_best", same)).drop("_w", "_best")


def _descending(token: str) -> Column:
    """A key that is greater for a lesser token: its code points negated, then an end mark that ranks highest."""
    return F.concat(F.transform(F.split(F.col(token), ""), lambda ch: -F.ascii(ch)), F.array(F.lit(1)))


def correct_queries(queries: DataFrame, vocab: DataFrame, threshold: int = THRESHOLD, id_col: str = "query_id", col: str = "query") -> DataFrame:
    """queries with `corrected`: the words corrected and joined by single spaces; null and empty queries stay."""
    words = queries.select(F.col(id_col), F.posexplode(F.filter(F.split(F.col(col), r"(?U)\s+"), lambda w: w != "")).alias("_pos", "word"))
    fixed = correct_words(words, vocab, threshold)
    joined = fixed.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_pos", "corrected"))).alias("_ws"))
    text = F.array_join(F.col("_ws.corrected"), " ")
    kept = F.when(F.coalesce(F.col(col), F.lit("")) == "", F.col(col)).otherwise(F.coalesce(text, F.lit("")))
    return queries.join(joined, id_col, "left").withColumn("corrected", kept).withColumn("changed", ~F.col("corrected").eqNullSafe(F.coalesce(F.col(col), F.lit("")))).drop("_ws")


class SpellCorrector:
    """Corrections for single requests: one small job for each."""

    def __init__(self, spark: SparkSession, vocab: DataFrame):
        self.spark, self.vocab = spark, vocab

    def correct_words(self, words: list[str], threshold: int = THRESHOLD) -> list[str]:
        if not words:
            return []
        rows = self.spark.createDataFrame(list(enumerate(words)), "pos int, word string")
        return [r["corrected"] for r in sorted(correct_words(rows, self.vocab, threshold).collect(), key=lambda r: r["pos"])]

    def correct_word(self, word: str | None, threshold: int = THRESHOLD) -> str | None:
        return self.correct_words([word], threshold)[0] if word else word

    def correct_query(self, query: str | None, threshold: int = THRESHOLD) -> str | None:
        return " ".join(self.correct_words(query.split(), threshold)) if query else query
