"""The title normalizer as a chain of column stages.

Every stage is a column expression; only entities and NFKC, which have no built-in function, run in Arrow UDFs, and
these get only the texts that need them. Patterns are Unicode-aware ((?U)).
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text_rules as rules
from quarry.functions.lemma import Lemmatizer, NounPlurals

_SPACE = r"(?U)\s+"
_EDGES = r"(?U)^\s+|\s+$"


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, f"(?iU){rule[0]}", rule[1]), pairs, text)


def _rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """text with each match of pattern replaced by change(match)."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.zip_with(between, matches, lambda b, m: F.concat(F.coalesce(b, F.lit("")), F.coalesce(change(m), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _where(condition: Column, udf: Callable, text: Column) -> Column:
    """udf over the texts that meet condition, the others as they are."""
    return F.coalesce(udf(F.when(condition, text)), text)


def strip_html(text: Column) -> Column:
    """Entities first, then tags, so that an escaped tag goes too."""
    return F.regexp_replace(_where(text.contains("&"), _unescape, text), "<[^>]+>", " ")


def unicode_lower(text: Column) -> Column:
    return F.lower(_where(text.rlike(r"[^\x00-\x7F]"), _nfkc, text))


def normalize_units(text: Column) -> Column:
    return _replace_all(F.translate(text, rules.SMART_QUOTES, rules.PLAIN_QUOTES), rules.UNITS)


def expand_groups(text: Column) -> Column:
    """20/24/28 to inches where the largest number is a plausible size, else to separate numbers."""

    def expand(group: Column) -> Column:
        numbers = F.split(group, r"[/\-]")
        size = F.array_max(F.transform(numbers, lambda n: F.coalesce(n.try_cast("decimal(38,0)"), F.lit("1" + "0" * 37).cast("decimal(38,0)"))))
        inches = (size >= rules.INCH_FROM) & (size <= rules.INCH_TO)
        return F.array_join(F.transform(numbers, lambda n: F.when(inches, F.concat(n, F.lit(" inch"))).otherwise(n)), " ")

    return _rewrite(text, f"(?U){rules.GROUP}", expand)


def unwrap_parentheses(text: Column) -> Column:
    """Drop chunks that look like article numbers, expand sizes, keep the rest without its parentheses."""

    def change(chunk: Column) -> Column:
        inner = F.regexp_replace(F.substring(chunk, F.lit(2), F.char_length(chunk) - 2), _EDGES, "")
        sku = inner.rlike(r"(?U)\p{L}") & inner.rlike(r"(?U)\d") & F.replace(inner, F.lit(" "), F.lit("")).rlike(rules.SKU_START) & (F.char_length(inner) >= rules.SKU_CHUNK_LENGTH)
        return F.when((inner == "") | sku, F.lit(" ")).otherwise(F.concat(F.lit(" "), expand_groups(inner), F.lit(" ")))

    return _rewrite(text, r"\([^)]*\)", change)


def expand_abbreviations(text: Column) -> Column:
    return _replace_all(text, rules.ABBREVIATIONS)


def normalize_packs(text: Column) -> Column:
    return _replace_all(text, rules.PACKS)


def drop_noise(text: Column) -> Column:
    return _replace_all(text, [(p, " ") for p in rules.NOISE])


def drop_prices(text: Column) -> Column:
    return _replace_all(text, [(p, " ") for p in rules.PRICES])


def normalize_colors(text: Column) -> Column:
    return _replace_all(text, rules.COLORS)


def normalize_roman(text: Column) -> Column:
    return _replace_all(text, rules.ROMAN)


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s%.]", " "), _SPACE, " "), _EDGES, "")


def tokenize(text: Column) -> Column:
    """Split at white space, around % and runs of dots, and inside the few words that the tokenizer splits."""
    spaced = F.regexp_replace(F.regexp_replace(_replace_all(text, rules.SPLIT_WORDS), "%", " % "), r"\.{2,}", " $0 ")
    return F.filter(F.split(spaced, _SPACE), lambda t: t != "")


def drop_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*rules.STOPWORDS))


def drop_skus(tokens: Column) -> Column:
    def sku(t: Column) -> Column:
        return t.rlike(rules.SKU_TOKEN) & (F.char_length(t) >= rules.SKU_TOKEN_LENGTH) & t.rlike("[A-Za-z]") & t.rlike("[0-9]")

    return F.filter(tokens, lambda t: ~sku(t))


def final_tokens(tokens: Column) -> Column:
    """Strip edge punctuation; drop what is empty, one character that is no size, or a very long number."""
    bare = F.transform(tokens, lambda t: F.btrim(t, F.lit(".,%")))
    short = lambda t: (F.char_length(t) == 1) & ~t.isin(*rules.ONE_LETTER_SIZES)
    long = lambda t: t.rlike(r"(?U)^\d+$") & (F.char_length(t) > rules.LONG_NUMBER)
    return F.filter(bare, lambda t: (t != "") & ~short(t) & ~long(t))


STAGES = [
    strip_html, unicode_lower, normalize_units, expand_groups, unwrap_parentheses, expand_abbreviations, normalize_packs,
    drop_noise, drop_prices, normalize_colors, normalize_roman, strip_punctuation,
]


def normalized_text(text: Column) -> Column:
    """All stages up to the tokens; a null is empty."""
    return reduce(lambda c, stage: stage(c), STAGES, F.coalesce(text, F.lit("")))


def pre_lemma_tokens(normalized: Column) -> Column:
    return drop_skus(drop_stopwords(tokenize(normalized)))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(final_tokens(tokens), " ")


def clean_text(df: DataFrame, source: str | Column, target: str, lemmatizer: Lemmatizer | None = None) -> DataFrame:
    """df with the normalized form of source in target. The stages stand in projections of their own, so that a
    result that the next stage reads twice is computed once."""
    text = F.col(source) if isinstance(source, str) else source
    out = df.withColumn(target, F.coalesce(text.cast("string"), F.lit("")))
    for stage in STAGES:
        out = out.withColumn(target, stage(F.col(target)))
    lemmas = (lemmatizer or NounPlurals())(pre_lemma_tokens(F.col(target)))
    return out.withColumn(target, join_tokens(lemmas))
