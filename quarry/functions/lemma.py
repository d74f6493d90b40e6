"""Lemmatizers: something that maps an array of tokens to an array of lemmas.

There is no lexicon or part-of-speech tagger here, so the default reduces regular English noun plurals by rule and leaves
verbs and adjectives alone. A lexicon, given as a mapping of forms to lemmas, goes first.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plurals that the rules would miss, and words that only look like plurals.
IRREGULAR = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "knives": "knife", "wives": "wife", "lives": "life", "shelves": "shelf", "scarves": "scarf", "leaves": "leaf", "wolves": "wolf", "shoes": "shoe", "canoes": "canoe", "toes": "toe", "movies": "movie", "cookies": "cookie", "ties": "tie", "pies": "pie"}
SINGULAR = ("lens", "bus", "gas", "plus", "canvas", "series", "species", "always", "atlas", "yes", "its", "this", "was", "has", "does", "texas", "christmas", "news", "corps", "chassis", "tennis", "basis", "iris", "us", "jeans")
MAX_LEXICON = 50_000


class Lemmatizer(Protocol):
    def __call__(self, tokens: Column) -> Column: ...


class NoLemmas:
    def __call__(self, tokens: Column) -> Column:
        return tokens


class NounPlurals:
    """Regular plural endings, after a lexicon of bounded size."""

    def __init__(self, lexicon: Mapping[str, str] | None = None):
        self.lexicon = IRREGULAR | dict(lexicon or {})
        if len(self.lexicon) > MAX_LEXICON:
            raise ValueError(f"a lexicon literal holds at most {MAX_LEXICON} forms; join larger ones")

    def __call__(self, tokens: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in self.lexicon.items() for x in pair])

        def lemma(t: Column) -> Column:
            regular = (
                F.when((F.char_length(t) <= 3) | ~t.rlike("^[a-z]+$") | t.isin(*SINGULAR) | t.rlike("(?:ss|us|is)$"), t)
                .when(t.rlike("ies$") & (F.char_length(t) > 4), F.regexp_replace(t, "ies$", "y"))
                .when(t.rlike("(?:sses|xes|zzes|ches|shes)$"), F.regexp_replace(t, "es$", ""))
                .when(t.rlike("s$"), F.regexp_replace(t, "s$", ""))
                .otherwise(t)
            )
            return F.coalesce(F.try_element_at(known, t), regular)

        return F.transform(tokens, lemma)
