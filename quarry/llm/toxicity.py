"""Toxicity scores from a learned lexicon, matched with misspellings, weighed by its context.

Fitting takes labelled rows only (at most `TRAIN_ROWS` of them, those of lowest hash). Words and word stems whose
presence tells toxic from clean rows become the lexicon. It is stored as a trie; a Levenshtein automaton for one edit
is intersected with the trie and made deterministic as words are read, so most words die after a few letters. A word one
edit from a well-supported term counts as a misspelling of it unless clean rows use that very word. Each hit is put in
its window of words: what surrounds hits in toxic rows as against clean ones, and whether the hit stands inside
quotation marks, separates abuse from quotation. A logistic regression over these few figures gives the score; its rows'
figures leave the row itself out of the lexicon's counts.

Only the text is an input of a score. Defined cases: null and empty texts get the score of a text without hits; no
labelled rows, or rows of one class only, give every text the smoothed share of toxic rows; a document labelled twice
counts as toxic if any label says so; repeated rows get equal scores; a null doc_id is scored, never learned from;
other columns pass through `keep_clean`; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, filter_rows, texts

#: Bound on the labelled rows that are learned from, and with it on terms, context words and harmless words: none is cut besides.
TRAIN_ROWS = 20_000
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
STEMS, EDITS, FUZZY_FROM, WINDOW, MISSPELT = (4, 5, 6), 1, 5, 5, 0.9
CACHE_WORDS = 300_000
_word = regex.compile(r"[^\W_]+")
_OPEN, _CLOSE = "\"'“‘«„`", "\"'”’»“`"


class FuzzyLexicon:
    """Trie of terms intersected with a Levenshtein automaton, determinized state by state while words are read."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], strong: set[str], edits: int = EDITS):
        self.edits = edits
        self.children: list[dict[str, int]] = [{}]
        self.word_weight, self.stem_weight, self.fuzzy_weight = [0.0], [0.0], [0.0]
        for term, weight in words.items():
            node = self._node(term)
            self.word_weight[node] = max(self.word_weight[node], weight)
            if term in strong:
                self.fuzzy_weight[node] = self.word_weight[node]
        for term, weight in stems.items():
            node = self._node(term)
            self.stem_weight[node] = max(self.stem_weight[node], weight)
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.stem_of: list[float] = []
        self.start = self._state({(0, 0)})

    def _node(self, term: str) -> int:
        node = 0
        for letter in term:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.word_weight.append(0.0)
                self.stem_weight.append(0.0)
                self.fuzzy_weight.append(0.0)
            node = self.children[node][letter]
        return node

    def _state(self, positions: set[tuple[int, int]]) -> int:
        """The number of the state that holds these (node, edits) and all that missing letters lead to."""
        todo, closed = list(positions), set(positions)
        while todo:
            node, e = todo.pop()
            if e < self.edits:
                for child in self.children[node].values():
                    if (child, e + 1) not in closed:
                        closed.add((child, e + 1))
                        todo.append((child, e + 1))
        key = frozenset(closed)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.step.append({})
            self.stem_of.append(max((self.stem_weight[n] for n, e in key if not e), default=0.0))
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        """The next state, -1 when nothing can match any more."""
        to: set[tuple[int, int]] = set()
        for node, e in self.members[state]:
            if (child := self.children[node].get(letter)) is not None:
                to.add((child, e))
            if e < self.edits:
                to.add((node, e + 1))
                to.update((c, e + 1) for c in self.children[node].values())
        self.step[state][letter] = found = self._state(to) if to else -1
        return found

    def match(self, word: str) -> tuple[float, float]:
        """(weight of the word or of a stem it starts with, weight of a word within the edits); 0 for none."""
        state, stem = self.start, 0.0
        for letter in word:
            to = self.step[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if state < 0:
                return stem, 0.0
            stem = max(stem, self.stem_of[state])
        exact = max((self.word_weight[n] for n, e in self.members[state] if not e), default=0.0)
        fuzzy = max((self.fuzzy_weight[n] for n, e in self.members[state] if e), default=0.0)
        return max(stem, exact), fuzzy


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    strong: set[str] = field(default_factory=set)  # words whose misspellings count
    benign: set[str] = field(default_factory=set)  # words near those that clean rows use
    context: dict[str, float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES)
    intercept: float = 0.0


N_FEATURES = 5


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lexicon, self.cache = model, FuzzyLexicon(model.words, model.stems, model.strong), {}

    def _miss(self, word: str) -> tuple[float, float] | None:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        exact, fuzzy = self.lexicon.match(word)
        if exact or word in self.model.benign:
            fuzzy = 0.0
        self.cache[word] = found = (exact, fuzzy) if exact or fuzzy else False
        return found

    def hits(self, text: str) -> list[tuple[int, float, float]]:
        """(place of the word, exact weight, fuzzy weight) of each hit."""
        get, miss = self.cache.get, self._miss
        found = []
        for i, w in enumerate(_word.findall(text)):
            if (m := get(w)) is None:
                m = miss(w)
            if m:
                found.append((i, *m))
        return found

    def windows(self, text: str, hits: list[tuple[int, float, float]]) -> Iterator[tuple[list[str], bool]]:
        """For each hit the words around it and whether quotation marks enclose it."""
        spans = [m.span() for m in _word.finditer(text)]
        for i, _, _ in hits:
            near = spans[max(0, i - WINDOW) : i] + spans[i + 1 : i + 1 + WINDOW]
            a, b = spans[i]
            line = text.rfind("\n", 0, a) + 1
            end = text.find("\n", b)
            before, after = text[line:a], text[b : end if end >= 0 else len(text)]
            quoted = any(before.count(o) % 2 == 1 and c in after if o == c else before.rfind(o) > before.rfind(c) and c in after for o, c in zip(_OPEN, _CLOSE))
            yield [text[x:y] for x, y in near], quoted

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        hits = self.hits(text)
        if not hits:
            return [0.0] * N_FEATURES
        plain = quoted = total = around = 0.0
        for (_, exact, near), (words, inside) in zip(hits, self.windows(text, hits)):
            weight = exact or MISSPELT * near
            around = max(around, sum(self.model.context.get(w, 0.0) for w in words) / max(1, len(words)))
            total += weight
            if inside:
                quoted = max(quoted, weight)
            else:
                plain = max(plain, weight)
        return [plain, quoted, math.log1p(total), around, math.log1p(total) / math.log(20 + len(text))]

    def score(self, text: str | None) -> float:
        z = self.model.intercept + sum(c * x for c, x in zip(self.model.coef, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _each(rows: DataFrame, run: Callable[[list, list], list], schema: str) -> DataFrame:
    """run(texts, labels) -> tuples, for each Arrow batch of (text, toxic)."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[part.split()[1]] for part in schema.split(", ")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = list(zip(*run(part.column(0).to_pylist(), part.column(1).to_pylist()))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.select("text", "toxic").mapInArrow(over, schema)


def _counts(tox: Counter, clean: Counter) -> list[tuple[str, int, int]]:
    return [(k, tox[k], clean[k]) for k in tox.keys() | clean.keys()]


def _term_counts(rows: list, labels: list) -> list[tuple[str, int, int]]:
    both = Counter(), Counter()
    for text, toxic in zip(rows, labels):
        words = set(_word.findall((text or "").lower()))
        both[not toxic].update({"w" + w for w in words} | {f"s{w[:n]}" for w in words for n in STEMS if len(w) > n})
    return _counts(*both)


def _odds(tox: int, clean: int, n_tox: int, n_clean: int) -> float:
    return math.log((max(0, tox) + 0.5) / (n_tox + 1)) - math.log((max(0, clean) + 0.5) / (n_clean + 1))


def _told(counts: DataFrame, n_tox: int, n_clean: int, least: int) -> list[tuple[str, int, int]]:
    """(key, toxic rows, clean rows) of the keys that tell toxic rows; TRAIN_ROWS texts bound them."""
    sums = counts.groupBy("key").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean")).where(F.col("tox") >= least)
    odds = F.log((F.col("tox") + 0.5) / (n_tox + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    best = sums.withColumn("odds", odds).where(F.col("odds") > 1.0).orderBy(F.desc(F.col("tox") * F.col("odds")), "key")
    return [(r["key"], r["tox"], r["clean"]) for r in best.collect()]


def _lexicon(terms: list[tuple[str, int, int]], n_tox: int, n_clean: int, least: int, without: int | None = None) -> Model:
    """The terms with their weights; `without` a toxic row (1) or a clean one (0) that holds them."""
    weight = {k: max(0.0, _odds(t - (without == 1), c - (without == 0), n_tox, n_clean)) for k, t, c in terms}
    words, stems = {k[1:]: w for k, w in weight.items() if k[0] == "w"}, {k[1:]: w for k, w in weight.items() if k[0] == "s"}
    return Model(words, stems, {k[1:] for k, t, _ in terms if k[0] == "w" and len(k) > FUZZY_FROM and t >= 3 * least})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, shrink = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + shrink, a.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1].tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, train: Column, rows: int = TRAIN_ROWS) -> Model:
    """Learn from the rows of docs that labels covers and `train`, a condition on doc_id, admits."""
    own = labels.where(train & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    own = own.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = texts(docs).join(F.broadcast(picked), "doc_id").cache()  # at most `rows` ids are broadcast
    try:
        seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        n_clean, n_tox = seen.get(0, 0), sum(n for k, n in seen.items() if k)
        if not n_clean or not n_tox:
            return Model(intercept=math.log((n_tox + 1) / (n_clean + 1)))
        least = max(3, math.ceil(0.01 * n_tox))
        terms = _told(_each(sample, _term_counts, "key string, tox long, clean long"), n_tox, n_clean, least)
        model = _lexicon(terms, n_tox, n_clean, least)

        def window_counts(rows: list, labels: list) -> list[tuple[str, int, int]]:
            scorer, both = Scorer(model), (Counter(), Counter())
            for text, toxic in zip(rows, labels):
                text = (text or "").lower()
                hits = scorer.hits(text)
                both[not toxic].update({"c" + w for words, _ in scorer.windows(text, hits) for w in words})
                if not toxic:
                    words = _word.findall(text)
                    both[1].update({"b" + words[i] for i, exact, _ in hits if not exact})
            return _counts(*both)

        around = _each(sample, window_counts, "key string, tox long, clean long").groupBy("key").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean")).cache()
        near = {r["key"][1:]: r["clean"] for r in around.where(F.col("key").startswith("b")).collect()}
        context = _told(around.where(F.col("key").startswith("c")), n_tox, n_clean, max(5, least))
        around.unpersist()
        model.benign, model.context = set(near), {k[1:]: _odds(t, c, n_tox, n_clean) for k, t, c in context}
        others = []
        for toxic in (0, 1):  # for clean and for toxic rows: the model without such a row
            own = _lexicon(terms, n_tox, n_clean, least, toxic)
            own.benign = {w for w, n in near.items() if n > 1} if not toxic else model.benign
            own.context = {k[1:]: max(0.0, _odds(t - (toxic == 1), c - (toxic == 0), n_tox, n_clean)) for k, t, c in context}
            others.append(own)

        def figures(rows: list, labels: list) -> list[tuple[float, ...]]:
            scorers = [Scorer(m) for m in others]
            return [(*scorers[bool(y)].features(t), float(bool(y))) for t, y in zip(rows, labels)]

        names = ", ".join(f"x{i} double" for i in range(N_FEATURES))
        table = np.array([tuple(r) for r in _each(sample, figures, f"{names}, y double").collect()])  # at most `rows` rows of figures
        model.coef, model.intercept = _logistic(table[:, :-1], table[:, -1])
        return model
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([scorer.score(t) for t in part.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def train_rows(id_col: Column) -> Column:
    return crc_mod(id_col, FOLDS).isin([k for k in range(FOLDS) if k != HELD_OUT])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) with a model of the rows outside the held-out fold."""
    scored = score(docs, fit(docs, labels, train_rows(F.col("doc_id"))))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score as toxic."""
    model = fit(docs, labels, train_rows(F.col("doc_id")))

    def make() -> Callable[[str], bool]:
        scorer = Scorer(model)
        return lambda text: scorer.score(text) < threshold

    return filter_rows(docs, make)
