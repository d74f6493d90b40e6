"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

Templates and texts are sequences of words (runs of letters and digits, lower-cased) and their five-word shingles.
Templates of like size form a class; texts are cut into windows of twice the class's size at half their width, so every
passage of a template's size lies whole in one window. Each of ROUNDS seeded hashes deals the shingles of a window or
template to BINS bins, and the least hash of each bin is a band (MinHash by one permutation a round). Window and template
meet where they share a band: a shared shingle is one unless a lesser hash lies in its bin. Among w shingles of a window
and m of a template that happens with probability 1 - exp(-(w + m) / 2 BINS) at most; the hardest case is a template of one
shingle, which a window of its class (12 shingles) hides with 0.025 a round and 4e-7 in all four; templates of more
shingles would have to lose all they share. Exact containment of the template's shingles then decides.

Only windows that hold one of a few words of a template of their class are made, and only texts that hold such a word are
split into words: the words are chosen so that their shingles outnumber those a match may miss, hence neither a text nor a
window without any of them can match.

Defined cases: null and empty texts match nothing; a text or template of under five words is one shingle, so
such a template matches texts equal to it only; several
windows that match one template are one row with the best containment and the first such window; repeated rows stay
apart by their row; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import texts

SHINGLE, CONTAINMENT = 5, 0.8
ROUNDS, BINS = 4, 256
#: Notices as their licenses word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(words: list[str], k: int = SHINGLE) -> list[str]:
    return sorted({" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}) if words else []


def must_words(words: list[str], containment: float = CONTAINMENT, k: int = SHINGLE) -> set[str]:
    """Words (longest first) whose shingles are more than a match may miss."""
    shingles = shingles_of(words, k)
    most_missing = int((1 - containment) * len(shingles) + 1e-9)
    chosen: set[str] = set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(any(x in chosen for x in s.split(" ")) for s in shingles) > most_missing:
            break
        chosen.add(w)
    return chosen


def _shingles(words: Column, k: int = SHINGLE) -> Column:
    """Distinct hashes of the word shingles."""
    last = F.greatest(F.size(words) - k + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " "))))


def size_classes(templates: dict[str, str]) -> dict[int, dict[str, list[str]]]:
    """Templates by size class: powers of two of their number of words."""
    found = defaultdict(dict)
    for name, text in templates.items():
        if words := words_of(text):
            found[1 << (len(words) - 1).bit_length()][name] = words
    return dict(found)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it: the optimizer would copy it to each place."""
    return F.get(F.transform(F.array(value), use), 0)


def _holds(text: Column, words: set[str]) -> Column:
    """Whether the text holds any of the words; one that holds another is implied by it."""
    least = sorted(w for w in words if not any(v != w and v in w for v in words))
    return _once(F.lower(text), lambda low: reduce(or_, [low.contains(w) for w in least], F.lit(False)))


def _windows(words: Column, classes: dict[int, set[str]]) -> Column:
    """(size, at, words) of each window of each class that holds one of the class's words: each place lies in two windows."""
    every = sorted(set().union(*classes.values()))
    places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda p: p["word"].isin(every))

    def of(size: int, own: set[str], places: Column) -> Column:
        held = F.filter(places, lambda p: p["word"].isin(sorted(own)))
        both = F.flatten(F.transform(held, lambda p: F.array(p["at"] - p["at"] % F.lit(size), p["at"] - p["at"] % F.lit(size) - size)))
        cuts = F.array_distinct(F.filter(both, lambda at: at >= 0))
        return F.transform(cuts, lambda at: F.struct(F.lit(size).alias("size"), at.alias("at"), F.slice(words, at + 1, 2 * size).alias("words")))

    none = F.array().cast("array<struct<size:int,at:int,words:array<string>>>")
    return _once(places, lambda p: F.concat(none, *[of(size, own, p) for size, own in classes.items()]))


def _bands(shingles: Column) -> Column:
    """The least hash of each bin in each round; a hash tells its round and bin."""

    def dealt(seed: int) -> Column:
        hashed = F.transform(shingles, lambda h: F.xxhash64(F.lit(seed), h))
        ordered = F.array_sort(F.transform(hashed, lambda h: F.struct(F.pmod(h, F.lit(BINS)).alias("bin"), h.alias("value"))))

        def least(x: Column) -> Column:
            first = F.filter(x, lambda e, i: (i == 0) | (F.get(x, i - 1)["bin"] != e["bin"]))
            return F.transform(first, lambda e: e["value"])

        return F.get(F.transform(F.array(ordered), least), 0)

    return F.concat(*[dealt(seed) for seed in range(1, ROUNDS + 1)])


def _template_rows(spark: SparkSession, classes: dict[int, dict[str, list[str]]]) -> DataFrame:
    """(size, license, wanted, bands): the shingles and bands of each template."""
    rows = spark.createDataFrame([(size, name, words) for size, own in classes.items() for name, words in own.items()], "size int, license string, words array<string>")
    return rows.withColumn("wanted", _shingles(F.col("words"))).withColumn("bands", _bands(F.col("wanted"))).drop("words")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): one row for each document row and license it holds."""
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    classes = size_classes(templates)
    must = {size: set().union(*(must_words(x, containment) for x in own.values())) for size, own in classes.items()}
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id()).where(_holds(F.col("text"), set().union(*must.values())))
    rows = rows.select("row", "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)).alias("words"))
    windows = rows.select("row", "doc_id", F.explode(_windows(F.col("words"), must)).alias("window")).select("row", "doc_id", "window.*")
    windows = windows.withColumn("held", _shingles(F.col("words"))).drop("words")
    wanted = _template_rows(spark, classes)
    bands = {(r["size"], r["license"]): r["bands"] for r in wanted.collect()}  # a few templates
    some = sorted({v for own in bands.values() for v in own})

    def licenses(held: Column) -> Column:
        meets = [F.when((F.col("size") == size) & F.arrays_overlap(held, F.array(*map(F.lit, own))), name) for (size, name), own in bands.items()]
        return F.array_compact(F.array(*meets))

    met = windows.withColumn("license", F.explode(_once(F.filter(_bands(F.col("held")), lambda v: v.isin(some)), licenses)))
    pairs = met.join(F.broadcast(wanted.drop("bands")), ["size", "license"])  # a few templates
    share = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
    out = pairs.select("row", "doc_id", "license", "at", share.alias("share")).where(F.col("share") >= containment)
    best = F.max(F.struct("share", -F.col("at"))).alias("best")
    found = out.groupBy("row", "doc_id", "license").agg(best, F.count_distinct("at").alias("n_windows"))
    return found.select("doc_id", "license", F.col("best.share").alias("containment"), (-F.col("best.col2")).alias("first_word"), "n_windows")
