"""Goldens of the title normalizer, derived by hand from its rules."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import textnorm
from quarry.functions.lemma import NoLemmas, NounPlurals

PRE_LEMMA = {
    'Harbor 3.0 Rolling Suitcase with Quiet Casters | 30" SUITCASE | Moss Green (2-Piece Set)': "harbor 3.0 rolling suitcase quiet casters 30 inch suitcase moss green",
    "Meridian II Softshell Trolley with Wheels, Deep Teal, 4-Piece Set (18/22/26)": "meridian 2 softshell trolley wheels deep teal 4 pieces set",
    "Children's Wool Ankle Warm Anti-slip House Slippers Set of 3": "children s wool ankle warm anti slip house slippe pieces set",
    "Runner's 4TB Portable SSD - 3.9 stars with 150 reviews - Bestseller!": "runner s 4 tb portable ssd",
    "6pk linen towels, 24oz, ivory": "6 pack linen towels 24 oz ivory",
    "Kestrel VIII Folding Bicycle (Model QX9876-ZR)": "kestrel 8 folding bicycle",
}
FINAL = {
    None: "",
    "": "",
    "spinners 20 inch": "spinne inch",
    "v-neck tee": "neck tee",
    "2 in 1 brush": "inch brush",
    "w/lid pan": "withlid pan",
    "sizes 3-5": "sizes",
    "sizes 20-24": "sizes 20 inch 24 inch",
    "b08xyz1234 shoe": "shoe",
    "tom &amp; jerry &lt;b&gt;mug&lt;/b&gt;": "tom jerry mug",
    "ﬁne caﬀé": "fine caffé",
    '20"x30" frame': "20 inchx30 inch frame",
    "s m l x tee": "s m l tee",
    "1234567890123 cups": "cups",
    "grey 100% wool": "gray 100 wool",
    "dates 10/12/2020": "dates 10 12 2020",
    "empty () chunk": "empty chunk",
    "été façon": "été façon",
}


def cleaned(spark, texts, lemmatizer):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["c"] for r in textnorm.clean_text(rows, "t", "c", lemmatizer).orderBy("i").collect()]


def test_pre_lemma_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(PRE_LEMMA)], "i int, t string")
    for stage in textnorm.STAGES:
        rows = rows.withColumn("t", stage(F.col("t")))
    found = [r["x"] for r in rows.select("i", F.array_join(textnorm.pre_lemma_tokens(F.col("t")), " ").alias("x")).orderBy("i").collect()]
    assert found == list(PRE_LEMMA.values())


def test_final_text(spark):
    assert cleaned(spark, list(FINAL), NoLemmas()) == list(FINAL.values())


def test_cleaning_is_idempotent_on_plain_words(spark):
    words = ["red cotton shirt", "blue luggage set", "wool sock"]
    once = cleaned(spark, words, NounPlurals())
    assert cleaned(spark, once, NounPlurals()) == once == words


@pytest.mark.parametrize("form, lemma", [("shoes", "shoe"), ("dresses", "dress"), ("batteries", "battery"), ("glass", "glass"), ("women", "woman"), ("boxes", "box"), ("bus", "bus"), ("inch", "inch"), ("watches", "watch")])
def test_noun_plurals(spark, form, lemma):
    assert spark.range(1).select(NounPlurals()(F.array(F.lit(form)))[0]).first()[0] == lemma


def test_lexicon_goes_first(spark):
    assert spark.range(1).select(NounPlurals({"ran": "run"})(F.array(F.lit("ran")))[0]).first()[0] == "run"
