"""Rule data of the title normalizer, as ordered (pattern, replacement) pairs in Java's dialect.

Fixed values: spellings, units, words and their order decide the normalized text and are given as the rules state them.
Identity replacements and rules that an earlier rule makes unreachable are left out.
"""

NUMBER = r"(\d+(?:\.\d+)?)\s*"

#: Quote characters to their plain forms.
SMART_QUOTES, PLAIN_QUOTES = "”“’′", "\"\"''"

#: Canonical unit -> spellings; a word unit ends at a word boundary, the quote marks need none.
QUOTE_UNITS = (("inch", '"'), ("feet", "'"))
WORD_UNITS = (
    ("inch", ("inches", "inch", "in")),
    ("cm", ("cm", "centimeters", "centimetre")),
    ("mm", ("mm", "millimeter", "millimetre")),
    ("ml", ("ml", "millilitre", "milliliter")),
    ("l", ("l", "ltr", "liter", "litre")),
    ("kg", ("kg", "kilogram", "kilograms")),
    ("g", ("g", "gram", "grams", "gm", "gms")),
    ("lb", ("lb", "lbs", "pound", "pounds")),
    ("oz", ("oz", "ounce", "ounces")),
    ("tb", ("tb", "terabyte", "terabytes")),
    ("gb", ("gb", "gigabyte", "gigabytes")),
    ("mb", ("mb", "megabyte", "megabytes")),
)
UNITS = [(NUMBER + mark, f"$1 {unit}") for unit, mark in QUOTE_UNITS] + [(rf"{NUMBER}(?:{'|'.join(words)})\b", f"$1 {unit}") for unit, words in WORD_UNITS]

#: A run of numbers joined by slashes or hyphens; sizes between the bounds are inches.
GROUP = r"\b\d+(?:[/\-]\d+)+\b"
INCH_FROM, INCH_TO = 8, 200

SKU_START = r"^\b(?=[A-Za-z0-9-]{6,})[A-Za-z0-9-]+\b"
SKU_TOKEN, SKU_CHUNK_LENGTH, SKU_TOKEN_LENGTH, LONG_NUMBER = r"^[A-Za-z0-9-]+$", 6, 8, 12

ABBREVIATIONS = [
    (r"\bw/o\b", "without"),
    (r"\bw/\b", "with"),
    (r"\bqty\b", "quantity"),
    (r"\bpcs\b", "pieces"),
    (r"\bpc\b", "piece"),
    (r"\bpk\b", "pack"),
    (r"\bpkts\b", "packets"),
    (r"\bpkg\b", "package"),
    (r"\bct\b", "count"),
    (r"\bcts\b", "counts"),
    (r"\bfl oz\b", "fl_ounce"),
    (r"\bfl\.?oz\b", "fl_ounce"),
    (r"\bblk\b", "black"),
    (r"\bwht\b", "white"),
    (r"\bgry\b", "gray"),
    (r"\bgrn\b", "green"),
    (r"\bbrn\b", "brown"),
    (r"\bblu\b", "blue"),
    (r"\bslv\b", "silver"),
    (r"\bgld\b", "gold"),
    (r"\btbsp\b", "tablespoon"),
    (r"\btsp\b", "teaspoon"),
]

PACKS = [
    (r"\b(\d+)[- ]?(?:pc|pcs|piece|pieces)\b", "$1 pieces"),
    (r"\b(\d+)[- ]?p\b", "$1 pack"),
    (r"\b(\d+)[- ]?pk\b", "$1 pack"),
    (r"\b(\d+)[- ]?ct\b", "$1 count"),
    (r"\bset of (\d+)\b", "$1 piece set"),
    (r"(\d+)\s*[- ]?\s*piece\s*[- ]?\s*set", "$1 piece set"),
    (r"(\d+)[- ]?piece\b", "$1 pieces"),
    (r"(\d+)[- ]?pack\b", "$1 pack"),
]

NOISE = [
    r"\b\d+(?:\.\d+)?\s*stars?\b",
    r"\b\d+\s*reviews?\b",
    r"\bbestseller\b",
    r"\btop[- ]?rated\b",
    r"\bnew arrival\b",
    r"\bfree shipping\b",
    r"\blimited edition\b",
    r"\bhot deal\b",
    r"\bsave\s*\d+%?\b",
    r"\bbought\s+\d+\s+times\b",
]

#: No boundary before the currency: `rs` at the end of a word counts.
PRICES = [r"(?:₹|\$|usd|inr|rs\.?|eur|€)\s*\d+[,\d]*(?:\.\d+)?", r"\b(?:price|mrp|rs|inr|usd|aud|eur)\b"]

#: Of the colour names only this one changes after the abbreviations.
COLORS = [(r"\bgrey\b", "gray")]

ROMAN = [(rf"\b{numeral}\b", digits) for numeral, digits in (("ii", "2"), ("iii", "3"), ("iv", "4"), ("v", "5"), ("vi", "6"), ("vii", "7"), ("viii", "8"), ("ix", "9"), ("xi", "11"))]

STOPWORDS = ("for", "and", "with", "the", "a", "an", "of", "on", "by", "new", "its", "our")
ONE_LETTER_SIZES = ("s", "m", "l")

#: Words that the word tokenizer splits in two.
SPLIT_WORDS = [(r"\bcannot\b", "can not"), (r"\bgimme\b", "gim me"), (r"\bgonna\b", "gon na"), (r"\bgotta\b", "got ta"), (r"\blemme\b", "lem me"), (r"\bwanna\b", "wan na")]
