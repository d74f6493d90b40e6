"""Personal data by weak supervision, in DataFrame functions only.

Base recognizers find e-mail addresses, IP addresses, payment cards and phone numbers; their spans always stay. Three more
kinds have no sure pattern and are added: secrets (passwords, tokens, keys), bank accounts (IBAN) and names of persons.
Candidates are cast wide: every long mixed run of letters and digits, every value that follows a word that names secrets
and an assignment, whatever its length, every run of the form of an account number, every run of two to four capitalized
words. Four labelers of each kind vote on its candidates: a regular expression or checksum, a gazetteer, the context before
the value, and its shape. Expectation-maximisation over the counts of vote patterns estimates how often each labeler is
right without any labels; its posteriors are the soft labels from which the final span classifier of the kind, naive Bayes
over votes, length and letters of the span, is trained. Only counts of patterns (a few hundred at most) reach the driver.

Patterns use possessive loops and start guards, which match the same spans in linear time on very long texts; places are
summed up in blocks of about the root of the number of matches, so a text of very many matches takes n times root n steps.

Defined cases: a null or empty text has no spans; spans are code points with the end exclusive; an added span never
overlaps a base span or an added span of a kind listed before its own; without candidates nothing is added; repeated rows
give equal rows; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "name")
KINDS = (*BASE, *ADDED)
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Words that name secrets, in English, German, French and Spanish.
_SECRET_WORDS = (
    "token", "password", "passwd", "pwd", "passphrase", "passcode", "secret", "api[ _-]?key", "access[ _-]?key", "private[ _-]?key", "secret[ _-]?key", "signing[ _-]?key",
    "auth", "bearer", "credential", "client[ _-]?secret", "session[ _-]?id", "pin", "passwort", "kennwort", "schlüssel", "geheimnis", "mot de passe", "clé", "jeton",
    "contraseña", "clave", "ficha",
)
NAMES = "|".join(_SECRET_WORDS)
#: Countries of the registry of account numbers (ISO 13616) and how long their numbers are.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Common given names in the same four languages.
GIVEN_NAMES = (
    "Adam Alejandro Alexander Alice Amelia Ana Andrea Andrew Anna Anne Antonio Barbara Benjamin Bernd Camille Carla Carlos Carmen Catherine Charles Charlotte Chloe Christian "
    "Christine Claire Claudia Daniel David Diego Dieter Dominique Elena Elizabeth Emily Emma Eric Eva Fernando Francois Francisco Frank Gabriel George Hans Heike Helen Henry "
    "Isabel Jack Jacques James Jan Javier Jean Jennifer Jessica Joao John Jonas Jorge Jose Joseph Juan Julia Julie Jurgen Karen Karl Katrin Klaus Laura Lena Leon Linda Lisa "
    "Louis Lucas Lucia Luis Manuel Marc Maria Marie Mark Markus Marta Martin Mary Matthew Max Michael Michel Miguel Monika Nathalie Nicolas Nina Olivia Pablo Patricia Patrick "
    "Paul Paula Pedro Peter Philippe Pierre Rafael Richard Robert Rosa Samuel Sandra Sarah Sofia Sophie Stefan Stephen Susan Sven Thomas Thorsten Tim Uwe Victor Wolfgang"
).split()
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra?|Don|Doña)\.?"
_CAPITAL = r"\p{Lu}(?:\p{L}++(?:['’-]\p{L}++)*+|\.)"
_VALUE = r"[^\s\"',;]{4,}+"
_ASSIGNED = r"s?[\"']?\s{0,3}(?:[=:]|is)\s{0,3}[\"']?"
#: A match may start at the end of the last one or where no longer run of its first letters starts before.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+={0,2}+",
    "named secret": rf"(?i)(?<=(?<!\p{{L}})(?:{NAMES}){_ASSIGNED})(?<=[\s\"'=:]){_VALUE}",
    "name": rf"(?<![\p{{L}}.]){_CAPITAL}(?:\x20{_CAPITAL}){{1,3}}+",
}
#: What a text must hold for a kind to be sought in it at all.
GUARDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "[0-9]",
    "named secret": rf"(?i)(?:{NAMES}){_ASSIGNED}", "name": rf"{_CAPITAL}\x20\p{{Lu}}",
}
VOTES, CONTEXT, STEPS, ACCEPT = 4, 48, 60, 0.5
#: Matches that are always summed up at once.
LEAST_BLOCK = 32
SPAN, FOUND = "struct<start:bigint,kind:int,end:bigint>", "struct<start:bigint,end:bigint,value:string,before:string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _blocks(items: Column, kind: str) -> Column:
    """An array cut into runs of about the root of its size."""
    size = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(F.size(items))).cast("int"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), size), lambda i: F.slice(items, i, size))
    return F.when(F.size(items) > 0, cut).otherwise(F.array().cast(f"array<array<{kind}>>"))


def _found(text: Column, kind: str, context: int = 0) -> Column:
    """array of (start, end, value, before) of the non-overlapping matches."""
    matches, parts = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)

    def pair(m: Column, p: Column) -> Column:
        before = F.right(p, F.lit(context)) if context else F.lit("")
        return F.struct(F.char_length(p).cast("long").alias("gap"), F.char_length(m).cast("long").alias("n"), m.alias("value"), before.alias("before"))

    pairs = F.zip_with(matches, F.slice(parts, 1, F.size(matches)), pair)

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def within(block: Column) -> Column:
        """Spans of a block, counted from its start, and its whole length."""
        return F.aggregate(block, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{FOUND}>").alias("out")), add)

    def shift(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def joined(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), shift)["out"]
        moved = lambda block, at: F.transform(block["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value"), s["before"].alias("before")))
        return F.flatten(F.zip_with(blocks, begins, moved))

    pair_type = "struct<gap:bigint,n:bigint,value:string,before:string>"
    return _let(pairs, lambda p: _let(F.transform(_blocks(p, pair_type), within), joined))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda x: (F.char_length(part(x)) <= 2) | ((F.char_length(part(x)) == 3) & (F.lpad(part(x), 3, "0") <= "255")))
    if kind == "card":
        n = F.char_length(_digits(value))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def _mod97(value: Column) -> Column:
    """The remainder that is 1 for a right account number: its first four letters moved to the end, letters as two digits."""
    bare = F.regexp_replace(value, " ", "")
    letters = F.split(F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.substring(bare, 1, 4)), "")
    code = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(letters, F.lit(0), lambda a, c: F.when(code(c) > 9, (a * 100 + code(c)) % 97).otherwise((a * 10 + code(c)) % 97))


def _votes(kind: str, value: Column, before: Column) -> Column:
    """The labelers' votes as bits: format, gazetteer, context, shape."""
    n, digits = F.char_length(value), F.char_length(_digits(value))
    if kind == "secret":
        votes = [
            value.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?:sk|pk|ghp|gho|xox[abp])[_-][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|(?=[A-Za-z0-9+/]*[+/=])(?:[A-Za-z0-9+/]{4}){5,}[A-Za-z0-9+/]{0,4}={0,2})$"),
            F.lower(before).rlike(rf"(?:{NAMES})s?[\"']?\s{{0,3}}(?:[=:]|is)?\s{{0,3}}[\"']?$"),
            before.rlike(r"[=:]\s{0,3}[\"']?$"),
            (n >= 16) & (digits * 10 >= n * 2) & (digits * 10 <= n * 9) & ~value.rlike("[/_-]"),
        ]
    elif kind == "iban":
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        length = F.try_element_at(lengths, F.substring(value, 1, 2))
        votes = [
            _mod97(value) == 1,
            length.isNotNull(),
            F.lower(before).rlike(r"(?:iban|account|bank|konto|compte|cuenta|bic|swift)[^\n]{0,24}$"),
            length == F.char_length(F.regexp_replace(value, " ", "")),
        ]
    else:
        first = F.translate(F.regexp_extract(value, r"^\p{L}+", 0), "áàâäãéèêëíîïóôöõúûüçñ", "aaaaaeeeeiiioooouuucn")
        votes = [
            value.rlike(rf"^{TITLES}\x20") | before.rlike(rf"(?:^|[^\p{{L}}]){TITLES}\x20$"),
            first.isin(GIVEN_NAMES),
            F.lower(before).rlike(r"(?:name(?: is)?|i am|signed|contact|author|attn|dear|regards|from|ich bin|je suis|soy|nom|nombre)[\s:,]{1,3}$"),
            (F.size(F.split(value, " ")) <= 3) & ~before.rlike(r"(?:^|[.!?:\n]\s{0,3})$"),
        ]
    return reduce(lambda a, b: a + b, [F.when(v, 1 << i).otherwise(0) for i, v in enumerate(votes)])


def _look(value: Column) -> Column:
    """What the classifier sees besides the votes: length in eights (to 40) and kind of letters."""
    letters = F.when(value.rlike("^[0-9a-fA-F]+$"), 0).when(value.rlike("^[0-9A-Za-z]+$"), 1).otherwise(2)
    return F.least(F.floor(F.char_length(value) / 8), F.lit(5)).cast("int") * 3 + letters


def _base_spans(text: Column, k: int) -> Column:
    valid = F.filter(_found(text, KINDS[k]), lambda s: _valid(KINDS[k], s["value"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def _free(spans: Column, of: Column, kind: str) -> Column:
    """The spans that overlap none of the ordered spans `of`, which are gone through block by block."""

    def block(b: Column) -> Column:
        return F.struct(b.alias("spans"), F.get(b, 0)["start"].alias("low"), F.array_max(F.transform(b, lambda x: x["end"])).alias("high"))

    def kept(blocks: Column) -> Column:
        meets = lambda b, s: (b["start"] < s["end"]) & (s["start"] < b["end"])
        return F.filter(spans, lambda s: ~F.exists(blocks, lambda b: (b["low"] < s["end"]) & (s["start"] < b["high"]) & F.exists(b["spans"], lambda x: meets(x, s))))

    return F.when(F.size(spans) == 0, spans).when(F.size(of) == 0, spans).otherwise(_let(F.transform(_blocks(of, kind), block), kept))


CANDIDATE = "struct<start:bigint,kind:int,end:bigint,votes:int,look:int>"


def _candidates(text: Column, kind: str, pattern: str) -> Column:
    def candidate(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), _votes(kind, s["value"], s["before"]).alias("votes"), _look(s["value"]).alias("look"))

    return F.when(text.rlike(GUARDS[pattern]), F.transform(_found(text, pattern, CONTEXT), candidate)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates): base spans (start, kind number, end) and candidates with votes and look; one pass over the texts."""
    text = F.col("text")
    base = [F.when(text.rlike(GUARDS[kind]), _base_spans(text, k)).otherwise(F.array().cast(f"array<{SPAN}>")) for k, kind in enumerate(BASE)]
    own = {name: _candidates(text, "secret" if name == "named secret" else name, name).alias(name.replace(" ", "_")) for name in (*ADDED, "named secret")}
    rows = texts(docs).select("doc_id", F.array_sort(F.concat(*base)).alias("base"), *own.values())
    runs = F.array_sort(F.col("secret"))
    secret = F.concat("secret", _free(F.col("named_secret"), runs, CANDIDATE))  # a value found both ways is one candidate
    rows = rows.select("doc_id", "base", F.concat("iban", secret, "name").alias("candidates"))
    return rows.withColumn("candidates", _free(F.col("candidates"), F.col("base"), SPAN))


def estimate(patterns: dict[int, float], steps: int = STEPS) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """Two-class EM over counts of vote patterns: (posterior of each pattern, each labeler's rates of voting on secrets and on others)."""
    share = {p: (0.02 + 0.96 * p.bit_count() / VOTES) for p in patterns}
    rates = [(0.5, 0.5)] * VOTES
    for _ in range(steps):
        ones = sum(n * share[p] for p, n in patterns.items())
        zeros = sum(n * (1 - share[p]) for p, n in patterns.items())
        prior = (ones + 1) / (ones + zeros + 2)
        rates = []
        for i in range(VOTES):
            hit1 = sum(n * share[p] for p, n in patterns.items() if p >> i & 1)
            hit0 = sum(n * (1 - share[p]) for p, n in patterns.items() if p >> i & 1)
            rates.append(((hit1 + 2) / (ones + 3), (hit0 + 1) / (zeros + 3)))  # labelers are taken to be better than chance
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            for i, (a, b) in enumerate(rates):
                odds += math.log(a / b) if p >> i & 1 else math.log((1 - a) / (1 - b))
            share[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return share, rates


Weights = dict[tuple[str, int], float]


def train(scanned: DataFrame) -> dict[int, Weights]:
    """By kind number, weights of the span classifier: ("bias", 0), ("v<labeler>", vote) and ("look", value); none for a kind without candidates."""
    each = scanned.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.look").count().collect()  # at most 3 x 16 x 18 rows
    return {kind: _weights([(r["votes"], r["look"], r["count"]) for r in each if r["kind"] == kind]) for kind in sorted({r["kind"] for r in each})}


def _weights(each: list[tuple[int, int, int]]) -> Weights:
    patterns: dict[int, float] = {}
    for votes, _, n in each:
        patterns[votes] = patterns.get(votes, 0) + n
    share, _ = estimate(patterns)
    ones = sum(n * share[p] for p, n in patterns.items())
    zeros = sum(n * (1 - share[p]) for p, n in patterns.items())
    soft: dict[tuple[str, int], list[float]] = {}
    for votes, look, n in each:
        for key in [*((f"v{i}", votes >> i & 1) for i in range(VOTES)), ("look", look)]:
            pair = soft.setdefault(key, [0.0, 0.0])
            pair[0] += n * share[votes]
            pair[1] += n * (1 - share[votes])
    weights = {key: math.log((a + 1) / (ones + 2)) - math.log((b + 1) / (zeros + 2)) for key, (a, b) in soft.items()}
    return weights | {("bias", 0): math.log((ones + 1) / (zeros + 1))}


def _accepted(weights: Weights, votes: Column, look: Column, accept: float = ACCEPT) -> Column:
    """Whether the classifier takes a candidate; one that no more than its shape speaks for is never taken."""
    score = F.lit(weights[("bias", 0)])
    for i in range(VOTES):
        score = score + F.when(F.getbit(votes, F.lit(i)) == 1, weights.get((f"v{i}", 1), 0.0)).otherwise(weights.get((f"v{i}", 0), 0.0))
    looks = [(v, w) for (name, v), w in sorted(weights.items()) if name == "look"]
    score = score + reduce(lambda c, x: c.when(look == x[0], x[1]), looks[1:], F.when(look == looks[0][0], looks[0][1])).otherwise(0.0)
    return (score > math.log(accept / (1 - accept))) & ((votes.bitwiseAND(7)) > 0)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind number, end), ordered; spans holds base and what the classifiers add."""
    rows = materialize(scan(docs), "pii")
    rows, spans = rows.withColumn("spans", F.col("base")), F.col("spans")
    for kind, weights in train(rows).items():
        kept = F.filter("candidates", lambda c: (c["kind"] == kind) & _accepted(weights, c["votes"], c["look"]))  # noqa: B023
        added = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
        rows = rows.withColumn("added", _free(added, spans, SPAN)).withColumn("spans", F.array_sort(F.concat("spans", "added")))
    return rows.select("doc_id", "base", "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: reduce(lambda c, i: c.when(k == i, KINDS[i]), range(1, len(KINDS)), F.when(k == 0, KINDS[0]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def mask(docs: DataFrame, spans: DataFrame, fill: str = "*") -> DataFrame:
    """(doc_id, text) with each span's code points replaced by `fill`; for unique doc_ids."""
    cut = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("spans", i - 1)["end"]).alias("a"), F.coalesce(F.get("spans", i)["start"], F.char_length("text").cast("long")).alias("b")))
    parts = F.transform(cut, lambda c: F.concat(F.when(c["a"] > 0, F.lit(fill)).otherwise(""), F.substring(F.col("text"), (c["a"] + 1).cast("int"), F.greatest(c["b"] - c["a"], F.lit(0)).cast("int"))))
    return texts(docs).join(spans.select("doc_id", "spans"), "doc_id").select("doc_id", F.array_join(parts, "").alias("text"))
