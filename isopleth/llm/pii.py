"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

DataFrame functions only. A pattern's matches and the text between them
alternate, so running sums of their lengths give each match's place without a
function of our own. The patterns are possessive and start only where a run
of their first characters starts (or where the last match ended), which finds
the same leftmost matches in time linear in the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, and the pattern that proposes each. Access keys have a published prefix and length.
KINDS = ("email", "ip", "card", "phone", "iban", "access_key", "secret", "ssn")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A span's score before context, what a context word adds, and the words (lower case) of each kind. Alone, a run of letters
#: and digits or three groups of digits say too little: it is the words nearby that make them a secret or a number of a person.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "access_key": 0.9, "secret": 0.3, "ssn": 0.4}
CONTEXT = {"email": 0.1, "ip": 0.3, "card": 0.2, "phone": 0.2, "iban": 0.1, "access_key": 0.1, "secret": 0.4, "ssn": 0.4}
WORDS = {
    "email": "mail|contact|write|reply",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|llame|appel",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "access_key": "aws|access|key|credential|credentials",
    "secret": "password|passwd|pwd|passwort|token|secret|api key|apikey|api_key|credential|credentials|bearer",
    "ssn": "ssn|social security|taxpayer|tax id",
}
#: What a text must contain for a kind to be looked for at all; without its words a kind whose prior is too low is never kept.
NEEDS = {"email": "@", "phone": "+", "access_key": "IA"}
#: Code points before and after a span that are its context; least score of a span that the method adds to the base kinds.
NEARBY, ADDED_LEAST = 40, 0.5
#: Matches whose places are summed up at a time.
CHUNK = 256
#: The digits of a doubled digit, by digit.
DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn: from the right, every second digit is doubled."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in DOUBLED]), d.cast("int"))))
    return F.aggregate(back, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's number, its first four characters moved to the end and letters as 10 to 35, leaves 1 by 97."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        n = F.length(_digits(value))
        return n.between(12, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    if kind == "secret":  # letters and digits mixed, and not few of them over and over
        letters, digits = F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.length(_digits(value))
        return (letters >= 2) & (digits >= 2) & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    if kind == "ssn":
        return ~(F.substring(value, 1, 3).isin("000", "666") | value.startswith("9") | (F.substring(value, 5, 2) == "00") | (F.substring(value, 8, 4) == "0000"))
    return F.lit(True)


def _pairs(text: Column, kind: str, matches: Column) -> Column:
    """Array of (b, m): the length of the text before each match, from the last one on, and the match."""
    between = F.split(text, PATTERNS[kind], -1)
    return F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))


def _chunk(kind: str, pairs: Column) -> Column:
    """(at, out) of one chunk: its length in code points, and its confirmed matches with places counted from its start."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, value: string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["b"]
        e = s + F.length(p["m"])
        more = F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), p["m"].alias("value"))))
        return F.struct(e.alias("at"), F.when(confirmed(kind, p["m"]), more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, start, step)


def _chunks(kind: str) -> Column:
    pairs = F.col(f"_{kind}")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda j: _chunk(kind, F.slice(pairs, j * CHUNK + 1, F.lit(CHUNK))))


def _moved(chunks: Column) -> Column:
    """The spans of all chunks, with places counted from the text's start."""
    starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.transform(c["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))))


def _ranked(kind: str) -> Column:
    """The spans of a kind's column, made to sort by start, then kind."""
    return F.transform(F.col(f"_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: (doc_id, spans), an array of (start, end, kind, rank, value, score) in the order of start, then kind.

    A proposed match that its validator refuses is dropped and not tried
    again in part. Spans of the base kinds always stay; the others only with
    a score of at least ``ADDED_LEAST``, which secrets and numbers of persons
    reach by a context word alone. Spans of different kinds may overlap; of
    equal starts the kind listed first comes first. Null and empty texts have
    no span; the places in very long texts are summed up in chunks. Null ids
    and repeated rows are returned like others. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    wanted = {k: F.col("text").contains(NEEDS[k]) if k in NEEDS else digit for k in KINDS}
    for k in KINDS:
        if k not in BASE and PRIOR[k] < ADDED_LEAST:
            wanted[k] = wanted[k] & F.col("text").rlike(rf"(?i)\b(?:{WORDS[k]})\b")
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")
    # Steps of their own, so that the patterns run once: the next step uses each column more than once. Sums run over
    # chunks of matches, then over chunks, so that very many matches in one text don't take quadratic time.
    found = base.select("doc_id", "text", *[F.when(wanted[k], F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).alias(f"_{k}") for k in KINDS])
    paired = found.select("doc_id", "text", *[F.when(F.size(f"_{k}") > 0, _pairs(F.col("text"), k, F.col(f"_{k}"))).alias(f"_{k}") for k in KINDS])
    chunked = paired.select("doc_id", "text", *[F.when(F.size(f"_{k}") > 0, _chunks(k)).alias(f"_{k}") for k in KINDS])
    placed = chunked.select("doc_id", "text", *[F.when(F.size(f"_{k}") > 0, _moved(F.col(f"_{k}"))).otherwise(empty).alias(f"_{k}") for k in KINDS])
    every = reduce(F.concat, [_ranked(k) for k in KINDS])
    some = placed.select("doc_id", "text", F.array_sort(every).alias("_all"))

    def scored(s: Column) -> Column:
        near = F.lower(F.concat(F.substring(F.col("text"), F.greatest(F.lit(1), s["start"] + 1 - NEARBY), F.least(s["start"], F.lit(NEARBY))), F.lit(" "), F.substring(F.col("text"), s["end"] + 1, F.lit(NEARBY))))
        score = F.lit(0.0)
        for k in KINDS:
            score = F.when(s["kind"] == k, F.when(near.rlike(rf"\b(?:{WORDS[k]})\b"), round(PRIOR[k] + CONTEXT[k], 6)).otherwise(PRIOR[k])).otherwise(score)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["rank"].alias("rank"), s["value"].alias("value"), score.alias("score"))

    kept = F.filter(F.transform("_all", scored), lambda s: s["kind"].isin(*BASE) | (s["score"] >= ADDED_LEAST))
    return some.select("doc_id", kept.alias("spans"))


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(found: str, kind: str) -> Column:
    """How many spans of a kind there are."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
