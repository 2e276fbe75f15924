"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Everything is a column expression over one row, so there is no shuffle. A
pattern's matches come from ``regexp_extract_all`` and the gaps between them
from ``split`` by the same pattern; their running lengths are the positions.
The patterns are written with possessive quantifiers and start only where a
run starts (or the last match ended), so that a very long word or number costs
linear time; they match exactly what the plain forms of the contract match.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercraft.llm.text import col, fresh, let, whole, without

_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Countries by the length of their account codes (IBAN registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban() -> str:
    """A code's first four characters, with the code as group 1.

    A listed country's code has its length, any other takes the whole run.
    Only the four characters are consumed, so a false start hides no code after it.
    """
    def rest(n: str) -> str:
        return rf"[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}"
    listed = "|".join(v.replace(" ", "|") for v in IBAN_LENGTHS.values())
    codes = [rf"(?:{v.replace(' ', '|')}){rest(str(n - 4))}" for n, v in IBAN_LENGTHS.items()]
    codes.append(rf"(?!{listed})[A-Z]{{2}}{rest('11,30')}")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join(codes)})(?![A-Za-z0-9])))[A-Z0-9]{{4}}"


IBAN = _iban()
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
PATTERNS = dict(zip(BASE_KINDS + ADDED_KINDS, (EMAIL, IP, CARD, PHONE, IBAN, SSN), strict=True))

#: Score of a confirmed span before context, bonus for a context word nearby,
#: how near (code points before the span), and the score an added span needs.
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT_BONUS, CONTEXT_CHARS, MIN_SCORE = 0.3, 48, 0.5
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
}
_CHUNK = 64


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    def step(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0),
                        lambda a, i: a + step(i))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account code (letters count as 10 to 35, first four last) leaves 1 mod 97."""
    bare = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))

    def step(acc, ch):
        v = F.ascii(ch)
        return F.when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(m, r"\.")
        return F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            parts, lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4)
                                        .try_cast("int"), F.lit(0)) <= 255)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(m)
    return ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9")


def _score(kind: str, before: Column) -> Column:
    """The score of a span after the ``CONTEXT_CHARS`` code points ``before``."""
    bonus = F.when(F.regexp_like(F.lower(before), F.lit(rf"\b(?:{CONTEXT[kind]})\b")), CONTEXT_BONUS)
    return F.least(F.lit(1.0), F.lit(START_SCORE[kind]) + bonus.otherwise(0.0))


def _tail(c: Column) -> Column:
    """The last ``CONTEXT_CHARS`` code points of a string."""
    return F.substring(c, -CONTEXT_CHARS, CONTEXT_CHARS)


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _apart(spans: Column) -> Column:
    """Ordered spans less those that start inside the last one kept."""
    def step(acc, s):
        return F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["spans"], F.array(s)).alias("spans"))).otherwise(acc)
    done = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("at"),
                                       F.array().cast(_SPAN).alias("spans")), step)
    meet = F.exists(F.sequence(F.lit(1), F.size(spans) - 1),
                    lambda i: F.get(spans, i)["start"] < F.get(spans, i - 1)["end"])
    return F.when(F.size(spans) < 2, spans).when(meet, done["spans"]).otherwise(spans)


def _spans(kind: str, text: Column) -> Column:
    """The confirmed spans of one kind, by position."""
    pattern = PATTERNS[kind]
    none = F.array().cast(_SPAN)

    def located(matches: Column) -> Column:
        def fold(gaps: Column) -> Column:
            # The context is carried along: taken from the text it would be counted from the text's start.
            def one(acc, i):
                m, gap = F.get(matches, i), F.get(gaps, i)
                start = acc["at"] + F.length(gap)
                used = F.substring(m, 1, 4) if kind == "iban" else m
                before = _tail(F.concat(acc["before"], _tail(gap)))
                span = F.struct(F.lit(kind).alias("kind"), start.cast("bigint").alias("start"),
                                (start + F.length(m)).cast("bigint").alias("end"),
                                _score(kind, before).alias("score"))
                ok = _confirmed(kind, m)
                if kind in ADDED_KINDS:
                    ok = ok & (_score(kind, before) >= MIN_SCORE)
                return F.struct((start + F.length(used)).cast("int").alias("at"),
                                _tail(F.concat(before, _tail(used))).alias("before"),
                                F.when(ok, F.concat(acc["spans"], F.array(span).cast(_SPAN)))
                                .otherwise(acc["spans"]).alias("spans"))

            # Chunks keep the growing arrays short: appending one by one would be quadratic.
            def chunk(acc, c):
                first = c * _CHUNK
                last = F.least(first + _CHUNK, F.size(matches)) - 1
                done = F.aggregate(F.sequence(first, last), F.struct(
                    acc["at"].alias("at"), acc["before"].alias("before"), none.alias("spans")), one)
                return let(done, lambda d: F.struct(
                    d["at"].alias("at"), d["before"].alias("before"),
                    F.concat(acc["spans"], d["spans"]).alias("spans")))
            chunks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _CHUNK).cast("int"))
            return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), none.alias("spans")),
                               chunk)["spans"]
        return F.when(F.size(matches) == 0, none).otherwise(let(F.split(text, pattern, -1), fold))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(int(kind == "iban"))), located)
    if kind == "iban":
        found = let(found, _apart)
    must = {"email": "@", "phone": "+"}.get(kind)
    return F.when(F.instr(text, must) > 0, found).otherwise(none) if must else found


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """Every row of ``docs`` with an array of spans (kind, start, end, score).

    Positions are code points, the end exclusive; spans are ordered by kind
    (email, ip, card, phone, iban, ssn), then start. Base kinds need their
    check (ip parts at most 255; cards of 13 to 19 digits by Luhn; phones of 9
    to 15 digits) and stay whatever their score; iban (mod 97 over as many
    characters as its country has; the leftmost of overlapping ones) and ssn need
    ``MIN_SCORE``, which ssn reaches by a context word only. Null and empty
    texts have no spans; repeated rows are judged alike; an input column called
    like the new one is replaced; an empty table gives an empty result.
    """
    docs = without(docs, spans_col)
    parts = fresh(docs, *[f"__pii_{k}" for k in PATTERNS])
    # A first projection per kind keeps each expression small enough to analyse quickly.
    found = docs.select("*", *[let(whole(col(text_col)), partial(_spans, k)).alias(c)
                               for k, c in zip(PATTERNS, parts, strict=True)])
    return found.select(*map(col, docs.columns),
                        F.concat(*[F.col(c) for c in parts]).alias(spans_col))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by ``[KIND]``; where spans overlap, the leftmost longest stays."""
    (spans,) = fresh(docs, "__spans")
    found = find_pii(docs, text_col, spans)

    def cut(text, ordered):
        def step(acc, s):
            return F.when(s["start"] >= acc["at"], F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"),
                                                 (s["start"] - acc["at"]).cast("int")),
                         F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))).otherwise(acc)
        done = F.aggregate(ordered, F.struct(F.lit(0).cast("bigint").alias("at"),
                                             F.lit("").alias("out")), step)
        return let(done, lambda d: F.concat(d["out"], F.substring(
            text, (d["at"] + 1).cast("int"), F.length(text))))
    order = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("neg"), s["end"].alias("end"),
        s["kind"].alias("kind"))))
    out = let(whole(col(text_col)), lambda t: cut(t, order))
    return found.select(*[F.when(F.size(spans) > 0, out).otherwise(col(c)).alias(c)
                          if c == text_col else col(c) for c in docs.columns])


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: reduce(lambda a, k: a | (s["kind"] == k), BASE_KINDS,
                                            F.lit(False)))
