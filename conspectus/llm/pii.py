r"""Personal data: expressions propose spans, checksums confirm them, context words adjust scores.

DataFrame functions only. A kind's spans come from one expression applied twice:
regexp_extract_all gives the matches and split the text between them, whose
lengths in code points sum up to positions.

Expressions are written so that the engine's work stays in proportion to the text
and its stack stays flat: separators that stand between two digits (or dots
between two label characters) are first replaced by U+0001, one for one, so that a
number is a plain run of a character class; runs are entered at their start only.
A U+0001 of the text itself is first made U+0002, which no expression takes.

Base kinds follow fixed rules and always stay. The other kinds are kept from a
score of ``KEEP`` on: each has a prior, raised by its checksum and by context words
within ``WINDOW`` code points before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = (*BASE, *ADDED)
WINDOW, KEEP = 40, 0.6
#: Prior, gain of a confirmed checksum and gain of a context word.
PRIOR = {"email": (0.9, 0.0, 0.1), "ip": (0.6, 0.2, 0.2), "card": (0.3, 0.5, 0.2), "phone": (0.6, 0.2, 0.2), "iban": (0.2, 0.6, 0.2), "ssn": (0.3, 0.1, 0.4)}
CONTEXT = {
    "email": "mail|contact|write to", "ip": r"\bip\b|host|server|address", "card": "card|visa|master|amex|credit|payment",
    "phone": "phone|call|tel|fax|mobile", "iban": "iban|account|bank|konto|cuenta|compte", "ssn": r"\bssn\b|social security|security number",
}
TAG = {k: f"<{k.upper()}>" for k in KINDS}

_MARK = "\u0001"
_DIGIT_MARKS = ("(?<=[0-9])[ -](?=[0-9])", _MARK)
_LABEL_MARKS = (r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)
#: Characters of an IBAN by country, as registered.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_START = "[A-Z]{2}[0-9]{2}"
_IBAN = "|".join(
    [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items()]
    + [rf"(?!{'|'.join(_IBAN_LENGTHS.values()).replace(' ', '|')}){_IBAN_START}(?: ?[A-Z0-9]){{11,30}}"]
)
_LOCAL = r"A-Za-z0-9._%+\x01-"
_EXPRESSION = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9\x01])(?:[0-9]\x01?){11,18}[0-9](?![0-9\x01])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # what follows a country's length is left alone, and every start is tried: only the first four characters are consumed
    "iban": rf"(?<![A-Za-z0-9])(?={_IBAN_START})(?=({_IBAN})(?![A-Za-z0-9])){_IBAN_START}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Characters that a match consumes, where its span is the expression's first group.
_CONSUMED = {"iban": 4}
#: A text without this cannot have a span of the kind, and skips the expression.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice")),
        lambda acc, c: F.struct(
            (acc["sum"] + F.when(~acc["twice"], c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10)).alias("sum"),
            (~acc["twice"]).alias("twice"),
        ),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _confirmed(kind: str, match: Column) -> Column:
    """Whether a match passes its kind's checks."""
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        n = F.length(_digits(match))
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(kind: str, text: Column, source: Column) -> Column:
    """The confirmed and scored spans of one kind, in order of place."""
    shape = "array<struct<kind:string,start:int,end:int,score:double>>"
    pattern, consumed = F.lit(_EXPRESSION[kind]), _CONSUMED.get(kind)
    pieces = F.transform(
        F.arrays_zip(F.regexp_extract_all(source, pattern, F.lit(1 if consumed else 0)).alias("m"), F.split(source, _EXPRESSION[kind], -1).alias("g")),
        lambda x: F.struct(x["m"].alias("m"), F.length(x["g"]).alias("g"), F.length(x["m"]).alias("n")),
    )
    placed = F.aggregate(
        F.filter(pieces, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<m:string,start:int,end:int>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + (F.lit(consumed) if consumed else x["n"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["n"]).alias("end")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    prior, check, near = PRIOR[kind]

    def scored(x: Column) -> Column:
        begin = F.greatest(x["start"] - WINDOW, F.lit(0))
        before = F.lower(F.substring(text, begin + 1, x["start"] - begin))
        score = F.lit(prior + check) + F.when(before.rlike(CONTEXT[kind]), near).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(score, 3).alias("score"))

    spans = F.transform(F.filter(placed, lambda x: _confirmed(kind, x["m"])), scored)
    if kind in ADDED:
        spans = F.filter(spans, lambda x: x["score"] >= KEEP)
    if consumed:  # confirmed spans that overlap become one
        last = lambda acc: F.try_element_at(acc, F.lit(-1))
        spans = F.aggregate(
            spans.cast(shape),
            F.expr(f"cast(array() as {shape})"),
            lambda acc, x: F.when((F.size(acc) == 0) | (last(acc)["end"] <= x["start"]), F.concat(acc, F.array(x))).otherwise(
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["kind"].alias("kind"), last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"), F.greatest(last(acc)["score"], x["score"]).alias("score"))))
            ),
        )
    if kind in _NEEDS:
        spans = F.when(F.contains(source if kind != "email" else text, F.lit(_NEEDS[kind])), spans)
    return F.coalesce(spans.cast(shape), F.expr(f"cast(array() as {shape})"))


def find(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add ``into``: array of (kind, start, end, score), ordered by start, then kind as listed.

    Places are code points, ends exclusive. Spans of one kind do not overlap; those of
    different kinds may. A null or empty text has none. Other columns stay as they are;
    the helper columns are named so that they clash with none.
    """
    free = lambda name: next(n for n in (f"{name}{i or ''}" for i in range(1 << 20)) if n not in docs.columns)
    plain, digits, labels = free("__plain"), free("__digits"), free("__labels")
    own = {k: free(f"__{k}") for k in KINDS}
    with_plain = docs.withColumn(plain, F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, "\u0002"))
    marked = with_plain.withColumns(
        {
            digits: F.regexp_replace(plain, *map(F.lit, _DIGIT_MARKS)),
            labels: F.when(F.contains(plain, F.lit("@")), F.regexp_replace(plain, *map(F.lit, _LABEL_MARKS))).otherwise(""),
        }
    )
    source = {"email": labels, "card": digits}
    found = marked.withColumns({own[k]: _spans(k, F.col(plain), F.col(source.get(k, plain))) for k in KINDS})
    rank = F.create_map(*[F.lit(x) for pair in ((k, i) for i, k in enumerate(KINDS)) for x in pair])
    every = F.concat(*[F.col(own[k]) for k in KINDS])
    keyed = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["score"].alias("score"))))
    ordered = F.transform(keyed, lambda x: F.struct(x["kind"], x["start"], x["end"], x["score"]))
    return found.withColumn(into, ordered).drop(plain, digits, labels, *own.values())


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind's tag, and n_chars as it then is.

    Of overlapping spans the first is replaced, and the others as far as they reach
    beyond it. A null text stays null. All rows and columns stay.
    """
    spans = next(n for n in (f"__spans{i or ''}" for i in range(1 << 20)) if n not in docs.columns)
    found = find(docs, into=spans)
    tag = F.create_map(*[F.lit(x) for pair in TAG.items() for x in pair])
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, x: F.when(
            x["end"] > acc["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.element_at(tag, x["kind"]))).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    out = found.withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(F.col("text"))).drop(spans)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def report(docs: DataFrame) -> DataFrame:
    """Per document the counts and digest of base spans, and all spans: see find()."""
    found = find(docs.select("doc_id", "text"), into="found")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("top_score"))
