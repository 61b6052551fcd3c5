import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from conspectus.llm import pii

EXPRESSIONS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    out = []
    for rank, (kind, rx) in enumerate(EXPRESSIONS.items()):
        for m in rx.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(rows).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i].spans)
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in pii.BASE] == want
        assert got[i].n_card == sum(s.startswith("card") for s in want)


def test_base_spans_agree_with_python(spark):
    texts = [
        None, "", "a@b.c", "😀 x@y.zz_d@e.ff a.b@c", "1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3.4", "4111 1111-1111 1111 4111111111111111x 79927398713",
        "+1 (988) 555-2485 +12 +49.30/123", "call +1234567890123456 or ++1 2 3 4 5 6 7 8 9", "a@b..c a@b.c..d a@-.-", "x" * 30000, "1" * 30000, "1 " * 20000,
        "a." * 20000 + "@b.c", "a@" + "b." * 20000 + "c", "\x01 4\x011 1@\x01.c a\x01b@c.d \x02", "٣.1.2.3 1.2.3.٤", "4041894974608795", "0-0 0-0 0-0 0-0 0-0 0-0 0",
    ]
    check(spark, texts)


def test_random_texts_agree_with_python(spark):
    rng = random.Random(5)
    parts = ["@", ".", "-", " ", "+", "(", ")", "1", "23", "4111111111111111", "ab", "é", "_", "%", "\n", "😀", "255", "0", "\x01"]
    check(spark, ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000)])


def test_added_spans_need_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "code DE89370400440532013000", "DE89370400440532013001", "ssn 123-45-6789", "ref 123-45-6789"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.spans for r in pii.report(rows).orderBy("doc_id").collect()]
    kinds = [[s.split(":")[0] for s in g.split(",") if s] for g in got]
    assert [("iban" in k, "ssn" in k) for k in kinds] == [(True, False), (True, False), (False, False), (False, True), (False, False)]


def test_ibans_end_at_their_country_length(spark):
    good = {
        "DE89 3704 0044 0532 0130 00": "{} BIC COBADEFFXXX", "DE89370400440532013000": "{} 2024", "GB82 WEST 1234 5698 7654 32": "😀 {} SWIFT", "NO93 8601 1117 947": "{} 1 A {}",
        "MT84MALT011000012345MTLCAST001S": "{} {} X", "FR14 2004 1010 0505 0001 3M02 606": "GB12 {} 7", "BE68 5390 0754 7034": "AB13 {} NL91ABNA0417164300",
    }
    texts = [t.format(*[code] * t.count("{}")) for code, t in good.items()]
    bad = ["DE89370400440532013001 2024", "DE893704004405320130002024", "DE89 3704 0044 0532 0130 0", "xDE89370400440532013000 A", "DE89370400440532013000x", "GB82 WEST 1234 5698 7654 33 SWIFT", "AB12 CD34 EF56"]
    rows = spark.createDataFrame(list(enumerate(texts + bad)), "doc_id long, text string")
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("iban")] for r in pii.report(rows).collect()}
    want = {i: [(m.start(), m.end()) for m in re.finditer(f"{code}|NL91ABNA0417164300", texts[i])] for i, code in enumerate(good)}
    assert got == want | {len(texts) + i: [] for i in range(len(bad))}
    clean = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert clean[0] == "<IBAN> BIC COBADEFFXXX" and clean[6] == "AB13 <IBAN> <IBAN>" and clean[3] == "<IBAN> 1 A <IBAN>"


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "write a@b.cc or 1.2.3.4!", "x", 0, "s"), (2, None, "y", 0, "s"), (3, "clean", "z", 5, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __email string, n_chars long, __spans string")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "write <EMAIL> or <IP>!" and out[1].n_chars == len(out[1].text) and out[1]["__email"] == "x"
    assert out[2].text is None and out[3].text == "clean" and list(out[1].asDict()) == docs.columns


def test_empty_table_and_repeats(spark):
    schema = "doc_id long, text string"
    assert pii.report(spark.createDataFrame([], schema)).count() == 0
    assert pii.report(spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c")], schema)).count() == 2


@pytest.mark.parametrize("code", ["79927398713", "4111111111111111"])
def test_luhn(spark, code):
    assert spark.range(1).select(pii.luhn(F.lit(code)).alias("x")).first().x == luhn(code)
