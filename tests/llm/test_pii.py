"""PII spans against a plain reading of the patterns with Python's re."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quoinlake.llm import pii
from quoinlake.llm.pii import pii_query, redact, report, with_spans


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def brute(text):
    text = text or ""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([ -]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn_ok(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban_ok),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


def expected(text):
    spans = brute(text)
    base = ",".join(s for s in spans if not s.startswith("iban"))
    return tuple(sum(s.startswith(k) for s in spans) for k in pii.KINDS) + (hashlib.sha256(base.encode()).hexdigest(), ",".join(spans))


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[f"n_{k}"] for k in pii.KINDS) + (r["base_sha256"], r["spans"]) for r in report(with_spans(df, "text"), "doc_id").collect()}
    for i, t in enumerate(texts):
        assert got[i] == expected(t), (t or "")[:200]


HAND = [
    None, "", " ", "a@b.c", "a@b.c.@d.e", "x a@b@c.d y", "a@b.c_d@e.f", "..a@b.c.", "a@.b", "ä@b.de 😀 me@x.org",
    "1.2.3.4", "001.2.3.255", "1.2.3.256 9.9.9.9", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111x",
    "4111  1111 1111 1111", "41111111111111112", "+1 (547) 555-0128", "+1", "+12345678", "+49.30.1234567-", "++491234567890",
    "IBAN GB82 WEST 1234 5698 7654 32 ok", "GB83WEST12345698765432", " a@b.c  +1 547 555 0128",
    "a@b." + "c." * 5000 + "d", "1 " * 6000, "1" * 30000, "." * 3000 + "@x.y", "+1" + "-" * 5000 + "2", "a" * 20000 + "@",
    "a-b@c--d.e-f card 4111111111111111 call +1 547 555 0128",
]


def test_hand_written_cases(spark):
    check(spark, HAND)


def test_random_strings_of_pattern_characters(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab1+.@- ()4é") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(r.choice("0123456789 -.+") for _ in range(r.randint(10, 80))) for _ in range(1500)]
    check(spark, texts)


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii_query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) + (r["base_sha256"], r["spans"]) == expected(texts[r["doc_id"]])


def test_redaction_merges_overlaps_and_keeps_other_columns(spark):
    df = spark.createDataFrame(
        [(1, "é mail me@x.org or +1 547 555 0128, ip 10.0.0.1.", 5), (2, None, 6), (3, "", 7), (4, "12345678@1.2.3.4", 8)],
        "doc_id long, text string, score int",
    )
    got = {r["doc_id"]: (r["text"], r["score"]) for r in redact(with_spans(df, "text"), "text").collect()}
    assert got == {1: ("é mail [EMAIL] or [PHONE], ip [IP].", 5), 2: (None, 6), 3: ("", 7), 4: ("[EMAIL]", 8)}


def test_context_words_raise_the_score(spark):
    df = spark.createDataFrame([(1, "+1 547 555 0128"), (2, "phone +1 547 555 0128")], "doc_id long, text string")
    got = {r["doc_id"]: r["scores"] for r in report(with_spans(df, "text"), "doc_id").collect()}
    assert got == {1: "0.6", 2: "0.7"}


def test_no_rows_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = report(with_spans(df, "text"), "doc_id")
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
    assert with_spans(df.withColumn("pii", F.lit(1)), "text").columns == ["doc_id", "text", "pii"]


def test_ibans_are_found_whatever_stands_beside_them(spark):
    gb, de, no = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947"
    texts = {
        f"{gb} BY Friday": [gb], f"pay {gb} 100 EUR": [gb], f"{gb} {de} {no} A1": [gb, de, no], f"{no} 5 {de} OK": [no, de],
        f"NO12 345 {gb} BY": [gb], f"XX12 {de}": [de], f"{de}X {gb[:-1]}3 NOW": [], "GB82 WEST 1234 5698 7654 3 2 BY": ["GB82 WEST 1234 5698 7654 3 2"],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in report(with_spans(df, "text"), "doc_id").collect()}
    for i, (text, ibans) in enumerate(texts.items()):
        spans = [s.split(":") for s in got[i].split(",") if s.startswith("iban")]
        assert [text[int(a) : int(b)] for _, a, b in spans] == ibans, text
    fixed = redact(with_spans(df.where("doc_id = 0"), "text"), "text").first()["text"]
    assert fixed == "[IBAN] BY Friday"
