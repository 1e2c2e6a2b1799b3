"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Only built-in column expressions are used. A pattern's matches are put between two marks
that the text cannot hold; splitting at the marks gives matches and what lies between, and
the running length of the pieces gives the offsets, in code points.

Repeated groups recurse in Java's regular expressions and would overflow the stack on long
runs. Where the pattern has one, separators that stand where the group does not allow them
are first replaced by another mark of the same length; what is left is a single character
class. Lookbehinds keep a failed long run from being tried again at each of its characters.

Defined results: NULL text has no spans and stays NULL when redacted; empty text has none;
marks that occur in a text are read as another private character, which no pattern holds;
each row is judged alone, so repeated rows repeat their result; other columns are kept.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, SHUT, STAND_IN, APART, DOT = "", "", "", "", ""
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]

_LOCAL = rf"[A-Za-z0-9._%+\-{DOT}]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?=[A-Za-z0-9-]++\.)[A-Za-z0-9-][A-Za-z0-9.-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]{11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Length of an IBAN by country; further countries have none that is known here.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
IBAN_START = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11})"
IBAN_ENDS = (rf"^(?:{_BY_LENGTH})(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IBAN_CHARS = 70  # the longest IBAN with a blank before each character, and what follows it
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

#: Score of a confirmed span by itself, what a context word adds, and the words.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_GAIN, CONTEXT_CHARS = 0.1, 40
CONTEXT = {
    "email": "mail|contact|write|address|adresse|correo",
    "ip": r"\bip\b|server|host|login|client",
    "card": "card|visa|credit|payment|tarjeta|carte|karte",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|konto|compte|cuenta",
}


def _let(c: Column, f) -> Column:
    """f(c) with c computed once for all its uses."""
    return F.transform(F.array(c), f)[0]


def _plain(c: Column) -> Column:
    marks = [OPEN, SHUT, APART, DOT]
    any_mark = F.contains(c, F.lit(OPEN))
    for m in marks[1:]:
        any_mark = any_mark | F.contains(c, F.lit(m))
    return F.when(any_mark, F.translate(c, "".join(marks), STAND_IN * 4)).otherwise(c)


def _matches(c: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost matches that do not overlap."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    pieces = F.split(F.regexp_replace(c, pattern, f"{OPEN}$0{SHUT}"), f"[{OPEN}{SHUT}]", -1)

    def take(acc: Column, piece: Column) -> Column:
        end = acc["pos"] + F.char_length(piece)
        hit = F.struct(acc["pos"].alias("start"), end.alias("end"), piece.alias("match"))
        return F.struct(
            end.alias("pos"), (~acc["hit"]).alias("hit"),
            F.when(acc["hit"], F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(False).alias("hit"), none.alias("out"))
    return _let(pieces, lambda p: F.when(F.size(p) > 1, F.aggregate(p, zero, take, lambda a: a["out"])).otherwise(none))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    def add(acc: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return acc + F.when(x["i"] % 2 == 0, x["d"]).when(twice > 9, twice - 9).otherwise(twice)

    chars = F.filter(F.split(F.reverse(digits), ""), lambda s: s != "")
    numbered = F.transform(chars, lambda s, i: F.struct(s.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN without blanks has remainder 1."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda s: s != "")

    def add(acc: Column, s: Column) -> Column:
        code = F.ascii(s)
        return F.when(code <= 57, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(chars, F.lit(0), add) == 1


def _ibans(text: Column) -> Column:
    """Confirmed IBANs. Every start is tried, by the country's length first, so that what follows or precedes one hides none."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    pieces = F.split(F.regexp_replace(text, IBAN_START, OPEN), OPEN, -1)

    def take(acc: Column, piece: Column) -> Column:
        near = F.substr(text, (acc["pos"] + 1).cast("int"), F.lit(IBAN_CHARS))
        ends = F.filter(
            F.array(*[F.regexp_extract(near, p, 0) for p in IBAN_ENDS]),
            lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))),
        )
        end = acc["pos"] + F.char_length(F.get(ends, F.lit(0)))
        hit = F.struct(acc["pos"].alias("start"), end.alias("end"), F.get(ends, F.lit(0)).alias("match"))
        fresh = (acc["pos"] >= acc["free"]) & (F.size(ends) > 0)
        return F.struct(
            (acc["pos"] + F.char_length(piece)).alias("pos"), F.when(fresh, end).otherwise(acc["free"]).alias("free"),
            F.when(fresh, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"),
        )

    def all_of(p: Column) -> Column:
        zero = F.struct(F.char_length(p[0]).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("free"), none.alias("out"))
        return F.when(F.size(p) > 1, F.aggregate(F.slice(p, 2, F.size(p)), zero, take, lambda a: a["out"])).otherwise(none)

    return _let(pieces, all_of)


def _proposed(text: Column) -> dict[str, Column]:
    """Confirmed matches of each kind, each found on the text with its own stray marks."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    lone_dot = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"
    lone_gap = r"(?<![0-9])[ -]|[ -](?![0-9])"

    def within(digits: Column, low: int, high: int) -> Column:
        return F.char_length(digits).between(low, high)

    email = F.when(at, _matches(F.regexp_replace(text, lone_dot, DOT), EMAIL)).otherwise(none)
    ip = F.filter(
        F.when(digit, _matches(text, IP)).otherwise(none),
        lambda m: F.forall(F.split(m["match"], r"\."), lambda p: p.rlike(OCTET)),
    )
    card = F.filter(
        F.when(text.rlike("[0-9](?:[ -]?[0-9]){11}"), _matches(F.regexp_replace(text, lone_gap, APART), CARD)).otherwise(none),
        lambda m: within(_digits(m["match"]), 12, 19) & luhn(_digits(m["match"])),
    )
    phone = F.filter(
        F.when(F.contains(text, F.lit("+")), _matches(text, PHONE)).otherwise(none),
        lambda m: within(_digits(m["match"]), 9, 15),
    )
    iban = F.when(digit, _ibans(text)).otherwise(none)
    return dict(zip(KINDS, (email, ip, card, phone, iban)))


def _scored(text: Column, kind: str, found: Column) -> Column:
    """Spans as struct<start, order, end, kind, score>, so that their own order is that of the report."""
    def one(m: Column) -> Column:
        begin = F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.concat(
            F.substr(text, begin.cast("int") + 1, (m["start"] - begin).cast("int")), F.lit(" "),
            F.substr(text, m["end"].cast("int") + 1, F.lit(CONTEXT_CHARS)),
        )
        gain = F.when(F.lower(near).rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), m["end"].alias("end"),
            F.lit(kind).alias("kind"), (F.lit(SCORES[kind]) + gain).alias("score"),
        )

    return F.transform(found, one)


def with_spans(df: DataFrame, text: str, out: str = "pii") -> DataFrame:
    """Add the confirmed spans of `text`, in order of start and kind."""
    def spans(t: Column) -> Column:
        return F.array_sort(F.concat(*[_scored(t, k, found) for k, found in _proposed(t).items()]))

    return df.withColumn(out, _let(_plain(F.coalesce(F.col(text), F.lit(""))), spans))


def redact(df: DataFrame, text: str, spans: str = "pii", least: float = 0.5) -> DataFrame:
    """Replace spans of at least the score by their kind; spans that overlap become one."""
    def take(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col(text), (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        tag = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = s["start"] >= acc["pos"]
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, tag))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("out"))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col(text), (a["pos"] + 1).cast("int")))
    kept = F.filter(spans, lambda s: s["score"] >= least)
    return df.withColumn(text, F.when(F.size(kept) > 0, F.aggregate(kept, zero, take, rest)).otherwise(F.col(text)))


def _listed(spans: Column) -> Column:
    told = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(told, ",")


def report(df: DataFrame, key: str, spans: str = "pii") -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    base = F.filter(spans, lambda s: s["kind"] != "iban")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in KINDS]
    counts = [(F.size(kinds) - c).cast("bigint").alias(f"n_{k}") for k, c in zip(KINDS, counts)]
    scores = F.array_join(F.transform(spans, lambda s: F.format_string("%.1f", s["score"])), ",")
    return df.select(
        key, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col(spans)).alias("spans"),
        scores.alias("scores"),
    )


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report(with_spans(docs, "text"), "doc_id")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: personal data is replaced by its kind; every document stays."""
    fixed = redact(with_spans(docs, "text", "_pii"), "text", "_pii").drop("_pii")
    return fixed.withColumn("n_chars", F.char_length("text").cast("bigint"))
