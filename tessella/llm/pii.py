"""Personal data in text, by DataFrame functions alone.

Regular expressions propose spans; checksums and ranges confirm them (Luhn for cards, mod-97 for
IBANs, octets for addresses, groups for IPv6, digit counts for phones, entropy for secrets); words within ``CONTEXT`` code points,
as far as the text up to the next span of the kind goes, move a
span's score. Base kinds (email, ip, card, phone) keep every confirmed span whatever its score. The
method adds ``iban`` and ``ipv6`` (confirmed is enough), and where context
words lift the score over ``THRESHOLD``: ``national_id`` (ddd-dd-dddd), ``local_phone`` (without a country's number) and ``secret`` (a long
run of letters and digits as keys and tokens have).

The expressions below match what the plain ones do (or, for cards, only those of a right number of digits), but take no more than linear time and no deep
stack on long runs: a run is entered at its start only (or where the last match ended), and loops are possessive where
nothing that follows could make them give back. Places are sums of lengths, taken by blocks of about the root of the number of
matches, so a text of n code points and m matches costs about n + m sqrt(m).

Edge cases: a null or empty text has no span; positions count code points, end exclusive; repeated
rows each get their own result; other columns are kept (one named as the result is replaced).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ipv6": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}+(?![0-9A-Za-z:])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+])(?<![0-9][\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+",
}
BASE = ("email", "ip", "card", "phone")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ipv6": 0.6, "national_id": 0.4, "local_phone": 0.4, "secret": 0.4}
WORDS = {
    "email": "mail|e-mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|amex",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ipv6": "ip|ipv6|host|server|address",
    "national_id": "ssn|social|security|taxpayer|identity",
    "local_phone": "phone|call|tel|telephone|mobile|cell|fax",
    "secret": "token|key|apikey|secret|password|passwd|pwd|credential|credentials|bearer|auth|authorization",
}
CONTEXT, BONUS, THRESHOLD = 40, 0.3, 0.5
#: Bits a character that a secret has at least.
ENTROPY = 3.0

_SPAN = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is taken once: inside a lambda a plain expression would be taken again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""
    first = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice"))

    def add(acc: Column, c: Column) -> Column:
        d = F.ascii(c) - 48
        d = F.when(acc["twice"], F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return F.when(c == "", acc).otherwise(F.struct((acc["sum"] + d).alias("sum"), (~acc["twice"]).alias("twice")))

    return F.aggregate(F.split(F.reverse(digits), ""), first, add, lambda acc: acc["sum"]) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN's letters and digits pass ISO 7064 mod 97-10."""
    s = F.regexp_replace(text, " ", "")
    s = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: _let(F.regexp_replace(p, "^0+(?=.)", ""), lambda b: (F.length(b) <= 3) & (F.substring(b, 1, 3).cast("int") <= 255)))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ipv6":
        groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
        return m.rlike("[0-9]") & ~m.rlike("::.*::") & F.when(m.contains("::"), groups.between(3, 7)).otherwise(groups == 8)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (entropy(m) >= ENTROPY)
    return F.lit(True)


def entropy(s: Column) -> Column:
    """Bits a character of a string by how often each character is in it."""

    def add(acc: Column, c: Column) -> Column:
        p = (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / F.length(s)
        return F.when(c == "", acc).otherwise(_let(p, lambda p: acc - p * F.log2(p)))

    return F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), add)


def _starts(sizes: Column) -> Column:
    """The sum of all ``sizes`` (an array of long; a lambda's variable) before each: by blocks, whose own sums come first."""
    none, zero = F.expr("cast(array() as array<bigint>)"), F.lit(0).cast("long")
    n = F.size(sizes)

    def blocks(block: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), lambda k: F.slice(sizes, k * block + 1, block))

    def before(values: Column, base: Column) -> Column:
        first = F.struct(none.alias("out"), base.alias("at"))
        step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + x).alias("at"))
        return F.aggregate(values, first, step, lambda acc: acc["out"])

    def whole(b: Column) -> Column:
        return F.flatten(F.zip_with(b, before(F.transform(b, lambda x: F.aggregate(x, zero, lambda acc, y: acc + y)), zero), before))

    return F.when(n == 0, none).otherwise(_let(F.ceil(F.sqrt(n)).cast("int"), lambda block: _let(blocks(block), whole)))


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, in order, each with its score."""
    found = F.struct(F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0)).alias("m"), F.split(text, KINDS[kind], -1).alias("g"))

    def zipped(x: Column) -> Column:
        n = F.size(x["m"])
        return F.arrays_zip(F.slice(x["g"], F.lit(1), n).alias("g"), x["m"].alias("m"), F.slice(x["g"], F.lit(2), n).alias("h"))

    def placed(each: Column) -> Column:
        starts = _let(F.transform(each, lambda x: (F.length(x["g"]) + F.length(x["m"])).cast("long")), _starts)
        return F.zip_with(each, starts, lambda x, at: F.struct(x["m"].alias("m"), x["g"].alias("g"), x["h"].alias("h"), (at + F.length(x["g"])).alias("a")))

    good = F.filter(_let(_let(found, zipped), placed), lambda s: _confirmed(kind, s["m"]))

    def scored(s: Column) -> Column:
        near = F.lower(F.concat(F.right(s["g"], F.lit(CONTEXT)), F.lit(" "), F.left(s["h"], F.lit(CONTEXT)))).rlike(rf"(?<![a-z])(?:{WORDS[kind]})(?![a-z])")
        score = F.when(near, F.least(F.lit(1.0), F.lit(PRIOR[kind] + BONUS))).otherwise(F.lit(PRIOR[kind]))
        return F.struct(F.lit(kind).alias("kind"), s["a"].cast("long").alias("start"), (s["a"] + F.length(s["m"])).cast("long").alias("end"), score.alias("score"))

    out = F.transform(good, scored)
    if kind not in BASE:
        out = F.filter(out, lambda s: s["score"] >= THRESHOLD)
    needs = {"email": "@", "phone": "+", "national_id": "-", "ipv6": ":"}.get(kind)
    there = text.rlike(KINDS[kind])
    return F.when((text.contains(needs) & there) if needs else there, out).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def with_spans(docs: DataFrame, text: str = "text", into: str = "_pii") -> DataFrame:
    """``docs`` with a column ``into``: a struct with one array of spans for each kind."""
    whole = F.coalesce(F.col(common.quoted(text)).cast("string"), F.lit(""))
    return docs.withColumn(into, F.struct(*[spans_of(whole, k).alias(k) for k in KINDS]))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans by that which starts first."""
    found = with_spans(docs, text)
    spans = F.array_sort(F.transform(F.flatten(F.array(*[F.col("_pii")[k] for k in KINDS])), lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("z"), s["kind"].alias("k"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["a"] - acc["at"]).cast("int"))
        return F.when(s["a"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], gap, F.lit("["), s["k"], F.lit("]")).alias("out"), (-s["z"]).alias("at")))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(F.col(text))))

    return found.withColumn(text, F.aggregate(spans, start, add, end)).drop("_pii")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts of every kind and of all, a digest of the base spans, all spans, and their scores in the same order."""
    docs = with_spans(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda kinds, f: F.array_join(F.flatten(F.array(*[F.transform(F.col("_pii")[k], f) for k in kinds])), ",")
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    counts = [F.size(F.col("_pii")[k]).cast("long") for k in KINDS]
    return docs.select("doc_id", *[c.alias(f"n_{k}") for c, k in zip(counts, KINDS, strict=True)], sum(counts[1:], counts[0]).alias("n_spans"), F.sha2(joined(BASE, said), 256).alias("base_sha256"), joined(KINDS, said).alias("spans"), joined(KINDS, lambda s: F.format_number(s["score"], 2)).alias("scores"))
