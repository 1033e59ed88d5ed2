"""Personal data: candidate spans from generous patterns, judged by gradient-boosted trees, in DataFrame expressions only.

Base spans come from fixed patterns and checks and always stay. Beside them, generators propose spans that may overlap each other:
national phone numbers (with or without separators, in pairs), mail addresses with "at" and "dot" spelt out, account numbers in upper or
lower case, identity numbers with hyphens or spaces, IPv6 addresses (whole or with ``::``), card-like numbers of other lengths. Each candidate has features of its format (digits, groups, checksum) and its context (what is written before
it and on either side). Boosted trees, trained on a small labelled table, give log-odds; a logistic curve fitted on labelled rows that the trees
have not seen turns them into probabilities, and each kind has the least threshold at which its precision there reaches a
target. Of overlapping candidates the likeliest stays; one that overlaps a base span goes.

The trees are written out as column expressions and every step works within its row: nothing is shuffled, and a text's spans
stay with it. Patterns are possessive and do not start inside a run they have failed on, so they take time linear
in the text and no deep stack. Running sums go over an array in blocks, so many spans in one text do not cost a square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm import gbt

# Base kinds in their order, with patterns that find what the plain ones find.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|\([0-9]{2,5}\) ?[0-9]{5,9}|[0-9]{2}(?:[ .-][0-9]{2}){3,5}|[0-9]{3,5}[ ./-][0-9]{5,9}|[0-9]{3}[.-][0-9]{4}|[0-9]{7,12})(?![0-9-])",
    "card": r"(?<![0-9.+-])[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{3,5}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}(?:-[0-9]{2}-| [0-9]{2} )[0-9]{4}(?![0-9-])",
    # in lower case, what stands after a space goes on with the number only up to a digit, not through plain words
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2} ?[a-z0-9]{4}(?:[a-z0-9]{4}| (?=[a-z]{0,3}[0-9]|[a-z]{4} ?[a-z]{0,3}[0-9])[a-z0-9]{4}){2,6}(?:[a-z0-9]{1,3}| (?=[a-z]{0,2}[0-9])[a-z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z:_])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Za-z:_])",
}
KINDS = ["email", "ip", "card", "phone", "ssn", "iban"]
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = {
    "phone": "tel|phone|call|fax|mobile|cell|dial|contact|whatsapp",
    "card": "card|visa|master|amex|credit|debit|payment",
    "ssn": "ssn|social|security|tax|identity",
    "iban": "iban|account|bank|transfer|konto|compte",
    "email": "mail|contact|write|reach",
    "ip": "ipv6|address|host|server|client|from",
    "other": "page|isbn|order|version|section|chapter|part|item|serial|invoice|ref|doi|sku|model|released|dated",
}
BEFORE = 30
BLOCK = 64
SPAN = "struct<kind:string,start:int,end:int>"

# Labelled candidates to learn from, as text before, candidate, text after, and whether it is personal data.
# Each line is repeated with the fillers, which carry no label.
FILLERS = ["", "the erin of ", "und nicht schkeit. "]
LABELLED = [
    ("phone", "call me at ", "555-123-4567", " today", 1), ("phone", "tel ", "(030) 1234 5678", ".", 1), ("phone", "phone: ", "020 7946 0958", "", 1),
    ("phone", "fax ", "212-555-0187", ", thanks", 1), ("phone", "contact ", "(415) 555-2671", " now", 1), ("phone", "mobile ", "079 4609 5811", "", 1),
    ("phone", "dial ", "800.555.0199", " for help", 1), ("phone", "whatsapp ", "(212) 555-0100", "", 1), ("phone", "cell: ", "646 555 0134", ".", 1),
    ("phone", "order ", "100-200-300", " shipped", 0), ("phone", "pages ", "120-1400-1500", "", 0), ("phone", "part ", "555.123.4567", "", 0),
    ("phone", "version ", "10.2021.3000", " is out", 0), ("phone", "item ", "212-555-0187", "", 0), ("phone", "between ", "100 200 300", " of them", 0),
    ("phone", "isbn ", "978 3161 4841", "-0", 0), ("phone", "range ", "1990 2000 2010", "", 0), ("phone", "the ", "12 345 678", " rows", 0),
    ("phone", "serial ", "020 7946 0958", "", 0), ("phone", "sku ", "079-460-9581", "", 0), ("phone", "scores ", "11 222 333", " and", 0),
    ("ssn", "ssn ", "078-05-1120", "", 1), ("ssn", "social security ", "219-09-9999", ".", 1), ("ssn", "tax id ", "457-55-5462", "", 1), ("ssn", "identity number ", "123-45-6789", "", 1),
    ("ssn", "SSN: ", "536-90-4399", "", 1), ("ssn", "part ", "078-05-1120", "", 0), ("ssn", "order ", "219-09-9999", "", 0), ("ssn", "item ", "100-20-3000", " left", 0),
    ("ssn", "section ", "111-11-1111", "", 0), ("ssn", "the ", "000-00-0000", " mask", 0), ("ssn", "serial ", "457-55-5462", "", 0),
    ("card", "amex card ", "3782 822463 10005", "", 1), ("card", "credit card ", "371449635398431", "", 1), ("card", "card no ", "378734493671000", ".", 1), ("card", "payment with ", "3714 496353 98431", "", 1),
    ("card", "debit card ", "30569309025904", "", 1), ("card", "order ", "378282246310006", "", 0), ("card", "invoice ", "1234 567890 12345", "", 0), ("card", "serial ", "371449635398431", "", 0),
    ("card", "the ", "20210101120000", " build", 0), ("card", "ref ", "30569309025904", "", 0), ("card", "isbn ", "9783161484100", "", 0), ("card", "number ", "1111 222222 33333", "", 0),
    ("iban", "iban ", "DE89 3704 0044 0532 0130 00", "", 1), ("iban", "account ", "GB82WEST12345698765432", "", 1), ("iban", "bank transfer to ", "FR1420041010050500013M02606", "", 1), ("iban", "IBAN: ", "ES9121000418450200051332", ".", 1),
    ("iban", "konto ", "DE44500105175407324931", "", 1), ("iban", "model ", "AB12 CDEF GHIJ KLMN", "", 0), ("iban", "serial ", "XY99ABCDEFGHIJKLMNOP", "", 0), ("iban", "sku ", "ZZ10AAAA2222BBBB3333", "", 0),
    ("iban", "ref ", "GB82WEST12345698765432", "", 0), ("iban", "the code ", "QA01TEST2222TEST3333", "", 0),
    ("email", "mail ", "john.doe (at) example.com", "", 1), ("email", "write to ", "jane[at]example[dot]org", ".", 1), ("email", "contact ", "a.b (at) mail (dot) example (dot) net", "", 1), ("email", "reach me: ", "me (at) home.example.org", "", 1),
    ("email", "by ", "max.m [at] firma [dot] de", "", 1), ("email", "meeting ", "noon (at) office.we", " talk", 0), ("email", "item ", "5 (at) 3.50", " each", 0), ("email", "sold ", "10 (at) 2.25", "", 0),
    ("email", "the part ", "7 (at) 1.10", " unit", 0), ("email", "order ", "12[at]4.99", "", 0),
    ("ip", "client ", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "", 1), ("ip", "host ", "fe80:0:0:0:202:b3ff:fe1e:8329", "", 1), ("ip", "address ", "2001:db8:0:1:1:1:1:1", "", 1), ("ip", "from ", "2a00:1450:4001:81b:0:0:0:200e", "", 1),
    ("ip", "section ", "1:2:3:4:5:6:7:8", "", 0), ("ip", "ref ", "10:20:30:40:50:60:70:80", "", 0), ("ip", "chapter ", "1:1:1:1:1:1:1:1", "", 0), ("ip", "part ", "0:0:0:0:0:0:0:0", "", 0),
    # other forms
    ("phone", "call ", "5551234567", "", 1), ("phone", "tel ", "01 23 45 67 89", ".", 1), ("phone", "phone ", "(030) 12345678", "", 1), ("phone", "mobile: ", "0171 2345678", "", 1), ("phone", "fax ", "06.12.34.56.78", "", 1), ("phone", "contact ", "030/1234567", " now", 1),
    ("phone", "dial ", "555-0134", ".", 1), ("phone", "cell ", "2125550187", " today", 1), ("phone", "whatsapp ", "(0711) 234567", "", 1), ("phone", "call me at ", "02 98 76 54 32", "", 1), ("phone", "phone no ", "4155552671", "", 1), ("phone", "tel: ", "089-9876543", "", 1),
    ("phone", "order ", "5551234567", "", 0), ("phone", "serial ", "01 23 45 67 89", "", 0), ("phone", "the ", "20210101", " build", 0), ("phone", "item ", "0171 2345678", "", 0), ("phone", "has ", "1234567", " rows", 0), ("phone", "version ", "12.34.56.78.90", "", 0),
    ("phone", "between ", "10 20 30 40", " of them", 0), ("phone", "invoice ", "555-0134", "", 0), ("phone", "sum ", "1000000000", "", 0), ("phone", "dated ", "2021-0101", "", 0), ("phone", "id ", "4155552671", "", 0), ("phone", "ref ", "030/1234567", "", 0),
    ("ssn", "ssn ", "078 05 1120", "", 1), ("ssn", "social security ", "219 09 9999", ".", 1), ("ssn", "tax id ", "457 55 5462", "", 1), ("ssn", "order ", "078 05 1120", "", 0), ("ssn", "the ", "100 20 3000", " left", 0), ("ssn", "serial ", "219 09 9999", "", 0),
    ("iban", "iban ", "de89 3704 0044 0532 0130 00", "", 1), ("iban", "account ", "gb82west12345698765432", "", 1), ("iban", "bank transfer to ", "fr1420041010050500013m02606", ".", 1), ("iban", "serial ", "xy99abcdefghijklmnop", "", 0), ("iban", "model ", "ab12 cdef ghij1 klmn", "", 0), ("iban", "ref ", "gb82west12345698765432", "", 0),
    ("ip", "client ", "2001:db8::1", "", 1), ("ip", "host ", "fe80::1", "", 1), ("ip", "address ", "2a00:1450:4001:81b::200e", ".", 1), ("ip", "server ", "fd12:3456:789a::", "", 1), ("ip", "from ", "2001:db8:85a3::8a2e:370:7334", "", 1), ("ip", "the ", "fe80::202:b3ff:fe1e:8329", " is up", 1),
    ("ip", "section ", "1::2", "", 0), ("ip", "ref ", "ab::cd", "", 0), ("ip", "chapter ", "2::10", "", 0), ("ip", "part ", "3::", "", 0), ("ip", "the ", "a::b", " name", 0), ("ip", "version ", "10::20", "", 0),
]


# --- array helpers ---------------------------------------------------------------------------------


# Each array is worked out once, as a column of its own: what an expression names twice is not worked out twice, and what a
# lambda names is not worked out for each element. So steps take a DataFrame and add columns; names begin with TEMP.

TEMP = "__pii_"


def with_running(rows: DataFrame, values: dict[str, Column], zeros: dict[str, int], ops: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Add columns: for each element of an array of integers the result of an associative ``op`` over those before it, from zero."""

    def scan(part: Column, begin: Column, op) -> Column:
        state = F.struct(begin.alias("at"), F.slice(F.array(begin), 1, 0).alias("out"))
        return F.aggregate(part, state, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))

    def join(n: str) -> Column:
        blocks, zero, op = F.col(f"{TEMP}blocks_{n}"), F.lit(zeros[n]), ops[n]
        heads = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero, op)
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), heads.alias("h")), lambda x: scan(x["b"], x["h"], op)))

    rows = rows.withColumns({f"{TEMP}values_{n}": v for n, v in values.items()})
    rows = rows.withColumns({f"{TEMP}blocks_{n}": cut(F.col(f"{TEMP}values_{n}")) for n in values})
    rows = rows.withColumns({n: join(n) for n in values})
    return rows.drop(*(f"{TEMP}{what}_{n}" for what in ("values", "blocks") for n in values))


def with_matches(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add a column per pattern: its matches in ``text`` as array of struct(match, start, end), in code points."""
    m, g = (lambda n: F.col(f"{TEMP}matches_{n}")), (lambda n: F.col(f"{TEMP}gaps_{n}"))
    whole = F.col(text)
    rows = rows.withColumns({f"{TEMP}matches_{n}": F.regexp_extract_all(whole, F.lit(p), F.lit(0)) for n, p in patterns.items()})
    rows = rows.withColumns({f"{TEMP}gaps_{n}": F.when(F.size(m(n)) > 0, F.transform(F.slice(F.split(whole, p, -1), 1, F.size(m(n))), lambda x: F.length(x))).otherwise(F.array().cast("array<int>")) for n, p in patterns.items()})
    lengths = {f"{TEMP}at_{n}": F.zip_with(m(n), g(n), lambda x, gap: F.length(x) + gap) for n in patterns}
    rows = with_running(rows, lengths, dict.fromkeys(lengths, 0), dict.fromkeys(lengths, lambda a, b: a + b))

    def placed(n: str) -> Column:
        starts = F.zip_with(F.col(f"{TEMP}at_{n}"), g(n), lambda a, b: a + b)
        return F.zip_with(m(n), starts, lambda x, at: F.struct(x.alias("match"), at.alias("start"), (at + F.length(x)).alias("end")))

    rows = rows.withColumns({n: placed(n) for n in patterns})
    return rows.drop(*(f"{TEMP}{what}_{n}" for what in ("matches", "gaps", "at") for n in patterns))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(c == "", 0).otherwise(F.ascii(c) - 48) * (F.lit(1) + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def base_check(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return F.length(digits(match)).between(16, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def base_spans(kind: str, matches: Column) -> Column:
    """Spans of a base kind: its matches that pass its check."""
    kept = F.filter(matches, lambda x: base_check(kind, x["match"]))
    return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


# --- candidates and their judgement ----------------------------------------------------------------


def judged(kind: str, text: Column, matches: Column, model: dict) -> Column:
    """The proposals of a generator that reach the threshold of its kind: array of struct(minus, start, last, kind, end), minus the probability first."""
    rated = F.transform(matches, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), features(text, kind, x["match"], x["start"], x["end"]).alias("f")))
    limit = float(model["thresholds"][kind])
    p = lambda z: 1 / (1 + F.exp(-(F.lit(float(model["a"])) * z + F.lit(float(model["b"])))))
    kept = F.filter(F.transform(rated, lambda c: F.struct((-p(odds(model, c["f"]))).alias("minus"), c["start"].alias("start"), (-c["end"]).alias("last"), F.lit(kind).alias("kind"), c["end"].alias("end"))), lambda c: -c["minus"] >= limit)
    return kept


def features(text: Column, kind: str, match: Column, start: Column, end: Column) -> Column:
    """Format and context of a candidate as numbers."""
    number = digits(match)
    size = F.least(start, F.lit(BEFORE))
    before = F.lower(text.substr(start - size + 1, size))
    after = text.substr(end + 1, F.lit(1))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    each = [flag(F.lit(kind == k)) for k in KINDS]
    context = [flag(before.rlike(f"(?:{words})[^0-9A-Za-z]*(?:(?:no|nr|id|number|to|at|me|with)[^0-9A-Za-z]*){{0,2}}$")) for words in CONTEXT.values()]
    return F.array(
        *each,
        *context,
        F.length(number).cast("double"),
        F.length(match).cast("double"),
        F.length(F.regexp_replace(match, "[0-9A-Za-z]", "")).cast("double"),
        F.length(F.regexp_replace(match, "[^A-Za-z]", "")).cast("double"),
        F.size(F.array_distinct(F.split(number, ""))).cast("double"),
        flag(luhn(number)),
        flag(match.startswith("(")),
        flag(number.startswith("0")),
        flag(before.rlike("[0-9A-Za-z]$")),
        flag(after.rlike("[0-9A-Za-z%#&*$]")),
    )


def odds(model: dict, f: Column) -> Column:
    """The trees as an expression over the array of features."""

    def node(tree: list, at: int) -> Column:
        feature, cut, left, right, value = tree[at]
        return F.lit(float(value)) if feature < 0 else F.when(F.get(f, F.lit(feature)) <= F.lit(float(cut)), node(tree, left)).otherwise(node(tree, right))

    total = F.lit(float(model["bias"]))
    for tree in model["trees"]:
        total = total + node(tree, 0)
    return total


def fit(spark: SparkSession, trees: int = 12, depth: int = 3, precision: float = 0.95) -> dict:
    """Trees, calibration and thresholds from the labelled table (its rows are the bound of what is collected)."""
    cells = [(k, filler + a + m + b, len(filler + a), len(filler + a + m), y, n) for n, (k, a, m, b, y) in enumerate(LABELLED) for filler in FILLERS]
    table = spark.createDataFrame(cells, "kind string, text string, start int, end int, y int, n int")
    spans = [F.when(F.col("kind") == k, features(F.col("text"), k, F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), F.col("start"), F.col("end"))) for k in GENERATORS]
    rows = table.select("kind", "y", "n", F.coalesce(*spans).alias("f")).orderBy("n", "kind").collect()
    x, y, part = np.array([r.f for r in rows]), np.array([r.y for r in rows], dtype=float), np.array([r.n % 3 == 2 for r in rows])
    model = gbt.fit(x[~part], y[~part], trees=trees, depth=depth, rate=0.4)
    raw = gbt.score(model, x[part])
    a, b = 1.0, 0.0
    for _ in range(500):  # Platt's curve on the rows the trees have not seen
        error = y[part] - gbt.sigmoid(a * raw + b)
        a, b = a + 0.05 * float((error * raw).mean()), b + 0.05 * float(error.mean())
    p, kinds = gbt.sigmoid(a * raw + b), np.array([r.kind for r in rows])[part]
    thresholds = {}
    for kind in GENERATORS:
        mine, right = p[kinds == kind], y[part][kinds == kind]
        seen = sorted(set(mine.tolist()))
        good = [t for t in seen if right[mine >= t].mean() >= precision]
        # any value down to the next lower score divides these rows alike; half way leaves room for others on both sides
        under = max((t for t in seen if t < good[0]), default=0.0) if good else 0.0
        thresholds[kind] = max((good[0] + under) / 2, 0.5) if good else 1.1
    return model | {"a": a, "b": b, "thresholds": thresholds}


def with_added(rows: DataFrame, base: str, likely: str, out: str) -> DataFrame:
    """Add as ``out`` those of ``likely`` that overlap neither a span of ``base`` nor a likelier candidate (ties: the earlier, then the longer one)."""
    nothing = "struct<minus:double,start:int,last:int,kind:string,end:int>"
    far = 2**31 - 1

    def event(s: Column, own: int) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), (s if own else F.lit(None).cast(nothing)).alias("c"))

    events = F.concat(F.transform(F.col(base), lambda s: event(s, 0)), F.transform(F.col(likely), lambda c: event(c, 1)))
    names = {n: f"{TEMP}{n}" for n in ("events", "reach", "begin", "clear")}
    rows = rows.withColumn(names["events"], F.array_sort(events))
    e = F.col(names["events"])
    # the last end of a base span that starts before, and the first start of one after
    ends = F.transform(e, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0))
    starts = F.reverse(F.transform(e, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(far)))
    keys = {names["reach"]: ends, names["begin"]: starts}
    rows = with_running(rows, keys, {names["reach"]: 0, names["begin"]: far}, {names["reach"]: lambda a, b: F.greatest(a, b), names["begin"]: lambda a, b: F.least(a, b)})
    zipped = F.arrays_zip(e.alias("e"), F.col(names["reach"]).alias("reach"), F.reverse(names["begin"]).alias("begin"))
    free = F.filter(zipped, lambda x: (x["e"]["own"] == 1) & (x["reach"] <= x["e"]["start"]) & (x["begin"] >= x["e"]["end"]))
    rows = rows.withColumn(names["clear"], F.transform(free, lambda x: x["e"]["c"]))
    clear = F.col(names["clear"])
    best = F.filter(clear, lambda c: ~F.exists(clear, lambda o: (o["start"] < c["end"]) & (o["end"] > c["start"]) & (o < c)))
    rows = rows.withColumn(out, F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return rows.drop(*names.values())


def by_kind(spans: Column) -> Column:
    """Spans in the order of kinds, then start."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def with_personal_data(documents: DataFrame, text: str = "text", base: str = "base_pii", out: str = "pii") -> DataFrame:
    """The documents with ``base`` (base spans) and ``out`` (all spans): arrays of struct(kind, start, end), by kind, then start.

    Places are in code points, ends exclusive. Null and empty texts have none. Base spans of different kinds may overlap. Other columns are
    kept; repeated rows get the same spans.
    """
    model = fit(documents.sparkSession)
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # texts without a digit, an at sign or two colons have no span
    rows = documents.withColumn(f"{TEMP}text", F.when(plain.rlike(r"[0-9@]|::|[\[(]at[\])]"), plain).otherwise(""))
    patterns = {**{f"{TEMP}base_{k}": p for k, p in BASE.items()}, **{f"{TEMP}more_{k}": p for k, p in GENERATORS.items()}}
    rows = with_matches(rows, f"{TEMP}text", patterns)
    rows = rows.withColumns({
        base: F.concat(*(base_spans(k, F.col(f"{TEMP}base_{k}")) for k in BASE)),
        f"{TEMP}likely": F.concat(*(judged(k, F.col(f"{TEMP}text"), F.col(f"{TEMP}more_{k}"), model) for k in GENERATORS)),
    })
    rows = with_added(rows, base, f"{TEMP}likely", f"{TEMP}added")
    return rows.withColumn(out, by_kind(F.concat(base, f"{TEMP}added"))).drop(f"{TEMP}text", f"{TEMP}likely", f"{TEMP}added", *patterns)


def with_redacted(rows: DataFrame, text: str, spans: str, out: str) -> DataFrame:
    """Add as ``out`` the text with each stretch that spans cover replaced by the kind of its first span in brackets; null stays null."""
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = {n: f"{TEMP}{n}" for n in ("ordered", "reach", "marked")}
    rows = rows.withColumn(names["ordered"], ordered)
    o = F.col(names["ordered"])
    rows = with_running(rows, {names["reach"]: F.transform(o, lambda s: s["end"])}, {names["reach"]: 0}, {names["reach"]: lambda a, b: F.greatest(a, b)})
    rows = rows.withColumn(names["marked"], F.zip_with(o, names["reach"], lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("reach"), F.greatest(r, s["end"]).alias("upto"))))
    m, whole = F.col(names["marked"]), F.col(text)
    # a span that begins before the ones so far have ended goes on with their stretch
    heads = F.filter(m, lambda s: s["start"] >= s["reach"])
    pieces = F.transform(heads, lambda s: F.concat(whole.substr(s["reach"] + 1, s["start"] - s["reach"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    written = F.concat(F.array_join(pieces, ""), whole.substr(F.element_at(m, -1)["upto"] + 1, F.length(whole)))
    return rows.withColumn(out, F.when(F.size(m) > 0, written).otherwise(whole)).drop(*names.values())


def personal_data(documents: DataFrame) -> DataFrame:
    """Per document: numbers of base spans by kind, a digest of the base spans, and all spans."""
    rows = with_personal_data(documents.select("doc_id", "text")).drop("text")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base_pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(named(F.col("base_pii")), 256).alias("base_sha256"), named(F.col("pii")).alias("spans"))
