from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG
from tillwatch.llm import gbt, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_patterns(documents):
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", ".", "..", "1", "12", "255", "256", "0", ".", "+", "+1", " ", "-", "(", ")", "%", "_", "😀", "é", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "x@y.z", "call 555-123-4567", "ssn 078-05-1120", "\n", "a@b.c"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(1200)]
    rows += [(9001, None), (9002, ""), (9003, "x@y.z"), (9003, "x@y.z"), (None, "10.0.0.1"), (9004, LONG)]
    got = pii.personal_data(documents(rows)).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for row in got:
        base = brute(by[row.doc_id])
        named = [f"{k}:{s}:{e}" for k, s, e in base]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(b[0] == k for b in base) for k in PLAIN]
        assert row.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest(), by[row.doc_id]
        assert set(named) <= set(row.spans.split(","))
    assert pii.personal_data(documents(rows).limit(0)).collect() == []


def test_long_runs_take_linear_time_and_no_deep_stack(documents):
    n = 60_000
    rows = [(0, "1" * n), (1, "a" * n), (2, "a@" + "b." * n + "c"), (3, "1 " * n), (4, "+1" + "(" * n), (5, "10.0.0.1 " * 5000), (6, "a." * n), (7, "078-05-1120 " * 3000)]
    got = {r.doc_id: r for r in pii.personal_data(documents(rows)).collect()}
    assert got[2].n_email == 1 and got[5].n_ip == 5000 and [got[i].n_card for i in (0, 3)] == [0, 0]


def test_added_spans_and_redaction(documents):
    text = "Please call 555-123-4567 or ssn 078-05-1120, order 100-200-300, é😀 x@y.org 10.0.0.1 and +4 111 1111 1111 1111"
    rows = pii.with_personal_data(documents([(1, text), (2, None), (3, "nothing"), (4, "a@b.c")]))
    got = {r.doc_id: r for r in pii.with_redacted(rows, "text", "pii", "clean").collect()}
    assert got[1].clean == "Please call [PHONE] or ssn [SSN], order 100-200-300, é😀 [EMAIL] [IP] and +[CARD]"
    assert [got[2].clean, got[3].clean, got[4].clean] == [None, "nothing", "[EMAIL]"]
    kinds = [s.kind for s in got[1].pii]
    assert kinds == sorted(kinds, key=pii.KINDS.index) and all(b in got[1].pii for b in got[1].base_pii)


def test_redaction_joins_overlapping_spans(spark):
    rows = spark.createDataFrame([("abcdefghij", [("ip", 2, 5), ("card", 1, 4), ("phone", 5, 6), ("email", 7, 8), ("email", 7, 8)])], "text string, s array<struct<kind:string,start:int,end:int>>")
    assert pii.with_redacted(rows, "text", "s", "out").first().out == "a[CARD][PHONE]g[EMAIL]ij"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 300])
def test_running_sums(spark, n):
    values = [random.Random(n).randint(0, 9) for _ in range(n)]
    rows = pii.with_running(spark.createDataFrame([(values,)], "v array<int>"), {"out": F.col("v")}, {"out": 0}, {"out": lambda a, b: a + b})
    assert rows.first().out == [sum(values[:i]) for i in range(n)]


def test_expression_equals_the_trees(spark):
    model = pii.fit(spark)
    rng = random.Random(5)
    rows = [[float(rng.choice([0, 0, 1, 3, 9, 12, 15])) for _ in range(len(pii.KINDS) + len(pii.CONTEXT) + 10)] for _ in range(50)]
    table = spark.createDataFrame([(r,) for r in rows], "f array<double>")
    got = [r[0] for r in table.select(pii.odds(model, F.col("f"))).collect()]
    assert got == pytest.approx(gbt.score(model, __import__("numpy").array(rows)).tolist())
    assert all(t >= 0.5 for t in model["thresholds"].values())


def test_no_python_in_the_plan(documents, capsys):
    pii.personal_data(documents([(1, "x@y.z")])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_other_forms_are_proposed_and_judged(documents):
    personal = {
        "phone": ["call 5551234567 now", "tel 01 23 45 67 89", "phone (030) 12345678", "mobile 0171 2345678"],
        "ssn": ["ssn 078 05 1120"],
        "iban": ["iban de89 3704 0044 0532 0130 00 and more", "account gb82west12345698765432"],
        "ip": ["client 2001:db8::1", "host fe80::1 is up"],
    }
    rows = [(i, text) for i, text in enumerate(t for texts in personal.values() for t in texts)]
    kinds = [k for k, texts in personal.items() for _ in texts]
    other = ["order 5551234567", "the 100 20 3000 left", "section 1::2", "std::cout << a::b", "serial 01 23 45 67 89", "serial xy99abcdefghijklmnop"]
    rows += [(100 + i, text) for i, text in enumerate(other)]
    got = {r.doc_id: (r.text, r.pii) for r in pii.with_personal_data(documents(rows)).select("doc_id", "text", "pii").collect()}
    words = {0: "5551234567", 5: "de89 3704 0044 0532 0130 00", 7: "2001:db8::1", 8: "fe80::1"}
    assert [[s.kind for s in got[i][1]] for i in range(len(kinds))] == [[k] for k in kinds]
    assert {i: got[i][0][got[i][1][0].start : got[i][1][0].end] for i in words} == words
    assert [got[100 + i][1] for i in range(len(other))] == [[]] * len(other)
