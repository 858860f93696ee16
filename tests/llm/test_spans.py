"""Personal data and secrets against plain versions of the base patterns, and what the methods add."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowlens.llm import credentials, pii
from tests_llm_data import prose

BASE_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    "card": (
        r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group())),
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15),
}
BASE_SECRETS = {
    "assign": (
        r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(1)) >= 6,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
}


def plain(text: str | None, base: dict) -> list[tuple[str, int, int]]:
    return [(k, *m.span()) for k, (p, ok) in base.items() for m in re.finditer(p, text or "") if ok(m)]


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 0149(é\n%", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text, BASE_PII)


TEXTS = [
    None, "", "mail a.b@c.d.e@f.g, 10.0.0.255.1.2.3.4 and 300.1.1.1", "4111 1111 1111 1111 or 4111-1111-1111-1112 +1 (555) 010-9999",
    "\U0001f600 token = 'abc' password=token:abcdef API_KEY: \"x/y+z==_-.\" ſecret=abcdefg", "AKIA" + "A" * 15 + " AKIA" + "Z9" * 8,
    "0" * 23 + "g" + "0123456789abcdef" * 3, "secret = secret=abcdefgh", "a@b.c" * 50, "9" * 50_000, "x@" * 20_000, prose(1, 20_000),
]


def texts_table(spark):
    rows = [(i if i % 5 else None, t, "k") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "k"), (2, TEXTS[2], "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, row string")


def test_personal_data_rows(spark, odd, nothing):
    table = texts_table(spark)
    got = sorted((r.base_sha256, r.spans, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find(table).collect())
    want = []
    for r in table.collect():
        spans = plain(r.text, BASE_PII)
        counts = [sum(s[0] == k for s in spans) for k in BASE_PII]
        want.append((hashlib.sha256(said(spans).encode()).hexdigest(), said(spans), *counts))
    assert got == sorted(want)
    assert pii.find(odd).count() == odd.count()
    assert pii.find(nothing).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = []
    for i in range(8):
        rows.append((i, f"{prose(i, 9)} call us at +1 (555) 010-{1000 + i} today. Reach me under +1 555 020 {2000 + i} please. {prose(50 + i, 5)}"))
    rows.append((20, f"{prose(90, 9)} call us at 555/7788 today. Reach me under 555/7788 please."))
    rows.append((21, f"{prose(91, 9)} call us at 555/7788 today."))
    rows += [(30 + i, f"{prose(100 + i, 30)} order 12345{i} shipped") for i in range(12)]
    rows += [(i, t) for i, t in rows[:3]] * 5
    got = {}
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.n_phone, r.n_found, r.spans))
    texts = dict(rows)
    assert {n for i in range(8) for _, n, _ in got[i]} == {0}
    for i, times in ((20, 2), (21, 1)):
        ((phones, found, spans),) = got[i]
        assert (phones, found) == (0, times)
        assert [texts[i][int(a) : int(b)] for _, a, b in (s.split(":") for s in spans.split(","))] == ["555/7788"] * times
    assert all(n == 0 and s == "" for i in range(30, 42) for _, n, s in got[i])


def secrets_of(table) -> list[tuple[str, str]]:
    base = F.filter("spans", lambda s: s.kind.isin(credentials.BASE))
    rows = credentials.scan(table).select("doc_id", credentials.said(base).alias("base"), credentials.said(F.col("spans")).alias("spans"))
    return [(r.doc_id, r.base, r.spans) for r in rows.collect()]


def test_secret_rows(spark, odd, nothing):
    table = texts_table(spark)
    order = list(BASE_SECRETS)
    want = [said(sorted(plain(r.text, BASE_SECRETS), key=lambda s: (s[1], order.index(s[0])))) for r in table.collect()]
    assert sorted(b for _, b, _ in secrets_of(table)) == sorted(want)
    assert len(secrets_of(odd)) == odd.count()
    assert secrets_of(nothing) == []


def test_weak_parts_count_only_together(spark):
    alone = f"{prose(1, 9)} username: jane.doe {prose(2, 80)}"
    far = f"{alone} pwd: hunter2hunter2"
    near = "login = jane pwd: hunter2hunter2 at postgres://db.example:5432/x"
    url = f"see https://example.org/page {prose(3, 60)}"
    key = f"password = abcdef12345 {prose(4, 3)} user: root"
    crowd = " ".join(f"user: u{i:03d} pass: secret{i:03d}x" for i in range(300))
    rows = [(1, alone), (2, far), (3, near), (4, url), (5, key), (6, crowd)]
    got = {i: (b, s) for i, b, s in secrets_of(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1] == got[4] == ("", "")
    assert abs(far.index("username") - far.index("pwd")) > credentials.SCOPE and got[2] == ("", "")
    kinds = lambda x: [s.split(":")[0] for s in x.split(",")]
    assert kinds(got[3][1]) == ["ident", "value", "endpoint"] and got[3][0] == ""
    assert kinds(got[5][1]) == ["assign", "ident"] and kinds(got[5][0]) == ["assign"]
    assert kinds(got[6][1]) == ["ident", "value"] * 300
