"""Personal data against plain patterns, validators against known numbers."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketlake.llm import pii
from docketlake.llm.queries import op11_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def plain(text):
    """(start, kind, end) of the base spans, straight from the patterns."""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def base_of(text):
    return [(s.start, s.kind, s.end) for s in pii.spans(text) if s.base]


@pytest.mark.parametrize("text", [
    "", "a@b.c@d.ef", "a@b.c_x@d.ef", "@x.y a@b a.b+c%d@e-f.g.h.", "@@a@b.c", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0255.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "+1 (974) 555-3436 +12 +1 5", "+1+22 333 444 5555",
    "00000000000000000000255.1.1.1", "é 4111 1111 1111 1111 ü a@b.cd", "1.2.3.4-5 6.7.8.9",
])
def test_base_spans(text):
    assert base_of(text) == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@ab_é", max_size=60))
def test_base_spans_of_any_text(text):
    assert base_of(text) == plain(text)


def kinds(text):
    return [(pii.KINDS[s.kind], text[s.start : s.end], s.base) for s in pii.spans(text)]


def test_added_spans():
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00, and GB29NWBK60161331926819") == [
        ("iban", "DE89 3704 0044 0532 0130 00", False), ("iban", "GB29NWBK60161331926819", False)]
    assert kinds("DE89 3704 0044 0532 0130 01") == []  # mod-97 fails
    assert kinds("my SSN is 219-09-9999.") == [("ssn", "219-09-9999", False)]
    assert kinds("part 219-09-9999") == [] and kinds("SSN 000-09-9999") == []
    # two cards side by side are one run of digits, which the plain pattern drops
    assert kinds("pay 4111111111111111 5500005555555559 now") == [
        ("card", "4111111111111111", False), ("card", "5500005555555559", False)]
    assert kinds("call (212) 555-0123 or 212-555-0199") == [
        ("phone", "(212) 555-0123", False), ("phone", "212-555-0199", False)]
    assert kinds("lot 212-555-0199") == []


def test_context_moves_the_score():
    score = lambda text: pii.spans(text)[0].score
    assert score("server 10.1.2.3") > score("at 10.1.2.3") > score("version 10.1.2.3")
    assert pii.spans("version 10.1.2.3")[0].base  # base spans stay


def test_mask():
    assert pii.masked("x@y.zz, +1 (974) 555-3436 and 4111 1111 1111 1111!") == "<email>, <phone> and <card>!"


@pytest.mark.parametrize("piece", ["a", "7", "1.", "+", "+1 ", "1 ", "@a", "a@b.c ", "4111111111111111 ", "DE89 ", "123-45-6789 "])
def test_long_texts_take_linear_time(piece):
    took = []
    for size in (100_000, 400_000):
        text = piece * (size // len(piece))
        start = time.perf_counter()
        pii.spans(text)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_query_against_the_plain_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_pii(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    names = list(PLAIN)
    for r in rows:
        want = plain(texts[r["doc_id"]] or "")
        listed = [f"{names[k]}:{s}:{e}" for s, k, e in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(listed) <= set(r["spans"].split(","))
        assert r["n_added"] + len(listed) == len([s for s in r["spans"].split(",") if s])
    assert sum(r["n_email"] for r in rows) > 0 and sum(r["n_card"] for r in rows) > 0


def test_columns_of_odd_tables(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "a@b.cd", "c"), (2, "a@b.cd", "c"), (None, "10.0.0.1 " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _pii string")
    got = pii.digests(docs, name="found").collect()
    assert sorted((r["found"]["n_email"], r["found"]["n_ip"]) for r in got) == [(0, 0), (0, 0), (0, 20000), (1, 0), (1, 0)]
    assert {r["_pii"] for r in got} == {"a", "b", "c", None}
    found = docs.select(pii.find("text").alias("s"), pii.mask("text").alias("m")).collect()
    assert sorted(len(r["s"]) for r in found) == [0, 0, 1, 1, 20000]
    assert {r["m"] for r in found} == {None, "", "<email>", "<ip> " * 20000}
    assert pii.digests(spark.createDataFrame([], docs.schema), name="found").count() == 0
