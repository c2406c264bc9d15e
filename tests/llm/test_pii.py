import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1254.@+-( )é\n%", max_size=60))
def test_base_spans_equal_regular_expressions(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == brute(text)


def test_card_and_extra_kinds():
    text = "card 4111 1111 1111 1111, +1 (434) 555-2368 see http://u:p@h.example/x IBAN: GB82 WEST 1234 5698 7654 32 password=abcd1234efgh"
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == brute(text)
    assert {k for k, _, _ in pii.spans(text)} >= {"card", "phone", "url", "account", "secret"}
    assert "4111" not in pii.redacted(text, pii.spans(text)) and "abcd1234efgh" not in pii.redacted(text, pii.spans(text))


def test_documents_equal_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = pii.op9_pii(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert r.n_email == sum(k == "email" for k, _, _ in base)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (None, "", "x"), (2, "a@b.c", "x"), (2, "a@b.c", "x"), (3, "1 " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(df).select("doc_id", "spans", "redacted").collect()
    assert sorted((str(r[0]), r[1]) for r in got)[:2] == [("1", ""), ("2", "email:0:5")] and len(got) == 5
    assert pii.find(df.limit(0)).count() == 0
    with pytest.raises(Exception):
        pii.find(df, text_col="missing")


def test_a_scheme_of_any_length_is_whole():
    text = "see averylongschemename+x://me:pw@host/path now"
    assert ("url", 4, 43) in pii.spans(text)


def test_address_parts_with_leading_zeros():
    for text in ("0000000000000000000001.1.1.1", "1.2.3." + "0" * 6000 + "255", "1.2.3.0256", "00.0.0.0"):
        assert [s for s in pii.spans(text) if s[0] == "ip"] == ([] if "256" in text else [("ip", 0, len(text))])
