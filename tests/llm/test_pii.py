import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scenegrain.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        check = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and check % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PARTS = st.sampled_from(["a", "B.c", "@", "x@y.zz", ".", "..", "+", "+1 (555) 555-1234", " ", "-", "4", "12", "255", "256", "1.2.3.4", "4111111111111111", "4111-1111 1111 1111", "(", "%", "é", "\n", "token = ", "://", "A1b2C3d4E5f6G7h8"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute(text)


def test_cues_and_schemes():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t)]
    assert ("secret", "9A8B7C6D5E4F3A2B1C") in kinds('x token = "9A8B7C6D5E4F3A2B1C" y')
    assert ("account", "DE89370400440532013000") in kinds("IBAN: DE89370400440532013000.")
    assert ("uri", "ftp://me:pw@host.example/x") in kinds("see ftp://me:pw@host.example/x now")
    assert kinds("see https://host.example/page now") == []
    assert ("email_spoken", "jo [at] mail [dot] org") in kinds("write jo [at] mail [dot] org")
    assert pii.redact("a jo@b.cc d", pii.find("a jo@b.cc d")) == "a [EMAIL] d"


def test_odd_rows(spark):
    rows = [(1, None, "s"), (1, None, "s"), (2, "", "s"), (None, "a@b.cd", "s"), (3, "a@b.cd " * 3000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.spans(df).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 0), (3, 3000)]
    assert pii.spans(df.limit(0)).count() == 0
    clean = pii.redacted(df).collect()
    assert [r.text for r in clean][:4] == [None, None, "", "[EMAIL]"] and clean[0].spans == "s"


def test_query_against_brute_force(spark, small_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pii.op4_pii(spark, small_dir).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        want = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in want) for k in pii.KINDS[:4]]


def test_long_texts_take_time_in_proportion():
    """A megabyte of what starts a match again and again, with and without a match at its end."""
    import time

    for text in ("a://" * 250_000, "a://" * 250_000 + "@", "1.2.3." * 160_000, "a@" * 500_000, "+1(" * 330_000, "token" * 200_000, "iban " * 200_000):
        began = time.process_time()
        found = pii.find(text)
        assert time.process_time() - began < 15 and sum(b - a for _, a, b in found) <= 4 * len(text)


def test_uri_covers_its_run_once():
    text = "see ftp://a:b@host/x://y@z and http://10.0.0.1/p://q http://example.org/x"
    assert [(k, text[a:b]) for k, a, b in pii.find(text) if k == "uri"] == [("uri", "ftp://a:b@host/x://y@z"), ("uri", "http://10.0.0.1/p://q")]
