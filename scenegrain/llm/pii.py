"""Personal data: Aho-Corasick anchors, expanded and validated by deterministic local parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_rows, named, table, text_of

#: Kinds in the order in which spans with one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "email_spoken", "uri", "secret", "account")
BASE = frozenset(KINDS[:4])

#: Words that announce an identifier or a secret, each also looked for in capitals.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "ssn", "passport", "reisepass", "passeport", "pasaporte", "customer id", "user id", "licence no", "license no")
SECRET_CUES = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "access_key", "private key", "private_key")
SPOKEN_CUES = ("[at]", "(at)", "{at}")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AUTHORITY = re.compile(r"([^\s/?#\"'<>|]+)([^\s\"'<>|]*)")
SPOKEN_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?$")
SPOKEN_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]{1,63})+")
SECRET = re.compile(r"\x20?[=:]\x20?[\"']?([A-Za-z0-9_+/.-]{16,})")
ACCOUNT = re.compile(r"(?:\x20?(?:number|no|nr|num|id)\b\.?)?\x20?[#=:]?\x20?([A-Z]{0,4}[0-9](?:[\x20-]?[A-Z0-9]){4,32})\b", re.I)

SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))),
    ]
)
ARROW_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))])


@lru_cache(1)
def anchors():
    """The automaton of all anchors: at-signs, plus signs, digits, schemes and cues."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", "uri"), *((str(d), "0") for d in range(10))]:
        found.add_word(word, (kind, len(word)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("spoken", SPOKEN_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), in code points, sorted by start and then as KINDS are listed.

    Base kinds equal leftmost non-overlapping matches of their patterns. Each kind keeps the end of
    its last match (also of one that failed validation: no retries), and the parsers never look
    behind it, so that a text is read a bounded number of times: an at-sign expands left over the local part and right over the domain, a digit that
    no earlier match covers starts an address or a card, a plus sign starts a phone number.
    """
    out: list[tuple[str, int, int]] = []
    email = ip = card = phone = uri = 0
    for last, (kind, length) in anchors().iter(text):
        at = last - length + 1
        if kind == "0":
            if at >= ip:
                if m := IP.match(text, at):
                    ip = m.end()
                    if all(map(small, m.groups())):
                        out.append(("ip", at, ip))
                else:
                    ip = DIGITS.match(text, at).end()
            if at >= card:
                if m := CARD.match(text, at):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, card))
                else:
                    card = at + 1
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append(("email", start, email))
        elif kind == "+":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", at, phone))
        elif kind == "uri" and at >= uri:
            start = at
            while start > max(uri, at - 16) and text[start - 1] in SCHEME:
                start -= 1
            if start < at and (m := AUTHORITY.match(text, last + 1)):
                uri = m.end()
                # personal only where it names somebody: user data before the host, an address in the path, a numeric host
                if "@" in m[0] or (host := IP.match(m[1])) and all(map(small, host.groups())):
                    out.append(("uri", start, uri))
        elif kind == "uri":
            continue
        elif kind == "spoken":
            before = SPOKEN_LOCAL.search(text[max(0, at - 65) : at])
            if before and (m := SPOKEN_DOMAIN.match(text, last + 1)):
                out.append(("email_spoken", at - len(before[0]), m.end()))
        elif kind == "secret":
            if (m := SECRET.match(text, last + 1)) and any(c.isdigit() for c in m[1]):
                out.append(("secret", m.start(1), m.end(1)))
        elif (at == 0 or not text[at - 1].isalnum()) and (m := ACCOUNT.match(text, last + 1)) and sum(c.isdigit() for c in m[1]) >= 5:
            out.append(("account", m.start(1), m.end(1)))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if out else out


def spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data of every whole text: doc_id, spans (kind, start, end, base).

    One row per input row, in one pass without a shuffle; a task holds one text at a time besides
    its batch. Null and empty texts have no spans; repeated rows and null ids are rows like any
    other; an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [[{"kind": k, "start": a, "end": b, "base": k in BASE} for k, a, b in find(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, ARROW_SPANS.field(1).type)], schema=ARROW_SPANS)

    return df.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SPANS)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, longest one counts."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join(out) + text[at:] if out else text


def redacted(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns, personal data in text_col replaced.

    A null text stays null and an empty one empty; null ids and repeated rows are rows like any other;
    overlapping spans are replaced once, by the first, longest one; an empty table gives no rows; other
    columns are kept as they are, whatever their names.
    """
    names = df.columns
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                clean = [None if t is None else redact(t, find(t)) for t in part.column(where).to_pylist()]
                columns = [pa.array(clean, part.schema.field(where).type) if i == where else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return map_rows(df, run)


def joined(spans_col: str):
    return F.concat_ws(",", F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents")).withColumn("base_spans", F.filter("spans", lambda s: s["base"]))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = {k: count(k) for k in KINDS}
    digests = F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans")
    return found.select("doc_id", *(counts[k] for k in KINDS[:4]), *digests, *(counts[k] for k in KINDS[4:]))
