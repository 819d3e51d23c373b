"""Personal data: proposed by patterns, confirmed by checksums, scored by context.

Patterns propose spans. Validators confirm or drop them: Luhn for card numbers, mod-97 for
bank accounts, ranges for addresses and digit counts for phones. A span starts from the
score of its kind, gains by a passed checksum and by a context word nearby, and loses by a
word that speaks against it. `email`, `ip`, `card` and `phone` are settled by pattern and
validator, their score only informs; `iban` and `ssn` also need a score of `ACCEPT`.

Every pattern is written to be linear in the text, so a long run of digits or dots costs
its length. Texts are scanned in tasks of their own; nothing is shuffled.

Spans are code points, the end exclusive. Defined cases: a null text is empty and has no
spans; spans of different kinds may overlap (masking then covers their union); repeated
rows are scanned once per row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm import words

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
NEAR = 48
ACCEPT = 0.6
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.3}
CHECKSUM_GAIN, CONTEXT_GAIN, DOUBT_LOSS = 0.4, 0.35, 0.3
CONTEXT = {
    "email": {"email", "mail", "contact", "courriel", "correo", "kontakt"},
    "ip": {"ip", "address", "host", "server", "adresse"},
    "card": {"card", "credit", "visa", "mastercard", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta", "transfer"},
    "ssn": {"ssn", "social", "security"},
}
DOUBT = {"version", "order", "invoice", "isbn", "serial", "ticket", "part", "sku"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > end and text[left - 1] in _LOCAL:
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            end = domain.end()
            yield left, end
        at = text.find("@", max(at + 1, end))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposed(text: str):
    """(kind, start, end, checksum passed) of spans that their validator lets through."""
    for start, end in _emails(text):
        yield "email", start, end, False
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end(), False
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end(), False
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", m.start(), m.end(), True
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", m.start(), m.end(), False


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed, then start."""
    found = []
    for kind, start, end, checked in _proposed(text):
        near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
        around = {w.lower() for w in _WORD.findall(near)}
        score = START_SCORE[kind] + CHECKSUM_GAIN * checked
        score += CONTEXT_GAIN * bool(around & CONTEXT[kind]) - DOUBT_LOSS * bool(around & DOUBT)
        if kind in BASE_KINDS or score >= ACCEPT:
            found.append((kind, start, end, round(min(1.0, max(0.0, score)), 4)))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def mask(text: str, spans) -> str:
    """`text` with every span replaced by its kind in brackets; overlaps become one."""
    out, end = [], 0
    for kind, start, stop, _ in sorted(spans, key=lambda s: s[1]):
        if start >= end:
            out.append(text[end:start])
            out.append(f"<{kind}>")
        end = max(end, stop)
    return "".join([*out, text[end:]])


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
)


def _scan(masked: bool):
    def task(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in words.slices(texts):
                plain = [x or "" for x in texts.slice(a, b - a).to_pylist()]
                spans = [spans_of(x) for x in plain]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(
                        [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in spans],
                        type=_SPAN_TYPE,
                    ),
                ]
                if masked:
                    columns.append(pa.array([mask(x, s) for x, s in zip(plain, spans, strict=True)]))
                yield pa.record_batch(columns, names=["id", "spans", "masked"][: len(columns)])

    return task


def personal_data(docs: DataFrame, doc_id="doc_id", text="text", masked: bool = False) -> DataFrame:
    """One row per document row: `doc_id`, `spans` and, if asked, `masked` text."""
    columns = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = f"id {columns.schema['id'].dataType.simpleString()}, spans {_SPANS}"
    schema += ", masked string" if masked else ""
    return words.map_arrow(columns, _scan(masked), schema).withColumnRenamed("id", doc_id)


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_kind = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(of_kind(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def base_digest(spans) -> str:
    """The digest of `op2_personal_data` for spans in plain Python."""
    named = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans if k in BASE_KINDS)
    return hashlib.sha256(named.encode()).hexdigest()
