"""Operator 8: personal data in texts. Regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Base kinds, leftmost and non-overlapping within a kind: email, ip (parts at most 255), card (16 to 19 digits that pass
Luhn), phone (8 to 15 digits). A proposal that its validator refuses is dropped and not tried again. The method adds iban
(mod 97) and card15 (15 digits that pass Luhn), each only with its checksum. Added spans never replace base ones. What
follows an IBAN may look like more of it (a BIC, a currency): its end is where its country's length ends, or else the
latest end of a word within 34 characters at which mod 97 is right; after a refusal the search goes on a character later.
Every span has a score: what its validator is worth, more if a word that announces its kind stands shortly before or
after it, less if a word stands there that announces a plain number. Null text counts as empty: no spans. Positions are
code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card15")
#: Code points on either side of a span in which context words count.
NEAR = 48
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "card15": 0.5}
FOR = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "card15": ("card", "amex", "credit", "payment"),
}
AGAINST = ("version", "release", "order", "invoice", "isbn", "serial")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_WORD_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
#: An IBAN's length by country; codes not listed, or of another length, are tried at every end.
IBAN_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
    }.items()
    for c in cs.split()
}
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str):
    m = _IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 1
        ends = [e.start() for e in _WORD_END.finditer(text, start, min(len(text), m.end() + 1)) if e.start() <= m.end()]
        length = IBAN_LENGTHS.get(text[start : start + 2])
        for end in sorted(ends, key=lambda e: (len(text[start:e].replace(" ", "")) != length, -e)):
            if mod97(text[start:end]):
                yield start, end
                at = end
                break
        m = _IBAN.search(text, at)


def emails(text: str):
    """As the whole pattern would match, but from each @ outwards, so a long word is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed in BASE and ADDED, then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m[0].split(".")))]
    fifteen = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 15 <= len(digits) <= 19 and luhn(digits):
            (out if len(digits) > 15 else fifteen).append(("card" if len(digits) > 15 else "card15", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    out += [("iban", *x) for x in ibans(text)]
    return out + fifteen


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall(f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()))
    return round(min(1.0, max(0.0, WORTH[kind] + 0.2 * any(w in near for w in FOR[kind]) - 0.3 * any(w in near for w in AGAINST))), 2)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: the key and its spans, array<struct<kind, start, end, score>>. Repeated rows give repeated rows."""
    kind = docs.schema[key].dataType
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "score": score(t, k, a, b)} for k, a, b in find(t)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["key", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind.simpleString()}, spans array<struct<kind string, start bigint, end bigint, score double>>").withColumnRenamed("key", key)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with each span of at least that score replaced by [KIND]; of overlapping spans the one that starts first goes."""

    def run(batches):
        for batch in batches:
            out = []
            for t in texts(batch, text):
                parts, at = [], 0
                for k, a, b in sorted(find(t), key=lambda x: x[1:]):
                    if a >= at and score(t, k, a, b) >= least:
                        parts += [t[at:a], f"[{k.upper()}]"]
                        at = b
                out.append("".join([*parts, t[at:]]))
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from spans()."""
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("spans", lambda x: x.kind.isin(*BASE))
    of = lambda k: F.filter("spans", lambda x: x.kind == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: x.score.cast("string")), ",").alias("scores"))
