"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Every kind has a base score; checksum kinds (card by Luhn, iban by mod 97, routing and national numbers
by weights) are dropped when the sum fails. A context word of the kind within ``WINDOW`` code points
before or after raises the score, a contrary word lowers it. An IBAN has the length of its country. Base kinds always stay and only their score
varies; added kinds need a score of ``threshold`` and must not overlap a base span. A null text counts as
empty and has no spans. Repeated rows are each judged. Other columns are ignored. Texts are read whole, however long; a worker
holds a batch of 1 MB or one longer text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.batches import bounded

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "routing", "passport", "birth")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
WINDOW = 48
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=[A-Z0-9 ]{11})")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
ROUTING = re.compile(r"(?<![0-9.+-])[0-9]{9}(?![0-9.-])")
PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{7}(?![A-Za-z0-9])")
BIRTH = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![0-9])")
#: Characters of an IBAN by its country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Score without context, and the words that raise it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "routing": 0.2, "passport": 0.2, "birth": 0.1}
CONTEXT = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "cvv"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "account", "konto", "bank", "transfer"),
    "ssn": ("ssn", "social security", "tax id"),
    "routing": ("routing", "aba", "wire", "bank transit"),
    "passport": ("passport", "pasaporte", "reisepass", "passeport"),
    "birth": ("born", "birth", "dob", "geboren", "nacido", "nacida"),
}
CONTRARY = ("example", "sample", "dummy", "version", "invoice", "order no")
CONTEXT_RE = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, v)) + r")(?![a-z])") for k, v in CONTEXT.items()}
CONTRARY_RE = re.compile(r"(?<![a-z])(?:" + "|".join(CONTRARY) + r")(?![a-z])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """As many letters and digits as the country has, single blanks between them left out, and no more right after."""
    for m in IBAN.finditer(text):
        need, at = IBAN_LENGTH.get(m[1], 0) - 4, m.end()
        while need > 0 and at < len(text):
            step = 1 if text[at] != " " else 2
            c = text[at + step - 1 : at + step]
            if not (c.isascii() and (c.isdigit() or c.isupper())):
                break
            need, at = need - 1, at + step
        if need == 0 and IBAN_LENGTH.get(m[1]) and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97(text[m.start() : at]):
            yield m.start(), at


def routing_sum(d: str) -> bool:
    return d != "000000000" and sum(int(c) * w for c, w in zip(d, (3, 7, 1) * 3)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; works outward from each @, so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1  # an @ is in no local part: what stands before it is settled
        if m:
            yield start, m.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def score(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()
    return round(min(1.0, max(0.0, SCORE[kind] + 0.4 * bool(CONTEXT_RE[kind].search(near)) - 0.2 * bool(CONTRARY_RE.search(near)))), 3)


def added_spans(text: str, base: list[tuple[str, int, int]], threshold: float) -> list[tuple[str, int, int]]:
    found = [("iban", *x) for x in ibans(text)]
    if "-" in text:
        found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    found += [("routing", *m.span()) for m in ROUTING.finditer(text) if routing_sum(m[0])]
    found += [("passport", *m.span()) for m in PASSPORT.finditer(text)]
    found += [("birth", *m.span()) for m in BIRTH.finditer(text)]
    if not found:
        return []
    taken = bytearray(len(text))
    for _, s, e in base:
        taken[s:e] = b"1" * (e - s)
    out = []
    for kind, s, e in found:
        if score(kind, text, s, e) >= threshold and not any(taken[s:e]):
            out.append((kind, s, e))
            taken[s:e] = b"1" * (e - s)
    return out


def spans(text: str | None, threshold: float = 0.5) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, by kind and start."""
    if not text or not re.search("[0-9@]", text):
        return [], []
    base = base_spans(text)
    both = sorted(base + added_spans(text, base, threshold), key=lambda x: (ORDER[x[0]], x[1]))
    return sorted(base, key=lambda x: (ORDER[x[0]], x[1])), both


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, found array<struct<kind, start, end, score, value>>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())]))
        for b in bounded(batches, text):
            rows = [[{"kind": k, "start": s, "end": e, "score": score(k, t, s, e), "value": t[s:e]} for k, s, e in spans(t, threshold)[1]] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(rows, kind)], [key, "found"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, found array<struct<kind:string,start:int,end:int,score:double,value:string>>")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            counts, digest, lists, scores = [], [], [], []
            for t in b.column(text).to_pylist():
                base, both = spans(t, threshold)
                counts.append([sum(k == kind for k, _, _ in base) for kind in BASE])
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(both))
                scores.append([score(k, t, s, e) for k, s, e in both])
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(x, pa.int64()) for x in zip(*counts)), pa.array(digest, pa.string()), pa.array(lists, pa.string()), pa.array(scores, pa.list_(pa.float64()))], [key, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def op10_personal(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(docs)
