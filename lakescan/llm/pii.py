"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over the text and finds anchors: at-signs, plus signs,
digits, scheme separators and identifier cues.  From each anchor a deterministic local
parser expands to the span's boundaries and validates it.  Parsers never look back
behind the end of their kind's last span, so spans of a kind never overlap, and work stays
in proportion to the text.

Kinds, in the order that breaks ties: email, ip, card, phone (the base kinds), then what
the method adds: account (a cue followed by an IBAN with right check digits or a number of at
least six digits), address (a URL with credentials or a home directory) and secret (a key
or token cue, a separator and at least 16 characters that hold a digit).

Defined cases: null is an empty text without spans.  Offsets are in code points, ends
exclusive.  Letters are A-Z in either case: other characters that fold to them belong to no
span's fixed parts.  Texts of any length are read whole.  Rows are independent: repeats
give repeats, a null doc_id is passed on, columns of other names are ignored, and an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm.common import map_rows, whole_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "secret")
#: Characters of an address before the at-sign, and cues.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
ACCOUNT = re.compile(r"(?:[\x20\t]*(?:no\.?|number|nr\.?|[:#=]))*[\x20\t]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,})", re.I | re.A)
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
ADDRESS = re.compile(r"(?:[^\s/?#@:\"'<>]+(?::[^\s/?#@\"'<>]*)?@[^\s/?#@\"'<>]+|[^\s/?#\"'<>]+/(?:~|(?ai:home/|users/))[^\s/?#\"'<>]+)[^\s\"'<>]*")
SECRET = re.compile(r"[\"']?[\x20\t]*[:=][\x20\t]*[\"']?([A-Za-z0-9_+/=.-]{16,})")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "").upper()
    return text[:2].isalpha() and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in "0123456789":
        out.add_word(c, ("digit", 1))
    for anchor, kind in (("@", "email"), ("+", "phone"), ("://", "address")):
        out.add_word(anchor, (kind, len(anchor)))
    for cues, kind in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    found: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # end of each kind's last span, or of what it need not look at again

    def add(kind: str, start: int, end: int) -> None:
        found.append((start, KINDS.index(kind), end))

    for last, (kind, width) in anchors.iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= done["ip"]:
                if m := IP.match(text, at):
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                        add("ip", at, m.end())
                    done["ip"] = m.end()
                else:
                    done["ip"] = DIGITS.match(text, at).end()
            if at >= done["card"] and (m := CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    add("card", at, m.end())
                done["card"] = m.end()
        elif kind == "email":
            if span := _email(text, at, done["email"]):
                add("email", *span)
                done["email"] = span[1]
        elif kind == "phone":
            if m := PHONE.match(text, at):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", at, m.end())
        elif kind == "account":
            if at >= done["account"] and (m := ACCOUNT.match(text, last + 1)):
                own = m[1]
                if not own[:2].isalpha() or not own[2:4].isdigit() or len(own) < 15 or iban(own):
                    add("account", m.start(1), m.end(1))
                    done["account"] = m.end()
        elif kind == "secret":
            if at >= done["secret"] and (m := SECRET.match(text, last + 1)) and DIGITS.search(m[1]):
                add("secret", m.start(1), m.end(1))
                done["secret"] = m.end()
        elif at >= done["address"] and (scheme := SCHEME.search(text[max(done["address"], at - 16) : at])) and (m := ADDRESS.match(text, last + 1)):
            add("address", at - len(scheme[0]), m.end())
            done["address"] = m.end()
    return sorted(found)


def named(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans, their number: a row for each row."""

    def make():
        anchors = automaton()

        def one(doc_id, text):
            found = spans(text, anchors)
            base = [x for x in found if x[1] < len(BASE)]
            return doc_id, *(sum(x[1] == k for x in base) for k in range(len(BASE))), hashlib.sha256(named(base).encode()).hexdigest(), named(found), len(found)

        return one

    fields = [("doc_id", "long", pa.int64()), *((f"n_{k}", "long", pa.int64()) for k in BASE), ("base_sha256", "string", pa.string()), ("spans", "string", pa.string()), ("n_spans", "long", pa.int64())]
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), ["doc_id", "text"], make, fields)


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, text with each span replaced by its kind in angle brackets; of overlapping spans the first wins."""

    def make():
        anchors = automaton()

        def one(doc_id, text):
            out, at = [], 0
            for s, k, e in spans(text, anchors):
                if s >= at:
                    out += [text[at:s], f"<{KINDS[k]}>"]
                    at = e
            return doc_id, "".join([*out, text[at:]])

        return one

    return map_rows(docs.select("doc_id", whole_text().alias("text")), ["doc_id", "text"], make, [("doc_id", "long", pa.int64()), ("text", "string", pa.string())])
