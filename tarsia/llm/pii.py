"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, schemes
and identifier cues. From each anchor a deterministic parser expands to the boundaries of
an email address, a network address, a card, a phone number, a link with credentials, a
street address, an account or identity number or a secret, and validates what it has
found. Every parser moves forward over the text or looks at a bounded piece of it, so a
text takes time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Kinds of the contract, then those that the method adds, in this order.
BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address", "iban", "identity", "login", "obfuscated", "secret", "telephone")
ORDER = {k: i for i, k in enumerate((*BASE, *ADDED))}
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABELS = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]++")
_ACCOUNT = re.compile(r"[\s:#=.]{0,4}(?:(?:no|nr|number|nummer|num)\b)?[\s:#=.]{0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_RUN = re.compile(r"[0-9]++")
#: What stands between a cue and its value: the rest of a name, then a sign, a verb or a blank, then a quote.
_ASSIGNED = re.compile(r"""[A-Za-z0-9_]{0,20}["']?\s{0,3}(?:(?::=|=>|[:=])|\bis\b)\s{0,3}["'`]?([A-Za-z0-9+/_.~=-]{8,})""")
_BEARER = re.compile(r"""\s{1,3}["'`]?([A-Za-z0-9+/_.~=-]{16,})""")
_IDENTITY = re.compile(r"[\s:#=.]{0,4}(?:(?:no|nr|number|id)\b)?[\s:#=.]{0,4}([A-Z]{0,3}[0-9](?:[ .-]?[0-9]){5,13}[A-Z]?)(?![A-Za-z0-9])", re.I)
_TELEPHONE = re.compile(r"(?:\s?(?:no|nr|number)\b)?[\s:.#]{0,4}(\(?[0-9][0-9() ./-]{5,20}[0-9])(?![0-9])", re.I)
_IBAN = re.compile(r"[\s:#=.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])")
_LOGIN = re.compile(r"[^\s/?#@]{1,128}:[^\s/?#@]{1,128}@[A-Za-z0-9.-]{1,255}")
_OBFUSCATED_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?$")
_OBFUSCATED_RIGHT = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:\s?[\[(]dot[\])]\s?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}")
_NUMBER_LEFT = re.compile(r"(?<![0-9])[0-9]{1,5}[A-Za-z]?,?\s(?:[^\W\d_][\w.'-]{0,30}\s){0,3}$")
_NUMBER_RIGHT = re.compile(r"(?:\s[^\W\d_][\w.'-]{0,30}){0,3},?\s[0-9]{1,5}[A-Za-z]?(?![0-9])")

#: What each anchor leads to. Cues are matched without regard to case, at word starts.
CUES = {
    "account": ("account", "acct", "konto", "compte", "cuenta"),
    "identity": ("ssn", "social security", "passport", "passeport", "pasaporte", "reisepass", "tax id", "tax number", "steuernummer", "codice fiscale", "vat", "driver license", "driver's license", "national id", "dni"),
    "secret": ("token", "secret", "password", "passwd", "passwort", "contraseña", "mot de passe", "api key", "api_key", "apikey", "api-key", "access key", "access_key", "private key", "private_key", "auth_key", "credential"),
    "bearer": ("bearer",),
    "telephone": ("tel", "telephone", "telefon", "teléfono", "téléphone", "phone", "mobile", "fax", "cell", "handy"),
    "iban": ("iban",),
    "left": (" street", " avenue", " road", " lane", " boulevard", " drive", " straße", " strasse"),
    "right": ("calle ", "rue ", "avenida ", "plaza ", "via "),
    "login": ("://",),
    "obfuscated": ("[at]", "(at)"),
}


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for digit in "0123456789":
        a.add_word(digit, ("#", 1))
    for kind, cues in CUES.items():
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def iban_valid(raw: str) -> bool:
    s = raw.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Local part to the left, not before ``floor``; labels with dots to the right."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (m := _LABELS.match(text, at + 1)):
        return None
    return start, m.end()


def _ips(m: re.Match) -> Iterator[Span]:
    """Of a chain of numbers with dots between, each four in turn."""
    parts = m[0].split(".")
    at = m.start()
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
            yield at, end, "ip"
        at = end + 1


def card_valid(raw: str) -> bool:
    digits = raw.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * log2(n / len(s)) for n in Counter(s).values())


def secret_valid(s: str) -> bool:
    """Long and mixed enough to be no word: letters and digits of 3 bits a character, or 2.5 from 16 characters on."""
    if not (any(map(str.isdigit, s)) and any(map(str.isalpha, s))):
        return len(s) >= 20 and entropy(s) >= 3.5
    return entropy(s) >= (2.5 if len(s) >= 16 else 3.0)


def _lowered(text: str) -> str:
    """Lower case of the same length, so that places hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans_of(text: str | None) -> list[Span]:
    """All spans (start, end, kind) of a text, in order of start and kind."""
    if not text:
        return []
    found: list[Span] = []
    mail = phone = chain = digits = 0
    added: list[Span] = []
    for last, (kind, n) in _automaton().iter(_lowered(text)):
        start, end = last - n + 1, last + 1
        if kind == "@":
            if start >= mail and (s := _email(text, start, mail)):
                found.append((*s, "email"))
                mail = s[1]
        elif kind == "#":
            # the first digit of a chain comes first
            if start >= chain:
                if m := _DOTTED.match(text, start):
                    found += _ips(m)
                chain = m.end() if m else _RUN.match(text, start).end()
            if start >= digits:
                m = _DIGITS.match(text, start)
                if m and card_valid(m[0]):
                    found.append((*m.span(), "card"))
                digits = m.end() if m else end
        elif kind == "+":
            # the match ends at the last digit of the run, with something between
            if start >= phone and (m := _PHONE.match(text, start)):
                stop = len(m[0].rstrip(" ().-"))
                if stop >= 4:
                    phone = start + stop
                    if 10 <= sum(c.isdigit() for c in text[start:phone]) <= 15:
                        found.append((start, phone, "phone"))
        elif kind in ("account", "iban"):
            if start and text[start - 1].isalnum() or not (m := (_ACCOUNT if kind == "account" else _IBAN).match(text, end)):
                continue
            if kind == "account" or iban_valid(m[1]):
                added.append((*m.span(1), kind))
        elif kind in ("identity", "telephone"):
            if start and text[start - 1].isalnum() or end < len(text) and text[end].isalpha():
                continue
            if m := (_IDENTITY if kind == "identity" else _TELEPHONE).match(text, end):
                if kind == "identity" or 7 <= sum(map(str.isdigit, m[1])) <= 15:
                    added.append((*m.span(1), kind))
        elif kind in ("secret", "bearer"):
            if (m := (_ASSIGNED if kind == "secret" else _BEARER).match(text, end)) and secret_valid(m[1]):
                added.append((*m.span(1), "secret"))
        elif kind == "login":
            if m := _LOGIN.match(text, end):
                added.append((*m.span(), "login"))
        elif kind == "obfuscated":
            left, right = _OBFUSCATED_LEFT.search(text, max(0, start - 66), start), _OBFUSCATED_RIGHT.match(text, end)
            if left and right:
                added.append((left.start(), right.end(), "obfuscated"))
        elif kind == "left":
            if end < len(text) and text[end].isalnum():
                continue
            if m := _NUMBER_LEFT.search(text, max(0, start - 110), start + 1):
                added.append((m.start(), end, "address"))
        elif not (start and text[start - 1].isalnum()) and (m := _NUMBER_RIGHT.match(text, end - 1)):
            added.append((start, m.end(), "address"))
    # of the added, the longest of those that overlap in one kind
    added.sort(key=lambda s: (ORDER[s[2]], s[0], -s[1]))
    reach: dict[str, int] = {}
    for s in added:
        if s[0] >= reach.get(s[2], 0):
            found.append(s)
            reach[s[2]] = s[1]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            counts: list[list[int]] = [[] for _ in BASE]
            digest, spans = [], []
            for t in b.column(1):
                all_ = spans_of(t.as_py())
                base = [s for s in all_ if s[2] in BASE]
                for c, kind in zip(counts, BASE, strict=True):
                    c.append(sum(s[2] == kind for s in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(all_))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(spans)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    spans: kind:start:end of every span, comma-joined, by start and then kind; places are
    code points, ends exclusive. base_sha256 is over the four base kinds alone, which the
    others never displace.

    Null and empty texts have no spans. Repeated rows and null ids are returned as they
    come; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None, spans: list[Span] | None = None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first, then the longest."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in sorted(spans_of(text) if spans is None else spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])
