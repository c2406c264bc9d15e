"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, digits, schemes and identifier cues. Each anchor is handed to a local
parser that expands it to its left and right and validates what it found. No
parser looks further than the run of characters it accepts, so the work is
linear in the text.

Kinds, in their fixed order: email, ip, card, phone (the base kinds, whose
matches equal those of four regular expressions searched leftmost and without
overlap), then url (a scheme with user info or an identifying query), account
(an account number after a cue word, IBAN check digits verified) and secret (a
password, token or key after its cue).

Defined results: a null text counts as empty and has no spans; a null id is
kept; ties in start are listed in the order of the kinds; repeated rows are
judged alone; an empty table gives an empty table; of further input columns
none is read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.arrow import slices

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]
_RANK = {kind: i for i, kind in enumerate(KINDS)}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s\"'<>]+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_SCHEME_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_IDENTIFYING = re.compile(r"[?&](?:e?mail|user(?:name)?|token|session|password|phone)=[^&#]+", re.I)
_ACCOUNT = re.compile(r"[\s:#=.]{1,4}(?:no\.?|number|nr\.?)?[\s:#=.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}|[0-9](?:[ -]?[0-9]){5,19})(?![A-Za-z0-9])")
_SECRET = re.compile(r"\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9+/_=-]{8,})")
#: Cue words and the parser that each one starts.
_CUES = {"account": "account", "Account": "account", "ACCOUNT": "account", "iban": "account", "IBAN": "account", "konto": "account", "Konto": "account", "cuenta": "account", "Cuenta": "account", "compte": "account", "Compte": "account", "password": "secret", "Password": "secret", "passwd": "secret", "token": "secret", "Token": "secret", "api_key": "secret", "apikey": "secret", "secret": "secret"}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    found.add_word("://", ("url", 3))
    for word, parser in _CUES.items():
        found.add_word(word, (parser, len(word)))
    found.make_automaton()
    return found


_ANCHORS = None


def luhn(digits: str) -> bool:
    """Whether a string of ASCII digits has a valid Luhn check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(code: str) -> bool:
    """Whether the ISO 13616 check digits hold."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by start and then by kind."""
    global _ANCHORS
    if not text:
        return []
    _ANCHORS = _ANCHORS or _automaton()
    found: list[tuple[str, int, int]] = []
    email = ip = card = phone = url = 0  # where the next match of each kind may start
    for last, (kind, width) in _ANCHORS.iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(part) <= 3 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in m.group().split("."))):
                        found.append(("ip", at, ip))
                else:
                    ip = _DIGITS.match(text, at).end()
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                if m.end() - at >= 12:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", at, card))
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                found.append(("email", start, email))
        elif kind == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
                    found.append(("phone", at, phone))
        elif kind == "url":
            begin = at
            while begin > url and text[begin - 1] in _SCHEME_PART:
                begin -= 1
            head = _SCHEME.search(text, begin, at)
            if head and (m := _AUTHORITY.match(text, at + 3)):
                end, body = m.end(), m.group()
                url = end
                if "@" in re.split(r"[/?#]", body, maxsplit=1)[0] or _IDENTIFYING.search(body):
                    found.append(("url", head.start(), end))
        elif kind == "account":
            if m := _ACCOUNT.match(text, last + 1):
                code = m.group(1)
                if code[0].isdigit() or iban(code):
                    found.append(("account", *m.span(1)))
        elif (m := _SECRET.match(text, last + 1)) and any(c.isdigit() for c in m.group(1)):
            found.append(("secret", *m.span(1)))
    found = list(dict.fromkeys(found))
    found.sort(key=lambda s: (s[1], _RANK[s[0]], s[2]))
    return found


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with every maximal covered stretch replaced by its first kind in brackets."""
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        kind, start, end = found[i]
        i += 1
        while i < len(found) and found[i][1] < end:
            end = max(end, found[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns in keep, counts of the base kinds, all spans, and the redacted text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, "_text"):
            rows = [spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *piece.columns[1:],
                    *(pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in BASE),
                    pa.array([hashlib.sha256(joined([s for s in r if s[0] in BASE]).encode()).hexdigest() for r in rows]),
                    pa.array([joined(r) for r in rows], pa.string()),
                    pa.array([redacted(t, r) for t, r in zip(texts, rows)], pa.string()),
                ],
                names=[*piece.schema.names[1:], *(f"n_{k}" for k in BASE), "base_sha256", "spans", "redacted"],
            )

    rows = docs.select(F.col(text_col).alias("_text"), *dict.fromkeys([id_col, *keep]))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(scan, f"{own}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("redacted")
