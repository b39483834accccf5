"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, schemes, plus signs, digits and
identifier cues. A deterministic local parser then expands each anchor to its boundaries and
validates it, so that no pattern is tried where no anchor stands. Reading is map-only: no shuffle.

Base kinds (email, ip, card, phone): the leftmost non-overlapping matches of the stated patterns, a
kind at a time; matches that fail their check are dropped without a retry. Added kinds: `login`
(a URL that carries user information), `iban` (checked by mod 97), `account` (a number after an
account cue), `masked` (an address written with (at) or [at]) and `secret` (what a token, password or key
cue is set to: eight characters or more, with a digit and a letter).

Defined cases: a null or empty text has no spans, and base_sha256 is that of the empty string; offsets
are code points, ends exclusive; repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from costloom.llm.common import row_schema, slices, text_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "masked", "secret")
CUES = {  # fixed values: identifier cues, matched in lower, upper and title case
    "iban": "iban",
    "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account",
    "(at)": "masked", "[at]": "masked",
    "token": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "apikey": "secret", "api_key": "secret", "api-key": "secret",
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:<>\"']+(?::[^\s/@<>\"']*)?@[^\s/<>\"'?#]+")
_IBAN = re.compile(r"[ :#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:[ :#.]|(?i:number|nummer|no|nr)){0,6}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
IBAN_LENGTHS = {c: n for n, names in {  # fixed values: lengths by country
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in names.split()}
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_./+=~-]{8,})")
_MASKED = re.compile(r" ?([A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+)")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words = {"@": "@", "://": "scheme", "+": "+"} | {str(d): "digit" for d in range(10)}
    for cue, kind in CUES.items():
        words |= {form: kind for form in (cue, cue.upper(), cue.title())}
    for word, kind in words.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def byte_parts(address: str) -> bool:
    parts = (p.lstrip("0") for p in address.split("."))
    return all(len(p) < 4 and int(p or 0) <= 255 for p in parts)


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def iban_size(run: str) -> int:
    """Characters of the run's IBAN: as long as its country has it, else the longest valid start; 0 if none."""
    ends = [i + 1 for i, c in enumerate(run) if c != " "]
    known = IBAN_LENGTHS.get(run[:2])
    for n in [known] if known else range(len(ends), 14, -1):
        if n <= len(ends) and mod97(run[: ends[n - 1]].replace(" ", "")):
            return ends[n - 1]
    return 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def spans_of(text: str, machine) -> list[tuple[int, int, str, int]]:
    """(start, order of kind, kind, end) of every span, sorted."""
    out = []
    ends = dict.fromkeys(KINDS, 0)
    ip_from = 0

    def keep(kind: str, start: int, end: int) -> None:
        out.append((start, KINDS.index(kind), kind, end))

    def left_run(at: int, least: int) -> int:
        while at > least and text[at - 1] in LOCAL:
            at -= 1
        return at

    for last, (width, what) in machine.iter(text):
        at = last - width + 1
        if what == "digit":
            if at >= ip_from:
                if m := _IP.match(text, at):
                    ip_from = m.end()
                    if byte_parts(m[0]):
                        keep("ip", at, m.end())
                else:  # no later start among the same digits can match either
                    ip_from = _DIGITS.match(text, at).end()
            if at >= ends["card"] and (m := _CARD.match(text, at)):
                ends["card"] = m.end()
                digits = digits_of(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    keep("card", at, m.end())
        elif what == "@":
            if at >= ends["email"]:
                start = left_run(at, ends["email"])
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    ends["email"] = m.end()
                    keep("email", start, m.end())
        elif what == "+":
            if at >= ends["phone"] and (m := _PHONE.match(text, at)):
                ends["phone"] = m.end()
                if 9 <= len(digits_of(m[0])) <= 15:
                    keep("phone", at, m.end())
        elif what == "scheme":
            start = left_run(at, ends["login"])
            if start < at and (m := _LOGIN.match(text, last + 1)):
                ends["login"] = m.end()
                keep("login", start, m.end())
        elif what == "iban":
            if (m := _IBAN.match(text, last + 1)) and (size := iban_size(m[1])):
                keep("iban", m.start(1), m.start(1) + size)
        elif what == "account":
            if at >= ends["account"] and (m := _ACCOUNT.match(text, last + 1)):
                ends["account"] = m.end()
                keep("account", m.start(1), m.end(1))
        elif what == "secret":
            m = _SECRET.match(text, last + 1) if at >= ends["secret"] else None
            if m and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                ends["secret"] = m.end()
                keep("secret", m.start(1), m.end(1))
        else:
            before = at - (at > 0 and text[at - 1] == " ")
            start = left_run(before, ends["masked"])
            if start < before and (m := _MASKED.match(text, last + 1)):
                ends["masked"] = m.end()
                keep("masked", start, m.end())
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (all kinds) of each row."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in slices(batches, 1):
            rows = [spans_of(t, machine) if t else [] for t in b.column(1).to_pylist()]
            base = [[s for s in r if s[2] in BASE] for r in rows]
            cols = {id_col: b.column(0)}
            cols |= {f"n_{k}": pa.array([sum(s[2] == k for s in r) for r in base], pa.int64()) for k in BASE}
            cols["base_sha256"] = pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string())
            cols["spans"] = pa.array([joined(r) for r in rows], pa.string())
            cols["n_added"] = pa.array([len(r) - len(s) for r, s in zip(rows, base)], pa.int64())
            cols["n_spans"] = pa.array([len(r) for r in rows], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    schema = row_schema([docs.schema[id_col]], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
