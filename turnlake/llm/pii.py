"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs before digits,
digits, URL schemes and identifier cues (of accounts and of secrets). A deterministic parser
per anchor expands to both sides and validates what it finds, so the work is linear in the
text.

Kinds email, ip, card and phone have base spans: leftmost, non-overlapping per kind, a
failing match dropped without retry. The parsers add spans that base matching loses:
numbers that run together (a phone number before a card number), IBANs and numbers after
an account cue, URLs that carry a user name or password, and secrets: the value that follows
a cue and ":" or "=", if it is quoted or mixes letters and digits, and keys that begin with
a known prefix.

Edge cases: null is an empty text; texts of any length are read whole; the result has a
row per input row, so repeated rows repeat. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from turnlake.llm.common import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url", "secret")
CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "iban", "Iban", "IBAN")
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://")
#: Cues of secrets, in any case, and beginnings of keys with how many characters follow; fixed values.
SECRETS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "client_key", "auth_key")
PREFIXES = {"AKIA": 16, "ghp_": 36, "gho_": 36, "xoxb-": 20, "xoxp-": 20, "sk_live_": 16}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}").match
_DIGITS = re.compile(r"[0-9]+").match
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_NUMBERS = re.compile(r"[0-9]+").finditer
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}").match
_CUED = re.compile(r"(?:[\x20]?(?:number|no\.?|#))?[\x20]?[:#=]?[\x20]?", re.I).match
_ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,17}(?![0-9])").match
_ASSIGNED = re.compile(r"[\"']?[\x20\t]{0,4}(?::=|=>|[:=])[\x20\t]{0,4}").match
_QUOTED = re.compile(r"\"[^\"\s]{6,512}\"|'[^'\s]{6,512}'").match
_BARE = re.compile(r"[A-Za-z0-9_+/=~.-]{8,512}").match
_KEY = re.compile(r"[A-Za-z0-9_-]{1,512}").match
_LOGIN = re.compile(r"[^\s/@<>\"']+@[^\s<>\"']+").match


@functools.cache
def _anchors():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for word, kind in [("@", "@"), *((d, "0") for d in "0123456789"), *((f"+{d}", "+") for d in "0123456789"),
                       *((c, "cue") for c in CUES), *((s, "scheme") for s in SCHEMES), *((p, "prefix") for p in PREFIXES),
                       *((c, "secret") for s in SECRETS for c in {s, s.title(), s.upper()})]:
        auto.add_word(word, (kind, len(word)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _is_card(text: str, a: int, b: int) -> bool:
    digits = text[a:b].replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _cards_inside(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Cards among the digit groups of a run that fails as a whole; fewest groups first from each start."""
    groups, found, i = [m.span() for m in _NUMBERS(text, a, b)], [], 0
    while i < len(groups):
        j, n = i, 0
        while j < len(groups) and n < 20:
            n += groups[j][1] - groups[j][0]
            if 13 <= n <= 19 and _is_card(text, groups[i][0], groups[j][1]):
                found.append((groups[i][0], groups[j][1]))
                i = j
                break
            j += 1
        i += 1
    return found


def _phone_prefix(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The longest prefix of a too long number that ends with a digit group and has 9 to 15 digits."""
    best, n = None, 0
    for m in _NUMBERS(text, a, b):
        n += m.end() - m.start()
        if n > 15:
            break
        if n >= 9:
            best = (a, m.end())
    return best


def _secret(text: str, end: int) -> tuple[int, int] | None:
    """The value assigned to a cue that ends before end."""
    m = _ASSIGNED(text, end)
    if m is None:
        return None
    at = m.end()
    if m := _QUOTED(text, at):
        return m.start() + 1, m.end() - 1
    m = _BARE(text, at)
    if m and any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])):
        return m.start(), m.start() + len(m[0].rstrip("."))
    return None


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and all spans, per kind, ordered by start."""
    base = {k: [] for k in BASE_KINDS}
    more = {k: [] for k in KINDS}
    email_at = ip_at = card_at = account_at = url_at = secret_at = 0  # where each kind's search goes on
    for last, (anchor, n) in _anchors().iter(text):
        at = last - n + 1
        if anchor == "0":
            if at >= card_at:
                m = _CARD(text, at)
                card_at = m.end() if m else at + 1
                if m and m.end() - at >= 13:
                    if _is_card(text, at, m.end()):
                        base["card"].append(m.span())
                    else:
                        more["card"] += _cards_inside(text, at, m.end())
            if at >= ip_at:
                m = _IP(text, at)
                ip_at = m.end() if m else _DIGITS(text, at).end()
                if m and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                    base["ip"].append(m.span())
        elif anchor == "@":
            start = at
            while start > email_at and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _HOST(text, at + 1)):
                base["email"].append((start, m.end()))
                email_at = m.end()
        elif anchor == "+":
            if m := _PHONE(text, at):
                digits = sum(map(str.isdigit, m[0]))
                if 9 <= digits <= 15:
                    base["phone"].append(m.span())
                elif digits > 15 and (span := _phone_prefix(text, at, m.end())):
                    more["phone"].append(span)
        elif anchor == "cue" and last + 1 > account_at:
            start = _CUED(text, last + 1).end()
            m = _IBAN(text, start)
            while m and not _iban_ok(m[0]) and " " in m[0]:
                cut = m[0].rindex(" ")
                m = _IBAN(text, start, start + cut)
            if not (m and _iban_ok(m[0])):
                m = _ACCOUNT(text, start)
            if m:
                more["account"].append(m.span())
                account_at = m.end()
        elif anchor == "scheme" and at >= url_at and (m := _LOGIN(text, last + 1)):
            more["url"].append((at, m.end()))
            url_at = m.end()
        elif anchor == "secret" and at >= secret_at and (span := _secret(text, last + 1)):
            more["secret"].append(span)
            secret_at = span[1]
        elif anchor == "prefix" and at >= secret_at and (m := _KEY(text, last + 1)) and len(m[0]) >= PREFIXES[text[at : last + 1]]:
            more["secret"].append((at, m.end()))
            secret_at = m.end()
    every = {k: sorted(set(base.get(k, []) + more[k])) for k in KINDS}
    return base, every


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, at in spans.items() for a, b in at)


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done, until = [], 0, -1
    for a, b, k in sorted((a, b, k) for k, at in spans.items() for a, b in at):
        if a >= until:
            out += [text[done:a], f"[{k.upper()}]"]
        until = max(until, b)
        done = until
    return "".join([*out, text[done:]])


FOUND = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_account: long, n_url: long, n_secret: long, n_spans: long>"
_NONE = hashlib.sha256(b"").hexdigest()


def _found(text: pa.Array) -> pa.Array:
    rows = []
    for x in text:
        base, every = find(x.as_py() or "")
        joined = _joined(base)
        added = {f"n_{k}": len(every[k]) for k in KINDS if k not in BASE_KINDS}
        rows.append({f"n_{k}": len(base[k]) for k in BASE_KINDS} | added | {"base_sha256": hashlib.sha256(joined.encode()).hexdigest() if joined else _NONE, "spans": _joined(every), "n_spans": sum(map(len, every.values()))})
    kinds, more = [(f"n_{k}", pa.int64()) for k in BASE_KINDS], [(f"n_{k}", pa.int64()) for k in KINDS if k not in BASE_KINDS]
    return pa.array(rows, pa.struct([*kinds, ("base_sha256", pa.string()), ("spans", pa.string()), *more, ("n_spans", pa.int64())]))


def _redacted(text: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else redact(t, find(t)[1]) for x in text], pa.string())


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, counts of base spans, their digest, all spans, and counts of
    the kinds that the method adds and of all spans."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", arrow_udf(_found, FOUND)("text").alias("f")).select("doc_id", "f.*")


def redacted(text: Column | str) -> Column:
    """The text with its personal data replaced by the kinds' names."""
    return arrow_udf(_redacted, "string")(text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs, with all their columns and rows, with redacted texts; null texts stay null."""
    bounded_batches(docs.sparkSession)
    out = docs.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
