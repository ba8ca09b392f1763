"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and cue words. Local parsers expand
each anchor to its boundaries and validate it. A kind's parser never goes back before the end of its last candidate,
so its candidates are the leftmost non-overlapping ones of the kind's pattern; those that fail validation are dropped.
"""

from __future__ import annotations

import hashlib
import string

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

# The kinds in their order; the first four have fixed patterns, the others are added.
KINDS = ("email", "ip", "card", "phone", "account", "address")
BASE = 4
DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
PHONE = frozenset(string.digits + " ().-")
ALNUM = frozenset(string.ascii_letters + string.digits)
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("iban",)
STREET_CUES = (" street", " avenue", " boulevard", " road", "straße", "strasse", "calle ", "rue ")


def automaton() -> ahocorasick.Automaton:
    """Anchors by what they start: email, phone, digit, scheme, account or street cue."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for d in string.digits:
        a.add_word(d, ("digit", 1))
    for kind, words in (("scheme", SCHEMES), ("iban", ACCOUNT_CUES), ("street", STREET_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Expand an at-sign left over the local part and right over two or more labels."""
    start = at
    while start > least and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = _run(text, at + 1, LABEL)
    if end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == "." and (to := _run(text, end + 1, LABEL)) > end + 1:
        end, labels = to, labels + 1
    return (start, end) if labels > 1 else None


def ip_at(text: str, start: int) -> tuple[int, int] | None:
    """Four dotted runs of digits from a digit on."""
    end = _run(text, start, DIGITS)
    for _ in range(3):
        if end >= len(text) or text[end] != "." or (to := _run(text, end + 1, DIGITS)) == end + 1:
            return None
        end = to
    return start, end


def card_at(text: str, start: int) -> tuple[int, int]:
    """Digits from a digit on, single spaces or hyphens between them."""
    end, n = start + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return start, end


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """From a plus sign and a digit to the last digit of the run of phone characters, one or more between them."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in DIGITS else None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_after(text: str, at: int) -> tuple[int, int] | None:
    """An account number after its cue: country, check digits, 11 to 30 characters, single spaces in between; mod 97."""
    while at < len(text) and text[at] in " :=#":
        at += 1
    got, end, i = "", at, at
    while i < len(text) and len(got) < 34:
        if text[i] in ALNUM:
            got, i = got + text[i].upper(), i + 1
            if len(got) >= 15 and got[:2].isalpha() and got[2:4].isdigit() and int("".join(str(int(c, 36)) for c in got[4:] + got[:4])) % 97 == 1:
                end = i
        elif text[i] == " " and i > at:
            i += 1
        else:
            break
    return (at, end) if end > at else None


def credentials_after(text: str, at: int) -> tuple[int, int] | None:
    """user:password@ after a scheme, without the at-sign."""
    end = at
    while end < len(text) and text[end] not in "@/?# \t\r\n\"'<>":
        end += 1
    return (at, end) if end < len(text) and text[end] == "@" and ":" in text[at + 1 : end - 1] else None


def street_around(text: str, at: int, end: int) -> tuple[int, int] | None:
    """A house number before an English street cue, with one to three capitalised words between, or after another cue."""
    if text[at] == " ":
        words, start = 0, at
        while start > 0 and words < 3:
            to = start
            while start > 0 and text[start - 1].isalpha():
                start -= 1
            if to == start or not text[start].isupper():
                return None
            words += 1
            if start == 0 or text[start - 1] != " ":
                return None
            first = start - 1
            while first > 0 and text[first - 1] in DIGITS:
                first -= 1
            if 0 < start - 1 - first <= 5:
                return first, end
            start -= 1
        return None
    start = at
    while start > 0 and text[start - 1].isalpha():
        start -= 1
    if text[at - 1 : at] == " " or not text[start].isupper() and text[at] not in "rc":
        return None
    i, words = end, 0
    while words < 3:
        if text[i : i + 1] == " ":
            i += 1
        last = _run(text, i, DIGITS)
        if 0 < last - i <= 5:
            return start, last
        to = i
        while to < len(text) and text[to].isalpha():
            to += 1
        if to == i or not text[i].isupper():
            return None
        i, words = to, words + 1
    return None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[list[tuple[int, int]]]:
    """For each kind its spans in order, in code points, ends exclusive."""
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    email = ip = card = phone = account = address = 0
    lowered = text.lower()
    if len(lowered) != len(text):  # lower-casing that changes lengths would shift what follows
        lowered = text.translate({c: c + 32 for c in range(65, 91)})
    for last, (kind, size) in anchors.iter(lowered):
        at = last + 1 - size
        if kind == "digit":
            if at >= ip:
                if got := ip_at(text, at):
                    ip = got[1]
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text[at:ip].split("."))):
                        found[1].append(got)
                else:
                    ip = _run(text, at, DIGITS)
            if at >= card:
                got = card_at(text, at)
                card = got[1]
                digits = text[at:card].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found[2].append(got)
        elif kind == "email":
            if at >= email and (got := email_at(text, at, email)):
                email = got[1]
                found[0].append(got)
        elif kind == "phone":
            if at >= phone and (got := phone_at(text, at)):
                phone = got[1]
                if 8 <= sum(c in DIGITS for c in text[at:phone]) <= 15:
                    found[3].append(got)
        elif kind == "street":
            if at >= address and (got := street_around(text, at, last + 1)) and got[0] >= address:
                address = got[1]
                found[5].append(got)
        elif last + 1 >= account and (got := (iban_after if kind == "iban" else credentials_after)(text, last + 1)):
            account = got[1]
            found[4].append(got)
    return found


def written(found: list[list[tuple[int, int]]], kinds: int) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k in range(kinds) for s, e in found[k])


def redact(text: str, found: list[list[tuple[int, int]]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its first kind's name in brackets."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, rows in enumerate(found) for s, e in rows):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans; texts are read whole, however long; where spans of several kinds overlap each stays;
    repeated rows each give a row; an empty table gives an empty result; other columns are not read.
    """

    def run(batches):
        anchors = automaton()
        for b in batches:
            rows = []
            for t in b["text"]:
                f = spans(t or "", anchors)
                rows.append((*(len(f[k]) for k in range(BASE)), hashlib.sha256(written(f, BASE).encode()).hexdigest(), written(f, len(KINDS))))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the same columns and rows, spans in text replaced by their kinds, and n_chars, where docs has it, anew.

    Null and empty texts stay as they are; overlapping spans become one; repeated rows stay repeated; texts are read
    whole, however long; an empty table stays empty; columns of any other name pass through.
    """
    chars = "n_chars" in docs.columns

    def run(batches):
        anchors = automaton()
        for b in batches:
            b["text"] = [t if not t or not any(f := spans(t, anchors)) else redact(t, f) for t in b["text"]]
            if chars:
                b["n_chars"] = [n if t is None else len(t) for t, n in zip(b["text"], b["n_chars"])]
            yield b

    return docs.mapInPandas(run, docs.schema)
