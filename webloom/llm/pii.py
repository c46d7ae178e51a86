"""Personal data by anchor expansion (operator 4).

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and cues;
from there local parsers expand to the whole address, number or account, and
check it.  No text is searched with an expression.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import utf8

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALNUM = _DIGITS | _LETTERS
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_HEX = frozenset("0123456789abcdefABCDEF")
_URL_END = frozenset(" \t\n\x0b\x0c\r\"'<>|\\^`{}")

#: Cues of secrets and accounts, and the kinds in the order in which equal starts are written.
_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")
_ACCOUNT_CUES = ("iban", "ssn", "account")
KINDS = ("email", "ip", "card", "phone", "url", "secret", "iban", "ssn")
#: Fixed value: letters and digits in an account number, by country.
_IBAN_SIZES = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
_IBAN_SIZE = {x[:2]: int(x[2:]) for x in _IBAN_SIZES.split()}
_RANK = {k: i for i, k in enumerate(KINDS)}
_SIGNS = ("@", "://", "+", *_DIGITS)


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for sign in _SIGNS:
        out.add_word(sign, ("digit", 1) if sign in _DIGITS else (sign, len(sign)))
    for cue in (*_CUES, *_ACCOUNT_CUES):
        for form in {cue, cue.upper(), cue.capitalize()}:
            out.add_word(form, ("secret" if cue in _CUES else cue, len(form)))
    out.make_automaton()
    return out


_FOUND: list[ahocorasick.Automaton] = []


def anchors(text: str) -> Iterator[tuple[int, str, int]]:
    """(end of the sign, exclusive; kind; its length)."""
    if not _FOUND:
        _FOUND.append(_automaton())
    for at, (kind, size) in _FOUND[0].iter(text):
        yield at + 1, kind, size


def _while(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the at-sign at `at`; not before floor."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _while(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    last = None
    while end < len(text) and text[end] == "." and (more := _while(text, end + 1, _LABEL)) > end + 1:
        last = end = more
    return (start, last) if last else None


def _digit_runs(text: str, at: int) -> tuple[list[tuple[int, int]], list[str]]:
    """Runs of digits from `at` on with one character between them (a dot, a space, a hyphen), and these characters."""
    found, between = [], []
    while True:
        end = _while(text, at, _DIGITS)
        found.append((at, end))
        if end + 1 < len(text) and text[end] in ".- " and text[end + 1] in _DIGITS:
            between.append(text[end])
            at = end + 1
        else:
            return found, between


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def numbers(text: str, at: int) -> tuple[int, list[tuple[int, int, str]]]:
    """(where the run ends, spans): addresses and card numbers in the digits from `at` on."""
    found, between = _digit_runs(text, at)
    out = []
    k = 0
    while k + 3 < len(found):  # four parts with dots
        if between[k : k + 3] == [".", ".", "."]:
            parts = [text[a:b].lstrip("0") or "0" for a, b in found[k : k + 4]]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append((found[k][0], found[k + 3][1], "ip"))
            k += 4
        else:
            k += 1
    a = 0
    for b in range(len(found)):  # digits with spaces and hyphens
        if b == len(between) or between[b] == ".":
            start, end = found[a][0], found[b][1]
            digits = "".join(text[x:y] for x, y in found[a : b + 1]) if end - start <= 64 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((start, end, "card"))
            a = b + 1
    return found[-1][1], out


def phone(text: str, at: int) -> tuple[int, int] | None:
    """From the plus sign at `at` on."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _while(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < at + 4 or text[end - 1] not in _DIGITS:
        return None
    count = 0
    for c in text[at:end] if end - at <= 4096 else filter(_DIGITS.__contains__, text[at:end]):
        count += c in _DIGITS
    return (at, end, count)  # type: ignore[return-value]


def _after_cue(text: str, at: int) -> int:
    """Where a value begins after a cue: past one run of spaces, quotes and one of : = #."""
    at = _while(text, at, frozenset(" \t\"'"))
    if at < len(text) and text[at] in ":=#":
        return _while(text, at + 1, frozenset(" \t\"'"))
    return at


def secret(text: str, at: int) -> tuple[int, int] | None:
    """A value of 16 or more letters and digits, of both kinds, that an equals sign or colon gives to a cue."""
    start = _after_cue(text, at)
    if not any(c in ":=" for c in text[at:start]):
        return None
    end = _while(text, start, _ALNUM | frozenset("_-"))
    value = text[start:end]
    return (start, end) if len(value) >= 16 and any(c in _DIGITS for c in value) and any(c in _LETTERS for c in value) else None


def iban(text: str, at: int) -> tuple[int, int] | None:
    """An account number with two letters, two digits and 11 to 30 more, whose remainder by 97 is 1.

    It is as long as its country has it; for other letters, the longest that no letter or digit follows.
    """
    start = _after_cue(text, at)
    kept, end, last = "", start, None
    while end < len(text) and len(kept) < 34 and (text[end] in _ALNUM or text[end] == " " and end + 1 < len(text) and text[end + 1] in _ALNUM):
        if text[end] != " ":
            kept += text[end].upper()
            size = _IBAN_SIZE.get(kept[:2])
            whole = len(kept) == size if size else len(kept) >= 15 and (end + 1 == len(text) or text[end + 1] not in _ALNUM)
            if whole and kept[:2].isalpha() and kept[2:4].isdigit() and int("".join(str(int(c, 36)) for c in kept[4:] + kept[:4])) % 97 == 1:
                last = end + 1
        end += 1
    return (start, last) if last else None


def ssn(text: str, at: int) -> tuple[int, int] | None:
    """ddd-dd-dddd after a cue, with no part of zeros, and not from 666 or 900 on."""
    start = _after_cue(text, at)
    found, between = _digit_runs(text, start) if start < len(text) and text[start] in _DIGITS else ([], [])
    if [b - a for a, b in found] != [3, 2, 4] or between != ["-", "-"]:
        return None
    a, b, c = (text[x:y] for x, y in found)
    return (start, found[-1][1]) if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else None


def _address_end(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] not in _URL_END:
        at += 1
    return at


def url_with_user(text: str, at: int, size: int, end: int) -> tuple[int, int] | None:
    """An address with a user name or password before its host; it goes on to `end`."""
    start = at - size
    while start > 0 and text[start - 1] in _ALNUM and at - start < 20:
        start -= 1
    slash = text.find("/", at, end)
    stop = end if slash < 0 else slash
    return (start, end) if start < at - size and at < text.rfind("@", at, stop) < stop - 1 else None


def spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) of what is found; base ones by the plain rules of email, ip, card and phone."""
    out: list[tuple[int, int, str, bool]] = []
    mail = runs = plus = address = 0
    for end, kind, size in anchors(text):
        at = end - size
        if kind == "@":
            if at >= mail and (found := email(text, at, mail)):
                mail = found[1]
                out.append((*found, "email", True))
        elif kind == "digit":
            if at >= runs:
                runs, more = numbers(text, at)
                out += [(*x, True) for x in more]
        elif kind == "+":
            if at >= plus and (found := phone(text, at)):
                plus = found[1]
                if 9 <= found[2] <= 15:
                    out.append((found[0], found[1], "phone", True))
        elif kind == "://":
            if end > address:  # signs in one address have one end
                address = _address_end(text, end)
            if found := url_with_user(text, end, size, address):
                out.append((*found, "url", False))
        elif found := {"secret": secret, "iban": iban, "account": iban, "ssn": ssn}[kind](text, end):
            out.append((*found, "iban" if kind == "account" else kind, False))
    return sorted(set(out), key=lambda s: (s[0], _RANK[s[2]], s[1]))


def _joined(found: list[tuple[int, int, str, bool]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in found)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, body in zip(*batch.columns, strict=True):
            found = spans(body.as_py().decode("utf-8", "replace"))
            base = [s for s in found if s[3]]
            count = {k: sum(s[2] == k for s in base) for k in KINDS[:4]}
            more = {k: sum(s[2] == k for s in found) for k in KINDS[4:]}
            rows.append((doc.as_py(), *count.values(), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), *more.values()))
        columns = list(zip(*rows, strict=True)) or [()] * 11
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *(f"n_{k}" for k in KINDS[4:])])


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in every text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all, as
    kind:start:end in code points, end exclusive, by start and kind), n_url, n_secret, n_iban and n_ssn, a row for each input row, rows that repeat included.
    Beyond the four base kinds: url (an address with a user name), secret, iban and ssn, each
    after its cue and checked.  Null text is empty: no spans; an empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("body"))
    return rows.mapInArrow(_search, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS[4:]))
