"""Format-preserving pseudonyms of personal data.

Validated values (payment cards by their Luhn digit, IBANs by their remainder, phone
numbers, IPv4 addresses, social security numbers, calendar dates, mail addresses, keys in hexadecimal and
access keys with a known beginning) are replaced by other valid values of the same format.  Where a run of digits or letters isn't valid
as a whole, its shorter parts between separators are tried, and only valid values take up text.  The value is ranked among the
values of its format and the rank is permuted by a keyed Feistel network with cycle
walking, so the replacement is a bijection of the format: equal values get equal pseudonyms in
every document, different ones stay different, and separators stay where they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import limit_batches

ROUNDS = 10
#: First day and number of days of the dates that are permuted (1800 to 2199).
FIRST_DAY, DAYS = date(1800, 1, 1), (date(2200, 1, 1) - date(1800, 1, 1)).days
#: English month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Beginnings of access keys.
KEY_BEGINNINGS = ["sk_live_", "sk_test_", "pk_live_", "pk_test_", "rk_live_", "rk_test_", "ghp_", "gho_", "ghs_", "ghr_", "ghu_", "AKIA", "ASIA", "xoxb-", "xoxp-", "xoxa-"]

_MONTH = "(?:" + "|".join(MONTHS) + ")"
#: Candidates of each kind; a group named v, where there is one, holds the value.  None is longer than
#: its longest value, so that a refused one costs no more than that.
_PATTERNS = {
    "date": re.compile(r"\b(?:\d{4}-\d\d-\d\d(?=T\d|\b)|\d{1,2}([/.-])\d{1,2}\1\d{4}\b|\d{1,2} " + _MONTH + r" \d{4}\b|" + _MONTH + r" \d{1,2}, ?\d{4}\b)"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"),
    "phone": re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w+-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])|(?i:\bssn|\bsocial security (?:number|no\.?))[:#]?\s{0,3}(?P<v>\d{9})(?!\w)"),
    "hex": re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d\d(?: ?[0-9A-Z]){11,30}"),
    "key": re.compile(r"(?<![0-9A-Za-z])(?:" + "|".join(map(re.escape, KEY_BEGINNINGS)) + r")[0-9A-Za-z-]{16,}(?![0-9A-Za-z])"),
}
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")


class Feistel:
    """Keyed permutations of range(size), one for each format name."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, value: int, size: int, name: str, back: bool = False) -> int:
        if not 0 <= value < size:
            raise ValueError("value outside its format")
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            value = self._once(value, half, f"{name}/{size}", back)
            if value < size:
                return value

    def _once(self, value: int, half: int, name: str, back: bool) -> int:
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        rounds = range(ROUNDS)
        for r in reversed(rounds) if back else rounds:
            if back:
                left, right = right ^ self._round(left, r, half, name), left
            else:
                left, right = right, left ^ self._round(right, r, half, name)
        return left << half | right

    def _round(self, x: int, r: int, half: int, name: str) -> int:
        size = (half + 7) // 8
        data = b"%d|%s|" % (r, name.encode()) + x.to_bytes(size, "little")
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(data + b"|%d" % block, key=self.key, digest_size=min(64, size + 8)).digest()
            block += 1
        return int.from_bytes(out[:size], "little") & ((1 << half) - 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _refill(pattern: str, new: str, kind: str = r"[0-9A-Za-z]") -> str:
    """Put the characters of ``new`` in the places of ``pattern`` that hold characters of ``kind``."""
    it = iter(new)
    return re.sub(kind, lambda _: next(it), pattern)


def _mixed(text: str, feistel: Feistel, name: str, back: bool) -> str:
    """Permute letters and digits of ``text`` within their kinds; other characters stay."""
    kinds = [(c, 1) if not c.isascii() else ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) if c.isupper() else (c, 1) for c in text]
    value, size = 0, 1
    for c, (base, n) in zip(text, kinds):
        value, size = value * n + (ord(c) - ord(base) if n > 1 else 0), size * n
    value = feistel.permute(value, size, name + "".join(b for b, _ in kinds), back)
    out = []
    for base, n in reversed(kinds):
        out.append(chr(ord(base) + value % n) if n > 1 else base)
        value //= n
    return "".join(reversed(out))


def _date(text: str) -> tuple[date, str] | None:
    """The day and the format of a valid date; day-first where both orders are possible."""
    try:
        if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", text):
            return date(*map(int, m.groups())), "ymd"
        if m := re.fullmatch(r"(\d{1,2})([/.-])(\d{1,2})[/.-](\d{4})", text):
            a, b, y = int(m[1]), int(m[3]), int(m[4])
            pad = "2" if len(m[1]) == 2 and len(m[3]) == 2 else "1"
            return (date(y, b, a), f"d{m[2]}{pad}") if b <= 12 else (date(y, a, b), f"m{m[2]}{pad}")
        if m := re.fullmatch(r"([A-Z][a-z]+) (\d{1,2}),( ?)(\d{4})", text):
            return date(int(m[4]), MONTHS.index(m[1]) + 1, int(m[2])), "word," + m[3]
        d, month, y = text.split(" ")
        return date(int(y), MONTHS.index(month) + 1, int(d)), "word"
    except ValueError:
        return None


def _show(day: date, form: str) -> str:
    if form == "ymd":
        return day.isoformat()
    if form == "word":
        return f"{day.day} {MONTHS[day.month - 1]} {day.year}"
    if form.startswith("word,"):
        return f"{MONTHS[day.month - 1]} {day.day}{form[4:]}{day.year}"
    width = "02d" if form[2] == "2" else "d"
    first, second = (day.day, day.month) if form[0] == "d" else (day.month, day.day)
    return f"{first:{width}}{form[1]}{second:{width}}{form[1]}{day.year:04d}"


def _month_first(day: date) -> bool:
    return day.day > 12


def pseudonym(kind: str, text: str, feistel: Feistel, back: bool = False) -> str | None:
    """The pseudonym of a value, or None where it isn't valid for its kind."""
    digits = re.sub(r"\D", "", text)
    if kind == "card":
        if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
            return None
        body = f"{feistel.permute(int(digits[:-1]), 10 ** (len(digits) - 1), 'card', back):0{len(digits) - 1}d}"
        return _refill(text, body + next(c for c in "0123456789" if luhn(body + c)), r"\d")
    if kind == "iban":
        flat = text.replace(" ", "")
        if not 15 <= len(flat) <= 34 or int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 != 1:
            return None
        body = _mixed(flat[4:], feistel, "iban" + flat[:2], back)
        check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
        return _refill(text, f"{flat[:2]}{check:02d}{body}")
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        value = feistel.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip", back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .-]|\()", text)
        keep = len(re.sub(r"\D", "", country[0])) if country else 0
        if not 7 <= len(digits) - keep <= 15:
            return None
        body = digits[keep:]
        new = f"{feistel.permute(int(body), 10 ** len(body), 'phone' + digits[:keep], back):0{len(body)}d}"
        return _refill(text, digits[:keep] + new, r"\d")
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rank = feistel.permute(rank, 898 * 99 * 9999, "ssn", back)
        area, group, serial = rank // (99 * 9999) + 1, rank // 9999 % 99 + 1, rank % 9999 + 1
        return _refill(text, f"{area + (area >= 666):03d}{group:02d}{serial:04d}", r"\d")
    if kind == "date":
        if not (known := _date(text)) or not 0 <= (known[0] - FIRST_DAY).days < DAYS:
            return None
        day, form = known
        while True:  # month-first and unpadded forms walk on until the day can be told in that form
            day = FIRST_DAY + timedelta(feistel.permute((day - FIRST_DAY).days, DAYS, "date" + ("m" if form[0] == "m" else ""), back))
            if form[0] != "m" or _month_first(day):
                return _show(day, form)
    if kind == "hex":
        if not re.search("[a-fA-F]", text) or not digits:
            return None
        value = f"{feistel.permute(int(text, 16), 16 ** len(text), 'hex', back):0{len(text)}x}"
        return value.upper() if text.upper() == text else value
    if kind == "key":
        begin = next(k for k in KEY_BEGINNINGS if text.startswith(k))
        return begin + _mixed(text[len(begin) :], feistel, "key" + begin, back) if any(map(str.isdigit, text)) else None
    if kind == "mail":
        local, domain = text.rsplit("@", 1)
        name, _, top = domain.rpartition(".")
        return f"{_mixed(local, feistel, 'mail', back)}@{_mixed(name, feistel, 'host', back)}.{top}"
    raise ValueError(kind)


def _parts(kind: str, text: str, start: int, end: int) -> Iterator[int]:
    """Ends of what may be a value from ``start`` on: those of cards and IBANs at separators, the likelier first."""
    if kind not in ("card", "iban"):
        yield end
        return
    ends, size = {}, 0
    for at in range(start, end):
        size += text[at] not in " -"
        if at + 1 == len(text) or not text[at + 1].isalnum():
            ends[size] = at + 1
    if kind == "card":
        after = lambda at: text[at : at + 1] == "-" or text[at : at + 1] == "_"
        yield from (ends[n] for n in range(19, 12, -1) if n in ends and not after(ends[n]))
        return
    known = IBAN_LENGTHS.get(text[start : start + 2])
    yield from (ends[n] for n in ([known] if known else range(34, 14, -1)) if n in ends)


def find(text: str, feistel: Feistel) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values, in order and without overlap."""
    spans = []
    if "@" in text:
        at, done = text.find("@"), 0
        while at >= 0:  # match around each sign: the pattern alone would rescan every word
            low = at
            while low > done and (text[low - 1].isascii() and text[low - 1].isalnum() or text[low - 1] in "._%+-"):
                low -= 1
            if low < at and (m := _MAIL.match(text, low)):
                spans.append((m.start(), m.end(), "mail", pseudonym("mail", m.group(), feistel)))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    for kind, pattern in _PATTERNS.items():
        m = pattern.search(text)
        while m:
            start, end = m.span("v") if "v" in pattern.groupindex and m["v"] else m.span()
            again = end if kind == "key" else start + 1  # no part of a refused key has a digit
            for stop in _parts(kind, text, start, end):
                if (new := pseudonym(kind, text[start:stop], feistel)) is not None:
                    spans.append((start, stop, kind, new))
                    again = stop
                    break
            m = pattern.search(text, again)
    rank = {"mail": 0, "key": 1, "iban": 2, "hex": 3}
    out, end = [], 0
    for span in sorted(spans, key=lambda s: (s[0], rank.get(s[2], 4), -s[1])):
        if span[0] >= end:
            out.append(span)
            end = span[1]
    return out


def pseudonymise(text: str | None, feistel: Feistel) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of each replaced value in the old text."""
    if not text:
        return text, []
    parts, done, replaced = [], 0, []
    for a, b, kind, new in find(text, feistel):
        parts += [text[done:a], new]
        done = b
        replaced.append((a, b, kind))
    return "".join([*parts, text[done:]]), replaced


def protect(docs: DataFrame, key: bytes) -> Column:
    """Column of ``text`` (of ``docs``) giving struct<text, found: array<struct<start, end, kind>>>.

    NULL stays NULL with nothing found, empty stays empty; offsets are code points of the old text.
    """
    limit_batches(docs.sparkSession)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        feistel = Feistel(key)
        for array in arrays:
            texts, found = [], []
            for value in array:
                text, replaced = pseudonymise(value.as_py(), feistel)
                texts.append(text)
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in replaced])
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(found, spans)], ["text", "found"])

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<text:string,found:array<struct<start:int,end:int,kind:string>>>")(F.col("text"))


def pseudonymise_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, found`` of every row (see ``protect``).

    Repeated rows each give a row, an empty table gives none; other columns are ignored.  Texts of any length
    are scanned whole, in time that grows with their length.
    """
    return docs.select("doc_id", protect(docs, key).alias("found")).select("doc_id", "found.*")
