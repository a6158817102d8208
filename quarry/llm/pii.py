"""Personal data: plain patterns, and offset-preserving deobfuscation for what is disguised.

Four transducers rewrite a text: look-alike characters become ASCII, letters set apart around an @ are drawn together,
spelled digits become digits, and written-out or bracketed "at" and "dot" become @ and full stops. Each keeps the pieces
that it wrote anew with the source characters that they stand for. The patterns run on the rewritten text, and what
they find there is mapped back through the pieces.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextSlice, per_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit before a match is never one that a match could have begun at, so runs are tried from their first digit only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _emails(t: str) -> list[Span]:
    """Leftmost matches, found from their @: the local part is all that leads up to it, back to the last match."""
    found, free, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > free and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            free = m.end()
        at = t.find("@", m.end() if m else at + 1)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def plain_spans(t: str) -> list[Span]:
    """What the patterns find in a text as it stands, by start, then kind."""
    found = _emails(t) if "@" in t else []
    if _DIGIT.search(t):
        if "." in t:
            # Parts of over three digits may hold leading zeros.
            found += [("ip", m.start(), m.end()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in t:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=_place)


def _place(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


# Letters of other scripts that look like ASCII ones.
_ALIKE = dict(zip("авсеоркхуіјѕԁһӏАВСЕОРКХУІЈЅТМНαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abceopkxyijsdhlABCEOPKXYIJSTMHaopvikABEZHIKMNOPTYX", strict=True))
# Characters without width, and look-alikes of @ and full stops.
_UNSEEN = "​‌‍⁠﻿­"
_SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "｡": ".", "․": ".", "＋": "+", "﹢": "+", "－": "-", "‐": "-", "‑": "-", "–": "-"}


def _one(ch: str) -> str | None:
    """The ASCII that a character stands for: '' for none, None if it stays."""
    if ch in _UNSEEN:
        return ""
    if ch in _ALIKE or ch in _SIGNS:
        return _ALIKE.get(ch) or _SIGNS[ch]
    if (d := unicodedata.decimal(ch, None)) is not None:
        return str(d)
    plain = unicodedata.normalize("NFKC", ch)
    return plain if len(plain) == 1 and plain.isascii() and plain.isalnum() else None


_known: dict[str, str | None] = {}


def _ascii_of(ch: str) -> str | None:
    if ch not in _known:
        _known[ch] = _one(ch)
    return _known[ch]


# Names of digits in English, French, German and Spanish.
_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAMES |= {"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
_NAMES |= {"null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
_NAMES |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
# Names of the signs. Of those of @ only the first is a common word too.
_PLUS, _DOTS, _ATS = ("plus",), ("dot", "punkt", "point", "punto"), ("at", "arroba", "arobase")
# What written addresses end in.
_TOP = frozenset(
    "com org net edu gov mil int info biz name pro io app dev ai tv uk us ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg hr si se no dk fi is ee lv lt ru ua tr il in cn jp kr hk tw sg br mx ar cl co pe za eu".split()
)
# Common words that stand before "at" in prose.
_BEFORE_AT = frozenset(
    "a all am an and any are arrive arrived as available back be been begin begins best both but came close come comes day down each early eat even ever far find fine first found get good great had has have he held her here him his hosted how i "
    "in is it its just keep last later least left line listed live lives located look looked looking looks made me meet meeting meets met more most much new next nice noon not now of off on once one online only open or our out over page please point "
    "posted published read right sat see she shop shown shows sit site sits so soon staff start started starts stay still stop store that the them then there these they this those time today tomorrow tonight up us visit visited was we website welcome "
    "well went were what when where which who will with work worked working works yesterday yet you your".split()
)
_NAME = "|".join(sorted(_NAMES, key=len, reverse=True))
_UNIT = re.compile(rf"(?i)\b(?:{_NAME}|{'|'.join(_PLUS)})\b|[0-9]+")
_GAP = re.compile(r"[\s,-]+")
#: A name beside another name, a sign's name or a digit: without one no number is spelled.
_SPELLED = re.compile(rf"(?i)\b(?:{_NAME})[\s,-]+(?:(?:{_NAME}|{'|'.join((*_PLUS, *_DOTS))})\b|[0-9])|[0-9][\s,-]+(?:{_NAME})\b|\b(?:{'|'.join(_PLUS)})\s+(?:(?:{_NAME})\b|[0-9])")
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_DOT_SIGN = rf"(?:\s*{_OPEN}(?:{'|'.join(_DOTS)}|\.){_CLOSE}\s*|\s+(?:{'|'.join(_DOTS)})\s+)"
_HOST = rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT_SIGN})[A-Za-z0-9-]+)+"
_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])(?:\s*{_OPEN}(?:{'|'.join(_ATS)}|@){_CLOSE}\s*(?=[A-Za-z0-9-])|\s+(?:{'|'.join(_ATS)})\s+(?={_HOST}))")
_HOST_HERE = re.compile(rf"(?i){_HOST}")
_LAST_LABEL = re.compile(r"[A-Za-z0-9-]+\Z")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_DOT_SIGN}(?=[A-Za-z0-9])")
_SPACED_DOT = re.compile(r"(?<=[0-9])[ \t]+\.[ \t]+(?=[0-9])")
_SIGN_NAME = re.compile(rf"(?i)\s(?:{'|'.join((*_DOTS, *_ATS))})\s|{_OPEN}(?:{'|'.join((*_DOTS, *_ATS))}|@|\.){_CLOSE}|[0-9][ \t]+\.[ \t]+[0-9]")
#: The characters looked at before "at" for the word there.
_WORD_BEFORE = 80


class Rewritten:
    """A text with the source that it stands for: of each rewriting the pieces that it wrote anew, and what they replaced."""

    def __init__(self, source: str):
        self.text = source
        self._levels: list[tuple[array, array, array, array]] = []

    def replace(self, edits: Iterable[tuple[int, int, str]]) -> Rewritten:
        """Puts each text in the place of [from, to); edits come in order and don't overlap."""
        pieces, done, at = [], 0, 0
        level = array("q"), array("q"), array("q"), array("q")
        for a, b, new in edits:
            pieces += (self.text[done:a], new)
            at += a - done
            for column, value in zip(level, (at, at + len(new), a, b), strict=True):
                column.append(value)
            at, done = at + len(new), b
        if level[0]:
            self.text = "".join([*pieces, self.text[done:]])
            self._levels.append(level)
        return self

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of [start, end) of the text, which holds a character at least."""
        first, last = start, end - 1
        for begins, ends, froms, tos in reversed(self._levels):
            first, last = self._below(first, begins, ends, froms, tos)[0], self._below(last, begins, ends, froms, tos)[1]
        return first, last + 1

    @staticmethod
    def _below(at: int, begins: array, ends: array, froms: array, tos: array) -> tuple[int, int]:
        """The first and last character that a character stands for one level below."""
        j = bisect_right(begins, at) - 1
        if j < 0:
            return at, at
        if at < ends[j]:
            return froms[j], tos[j] - 1
        return tos[j] + at - ends[j], tos[j] + at - ends[j]


def _foreign(t: str) -> set[str]:
    """The characters outside ASCII that stand for ASCII ones or for none."""
    return set() if t.isascii() else {ch for ch in set(t) if ch > "\x7f" and _ascii_of(ch) is not None}


def characters(r: Rewritten) -> Rewritten:
    """Look-alikes become the one ASCII character that they stand for; characters without width go."""
    some = _foreign(r.text)
    if not some:
        return r
    unseen = "".join(ch for ch in some if not _known[ch])
    r.text = r.text.translate({ord(ch): _known[ch] for ch in some if _known[ch]})
    return r.replace((m.start(), m.end(), "") for m in re.finditer(f"[{re.escape(unseen)}]", r.text)) if unseen else r


def spaced_letters(r: Rewritten) -> Rewritten:
    """Of an @ with single characters set apart by single spaces on both sides, the spaces go."""
    t, edits, free, at = r.text, [], 0, r.text.find(" @ ")
    while at >= 0:
        start, end = at, at + 3
        while start - 1 > free and t[start - 1] in _LOCAL and (start - 2 < free or t[start - 2] == " "):
            start -= 2
        while end < len(t) and t[end] in _LOCAL and not t[end + 1 : end + 2].isalnum():
            end += 1
            if t[end : end + 1] != " ":
                break
            end += 1
        start, end = max(start + 1, free), end - (t[end - 1] == " ")
        # Some letters on both sides, or it is an @ between words.
        if at - start >= 3 and end - at >= 8:
            edits += [(i, i + 1, "") for i in range(start, end) if t[i] == " "]
            free = end
        at = t.find(" @ ", max(at + 1, free))
    return r.replace(edits)


def spelled_digits(r: Rewritten) -> Rewritten:
    """Names of digits become digits however few they are, also among digits; the patterns tell numbers from prose."""
    edits, units = [], list(_UNIT.finditer(r.text))
    for w, after in zip(units, [*units[1:], None], strict=False):
        digits, end = r.text[w.start()].isdigit(), w.end()
        joined = after is not None and _GAP.fullmatch(r.text, end, after.start()) is not None
        name = "" if digits else _NAMES.get(unicodedata.normalize("NFKC", w[0]).lower(), "+")
        nearby = joined and r.text[after.start()].isdigit()
        if name == "+":
            if joined and "," not in r.text[end : after.start()]:
                edits.append((w.start(), after.start(), "+"))
            continue
        following = joined and not nearby and after[0].lower() not in _PLUS
        if not digits:
            # What parts two names goes with the first of them.
            edits.append((w.start(), after.start() if following else end, name))
        if joined and (following if digits else nearby) and after.start() - end > 1:
            edits.append((end, after.start(), " "))
    return r.replace(edits)


def _addresses(t: str) -> Iterable[tuple[int, int, str]]:
    """Where "at" is an @: in brackets, or after a word that is a name and before a host with a known ending."""
    for m in _AT.finditer(t):
        if not (t[m.start()].isspace() and m[0].strip().isalpha()):
            yield m.start(), m.end(), "@"
            continue
        name = _LOCAL_END.search(t[max(0, m.start() - _WORD_BEFORE) : m.start()])
        host = _HOST_HERE.match(t, m.end())
        if name and host and name[0].lower() not in _BEFORE_AT and _LAST_LABEL.search(host[0])[0].lower() in _TOP:
            yield m.start(), m.end(), "@"


def written_signs(r: Rewritten) -> Rewritten:
    r.replace(_addresses(r.text))
    r.replace((m.start(), m.end(), ".") for m in _DOT.finditer(r.text))
    return r.replace((m.start(), m.end(), ".") for m in _SPACED_DOT.finditer(r.text))


def disguised_spans(t: str, plain: list[Span]) -> list[Span]:
    """What only the rewritten text shows, as spans of the source; one that widens a plain span counts, but not by the
    name of one digit."""
    # Digits and signs may be spelled in look-alike letters too, so foreign characters always lead on.
    foreign = bool(_foreign(t))
    spelled, apart = foreign or _SPELLED.search(t) is not None, " @ " in t
    if not foreign and not spelled and not apart and not _SIGN_NAME.search(t):
        return []
    known = {k: [(a, b) for kind, a, b in plain if kind == k] for k in KINDS}
    found, read = set(), {t}
    # Names beside a number may be prose, so the text is read with them and with their digits.
    for steps in ((characters, spaced_letters, written_signs), (characters, spaced_letters, spelled_digits, written_signs))[: 2 if spelled else 1]:
        r = Rewritten(t)
        for step in steps:
            step(r)
        if r.text in read:
            continue
        read.add(r.text)
        for kind, a, b in plain_spans(r.text):
            a, b = r.source(a, b)
            if not any(x <= a and b <= y for x, y in known[kind]) and not any(a <= x and y <= b and _by_one_name(t[a:x] + " | " + t[y:b]) for x, y in known[kind]):
                found.add((kind, a, b))
    return sorted(found, key=_place)


def _by_one_name(more: str) -> bool:
    """Whether what a span has more than a plain one is the name of a single digit, as a word of prose may be."""
    units = _UNIT.findall(more)
    return len(units) == 1 and not units[0].isdigit()


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _redacted(t: str, spans: list[Span]) -> str:
    """Each span, or union of overlapping spans, becomes the tag of its first kind."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += (t[done:a], f"[{kind.upper()}]")
        done = max(done, b)
    return "".join([*out, t[done:]])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", redacted: bool = True) -> DataFrame:
    """One row a row of docs: key, n_email, n_ip, n_card, n_phone, base_sha256, spans and, with redacted, that text.

    The counts and base_sha256 are of the plain patterns: emails; dotted quads with parts up to 255; card numbers of
    14 to 19 digits with single spaces or hyphens that pass the Luhn test; phone numbers from + with 10 to 15 digits.
    Of each kind the leftmost matches that don't overlap count, and one that fails its test is dropped, not retried.
    spans holds these and the disguised ones as kind:start:end in code points, by start, then kind. A text that is
    null or empty has none; a null text stays null in redacted. Repeated rows and null keys pass through. Other
    columns of docs are not read. Whole texts of any length are searched; time is in proportion to the length.
    """

    def work(part: TextSlice) -> list[pa.Array]:
        counts, digests, joined, clean = {k: [] for k in KINDS}, [], [], []
        for t, is_null in zip(part.strings, part.nulls.to_pylist(), strict=True):
            base = plain_spans(t)
            every = sorted(set(base + disguised_spans(t, base)), key=_place)
            for k in KINDS:
                counts[k].append(sum(kind == k for kind, _, _ in base))
            digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
            joined.append(_join(every))
            if redacted:
                clean.append(None if is_null else _redacted(t, every))
        out = [pa.array(counts[k], pa.int64()) for k in KINDS] + [pa.array(digests, pa.string()), pa.array(joined, pa.string())]
        return out + ([pa.array(clean, pa.string())] if redacted else [])

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return per_text(docs, [key], text, schema + ", redacted string" * redacted, work)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of docs, with a tag in the place of each personal datum in text; a null text stays null."""

    def work(part: TextSlice) -> list[pa.Array]:
        clean = []
        for t, is_null in zip(part.strings, part.nulls.to_pylist(), strict=True):
            base = plain_spans(t)
            clean.append(None if is_null else _redacted(t, sorted(set(base + disguised_spans(t, base)), key=_place)))
        return [pa.array(clean, pa.string())]

    name = "redacted"
    while name in docs.columns:
        name = "_" + name
    others = [c for c in docs.columns if c != text]
    done = per_text(docs, others, text, f"{name} string", work)
    return done.select(*[F.col(f"`{name}`").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
