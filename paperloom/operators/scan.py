"""Entity recognition, containment dedup and roles of one text, in Python: what entities.py states as columns, several times faster.

A pattern runs only where the text has what each of its matches must have. Word boundaries, classes and case are those of the
engine: texts beyond ASCII are searched in a copy of equal length whose letters and digits are one letter, and shown as they are.
Addresses, organisations and emails are found from their ends, in time proportional to the text.
"""

from __future__ import annotations

import calendar
import functools
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from paperloom.functions import fixed_values as V

KINDS = tuple(k for k, *_ in V.RECOGNISERS)
CONFIDENCE = tuple(c for _, c, *_ in V.RECOGNISERS)
#: kind (its place in KINDS), text, start, end, normalised
Found = tuple[int, str, int, int, "str | None"]

WHITE = " \t\n\x0b\f\r"
#: Ends of lines that aren't white space to patterns; $ is before a last one too.
_ENDS = "\x85  "
_LETTER, _FAR_LETTER, _MARK, _SIGN = "\u00e9", "\u00f8", "\u0301", "\u00a7"
_MARKED = re.compile(f"(?<=[A-Za-z0-9{_LETTER}]){_MARK}+")
_HIDDEN = {0xE000: 0xE003, 0xE001: 0xE003, 0xE002: 0xE003}  # the marks of functions/spans.py


class _Stand(dict):
    """Code points beyond ASCII as letters, marks or signs; marks and their bases are so only in the basic plane."""

    def __missing__(self, c: int) -> str:
        kind = unicodedata.category(chr(c))
        word = _LETTER if c < 0x10000 else _FAR_LETTER
        out = chr(c) if c < 128 else word if kind[0] == "L" or kind == "Nd" else _MARK if kind == "Mn" and c < 0x10000 else _SIGN
        self[c] = out
        return out


_STAND = _Stand()


def stand_in(text: str) -> str:
    """A text of equal length with the same word boundaries, in which only ASCII is as it was."""
    if text.isascii():
        return text
    out = text.translate(_STAND)
    return _MARKED.sub(lambda m: _LETTER * len(m[0]), out) if _MARK in out else out


def _plain(pattern: str) -> str:
    """The pattern with ASCII's digits and white space, as the engine has them."""
    out, i, within = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            inner = {"\\s": r" \t\n\x0b\f\r", "\\d": "0-9"}.get(two)
            out.append(two if inner is None else inner if within else f"[{inner}]")
            i += 2
            continue
        if c == "[" and not within:
            within = True
        elif c == "]" and within:
            within = False
        out.append(c)
        i += 1
    return "".join(out)


def _trimmed(x: str) -> str:
    return x[:-1].strip(WHITE) + x[-1] if x and x[-1] in _ENDS else x.strip(WHITE)


# --- normal forms ------------------------------------------------------------------------------------------------------

_SLASH = re.compile(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]+)")
_NAMED, _TURNED = re.compile(r"([A-Za-z]+) ([0-9]{1,2}),? ([0-9]{4})"), re.compile(r"([0-9]{1,2}) ([A-Za-z]+) ([0-9]{4})")
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def _real(y: str, m: int, d: int) -> str | None:
    leap = calendar.isleap(int(y))
    return f"{y}-{m:02d}-{d:02d}" if 1 <= m <= 12 and 1 <= d <= (29 if m == 2 and leap else calendar.mdays[m]) else None


@functools.lru_cache(65_536)
def iso_date(raw: str) -> str | None:
    """As entities.iso_date."""
    if raw[4:5] == "-":
        return _real(raw[:4], int(raw[5:7]), int(raw[8:]))
    if m := _SLASH.fullmatch(raw):
        a, b, y = int(m[1]), int(m[2]), m[3]
        if len(y) == 4:
            return _real(y, a, b) or _real(y, b, a)
        return _real(("19" if int(y) >= 69 else "20") + y, a, b) if len(y) == 2 else None
    if "." in raw and raw[0].isdigit():
        d, m, y = raw.split(".")
        return _real(y, int(m), int(d))
    v = re.sub(f"[{WHITE}]+", " ", raw)
    if m := _NAMED.fullmatch(v):
        return _real(m[3], _MONTHS[m[1][:3].lower()], int(m[2]))
    m = _TURNED.fullmatch(v)
    return _real(m[3], _MONTHS[m[2][:3].lower()], int(m[1])) if m else None


_NO_AMOUNT, _NO_DIGIT = re.compile(r"[^0-9.]+"), re.compile(r"[^0-9]+")
_NORMAL: dict[str, Callable[[str], str | None]] = {
    "email": str.lower, "date": iso_date, "amount": lambda x: _NO_AMOUNT.sub("", x) or None, "phone": lambda x: _NO_DIGIT.sub("", x), "reference_number": str.upper, "person": str,
}

# --- patterns ----------------------------------------------------------------------------------------------------------

#: Of a text and its lower case the places of matches.
Spans = Callable[[str, str], Iterable[tuple[int, int]]]
_WS = r" \t\n\x0b\f\r"
#: Patterns in forms that begin with a sign or a class of signs, which are found faster than a boundary; the rest is as it is stated.
_FORMS = {
    V.DATE[1]: r"[0-9](?<=\b[0-9])[0-9]?/[0-9]{1,2}/[0-9]{2,4}\b",
    V.PHONE[3]: rf"1(?<=\b1)[\-.{_WS}][0-9]{{3}}[\-.{_WS}][0-9]{{3}}[\-.{_WS}][0-9]{{4}}\b",
    V.REFERENCE_NUMBER[0]: rf"[Ii][Nn][Vv](?:[Oo][Ii][Cc][Ee])?[{_WS}#\-]*:?[{_WS}]*([A-Za-z0-9\-]{{4,20}})",
    V.REFERENCE_NUMBER[3]: rf"[Nn#](?:(?<=#)|(?<=[Nn])(?:[Oo]\.|[Uu][Mm][Bb][Ee][Rr]))[{_WS}]*([A-Za-z]?[0-9]{{4,12}})",
}
#: The same from the first separator on; digits before it are looked back at, and no match can begin in another.
_FROM_SEPARATOR = {
    V.DATE[0]: (r"-(?<=\b[0-9]{4}-)[0-9]{2}-[0-9]{2}\b", 4, 4),
    V.DATE[2]: (r"\.(?:(?<=\b[0-9]\.)|(?<=\b[0-9]{2}\.))[0-9]{1,2}\.[0-9]{4}\b", 1, 2),
    V.PHONE[1]: (r"[.\-](?<=\b[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}\b", 3, 3),
}
_MONTH_NAMES, _CURRENCIES = tuple(_MONTHS), ("USD", "EUR", "GBP", "CAD", "AUD", "JPY")
#: Of these one is in every text that the pattern matches: as it is, or (second list) in lower case.
_NEEDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    V.EMAIL[0]: (("@",), ()), V.URL[0]: (("http", "www."), ()),
    V.DATE[0]: (("-",), ()), V.DATE[1]: (("/",), ()), V.DATE[2]: ((".",), ()), V.DATE[3]: ((), _MONTH_NAMES), V.DATE[4]: ((), _MONTH_NAMES), V.DATE[5]: ((), _MONTH_NAMES),
    V.AMOUNT[0]: (("$",), ()), V.AMOUNT[1]: (_CURRENCIES, ()), V.AMOUNT[2]: (_CURRENCIES, ()), V.AMOUNT[3]: (("total", "amount", "tax", "price"), ()),
    V.PHONE[0]: (("(",), ()), V.PHONE[1]: (("-", "."), ()), V.PHONE[2]: (("+",), ()), V.PHONE[3]: (("1-", "1.", "1 ", "1\t", "1\n", "1\x0b", "1\f", "1\r"), ()),
    V.ADDRESS[0]: ((), ("st", "ave", "boulevard", "blvd", "dr", "lane", "ln", "road", "rd", "way", "court", "ct", "pl", "suite", "fl")),
    V.REFERENCE_NUMBER[0]: ((), ("inv",)), V.REFERENCE_NUMBER[1]: ((), ("po", "p.o", "purchase order")), V.REFERENCE_NUMBER[2]: ((), ("ref", "case")), V.REFERENCE_NUMBER[3]: (("#",), ("no.", "number")),
    V.PERSON[0]: (("Mr", "Ms", "Dr", "Prof", "Rev", "Sir", "Lady", "Lord"), ()),
    V.ORGANIZATION[0]: (("Inc.", "LLC", "Ltd.", "Corp.", "Co.", "GmbH", "PLC", "LP", "AG"), ()),
}

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN, _BOUND = re.compile(r"@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"), re.compile(r"\b")


def _emails(t: str, low_case: str) -> Iterator[tuple[int, int]]:
    """An address begins at the first boundary among the signs before its @."""
    last = 0
    for m in _DOMAIN.finditer(t):
        at, back = m.start(), 64
        while True:
            low = max(last, at - back)
            begin = low + len(t[low:at].rstrip(_LOCAL))
            if begin > low or low == last:
                break
            back *= 4
        first = _BOUND.search(t, begin, at) if begin < at else None
        if first is not None and first.start() < at:
            last = m.end()
            yield first.start(), last


_NUMBER_END, _NUMBERED = re.compile(f"[0-9][{_WS}]"), re.compile(f"[0-9][{_WS}][a-z0-9{_WS},.]+")
_STREETS = {"s": "treet|t|uite|te", "a": "venue|ve", "b": "oulevard|lvd", "d": "rive|r", "l": "ane|n", "r": "oad|d", "w": "ay", "c": "ourt|t", "p": "lace|l", "f": "loor|l"}
_STREET = re.compile(f"[{''.join(_STREETS)}](?:" + "|".join(f"(?<={c})(?:{x})" for c, x in _STREETS.items()) + r")\b")


def _addresses(t: str, low: str) -> Iterator[tuple[int, int]]:
    """A number, then signs of a class up to their last street word, whose line belongs to the address."""
    at = 0
    while m := _NUMBERED.search(low, at):
        (first, stop), bound = m.span(), at
        at = stop
        last = None
        for last in _STREET.finditer(low, first + 3, stop + 1):  # the sign after the run decides on the last boundary
            pass
        while last is not None and m is not None:
            begin = first = m.start()
            while begin > bound and low[begin - 1] in "0123456789":
                begin -= 1
            if begin == 0 or not (low[begin - 1].isalnum() or low[begin - 1] == "_"):
                line = low.find("\n", last.end())
                line = len(low) if line < 0 else line
                yield begin, line
                at = max(stop, line)
                break
            m = _NUMBER_END.search(low, first + 1, last.start() - 1)  # no number yet: the next one of the run


def _organizations(t: str, low: str) -> Iterator[tuple[int, int]]:
    """A capital, then signs of a class up to their last suffix."""
    at = 0
    while m := _CAPITAL.search(t, at):
        at = m.end()
        last = None
        for last in _SUFFIX.finditer(t, m.start() + 2, at + 1):
            pass
        if last is not None:
            yield m.start(), last.end()
            at = max(at, last.end())


_CAPITAL = re.compile(f"[A-Z](?<=\\b[A-Z])[a-zA-Z&{_WS},.]+")
_SUFFIX = re.compile(r"(?:Inc\.|LLC|Ltd\.|Corp\.|Co\.|GmbH|PLC|LP|AG)\b")  # what ends in LLP ends in LP
_LINEAR: dict[str, Spans] = {V.EMAIL[0]: _emails, V.ADDRESS[0]: _addresses, V.ORGANIZATION[0]: _organizations}


def _spans(pattern: str, group: bool) -> Spans:
    if pattern in _LINEAR:
        return _LINEAR[pattern]
    if pattern in _FROM_SEPARATOR:
        form, least, most = _FROM_SEPARATOR[pattern]
        found = re.compile(form).finditer
        if least == most:
            return lambda t, low: [(m.start() - least, m.end()) for m in found(t)]
        return lambda t, low: [(m.start() - (most if t[m.start() - most : m.start()].isdigit() and m.start() >= most else least), m.end()) for m in found(t)]
    found = re.compile(_FORMS.get(pattern) or _plain(pattern)).finditer
    if group:
        return lambda t, low: [(m.start(1), m.end()) for m in found(t)]
    return lambda t, low: [m.span() for m in found(t)]


def _searches() -> tuple[tuple[int, tuple[str, ...], tuple[str, ...], tuple[Spans, ...]], ...]:
    """kind, needed signs, the same in lower case, and what to search for; neighbours of equal needs are one."""
    out: list = []
    for k, (_, _, patterns, group) in enumerate(V.RECOGNISERS):
        for p in patterns:
            if out and out[-1][:3] == [k, *_NEEDS[p]]:
                out[-1][3].append(_spans(p, group))
            else:
                out.append([k, *_NEEDS[p], [_spans(p, group)]])
    return tuple((k, needs, low, tuple(s)) for k, needs, low, s in out)


_SEARCHES = _searches()
_TRIMMED, _ONCE, _LONG = (frozenset(map(KINDS.index, x)) for x in (("address", "organization"), ("reference_number",), ("organization",)))
_NORMALS = tuple(_NORMAL.get(k, lambda x: None) for k in KINDS)


def recognised(text: str | None, kinds: frozenset[int] | None = None) -> list[Found]:
    """All entities of a text in order of recognition."""
    if not text:
        return []
    t, shown = stand_in(text), text
    if t is not text:
        shown = text.translate(_HIDDEN) if "\ue000" in text or "\ue001" in text or "\ue002" in text else text
    low = t.lower()
    out: list[Found] = []
    once: set[str] = set()
    for k, needs, low_needs, searches in _SEARCHES:
        if kinds is not None and k not in kinds:
            continue
        for n in needs:
            if n in t:
                break
        else:
            for n in low_needs:
                if n in low:
                    break
            else:
                continue
        normal = _NORMALS[k]
        for a, b in (s for search in searches for s in search(t, low)):
            x = shown[a:b]
            if k in _TRIMMED:
                x = _trimmed(x)
                if k in _LONG and len(x) < 5:
                    continue
            elif k in _ONCE:
                if x in once:
                    continue
                once.add(x)
            out.append((k, x, a, b, normal(x)))
    return out


def deduplicated(found: list[Found]) -> list[tuple[int, Found]]:
    """The entities that lie in no longer (or equal, earlier) one, by start, with their order of recognition."""
    far, out = -1, []
    for _, n, i in sorted([(e[2], -e[3], i) for i, e in enumerate(found)]):
        if -n > far:
            far = -n
            out.append((i, found[i]))
    return out


# --- roles -------------------------------------------------------------------------------------------------------------

_RULES = tuple(tuple((phrases, role) for phrases, kind, role in V.ROLE_RULES if kind == k) for k in KINDS)
_LABEL = re.compile(rf"([a-z][a-z{_WS}]{{1,30}}):[{_WS}]*[{_ENDS}]?")
_NEAR = 256


def role(text: str, k: int, start: int) -> str | None:
    """As entities.role_of, for an entity's kind and place."""
    context = text[max(0, start - V.ROLE_CONTEXT) : start].lower()
    for phrases, name in _RULES[k]:
        for p in phrases:
            if p in context:
                return name
    near = text[max(0, start - _NEAR) : start].rstrip(WHITE + _ENDS)
    if near and near[-1] != ":":
        return None
    line = _trimmed(text[text.rfind("\n", 0, start) + 1 : start].lower())
    m = _LABEL.fullmatch(line)
    return "field:" + m[1].rstrip(WHITE) if m else None


# --- Arrow -------------------------------------------------------------------------------------------------------------

ENTITY = "struct<ord:int,text:string,entity_type:string,start:int,end:int,confidence:double,normalized:string,role:string>"
_FIELDS = ("ord", "text", "entity_type", "start", "end", "confidence", "normalized", "role")
_NAMES, _SURE = pa.array(KINDS, pa.string()), pa.array(CONFIDENCE, pa.float64())

#: ord, kind, text, start, end, normalised, role
Linked = tuple[int, int, str, int, int, "str | None", "str | None"]


def entities(text: str | None, dedup: bool = True, link: bool = True, kinds: frozenset[int] | None = None) -> list[Linked]:
    """What entity_rows gives for a text, in order."""
    found = recognised(text, kinds)
    numbered = deduplicated(found) if dedup else enumerate(found)
    return [(i, k, x, a, b, n, role(text, k, a) if link else None) for i, (k, x, a, b, n) in numbered]


def as_arrow(lists: list[list[Linked]]) -> pa.Array:
    """array<ENTITY> of each text."""
    rows = [e for es in lists for e in es]
    i, k, x, a, b, n, r = zip(*rows) if rows else ((),) * 7
    kind, place = pa.array(k, pa.int32()), lambda v: pa.array(v, pa.int32())
    text = lambda v: pa.array(v, pa.string())
    values = (place(i), text(x), _NAMES.take(kind), place(a), place(b), _SURE.take(kind), text(n), text(r))
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, lists)], dtype=np.int32), pa.StructArray.from_arrays(values, names=list(_FIELDS)))
