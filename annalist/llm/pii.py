"""Personal data with offset-preserving deobfuscation.

Base detectors run on the text itself. Then a chain of transducers rewrites the text and keeps, for every character
it writes, where that came from: homoglyphs and full-width forms become ASCII, spelled digits become digits, and
at/dot disguises become @ and dots. Bare words count where they form a whole address or number: `at` between a word
that is common in prose and a domain does not, unless its last label is one of _TOP after a spelled dot. The same
detectors run on the rewritten text, and what they find is mapped back to source characters. A found span is added
unless it is inside a base span of any kind; base spans always stay.

Detectors are linear in the text: each anchors on a character its matches must have (@, +, a digit not after a digit)
and never looks back further than the previous match. So are the transducers, whose looks around are of bounded
length or end where the next one begins; found spans are compared with base spans by binary search.

Defined results: null texts are empty, without spans; spans are code points, end exclusive; spans that start together
go in the order of KINDS, then by end; documents are read one by one, without a shuffle, so repeated rows give repeated
results and a very long text is read whole, with a tape of two integers a character only if a transducer changes it; an
empty table gives no rows; extra columns pass through, and the columns added win over columns of the same names
(redact_documents keeps all columns, whatever their names).
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.arrays import slices
from annalist.llm.shared import names_aside

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, number of the kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII letters, and the letters they look like.
_HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
    "\u0131": "i", "\u0261": "g", "\u2113": "l", "\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-",
}
# Spelled digits.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
# Characters that show nothing.
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in _HOMOGLYPHS.items()}
    table |= {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}  # full-width forms
    table |= dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000], " ")  # blanks of other widths
    for zero in (0x0660, 0x06F0, 0x0966):  # other decimal digits
        table |= {zero + d: str(d) for d in range(10)}
    return table


_FOLD = _fold_table()
_STRANGE = re.compile("[" + "".join(re.escape(chr(c)) for c in _FOLD) + _INVISIBLE + "]")
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")
_WORD = "|".join(_DIGITS)
_JOINT = r"(?:[ ,.-]{1,2}|\s(?:dot|point)\s)"
_SPELLED = re.compile(rf"\b(?:{_WORD}|[0-9])(?:{_JOINT}(?:{_WORD}|[0-9])){{3,}}\b", re.I)
_SPELLED_HINT = re.compile(rf"\b(?:{_WORD}){_JOINT}(?:{_WORD}|[0-9])|\b[0-9]{_JOINT}(?:{_WORD})\b|[0-9]\s(?:dot|point)\s(?:{_WORD}|[0-9])", re.I)
_SPELLED_PIECE = re.compile(rf"({_WORD}|[0-9]+)(\s(?:dot|point)\s|[ ,.-]*)", re.I)
# four numbers with dots between, each in figures or spelled digit by digit
_NUMBER = rf"(?:[0-9]{{1,3}}|(?:{_WORD}|[0-9])(?:[ ,-]{{1,2}}(?:{_WORD}|[0-9])){{0,2}})"
_SPELLED_IP = re.compile(rf"(?<![0-9.])\b{_NUMBER}(?:(?:\s(?:dot|point)\s|\.){_NUMBER}){{3}}\b", re.I)
_PLUS = re.compile(r"\bplus[ -](?=[0-9])", re.I)
_AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?", re.I)
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|punkt|point|\.)\s?[\])}>]\s?", re.I)
# Last labels of domains that need no further sign of an address.
_TOP = frozenset("com org net edu gov info io co eu de fr es it nl uk us ca au ch at be br mx jp cn in ru pl se no dk fi pt".split())
_NEW_TOP = _TOP | frozenset("ai app arpa biz blog cloud cz dev ie int jobs kr me mil mobi name nz online page pro shop site store tech tv xyz za".split())
# Words that are no name before `at` and no label of a domain around a spelled dot.
_PROSE = frozenset(
    "a about above after again all also am an and any anyone are around arrive arrived arrives as ask available back based be because been before being below best both but by call called came can "
    "click come comes contact could day did do does dot down download each either email employed end ended every everyone few find first for found founded from get given go goes had happened has have he held her here "
    "him his home hosted how i if in into is it its join just keep kept know last launched least left like listed live lived lives look looked looking looks made mail many me meet meeting meets met more most much my named no not "
    "now of off on once one online only open or our out over page people place placed point pointed points posted published read register said same saw see seen sell she shop site so sold some start started starts stay stayed "
    "still stop stopped store such than that the their them then there these they thing this those time to today together tomorrow too two under until up us used very via visit visited was way we website went were what when where "
    "which while who will with work worked working works would write yesterday yet you your".split()
)
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9])\sat\s(?=[A-Za-z0-9])", re.I)
_LAST_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:(?:\sdot\s|\.)[A-Za-z0-9-]+)*", re.I)
_JOIN = re.compile(r"\sdot\s|\.", re.I)
_PLAIN_DOT = re.compile(r"(?<=[A-Za-z0-9])\sdot\s(?=[A-Za-z0-9])", re.I)
_LOCAL_DOT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]{1,64})(\sdot\s)\Z", re.I)
_LOCAL_DOTS = 5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield m.span()


_DETECTORS: tuple[Callable[[str], Iterator[tuple[int, int]]], ...] = (_emails, _ips, _cards, _phones)


def _place(span: Span) -> tuple[int, int, int]:
    """Spans go by start, then kind, then end."""
    return span[0], span[2], span[1]


def detect(text: str) -> list[Span]:
    """Leftmost, non-overlapping spans of each kind, by start and then kind."""
    return sorted(((s, e, k) for k, find in enumerate(_DETECTORS) for s, e in find(text)), key=_place)


class Tape:
    """A text and, for each of its characters, the span of source characters it was written from."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | None = None  # none: the characters are the source's
        self.ends: list[int] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces non-overlapping spans, given in order; what is written stems from the whole span."""
        if not edits:
            return
        n = len(self.text)
        starts, ends = (self.starts, self.ends) if self.starts is not None else (list(range(n)), list(range(1, n + 1)))
        text, new_starts, new_ends, done = [], [], [], 0
        for s, e, new in edits:
            text += (self.text[done:s], new)
            new_starts += starts[done:s] + [starts[s]] * len(new)
            new_ends += ends[done:s] + [ends[e - 1]] * len(new)
            done = e
        text.append(self.text[done:])
        self.text, self.starts, self.ends = "".join(text), new_starts + starts[done:], new_ends + ends[done:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _spelled(match: re.Match) -> list[tuple[int, int, str]]:
    """Digits for spelled ones; blanks and commas between them go, dots, spelled or not, and hyphens stay."""
    return [
        (match.start() + p.start(), match.start() + p.end(), _DIGITS.get(p[1].lower(), p[1]) + ("." if p[2][1:2].isalpha() else "".join(c for c in p[2] if c in ".-")))
        for p in _SPELLED_PIECE.finditer(match[0])
    ]


def _spelled_address(text: str, at: re.Match) -> bool:
    """Whether the words around a bare `at` form a whole address. A domain of real dots alone needs a known last label
    or a local part that is no plain word, as sentences may lack the blank between them."""
    local, domain = _LAST_LOCAL.search(text, max(0, at.start() - 64), at.start()), _LABELS.match(text, at.end())
    if not local or not domain:
        return False
    found = domain[0].lower()
    labels = _JOIN.split(found)
    if any(top in _TOP for top, dot in zip(labels[1:], _JOIN.findall(found), strict=True) if dot != "."):
        return True
    before, last = local[0].lower(), labels[-1]
    if len(labels) < 2 or not (last.isalpha() and 2 <= len(last) <= 24) or before in _PROSE or labels[0] == "www":
        return False
    spelled = "." not in found or _PLAIN_DOT.search(found)
    if spelled:
        return not any(label in _PROSE for label in labels) or (last in _NEW_TOP and labels[-2] not in _PROSE)
    return text[domain.end() : domain.end() + 1] != "/" and (last in _NEW_TOP or not before.isalpha())


def _address_dots(text: str) -> Iterator[tuple[int, int]]:
    """The bare dots of the addresses around at signs: up to _LOCAL_DOTS in a local part and all in a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start, dots = at, []
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        while start < at and len(dots) < _LOCAL_DOTS:
            m = _LOCAL_DOT.search(text, max(done, start - 70), start)
            if not m or m[1].lower() in _PROSE:
                break
            dots.append(m.span(2))
            start = m.start()
        yield from reversed(dots)
        domain = _LABELS.match(text, at + 1)
        done = at + 1
        if domain and start < at:
            pieces = list(_JOIN.finditer(text, domain.start(), domain.end()))
            plain = sum(1 for _ in itertools.takewhile(lambda p: p[0] == ".", pieces))
            ends = [p.start() for p in pieces[1:]] + [domain.end()]
            labels = [text[p.end() : e].lower() for p, e in zip(pieces, ends, strict=True)]
            known = max((i for i, label in enumerate(labels) if label in _NEW_TOP), default=-1)
            for i, p in enumerate(pieces):
                # an address that is whole goes on only to a known last label, others to the first word of prose
                if i > known and (labels[i] in _PROSE or known >= 0 or 0 < plain <= i):
                    break
                if p[0] != ".":
                    yield p.span()
            done = domain.end()
        at = text.find("@", done)


def deobfuscate(text: str) -> Tape | None:
    """The rewritten text, or None if no transducer changes it."""
    tape = Tape(text)
    if not text.isascii() and _STRANGE.search(text):
        tape.text = text.translate(_FOLD)  # one character for one, so places stay
        tape.rewrite([(*m.span(), "") for m in _HIDDEN.finditer(tape.text)])
    if _SPELLED_HINT.search(tape.text):
        for spelled in (_SPELLED_IP, _SPELLED):
            tape.rewrite([edit for m in spelled.finditer(tape.text) for edit in _spelled(m)])
        tape.rewrite([(*m.span(), "+") for m in _PLUS.finditer(tape.text)])
    tape.rewrite([(*m.span(), "@") for m in _AT.finditer(tape.text)])
    tape.rewrite([(*m.span(), "@") for m in _BARE_AT.finditer(tape.text) if _spelled_address(tape.text, m)])
    tape.rewrite([(*m.span(), ".") for m in _DOT.finditer(tape.text)])
    if "@" in tape.text and _PLAIN_DOT.search(tape.text):
        tape.rewrite([(*span, ".") for span in _address_dots(tape.text)])
    return None if tape.text is text or tape.text == text else tape


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those that only deobfuscation shows."""
    base = detect(text)
    tape = deobfuscate(text)
    if tape is None:
        return base, base
    every = list(base)
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, e, _ in base), max))  # the furthest end of the base spans so far
    for s, e, k in detect(tape.text):
        s, e = tape.source(s, e)
        before = bisect_right(starts, s)
        if not before or reach[before - 1] < e:
            every.append((s, e, k))
    return base, sorted(every, key=_place)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out += (text[done:s], f"[{KINDS[k].upper()}]")
        done = max(done, e)
    return "".join([*out, text[done:]])


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_ADDED = {"base_spans": pa.list_(_SPAN), "all_spans": pa.list_(_SPAN), "redacted": pa.string()}
_SQL = {k: "array<struct<start:bigint,end:bigint,kind:string>>" for k in ("base_spans", "all_spans")} | {"redacted": "string"}


def find_personal_data(documents: DataFrame, text: str = "text", outputs: tuple[str, ...] = ("base_spans", "all_spans", "redacted")) -> DataFrame:
    """The documents with base_spans, all_spans (start, end, kind) and the redacted text, or those of them asked for."""
    source = documents.select(*(F.col(f"`{c}`") for c in documents.columns if c not in outputs))

    def structs(spans: list[Span]) -> list[dict]:
        return [{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            found = [find_spans(t or "") for t in texts]
            made = {
                "base_spans": lambda found=found: [structs(b) for b, _ in found],
                "all_spans": lambda found=found: [structs(a) for _, a in found],
                "redacted": lambda found=found, texts=texts: [t and redact(t, a) for t, (_, a) in zip(texts, found, strict=True)],
            }
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(made[k](), _ADDED[k]) for k in outputs)], names=[*part.schema.names, *outputs])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"{k} {_SQL[k]}" for k in outputs)]))


def redact_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data in `text` replaced; all rows and columns stay."""
    aside = names_aside(documents.columns, ("redacted",))
    found = find_personal_data(documents.withColumnsRenamed(aside), aside.get(text, text), ("redacted",))
    return found.select(*(F.col("redacted" if c == text else f"`{aside.get(c, c)}`").alias(c) for c in documents.columns))
