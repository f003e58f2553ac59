"""Personal data in texts, plain and disguised, with spans in the original text.

Plain identifiers are found in the text itself. For disguised ones, transducers rewrite the text: look-alike
characters, spelled digits, and words or brackets for ``@`` and ``.``. Each rewrite keeps the source span of what
it writes, detectors run over the rewritten text, and what they find around a rewritten place is mapped back to
source characters. Plain finds always stay.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import map_columns, texts_of

KINDS = ("email", "ip", "card", "phone")

# The identifiers' patterns. Possessive repeats match the same and cannot run back.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Each ``@`` with the longest name before it that no earlier match holds, and the domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] in LOCAL:
            low -= 1
        match = DOMAIN.match(text, at + 1) if low < at else None
        if match:
            end = match.end()
            out.append((low, end))
        at = text.find("@", max(at + 1, end))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def plain(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping finds of every kind; those that fail their test are dropped."""
    found: dict[str, list[Span]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found["phone"].append(m.span())
    return found


# Letters of other scripts that look like Latin ones, and characters without width.
LOOK_ALIKE = dict(zip("аеорсухіјѕһԁԛԝкмтвнАЕОРСУХІЈЅВНКМТαονρικΑΒΕΗΙΚΜΝΟΡΤΧΖ", "aeopcyxijshdqwkmtbhAEOPCYXIJSBHKMTaovpikABEHIKMNOPTXZ"))
NO_WIDTH = "­​‌‍⁠﻿"
DASHES = "‐‑‒–—−"
WIDE_SPACES = "             　"
DOTS = "․。｡"


def _characters() -> dict[str, str]:
    """Character to its plain form. Compatibility forms and digits of other scripts follow from Unicode."""
    table = dict(LOOK_ALIKE)
    table.update(dict.fromkeys(NO_WIDTH, ""))
    table.update(dict.fromkeys(DASHES, "-"))
    table.update(dict.fromkeys(WIDE_SPACES, " "))
    table.update(dict.fromkeys(DOTS, "."))
    for code in (*range(0x660, 0xFFF), *range(0x2070, 0x2500), *range(0xFE50, 0xFF5F), *range(0x1D400, 0x1D800)):
        char = chr(code)
        form = unicodedata.normalize("NFKC", char)
        if len(form) == 1 and form.isascii() and form.isprintable():
            table.setdefault(char, form)
        elif char.isdecimal():
            table.setdefault(char, str(unicodedata.decimal(char)))
    return table


CHARACTERS = _characters()
STRANGE = re.compile("[" + "".join(map(re.escape, CHARACTERS)) + "]")  # slow; asked only where it matches

#: Spelled digits in English, German, French and Spanish, the longer before the shorter.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_DOT = r"(?:dot|punkt|punto|point)"
_AT = r"(?:at|arroba)"


def _chain(written: str) -> re.Pattern:
    """Spelled digits and numbers of the pattern ``written``, each a whole word, with what may stand between them."""
    member = rf"(?:(?:{_WORDS})(?![^\W_])|{written}(?![^\W_]))"
    return re.compile(
        rf"(?<![^\W_])(?:plus[ \t]+(?={member}))?{member}(?:(?:[ \t]*[-,][ \t]*|[ \t]+|[ \t]+{_DOT}[ \t]+){member})++",
        re.IGNORECASE,
    )


#: Spelled digits mixed with numbers of any length, and with single digits only.
CHAIN, SINGLE_CHAIN = _chain("[0-9]++"), _chain("[0-9]")
CHAIN_PART = re.compile(rf"plus|{_WORDS}|[0-9]+|{_DOT}|[^\w]+", re.IGNORECASE)
SPELLED_WORD = re.compile(rf"\b(?:{'|'.join(SPELLED)})\b")
_NAME = r"[A-Za-z0-9_%+-]"
_BRACKET_AT = rf"\s*[(\[{{<]\s*(?:{_AT}|@)\s*[)\]}}>]\s*"
_BRACKET_DOT = rf"\s*[(\[{{<]\s*(?:{_DOT}|\.)\s*[)\]}}>]\s*"
#: What a disguise cannot do without, looked for first because it is quick to find.
DOT_WORDS = ("dot", "punkt", "punto", "point")
BRACKETS = re.compile(r"[(\[{<]\s*(?:at|arroba|@|\.)", re.IGNORECASE)
#: Last labels of a real domain after a bare ``at``: generic ones and those of countries but for those that files end in.
TOP = (
    "com org net edu gov mil int info biz name pro app dev online site tech cloud email "
    "ac ad ae af ag ai al am an ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cd "
    "cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge "
    "gf gg gh gi gl gm gn gp gq gr gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki "
    "km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my "
    "mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr pt pw qa re ro ru rw sa sb sc sd se "
    "sg si sk sl sm sn sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc "
    "ve vg vi vn vu wf ws ye yt za zm zw"
).split()
_REAL = (
    rf"(?!www\.)(?:[A-Za-z0-9-]+\.)+(?:{'|'.join(sorted(TOP, key=len, reverse=True))})(?![A-Za-z0-9_/:@-]|\.[A-Za-z0-9])"
)
_SPELLED_DOMAIN = rf"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:[ \t]+{_DOT}[ \t]+|{_BRACKET_DOT})[A-Za-z0-9-]+"
REAL_DOMAIN = re.compile(rf"[ \t]{_AT}[ \t]+[a-z0-9-]+\.[a-z0-9]")
#: Words after which a bare ``at`` and a real domain are prose, as in "find us at example.com".
BEFORE_AT = frozenset(
    "a all also and are available be been book both buy click company data day details donate download else "
    "email event events everyone everything explore find follow for found free further go guide have he help her here "
    "him hosted i information is it items join just learn listed listen live located look me more myself news not now "
    "official on one online only open or order out over page people posted products published read register registered "
    "sale see seen she shop shopping sign site sold start starts store stories team that the them there these they "
    "this those tickets time today up us visit was watch we website week were work worked working works write writer "
    "you yourself".split()
)
DISGUISE = re.compile(
    rf"(?<={_NAME})(?:(?P<at>{_BRACKET_AT}|[ \t]+{_AT}[ \t]+(?!(?:the|an?|this|that|my|our|your)\b)(?:(?={_SPELLED_DOMAIN})|(?P<real>(?={_REAL}))))"
    rf"|(?P<dot>{_BRACKET_DOT}|[ \t]+{_DOT}[ \t]+))(?={_NAME})",
    re.IGNORECASE,
)


class Rewritten:
    """A text with rewritten pieces, each of which knows the source span that it stands for."""

    def __init__(self, text: str):
        self.text = text
        # Stretches of text: where each starts here, its source span, and whether it was rewritten.
        self.starts, self.spans, self.changed = [0], [(0, len(text))], [False]

    def source(self, start: int, end: int) -> Span:
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        low = self.spans[first][0] + (0 if self.changed[first] else start - self.starts[first])
        high = self.spans[last][1] if self.changed[last] else self.spans[last][0] + end - self.starts[last]
        return low, high

    def touches(self, start: int, end: int) -> bool:
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        # A gap between two source spans is a character that was deleted.
        gaps = (self.spans[i][1] != self.spans[i + 1][0] for i in range(first, last))
        return any(self.changed[first : last + 1]) or any(gaps)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace spans of this text, in order; an unchanged stretch stays linked character by character."""
        out = Rewritten("")
        out.starts, out.spans, out.changed = [], [], []
        parts, at, size = [], 0, 0

        def add(piece: str, span: Span, changed: bool) -> None:
            nonlocal size
            if piece:
                out.starts.append(size)
                out.spans.append(span)
                out.changed.append(changed)
                parts.append(piece)
                size += len(piece)

        def copy(low: int, high: int) -> None:
            while low < high:
                i = bisect_right(self.starts, low) - 1
                stop = min(high, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
                add(self.text[low:stop], self.source(low, stop), self.changed[i])
                low = stop

        for low, high, piece in edits:
            copy(at, low)
            add(piece, self.source(low, high), True)
            at = high
        copy(at, len(self.text))
        out.text = "".join(parts)
        return out


def _strange(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or CHARACTERS.keys().isdisjoint(text):
        return []
    return [(m.start(), m.end(), CHARACTERS[m.group()]) for m in STRANGE.finditer(text)]


def _spelled(text: str) -> list[list[tuple[int, int, str]]]:
    """Digits for the words of a chain of them; what separates them goes, a spelled dot becomes one.

    Numbers of several digits belong to a chain. As one may also just stand beside it, there is a second
    list of edits, without them and with a line break where a space or dash joins the chain to what is near.
    """
    if not SPELLED_WORD.search(text.lower()):
        return [[]]
    if not (edits := _chain_edits(text, CHAIN)):
        return [edits]
    return [edits, _chain_edits(text, SINGLE_CHAIN, apart=True)]


def _chain_edits(text: str, pattern: re.Pattern, apart: bool = False) -> list[tuple[int, int, str]]:
    edits = []
    for chain in pattern.finditer(text):
        if not SPELLED_WORD.search(chain.group().lower()):
            continue
        low, high = chain.span()
        if apart and text[low - 1 : low] in (" ", "-") and not (edits and edits[-1][1] == low):
            edits.append((low - 1, low, "\n"))
        for part in CHAIN_PART.finditer(text, chain.start(), chain.end()):
            word = part.group().lower()
            if word == "plus":
                written = "+"
            elif word in SPELLED:
                written = SPELLED[word]
            elif word[0].isalpha():
                written = "."
            else:
                written = "" if not word.isdigit() else word
            edits.append((part.start(), part.end(), written))
        if apart and text[high : high + 1] in (" ", "-"):
            edits.append((high, high + 1, "\n"))
    return edits


def _disguised(text: str) -> list[tuple[int, int, str]]:
    """``@`` and ``.`` for their words and brackets. A bare ``at`` is one before a domain with a spelled or bracketed
    dot, or with real dots and a last label in ``TOP``, if no word of ``BEFORE_AT`` stands before it."""
    lowered = text.lower()
    if not (any(word in lowered for word in DOT_WORDS) or BRACKETS.search(text) or REAL_DOMAIN.search(lowered)):
        return []
    return [
        (m.start(), m.end(), "@" if m["at"] else ".") for m in DISGUISE.finditer(text)
        if m["real"] is None or _name_before(text, m.start()) not in BEFORE_AT
    ]


def _name_before(text: str, at: int) -> str:
    low = at
    while low and text[low - 1] in LOCAL:
        low -= 1
    return text[low:at].lower()


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) in code points, end exclusive; plain finds and those disguises add."""
    text = text or ""
    found = plain(text)
    spans = [(kind, low, high, False) for kind in KINDS for low, high in found[kind]]
    base = Rewritten(text)
    if edits := _strange(text):
        base = base.rewrite(edits)
    known = {kind: set(hits) for kind, hits in found.items()}
    for way, spelled in enumerate(_spelled(base.text)):
        state = base.rewrite(spelled) if spelled else base
        if edits := _disguised(state.text):
            state = state.rewrite(edits)
        if state.text == text:
            continue
        for kind, hits in plain(state.text).items():
            before = [(low, high) for k, low, high, disguised in spans if k == kind and disguised] if way else []
            for low, high in hits:
                source = state.source(low, high)
                if not state.touches(low, high) or source in known[kind]:
                    continue
                # The second way only adds what the first one has not found a part of.
                if all(source[1] <= a or b <= source[0] for a, b in before):
                    known[kind].add(source)
                    spans.append((kind, *source, True))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:]))


def redact(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with every span replaced by its kind; spans that overlap become one."""
    if not spans or text is None:
        return text
    merged: list[list] = []
    for kind, low, high, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and low < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], high)
        else:
            merged.append([kind, low, high])
    out, at = [], 0
    for kind, low, high in merged:
        out += [text[at:low], f"<{kind.upper()}>"]
        at = high
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (kind, start, end, disguised), text with the spans replaced.

    A null text has no spans and stays null; an empty one likewise. Repeated rows stay repeated, other columns
    are ignored.
    """

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        names = ("kind", "start", "end", "disguised")
        for rows in slices:
            found = [find(t) for t in rows["text"]]
            yield {
                "doc_id": rows["doc_id"],
                "spans": [[dict(zip(names, s)) for s in spans] for spans in found],
                "text": [redact(t, spans) for t, spans in zip(rows["text"], found)],
            }

    kind = "array<struct<kind:string,start:int,end:int,disguised:boolean>>"
    return map_columns(texts_of(docs), work, f"doc_id long, spans {kind}, text string")


def digest(detected: DataFrame) -> DataFrame:
    """Numbers of plain finds, the checksum of their spans, and all spans, as kind:start:end joined by commas."""

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: ~s["disguised"])
    return detected.select(
        "doc_id",
        *map(number, KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_disguised"),
    )
