"""Offset-preserving normalisation of disguised identifiers.

Each transducer rewrites a text and keeps, for every character of its output,
the source characters it stands for, so a span found in the rewritten text maps
back to the source. They run one after the other on each other's output.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

# Letters of other scripts that look like Latin ones (Unicode
# confusables), and the digit words of four languages.
HOMOGLYPHS = dict(
    zip(
        "аеорсухікмнтвѕјԁɡӏАВЕКМНОРСТУХІЅЈαονρικυχτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxikmhtbsjdglABEKMHOPCTYXISJaovpikuxtABEZHIKMNOPTYX",
        strict=True,
    )
)
DIGIT_WORDS = {
    w: str(d)
    for line in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(line.split())
} | {"oh": "0"}
INVISIBLE = "­​‌‍⁠﻿"

_BRACKETED = re.compile(r"\s{0,3}[(\[{<]\s{0,3}(at|dot|@|\.|punkt|punto|point|arroba)\s{0,3}[)\]}>]\s{0,3}", re.I)
_BRACKET = re.compile(r"[(\[{<]\s{0,3}(?:at|dot|@|\.|punkt|punto|point|arroba)\s{0,3}[)\]}>]", re.I)
_AT = {"at", "@", "arroba"}
#: The same between underscores, and as character references.
_LINKED = re.compile(r"_(at|dot)_", re.I)
_REFERENCE = re.compile(r"&#(?:0{0,3}(64|46)|[xX]0{0,3}(40|2[eE]));?")
#: Letters that imitate digits, in a run with real ones or as a part after a dot.
_LOOKALIKE = re.compile(r"(?<![A-Za-z0-9])(?:(?=[OolI]*[0-9])[0-9OolI]{1,32}|(?<=\.)[OolI]{1,3})(?![A-Za-z0-9])")
_BESIDE = re.compile(r"[0-9][OolI]|[OolI][0-9]|[0-9.][OolI](?![A-Za-z])")
def _spoken(at: str, dot: str) -> re.Pattern[str]:
    """name at host dot tld, in words; or only the dots are."""
    part = r"[A-Za-z0-9_%+-]{1,64}"
    host = r"[A-Za-z0-9-]{1,63}"
    return re.compile(
        rf"(?<![\w.+-])[A-Za-z0-9_%+.-]{{1,64}}((?:\s{{1,3}}(?:{dot})\s{{1,3}}{part}){{0,3}})(\s{{1,3}}(?:{at})\s{{1,3}}|@){host}"
        rf"((?:\.{host}){{0,4}}(?:\s{{1,3}}(?:{dot})\s{{1,3}}(?!(?:{dot})(?!\w)){host}){{1,5}})(?![\w-])",
        re.I,
    )


#: "point" is a common word after "at", so it takes the French word for it.
_SPOKEN = (_spoken("at|ät|arroba", "dot|punto|punkt"), _spoken("arobase", "point"))
_DOTS = "dot|point|punto|punkt"
_DOT_WORD = re.compile(rf"\s{{1,3}}(?:{_DOTS})\s{{1,3}}", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])\s{{1,3}}(?:{_DOTS})\s{{1,3}}(?=[0-9])", re.I)
_DIGITS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Digit words, numbers and dots in a row, of any length.
_RUN = re.compile(rf"(?<!\w)(?:plus[\s,-]{{1,3}})?(?:(?:{_DIGITS}|{_DOTS}|[0-9]+)(?:[\s,./()-]{{1,3}}|(?!\w)))++", re.I)
_DIGIT_WORD = re.compile(rf"(?<!\w)(?:{_DIGITS}|{_DOTS}|plus|[0-9]+)(?!\w)", re.I)
_DOT = frozenset(_DOTS.split("|"))
_POINTS = re.compile(rf"(?<!\w)(?:{_DOTS})(?!\w)")
JOINTS = ",./()-"
#: Digits of the shortest identifier without dots (a phone), dots of one with them (an address), and different digits ("un un un" is none).
LEAST_NUMBER, LEAST_DOTS, LEAST_DIGITS = 9, 3, 2
#: Digit words from which a spelled phone needs no leading plus.
LEAST_WORDS = 6


@dataclass
class Tape:
    """A rewritten text; character i stands for source characters ``start[i]:end[i]``."""

    text: str
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def replaced(self, spans: list[tuple[int, int, str]]) -> Tape:
        """Disjoint ordered spans of this tape rewritten; each new character stands for its whole span."""
        if not spans:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in spans:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        return Tape("".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def plain(c: str) -> str:
    """The ASCII character that ``c`` imitates; empty for invisible ones."""
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    return str(digit) if digit is not None else HOMOGLYPHS.get(c, c)


def _spelled(text: str) -> bool:
    """Whether digit words occur that could stand beside other digits or digit words."""
    for joint in JOINTS:
        if joint in text:
            text = text.replace(joint, " ")
    found = {DIGIT_WORDS[w] for w in DIGIT_WORDS.keys() & set(text.split())}
    return len(found) >= LEAST_DIGITS or (len(found) == 1 and _DIGIT.search(text) is not None)


_DIGIT = re.compile("[0-9]")


def _numbers(tape: Tape) -> list[tuple[int, int, str]]:
    """Numbers that are spelled, wholly or in part, as digits. What they make up is left to the
    patterns and checks of the identifiers: digits with a space between two of them, or, if
    dots are spoken as well, digits without one between the dots."""
    out: list[tuple[int, int, str]] = []
    for m in _RUN.finditer(tape.text):
        words = list(_DIGIT_WORD.finditer(tape.text, *m.span()))
        said = [w[0].lower() for w in words]
        while said and said[-1] in _DOT:
            words.pop()
            said.pop()
        while said and said[0] in _DOT:
            words.pop(0)
            said.pop(0)
        digits = ["." if s in _DOT else "+" if s == "plus" else DIGIT_WORDS.get(s, s) for s in said]
        numbers = "".join(d for d in digits if d not in ".+")
        dots = digits.count(".")
        if not any(s in DIGIT_WORDS for s in said) or len(set(numbers)) < LEAST_DIGITS or (len(numbers) < LEAST_NUMBER and dots < LEAST_DOTS):
            continue
        for i, (w, d) in enumerate(zip(words, digits, strict=True)):
            if i and words[i - 1].end() < w.start():
                tight = digits[i - 1] in "+." or d == "." or (dots and (said[i] in DIGIT_WORDS or said[i - 1] in DIGIT_WORDS))
                gap = tape.text[words[i - 1].end() : w.start()]
                out.append((words[i - 1].end(), w.start(), "." if dots and gap.strip() == "." else "" if tight else " "))
            if d != said[i]:
                out.append((*w.span(), d))
    return out


def normalised(text: str) -> Tape | None:
    """The text without disguises; None if it has none."""
    odd = () if text.isascii() else [c for c in set(text) if not c.isascii() and plain(c) != c]
    low = text.lower()
    bracketed = _BRACKET.search(text)
    spoken = any(w in low for w in _DOT) and _POINTS.search(low)
    spelled = _spelled(low)
    linked = "_dot_" in low and "_at_" in low
    reference = "&#" in text
    lookalike = _BESIDE.search(text)
    if not (odd or bracketed or spoken or spelled or linked or reference or lookalike):
        return None
    tape = Tape.of(text)
    if odd:
        tape = tape.replaced([(i, i + 1, plain(c)) for i, c in enumerate(text) if c in odd])
    if reference:
        tape = tape.replaced([(*m.span(), "@" if m[1] == "64" or m[2] == "40" else ".") for m in _REFERENCE.finditer(tape.text)])
    if linked:
        tape = tape.replaced([(*m.span(), "@" if m[1].lower() == "at" else ".") for m in _LINKED.finditer(tape.text)])
    if lookalike:
        digits = str.maketrans("OolI", "0011")
        tape = tape.replaced([(i, i + 1, tape.text[i].translate(digits)) for m in _LOOKALIKE.finditer(tape.text) for i in range(*m.span()) if tape.text[i] in "OolI"])
    if odd or bracketed:
        tape = tape.replaced([(m.start(), m.end(), "@" if m[1].lower() in _AT else ".") for m in _BRACKETED.finditer(tape.text)])
    if odd or spoken:
        for form in _SPOKEN:
            signs: list[tuple[int, int, str]] = []
            for m in form.finditer(tape.text):
                signs += [(*d.span(), ".") for d in _DOT_WORD.finditer(tape.text, *m.span(1))]
                signs.append((*m.span(2), "@"))
                signs += [(*d.span(), ".") for d in _DOT_WORD.finditer(tape.text, *m.span(3))]
            tape = tape.replaced(signs)
    if odd or spelled:  # with their dots, so before those between digits
        tape = tape.replaced(_numbers(tape))
    if odd or spoken:
        tape = tape.replaced([(*m.span(), ".") for m in _NUMBER_DOT.finditer(tape.text)])
    return tape if tape.text != text else None
