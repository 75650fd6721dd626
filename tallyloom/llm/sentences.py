"""Sentence boundaries across languages and scripts.

Method: ordered pairs of break and no-break expressions in cascading tables (``sentence_rules``). A text is
cut into units at blank lines; in a unit every place behind a mark is put to the tables of its script and of the language of its sentence, the first rule that matches deciding.
Quotations and brackets that their sentence carries beyond are found first, and no place inside them counts.

The language of a sentence, where it matters, is the one most of whose frequent words stand in it; if they do not tell, those up to the next mark
are counted too; if these do not tell either, the tables of all languages of the script are asked. Other sentences of the paragraph
do not count, since they may be in another language.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import sentence_rules as R
from tallyloom.session import ship

EMOJI = R.EMOJI
BLANK_LINES = re.compile(r"(?:\r\n|\n|\r(?!\n)|\u2029)[^\S\r\n]*[\r\n\u2029]\s*|\u2029")
TAIL = rf"(?:[^\S\n]»(?![\p{{L}}\p{{N}}])|[{R.CLOSING}])*(?:\[\p{{N}}{{1,3}}\])*(?:\s?{EMOJI}+)?"
#: A mark or several (Tibetan ones also set apart by a blank), then what belongs to it: closing signs, note numbers, emoji.
PLACE = regex.compile(rf"(?:[{R.MARKS}]|(?<=\p{{Greek}}\p{{M}}*);)[{R.MARKS}]*(?:(?<=[{R.SHADS}])[^\S\r\n]+[{R.SHADS}]+)*{TAIL}")
MORE = regex.compile(TAIL)
SPANS = regex.compile(
    r"(?=[„“«»‘\"「『《（(\[【])(?:„[^„“”]*[“”]|“[^“”]*”|«[^«»]*»|(?<![^\s(\[—–-])»(?=\S)[^«»]*«|‘(?:[^‘’]|’(?=\p{L}))*+’(?!\p{L})|\"[^\"]*\"|「[^「」]*」|『[^『』]*』|《[^《》]*》|（[^（）]*）|\([^()]*\)|\[[^\[\]]*\]|【[^【】]*】)"
)
OPENS = re.compile("[„“«»‘\"「『《（(\\[【]")
BRACKETS = "([（【"
GOES_ON = regex.compile(rf"\s*[,;:،؛，；：、—–-]|\s*\p{{Ll}}|\s*[.!?。！？…]")
#: Who said what stands before; not who says what follows.
SPEAKER = regex.compile(rf"\s*(?:I|(?!(?:{R.NO_SPEAKERS.replace(' ', '|')})\b){R.CAPITAL}\p{{Ll}}+)\s+(?:{R.SAYING.replace(' ', '|')})\b(?!\s*[,:：]\s*{R.OPENING})")
SAID_AFTER = regex.compile("|".join(rf"(?:\s*{p})" for p in R.SAYING_AFTER))
#: Closing signs of quotations that end with the one around them.
INNER_CLOSING = "”’»\"“"
GREEK_QUESTION = regex.compile(r"\p{Greek};")
ATTACHED = regex.compile(r"(?:\p{Hangul}|\p{Hiragana})|\s?(?:하고|라고)")
CAPITAL_NEXT = regex.compile(rf"\s*+(?:{R.OPENING}++\s*+)?{R.CAPITAL}")
UNMARKED_SPACE = regex.compile(rf"(?<=[{R.UNMARKED}{R.CLOSING}])[^\S\r\n]+(?=[^\s])")
#: The same scripts as a plain range, to ask quickly whether there are any.
HAS_UNMARKED = re.compile("[\u0e00-\u0eff]")
#: What keeps a sentence together across a blank in scripts without marks: numerals, abbreviations, Latin words.
KEEPS_LEFT = regex.compile(rf"(?<=[\p{{N}}\p{{Latin}}.])")
KEEPS_RIGHT = regex.compile(rf"\s+[{R.CLOSING}(\[]*(?:[\p{{N}}\p{{Latin}}]|[{R.UNMARKED}]+(?:\.[{R.UNMARKED}]+)*\.)")
VISIBLE = re.compile(r"[^\s\ufeff\u200b]")

SCRIPTS = {
    "latin": r"\p{Latin}",
    "cyrillic": r"\p{Cyrillic}",
    "greek": r"\p{Greek}",
    "thai": r"[\p{Thai}\p{Lao}]",
    "armenian": r"\p{Armenian}",
    "arabic": r"\p{Arabic}",
    "indic": r"[\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}]",
    "ethiopic": r"\p{Ethiopic}",
}
SCRIPT = regex.compile("|".join(f"(?P<{name}>{letters})" for name, letters in SCRIPTS.items()))


@functools.cache
def script_of(letter: str) -> str:
    found = SCRIPT.match(letter)
    return found.lastgroup if found else "other"


@functools.cache
def cascade(script: str, mark: str, language: str | None = None, plain: bool = False) -> tuple[regex.Pattern, list[tuple[bool, bool]]]:
    """The rules of a script about ``mark`` as one expression, whose alternatives are tried in order, and of each its
    decision and whether it belongs to a language. With a ``language`` the tables of the others are left out, for a ``plain`` word all that
    are not about every word.
    """
    asked = [
        (name in R.LANGUAGES, rule)
        for name in R.CASCADES[script]
        if (language is None or name == language or name not in R.LANGUAGES) and (not plain or name in R.ABOUT_EVERY_WORD)
        for rule in R.TABLES[name]
        if not rule[1] or mark in rule[1]
    ]
    # what stands behind is looked at first: it is short, and mostly decides
    either = "|".join((f"(?={after})" if after else "") + (f"(?<={before})" if before else "") + "()" for _, (_, _, before, after) in asked)
    return regex.compile(either), [(rule[0], spoken) for spoken, rule in asked]


def is_plain(last: str, script: str) -> bool:
    """Whether the last three characters before a full stop show that its word is no abbreviation, numeral or initial."""
    return len(last) == 3 and last.isalpha() and last not in R.SHORT_ENDS and script not in R.NEVER_PLAIN


WORD = re.compile(r"[^\W\d_]+")
SPOKEN_BY: dict[str, list[int]] = {}
for _number, _language in enumerate(R.LANGUAGES):
    for _word in R.FREQUENT[_language].split():
        SPOKEN_BY.setdefault(_word, []).append(_number)


class Languages:
    """The language of each sentence of a unit, by counting frequent words once."""

    def __init__(self, unit: str) -> None:
        self.unit, self.begin, self.at = unit, 0, 0
        self.counts = [0] * len(R.LANGUAGES)

    def count(self, counts: list[int], begin: int, end: int) -> None:
        for word in WORD.findall(self.unit, begin, end):
            # one capital alone is rather an initial
            for number in SPOKEN_BY.get(word if len(word) == 1 else word.lower(), ()):
                counts[number] += 1

    def at_place(self, begin: int, at: int, next_mark: int) -> str | None:
        """Of the sentence from ``begin``, read up to ``at``; None if it cannot be told. Both only grow from call to call."""
        if begin != self.begin:
            self.begin = self.at = begin
            self.counts = [0] * len(R.LANGUAGES)
        self.count(self.counts, self.at, at)
        self.at = at
        if (best := self.best(self.counts)) is not None:
            return best
        ahead = list(self.counts)
        self.count(ahead, at, next_mark)
        return self.best(ahead)

    def best(self, counts: list[int]) -> str | None:
        most = max(counts)
        return R.LANGUAGES[counts.index(most)] if most and counts.count(most) == 1 else None


def _guard(unit: str, begin: int, end: int, lower: int) -> int | None:
    """Up to where no mark in the quotation or bracket ``unit[begin:end]`` ends a sentence; None if its sentences stand for themselves.

    All of it where the sentence goes on behind; up to its last marks where the sentence began before it and ends with it. ``lower``: where its context begins.
    """
    before = unit[max(lower, begin - 8) : begin].rstrip().rstrip("\ufeff\u200b").rstrip()
    inside = unit[begin + 1 : end - 1].rstrip().rstrip(INNER_CLOSING)
    last = inside[-1:]
    marked = bool(last) and last in R.MARKS or last == ";" and GREEK_QUESTION.fullmatch(inside[-2:]) is not None
    starts = not before or before[-1] in R.MARKS or before[-1] in "”»’\"）)]」』" or regex.match(EMOJI, before[-1]) is not None
    if not marked:
        return end
    if unit[begin] in BRACKETS:
        return None if starts else end
    if unit[begin] == "《":
        return end
    if not VISIBLE.search(unit, end):
        goes_on = False
    elif GOES_ON.match(unit, end):
        goes_on = True
    elif starts:
        goes_on = (SPEAKER.match(unit, end) or SAID_AFTER.match(unit, end)) is not None
    elif before[-1] in ":：,،，":
        goes_on = ATTACHED.match(unit, end) is not None
    else:
        goes_on = CAPITAL_NEXT.match(unit, end) is None
    if goes_on:
        return end
    return None if starts else begin + 1 + len(inside.rstrip(R.MARKS + ";"))


def _guarded(unit: str, closed: set[int], lower: int = 0, upper: int | None = None) -> list[tuple[int, int]]:
    """Spans inside which no mark ends a sentence, in order. ``closed`` gets the ends of all quotations and brackets."""
    spans: list[tuple[int, int]] = []
    for found in SPANS.finditer(unit, lower, len(unit) if upper is None else upper):
        begin, end = found.span()
        closed.add(end)
        until = _guard(unit, begin, end, lower)
        inner = _guarded(unit, closed, begin + 1, end - 1) if until != end else []
        spans += inner if until is None else [(begin, until)]
    return spans


def _ends(unit: str) -> list[int]:
    """Places in a unit at which a sentence ends, but for its own end."""
    closed: set[int] = set()
    spans = _guarded(unit, closed) if OPENS.search(unit) else []
    starts = [a for a, _ in spans]
    ends: list[int] = []
    languages = Languages(unit)
    read, letter = 0, ""
    found = PLACE.search(unit)
    while found:
        at, mark, place = found.start(), unit[found.start()], found.end()
        following = PLACE.search(unit, place)
        k = at
        while k > read and not unit[k - 1].isalpha():
            k -= 1
        if k > read:
            letter = unit[k - 1]
        read, found = at, following
        while place + 1 in closed and unit[place] in R.CLOSING_IF_OPENED:
            place = MORE.match(unit, place + 1).end()
        k = bisect_right(starts, at) - 1
        if k >= 0 and at < spans[k][1]:
            if place > spans[k][1] and (again := PLACE.search(unit, spans[k][1], place)) and unit[again.start()] in R.MARKS:
                place = again.end()
            else:
                continue
        if mark in R.SURE:
            ends.append(place)
            continue
        script, mark = script_of(letter) if letter else "other", "?" if mark == ";" else mark
        rules, decisions = cascade(script, mark, None, mark == "." and is_plain(unit[max(0, at - 3) : at], script))
        end, spoken = decisions[rules.match(unit, place).lastindex - 1]
        if spoken and (language := languages.at_place(ends[-1] if ends else 0, at, following.start() if following else len(unit))):
            rules, decisions = cascade(script, mark, language)
            end, _ = decisions[rules.match(unit, place).lastindex - 1]
        if end:
            ends.append(place)
    if HAS_UNMARKED.search(unit):
        for found in UNMARKED_SPACE.finditer(unit):
            at = found.start()
            k = bisect_right(starts, at) - 1
            if (k < 0 or at >= spans[k][1]) and not KEEPS_LEFT.match(unit, at) and not KEEPS_RIGHT.match(unit, at):
                ends.append(at)
        ends.sort()
    return ends


def sentence_ends(text: str | None) -> list[int]:
    """For each sentence the number of characters up to and including its last one that is not blank, ascending."""
    if not text:
        return []
    out: list[int] = []
    begin = 0
    for a, b in [*((m.start(), m.end()) for m in BLANK_LINES.finditer(text)), (len(text), len(text))]:
        unit = text[begin:a]
        if VISIBLE.search(unit):
            last = 0
            for end in [*_ends(unit), len(unit)]:
                piece = unit[last:end].rstrip()
                if VISIBLE.search(piece):
                    out.append(begin + last + len(piece))
                    last = end
        begin = b
    return out


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, end_pos): one row for each sentence of each text; whole texts, and no row for null, empty and blank ones.

    Nothing is shuffled. ``end_pos`` counts code points. Repeated texts are cut each; the stated language of a row is not used, since it may be wrong and texts mix
    languages: each place goes by the script it stands in. Other columns are ignored and not read.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                ends = [sentence_ends(t.as_py()) for t in batch.column(1)]
                counts = np.array([len(e) for e in ends], dtype=np.int64)
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(ends)), counts)))
                yield pa.RecordBatch.from_arrays([keys, pa.array([e for one in ends for e in one], pa.int64())], ["k", "end_pos"])

    return rows.mapInArrow(run, f"k {kind}, end_pos bigint").withColumnRenamed("k", key)
