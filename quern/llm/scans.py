"""Repairing text that was taken from scanned pages.

Words broken at line and page ends are joined, misrecognised characters put right,
running headers, footers and page numbers taken out, and the lines joined to
paragraphs. A misread word is decoded as a noisy channel: every word it may have
been is weighed by how likely its characters are confused and by how likely the
corpus makes it there, and Viterbi picks the best path through each line.

The driver holds the confusions and the most frequent words, both of a fixed bound;
rarer words, the suspicious words' candidates and word pairs are looked up by joins,
so that no result depends on the bound. A word and all its misreadings, however many
of its characters are confused, share one skeleton; candidates are joined by it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.lookalikes import look
from quern.operators.snapshots import current_sections
from quern.session import materialise

#: What was printed, and what recognition makes of it.
CONFUSIONS = (
    ("m", "rn"), ("n", "ri"), ("u", "ii"), ("ü", "ii"), ("w", "vv"), ("d", "cl"), ("h", "b"), ("li", "h"),
    ("e", "c"), ("i", "l"), ("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("g", "9"), ("t", "f"), ("b", "6"), ("é", "6"),
    ("rn", "m"), ("ó", "6"), ("ô", "6"), ("ả", "å"), ("á", "å"), ("ấ", "â'"), ("ế", "ê'"), ("ố", "ô'"), ("z", "2"), ("b", "8"), ("q", "9"), ("ß", "b"), ("ß", "8"),
    ("ạ", "a."), ("ẹ", "e."), ("ệ", "e."), ("ệ", "ê."), ("ị", "i."), ("ọ", "o."), ("ộ", "ô."), ("ợ", "ơ."), ("ụ", "u."), ("ự", "ư."), ("ậ", "â."), ("ặ", "ă."),
)
#: Words sent to all tasks, the most frequent ones; others are looked up by a join.
HEAD = 100_000
#: A word seen so often, without a likelier reading, is taken as it is; others are decoded in their line. Pairs with rarer words tell nothing.
SEEN = 3
#: One in so many: how likely a word nobody has seen has just these characters, by character; at most a hundredth of a word seen once.
CHARACTERS = 30
#: Lines at either edge of a page that may be running lines. Where all of them are, as many more are looked at, and so on.
EDGE = 3
#: Probability of a confusion before any was counted.
PRIOR = 1e-3
#: Share of a word's probability that comes from the word before it.
PAIR_SHARE = 0.6
#: Signs that scanning leaves where a line breaks a word; the first is also a word's own.
BREAKS = "-‐‑\xac\xad"
#: Words for page in the store's languages.
PAGE_WORDS = ("page", "seite", "trang", "pg", "p", "s", "tr")
#: Words before the total of pages.
TOTAL_WORDS = ("of", "von", "sur", "de", "trên")

_ALNUM = regex.compile(r"[\p{L}\p{N}]+")
#: Five words or more.
_WORDY = re.compile(r"[\W_]*(?:[^\W_]+[\W_]+){4}[^\W_]")
_NEWLINE = re.compile(r"\r\n|\n|\r")
#: Letters and numbers, joined by hyphens and apostrophes, or by a dot that a letter may have had below it.
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:(?:[-'’‐‑]|(?<=[aeiouâêôơưă])\.)[\p{L}\p{M}\p{N}]+)*")
_LAST = regex.compile(rf"([\p{{L}}\p{{M}}\p{{N}}]+(?:[-'’][\p{{L}}\p{{M}}\p{{N}}]+)*)([{BREAKS}])[ \t]*$")
_FIRST = regex.compile(r"^[ \t]*([\p{L}\p{M}\p{N}]+(?:[-'’‐‑][\p{L}\p{M}\p{N}]+)*)")
_FENCE = re.compile(r"[ \t]{0,3}(```|~~~)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]")
_ROMAN = re.compile(r"(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")

_FOLDS = [(seen, real) for real, seen in (("m", "rn"), ("n", "ri"), ("u", "ii"), ("w", "vv"), ("d", "cl"), ("h", "li"))]
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_DIGITS = str.maketrans({"1": "l", "6": "b"})
_FOLDED = str.maketrans({"1": "l", "i": "l", "0": "o", "5": "s", "9": "g", "6": "b", "8": "b", "c": "e", "f": "t", "h": "b", "2": "z", "é": "b"})


def fold(line: str) -> str:
    """A line without blanks, signs and letter case, and with characters that are confused made equal."""
    text = regex.sub(r"[^\p{L}\p{N}]+", "", unicodedata.normalize("NFC", look(line)).lower())
    return _made_equal(text)


def _made_equal(text: str) -> str:
    text = text.translate(_DIGITS)
    for seen, real in _FOLDS:
        text = text.replace(seen, real)
    return text.translate(_FOLDED)


def number_of(word: str) -> int | None:
    """A page number in digits, some of which may be misread as letters, or in Roman ones."""
    low = word.lower()
    if re.fullmatch(r"[0-9liosbg]{1,5}", low) and (any(c.isdigit() for c in low) or low in ("l", "ll", "s", "b", "g", "o")):
        return int(low.translate(str.maketrans("liosbg", "110569")))
    roman = low.replace("1", "i")
    low = roman if _ROMAN.fullmatch(roman) else roman.replace("l", "i")
    found = _ROMAN.fullmatch(low)
    if not found:
        return None
    value, last = 0, 0
    for c in reversed(low):
        n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
        value, last = (value - n, last) if n < last else (value + n, n)
    return value


_PAGE_FOLDS = {fold(w) for w in PAGE_WORDS}


def page_number(line: str) -> tuple[int, bool] | None:
    """The number of a line that is nothing but a page's number, and whether it is plain digits.

    Signs, however many, a word for page and a total may stand with it.
    """
    if _WORDY.match(line):
        return None
    words = [m[0] for m in islice(_ALNUM.finditer(look(line)), 5)]
    if not 1 <= len(words) <= 4:
        return None
    named = len(words) > 1 and fold(words[0]) in _PAGE_FOLDS and (words[0].isalpha() or number_of(words[0]) is None)
    words = words[named:]
    total = len(words) == 3 and words[1].lower() in TOTAL_WORDS
    if total:
        words = words[::2]
    if len(words) > 2:
        return None
    numbers = [number_of(w) for w in words]
    if None in numbers or (len(numbers) == 2 and not numbers[0] <= numbers[1]):
        return None
    if len(numbers) == 2 and not (total or re.search(r"[/|]", line)):
        return None
    return numbers[0], line.strip().isdigit()


def header_forms(line: str) -> set[str]:
    """The folded line, and the same without a page's number at either end."""
    forms = {fold(line)}
    for pattern in (r"^\W*(\w{1,5})\W+(?=\w)", r"(?<=\w)\W+(\w{1,5})\W*$"):
        found = re.search(pattern, look(line).strip())
        if found and number_of(found[1]) is not None:
            rest = line.strip()[found.end() :] if pattern[0] == "^" else look(line).strip()[: found.start()]
            forms.add(fold(rest))
    return {f for f in forms if len(f) >= 4}


def masks(line: str) -> list[int]:
    """Hashes of a line's folded forms without one of its words and with all numbers alike.

    Running lines of different documents that differ in a name only share one. A form's
    hash is put together from those of the line's beginnings, so a long line costs no more than its length.
    """
    text = re.sub(r"\d+", "0", unicodedata.normalize("NFC", look(line)).lower())
    folded = _made_equal("\0".join(regex.findall(r"[\p{L}\p{M}\p{N}]+", text))).split("\0")
    begun = [0]
    for w in folded:
        begun.append(reduce(lambda h, c: (h * _BASE + ord(c)) % _PRIME, w, begun[-1]))
    size, out, rest = sum(map(len, folded)), [], 0
    for i in range(len(folded) - 1, -1, -1):
        shift = pow(_BASE, rest, _PRIME)
        if len(folded) > 1 and size - len(folded[i]) >= 4:
            out.append((begun[i] * shift + begun[-1] - begun[i + 1] * shift) % _PRIME)
        rest += len(folded[i])
    return list(dict.fromkeys(out))


class Headers:
    """A document's running lines, to be found in lines that repeat them, misread or not.

    A line that is as good as equal (nine tenths of both are in common) has runs of
    four characters in common with it; only lines that have enough of these are compared.
    """

    def __init__(self, forms: Iterable[str]):
        self.forms = set(forms)
        self.longest = 2 * max(map(len, self.forms), default=-10) + 20
        self.lengths = {len(f) for f in self.forms}
        self.grams: dict[str, list[str]] = {}
        for form in self.forms:
            if len(form) >= 8:
                for gram in {form[i : i + 4] for i in range(len(form) - 3)}:
                    self.grams.setdefault(gram, []).append(form)

    def may_repeat(self, line: str) -> bool:
        """Whether a line's length fits one of the forms, with a page number and signs besides.

        Folding takes no more than half of the letters away.
        """
        letters = len(re.sub(r"[\W_]+", "", line))
        return any(h - 2 <= letters <= 2 * h + 8 for h in self.lengths)

    def repeated_by(self, line: str) -> bool:
        forms = header_forms(line)
        return bool(forms & self.forms) or any(map(self._near, forms))

    def _near(self, form: str) -> bool:
        shared = Counter(h for i in range(len(form) - 3) for h in self.grams.get(form[i : i + 4], ()))
        for header, n in shared.items():
            both = len(form) + len(header)
            alike, parts = math.ceil(0.45 * both), int(0.1 * both) + 1
            if abs(len(form) - len(header)) <= 2 and n >= alike - 3 * parts:
                if SequenceMatcher(None, form, header, autojunk=False).ratio() >= 0.9:
                    return True
        return False


@lru_cache(maxsize=256)
def _headers(forms: tuple[str, ...]) -> Headers:
    return Headers(forms)


@dataclass
class Line:
    """A line of a section: ``text`` carries the running text, all other kinds but noise stay as they are."""

    kind: str
    text: str


@dataclass
class Word:
    """A word of the running text; ``line`` and ``start`` say where it begins.

    A broken word has its second half at ``line2``, up to ``end2``.
    """

    line: int
    start: int
    end: int
    text: str
    forms: tuple[str, ...] = field(default=())
    line2: int = -1
    end2: int = -1
    sign: str = ""


def classify(text: str, headers: Headers, numbers: range | None) -> list[Line]:
    """The lines of a section by kind: text, item, heading, table, code, blank, header, page_number.

    ``numbers`` are those printed on the section's pages; without them, only numbers
    with a sign or word are taken for page numbers.
    """
    raw = _NEWLINE.split(text)
    lines, fenced = [], False
    found = [page_number(t) if t.strip() else None for t in raw]
    for i, line in enumerate(raw):
        bare = line.strip()
        if _FENCE.match(line):
            lines.append(Line("code", line))
            fenced = not fenced
        elif fenced:
            lines.append(Line("code", line))
        elif not bare:
            lines.append(Line("blank", line))
        elif bare[0] == "|" or (bare[0] == "#" and re.match(r"#{1,6}(\s|$)", bare)):
            lines.append(Line("table" if bare[0] == "|" else "heading", line))
        elif (n := found[i]) is not None and _own_number(n, numbers, i, found):
            lines.append(Line("page_number", line))
        elif len(bare) <= headers.longest and headers.may_repeat(bare) and headers.repeated_by(line):
            lines.append(Line("header", line))
        else:
            lines.append(Line("item" if _ITEM.match(line) else "text", line))
    for i in _listed(lines):
        lines[i].kind = "text"
    return lines


def _listed(lines: list[Line]) -> list[int]:
    """Lines taken for page numbers that are values of a list: in a run of plain numbers that a colon opens, away from running lines."""
    out, run = [], False
    for i, line in enumerate(lines):
        plain_number = line.text.strip().isdigit()
        run = plain_number and (run or (i > 0 and lines[i - 1].text.rstrip().endswith(":")))
        near = [x.kind for x in lines[max(0, i - 1) : i + 2]]
        if run and line.kind == "page_number" and "header" not in near:
            out.append(i)
    return out


def _own_number(n: tuple[int, bool], numbers: range | None, at: int, found: list) -> bool:
    value, plain = n
    if numbers:
        return value in numbers
    near = [found[j] for j in (at - 1, at + 1) if 0 <= j < len(found)]
    return not plain or (0 < value < 2000 and not any(x and x[1] for x in near))


def words_of(lines: list[Line], passed: Callable[[str], bool] | None = None) -> list[list[Word]]:
    """The words of the running text by logical line, broken ones put together.

    A word is broken where a line ends in a sign for it and the next line of the same
    paragraph, past page numbers and running lines, goes on with a letter. Lines
    without broken words whose text is ``passed`` are left out.
    """
    out: list[list[Word]] = []
    skip: dict[int, int] = {}
    for i, line in enumerate(lines):
        if line.kind not in ("text", "item"):
            continue
        text, start = line.text, skip.get(i, 0)
        last = _LAST.search(text) if text.rstrip()[-1] in BREAKS else None
        j = _continues(lines, i) if last else -1
        first = _FIRST.match(lines[j].text) if j >= 0 else None
        if first and (first[1][0].isdigit() or last[1][-1].isdigit()) and not _letters(last[1] + first[1]):
            first = None
        if first is None and passed and passed(text[start:]):
            continue
        words = [Word(i, m.start(), m.end(), m[0]) for m in _WORD.finditer(text) if m.start() >= start]
        if first:
            a, b = last[1], first[1]
            words = [w for w in words if w.start < last.start()]
            words.append(Word(i, last.start(), last.end(2), a + b, (a + b, f"{a}-{b}"), j, first.end(), last[2] + ("" if text.endswith(last[2]) else " ")))
            skip[j] = first.end()
        out.append(words)
    return out


def _letters(word: str) -> bool:
    return sum(c.isalpha() for c in word) >= 3


def _continues(lines: list[Line], at: int) -> int:
    """The line that goes on with the paragraph of line ``at``, or -1."""
    noise = blanks = 0
    for j in range(at + 1, len(lines)):
        kind = lines[j].kind
        if kind in ("header", "page_number"):
            noise += 1
        elif kind == "blank":
            blanks += 1
        elif kind == "text":
            return j if noise or not blanks else -1
        else:
            return -1
    return -1


def plain(word: str) -> str:
    """A word as it is counted and looked up."""
    return look(word).lower().replace("\u2019", "'")


def _skeletons() -> dict[int, str]:
    """For each character that is confused, a text that it shares with all it is confused with.

    Every confusion is an equation of two texts. One side without what both begin and
    end with is a single character; it is written as the other from then on.
    """
    written: dict[str, str] = {}
    left = [pair for pair in CONFUSIONS]
    while left:
        a, b = ("".join(written.get(c, c) for c in text) for text in left.pop())
        while a and b and a[0] == b[0]:
            a, b = a[1:], b[1:]
        while a and b and a[-1] == b[-1]:
            a, b = a[:-1], b[:-1]
        if a == b:
            continue
        one, other = (a, b) if len(a) == 1 else (b, a)
        if len(one) != 1 or one in other:
            raise ValueError(f"these confusions leave no common form: {a} {b}")
        written = {c: text.replace(one, other) for c, text in written.items()} | {one: other}
    return {ord(c): text for c, text in written.items()}


_SKELETON = _skeletons()


def skeleton(word: str) -> str:
    """Equal for a word and whatever recognition makes of it."""
    return word.translate(_SKELETON)


def _skeleton_of(word: Column) -> Column:
    """The same in the JVM; what characters are written as isn't rewritten again."""
    return reduce(lambda text, c: F.replace(text, F.lit(chr(c)), F.lit(_SKELETON[c])), _SKELETON, word)


_RULES: dict[str, list[tuple[int, str, str]]] = {}
for _k, (_real, _seen) in enumerate(CONFUSIONS):
    _RULES.setdefault(_real[0], []).append((_k, _real, _seen))


def confused(real: str, seen: str) -> tuple[int, ...] | None:
    """The fewest confusions that make ``seen`` of ``real``, every printed character being misread once at most; None where none do."""
    ways: list[dict[int, tuple[int, ...]]] = [{} for _ in range(len(real) + 1)]
    ways[0][0] = ()

    def reach(i: int, j: int, how: tuple[int, ...]) -> None:
        known = ways[i].get(j)
        if known is None or (len(how), how) < (len(known), known):
            ways[i][j] = how

    for i, c in enumerate(real):
        for j, how in ways[i].items():
            if seen.startswith(c, j):
                reach(i + 1, j + 1, how)
            for k, printed, read in _RULES.get(c, ()):
                if seen.startswith(read, j) and real.startswith(printed, i):
                    reach(i + len(printed), j + len(read), (*how, k))
    return ways[-1].get(len(seen))


def outweighed(own: int, readings: Iterable[tuple[int, int]]) -> bool:
    """Whether one of a word's other readings, each a count and its confusions, is likelier than the word seen ``own`` times."""
    return any(n * PRIOR**k > own for n, k in readings)


class Lexicon(dict):
    """The most frequent words with their counts, and for each word whether it is safe.

    A word is safe if it is frequent and can't have been another, still more frequent
    one. The dictionary remembers the answers. A word that isn't among them is never safe.
    """

    def __init__(self, head: dict[str, int], rivals: dict[str, list[str]] | None = None):
        super().__init__()
        self.head = head
        if rivals is None:
            groups: dict[str, list[str]] = {}
            for word in head:
                groups.setdefault(skeleton(word), []).append(word)
            rivals = {key: words for key, words in groups.items() if len(words) > 1}
        self.rivals = rivals

    def __missing__(self, word: str) -> bool:
        own = self.head.get(word, 0)
        known = own >= SEEN
        if known:
            likelier = [c for c in self.rivals.get(skeleton(word), ()) if c != word and self.head[c] * PRIOR > own]
            known = not outweighed(own, ((self.head[c], len(k)) for c in likelier if (k := confused(c, word))))
        self[word] = known = known or not any(c.isalpha() for c in word)
        return known

    def passes(self, text: str) -> bool:
        """Whether all words of a text are safe."""
        if len(self) > 500_000:
            self.clear()
        return all(map(self.__getitem__, _WORD.findall(plain(text))))


def viterbi(line: list[list[tuple[str, float]]], unigram: dict[str, int], pairs: dict[tuple[str, str], int], total: int) -> list[str]:
    """The likeliest words of a line: each position has its candidates with the log probability of their characters."""

    def step(before: str | None, word: str) -> float:
        seen = unigram.get(word, 0)
        alone = (seen + 0.01) / total if seen else min(0.01 / total, max(float(CHARACTERS) ** -len(word), 1e-300))
        if before is None:
            return math.log(alone)
        return math.log((1 - PAIR_SHARE) * alone + PAIR_SHARE * pairs.get((before, word), 0) / (unigram.get(before, 0) + 1))

    best: list[dict[str, tuple[float, str | None]]] = []
    for options in line:
        row: dict[str, tuple[float, str | None]] = {}
        for word, seen in options:
            if best:
                score, before = max((s + step(b, word), b) for b, (s, _) in best[-1].items())
            else:
                score, before = step(None, word), None
            row[word] = (score + seen, before)
        best.append(row)
    if not best:
        return []
    word = max(best[-1], key=lambda w: (best[-1][w][0], w))
    path = [word]
    for row in reversed(best[1:]):
        path.append(row[path[-1]][1])
    return path[::-1]


def _edges(pages: DataFrame, depth: int) -> DataFrame:
    """``repo_id, doc_id, page, line, place, seen`` of the lines that are ``EDGE`` or fewer further in than ``depth`` at either edge of a page.

    ``place`` counts from the edge, up from 0 at the top and down from -1 at the bottom.
    """
    lines = F.filter(F.split("page_text", r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    placed = F.transform("l", lambda x, i: F.struct(x.alias("line"), i.alias("place")))
    last = F.transform(F.reverse("l"), lambda x, i: F.struct(x.alias("line"), (-1 - i).alias("place")))
    outer = F.concat(*(F.slice(side, depth + 1, EDGE) for side in (placed, last)))
    own = pages.where("page_text IS NOT NULL AND page IS NOT NULL").select("repo_id", "doc_id", "page", lines.alias("l"))
    return own.select("repo_id", "doc_id", "page", F.explode(outer).alias("e")).select("repo_id", "doc_id", "page", "e.line", "e.place", F.lit(False).alias("seen"))


def _marks(lines: DataFrame) -> DataFrame:
    """Of lines that may be running ones ``form``, the folded line; of page numbers ``shift``, by how much they differ from the page's place.

    A line that ends like a sentence is none, unless it was recognised as one.
    """
    schema = "repo_id string, doc_id string, page int, seen boolean, place int, line string, form string, shift int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for repo, doc, page, line, place, seen in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "doc_id", "page", "line", "place", "seen"))):
                number = page_number(line)
                if number:
                    if page is not None:
                        out.append((repo, doc, page, seen, place, None, None, number[0] - page))
                elif seen or line.rstrip()[-1] not in ".,;:!?":
                    out += [(repo, doc, page, seen, place, line, form, None) for form in header_forms(line)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["repo_id", "doc_id", "page", "seen", "place", "line", "form", "shift"])

    return lines.mapInArrow(run, schema)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _masks_of(lines: pd.Series) -> pd.Series:
    return lines.map(masks)


def running_lines(pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """For every scanned document ``repo_id, doc_id, headers, shift, first_page, last_page``.

    ``headers`` are folded running lines: those recognised on a page, those at the
    edge of two pages or more, and those at one edge that differ from running lines
    of two other documents in one word and numbers only. ``shift`` is what most
    pages' printed numbers differ by from their place. Lines are counted before any
    list is built, so a document of very many pages costs one row for each line that
    differs. Where an edge consists of nothing but running lines, the lines further
    in are looked at as well, until no page has such an edge left.
    """
    doc = ["repo_id", "doc_id"]
    known = furniture.where("line_text IS NOT NULL AND trim(line_text) <> ''").select(*doc, "page", F.col("line_text").alias("line"), F.lit(None).cast("int").alias("place"), F.lit(True).alias("seen"))
    marks, near, depth = None, pages, 0
    while True:
        lines = _edges(near, depth)
        new = materialise(_marks(lines.unionByName(known) if marks is None else lines), "edges")
        marks = new if marks is None else marks.unionByName(new)
        on_pages = marks.where("form IS NOT NULL").groupBy(*doc, "form", "page").agg(F.max("seen").alias("seen"), F.min("line").alias("line"))
        forms = materialise(on_pages.groupBy(*doc, "form").agg(F.count("page").alias("n"), F.max("seen").alias("seen"), F.min("line").alias("line")), "forms")
        sure = forms.where("seen OR n > 1")
        depth += EDGE
        at = [*doc, "page", "place"]
        own = new.where("NOT seen")
        running = own.join(sure.select(*doc, "form"), [*doc, "form"], "left_semi").select(*at).unionByName(own.where("shift IS NOT NULL").select(*at)).distinct()
        full = materialise(running.groupBy(*doc, "page", F.col("place") < 0).agg(F.count("*").alias("n")).where(F.col("n") == EDGE).select(*doc, "page").distinct(), "full")
        if full.isEmpty():
            break
        near = near.join(full, [*doc, "page"], "left_semi").where(F.size(F.split("page_text", r"\r\n|\n|\r")) > depth)
    extent = pages.groupBy(*doc).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    templates = sure.select(*doc, F.explode(_masks_of("line")).alias("mask")).distinct().groupBy("mask").agg(F.count("*").alias("docs")).where("docs > 1").select("mask")
    once = forms.where("NOT seen AND n = 1").select(*doc, "form", F.explode(_masks_of("line")).alias("mask")).join(templates, "mask", "left_semi")
    headers = sure.select(*doc, "form").unionByName(once.select(*doc, "form")).groupBy(*doc).agg(F.collect_set("form").alias("headers"))
    shifts = marks.where("shift IS NOT NULL").groupBy(*doc, "shift").agg(F.countDistinct("page").alias("n"))
    shifts = shifts.groupBy(*doc).agg(F.max_by("shift", F.struct("n", (-F.abs("shift")).alias("near"), "shift")).alias("shift"))
    return extent.join(headers, doc, "left").join(shifts, doc, "left")


def scanned_sections(sections: DataFrame, pages: DataFrame, furniture: DataFrame, spans: DataFrame) -> DataFrame:
    """``id, headers, low, high`` of the last snapshot's sections of documents that have a text layer.

    ``low`` to ``high`` are the numbers printed on the section's pages, or on all of
    the document where no span is known; null where no number could be read.
    """
    doc = ["repo_id", "doc_id"]
    where = spans.groupBy(*doc, "section_id").agg(F.min("page").alias("page"), F.max(F.coalesce("end_page", "page")).alias("end_page"))
    joined = current_sections(sections).join(running_lines(pages, furniture), doc).join(where, [*doc, "section_id"], "left")
    low, high = F.coalesce("page", "first_page") + F.col("shift"), F.coalesce("end_page", "last_page") + F.col("shift")
    return joined.select("id", F.coalesce("headers", F.array().cast("array<string>")).alias("headers"), low.alias("low"), high.alias("high"))


def corpus_grams(texts: DataFrame, scanned: str, noisy: str, clean: Iterable[str]) -> DataFrame:
    """``a, b, n``: how often each word (``b`` null) and each pair of neighbours occurs.

    Counts the ``clean`` columns of all rows, and the ``noisy`` one of those that
    aren't ``scanned``. A row that is there several times has their number as ``times``
    and counts by its share, so that repeats count once. Each task adds up before anything is shuffled.
    """
    clean = list(clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single: Counter = Counter()
        pairs: Counter = Counter()

        def add(counts: Counter, found: Iterable, share: float) -> None:
            if share == 1:
                counts.update(found)
            else:
                for x in found:
                    counts[x] += share

        def flush() -> pa.RecordBatch:
            a, b = zip(*pairs) if pairs else ((), ())
            columns = [[*single, *a], [*[None] * len(single), *b], [*single.values(), *pairs.values()]]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=["a", "b", "n"])
            single.clear()
            pairs.clear()
            return made

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in clean]
            columns.append([None if s else t for s, t in zip(batch.column(scanned).to_pylist(), batch.column(noisy).to_pylist())])
            shares = [1 / (n or 1) for n in batch.column("times").to_pylist()]
            for column in columns:
                for text, share in zip(column, shares):
                    if text:
                        words = _WORD.findall(plain(text))
                        add(single, words, share)
                        add(pairs, zip(words, words[1:]), share)
                if len(single) + len(pairs) > 500_000:
                    yield flush()
        yield flush()

    counted = texts.select(scanned, "times", noisy, *clean).mapInArrow(run, "a string, b string, n double").groupBy("a", "b").agg(F.round(F.sum("n")).cast("long").alias("n"))
    return counted.where("n > 0")


_WORD_TYPE = pa.struct([("forms", pa.list_(pa.string())), ("broken", pa.string()), ("tail", pa.string()), ("suspect", pa.bool_())])


def _forms(word: Word) -> list[str]:
    return [plain(f) for f in (word.forms or (word.text,))]


def _broken_form(forms: list[str], counts: dict[str, int]) -> str:
    """The more frequent form of a broken word, and without the hyphen where neither was seen."""
    return max(forms, key=lambda f: (counts.get(f, 0), f == forms[0]))


def _tail(forms: list[str]) -> str:
    """The second half of a broken word, of its forms without and with a hyphen."""
    joined, hyphened = forms
    cut = next((i for i, (a, b) in enumerate(zip(joined, hyphened)) if a != b), len(joined))
    return hyphened[cut + 1 :]


def parse_sections(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """What a section's lines tell by themselves: ``id, kind, line, word, words``.

    Kinds: ``header`` and ``page_number``; ``broken`` words whose form is plain;
    ``line`` with all words of a line that has one to be decoded; ``size`` with the
    number of words in ``line``.
    """
    sent = texts.sparkSession.sparkContext.broadcast((lexicon.head, lexicon.rivals))
    names = ["id", "kind", "line", "word", "words"]
    id_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[texts.schema["id"].dataType.simpleString()]
    schema = T.StructType([texts.schema["id"], *T.StructType.fromDDL("kind string, line int, word string, words array<struct<forms: array<string>, broken: string, tail: string, suspect: boolean>>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(*sent.value)
        for batch in batches:
            out = []
            for i, body, headers, low, high in zip(*(batch.column(c).to_pylist() for c in ("id", "body_l3", "headers", "low", "high"))):
                lines = classify(body, _headers(tuple(headers)), range(low, high + 1) if low is not None and high is not None else None)
                out += [(i, line.kind, at, "", None) for at, line in enumerate(lines) if line.kind in ("header", "page_number")]
                size = sum(line.text.count(" ") + 1 for line in lines if line.kind in ("text", "item"))
                for words in words_of(lines, known.passes):
                    entries, odd = [], False
                    for w in words:
                        forms = _forms(w)
                        best = _broken_form(forms, known.head)
                        suspect = not known[best]
                        odd |= suspect
                        if w.forms and not suspect:
                            out.append((i, "broken", w.line, best, None))
                        tail = _tail(forms) if suspect and w.sign == "-" else None
                        entries.append({"forms": forms if suspect else [best], "broken": w.sign or None, "tail": tail, "suspect": suspect})
                    if odd:
                        out.append((i, "line", words[0].line, "", entries))
                out.append((i, "size", size, "", None))
            kinds = [id_kind, pa.string(), pa.int32(), pa.string(), pa.list_(_WORD_TYPE)]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return texts.select("id", "body_l3", "headers", "low", "high").mapInArrow(run, schema)


def _options(lines: DataFrame, unigrams: DataFrame) -> DataFrame:
    """``form, times, candidate, confused, n``: for every form of a suspicious word, the words of the corpus it may have been.

    They are those of the same skeleton that confusions lead to it from. ``times`` is
    how often the form stands unbroken. The second half of a broken word is looked up too.
    """
    words = lines.select(F.explode("words").alias("w")).where("w.suspect")
    asked = F.array_compact(F.concat("w.forms", F.array("w.tail")))
    forms = words.select(F.explode(asked).alias("form"), F.when(F.col("w.broken").isNull(), 1).otherwise(0).alias("one")).groupBy("form").agg(F.sum("one").alias("times"))
    keyed = forms.withColumn("skeleton", _skeleton_of(F.col("form")))
    lettered = unigrams.where(F.col("a").rlike(r"\p{L}")).select(F.col("a").alias("candidate"), "n", _skeleton_of(F.col("a")).alias("skeleton"))
    alike = keyed.join(lettered, "skeleton").select("form", "times", "candidate", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            how = [confused(c, f) for c, f in zip(batch.column("candidate").to_pylist(), batch.column("form").to_pylist())]
            kept = pa.array([k is not None for k in how])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(how, pa.list_(pa.int32()))], names=[*batch.schema.names, "confused"]).filter(kept)

    return alike.mapInArrow(run, "form string, times long, candidate string, n long, confused array<int>")


def _rates(options: DataFrame, words: int) -> list[float]:
    """How often each confusion happens, from the likeliest reading of each suspicious unbroken word."""
    weight = F.log("n") + F.size("confused") * math.log(PRIOR)
    best = options.where("times > 0").groupBy("form", "times").agg(F.max_by("confused", F.struct(weight.alias("w"), "candidate")).alias("confused"))
    uses = {r["k"]: r["n"] for r in best.select(F.explode("confused").alias("k"), "times").groupBy("k").agg(F.sum("times").alias("n")).collect()}
    return [(uses.get(k, 0) + 1) / (words + len(CONFUSIONS)) for k in range(len(CONFUSIONS))]


def _choices(words: list[dict], found: list[dict] | None, cost: list[float]) -> list[dict[str, tuple[float, int, bool]]]:
    """For each word its readings: word -> (log probability of its characters, count, misread).

    A word that turns out safe, by the same rule as those of the lexicon, has one.
    """
    out: list[dict[str, tuple[float, int, bool]]] = [{f: (0.0, 0, False) for f in w["forms"][:1]} for w in words]
    by_place: dict[int, list[dict]] = {}
    for place in found or ():
        if place["form"] in words[place["at"]]["forms"]:
            by_place.setdefault(place["at"], []).append(place)
    for at, places in by_place.items():
        counts = {p["form"]: o["n"] for p in places for o in p["options"] if not o["confused"]}
        best = _broken_form(words[at]["forms"], counts)
        rivals = [(o["n"], len(o["confused"])) for p in places if p["form"] == best for o in p["options"] if o["confused"]]
        if counts.get(best, 0) >= SEEN and not outweighed(counts[best], rivals):
            out[at] = {best: (0.0, counts[best], False)}
            continue
        own = out[at]
        for o in (o for p in places for o in p["options"]):
            reading = (-sum(cost[k] for k in o["confused"]), o["n"], bool(o["confused"]))
            if o["candidate"] not in own or own[o["candidate"]][:2] < reading[:2]:
                own[o["candidate"]] = reading
    return out


def decode_lines(parsed: DataFrame, grams: DataFrame, lexicon: Lexicon, total: int) -> DataFrame:
    """``id, line, at, word, broken, changed`` for each suspicious word, decoded in its line.

    ``changed`` tells a misread word. Words that the corpus gives no reading for stay
    as they are; if broken, they are joined, unless the hyphen stands for an omitted
    half, as in pre- and post-: then the corpus often has what follows, but not the
    two together. Pairs with a word that was hardly ever seen tell nothing: a mirrored
    section would vouch for its own misread words.
    """
    lines = parsed.where("kind = 'line'").select("id", "line", "words")
    sizes = parsed.where("kind = 'size'").agg(F.sum("line")).collect()[0][0] or 0
    options = materialise(_options(lines, grams.where("b IS NULL")), "options")
    rates = _rates(options, sizes)
    by_form = options.groupBy("form").agg(F.collect_list(F.struct("candidate", "confused", "n")).alias("options"))
    places = lines.select("id", "line", F.posexplode("words").alias("at", "w")).where("w.suspect")
    places = places.select("id", "line", "at", F.explode(F.array_distinct(F.array_compact(F.concat("w.forms", F.array("w.tail"))))).alias("form"))
    found = places.join(by_form, "form").groupBy("id", "line").agg(F.collect_list(F.struct("at", "form", "options")).alias("found"))
    full = materialise(lines.join(found, ["id", "line"], "left"), "lines")
    sent = parsed.sparkSession.sparkContext.broadcast((lexicon.head, rates))
    key = parsed.schema["id"]

    def pairs_needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = [-math.log(r) for r in sent.value[1]]
        for batch in batches:
            rows = set()
            for i, line, words, found in zip(*(batch.column(c).to_pylist() for c in ("id", "line", "words", "found"))):
                own = _choices(words, found, cost)
                for left, right in zip(own, own[1:]):
                    if len(left) > 1 or len(right) > 1:
                        rows |= {(i, line, a, b) for a in left for b in right}
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column("id").type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:])], names=["id", "line", "a", "b"])

    needed = full.mapInArrow(pairs_needed, T.StructType([key, *T.StructType.fromDDL("line int, a string, b string")]))
    counted = needed.join(grams.where("b IS NOT NULL"), ["a", "b"]).groupBy("id", "line").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rates = sent.value
        cost = [-math.log(r) for r in rates]
        for batch in batches:
            out = []
            for i, line, words, found, pairs in zip(*(batch.column(c).to_pylist() for c in ("id", "line", "words", "found", "pairs"))):
                own = _choices(words, found, cost)
                unigram = {w: n or head.get(w, 0) for c in own for w, (_, n, _) in c.items()}
                tails = {p["at"]: o["n"] for p in found or () if p["form"] == words[p["at"]]["tail"] for o in p["options"] if not o["confused"]}
                seen = {(p["a"], p["b"]): p["n"] for p in pairs or () if min(unigram.get(p["a"], 0), unigram.get(p["b"], 0)) >= SEEN}
                path = viterbi([[(w, p) for w, (p, _, _) in c.items()] for c in own], unigram, seen, total)
                for at, (w, chosen) in enumerate(zip(words, path)):
                    if not w["suspect"]:
                        continue
                    _, n, changed = own[at][chosen]
                    if w["broken"] == "-" and not n and tails.get(at, 0) >= 10 * SEEN:
                        continue
                    out.append((i, line, at, chosen, bool(w["broken"]), changed))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [batch.column("id").type, pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "line", "at", "word", "broken", "changed"])

    return full.join(counted, ["id", "line"], "left").mapInArrow(run, T.StructType([key, *T.StructType.fromDDL("line int, at int, word string, broken boolean, changed boolean")]))


def _head(unigrams: DataFrame, most: int) -> dict[str, int]:
    """The most frequent words with their counts, at most ``most``; of equally frequent ones all or none."""
    rows = unigrams.orderBy(F.desc("n"), "a").limit(most + 1).select("a", "n").collect()
    rarest = rows[-1]["n"] if len(rows) > most else 0
    return {r["a"]: r["n"] for r in rows if r["n"] > rarest}


def _stages(sections: DataFrame, fts: DataFrame, pages: DataFrame, furniture: DataFrame, spans: DataFrame, head: int):
    info = materialise(scanned_sections(sections, pages, furniture, spans), "scanned")
    clean = ["title", "summary", "body_l2"]
    repeated = fts.groupBy("id").agg(F.count("*").alias("times")).where("times > 1")
    flags = info.select("id").distinct().withColumn("scanned", F.lit(True)).join(repeated, "id", "full_outer")
    texts = fts.select("id", "body_l3", *clean).join(flags, "id", "left")
    grams = materialise(corpus_grams(texts, "scanned", "body_l3", clean), "grams")
    unigrams = grams.where("b IS NULL")
    total = unigrams.agg(F.sum("n")).collect()[0][0] or 1
    lexicon = Lexicon(_head(unigrams, head))
    bodies = fts.where("body_l3 <> ''").select("id", "body_l3").join(info, "id").dropDuplicates(["id"])
    parsed = materialise(parse_sections(bodies, lexicon), "parsed")
    return bodies, parsed, decode_lines(parsed, grams, lexicon, total), lexicon


def scan_noise(sections: DataFrame, fts: DataFrame, pages: DataFrame, furniture: DataFrame, spans: DataFrame, head: int = HEAD) -> DataFrame:
    """``id, kind, word``: the broken and misread words, running lines and page numbers of scanned sections.

    Only sections of documents with a row in ``pages`` are looked at. Null and empty
    texts have no noise. Repeated rows count once; of different texts under one id
    one is taken. Other columns are ignored.
    """
    _, parsed, decoded, _ = _stages(sections, fts, pages, furniture, spans, head)
    plainly = parsed.where(F.col("kind").isin("header", "page_number", "broken")).select("id", "kind", "word")
    broken = decoded.where("broken").select("id", F.lit("broken").alias("kind"), "word")
    misread = decoded.where("changed").select("id", F.lit("misread").alias("kind"), "word")
    return plainly.unionByName(broken).unionByName(misread).distinct()


def _cased(word: str, like: str) -> str:
    """A word in the letter case of another, part by part where hyphens divide both alike."""
    parts, models = word.split("-"), like.split("-")
    if len(parts) == len(models) > 1:
        return "-".join(map(_cased, parts, models))
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def rewrite(body: str, headers: Headers, numbers: range | None, fixes: dict[tuple[int, int], str], head: dict[str, int]) -> str:
    """A section as continuous paragraphs: without noise lines, with whole and right words.

    Headings, tables, code and list items stay lines of their own.
    """
    lines = classify(body, headers, numbers)
    shown = {i: line.text for i, line in enumerate(lines)}
    glued: set[int] = set()
    for words in reversed(words_of(lines)):
        for at in range(len(words) - 1, -1, -1):
            w = words[at]
            fix = fixes.get((words[0].line, at))
            if w.forms:
                forms = _forms(w)
                fix = fix or (_broken_form(forms, head) if any(f in head for f in forms) else None)
                if fix is None:
                    continue
                shown[w.line] = shown[w.line][: w.start] + _cased(fix, w.text)
                rest = shown[w.line2][w.end2 :]
                mark = re.match(r"[^\w\s]*", rest)[0]
                shown[w.line] += mark
                shown[w.line2] = rest[len(mark) :].lstrip()
                glued.add(w.line2)
            elif fix is not None and fix != plain(w.text):
                shown[w.line] = shown[w.line][: w.start] + _cased(fix, w.text) + shown[w.line][w.end :]
    out: list[str] = []
    paragraph: list[str] = []
    noise = False

    def close() -> None:
        if paragraph:
            out.append(" ".join(paragraph))
            paragraph.clear()

    for i, line in enumerate(lines):
        if line.kind in ("header", "page_number"):
            noise = True
        elif line.kind == "blank":
            following = next((x for x in lines[i + 1 :] if x.kind != "blank"), None)
            if noise or (following and following.kind in ("header", "page_number")):
                ends = not paragraph or paragraph[-1].rstrip()[-1:] in ".!?:;"
                after = next((x for x in lines[i + 1 :] if x.kind not in ("blank", "header", "page_number")), None)
                if not ends and after and after.kind == "text":
                    continue
            close()
            if out and out[-1] != "":
                out.append("")
        elif line.kind == "text":
            noise = False
            if shown[i].strip():
                paragraph.append(shown[i].strip())
        else:
            noise = False
            close()
            if line.kind == "item":
                paragraph.append(shown[i].rstrip())
            else:
                out.append(shown[i])
    close()
    return "\n".join(out).strip("\n")


def repair_scans(sections: DataFrame, fts: DataFrame, pages: DataFrame, furniture: DataFrame, spans: DataFrame, head: int = HEAD) -> DataFrame:
    """``id, body_l3`` of all rows, repaired where a section was scanned and as it is everywhere else."""
    bodies, _, decoded, lexicon = _stages(sections, fts, pages, furniture, spans, head)
    fixes = decoded.groupBy("id").agg(F.collect_list(F.struct("line", "at", "word")).alias("fixes"))
    sent = fts.sparkSession.sparkContext.broadcast(lexicon.head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, headers, low, high, fixes in zip(*(batch.column(c).to_pylist() for c in ("body_l3", "headers", "low", "high", "fixes"))):
                numbers = range(low, high + 1) if low is not None and high is not None else None
                out.append(rewrite(body, _headers(tuple(headers)), numbers, {(f["line"], f["at"]): f["word"] for f in fixes or ()}, sent.value))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "body_l3"])

    repaired = bodies.join(fixes, "id", "left").mapInArrow(run, T.StructType([fts.schema["id"], T.StructField("body_l3", T.StringType())]))
    others = fts.select("id", "body_l3").join(bodies.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return repaired.unionByName(others)
