"""Keyword-stuffed pages, link lists and product or tag lists, by the shapes of their lines.

Each line is reduced to a shape: how many words it has, how its words are capitalised,
what separates them, whether it carries links, and whether it ends as a sentence does.
A page is flagged if shapes that no prose has make up more than half of its text; the strongest few are reported.
A text is judged whole, alone and in one pass, so the work follows the text's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm import shingles

#: Part of the text that non-prose shapes must exceed, and how many of them are named (all count).
DOMINANT, NAMED = 0.5, 5
#: Part of a unit's words inside phrases that the page repeats, from which the unit is stuffed.
STUFFED = 0.4
#: A phrase is repeated if it occurs so often, and its words make up this part of the page.
REPEATS, REPEAT_SHARE, SINGLE_SHARE = 4, 0.04, 0.08
#: Where function words make up this part, passages of so many words that are said again count once: running text repeats them whole.
RUNNING, PASSAGE = 0.2, 8
#: Running text that stands so often is stuffed; fewer times, prose is said again.
VERBATIM = 10
#: So many headings in a row, most of them repeating words, are a list.
HEADINGS = 4

# Common function words of English, German, French and Spanish. Running text holds many, keyword lists few.
FUNCTION_WORDS = frozenset(
    """a an the of to in on at by with and or but so if when while what who how that this these those it its is are was were be been
    not no nor from as than then there here you your we our they their he she his her i my do does did because each every most some
    der die das den dem ein eine einen und oder nicht ist sind im mit von zu auf wenn man jede jeder danach
    le la les un une des du et ou ne pas est dans que qui sur pour sans quand personne
    el los las una unos y o no en con por para se su cuando si todo sin que""".split()
)

LINK = re.compile(r"<a\s[^>]*>|</a>|<br\s*/?>|https?://[^\s)\]>\"']+|\bwww\.[^\s)\]>\"']+", re.I)
HREF = re.compile(r"<a\s|https?://|\bwww\.", re.I)
BULLET = re.compile(r"^\s*(?:[-*\u2022]|\d{1,3}[.)])\s+")
SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
ENDS = re.compile(r"[.!?:][\"')\]*]*$")
SENTENCE_END = frozenset(".!?")
WORD = re.compile(r"[^\W_]+(?:['\u2019-][^\W_]+)*")
CODE = re.compile(r"[(\[{][^)\]}]*$|\w\(|[={}\[\]<>]|\w_\w|^```|^#+ |^ {4}")
TAG = re.compile(r"(?:^|\s)#\w")
SEPARATORS = (("|", re.compile(r"\s*\|\s*")), ("\u00b7", re.compile(r"\s*[\u00b7\u2022]\s*")), (";", re.compile(r"\s*;\s*")), (",", re.compile(r"\s*,\s*")))


#: All repeated phrases of a page, those that it repeats other than by saying passages again, and its units that are stuffed as they're repeated whole.
Phrases = tuple[frozenset, frozenset, frozenset]


def _again(words: list[str], phrases: set) -> list[str]:
    """The words, with blanks for passages that stood before. A passage that itself repeats one of the phrases stays: it is dense with it."""
    seen: set[tuple[str, ...]] = set()
    kept = list(words)
    for i in range(len(words) - PASSAGE + 1):
        passage = tuple(words[i : i + PASSAGE])
        if "" in passage:
            continue
        if passage not in seen:
            seen.add(passage)
            continue
        own = [p for p in zip(passage, passage[1:]) if p in phrases]
        if len(set(own)) == len(own):
            kept[i : i + PASSAGE] = [""] * PASSAGE
    return kept


def _strong(words: list[str], often: set[str], n: int) -> set[tuple[str, str]]:
    pairs = Counter(p for p in zip(words, words[1:]) if p[0] in often and p[1] in often)
    return {p for p, c in pairs.items() if c >= REPEATS and 2 * c >= REPEAT_SHARE * n}


def _verbatim(units: Counter[str]) -> frozenset:
    """Units that the page repeats so often that they're much of it. Keywords need fewer repeats than running text, if each of their words is much of the page."""
    if max(units.values(), default=0) < REPEATS:
        return frozenset()
    words = {u: shingles.words(u) for u in units}
    n = sum(len(words[u]) * c for u, c in units.items())
    found = set()
    for u, c in units.items():
        if c >= REPEATS and len(words[u]) >= 4:
            keywords = sum(w in FUNCTION_WORDS for w in words[u]) < RUNNING * len(words[u])
            if c >= VERBATIM and c * len(words[u]) >= REPEAT_SHARE * n or keywords and c >= SINGLE_SHARE * n:
                found.add(u)
    return frozenset(found)


def _repeated(units: Counter[str]) -> Phrases:
    """Phrases that the page's different units repeat: neighbouring words, or a word that is
    much of the page; function words aside. A sentence that is repeated whole counts once here; see ``_verbatim``."""
    verbatim = _verbatim(units)
    words: list[str] = []
    for u in units:
        words += shingles.words(u)
        words.append("")
    n = len(words) - len(units)
    often = {w for w, c in Counter(words).items() if c >= REPEATS and w and w not in FUNCTION_WORDS}
    if not often:
        return frozenset(), frozenset(), verbatim
    found = _strong(words, often, n)
    once = _again(words, found) if found else words
    singles = Counter(w for w in words if w in often)
    single = {w for w, c in singles.items() if c >= REPEATS and c >= SINGLE_SHARE * n}
    return frozenset(found | single), frozenset((_strong(once, often, sum(map(bool, once))) if found else found) | single), verbatim


def _cover(words: list[str], phrases: frozenset) -> float:
    covered = [w in phrases for w in words] + [False]
    single = sum(covered)
    for i, p in enumerate(zip(words, words[1:])):
        if p in phrases:
            covered[i] = covered[i + 1] = True
    # a phrase of one word leaves room for as many others around it
    return max(sum(covered), 1.5 * single) / max(1, len(words))


def _case(raw: list[str]) -> str:
    letters = [w for w in raw if w[0].isalpha()]
    if not letters:
        return "digits"
    if all(w.isupper() for w in letters):
        return "upper"
    return "title" if sum(w[0].isupper() for w in letters) >= 0.6 * len(letters) else "lower"


def _size(n: int) -> str:
    return "0" if not n else "1-3" if n < 4 else "4-9" if n < 10 else "10-39" if n < 40 else "40+"


def unit_shape(unit: str, linked: bool, phrases: Phrases) -> tuple[str, ...] | None:
    """The shape of a unit if no prose has it; () for a heading; None for prose, code and tables."""
    body = unit.strip()
    if not linked and not phrases[0] and not phrases[2] and body[-1:] in SENTENCE_END and max(map(unit.count, "|\u00b7;,")) < 3:
        return None
    raw = WORD.findall(unit)
    n, case = len(raw), _case(raw)
    if linked and n < 6:
        return ("link", case, "", _size(n))
    tags = len(TAG.findall(unit))
    if tags >= 3 and tags * 2 >= len(unit.split()):
        return ("tags", case, "#", _size(n))
    low = [w.lower() for w in raw]
    function = sum(w in FUNCTION_WORDS for w in low) / max(1, n)
    cover = _cover(low, phrases[function >= RUNNING]) if n >= 4 else 0.0
    if not body.startswith("|"):
        for sign, split in SEPARATORS:
            if unit.count(sign) >= 3:
                pieces = [p for p in split.split(unit) if p]
                short = n <= 4.5 * len(pieces)
                if short and (sign in "|\u00b7" or not ENDS.search(body) or cover >= STUFFED):
                    return ("list", case, sign, _size(n))
    if linked and not ENDS.search(body):
        return ("link", case, "text", _size(n))
    if n >= 4 and cover >= STUFFED and not body.startswith("|"):
        return ("stuffed", case, "." if ENDS.search(body) else "", _size(n))
    if CODE.search(unit) or body.startswith("|"):
        return None
    if unit in phrases[2] and (ENDS.search(body) or n > 7):
        return ("repeated", case, "." if ENDS.search(body) else "", _size(n))
    if ENDS.search(body):
        return None
    if n >= 8 and function < 0.12 and (case == "title" or len(set(low)) < 0.6 * n):
        return ("run", case, "", _size(n))
    return () if n <= 7 else None


def spam_share(text: str | None) -> tuple[float, list[tuple[str, ...]]]:
    """The part of a text (of its characters other than white space) in non-prose shapes of any kind, and the strongest of those.

    Null and blank texts have (0, [])."""
    if not text or text.isspace():
        return 0.0, []
    lines: list[tuple[int, bool, str, list[str]]] = []
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        linked = "://" in line or HREF.search(line) is not None
        plain = BULLET.sub("", LINK.sub(" ", line) if linked else line, count=1)
        units = [u for u in SENTENCE.split(plain) if u and not u.isspace()] if len(plain) > 40 else [plain]
        lines.append((len(line) - line.count(" "), linked, plain, units))
    phrases = _repeated(Counter(u for x in lines for u in x[3]))
    known: dict[str, tuple[str, ...] | None] = {}

    def shape_of(unit: str) -> tuple[str, ...] | None:
        if unit not in known:
            known[unit] = unit_shape(unit, False, phrases)
        return known[unit]

    mass: Counter[tuple[str, ...]] = Counter()
    total, held, heads = 0, 0.0, []
    last: tuple[str, ...] | None = None

    def headings(then: tuple[str, ...] | None) -> None:
        """Headings are a list of their own if they are many and repeat each other; else they go with what follows."""
        nonlocal held, heads
        if len(heads) >= HEADINGS:
            low = [w for h in heads for w in shingles.words(h)]
            if _cover(low, phrases[0]) >= STUFFED or len(set(low)) < 0.4 * len(low):
                then = ("list", _case(low), "newline", "")
        if then and held:
            mass[then] += held
        held, heads = 0.0, []

    for weight, linked, plain, units in lines:
        total += weight
        if linked:  # a link with sentences beside it is explained
            prose = sum(len(WORD.findall(u)) for u in units if ENDS.search(u.strip()) and shape_of(u) is None)
            if prose < 6:
                last = unit_shape(plain, True, phrases) or ("link", "", "text", "")
                headings(last)
                mass[last] += weight
                continue
        size = sum(map(len, units)) or 1
        for u in units:
            shape, part = shape_of(u), weight * len(u) / size
            if shape == ():
                held += part
                heads.append(u)
                continue
            headings(shape)
            last = shape
            if shape:
                mass[shape] += part
    headings(last)  # at the end they go with what stands above them
    return sum(mass.values()) / max(1, total), [s for s, _ in mass.most_common(NAMED)]


def shares(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, share (part of the text in non-prose shapes) and shapes (the strongest ``NAMED``), for every row.

    Null, empty and blank texts have share 0 and no shapes; repeated rows stay; other columns aren't read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spam_share(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch(
                [b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([[" ".join(filter(None, x)) for x in k] for _, k in found], pa.list_(pa.string()))],
                ["key", "share", "shapes"],
            )

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, share double, shapes array<string>")


def flagged(df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of rows whose text is mostly keywords, links, tags or products."""
    found = shares(df, key, text)
    return found.where(found.share > DOMINANT).select("key").distinct()
