"""HTML extraction: maximum-scoring subsequence of words and tags.

A page is read once as a sequence of tags and text blocks.  A linear scan finds
the contiguous region with the largest sum of scores, and the blocks in it that
score above zero are the text.

Weights are log likelihood ratios of content against boilerplate, fitted on at
most ``LABELLED_PAGES`` pages that mark their own article.  Each place around a
block has features: its element, its classes, whether its name or role sounds
like boilerplate, and whether it is inside the page's mark or outside of it.
Words inside the mark speak for all their places; words outside speak against
theirs, and words in a menu, advert, form or the like against that place alone,
so that what it holds (lists, plain divisions) keeps its standing.  The fixed
lists of such places are prior counts, not vetoes.  A word scores by the worst
of its places, or if none is bad by the best; a place that no labelled page
showed is neutral, so pages of other layouts still give their running text.
Tags cost by their own weights.

A class or form that sounds like boilerplate is not believed where it holds the
page: where it has more than ``HOLDS`` times the words outside such places, or
a single article or main with more words than those.

Nulls and edge cases: null or empty html gives an empty text; quotes open a
value only behind an equals sign; a line break is white space; unclosed elements last until their parent
ends; broken references stay as they are; ties go to the earlier, longer region;
pages of any length and depth are read whole in time that grows with their
length; repeated rows are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows

#: Bound of the fitted sample.
LABELLED_PAGES = 500

# The elements of the HTML language by their part in a page.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym area audio b bdi bdo big canvas cite code data del dfn em embed font i img input ins kbd label map mark math meter object output "
    "picture progress q rb rp rt ruby s samp slot small source span strike strong sub sup time track tt u var video wbr".split()
)
BOILERPLATE = frozenset("head nav footer aside form button menu dialog".split())
MARKED = frozenset(("article", "main"))
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|alert|popup|modal|"
    r"nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|related|recommend\w*|share\w*|sharing|social\w*|"
    r"header|masthead|footer\w*|copyright|comment\w*|disqus|reply|replies|respond|subscribe\w*|newsletter\w*|signup|login|search|toolbar|pagination|pager)(?:$|[-_ ])",
    re.I,
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: A suspicious class is content where it has so many times the words of all places that are not suspicious.
HOLDS = 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=(?:\s*+(?:\"[^\"]*\"|'[^']*'))?)*+)(?:>|$)",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")
#: Classes that tell of an element's state, not its kind ("has-sidebar").
_STATE = re.compile(r"(?:with|without|has|no|is|not|show|hide)[-_]", re.I)
#: Prior counts of words against the places of the fixed lists, and for and against any feature.
PRIOR, SMOOTH = 1000.0, 50.0
#: Weights are cut off here; a place below ``BAD`` is boilerplate whatever is around it.
MOST, BAD = 4.0, -0.7
#: What a word in neutral places and a tag without a weight score.
NEUTRAL, NEUTRAL_TAG = 0.5, -0.05
#: A word costs no more than this in the scan.
LEAST = -0.5
#: An open one of these ends where another of its group starts.
_ENDED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th tr", "th": "td th tr", "option": "option"}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


LISTED, INSIDE, OUTSIDE = "~listed", "~inside", "~outside"


class Place:
    """Where an open element stands: its own features, and what the places around it say."""

    __slots__ = ("parent", "features", "listed", "marked", "group", "groups", "article", "worst", "best")

    def __init__(self, parent: Place | None, features: tuple[str, ...] = (), listed=False, marks=False, group=(), article: int | None = None):
        self.parent, self.features = parent, features
        self.listed = listed or parent is not None and parent.listed
        self.marked = marks or parent is not None and parent.marked
        self.group = group
        self.groups: tuple[str | None, ...] = parent.groups if parent else ()
        if group and group[0] not in self.groups:
            self.groups += group
        self.article = article if parent is None or parent.article is None else parent.article
        self.worst: float | None = None
        self.best = 0.0


@dataclass(slots=True)
class Event:
    """A tag (``text`` is None, ``name`` its feature) or a text block, and its place."""

    place: Place
    name: str = ""
    text: str | None = None


@dataclass
class Weights:
    """Log likelihood ratios by feature; what is not in them is neutral."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def _settle(self, place: Place) -> None:
        """Worst and best weight of a place and those around it; places are settled outermost first, once."""
        todo = []
        while place is not None and place.worst is None:
            todo.append(place)
            place = place.parent
        for p in reversed(todo):
            own = [self.words.get(f, 0.0) for f in p.features]
            up = p.parent
            p.worst = min([*own, up.worst if up else 0.0])
            p.best = max([*own, up.best if up else 0.0])

    def word(self, place: Place, outside: bool) -> float:
        """Of one word: below zero in a bad place, else between 0 and 1.  ``outside``: of the page's mark."""
        self._settle(place)
        context = self.words.get(OUTSIDE if outside else INSIDE if place.marked else "", 0.0)
        worst, best = min(place.worst, context), max(place.best, context)
        return worst if worst < BAD else min(1.0, NEUTRAL + best)

    def tag(self, event: Event) -> float:
        inside = "@inside" if event.place.marked else ""
        return max(-1.0, min(-0.01, self.tags.get(event.name + inside, NEUTRAL_TAG)))


def events(page: str) -> list[Event]:
    out, held = _scan(page, set())
    if more := _content(held):
        out, _ = _scan(page, more)
    return out


#: Words by the suspicious places around them, outermost first (None: certain boilerplate), and by the outermost article in those.
Held = Counter[tuple[tuple[str | None, ...], int | None]]


def _content(held: Held) -> set[str]:
    """The suspicious classes that hold the page."""
    chains, marks, lifted = Counter(), Counter(), set()
    for (chain, mark), n in held.items():
        chains[chain] += n
        if mark is not None:
            marks[chain, mark] += n
    while True:
        free = sum(n for chain, n in chains.items() if lifted.issuperset(chain))
        words, most = Counter(), Counter()
        for chain, n in chains.items():
            for g in set(chain) - lifted if None not in chain else ():
                words[g] += n
        for (chain, _), n in marks.items():
            for g in set(chain) - lifted if None not in chain else ():
                most[g] = max(most[g], n)
        found = [g for g in words if words[g] > HOLDS * free or most[g] > free]
        if not found:
            return lifted
        lifted.add(max(found, key=words.__getitem__))


def _scan(page: str, lifted: set[str]) -> tuple[list[Event], Held]:
    """The events of a page where the classes ``lifted`` are not suspicious."""
    out: list[Event] = []
    held: Held = Counter()
    stack: list[tuple[str, Place]] = [("", Place(None))]  # block elements, and inline ones that are listed
    opened: Counter[str] = Counter()
    inline: dict[str, list[Place | None]] = {}  # open inline elements by name: the place of a listed one, else None
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                place, n = stack[-1][1], text.count(" ") + 1
                out.append(Event(place, "", text))
                held[place.groups, place.article] += n

    def pop() -> str:
        name, _ = stack.pop()
        opened[name] -= 1
        return name

    def end_inline(name: str) -> None:
        place = inline[name].pop() if inline.get(name) else None
        k = len(stack) - 1
        while place is not None and stack[k][0] in INLINE:
            if stack[k][1] is place:
                flush()
                above = stack[k + 1 :]
                del stack[k:]
                for other, p in above:  # crossed elements go on without it
                    stack.append((other, Place(stack[-1][1], p.features, True, False, p.group)))
                return
            k -= 1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        buffer.append(page[at : m.start()])
        at = m.end()
        if not (name := m[2]):
            continue
        name = name.lower()
        if name == "br":  # white space inside a block
            buffer.append(" ")
            continue
        if name in RAW and not m[1]:
            if name == "svg" and m[3].rstrip().endswith("/"):  # foreign elements may end themselves
                continue
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        if m[1]:
            if name in INLINE:
                end_inline(name)
                continue
            flush()
            if opened[name] > 0:
                place = stack[-1][1]
                while pop() != name:
                    pass
                out.append(Event(place, f"/{name}"))
            continue
        given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
        names = f"{given.get('class', '')} {given.get('id', '')}".strip()
        names = " ".join(x for x in names.split() if not _STATE.match(x))
        if name not in INLINE:
            flush()
            ends = {o for o, by in _ENDED_BY.items() if name in by.split()} | ({"p"} if name in _ENDS_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE:
                    break
        around = stack[-1][1]
        role = given.get("role", "").lower()
        named = bool(names and BOILERPLATE_NAMES.search(names))
        certain = (
            (name in BOILERPLATE and name != "form")
            or (name == "header" and not around.marked)
            or (role in BOILERPLATE_ROLES and role != "form")
            or "hidden" in given
        )
        group = f"{name} {names}" if name == "form" or role == "form" or (named and name not in ("html", "body", *MARKED)) else None
        suspicious = (None,) if certain else () if group is None or group in lifted else (group,)
        open_ended = name not in VOID and not m[3].rstrip().endswith("/")
        if name in INLINE and not suspicious:
            if open_ended:
                inline.setdefault(name, []).append(None)
            continue
        # An article inside a listed part (a teaser, a comment) is not the page's.
        marks = name in MARKED and not suspicious and not around.listed
        features = (name, *(f"{name}.{x.lower()}" for x in names.split()), *((LISTED,) if suspicious else ()))
        if suspicious and name not in BOILERPLATE:
            features = features[1:]  # a plain division is not bad for the name that one of them has
        place = Place(around, features, bool(suspicious), marks, suspicious, m.start() if name in MARKED and not named else None)
        if name in INLINE:
            flush()
            if open_ended:
                stack.append((name, place))
                inline.setdefault(name, []).append(place)
            continue
        out.append(Event(place, name))
        if open_ended:
            stack.append((name, place))
            opened[name] += 1
    flush()
    return out, held


def fit(pages: list[str]) -> Weights:
    """Log likelihood ratios of content against boilerplate, by feature."""
    words, tags, total = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for page in pages:
        whole: dict[int, tuple[Place, list[int]]] = {}  # words of content and of boilerplate in each place
        own = events(page)
        for e in own:
            if e.text is None:
                if not e.place.listed:
                    tags[e.place.marked][e.name + "@inside" * e.place.marked] += 1
                continue
            n = e.text.count(" ") + 1
            good = e.place.marked and not e.place.listed
            total[good] += n
            if not e.place.listed:
                words[good][INSIDE if e.place.marked else OUTSIDE] += n
            p = e.place
            if e.place.listed:  # the outermost listed place alone is to blame
                while p.parent is not None and p.parent.listed:
                    p = p.parent
                words[False].update(dict.fromkeys(p.features, n))
            else:
                whole.setdefault(id(p), (p, [0, 0]))[1][good] += n
        for p, counts in whole.values():
            seen: tuple[set[str], set[str]] = (set(), set())
            while p is not None:
                seen[1].update(p.features)
                seen[0].update(p.features[1:] or p.features)  # classes, where there are any, and not the element
                p = p.parent
            for good in (0, 1):
                words[good].update(dict.fromkeys(seen[good], counts[good]))
    prior = {LISTED: PRIOR, OUTSIDE: PRIOR, **dict.fromkeys(BOILERPLATE - {"form"}, PRIOR)}

    def ratios(counts: tuple[Counter, Counter], total: list[float], smooth: float, against: dict[str, float]) -> dict[str, float]:
        def share(f: str, k: int) -> float:
            return (counts[k][f] + smooth * total[k] / sum(total) + (0.0 if k else against.get(f, 0.0))) / total[k]

        return {f: max(-MOST, min(MOST, math.log(share(f, 1) / share(f, 0)))) for f in counts[0].keys() | counts[1].keys() | against.keys()}

    return Weights(
        ratios(words, [n + PRIOR for n in total], SMOOTH, prior), ratios(tags, [sum(c.values()) + SMOOTH for c in tags], SMOOTH / 10, {})
    )


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the largest sum; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, at = total, (start, k + 1)
    return at


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    own = events(page)
    has_mark = any(e.place.marked for e in own)
    of_word = [0.0 if e.text is None else weights.word(e.place, has_mark and not e.place.marked) for e in own]
    # Boilerplate in the middle of a text ends it only where it outweighs what follows, and inside a mark never.
    scores = [
        weights.tag(e) if e.text is None else -0.01 if w < 0 and e.place.marked else max(w, LEAST) * (e.text.count(" ") + 1)
        for e, w in zip(own, of_word)
    ]
    first, last = best_region(scores)
    return "\n".join(e.text for e, w in zip(own[first:last], of_word[first:last]) if w > 0)


def labelled(pages: DataFrame, html_col: str = "html") -> list[str]:
    """At most ``LABELLED_PAGES`` pages that mark their article, the same ones on every run: those whose hashes are lowest."""
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]")).select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("page"))
    # Hashes first: tasks send the driver no pages but the chosen ones.
    last = marked.select("h").distinct().orderBy("h").limit(LABELLED_PAGES).agg(F.max("h")).first()[0]
    if last is None:
        return []
    return [r.page for r in marked.where(F.col("h") <= last).groupBy("h").agg(F.min("page").alias("page")).orderBy("h").collect()]


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; no shuffle."""
    weights = fit(labelled(pages, html_col)) if weights is None else weights

    def row(key, url, page):
        text = main_text(page, weights)
        return [(key, url, text, len(text))]

    return map_rows(pages, [id_col, url_col, html_col], row, "page_id long, url string, text string, n_chars long")
