"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is a sequence in which words score positive and tags negative; one linear
scan finds the contiguous run with the greatest sum.  Scores come from labelled
pages.  The pages also show which elements (by tag name, class, id or role) hold
no article text; such an element enters the sequence as one tag, and its words
are not part of it, wherever it stands.  Words of links have a score of their own in
blocks that are links for the greater part; elsewhere they are words as any other.  Where a single article or main element has
at least half of the words, so does the text beside it, but for h1 and p elements
before it.  Otherwise all text competes.  The text is the words of the best run.

Within the run, character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by one space in page order.

One pass, no shuffle; a task holds a batch of pages.  Scores are a few hundred
numbers, sent with the task.

Defined cases: a null or empty page, or one without words, gives the empty text.
A page without tags is its own text.  Elements whose end tag may be left out (p,
li, dd, dt, table parts, option, head) end where HTML says.  Other unclosed elements
end with what encloses them, at the latest with the page; an unclosed box also ends where an article or
main element begins.  Of runs with equal sums the first, then the longest, wins.
Repeated rows are extracted alike.  Other columns are returned unchanged, and
one with the name of an output column is replaced.
"""

from __future__ import annotations

import functools
import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .html_pages import Page, labelled_pages

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset("a a-text abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split())
_SHELL = frozenset(["html", "body", "article", "main"])
_WORD = re.compile(r"\S+")


class Scores:
    """What the labelled pages teach: ``boxes`` are features of elements without article text, ``tags`` the score of each tag, ``word`` of a word; ``framed``: a page's article or main element holds all article text."""

    def __init__(self, boxes: frozenset, tags: dict[str, float], word: float, link: float, other: float, framed: bool):
        self.boxes, self.tags, self.word, self.link, self.other, self.framed = boxes, tags, word, link, other, framed

    def of(self, tag: str, text: str, link: bool, frame: int) -> float:
        """The score of one token of a page; tags have scores of their own inside article and main elements."""
        if tag:
            return self.tags.get("in " + tag if frame else tag, -0.01 if frame or tag.lstrip("/") in _INLINE else self.other)
        return len(text.split()) * (self.link if link else self.word)


def features(name: str, attrs: str) -> list[str]:
    """Names under which an element is known: its tag; whether it is hidden; its class, id and role values and their parts."""
    out = [name]
    if attrs and name not in _SHELL:
        if _HIDDEN.search(attrs):
            out.append("hidden")
        for kind, a, b, c in _ATTR.findall(attrs):
            value = (a or b or c).lower()
            if kind.lower() == "role":
                out.append("role=" + value.strip())
                continue
            for v in value.split():
                out.append("." + v)
                parts = [p for p in re.split(r"[^a-z0-9]+", v) if p]
                if len(parts) > 1:
                    out += ["~" + p for p in parts]
                else:
                    out.append("~" + v)
    return out


def scan(page: str):
    """(kind, name, features or text, position): kind is 'open', 'close' or 'text'."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:], at
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()], at
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            yield "close", name, None, m.start()
            continue
        yield "open", name, m[3] or "", m.start()
        if name in _RAW:
            end = re.compile("</" + re.escape(name), re.I).search(page, at)
            at = end.start() if end else n


#: Elements whose end tag may be left out: (members, start tags that end the innermost member, elements beyond which none is looked for)
_CELLS = "table td th caption button object template"
_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul"
_IMPLIED = [
    ("p", _BLOCKS, _CELLS),
    ("li", "li", f"{_CELLS} ul ol menu dir dl section article main aside nav header footer form fieldset figure details blockquote"),
    ("dd dt", "dd dt", f"{_CELLS} ul ol menu dir dl section article main aside nav header footer form fieldset figure details blockquote"),
    ("td th", "td th tr thead tbody tfoot", "table template"),
    ("tr", "tr thead tbody tfoot", "table template"),
    ("thead tbody tfoot caption colgroup", "thead tbody tfoot", "table template"),
    ("option", "option optgroup", "select datalist template"),
    ("optgroup", "optgroup", "select template"),
    ("head", "body", "html"),
]
_ENDS: dict[str, list[int]] = {}
_MARKS: dict[str, list[tuple[int, bool]]] = {}
for _i, (_members, _starts, _bounds) in enumerate(_IMPLIED):
    for _n in _starts.split():
        _ENDS.setdefault(_n, []).append(_i)
    for _n in {*_members.split(), *_bounds.split()}:
        _MARKS.setdefault(_n, []).append((_i, _n in _members.split()))


class _Stack:
    """Open elements; closing one closes what it holds."""

    def __init__(self):
        self.names: list[str] = []
        self.open: Counter = Counter()
        self.marks: list[list[tuple[int, bool]]] = [[] for _ in _IMPLIED]  # by rule, open members and bounds: (position, whether a member)

    def end_implied(self, name: str) -> None:
        """Close what a start tag ends without an end tag."""
        for i in _ENDS.get(name, ()):
            if self.marks[i] and self.marks[i][-1][1]:
                at = self.marks[i][-1][0]
                while len(self.names) > at:
                    self._drop()

    def push(self, name: str) -> None:
        self.end_implied(name)
        for i, member in _MARKS.get(name, ()):
            self.marks[i].append((len(self.names), member))
        self.names.append(name)
        self.open[name] += 1

    def _drop(self) -> str:
        last = self.names.pop()
        self.open[last] -= 1
        for i, _ in _MARKS.get(last, ()):
            self.marks[i].pop()
        return last

    def pop(self, name: str) -> None:
        if self.open[name]:
            while self._drop() != name:
                pass


def sequence(page: str, boxes: frozenset):
    """(tag or '', text or '', inside a link, number of the outermost article or main element around it or 0) for each token; boxes are one tag each."""
    stack, box, frame = _Stack(), None, 0

    def around() -> int:
        return frame if stack.open["article"] or stack.open["main"] else 0

    for kind, name, extra, at in scan(page):
        if kind == "text":
            if box is None:
                yield "", extra, bool(stack.open["a"]), around()
            continue
        if kind == "open":
            if box is not None and name in ("article", "main") and page.find("</" + stack.names[box], at) < 0:
                while len(stack.names) > box:
                    stack.pop(stack.names[-1])
                box = None
            stack.end_implied(name)
            if box is not None and len(stack.names) <= box:
                box = None
            frame += name in ("article", "main") and not (stack.open["article"] or stack.open["main"])
            depth = len(stack.names)
            if name not in _VOID:
                stack.push(name)
            if box is None:
                if name in _RAW or name == "head" or any(f in boxes for f in features(name, extra)):
                    inside = "in" if stack.open["article"] or stack.open["main"] else "out"
                    yield "box-" + inside, "", False, 0
                    if name not in _VOID:
                        box = depth
                else:
                    yield name, "", False, around()
        else:
            stack.pop(name)
            if box is not None and len(stack.names) <= box:
                box = None
            elif box is None:
                yield "/" + name, "", False, around()


def _linked(tokens: list) -> list:
    """Links count as such only in blocks most of whose words are links; a link in a sentence is text, its tags are ``a-text``."""
    out, begin, plain, linked = list(tokens), 0, 0, 0

    def settle(end: int) -> None:
        if linked and plain > linked:
            for i in range(begin, end):
                tag, text, _, frame = out[i]
                out[i] = (tag + "-text" if tag in ("a", "/a") else tag, text, False, frame)

    for i, (tag, text, link, _) in enumerate(tokens):
        if tag and tag.lstrip("/") not in _INLINE:
            settle(i)
            begin, plain, linked = i + 1, 0, 0
        elif not tag:
            n = len(text.split())
            plain, linked = plain + n * (not link), linked + n * link
    settle(len(tokens))
    return out


def _framed(tokens: list) -> bool:
    """Whether all words in article or main elements are in one and at least as many as those outside."""
    words: Counter = Counter()
    for _, text, _, frame in tokens:
        words[frame] += len(text.split())
    outside = words.pop(0, 0)
    words = +words
    return len(words) == 1 and sum(words.values()) >= outside


def _without_beside(tokens: list) -> list:
    """Text beside the frame becomes a tag, but for headings and paragraphs before it (a title, a lead): these compete.  Links in the frame are text."""
    inside = [i for i, t in enumerate(tokens) if t[3] and t[1].strip()]
    first, last = inside[0], inside[-1]
    link = next((i for i in range(first - 1, -1, -1) if tokens[i][1].strip() or tokens[i][0] in ("/a", "article", "main")), -1) + 1
    out, block = [], ""
    for i, t in enumerate(tokens):
        if t[0]:
            if t[0].lstrip("/") not in _INLINE:
                block = t[0]
            elif t[0] in ("a", "/a") and link <= i <= last + 1:
                t = (t[0] + "-text", "", False, t[3])
        elif t[3]:
            t = ("", t[1], False, t[3])
        elif not t[3] and t[1].strip() and not (i < first and block in ("h1", "p") and not t[2]):
            t = ("box-out", "", False, 0)
        out.append(t)
    return out


@functools.lru_cache(maxsize=2)
def default_scores() -> Scores:
    return fit(labelled_pages())


def fit(pages: list[Page], share: float = 0.02, support: int = 3) -> Scores:
    """Scores from labelled pages.

    An element feature marks a box when at most ``share`` of the words seen in
    such elements are article text.  A word scores the log odds of being article
    text among words outside boxes, a tag the log odds of lying inside the article.
    The words' score is then scaled to what tells most pages right.
    """
    seen: dict[str, list[int]] = {}
    for page in pages:
        source = "".join(f for f, _ in page)
        label, at = {}, 0
        for fragment, kind in page:
            if kind is not None and fragment:
                label[at] = kind
            at += len(fragment)
        stack, feats = _Stack(), []
        for kind, name, extra, pos in scan(source):
            if kind == "open" and name not in _VOID:
                stack.push(name)
                feats = feats[: len(stack.names) - 1] + [features(name, extra)]
            elif kind == "close":
                stack.pop(name)
                feats = feats[: len(stack.names)]
            elif kind == "text" and pos in label:
                n = len(extra.split())
                for f in {f for fs in feats for f in fs}:
                    counts = seen.setdefault(f, [0, 0, 0])
                    counts[label[pos]] += n
                    counts[2] += 1
    inline = {"a", "b", "em", "span", "li", "p", "div", "ul", "ol", "section"}
    boxes = frozenset(f for f, (out, art, k) in seen.items() if k >= support and art <= share * (out + art) and f not in inline)
    inside, outside, words = Counter(), Counter(), {False: [1, 1], True: [1, 1]}
    beside = [0, 0]
    for page in pages:
        source = "".join(f for f, _ in page)
        starts, at = [], 0
        for fragment, kind in page:
            if kind is True:
                starts.append(at)
            at += len(fragment)
        article = {" ".join(f.split()) for f, kind in page if kind is True}
        tokens = _linked(list(sequence(source, boxes)))
        framed = _framed(tokens)
        hits = [i for i, (_, text, _l, _w) in enumerate(tokens) if text and " ".join(text.split()) in article]
        first, last = (hits[0], hits[-1]) if hits else (0, -1)
        # the tags of the first and last text's own elements are the article's, too, and all in its frame
        first -= bool(hits and first and re.fullmatch(r"[a-z]\w*", tokens[first - 1][0]))
        last += bool(hits and last + 1 < len(tokens) and tokens[last + 1][0].startswith("/"))
        if framed and hits:
            frame = [i for i, t in enumerate(tokens) if t[3]]
            first, last = min(first, frame[0]), max(last, frame[-1])
        for i, (tag, text, link, within) in enumerate(tokens):
            if framed and text.split() and not within:
                beside[" ".join(text.split()) in article] += len(text.split())
            if tag:
                (inside if first <= i <= last else outside)["in " + tag if within else tag] += 1
            elif text.split():
                words[link][" ".join(text.split()) in article] += len(text.split())
    odds = lambda a, b: math.log((a + 0.5) / (b + 0.5))
    tags = {t: min(-0.01, odds(inside[t], outside[t])) for t in {*inside, *outside}}
    for t in ("article", "/article", "main", "/main", "in article", "in /article", "in main", "in /main", "box-in"):  # the frame of an article never costs more than a word
        tags[t] = max(tags.get(t, -0.01), -0.01)
    found = Scores(boxes, tags, max(0.05, odds(words[False][1], words[False][0])), max(0.05, odds(words[True][1], words[True][0])), -0.5, beside[1] <= share * sum(beside))
    # words of one text are no independent witnesses: their odds count by the part that tells most of the pages right
    some = [("".join(f for f, _ in page), " ".join(f for f, kind in page if kind).split()) for page in pages[:: max(1, len(pages) // 300)]]
    word, best = found.word, -1
    for part in (1.0, 0.5, 0.25, 0.12, 0.06):
        found.word = word * part
        right = sum(extract_text(source, found).split() == text for source, text in some)
        best, chosen = (right, part) if right > best else (best, chosen)
    found.word = word * chosen
    return found


def best_run(values: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the greatest positive sum, of equal ones the first, then the longest; (0, 0) if there is none."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        total += v
        if total > best or (total == best and span[0] == begin and best > 0):
            best, span = total, (begin, i + 1)
        if total < 0:
            total, begin = 0.0, i + 1
    return span


def extract_text(page: str | None, scores: Scores | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    scores = scores or default_scores()
    tokens = _linked(list(sequence(page, scores.boxes)))
    if scores.framed and _framed(tokens):
        tokens = _without_beside(tokens)
    first, end = best_run([scores.of(*t) for t in tokens])
    blocks, now = [], []
    for tag, text, _, _ in tokens[first:end]:
        if not tag:
            now.append(text)
        elif tag.lstrip("/") not in _INLINE and now:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return " ".join(b for b in (" ".join(_html.unescape(x).split()) for x in blocks) if b)


def extract(pages: DataFrame, html_col: str = "html", text_out: str = "text", chars_out: str = "n_chars", scores: Scores | None = None) -> DataFrame:
    """``pages`` without the page source, with its main text and the text's number of code points."""
    rest = [c for c in pages.columns if c not in (html_col, text_out, chars_out)]
    schema = T.StructType([*[pages.schema[c] for c in rest], T.StructField(text_out, T.StringType()), T.StructField(chars_out, T.LongType())])
    scores = scores or default_scores()

    def run(batches):
        for batch in batches:
            texts = [extract_text(x.as_py(), scores) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i + 1) for i in range(len(rest))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, text_out, chars_out]
            )

    return pages.select(F.col(html_col).alias("_quill_html"), *[F.col(c) for c in rest]).mapInArrow(run, schema)


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
