"""Pages made of repeated keywords, links or tags rather than sentences.

A page is read in units that don't depend on its line breaks: sentences, and windows of
about a sentence's words where no sentence ends.  Every unit is turned into a symbol (its
structure and whether its words keep coming back on the page).  A hidden Markov model
over the units labels each as prose, link list, tag list or menu (Viterbi); a page is
flagged when its non-prose units hold more than half of its words.

The model starts from a prior and is fitted by expectation maximisation (Baum-Welch) on
a bounded sample of pages (``SAMPLE_PAGES`` of lowest hash, of at most ``SAMPLE_CHARS``
characters); every page is labelled.  Null, empty and blank texts have no units and are
never flagged.  Equal units count once for repetition, so a refrain stays prose.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

STATES = ("prose", "links", "tags", "menu")
SHARE = 0.5
#: a unit's word pairs count as repeated if they stand this often on the page; a unit repeats if that share of them do
TIMES, REPEATS = 3, 0.34
#: a unit without a sentence's end also repeats if that share of its words stand so often on the page
WORD_TIMES, WORD_REPEATS = 4, 0.85
#: words of a window, and most words of a unit before it is cut into windows
WINDOW, LONGEST = 12, 40
#: most words of a curt sentence, and the share of its pairs that must come back
CURT, REPEATS_CURT = 7, 0.5
#: pages the model is fitted on, their greatest length, rounds, and what the prior counts for
SAMPLE_PAGES, SAMPLE_CHARS, ROUNDS, PRIOR = 1000, 20_000, 8, 1000.0

_ANCHOR = re.compile(r"(?P<open><a\b[^<>]*>)|(?P<close></a>)|<a\b", re.I)
_ADDRESS = re.compile(r"\[[^\[\]\n]*\]\(\s*[^()\s]+\s*\)|(?:https?|ftp)://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>")
# with the marks of the scripts whose vowels are marks
_M = "\\w\u0300-\u036f\u0610-\u065f\u0900-\u0dff\u0e00-\u0e7f"
_WORD = re.compile(rf"[{_M}]+(?:[-'’][{_M}]+)*")
_NO_MARKS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_WIDE = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_MENU = re.compile(r"\s+[>|»/·•→]\s+")
_FIELD = re.compile(r"\s*(?:[A-Z][\w-]{1,11}:\s|SKU\s*\d+|[A-Z]{2,5}[ -]?\d{3,})")
_ENDS = re.compile(r"[.!?…。！？।؟]+[\"'”’»」』)）]*(?=\s|$)|[。！？।؟]")
_PLAIN_END = re.compile(r"[.!?][\"'”’)]*\s*$")
_LISTED = re.compile(r"[,;、，；|/•·]|\s[–—]\s")
_TAG = re.compile(r"(?:^|\s)#[^\s#]{2,}")

SYMBOLS = [s + r for s in ("link", "hash", "menu", "field", "listed", "bare", "curt", "short", "sentence") for r in ("-", "+")]
_AT = {s: i for i, s in enumerate(SYMBOLS)}


# The prior: shares of the symbols in each state; the rest is a small remainder.
_PRIOR = {
    "prose": {"sentence-": 60, "sentence+": 14, "short-": 14, "short+": 0.6, "bare-": 3, "bare+": 0.2, "curt-": 4, "curt+": 0.5, "listed-": 2, "listed+": 0.3, "menu-": 0.5, "field-": 0.8, "field+": 0.5, "link-": 1, "link+": 0.3},
    "links": {"link-": 45, "link+": 45, "short+": 1.5, "short-": 0.8},
    "tags": {"hash-": 12, "hash+": 14, "field+": 14, "field-": 2, "listed+": 18, "listed-": 2, "bare+": 20, "bare-": 3, "curt+": 12, "curt-": 1, "short+": 14, "short-": 0.6, "sentence+": 2},
    "menu": {"menu+": 50, "menu-": 35, "short-": 0.8, "short+": 3},
}


class Model:
    """Start, transition and emission probabilities (logarithms)."""

    def __init__(self) -> None:
        e = np.full((len(STATES), len(SYMBOLS)), 0.02)
        for k, s in enumerate(STATES):
            for name, w in _PRIOR[s].items():
                e[k, _AT[name]] += w
        self.emit = np.log(e / e.sum(1, keepdims=True))
        self.move = np.log(np.where(np.eye(len(STATES)) > 0, 0.85, 0.05))
        self.start = np.log(np.array([0.7, 0.1, 0.1, 0.1]))

    def fit(self, pages: list[list[int]]) -> Model:
        """Baum-Welch with the prior as pseudo-counts; all pages at once, in padded arrays."""
        pages = [p[i : i + 64] for p in pages for i in range(0, len(p), 64)]
        if not pages:
            return self
        pages.sort(key=len)
        prior = [np.exp(x) * PRIOR for x in (self.start, self.move, self.emit)]
        for _ in range(ROUNDS):
            start, move, emit = (p.copy() for p in prior)
            for s in range(0, len(pages), 256):  # of like length
                self._expect(pages[s : s + 256], start, move, emit)
            self.start, self.move, self.emit = (np.log(x / x.sum(-1, keepdims=True)) for x in (start, move, emit))
        return self

    def _expect(self, pages: list[list[int]], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        sizes = np.array([len(p) for p in pages])
        n, width = len(pages), int(sizes.max())
        obs = np.full((n, width), -1)
        obs[np.arange(width) < sizes[:, None]] = np.concatenate(pages)
        seen = obs >= 0
        like = np.where(seen[:, :, None], np.exp(self.emit).T[obs], 1.0)
        step = np.exp(self.move)
        alpha = np.empty(like.shape)
        for t in range(width):
            a = like[:, t] * (np.exp(self.start) if t == 0 else alpha[:, t - 1] @ step)
            alpha[:, t] = a / a.sum(1, keepdims=True)
        beta = np.ones((n, len(STATES)))
        for t in range(width - 1, -1, -1):
            g = alpha[:, t] * beta
            g = np.where(seen[:, t, None], g / g.sum(1, keepdims=True), 0)
            np.add.at(emit.T, obs[seen[:, t], t], g[seen[:, t]])
            if t == 0:
                start += g.sum(0)
                break
            right = like[:, t] * beta
            pair = alpha[:, t - 1, :, None] * step * right[:, None, :]
            pair = np.where(seen[:, t, None, None], pair / pair.sum((1, 2), keepdims=True), 0)
            move += pair.sum(0)
            back = right @ step.T
            beta = np.where(seen[:, t, None], back / back.sum(1, keepdims=True), beta)

    def label(self, observed: list[int]) -> list[int]:
        """Most likely states of the units (Viterbi)."""
        return self.label_all([observed])[0]

    def label_all(self, pages: list[list[int]]) -> list[list[int]]:
        """The same for many pages, those of like length in one array."""
        out: list[list[int]] = [[] for _ in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            some = order[at : at + 64]
            # a much longer page waits for others like it
            some = [i for i in some if len(pages[i]) <= 16 + 2 * len(pages[some[0]])]
            at += len(some)
            sizes = np.array([len(pages[i]) for i in some])
            width, rows = int(sizes.max()), np.arange(len(some))
            obs = np.zeros((len(some), width), np.int64)
            obs[np.arange(width) < sizes[:, None]] = np.concatenate([pages[i] for i in some])
            back = np.empty((width, len(some), len(STATES)), np.int8)
            score = self.start + self.emit[:, obs[:, 0]].T
            final = np.where((sizes == 1)[:, None], score, 0.0)
            for t in range(1, width):
                step = score[:, :, None] + self.move
                back[t] = step.argmax(1)
                score = step.max(1) + self.emit[:, obs[:, t]].T
                final[sizes == t + 1] = score[sizes == t + 1]
            state = final.argmax(1)
            path = np.empty((width, len(some)), np.int8)
            for t in range(width - 1, -1, -1):
                path[t] = state
                state = np.where(t < sizes, back[t, rows, state], state) if t else state
            for c, i in enumerate(some):
                out[i] = path[: sizes[c], c].tolist()
        return out


def _lines(text: str) -> list[str]:
    """Lines as a reader sees them: block markup breaks lines, a list of anchors stays links."""
    text = re.sub(r"</li>|<br\s*/?>|</p>|</div>|</tr>|</h\d>", "\n", text, flags=re.I)
    return [x for x in re.split(r"[\r\n  ]+", text) if x.strip()]


def _linked(line: str) -> bool:
    """Whether the line may hold a link at all; the patterns needn't run on the others."""
    return "://" in line or "](" in line or "<a" in line or "<A" in line or "www." in line or "WWW." in line


def _links(line: str) -> list[tuple[int, int]]:
    """(start, end) of the links: an anchor tag up to its closing one with no other between, or an address."""
    anchors, start = [], -1
    if "<a" in line or "<A" in line:
        for m in _ANCHOR.finditer(line):
            if m["close"] is None:
                start = m.start() if m["open"] is not None else -1
            elif start >= 0:
                anchors.append((start, m.end()))
                start = -1
    out: list[tuple[int, int]] = []
    at, k, other = 0, 0, _ADDRESS.search(line)
    while True:
        while k < len(anchors) and anchors[k][0] < at:
            k += 1
        if other and other.start() < at:
            other = _ADDRESS.search(line, at)
        if k < len(anchors) and (not other or anchors[k][0] < other.start()):
            out.append(anchors[k])
        elif other:
            out.append(other.span())
        else:
            return out
        at = out[-1][1]


def _without(line: str, links: list[tuple[int, int]], shown: bool = False) -> str:
    """The line with its links blanked out, or only their visible words left."""
    parts, at = [], 0
    for a, b in links:
        parts += [line[at:a], _shown(line[a:b]) if shown else " "]
        at = b
    return "".join([*parts, line[at:]])


def _shown(s: str) -> str:
    """The visible words of a link."""
    if s[0] == "[":
        return " " + s[1 : s.index("]")] + " "
    return " " + _MARKUP.sub(" ", s) + " " if s[0] == "<" else " "


def _label(found: str) -> str:
    return re.sub(r"[\W\d_]+", "", found)


def units(line: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(unit, links in it) of a line: sentences, and windows where there is no end for long; no link is cut."""
    links = _links(line) if _linked(line) else []
    cuts = [m.end() for m in _ENDS.finditer(line)]
    if len(line) > 5 * WINDOW:
        words = None
        for a, b in zip([0, *cuts], [*cuts, len(line)]):
            if b - a > 5 * LONGEST or line.count(" ", a, b) > LONGEST or len(_LISTED.findall(line, a, b)) > WINDOW:
                words = [m.start() for m in _WORD.finditer(line, a, b)]
                if len(words) > LONGEST:
                    cuts += words[WINDOW : len(words) - WINDOW // 2 : WINDOW]
        if words:
            cuts.sort()
    if links:
        cuts = [c for c in cuts if not any(a < c < b for a, b in links)] if len(links) < 4 else _outside(cuts, links)
    out, at, k = [], 0, 0
    for c in [*cuts, len(line)]:
        if c > at and not line[at:c].isspace():
            mine = []
            while k < len(links) and links[k][1] <= c:
                mine.append((links[k][0] - at, links[k][1] - at))
                k += 1
            out.append((line[at:c], mine))
            at = c
    return out


def _outside(cuts: list[int], links: list[tuple[int, int]]) -> list[int]:
    starts, ends = [a for a, _ in links], [b for _, b in links]
    out = []
    for c in cuts:
        k = bisect_left(starts, c) - 1
        if k < 0 or ends[k] <= c:
            out.append(c)
    return out


def read(text: str | None) -> tuple[list[int], list[float]]:
    """(symbol, words) of every unit of a page."""
    found = [u for line in _lines(text or "") for u in units(line)]
    words = []
    for unit, links in found:
        shown = _without(unit, links, shown=True) if links else unit
        words.append(_WORD.findall((_MARKUP.sub(" ", shown) if "<" in shown else shown).lower()))
    pairs: Counter = Counter()
    single: Counter = Counter()
    for ws in set(map(tuple, words)):
        pairs.update(zip(ws, ws[1:]))
        single.update(ws)
        if len(ws) == 1:
            pairs[ws] += 1
    labels = Counter(_label(m.group()) for unit, _ in found if (m := _FIELD.match(unit)))
    often, words_often = {p for p, c in pairs.items() if c >= TIMES}, {w for w, c in single.items() if c >= WORD_TIMES}
    sizes = [_size(unit, links, ws) for (unit, links), ws in zip(found, words)]
    return [_symbol(unit, links, ws, n, often, words_often, labels) for (unit, links), ws, n in zip(found, words, sizes)], sizes


def _size(unit: str, links: list[tuple[int, int]], words: list[str]) -> float:
    """Words of a unit; an address counts by its parts, and so do scripts without blanks by pairs of characters."""
    n = len(words)
    if links:
        n = len(_WORD.findall(unit))
    if not unit.isascii():
        wide = len(_WIDE.findall(unit))
        if wide:
            n = max(n, len(_WORD.findall(_WIDE.sub(" ", unit)))) + wide / 2
    return float(n)


def _symbol(unit: str, links: list[tuple[int, int]], ws: list[str], n: float, often: set, words_often: set, labels: Counter) -> int:
    again = 0.0
    if often:
        again = sum(map(often.__contains__, zip(ws, ws[1:]))) / (len(ws) - 1) if len(ws) > 1 else float(tuple(ws) in often)
    repeated = again >= REPEATS
    body, size = unit, len(unit.strip())
    linked = sum(b - a for a, b in links)
    if links:
        body = _without(unit, links)
    if "<" in body:
        body = _MARKUP.sub(" ", body)
    if "&" in body:
        body = html.unescape(body)
    body = body.strip(" \t-*•#=　")
    ended = bool(_ENDS.search(body))
    tags = _TAG.findall(unit) if "#" in unit else []
    if linked > 0.5 * size:
        kind = "link"
    elif len(tags) >= 3 and sum(map(len, tags)) > 0.5 * size:
        kind = "hash"
    elif not ended and len(parts := _MENU.split(body)) >= 3 and n <= 5 * len(parts):
        kind = "menu"
    elif not ended and n <= 7 and (label := _FIELD.match(unit)):
        kind = "field"
        repeated = repeated or labels[_label(label.group())] >= TIMES
    else:
        open_ended = False  # in a script that writes sentences without an end mark
        segments = sum(not s.isspace() for s in _LISTED.split(body) if s)
        if segments >= 4 and n <= 5 * segments and not ended:
            kind = "listed"
        elif ended:
            kind = "sentence"
            if 1 < len(ws) and n <= 2 * CURT and len(ws) <= CURT and _PLAIN_END.search(body):
                kind, repeated = "curt", again >= REPEATS_CURT
        else:
            kind = "bare" if n >= WINDOW - 2 else "short"
            open_ended = kind == "bare" and len(_NO_MARKS.findall(body)) > len(body) // 2
        if not ended and not repeated and len(ws) > 4:
            repeated = sum(map(words_often.__contains__, ws)) >= WORD_REPEATS * len(ws)
        if not ended and not repeated and open_ended:
            kind = "sentence"
    return _AT[kind + ("+" if repeated else "-")]


def page_shares(text: str | None, model: Model | None = None) -> dict[str, float] | None:
    """Share of the words in units of each label; None for a text without words."""
    return shares_of([text], model or Model())[0]


def shares_of(texts: list[str | None], model: Model) -> list[dict[str, float] | None]:
    pages = [read(t) for t in texts]
    out: list[dict[str, float] | None] = []
    for (_, sizes), states in zip(pages, model.label_all([symbols for symbols, _ in pages])):
        total = sum(sizes)
        if not total:  # nothing, or nothing but marks and invisible characters
            out.append(None)
            continue
        share = dict.fromkeys(STATES, 0.0)
        for k, n in zip(states, sizes):
            share[STATES[k]] += n / total
        out.append(share)
    return out


def fit_model(documents: DataFrame) -> Model:
    """The model of a bounded sample of the pages, the same whatever their order."""
    fit = documents.where(F.length("text").between(1, SAMPLE_CHARS)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    return Model().fit([read(r.text)[0] for r in fit.orderBy("h").limit(SAMPLE_PAGES).collect()])


def label_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, prose, links, tags, menu, spam) of every document; after the fit a scan without a shuffle."""
    model = fit_model(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = []
            for k in range(0, b.num_rows, 512):  # a bounded number of pages at a time
                shares += shares_of(b.column(1).slice(k, 512).to_pylist(), model)
            cols = [pa.array([s and s[k] for s in shares], pa.float64()) for k in STATES]
            spam = pa.array([bool(s) and 1 - s["prose"] > SHARE for s in shares], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, spam], names=["doc_id", *STATES, "spam"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{s} double" for s in STATES) + ", spam boolean")


def spam_pages(documents: DataFrame) -> DataFrame:
    return label_pages(documents).where("spam").select("doc_id").distinct()
