"""Sentence boundaries for any script, by a pushdown automaton.

The automaton reads a line at a time (a line break always ends a sentence).  Its
stack holds open quotations and brackets and, for a list entry, heading or log
line, a frame that lasts to the end of the line.  A terminator only ends a
sentence on an empty stack; what it means there depends on the abbreviation trie,
on the script and on the character that follows.

Results for the edges: null and empty text give no sentence, blank lines give
none, a text without any mark is one sentence per line.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import current_documents, text_payloads

# Abbreviations by what may follow them.
# TITLE: a name always follows.  NUMBER: a numeral (or a lower-case word) follows.
# INNER: the sentence goes on whatever follows.  FINAL: may also close a sentence.
TITLE = """
mr mrs ms dr prof st sr sra srta dra sres hr fr frl herr ing dipl mag mme mlle m mm mgr sig sigg dott avv egr
dhr mevr mw drs ir exmo exma doç bn sn yrd ks inż lek doc акад проф г-н г-жа гр д-р тов डॉ श्री
श्रीमती د أ ดร นาย capt lt sgt rev hon gov
""".split()
NUMBER = """
fig figs no nos nr núm num n.º nº p pp pg pág págs pag pagg blz abb afb kap cap caps tab tbl taf vol vols art arts sec sect
ch eq ed bd jh anm ziff rys str godz poz tabl rozdz ок рис табл стр с гл п ст разд мал розд див см zob vgl siehe ver véase
cf cfr bkz şek çiz ص पृ จ approx aprox ca c circa env około ok yakl vers
jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic okt dez mrt gen mag giu lug set ott
""".split()
INNER = """
e.g i.e viz z z.b b d.h d.w.z bzw inkl exkl bijv o.a т.е т.п т.к т.н т.зв напр np m.in tzn tj tzw ud uds vd
vds p.ej c.-à-d c.à.d örn ibid incl excl sog evtl ggf bzgl z.t
""".split()
FINAL = """
etc usw enz ecc itd itp vb vs co ltd inc corp bros a.m p.m u.k u.s u.s.a e.u jr sr плюс др пр г гг р рр тыс млн млрд руб
коп в.в in uu ee.uu l.p h min s ms km kg cm mm m.ö m.s a.d b.c
""".split()
# German, Dutch, French, Polish ... month names after an ordinal day.
MONTHS = """januar februar märz april mai juni juli august september oktober november dezember jänner""".split()
# Quotation and bracket pairs.
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "‘": "’", "‹": "›"}
QUOTES = set("“„«「『‘‹\"»")
CLOSERS = set("”“»」』)）]】》〉’›\"'")
CJK_END = set("。！？｡")
HARD_END = set("।؟॥۔")



def _trie(words: list[str]) -> dict:
    """Characters read backwards from the mark, so that one walk finds the longest abbreviation."""
    root: dict = {}
    for w in words:
        node = root
        for ch in reversed(w):
            node = node.setdefault(ch, {})
        node[""] = True
    return root


_DEPTH = 3 * max(map(len, TITLE + NUMBER + INNER + FINAL)) + 2
_TRIES = {"title": _trie(TITLE), "number": _trie(NUMBER), "inner": _trie(INNER), "final": _trie(FINAL)}
_EVENT = re.compile(r"[.!?…。！？｡।॥۔؟“”„«»「」『』()（）\[\]【】《》〈〉‘’‹›\"]|(?<=[\u0E00-\u0E7F]) +(?=[\u0E00-\u0E7F])")
_LINE = re.compile(r"[^\r\n\u2028\u2029\x85\x0b\x0c]+")
_BULLET = re.compile(r"\s*(?:[-*•‣◦▪·+–]|\(?(?:\d{1,3}|[a-zA-Zа-я])[.)]|[①-⑳]|\d{1,2}、)[ \t\u00a0\u3000]")
_HEADING = re.compile(r"\s*(?:#{1,6}\s|={2,}\s?|\*\*[^*]+\*\*\s*$|<h\d)")
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d\b|0x[0-9a-f]+\b|(?:INFO|WARN|ERROR|DEBUG|TRACE)\b|[\d;,.:\s-]+$)")
_IDENT = re.compile(r"[a-z][\w-]*(?:[._/][\w.-]+|\d[\w.]*)|[a-z][\w-]* v?\d+\.\d|[a-z]+[A-Z]")
_WORD_CHAR = re.compile(r"[\w.º\u0900-\u0DFF\u0E00-\u0E7F-]").match
_WORD_BACK = re.compile(r"[\w.º\u0900-\u0DFF\u0E00-\u0E7F-]+$")


@lru_cache(maxsize=50_000)
def _kinds(word: str) -> tuple[str, ...]:
    """The kinds of abbreviation that a word ends with; its own or after a mark inside it."""
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    word = word.lower()
    out = []
    for kind, trie in _TRIES.items():
        node, i, hit = trie, len(word) - 1, -1
        while i >= 0:
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                hit = i
            i -= 1
        if hit == 0 or (hit > 0 and not (word[hit - 1].isalnum() or word[hit - 1] == ".")):
            out.append(kind)
    return tuple(out)


def _abbreviations(line: str, start: int, dot: int) -> tuple[str, ...]:
    return _kinds(line[max(start, dot - _DEPTH) : dot])  # more than the longest abbreviation, so nothing is lost


def _cased(ch: str) -> str:
    """U upper, l lower, 9 digit, o uncased letter, else the mark itself."""
    if not ch:
        return ""
    if ch.isupper() or unicodedata.category(ch) == "Lt":
        return "U"
    if ch.islower():
        return "l"
    if ch.isdigit():
        return "9"
    return "o" if ch.isalpha() else ch


_SMALL = re.compile(r"[a-zß-öø-ÿа-яёіїєґ]+")


def _capitals(line: str) -> bool:
    """Whether a line is written in capitals."""
    if line.lower() == line or sum(map(len, _SMALL.findall(line))) > 0.1 * len(line):
        return False
    letters = [c for c in line if c.isalpha()]
    return len(letters) > 12 and sum(map(str.isupper, letters)) > 0.9 * sum(c.isupper() or c.islower() for c in letters) > 0


def _prose(line: str, base: int, out: list[tuple[int, int]]) -> None:
    """Boundaries of one line of running text, appended as (start, end)."""
    n, begin = len(line), 0
    while begin < n and line[begin].isspace():
        begin += 1
    dead: set[int] = set()  # openers that never close on this line
    capitals = _capitals(line)
    inward = line.rfind("«")
    while begin < n:
        end, stuck = _next_end(line, begin, n, dead, capitals, inward)
        if stuck:
            dead.update(stuck)
            continue
        out.append((base + begin, base + end))
        begin = end
        while begin < n and line[begin].isspace():
            begin += 1


def _next_end(line: str, begin: int, n: int, dead: set[int], capitals: bool, inward: int) -> tuple[int, list[int]]:
    """End of the sentence that starts at begin; or the positions of openers that are never closed."""
    stack: list[tuple[str, int]] = []
    skip = begin
    for m in _EVENT.finditer(line, begin):
        i, ch = m.start(), m.group()[0]
        if i < skip:
            continue
        if ch == " ":  # between two Thai letters
            if not stack:
                return i, []
            continue
        if stack and _closes(ch, stack[-1][0], line, i):
            opener, at = stack.pop()
            if stack:
                continue
            end = _after_close(line, begin, at, i, n, opener, capitals)
            if end:
                return end, []
            skip = i + 1
            continue
        if ch in PAIRS or ch in '"»':
            if i not in dead and _opens(ch, line, i, begin, inward):
                stack.append((ch, i))
            continue
        if ch in CLOSERS or stack:
            continue
        end = _terminates(line, begin, i, n, capitals)
        if end:
            return end, []
        j = i + 1
        while j < n and line[j] in ".!?…。！？":
            j += 1
        skip = j
    if stack:
        return -1, [at for _, at in stack]
    end = n
    while end > begin and line[end - 1].isspace():
        end -= 1
    return end, []


def _opens(ch: str, line: str, i: int, begin: int, inward: int) -> bool:
    if ch == '"':
        return (i == begin or not line[i - 1].isalnum()) and i + 1 < len(line) and not line[i + 1].isspace()
    if ch == "»":  # the German inward form
        return inward > i and (i == begin or line[i - 1].isspace()) and i + 1 < len(line) and not line[i + 1].isspace()
    if ch == "‘":
        return i == begin or not line[i - 1].isalnum()
    return True


def _closes(ch: str, opener: str, line: str, i: int) -> bool:
    if opener == '"':
        return ch == '"'
    if opener == "»":
        return ch == "«"
    if ch == "’" and opener == "‘":
        return not (i + 1 < len(line) and line[i + 1].isalpha())
    return ch in PAIRS.get(opener, "")


def _skip_blanks(line: str, i: int) -> int:
    while i < len(line) and line[i].isspace():
        i += 1
    return i


def _after_close(line: str, begin: int, at: int, i: int, n: int, opener: str, capitals: bool) -> int:
    """The end of a sentence if it ends with the quotation or bracket at..i, else 0."""
    j = i + 1
    while j < n and line[j] in CLOSERS and line[j] not in "“\"'" :
        j += 1
    inner = line[at + 1 : i].rstrip()
    if not inner or inner[-1] not in ".!?…。！？।؟॥":
        return 0
    k = _skip_blanks(line, j)
    if k >= n:
        return j
    follow = line[k]
    kind = _cased(follow)
    whole = line[begin:at].strip() == ""  # the sentence began with it
    if follow in ".,;:!?。，、；：！？…।؟،":
        return 0
    if follow in "—–-":
        return 0
    if kind == "l":
        return 0 if not _IDENT.match(line, k) or (whole and opener in QUOTES) else j
    if whole and opener in QUOTES:
        if kind == "o":
            return 0  # the speaker's words follow
        if kind == "U" and (_speaker(line, k) or capitals):
            return 0
        return j
    if kind == "o" and opener not in QUOTES and not whole:
        return 0
    if k == j and kind not in "oU" and follow not in "“„«「『":
        return 0
    return j


_SAYS = re.compile(
    r"(?:(?:[A-ZÀ-ÞА-ЯЁЄІЇҐ][\w.'’-]*\.?|de|van|von|la|der)\s+){1,3}"
    r"(?:said|asked|replied|wrote|shouted|whispered|answered|murmured|fragte|sagte|rief|flüsterte|demanda|dit|répondit|preguntó|dijo|chiese|disse|perguntou|vroeg|zei|zapytał|zapytała|powiedział|powiedziała|спросил|спросила|сказал|сказала|запитав|запитала|сказав|sordu|dedi|diye)\b"
)


def _speaker(line: str, k: int) -> bool:
    return bool(_SAYS.match(line, k))


def _terminates(line: str, begin: int, i: int, n: int, capitals: bool) -> int:
    """The end of the sentence if the mark at i ends it outside quotations, else 0."""
    ch = line[i]
    j = i + 1
    while j < n and line[j] in ".!?…。！？":
        j += 1
    run = line[i:j]
    ellipsis = "…" in run or (len(run) > 1 and set(run) == {"."})
    end = j
    while end < n and line[end] in CLOSERS and not (line[end] in "\"'“" and end + 1 < n and line[end + 1].isalnum()):
        end += 1
    k = _skip_blanks(line, end)
    if k >= n:
        return end
    if ch == "." and not ellipsis and j < n and line[j] in ",;:)":
        return 0
    follow = line[k]
    kind = _cased(follow)
    blank = k > end
    if ellipsis:
        if kind == "U" and not capitals and blank:
            return end
        return end if follow in "¿¡“„«「『" and blank else 0
    if ch in CJK_END or ch in HARD_END:
        return end
    if follow in ",;:)，、；：" or (follow in "—–" and ch != "."):
        return 0
    if ch in "!?":
        if not blank and not (kind in "Uo" or follow in "“„«「『"):
            return 0
        return end if kind != "l" or _IDENT.match(line, k) else 0
    # a full stop
    before = line[i - 1] if i > begin else ""
    if not blank:
        if kind == "U" and (before.islower() or before.isdigit()) and k + 1 < n and (line[k + 1].islower() or line[k + 1] == " ") and not _technical(line, i):
            return end
        if kind == "o" and before and _cased(before) == "o" and follow > "\u02ff":
            return end if not _abbrev_any(line, begin, i) else 0
        return end if follow in "“„«「『¿¡" else 0
    m = _WORD_BACK.search(line, max(begin, i - 24), i)
    start = m.start() if m else i
    while start > begin and i - start >= 24 and _WORD_CHAR(line[start - 1]):  # a longer word
        start -= 1
    word = line[start:i]
    if kind == "l":
        if not _IDENT.match(line, k):
            return 0
        return 0 if _abbrev_any(line, start, i) else end
    kinds = _abbreviations(line, start, i)
    if "title" in kinds and word.lower() not in ("m",) or word in ("M", "Mme"):
        return 0
    if "inner" in kinds:
        return 0
    if "number" in kinds:
        return 0 if kind == "9" or word.lower() in ("см", "див", "bkz", "vgl", "cf") else end
    if len(word) == 1 and word.isupper() and kind == "U" and not capitals:
        return 0  # an initial
    if word and word.isdigit() and kind == "U":
        nxt = re.match(r"\w+", line[k : k + 20])
        if nxt and nxt.group().lower() in MONTHS:
            return 0
    if "final" in kinds:
        if word.lower() == "co" and _COMPANY.match(line, k):
            return 0
        if kind == "9" and word.lower() in ("vs",):
            return 0
        if capitals and word.lower() in ("a.m", "p.m") and len(line[begin:i].split()) <= 3:
            return 0
        return end
    return end


_COMPANY = re.compile(r"(?:ltd|inc|llc|kg|s\.a)\b", re.I)


@lru_cache(maxsize=4)
def _tokens(line: str) -> tuple[list[int], list[bool]]:
    """Where the line's tokens start, and whether each is technical; found once a line."""
    found = [(m.start(), bool(_TECHNICAL.search(m.group()))) for m in re.finditer(r"\S+", line)]
    return [a for a, _ in found], [t for _, t in found]


_TECHNICAL = re.compile(r"[/_@=(]")


def _technical(line: str, i: int) -> bool:
    """A stop inside a file name, host or identifier."""
    starts, technical = _tokens(line)
    return technical[bisect_right(starts, i) - 1]


def _abbrev_any(line: str, start: int, i: int) -> bool:
    return bool(_abbreviations(line, start, i))


def is_single(line: str) -> bool:
    """A line that is one sentence whatever marks it holds: list entry, heading, log line."""
    return bool(_BULLET.match(line) or _HEADING.match(line) or _LOG.match(line))


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) in code points of every sentence; end is past its last character."""
    out: list[tuple[int, int]] = []
    for m in _LINE.finditer(text or ""):
        line = m.group()
        if line.isspace():
            continue
        if is_single(line):
            body = line.rstrip()
            out.append((m.start() + len(line) - len(line.lstrip()), m.start() + len(body)))
        else:
            _prose(line, m.start(), out)
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def spans_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda t: [{"start_pos": a, "end_pos": b} for a, b in sentence_spans(t)] if t else [])


_UNITS = T.ArrayType(T.StructType([*_SPANS.elementType.fields, T.StructField("sentence", T.StringType())]))


@F.pandas_udf(_UNITS)
def units_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda t: [{"start_pos": a, "end_pos": b, "sentence": t[a:b]} for a, b in sentence_spans(t)] if t else [])


def split_sentences(store_docs: DataFrame) -> DataFrame:
    """Sentence units of the text payloads of every document's current version.

    One row (doc_key, payload_no, ordinal, start_pos, end_pos, sentence) each.
    Null or empty payloads and documents without payloads give no row; exact
    duplicate rows of a version give their sentences once.
    """
    texts = text_payloads(current_documents(store_docs)).where(F.length("data") > 0)
    units = texts.select("doc_key", "payload_no", F.posexplode(units_udf("data")).alias("ordinal", "s"))
    return units.select("doc_key", "payload_no", "ordinal", "s.start_pos", "s.end_pos", "s.sentence")


def sentence_ends(store_docs: DataFrame) -> DataFrame:
    """Only the boundaries; the text doesn't leave the stage that reads it."""
    texts = text_payloads(current_documents(store_docs)).where(F.length("data") > 0)
    ends = texts.select("doc_key", "payload_no", F.explode(spans_udf("data")).alias("s"))
    return ends.select("doc_key", "payload_no", F.col("s.end_pos").alias("end_pos"))
