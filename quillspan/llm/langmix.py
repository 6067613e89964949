"""Language of every document and of every segment in one language.

A document's sentences are modelled as a mixture of languages.  Character n-gram
models give every sentence's likelihood under each language; expectation
maximisation estimates the document's language proportions; the language set is
chosen by penalised likelihood (a language stays only if the document's
log-likelihood with it, after a penalty a language, is higher than without it).
A sentence's confidence is its posterior under the fitted mixture.

Edges: null, empty and blank payloads, lines of logs, code or numbers and
sentences without letters have no language and are skipped; a document without
any sentence that has one gives no segment.  An unknown label counts as missing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import current_documents
from .sentences import sentence_spans

#: n-gram orders, additive smoothing, nats a further language must earn, weight of the likelihood
#: (n-grams overlap, so their sum overstates the evidence), most training sentences a language.
ORDERS, ALPHA, PENALTY, TEMPER, SAMPLE_LIMIT = (1, 2, 3, 4), 0.3, 5.0, 0.5, 2000
EM_ROUNDS = 12
#: labelled documents a label, and their greatest length, that the second fit takes
LABELLED_LIMIT, LABELLED_CHARS = 60, 4000
#: share of a labelled document's sentences on which label and first model must agree for all of them to count
MOSTLY = 0.7
#: share of a sentence's letters in a script that one language alone writes, which settles it
OWN_SCRIPT = 0.3
#: log-likelihood of the other languages of a sentence that its script settles
SETTLED = -1000.0
#: least share of a Latin sentence's longest n-grams that its best language must know
MIN_KNOWN = 0.22
#: the same of a model that knows the wordings of the samples only
FIRST_KNOWN = 0.1

# ISO 639-2 three-letter codes (terminological and bibliographic) of the two-letter ones.
THREE = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl",
    "pol": "pl", "rus": "ru", "ukr": "uk", "tur": "tr", "ara": "ar", "hin": "hi", "zho": "zh", "chi": "zh", "jpn": "ja", "kor": "ko",
    "tha": "th", "ces": "cs", "cze": "cs", "swe": "sv", "nor": "no", "dan": "da", "fin": "fi", "ell": "el", "gre": "el", "heb": "he",
    "vie": "vi", "ind": "id", "ron": "ro", "rum": "ro", "hun": "hu", "bul": "bg", "fas": "fa", "per": "fa", "cat": "ca",
}
_NONE = ("und", "mul", "zxx", "mis", "xx")

_LOG_LINE = re.compile(
    r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d\b|0x[0-9a-fA-F]+\b|(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b|data:\w+/|(?:def|class|import|from|return|for|while|if)\b.*[:()=\[\]]|[\d\s;,.:|+*/=x-]+$|(?:[^\s=]+=\S+(?:\s+|$)){2,}$)"
)
_ASCII_RUN = re.compile(r"[!-~]+")
_TECHNICAL = re.compile(r"[0-9_/\\@=<>{}]|\w\.\w")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def label_code(label: str | None) -> str | None:
    """The two-letter code a label names, in any case, with or without region or script; None if it names none."""
    part = re.split(r"[-_]", (label or "").strip().lower())[0]
    if part in _NONE:
        return None
    if re.fullmatch(r"[a-z]{2}", part):
        return part
    return THREE.get(part)


# Ranges of scripts that few languages write.
_SCRIPTS = {
    "arabic": r"\u0600-\u06ff\u0750-\u077f", "devanagari": r"\u0900-\u097f", "thai": r"\u0e00-\u0e7f", "hangul": r"\uac00-\ud7af\u1100-\u11ff",
    "kana": r"\u3040-\u30ff", "hebrew": r"\u0590-\u05ff", "greek": r"\u0370-\u03ff", "cyrillic": r"\u0400-\u04ff", "han": r"\u3400-\u9fff",
}
_SCRIPT = re.compile("|".join(f"([{chars}]+)" for chars in _SCRIPTS.values()))
_SCRIPT_NAMES = ("", *_SCRIPTS)


def _script_letters(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    if max(text, default="") < "\u0370":  # Latin
        return found
    for m in _SCRIPT.finditer(text.replace(" ", "")):
        name = _SCRIPT_NAMES[m.lastindex]
        found[name] = found.get(name, 0) + m.end() - m.start()
    return found


def _drop_technical(m: re.Match) -> str:
    return " " if _TECHNICAL.search(m.group()) else m.group()


#: every ASCII character that is no letter, as a blank
_ASCII_LETTERS = {c: chr(c) if chr(c).isalpha() else " " for c in range(128)}


def features(sentence: str) -> str:
    """The text whose n-grams count: letters and single blanks, without numbers, addresses and identifiers."""
    s = (_ASCII_RUN.sub(_drop_technical, sentence) if _TECHNICAL.search(sentence) else sentence).lower()
    if s.isascii():
        return " " + " ".join(s.translate(_ASCII_LETTERS).split()) + " "
    return " " + " ".join(_NOT_LETTERS.sub(" ", unicodedata.normalize("NFKC", s)).split()) + " "


def _plain(text: str) -> str:
    """Without accents, as carelessly typed text is."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f"))


_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: characters whose n-grams are looked up at once
SLICE = 60_000


@lru_cache(maxsize=4)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        tables = []
        for factor in (int(_P), pow(int(_P), -1, 1 << 64)):
            steps = np.full(size, np.uint64(factor))
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
    return tables[0], tables[1]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2 ** 64."""
    power, back = _power_table(max(SLICE * 2, 1 << max(1, size - 1).bit_length()))
    return power[:size], back[:size]


class _Grams:
    """n-grams and words of many sentences as hashes, for whole arrays at once."""

    def __init__(self, texts: list[str], orders: tuple[int, ...] = ORDERS):
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        hashes, counts = [], []
        with np.errstate(over="ignore"):
            h = np.zeros(len(c), np.uint64)
            for n in ORDERS:
                m = len(c) - n + 1
                if m <= 0:
                    break
                h = h[:m] * _P + c[n - 1 :] + np.uint64(1)  # one character more each time
                if n not in orders:
                    continue
                inside = np.ones(len(c), bool)
                for k in range(1, n):  # not across the end of a sentence
                    inside[np.maximum(ends - k, ends - sizes)] = False
                mine = np.maximum(sizes - (n - 1), 0)
                inside[(ends - 1)[(sizes > 0) & (mine == 0)]] = False
                hashes.append(((h ^ np.uint64(n)) * _MIX)[inside[:m]])
                counts.append(mine)
            # words: between blanks, of which a sentence begins and ends with one
            blank = np.flatnonzero(c == 32)
            left, right = blank[:-1] + 1, blank[1:]
            word = right > left
            left, right = left[word], right[word]
            # of a word of any length: the difference of two prefix sums, brought to its own place
            power, back = _powers(len(c))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * power, dtype=np.uint64)))
            total = (sums[right] - sums[left]) * back[left]
            hashes.append((total ^ np.uint64(77)) * _MIX)
            counts.append(np.diff(np.searchsorted(left, np.concatenate((ends - sizes, ends[-1:])))))
        #: of each kind how many each sentence has, one sentence behind the other
        self.counts = counts
        self.kinds = [len(x) for x in hashes]
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


class Model:
    """Log-probabilities of n-grams and words by language; rows are found through a hash table."""

    def __init__(self, samples: list[tuple[str, str]], least: float = FIRST_KNOWN):
        self.least = least
        self.langs = sorted({lang for lang, _ in samples})
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.all = tuple(range(len(self.langs)))
        self.writers = self._script_writers(samples)
        self._narrow: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
        forms = [(at[lang], f) for lang, text in samples for f in {features(text), _plain(features(text))} if len(f) > 2]
        kinds = len(ORDERS) + 1
        parts: list[list[np.ndarray]] = [[] for _ in range(kinds)]
        owner_lang = np.array([k for k, _ in forms], np.int64)
        langs_of: list[list[np.ndarray]] = [[] for _ in range(kinds)]
        for s in range(0, len(forms), 500):
            g = _Grams([f for _, f in forms[s : s + 500]])
            ends = np.cumsum([0, *g.kinds])
            for k in range(len(g.kinds)):
                kind = kinds - 1 if k == len(g.kinds) - 1 else k
                parts[kind].append(g.hashes[ends[k] : ends[k + 1]])
                langs_of[kind].append(np.repeat(owner_lang[s : s + 500], g.counts[k]))
        keys, rows, known = [], [], []
        n_lang = len(self.langs)
        for kind in range(kinds):
            if not parts[kind]:
                continue
            u, inv = np.unique(np.concatenate(parts[kind]), return_inverse=True)
            count = np.bincount(inv * n_lang + np.concatenate(langs_of[kind]), minlength=len(u) * n_lang).reshape(len(u), n_lang).astype(float)
            keys.append(u)
            rows.append(np.log((count + ALPHA) / (count.sum(0) + ALPHA * (len(u) + 1))))
            known.append((count > 0) & (kind == len(ORDERS) - 1))
        self.table = np.concatenate([*rows, np.zeros((1, n_lang))]).astype(np.float32)
        self.known = np.concatenate([*known, np.zeros((1, n_lang), bool)])
        self._fill(np.concatenate(keys) if keys else np.zeros(0, np.uint64))

    def _script_writers(self, samples: list[tuple[str, str]]) -> dict[str, tuple[int, ...]]:
        """The languages whose samples use a script ("" is Latin) for more than a little."""
        total = dict.fromkeys(self.langs, 0)
        used: dict[str, dict[str, int]] = {name: {} for name in ("", *_SCRIPTS)}
        for lang, text in samples:
            form = features(text)
            found = _script_letters(form)
            letters = len(form) - form.count(" ")
            total[lang] += letters
            for name, n in (found | {"": letters - sum(found.values())}).items():
                used[name][lang] = used[name].get(lang, 0) + n
        # names and terms in Latin letters are no sign of a language that writes in them
        return {name: tuple(k for k, lang in enumerate(self.langs) if by.get(lang, 0) > (0.5 if not name else 0.02) * total[lang]) for name, by in used.items()}

    def _writers(self, text: str) -> tuple[int, tuple[int, ...]]:
        """(the only language that writes the script of a sentence or -1, else the languages that may)."""
        found = {} if text.isascii() else _script_letters(text)
        letters = max(1, len(text) - text.count(" "))
        own = {self.writers[name][0] for name, n in found.items() if len(self.writers[name]) == 1 and n >= OWN_SCRIPT * letters}
        if len(own) == 1:
            return own.pop(), ()
        some = [name for name, n in found.items() if n >= OWN_SCRIPT * letters]
        if not some:
            return -1, self.writers[""] or self.all
        both = sorted({k for name in some for k in self.writers[name]})
        return -1, tuple(both) or self.all

    def _fill(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys, np.uint64(0))
        todo = np.arange(len(keys))
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        mask = (1 << self.bits) - 1
        while len(todo):  # of those that want a free slot one gets it; the rest move on
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slots[at[won]] = todo[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & mask

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, the last for unknown ones."""
        out = np.full(len(h), len(self.table) - 1, np.int32)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        mask = (1 << self.bits) - 1
        todo, mine = None, h
        while len(mine):
            row = self.slots.take(at)
            taken = row >= 0
            hit = taken & (self.keys.take(row, mode="clip") == mine)
            if todo is None:  # the first look, for all
                np.copyto(out, row, where=hit)
                todo = np.flatnonzero(taken & ~hit)
                at, mine = (at[todo] + 1) & mask, h[todo]
                continue
            out[todo[hit]] = row[hit]
            on = np.flatnonzero(taken & ~hit)
            todo, at, mine = todo[on], (at[on] + 1) & mask, mine[on]
        return out

    def scores(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood by language up to a constant, whether the sentence is in a language at all).

        It isn't if it has no letters, or if it is alphabetic and hardly a longest n-gram
        of it occurs in any language (scrambled letters, keys, encoded data).
        """
        texts = [features(s) for s in sentences]
        ll = np.zeros((len(texts), len(self.langs)))
        ok = np.zeros(len(texts), bool)
        if not self.langs:
            return ll, ok
        groups: dict[tuple[int, ...], list[int]] = {}  # those whose script leaves several languages, by these
        for i, t in enumerate(texts):
            owner, some = self._writers(t)
            if owner < 0:
                groups.setdefault(some, []).append(i)
            elif len(t) > 2:
                ll[i], ll[i, owner], ok[i] = SETTLED, 0.0, True
        for some, members in groups.items():
            rest = [texts[i] for i in members]
            part, good = np.zeros((len(rest), len(some))), np.zeros(len(rest), bool)
            sizes = np.cumsum([0, *map(len, rest)])
            s = 0
            while s < len(rest):
                e = max(s + 1, int(np.searchsorted(sizes, sizes[s] + SLICE, "right")) - 1)
                self._slice(rest[s:e], part[s:e], good[s:e], some)
                s = e
            mine = np.repeat(part.min(1, keepdims=True) + SETTLED, len(self.langs), 1)
            # no evidence is none for any language
            mine[:, list(some)] = part
            mine[~part.any(1)] = 0.0
            ll[members], ok[members] = mine, good
        return ll, ok

    def _columns(self, some: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The table's columns of some languages, each in one piece; made once in each process."""
        if some not in self._narrow:
            self._narrow[some] = np.ascontiguousarray(self.table.T[list(some)]), np.ascontiguousarray(self.known.T[list(some)].view(np.int8))
        return self._narrow[some]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_narrow": {}}

    def _slice(self, texts: list[str], ll: np.ndarray, ok: np.ndarray, some: tuple[int, ...]) -> None:
        table, known = self._columns(some)
        # single letters tell languages of one alphabet hardly apart
        orders = ORDERS if set(some) & set(self.writers["han"]) or some == self.all else ORDERS[1:]
        g = _Grams(texts, orders)
        row = self._find(g.hashes)  # the last row, of zeros, for unknown ones
        seen = np.zeros(len(texts), np.int64)
        ends = np.cumsum([0, *g.kinds])
        for k, many in enumerate(g.counts):
            there = np.flatnonzero(many)
            if not len(there):
                continue
            first = (np.cumsum(many) - many)[there]
            r = row[ends[k] : ends[k + 1]]
            ll[there] += np.add.reduceat(table.take(r, 1, mode="clip"), first, axis=1).T
            if k == 0:  # where none of the shortest is known, nothing is
                ok[there] = np.minimum.reduceat(r, first) < len(self.table) - 1
            if k == len(orders) - 1:
                seen[there] = np.add.reduceat(known.take(r, 1, mode="clip"), first, axis=1, dtype=np.int32).max(0)
        for i, t in enumerate(texts):
            longest = len(t) - max(ORDERS) + 1
            if len(t) < 3 or (longest >= 12 and t.isascii() and seen[i] < self.least * longest):
                ok[i] = False


def fit_mixture(scores: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions over sentences (rows of scores); returns (proportions, posteriors).

    The set of languages is chosen by penalised likelihood: from the set of those likeliest
    in some sentence languages come in, leave or change places as long as that raises it;
    then every single language and every pair that could still do better is tried as
    another start.  A set can't do better than its languages' best likelihoods less the
    penalty, nor a further language earn more than the likelihood's slope towards it, so
    most need no EM; where one language is likeliest in every sentence no set can beat it.
    """
    ll = scores * TEMPER
    ll = ll - ll.max(1, keepdims=True)
    like = np.exp(np.maximum(ll, -600))
    full = np.zeros(scores.shape[1])
    winners = tuple(np.unique(ll.argmax(1)).tolist())
    if len(winners) == 1:
        full[winners[0]] = 1.0
        return full, np.broadcast_to(full, scores.shape)
    fitted: dict[tuple[int, ...], tuple[float, np.ndarray]] = {}

    def em(use: tuple[int, ...]) -> tuple[float, np.ndarray]:
        if use not in fitted:
            part = like[:, use] + 1e-300
            pi = np.full(len(use), 1 / len(use))
            for _ in range(EM_ROUNDS if len(use) > 1 else 0):
                post = part * pi
                post /= post.sum(1, keepdims=True)
                pi = (post * weights[:, None]).sum(0) + 1e-9
                pi /= pi.sum()
            # alone, a language's likelihood is known without the floor of the exponential
            value = float(np.log((part * pi).sum(1)).sum()) if len(use) > 1 else float(ll[:, use[0]].sum())
            fitted[use] = value - PENALTY * len(use), pi
        return fitted[use]

    def better(sets: list[tuple[float, tuple[int, ...]]], value: float) -> tuple[int, ...] | None:
        """The best set of more than a value, by falling bound."""
        best = None
        for bound, other in sorted(sets, reverse=True):
            if bound <= value + 1e-9:
                break
            if em(other)[0] > value + 1e-9:
                value, best = em(other)[0], other
        return best

    def climb(use: tuple[int, ...]) -> tuple[int, ...]:
        while True:
            value, pi = em(use)
            sets: list[tuple[float, tuple[int, ...]]] = []
            slope = (like / ((like[:, use] * pi).sum(1) + 1e-300)[:, None]).sum(0) - len(ll)
            for gone in (None, *use):
                rest = tuple(k for k in use if k != gone)
                top = ll[:, rest].max(1) if rest else np.full(len(ll), -np.inf)
                if gone is not None and rest:
                    sets.append((float(top.sum()) - PENALTY * len(rest), rest))
                reach = np.maximum(top[:, None], ll).sum(0) - PENALTY * (len(rest) + 1)
                if gone is None:
                    reach = np.minimum(reach, value + np.maximum(slope, slope[list(use)].max()) - PENALTY)
                sets += [(float(reach[k]), tuple(sorted((*rest, k)))) for k in np.flatnonzero(reach > value + 1e-9).tolist() if k not in use]
            best = better(sets, value)
            if best is None:
                return use
            use = best

    keep = climb(winners)
    while True:
        value = em(keep)[0]
        sets = [(float(v), (k,)) for k, v in enumerate(ll.sum(0) - PENALTY) if v > value]
        if -2 * PENALTY > value:  # no likelihood is above 0, so pairs may matter
            for i in range(ll.shape[1] - 1):
                reach = np.maximum(ll[:, i : i + 1], ll[:, i + 1 :]).sum(0) - 2 * PENALTY
                sets += [(float(reach[j]), (i, i + 1 + j)) for j in np.flatnonzero(reach > value).tolist()]
        other = better(sets, value)
        if other is None:
            break
        keep = climb(other)
    full[list(keep)] = em(keep)[1]
    post = like * full
    total = post.sum(1, keepdims=True)
    lost = total[:, 0] <= 0
    post[lost] = full
    return full, post / np.where(lost[:, None], 1, total)


def sentences_with_language(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """(payload, start, end, sentence) of the sentences that may have a language."""
    out = []
    for k, text in enumerate(texts):
        for a, b in sentence_spans(text):
            s = text[a:b]
            if not _LOG_LINE.match(s):
                out.append((k, a, b, s))
    return out


def segment(model: Model, texts: list[str | None]) -> list[dict]:
    """Maximal runs of sentences in one language, in order."""
    return segment_all(model, [texts])[0]


def segment_all(model: Model, documents: list[list[str | None]]) -> list[list[dict]]:
    """The segments of each document; the n-grams of all of them are looked up together."""
    found = [sentences_with_language(texts) for texts in documents]
    ll, ok = model.scores([s for part in found for *_, s in part])
    out, at = [], 0
    for part in found:
        n = len(part)
        use = np.flatnonzero(ok[at : at + n])
        out.append(_runs(model.langs, [part[i][:3] for i in use], ll[at : at + n][use]))
        at += n
    return out


def _runs(langs: list[str], found: list[tuple[int, int, int]], scores: np.ndarray) -> list[dict]:
    if not found:
        return []
    weights = np.array([max(1, b - a) for _, a, b in found], float)
    mix, post = fit_mixture(scores, weights)
    out: list[dict] = []
    for (k, a, b), p, w in zip(found, post, weights):
        best = int(p.argmax())
        if out and out[-1]["lang"] == langs[best]:
            seg = out[-1]
            seg["payload_end"], seg["end_pos"] = k, b
            seg["sentences"] += 1
            seg["_w"] += w
            seg["_c"] += w * float(p[best])
        else:
            out.append({"seg_no": len(out), "lang": langs[best], "payload_no": k, "start_pos": a, "payload_end": k, "end_pos": b, "sentences": 1, "share": float(mix[best]), "_w": w, "_c": w * float(p[best])})
    for seg in out:
        seg["confidence"] = seg.pop("_c") / seg.pop("_w")
    return out


SCHEMA = "doc_key string, label string, seg_no int, lang string, confidence double, share double, payload_no int, start_pos int, payload_end int, end_pos int, sentences int, segments int"
_ARROW = pa.schema(
    [("doc_key", pa.string()), ("label", pa.string()), ("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("share", pa.float64())]
    + [(n, pa.int32()) for n in ("payload_no", "start_pos", "payload_end", "end_pos", "sentences", "segments")]
)


def refine(model: Model, samples: list[tuple[str, str]], labelled: list[tuple[str, list[str | None]]]) -> Model:
    """Fit again with the sentences of labelled documents.

    Where label and first model agree on at least MOSTLY of a document's sentences all
    of them count, so that wordings the samples lack are learned; else only those on
    which they agree, as the label may be wrong or the document mixed.
    """
    docs = [(lang, [s for *_, s in sentences_with_language(texts)]) for lang, texts in labelled if lang in model.langs]
    flat = [s for _, part in docs for s in part]
    if not flat:
        return model
    ll, ok = model.scores(flat)
    best = ll.argmax(1)
    more, at = [], 0
    for lang, part in docs:
        use, agree = ok[at : at + len(part)], best[at : at + len(part)] == model.langs.index(lang)
        whole = use.any() and agree[use].mean() >= MOSTLY
        more += [(lang, s) for s, u, a in zip(part, use, agree) if u and (a or whole)]
        at += len(part)
    return Model(samples + more, MIN_KNOWN)


def fit_model(store_docs: DataFrame, lang_samples: DataFrame, sample_limit: int = SAMPLE_LIMIT, labelled_limit: int = LABELLED_LIMIT) -> Model:
    """n-gram models from the samples, then once more with a bounded sample of labelled documents.

    Taken are at most ``sample_limit`` samples a language (lowest sample_id first) and at
    most ``labelled_limit`` documents for each two letters that labels start with, of at most ``LABELLED_CHARS`` characters
    (lowest hash of the key first), so the driver holds a bounded amount at any scale.
    """
    by = Window.partitionBy("lang").orderBy("sample_id")
    kept = lang_samples.where("lang is not null and text is not null").select("lang", "text", "sample_id", F.row_number().over(by).alias("r")).where(F.col("r") <= sample_limit)
    samples = [(r.lang, r.text) for r in kept.select("lang", "text").collect()]
    model = Model(samples)
    texts = F.expr("transform(payloads, p -> if(p.modality = 'text', p.data, null))")
    chars = F.expr("aggregate(payloads, 0, (n, p) -> n + coalesce(length(p.data), 0))")
    docs = store_docs.where(F.expr("metadata['lang'] is not null") & (chars <= LABELLED_CHARS)).select("doc_key", F.expr("metadata['lang']").alias("label"), F.xxhash64("doc_key").alias("h"), texts.alias("texts"))
    pick = Window.partitionBy(F.substring(F.lower(F.trim("label")), 1, 2)).orderBy("h", "doc_key")
    rows = docs.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= labelled_limit).select("label", "texts").collect()
    return refine(model, samples, [(label_code(r.label) or "", r.texts) for r in rows])


def language_segments(store_docs: DataFrame, lang_samples: DataFrame, sample_limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Segments of every document's current version with language, confidence and position.

    The n-gram models are fitted on bounded samples (see fit_model); every document is scored.
    """
    model = fit_model(store_docs, lang_samples, sample_limit)
    shared = store_docs.sparkSession.sparkContext.broadcast(model)
    docs = current_documents(store_docs).select(
        "doc_key", F.expr("metadata['lang']").alias("label"),
        F.expr("transform(payloads, p -> if(p.modality = 'text', p.data, null))").alias("texts"),
    ).where(F.size("texts") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
            rows = []
            docs = batch.to_pylist()
            for r, segs in zip(docs, segment_all(m, [r["texts"] or [] for r in docs])):
                rows += [{"doc_key": r["doc_key"], "label": label_code(r["label"]), **s, "segments": len(segs)} for s in segs]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.mapInArrow(run, SCHEMA)


def document_languages(store_docs: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """One row a document: its main language, that language's share and the languages it holds."""
    segs = language_segments(store_docs, lang_samples)
    return segs.groupBy("doc_key").agg(
        F.max_by("lang", F.struct("share", "confidence")).alias("lang"), F.max("share").alias("share"),
        F.array_sort(F.collect_set("lang")).alias("langs"), F.first("segments").alias("segments"),
    )


def wrongly_labelled(store_docs: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """Segments of the documents whose label is missing or wrong or that hold several languages."""
    segs = language_segments(store_docs, lang_samples)
    case = F.col("label").isNull() | (F.col("segments") > 1) | (F.col("label") != F.col("lang"))
    return segs.where(case).select("doc_key", "seg_no", "lang")
