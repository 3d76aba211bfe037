"""Statistics of each text and its kind: prose, table, list or junk.

A text is cut into segments: its lines, with hard-wrapped lines joined again. A segment's tokens fall into classes
(function word, other word, number, separator, bullet, sentence end, garbled, unconnected word); its distribution over
them is compared with fixed structural profiles by Jensen-Shannon divergence and the nearest profile names it. The
kind that holds most of the characters is the text's kind; a text that mostly repeats itself is junk. The function words
of the whole text are compared with the profile of each language in the same way; what looks like prose but is near
none of them, as letters set apart are, is junk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Frequent function words of nine languages, lower case.
FUNCTION_WORDS = {
    "en": "the of and to in a an that is was for as by with on at from our we may would if be are has have had were or which this it its their not no but while because although however so than under since until during into about between also they he she i you your can could should will been there these those what when where how who does did do".split(),
    "fr": "le la les l de des du d un une et en à au aux que qui pour par avec dans sur est a ont sont ce cette ces son sa ses leur leurs ne pas plus selon malgré sans il elle nous vous comme mais ou où si se s n qu même durant pendant depuis entre été".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und in im ist sind war wurde auf für mit von vom zu zum zur nicht sich auch als an am bei durch aus nach über unter wegen trotz obwohl oder aber wie es er sie wir ihr ab vor seit haben hat".split(),
    "es": "el la los las un una unos unas de del y e en a al que por para con se su sus es son fue ha han no lo como más pero según sin sobre desde durante aunque pese este esta esto entre".split(),
    "pt": "o a os as um uma uns umas de do da dos das e em no na nos nas que por pela pelo para com se seu sua é são foi tem não como mais mas segundo sem sobre desde durante embora apesar este esta isto entre ao à".split(),
    "it": "il lo la i gli le un uno una di del della dei delle e in nel nella a al alla che per con su da dal dalla si è sono non come più ma secondo senza durante anche questo questa tra fra".split(),
    "nl": "de het een en van in is op te dat die voor met niet aan zijn er om ook als bij door naar uit over onder tegen maar of wordt werd heeft hebben deze dit".split(),
    "sv": "och att det i en ett på är av för med den till inte om har som var men de från vid under efter kan".split(),
    "pl": "i w na z do się nie że to jest o jak po za od przez dla oraz są był było ale lub przy".split(),
}
EVERY_FUNCTION_WORD = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)

CLASSES = ("function", "word", "number", "separator", "bullet", "end", "garbled", "loose")
FN, WORD, NUM, SEP, BULLET, END, GARBLED, LOOSE, WIDE = range(9)
# How the token classes are distributed in each structure.
PROFILES = (
    ("prose", {"function": 0.25, "word": 0.58, "number": 0.07, "separator": 0.01, "bullet": 0.01, "end": 0.06, "garbled": 0.02}),
    ("prose", {"function": 0.15, "word": 0.66, "number": 0.08, "end": 0.09, "garbled": 0.02}),
    ("table", {"function": 0.01, "word": 0.33, "number": 0.62, "separator": 0.03, "garbled": 0.01}),
    ("table", {"function": 0.01, "word": 0.25, "number": 0.35, "separator": 0.37, "garbled": 0.02}),
    ("table", {"number": 0.92, "word": 0.04, "separator": 0.04}),
    ("table", {"word": 0.7, "number": 0.05, "separator": 0.25}),
    ("list", {"function": 0.02, "word": 0.80, "number": 0.01, "separator": 0.01, "bullet": 0.14, "garbled": 0.02}),
    ("list", {"function": 0.02, "word": 0.92, "number": 0.03, "end": 0.02, "garbled": 0.01}),
    ("list", {"function": 0.14, "word": 0.62, "number": 0.22, "garbled": 0.02}),
    ("list", {"function": 0.02, "word": 0.62, "number": 0.33, "garbled": 0.03}),
    ("junk", {"function": 0.08, "word": 0.34, "number": 0.08, "end": 0.02, "separator": 0.03, "garbled": 0.45}),
    ("junk", {"word": 0.05, "number": 0.05, "separator": 0.05, "garbled": 0.85}),
    ("junk", {"word": 0.13, "number": 0.40, "garbled": 0.47}),
    ("junk", {"loose": 0.97, "function": 0.01, "number": 0.01, "garbled": 0.01}),
    ("junk", {"separator": 0.95, "garbled": 0.05}),
)
KINDS = ("prose", "table", "list", "junk")
_P = np.array([[p.get(c, 0.0) for c in CLASSES] for _, p in PROFILES])
_P = (_P + 1e-4) / (_P + 1e-4).sum(axis=1, keepdims=True)
_KIND = np.array([KINDS.index(k) for k, _ in PROFILES])

#: The function words of every language, and how each language's prose spreads over them: by rank, as 1 / (rank + 2).
_VOCABULARY = {w: i for i, w in enumerate(sorted(EVERY_FUNCTION_WORD))}
_LANGUAGES = np.zeros((len(FUNCTION_WORDS), len(_VOCABULARY)))
for _k, _ws in enumerate(FUNCTION_WORDS.values()):
    for _r, _w in enumerate(dict.fromkeys(_ws)):
        _LANGUAGES[_k, _VOCABULARY[_w]] = 1 / (_r + 3)
_LANGUAGES /= _LANGUAGES.sum(axis=1, keepdims=True)
#: Texts of fewer function words are not held against the languages; n of them may diverge by FAR + 1 / sqrt(n) bits.
LEAST_FUNCTION_WORDS, FAR = 20, 0.5

_WORD = re.compile(r"[^\W\d_]+(?:[-'’./&][^\W\d_]+)*")
_NUMBER = re.compile(r"[-+~]?[$€£¥]?[-+]?\d[\d.,:/\-]*(?:%|[kKmMbB]|st|nd|rd|th)?")
_SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~•·–—“”‘’…€£�"
_TAG = re.compile(r"</?(?:p|br|div|span|b|i|u|em|strong|a|h[1-6]|ul|ol|li|font|center|sup|sub|table|thead|tbody|tr|td|th|hr)\b[^<>]{0,300}>", re.I)
_CELLS = re.compile(r"[|\t]| {4,}| \.\.\. |\d[,;]\d+[,;]\d")
_HEX = re.compile(r"(?:[0-9a-f]{2}){1,8}|(?:[0-9A-F]{2}){1,8}")
_OPEN, _CLOSE = "\"'“”‘’«»„([{¿¡*_", "\"'“”‘’«»)]}.,;:!?…*_"
_BROKEN = ("â€", "Ã", "Â", "ï¿½", "�")


def token_class(t: str) -> int:
    """The class of one token."""
    if t in ("•", "·", "‣", "▪", "◦", "●", "○", "*", "–", "o"):
        return BULLET if t != "o" else FN
    if t in ("-", "—", "--"):
        return SEP
    if any(b in t for b in _BROKEN):
        plain = sum(c.isascii() and c.isalpha() for c in t)
        return WORD if plain >= 4 and plain * 2 > len(t) else GARBLED
    core = t.lstrip(_OPEN).rstrip(_CLOSE)
    ends = t.rstrip("\"'”’»)]}")[-1:] in (".", "!", "?", "…", "。", "！", "？", "।", "؟")
    if not core:
        return SEP if len(set(t)) <= 2 else GARBLED
    low = core.lower()
    if low in EVERY_FUNCTION_WORD:
        return END if ends and len(low) > 2 else FN
    if _NUMBER.fullmatch(core) or _NUMBER.fullmatch(core.strip("()$%")):
        return NUM
    if not core.isascii() and sum(c > "฀" and c.isalpha() for c in core) >= 4:
        return WIDE  # scripts without spaces: a token is a clause
    if len(core) <= 30 and _WORD.fullmatch(core):
        body = core.replace("GmbH", "").replace("McD", "D")
        if any(a.islower() and b.isupper() for a, b in zip(body, body[1:])) and len(core) >= 5:
            return GARBLED
        return END if ends and len(core) > 1 else WORD
    if len(core) <= 30 and core[:-1].isalpha() and core[-1:].isdigit():
        return WORD
    if len(set(core)) <= 2 and not any(c.isalnum() for c in core):
        return SEP
    return GARBLED


class _Classes(dict):
    """Classes of tokens seen lately."""

    def __missing__(self, t: str) -> int:
        if len(self) > 500_000:
            self.clear()
        c = self[t] = token_class(t)
        return c


_class_of = _Classes()


class _Places(dict):
    """Places of tokens seen lately in the vocabulary of function words, its length for others."""

    def __missing__(self, t: str) -> int:
        if len(self) > 500_000:
            self.clear()
        k = self[t] = _VOCABULARY.get(t.lstrip(_OPEN).rstrip(_CLOSE).lower(), len(_VOCABULARY))
        return k


class _Hex(dict):
    """Whether tokens seen lately are pairs of hexadecimal digits."""

    def __missing__(self, t: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        k = self[t] = _HEX.fullmatch(t) is not None
        return k


_place_of, _is_hex = _Places(), _Hex()
_BEYOND = re.compile(r"[^\x00-\x7f]")
_ITEM = re.compile(r"\s*(?:[•·‣▪◦●○*–—-]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)]|(?:Note|Exhibit|Schedule|Annex|Appendix|Item|Section|Part)\s+[\dA-Z][\w.]*)\s+")


def segments(text: str) -> list[str]:
    """The lines that hold something; lines broken at a fixed width are joined again.

    Neighbouring lines belong together if none of them, the last excepted, had room for the first word of the next
    within the longest of them; each paragraph may have its own width.
    """
    lines = [x.strip("\r\n ") for x in text.splitlines()]
    out: list[str] = []
    i = 0
    while i < len(lines):
        x = lines[i]
        if not x:
            i += 1
            continue
        j, most, room = i, len(x), 1 << 30
        if most >= 34 and most <= 140 and not _CELLS.search(x):
            while j + 1 < len(lines) and lines[j + 1]:
                y = lines[j + 1]
                m = max(most, len(y))
                r = min(room, len(lines[j]) + 1 + len(y.split(None, 1)[0]))
                if m > 140 or r <= m or _CELLS.search(y) or _ITEM.match(y):
                    break
                j, most, room = j + 1, m, r
        if j - i >= 2 or (j - i == 1 and most >= 40 and (lines[j][0].islower() or lines[j][0] in "$(")):
            out.append(" ".join(lines[i : j + 1]))
            i = j + 1
        else:
            out.append(x)
            i += 1
    return out


def tokens(s: str) -> list[str]:
    """The tokens of a segment; cells of a delimited row come apart."""
    digits = sum(map(s.count, "0123456789")) + (0 if s.isascii() else sum(map(str.isdigit, _BEYOND.findall(s))))
    if ("|" in s or "\t" in s or ";" in s or s.count(",") >= 2) and (digits > 0.2 * len(s) or s[:1] in ",;|\t" or (s.count("-") + digits > 0.12 * len(s) and len(s.split()) <= 8)):
        return [x for x in re.split(r"[\s|;,]+", s) if x] + ["|"] * (s.count("|") + s.count("\t") + s.count(";"))
    return s.split()


def features(text: str) -> tuple[np.ndarray, np.ndarray, dict]:
    """(class counts of each segment, its characters, basic counts)."""
    stripped = _TAG.sub(" ", text) if "<" in text else text
    tags = len(text) - len(stripped)
    parts = segments(stripped)
    counts, sizes = np.zeros((len(parts) + 1, 9)), np.zeros(len(parts) + 1)
    words: list[str] = []
    short = ended = common = 0
    for i, s in enumerate(parts):
        toks = tokens(s)
        items = _ITEM.match(s)
        codes = bytes([_class_of[t] for t in toks])
        if len(toks) >= 6 and sum([_is_hex[t] for t in toks]) > 0.8 * len(toks) and any(c.isalpha() for t in toks for c in t):
            codes = bytes([GARBLED] * len(toks))
        c = counts[i]
        for k in range(9):
            c[k] = codes.count(k)
        common += codes.count(FN)
        if toks and toks[-1:] and codes[-1] == END and len(toks) <= 3:
            c[END] -= 1  # a full stop after a short entry makes no sentence
            c[WORD] += 1
        if items and c[FN] < 0.12 * len(toks):
            c[BULLET] += 1
        if len(toks) > 12 and c[FN] + c[END] < 0.06 * len(toks) and c[WORD] > 0.8 * len(toks):
            c[LOOSE], c[WORD] = c[WORD] + c[END], 0
            c[END] = 0
        if c[WIDE]:
            n, c[WIDE] = c[WIDE], 0
            c[FN] += n * 2
            c[WORD] += n * 4
            c[END] += n * 0.5
        if 2 <= len(toks) <= 9 and c[FN] <= 0.25 * len(toks) and c[END] == 0 and c[NUM] + c[GARBLED] <= 0.5 * len(toks):
            c[BULLET] += 0.08 * len(toks)
        sizes[i] = len(s)
        short += len(toks) <= 8
        ended += s.rstrip()[-1:] in (".", "!", "?", ":", ";", "…", "。", "”", '"')
        words += toks
    if tags:
        counts[-1, GARBLED], sizes[-1] = tags / 6, tags
    places = np.bincount([_place_of[t] for t in words], minlength=len(_VOCABULARY) + 1)[:-1] if words else np.zeros(len(_VOCABULARY))
    n = len(words)
    letters = sum(map(len, words))
    return counts, sizes, {
        "places": places,
        "n_words": n,
        "mean_word_length": letters / n if n else 0.0,
        "symbol_ratio": sum(map(text.count, _SYMBOLS)) / len(text) if text else 0.0,
        "ended_lines": ended / len(parts) if parts else 0.0,
        "short_lines": short / len(parts) if parts else 0.0,
        "common_words": common / n if n else 0.0,
        "distinct_grams": len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0,
    }


def divergences(counts: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row's distribution from each profile."""
    p = counts[:, :8] + 1e-6
    p = p / p.sum(axis=1, keepdims=True)
    m = (p[:, None, :] + _P[None]) / 2
    return 0.5 * (p[:, None, :] * np.log2(p[:, None, :] / m)).sum(axis=2) + 0.5 * (_P[None] * np.log2(_P[None] / m)).sum(axis=2)


def language_divergences(places: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of function word counts from the nearest language; nan without any."""
    n = places.sum(axis=1)
    i, j = np.nonzero(places)
    p = places[i, j] / n[i]
    out = np.full(len(places), np.inf)
    for q in _LANGUAGES:  # a word that the text lacks adds half its share of the profile
        qj = q[j]
        m = (p + qj) / 2
        d = p * np.log2(p / m) + np.where(qj > 0, qj * np.log2(np.maximum(qj, 1e-300) / m), 0) - qj
        out = np.minimum(out, 0.5 * (1 + np.bincount(i, d, minlength=len(places))))
    return np.where(n > 0, out, np.nan)


STATS = "doc_id long, n_chars_found long, n_words long, mean_word_length double, symbol_ratio double, ended_lines double, short_lines double, common_words double, distinct_grams double, prose_divergence double, language_divergence double, prose_share double, table_share double, list_share double, junk_share double, text_kind string"
_NAMES = ("n_words", "mean_word_length", "symbol_ratio", "ended_lines", "short_lines", "common_words", "distinct_grams")


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        rows: list[tuple] = []
        for a in range(0, len(texts), 500):
            some = texts[a : a + 500]
            got = [features(t or "") for t in some]
            ends = np.cumsum([len(g[0]) for g in got]) if got else []
            if not len(ends):
                continue
            counts = np.concatenate([g[0] for g in got])
            d = divergences(counts)
            kind = np.where(counts[:, :8].sum(axis=1) > 0, _KIND[d.argmin(axis=1)], -1)
            wholes = divergences(np.stack([g[0].sum(axis=0) for g in got]))[:, _KIND == 0].min(axis=1).tolist()
            places = np.stack([g[2]["places"] for g in got])
            foreign, n_places = language_divergences(places), places.sum(axis=1)
            for t, g, e, far, n, near in zip(some, got, ends, foreign.tolist(), n_places.tolist(), wholes):
                s = e - len(g[0])
                shares = np.array([g[1][kind[s:e] == k].sum() for k in range(4)])
                if n >= LEAST_FUNCTION_WORDS and far > FAR + n**-0.5:
                    shares[3] += shares[0]
                    shares[0] = 0
                total = shares.sum()
                shares = shares / total if total else np.zeros(4)
                said = KINDS[int(shares.argmax())] if total else "junk"
                f = g[2]
                if f["n_words"] >= 9 and f["distinct_grams"] < 0.3:
                    said = "junk"
                rows.append((len(t or ""), *(f[k] for k in _NAMES), near, None if far != far else far, *map(float, shares), said))
        if rows:
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 12, pa.string()]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names=[x.split()[0] for x in STATS.split(", ")])


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts, its divergence from prose, the share of its characters of each kind, its kind.

    Null and blank texts are junk with counts of 0. Map only: no row moves, texts are read whole.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_stats, STATS)
