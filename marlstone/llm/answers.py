"""Defective answers: empty, refusal, copies_question, other_language or truncated, at most one of them each.

A pushdown parser follows fences, brackets, lists, quotations and markup and shows what is still open at the end; whole
JSON lists are read as their items. Greedy string tiling measures how much of an answer is its question. Function words
and scripts give the languages. A grammar of openings, subjects, verb phrases and objects tells a refusal of the
answerer from a filing that reports an inability. An answer that ends without a mark is compared with how the collection's sentences end: whether its last
word occurs elsewhere, ever ends a clause, and at what distance from the last function word sentences end.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.quality import EVERY_FUNCTION_WORD, FUNCTION_WORDS

# Answers without content.
PLACEHOLDERS = frozenset("null nil nan n/a na n.a tbd tba tbc todo pending placeholder unanswered xxx blank empty undefined".split()) | {
    "no answer", "no reply", "not available", "not applicable", "to be determined", "to be done", "to be confirmed", "to be announced", "no response", "no data", "answer missing", "missing answer", "left blank", "insert answer here", "answer here", "your answer",
    "keine angabe", "k.a", "k. a", "sans réponse", "sin respuesta", "sem resposta", "s/r",
}
# Words after which an English, French, German, Spanish or Portuguese phrase goes on.
GOES_ON = {
    "en": "the of and to in a an that is was for as by with on at from our may would if be are has have were or which because although while so than under into between its their his her my your this these those could should will must might shall cannot not but nor during against among".split(),
    "fr": "le la les l de des du d un une et à au aux que qui pour par avec dans sur son sa ses leur leurs sans selon malgré ou si ce cette ces en".split(),
    "de": "der die das den dem des ein eine einen einem einer und im für mit von vom zum zur durch aus wegen trotz obwohl oder dass als am in ihre ihr seine".split(),
    "es": "el la los las un una de del y en a al que por para con su sus sin sobre desde según pese o e como".split(),
    "pt": "o a os as um uma de do da dos das e em no na nos nas que por pela pelo para com sem sobre desde segundo ao à ou seu sua".split(),
}
# Spellings that one language alone has.
CUES = {"pt": r"(ção|ções|ões|ãos?|não|lh|nh|ê|ô)", "es": r"(ñ|¿|¡|ción|ciones|ll|ió\b)", "de": r"(ß|ä|ö|ü|sch|ung\b|keit\b)", "fr": r"(è|ê|œ|ç|eaux?\b|\bl'|\bd'|\bqu'|ée?s?\b)"}
_CUE = {k: re.compile(v, re.I) for k, v in CUES.items()}
_SHARED = Counter(w for ws in FUNCTION_WORDS.values() for w in set(ws))
_WEIGHT = {lang: {w: 1 / _SHARED[w] for w in ws} for lang, ws in FUNCTION_WORDS.items()}
_WORDS = re.compile(r"[^\W_]+(?:[-'’.,][^\W_]+)*")
_YES_NO = re.compile(r"\W*(?:yes|no|oui|non|ja|nein|sí|si|sim|não|true|false)\b", re.I)

# What may stand before a refusal, as words; * is any one word.
LEADS = [
    x.split()
    for x in "i am sorry|i am very sorry|i am so sorry|i am truly sorry|i am afraid|we are sorry|we are afraid|sorry|very sorry|so sorry|to say|apologies|my apologies|our apologies|i apologize|i apologise|unfortunately|regrettably|i regret to say|i regret|i regret that|thank you|thanks|many thanks|thank you very much|for the question|for your question|for this question|for the request|for your request|for the query|for your query|for your message|for the message|"
    "as an ai|as an ai model|as an ai assistant|as an ai language model|as a * model|as a * assistant|as an * assistant|as a * language model|as a large language model|as an assistant|as a model|hello|hi|well|i understand|please note|please note that|however|at this time|at present|but|and|that|je suis désolé|je suis désolée|désolé|désolée|lo siento|leider|es tut mir leid|desculpe|lamento|malheureusement|lamentablemente|infelizmente|mi dispiace".split("|")
    if x
]
_LEADS: dict[str, list[list[str]]] = {}
for _x in sorted(LEADS, key=len, reverse=True):
    _LEADS.setdefault(_x[0], []).append(_x)
# The classes of the refusal grammar's words.
ADVERBS = frozenset("really simply currently personally just respectfully politely kindly also therefore still unfortunately regrettably hereby honestly".split())
MODALS, BE, DO = frozenset("can could will would may shall should might".split()), frozenset("am is are was were be been".split()), frozenset("do does did".split())
DECLINES = frozenset("decline declines declined refuse refuses refused abstain refrain pass".split())
UNABLE, WILLING = frozenset("unable unwilling incapable".split()), frozenset("able allowed permitted authorized authorised going comfortable equipped qualified prepared willing".split())
REPLIES = frozenset("answer respond reply assist help comply comment advise address discuss".split())
GIVES, GIFTS = frozenset("provide give offer share supply make".split()), frozenset("answer answers response reply assessment advice opinion assistance help comment".split())
KNOWS, KNOWLEDGE = frozenset("have know possess see find answer".split()), frozenset("access information answer way knowledge means".split())
REQUESTS = frozenset("question questions request requests query queries topic topics subject matter message prompt one".split())
POINTERS = frozenset("this that it these those your you such the to with on in as because since due without from at regarding about any further".split())
MACHINES = frozenset("system assistant model service bot chatbot tool".split())
SAYS = frozenset("said says stated states told added noted wrote reported warned explained remarked according".split())
# The same in other languages, as patterns of an opening.
ABROAD = re.compile(
    r"\W*(?:je (?:ne (?:peux|puis|suis|dispose|sais)|suis (?:dans l\W?incapacité|incapable|au regret))|ich (?:kann|darf|bin)[^.]{0,60}(?:nicht|leider|keine)|(?:das|dies) kann ich (?:leider )?nicht|(?:yo )?no (?:puedo|me es posible|dispongo|tengo acceso|estoy)|(?:eu )?não (?:posso|consigo|tenho acesso|estou|me é possível)|non posso)",
    re.I,
)
_STEP = re.compile(r"[^\W\d_]+|\d+|[.!?;:,\"“”–—-]")
# Contracted forms.
SHORT = {"cannot": ("can", "not"), "can't": ("can", "not"), "won't": ("will", "not"), "don't": ("do", "not"), "doesn't": ("does", "not"), "didn't": ("did", "not"), "couldn't": ("could", "not"), "wouldn't": ("would", "not"), "i'm": ("i", "am"), "we're": ("we", "are"), "i'll": ("i", "will"), "we'll": ("we", "will"), "i'd": ("i", "would"), "i've": ("i", "have"), "isn't": ("is", "not"), "aren't": ("are", "not"), "that's": ("that", "is"), "it's": ("it", "is")}
_CONTRACTED = re.compile("|".join(sorted((k.replace("'", "['’ʼ]") for k in SHORT), key=len, reverse=True)))
_ASKED = re.compile(r"\W*(?:the question(?: (?:is|was|asked))?|question|q|you (?:asked|ask|want to know|are asking)|asked|query|prompt|frage|pregunta|pergunta|la question|instruction)\s*[:.,–—-]*\s*(?=\S)", re.I)
_SO = re.compile(r"\W*\b(?:answer|a|response|antwort|respuesta|resposta|réponse)\s*:?\s*$", re.I)
_SO_ENDS = ("answer", "a", "response", "antwort", "respuesta", "resposta", "réponse")
_AMOUNT = re.compile(r"\d\s*(?:%|percent|per cent|prozent|pour cent|por ciento|por cento|(?:hundred|thousand|million|billion|trillion)s?(?: (?:dollars|euros?|usd|eur))?|bps|basis points|shares|dollars|euros?|usd|eur|years?|[kmb])?$", re.I)
_OPENERS, _CLOSERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}, set(")]}”»")
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)[^<>]*?(/?)>|<[a-zA-Z/!][^<>]*$")
_MARK = re.compile(r"```|\\\\.|[<\"()\[\]{}“”„«»]", re.S)
_VOID = {"br", "hr", "img", "input", "meta", "link", "p", "li", "td", "tr", "th"}


def items(answer: str) -> tuple[list[str], bool]:
    """(texts, broken): the items of a JSON list or object as text, or the answer itself; broken if it is no whole list."""
    s = answer.strip()
    if s[:1] in "[{" or s[:1] == '"' and s[-1:] == '"':
        try:
            v = json.loads(s)
        except ValueError:
            return [s], s[:1] == "[" and '"' in s[:6] and "]" in still_open(s) or s[:2] in ('["', "[\n")
        flat, out = [v], []
        while flat:
            x = flat.pop(0)
            if isinstance(x, dict):
                flat = [*x.values(), *flat]
            elif isinstance(x, list):
                flat = [*x, *flat]
            elif x is not None:
                out.append(str(x))
        return out, False
    return [answer], False


def still_open(text: str) -> list[str]:
    """What a pushdown parser still expects at the end: closers of brackets, quotations, fences and markup."""
    stack: list[str] = []
    i = 0
    while m := _MARK.search(text, i):
        i, c = m.start(), m[0]
        if c == "```":  # within a fence nothing else is read
            end = text.find("```", i + 3)
            if end < 0:
                return [*stack, "```"]
            i = end + 3
            continue
        if c[0] == "\\":
            i = m.end()
            continue
        if c == "<":
            m = _TAG.match(text, i)
            if m and m[2] is None:
                return [*stack, ">"]
            if m:
                name = m[2].lower()
                if m[1]:
                    if f"</{name}>" in stack:
                        while stack.pop() != f"</{name}>":
                            pass
                elif not m[3] and name not in _VOID:
                    stack.append(f"</{name}>")
                i = m.end()
                continue
        if c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append('"')
        elif stack and c == stack[-1]:
            stack.pop()
        elif c in _OPENERS:
            stack.append(_OPENERS[c])
        elif c in _CLOSERS and c in stack:
            while stack.pop() != c:
                pass
        i += 1
    return stack


class _Clause:
    """A reader of the refusal grammar over the words and marks of a text's opening sentences."""

    def __init__(self, words: list[str]):
        self.w, self.i = words, 0

    def at(self, k: int = 0) -> str:
        return self.w[self.i + k] if self.i + k < len(self.w) else ""

    def take(self, *classes) -> bool:
        """Reads one word of each class in turn, adverbs between them, or nothing."""
        start = self.i
        for c in classes:
            while self.at() in ADVERBS and self.at() not in c:
                self.i += 1
            if self.at() not in c or not self.at():
                self.i = start
                return False
            self.i += 1
        return True

    def leads(self) -> int:
        """Reads openings and the marks after them; how many there were."""
        n = 0
        while n < 8:
            fit = next((x for x in _LEADS.get(self.at(), ()) if len(x) <= len(self.w) - self.i and all(a in ("*", b) for a, b in zip(x, self.w[self.i : self.i + len(x)]))), None)
            if fit is None:
                break
            self.i += len(fit)
            n += 1
            while self.at() and self.at() in ",:-–—":
                self.i += 1
        return n

    def stops(self) -> bool:
        return not self.at() or self.at() in ".!?;,:-–—\"”"

    def sentence(self) -> list[str]:
        end = next((k for k in range(self.i, len(self.w)) if self.w[k] in ".!?;"), len(self.w))
        return self.w[self.i : end]

    def reported(self) -> bool:
        """Whether the sentence goes on to name another as its speaker: ", the chairman said" or "according to"."""
        rest = self.sentence()
        marks = [k for k, x in enumerate(rest) if x in ',"”']
        return bool(marks) and any(x in SAYS for x in rest[marks[-1] :][:7])

    def request(self) -> bool:
        """An object that is what was asked, or none; "answer for" means to be accountable."""
        if self.stops():
            return True
        if self.at() == "for":
            return False
        return self.at() in POINTERS or self.at() in REQUESTS

    def reply(self) -> bool:
        """answer ..., help with ..., provide an answer ..."""
        if self.take({"be"}, WILLING | UNABLE) and self.at() == "to" or self.at() == "to":
            self.take({"to"})
        if self.take(REPLIES):
            return self.request()
        if self.take(GIVES):
            self.take({"an", "a", "any", "the", "you", "that", "this", "such"})
            self.take({"with"})
            self.take({"an", "a", "any", "the", "that", "this"})
            return self.at() in GIFTS
        return False

    def inability(self) -> bool:
        """can not, am unable to, must decline to, do not have, have no access: the verb phrase of one who declines."""
        for before in ((MODALS, {"not"}), (BE, UNABLE), (BE, {"not"}, WILLING), (BE, {"not"}, {"in"}, {"a"}, {"position"}), (DO, {"not"}, KNOWS), ({"have"}, {"no"}, KNOWLEDGE), ({"lack"}, {"access", "the"}), ({"would"}, {"rather"}, {"not"})):
            if self.take(*before):
                return True
        self.take({"must", "would", "will", "shall", "have", "need"})
        self.take({"have"})
        self.take({"to"})
        return self.take(DECLINES)

    def subject(self) -> str:
        if self.take({"i"}):
            return "i"
        if self.take({"we"}):
            return "we"
        start = self.i
        if self.take({"this", "the"}):
            for _ in range(3):
                if self.take(MACHINES):
                    return "machine"
                self.i += 1
        self.i = start
        return ""

    def topic(self) -> bool:
        """this question falls outside ..., answering it would be beyond ..., no answer can be given, it is not possible for me"""
        if self.take({"no"}, GIFTS, MODALS, {"be"}, {"given", "provided", "offered", "made"}):
            return True
        if self.take({"it"}, BE):
            return (self.take({"not"}, {"possible"}) or self.take({"impossible"})) and self.take({"for"}, {"me"})
        if self.take({"that", "this"}, BE):
            self.take({"not"})
            if self.take({"something"}, {"i"}, {"can"}):
                return True
            return self.take({"outside", "beyond"})
        if self.take({"answering", "responding", "assisting", "addressing", "discussing", "helping"}):
            rest = self.sentence()
            k = next((k for k, x in enumerate(rest) if x in BE), None)
            return bool(rest) and rest[0] in POINTERS and k is not None and any(x in ("not", "beyond", "outside", "impossible") for x in rest[k : k + 3])
        if self.take({"this", "that", "the", "your"}):
            return self.take(REQUESTS, {"falls", "fall", "is", "lies", "goes"}) and self.at() in ("outside", "beyond", "out", "not")
        return False

    def elliptic(self) -> bool:
        """Declined to answer. Unable to help with this."""
        if not (self.take(DECLINES) or self.take({"not"}, WILLING) or self.take(UNABLE) or self.take({"can", "could", "will"}, {"not"})):
            return False
        return self.reply() and (len(self.sentence()) < 12)

    def declines(self) -> bool:
        start = self.i
        who = self.subject()
        if who and self.inability():
            if self.reported():
                return False
            if who == "i":
                return not (self.at() == "answer" and self.at(1) == "for")
            return who == "machine" or self.reply()
        self.i = start
        if self.topic():
            return True
        self.i = start
        return self.elliptic()


def _opening(text: str) -> list[list[str]]:
    """The words and marks of the first sentences, contracted forms written out."""
    sentences, own = [], []
    low = _CONTRACTED.sub(lambda m: " ".join(SHORT[m[0].replace("’", "'").replace("ʼ", "'")]), text.lower())
    for m in _STEP.finditer(low):
        own.append(m[0])
        if m[0] in ".!?;":
            sentences.append(own)
            own = []
            if len(sentences) == 3:
                return sentences
    return [*sentences, own] if own else sentences


def refuses(text: str) -> bool:
    """Whether the answerer declines: openings, then a declining clause, in the first or, after a bare opening, the next sentence."""
    s = text.strip().lstrip("\"'“”*_>- ")
    if ABROAD.match(s):
        return True
    opening = _opening(s)
    for k, words in enumerate(opening):
        c = _Clause(words)
        n = c.leads()
        if c.declines():
            return True
        bare = c.stops() or n > 0 and len(" ".join(words)) < 60 and not any(w.isdigit() for w in words)
        if not bare:
            break
    for lead in ("désolé", "lo siento", "leider", "es tut mir leid", "desculpe", "lamento", "malheureusement", "infelizmente", "je suis"):
        if s.lower().startswith(lead) and ABROAD.match(re.sub(r"^[^,.;:]*[,.;:]\s*", "", s)):
            return True
    return False


def tiled(answer: list[str], question: list[str], least: int = 2) -> float:
    """The share of the answer's tokens in tiles of the question, longest first; the question may be used again."""
    free = [True] * len(answer)
    while True:
        used = [True] * len(question)
        any_ = False
        while True:
            best, at = least - 1, None
            run = [0] * (len(question) + 1)
            for i, w in enumerate(answer):
                new = [0] * (len(question) + 1)
                if free[i]:
                    for j, v in enumerate(question):
                        if used[j] and w == v:
                            new[j + 1] = run[j] + 1
                            if new[j + 1] > best:
                                best, at = new[j + 1], (i, j)
                run = new
            if at is None:
                break
            any_ = True
            for k in range(best):
                free[at[0] - k] = False
                used[at[1] - k] = False
        if not any_:
            return 1 - sum(free) / len(answer) if answer else 0.0


def _near(a: str, b: str) -> bool:
    """Whether two words differ by one edit or swap; short ones are never near."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] or (a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1])


def copies(question: str, answer: str) -> bool:
    """Nothing but the question: its words again but for a frame, slips of the pen and a named or unnamed subject."""
    if _YES_NO.match(answer) and not _YES_NO.match(question):
        return False
    s = answer.strip()
    for _ in range(3):
        m = _ASKED.match(s)
        s = s[m.end() :] if m else s
        if s.rstrip().removesuffix(":").rstrip().lower().endswith(_SO_ENDS):
            s = _SO.sub("", s)
        s = s.strip()
    a, q = [w.lower() for w in _WORDS.findall(s)], [w.lower() for w in _WORDS.findall(question)]
    if len(a) < 3 or len(q) < 3:
        return bool(a) and a == q
    have = set(q)
    if sum(w in have for w in a) < 0.6 * len(a):
        return False
    if any(any(c.isdigit() for c in w) and w not in have for w in a):
        return False
    a = [w if w in have else next((v for v in q if _near(w, v)), w) for w in a]
    share, back = tiled(a, q, 1), tiled(q, a, 1)
    new = [w for w in a if w not in have and w not in EVERY_FUNCTION_WORD and w not in ("company", "registrant", "group", "issuer", "filer")]
    return share >= 0.8 and back >= 0.5 and len(new) <= 1


_BY_WORD: dict[str, list[tuple[str, float]]] = {}
for _lang, _ws in _WEIGHT.items():
    for _w, _x in _ws.items():
        _BY_WORD.setdefault(_w, []).append((_lang, _x))
_LETTERS = re.compile(r"[^\W\d_]+")
_SCRIPTS = (("cyrillic", "Ѐ", "ԯ"), ("greek", "Ͱ", "Ͽ"), ("hebrew", "֐", "׿"), ("arabic", "؀", "ۿ"), ("devanagari", "ऀ", "ॿ"), ("thai", "฀", "๿"), ("hangul", "가", "힣"), ("kana", "぀", "ヿ"), ("han", "一", "鿿"))
_PLAIN_DE, _PLAIN_FR = re.compile(r"ung\b|keit\b"), re.compile(r"eaux?\b|\bl'|\bd'|\bqu'")


def cues(lang: str, text: str) -> int:
    """How many of a language's spellings a text has; texts of ASCII alone take a shorter way to the same number."""
    if not text.isascii():
        return len(_CUE[lang].findall(text))
    t = text.lower()
    if lang == "pt":
        return t.count("lh") + t.count("nh")
    if lang == "es":
        return t.count("ll") + t.count("ciones")
    if lang == "de":
        return t.count("sch") + (len(_PLAIN_DE.findall(t)) if "ung" in t or "keit" in t else 0)
    return len(_PLAIN_FR.findall(t)) if "'" in t or "eau" in t else 0


@lru_cache(maxsize=8192)
def language(text: str) -> tuple[str | None, float, float]:
    """(language, its score, the score of the next) by function words and spellings; a script other than Latin is its own."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return None, 0.0, 0.0
    if not text.isascii() and max(text) >= "Ͱ":
        letters = "".join(words)
        for name, low, high in _SCRIPTS:
            if sum(low <= c <= high for c in letters) > 0.5 * len(letters):
                return name, 10.0, 0.0
    score = dict.fromkeys(_WEIGHT, 0.0)
    for w in words:
        for lang, x in _BY_WORD.get(w, ()):
            score[lang] += x
    for lang in _CUE:
        if score[lang] > 0:
            score[lang] += 0.25 * cues(lang, text)
    best = sorted(score, key=score.get, reverse=True)
    return (best[0], score[best[0]], score[best[1]]) if score[best[0]] > 0 else (None, 0.0, 0.0)


def other_language(question: str, answer: str) -> bool:
    """Whether the answer is mainly in another language; too few telling words leave it in the question's."""
    a, high, _ = language(answer)
    q, sure, next_ = language(question)
    if a is None or q is None or a == q or high < 1.0 or len(_WORDS.findall(answer)) < 4:
        return False
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", answer)]
    own = sum(_WEIGHT.get(q, {}).get(w, 0.0) for w in words) + (0.25 * cues(q, answer) if q in _CUE else 0)
    return sure >= next_ and high > 1.3 * own


def ending(text: str, lang: str | None) -> tuple[bool | None, str, str]:
    """(cut, last word, skeleton): cut is None if only the collection can tell."""
    s = text.rstrip()
    core = s.rstrip("\"'”’»)]}*_` ")
    if still_open(s):
        return True, "", ""
    if s.endswith(("…", "...", "..")) or core[-1:] in tuple("([{,;:$€£/&–—-<«“„+="):
        return True, "", ""
    words = _WORDS.findall(core)
    if not words:
        return False, "", ""
    last = words[-1].lower()
    marked = core[-1:] in tuple(".!?。！？") or core != s
    if last in GOES_ON.get(lang or "en", ()) and len(words) > 2:
        return True, last, ""
    if marked:
        return False, last, ""
    if len(words) <= 5 and _AMOUNT.search(s):
        return False, last, ""
    far = next((k for k in range(len(words)) if words[-1 - k].lower() in EVERY_FUNCTION_WORD), None)
    if len(words) <= 3 and far is None:
        return False, last, ""
    return None, "#" if any(c.isdigit() for c in last) else last, skeleton(words)


def skeleton(words: list[str]) -> str:
    """The last function word of a sentence and how many words follow it."""
    for k in range(min(len(words), 12)):
        w = words[-1 - k].lower()
        if w in EVERY_FUNCTION_WORD:
            return f"{w} {k}"
    return f"- {min(len(words), 12)}"


def judge(question: str | None, answer: str | None) -> tuple[str | None, str, str]:
    """(defect, last word, skeleton); the latter two are set if the collection has to tell whether the answer is cut."""
    if answer is None:
        return "empty", "", ""
    texts, broken = items(answer)
    texts = [t for t in texts if any(c.isalnum() for c in t) and re.sub(r"\s+", " ", t.strip(" .!?:;()[]{}<>\"'*_-–— \t\r\n").lower()) not in PLACEHOLDERS]
    if not texts:
        return "empty", "", ""
    whole = " ".join(texts)
    if refuses(texts[0]):
        return "refusal", "", ""
    q = question or ""
    if copies(q, whole if not broken else whole.lstrip('[" ')):
        return "copies_question", "", ""
    if other_language(q, whole):
        return "other_language", "", ""
    if broken:
        return "truncated", "", ""
    lang = language(whole)[0]
    cut, last, shape = ending(texts[-1], lang)
    if cut:
        return "truncated", "", ""
    return (None, last, shape) if cut is None else (None, "", "")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [judge(q, a) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if got:
            keep = pa.array([g[0] is not None or g[1] != "" for g in got])
            rows = pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], pa.string()) for i in range(3))], names=["question_id", "defect", "last", "shape"])
            yield rows.filter(keep)


_TOKENS = re.compile(r"([^\W_]+(?:[-'’.,][^\W_]+)*)([^\w\s]?)")


class _Keys(dict):
    """Words in lower case, # for those with digits; what has been seen lately is kept."""

    def __missing__(self, w: str) -> str:
        if len(self) > 200_000:
            self.clear()
        k = self[w] = "#" if any(map(str.isdigit, w)) else w.lower()
        return k


_key, _CLOSE = _Keys(), frozenset('.;:!?,"”')


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: each word's uses and its uses before a mark, and the skeletons of sentence ends."""
    seen: Counter = Counter()
    ends: Counter = Counter()
    shapes: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list(seen)
        rows = [("w", w, seen[w], ends[w]) for w in words] + [("s", k, n, n) for k, n in shapes.items()]
        seen.clear(), ends.clear(), shapes.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "word", "uses", "finals"])

    for batch in batches:
        for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            texts = items(a)[0] if a else []
            for text in [q or "", *texts]:
                found = _TOKENS.findall(text)
                if text.rstrip()[-1:].isalnum() and found:
                    found.pop()  # its end is what is in question
                seen.update([_key[w] for w, _ in found])
                ends.update([_key[w] for w, m in found if m and m in _CLOSE])
            for text in texts:
                for s in re.findall(r"[^.!?]*(?:\.(?=\S)[^.!?]*)*[.!?](?=\s|$)", text):
                    words = _WORDS.findall(s)
                    if len(words) > 1:
                        shapes[skeleton(words)] += 1
        if len(seen) > 300_000:
            yield out()
    if seen or shapes:
        yield out()


#: An end is unknown to the collection below this share of its sentence ends; a word is no end if none of so many uses is.
RARE_END, USES = 0.002, 5


def defects(pairs: DataFrame, question_id: str = "question_id", question: str = "question_text", answer: str = "answer_text") -> DataFrame:
    """(question_id, defect), each defective question once.

    A question delivered again counts once; if its deliveries differ, the first defect in the order of the module's
    head holds. A null question leaves only what its answer shows by itself. Null ids are left out.
    """
    rows = pairs.select(F.col(question_id).cast("string").alias("question_id"), F.col(question).alias("q"), F.col(answer).alias("a")).where("question_id is not null")
    judged = rows.mapInArrow(_judged, "question_id string, defect string, last string, shape string")
    counted = rows.mapInArrow(_endings, "kind string, word string, uses long, finals long").groupBy("kind", "word").agg(F.sum("uses").alias("uses"), F.sum("finals").alias("finals")).persist(StorageLevel.MEMORY_AND_DISK)
    shapes = counted.where("kind = 's'").select(F.col("word").alias("shape"), F.col("uses").alias("shape_uses"))
    total = shapes.agg(F.sum("shape_uses").alias("shape_total"))
    words = counted.where("kind = 'w'").select(F.col("word").alias("last"), "uses", "finals")
    open_ = F.col("defect").isNull()
    none = F.concat(F.lit("\x00"), F.col("question_id"))  # decided rows meet nobody and spread over the tasks
    keyed = judged.withColumns({"last": F.when(open_, F.col("last")).otherwise(none), "shape": F.when(open_, F.col("shape")).otherwise(none)})
    every = keyed.join(words, "last", "left").join(shapes, "shape", "left").crossJoin(F.broadcast(total))
    cut = F.col("uses").isNull() | ((F.col("uses") >= USES) & (F.col("finals") == 0)) | (F.coalesce("shape_uses", F.lit(0)) < RARE_END * F.coalesce("shape_total", F.lit(0)))
    every = every.withColumn("defect", F.coalesce("defect", F.when(cut, "truncated"))).where("defect is not null")
    order = F.array(*map(F.lit, ("empty", "refusal", "copies_question", "other_language", "truncated")))
    return every.groupBy("question_id").agg(F.min(F.array_position(order, F.col("defect"))).alias("k")).select("question_id", F.element_at(order, F.col("k").cast("int")).alias("defect"))
