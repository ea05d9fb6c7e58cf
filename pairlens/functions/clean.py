"""Cleaning and stemming of whole texts, in Arrow batches: entities, compatibility forms and Porter2 stems need more than patterns.

`clean` and `stem` work on one text; `cleaned`, `stemmed` and `cleaned_and_stemmed` are the same as Column
functions. A null text, and one that can't be stemmed, gives null.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .stemmer import stem_word

# What short forms stand for, word by word; further ones follow from their endings.
CONTRACTIONS = {"ain't": "are not", "can't": "cannot", "won't": "will not", "shan't": "shall not", "let's": "let us", "y'all": "you all", "ma'am": "madam", "o'clock": "of the clock", "i'm": "i am", "he's": "he is", "she's": "she is", "it's": "it is", "that's": "that is", "what's": "what is", "there's": "there is", "here's": "here is", "who's": "who is", "where's": "where is", "when's": "when is", "how's": "how is", "why's": "why is"}
ENDINGS = {"n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'d": " would"}
# Bullets and geometric signs; signs without width.
BULLETS = r"[\u00A7\u00B0\u00B6\u00B7\u2022\u2023\u25A0-\u25FF\uE000-\uF8FF\u2043\u2219]\s*"
NO_WIDTH = r"[\uFEFF\u200b]\s"
# The English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just "
    "don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't".split()
)

_SHORT = re.compile(r"\b[a-z]+(?:n't|'(?:re|ve|ll|d|m|s))\b|\by'all\b|\bo'clock\b|\bma'am\b", re.I)


def _case_like(model: str, made: str) -> str:
    return made.upper() if len(model) > 2 and model.isupper() else made[0].upper() + made[1:] if model[:1].isupper() else made


def _long_form(m: re.Match) -> str:
    low = m[0].lower()
    if low in CONTRACTIONS:
        return _case_like(m[0], CONTRACTIONS[low])
    for end, put in ENDINGS.items():
        if low.endswith(end):
            return m[0][: -len(end)] + put
    return m[0]  # 's of a name


def expand_contractions(text: str) -> str:
    return _SHORT.sub(_long_form, text.replace("’", "'")) if "'" in text or "’" in text else text


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def without_markup(text: str) -> str:
    """The text of a piece of HTML, references decoded."""
    if "<" not in text and "&" not in text:
        return text
    parser = _Text()
    parser.feed(text)
    parser.close()
    return "".join(parser.parts)


def _to_fixpoint(pattern: str, put, text: str) -> str:
    while (new := re.sub(pattern, put, text)) != text:
        text = new
    return text


def _dotted(m: re.Match) -> str:
    return f"{m[1]}_dot_{m[2]}" if m[1] else f"dot_{m[2]}"


def _at(m: re.Match) -> str:
    return f"{m[1]}_at_{m[2]}" if m[1] else f"at_{m[2]}"


def _it(m: re.Match) -> str:
    return f"{m[1] or ''}IT{m[2] or ''}" if m[1] or m[2] else "information_technology"


def words_for_stemming(text: str) -> str:
    """Joins what must stay together as one word: x@y, .net, A & B, A / B, C#, C++, IT."""
    text = re.sub(r"\.?\s*</li>", ".</li>", text)
    text = _to_fixpoint(r"(?:\w+://)?(\w+)?@(\w+\.?)", _at, text)
    text = re.sub(r"(\w+)?\.(\w+)", _dotted, text)
    text = re.sub(r"(\w+)\s*&(?:amp;)?\s*(\w+)", r"\1_and_\2", text)
    text = _to_fixpoint(r"(\w+)\s*/\s*(\w+)", r"\1_slash_\2", text)
    text = re.sub(r"(\w)?I\.*T\.*(\w)?", _it, text)
    return re.sub(r"C\s*#", "C_sharp", text.replace("++", "plusplus"))


def clean(text: str, for_stemming: bool = False) -> str:
    """A text, perhaps HTML, as plain sentences. Items, headings, bullets and line breaks end sentences."""
    text = re.sub(r"</?p>", ". ", expand_contractions(text))
    text = re.sub(r"<br\s*/>", "\r\n", text)
    text = re.sub(r"([A-Z\s]+:)", r". \1", text)
    text = re.sub(r"(<\s*/(?:li|ul|LI|UL)\s*>)", r". \1", text)
    text = re.sub(r"(<\s*/\s*div\s*>)", r". \1", text)
    if for_stemming:
        text = words_for_stemming(text)
    text = unicodedata.normalize("NFKD", without_markup(text))
    text = re.sub(NO_WIDTH, "", re.sub(BULLETS, ". ", text))
    text = re.sub(r"\)\s*([^a-z])", r"). \1", text)
    text = re.sub(r"\n([A-Z])", r". \1", text)
    text = re.sub(r"\s+", " ", text)
    text = re.sub(r"(.)\1{2,}", ". ", text)
    text = re.sub(r"\s*\.", ".", text)
    text = re.sub(r"\s\d+(?:.|\))\s+", " ", text)
    return re.sub(r"\.+", ".", text).strip()


#: Short forms after which a full stop ends no sentence.
ABBREVIATIONS = frozenset("dr mr mrs ms prof sr jr st vs etc inc ltd co corp dept e.g i.e fig no vol u.s a.m p.m".split())
_END = re.compile(r"[.?!]+[\"')\]]*\s+")
_TOKEN = re.compile(r"\w+(?:[-'.]\w+)*|[^\w\s]+")


def sentences(text: str) -> list[str]:
    """Parts that end in a stop, a question or an exclamation mark before white space; not after an abbreviation, an initial or before a small letter."""
    out, start = [], 0
    for m in _END.finditer(text):
        last = text[start : m.start()].rsplit(None, 1)[-1:] or [""]
        word = last[0].lower().lstrip("(\"'")
        if text[m.start()] == "." and (word in ABBREVIATIONS or len(word) == 1 and word.isalpha() or text[m.end() : m.end() + 1].islower()):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, text[start:].strip()] if s]


def tokens(sentence: str) -> list[str]:
    """Words with inner hyphens, apostrophes and points, and runs of other signs; n't and endings like 's are words of their own."""
    out = []
    for t in _TOKEN.findall(sentence):
        m = re.fullmatch(r"(\w+?)(n't|'(?:s|re|ve|ll|d|m))", t, re.I)
        out += [m[1], m[2]] if m else [t]
    return out


_PUNCTUATION = str.maketrans("", "", string.punctuation.replace("_", "") + "–")
_stem = lru_cache(maxsize=200_000)(stem_word)


def stem(text: str) -> str:
    """Sentences of stems without stop words and punctuation but underscores, each followed by '. '."""
    out = []
    for s in sentences(text):
        stems = (_stem(w).translate(_PUNCTUATION) for w in map(str.lower, tokens(s)) if w not in STOP_WORDS)
        out.append(" ".join(x for x in stems if x) + ". ")
    return "".join(out)


def stem_phrase(text: str) -> str:
    """Stems of a phrase, without the end of its sentence."""
    return stem(text)[:-2]


def clean_and_stem(text: str) -> str | None:
    """Cleans, without the rules for stemming, and stems; null where nothing can be made of it."""
    try:
        return stem(clean(text))
    except (TypeError, ValueError, IndexError):
        return None


#: Texts of a batch that are taken up at once.
STEP = 64


def _column(fn: Callable[[str], str | None]):
    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        # A batch is ten thousand texts of any size: only STEP of them, and what is made of them, are Python's at once.
        made = [pa.array([None if t is None else fn(t) for t in texts.slice(at, STEP).to_pylist()], pa.string()) for at in range(0, len(texts), STEP)]
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    return run


cleaned, cleaned_for_stemming = _column(clean), _column(lambda t: clean(t, True))
stemmed, stemmed_phrase, cleaned_and_stemmed = _column(stem), _column(stem_phrase), _column(clean_and_stem)


#: Code points of a phrase whose stems are kept, as such phrases recur from list to list.
SHORT = 100


@lru_cache(maxsize=100_000)
def _underscored(phrase: str) -> str:
    return stem(clean(phrase, True)).rstrip(". ").replace(" ", "_")


def underscored_stems(phrases: list[str]) -> list[str]:
    """The distinct stems of a list's phrases, words joined by underscores, sorted; phrases that hold commas count as several."""
    made = (_underscored(p) if len(p) <= SHORT else _underscored.__wrapped__(p) for p in phrases)
    return sorted({x for m in made for x in m.split(",")} - {""})


@F.pandas_udf(ArrayType(StringType()))
def stemmed_lists(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else underscored_stems([p for p in x if p is not None]))
