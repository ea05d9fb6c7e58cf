"""Word classes by a hidden Markov model and lemmas by suffix rules with exceptions.

The tables are small and go to the tasks with the function. Words that a table does not hold get their classes from
their shape: capitals, digits and the longest known suffix.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Classes that carry content.
CONTENT = ("NOUN", "PROPN", "ADJ", "VERB", "ADV")

#: Words of closed classes, and common words that suffixes would mislead.
KNOWN = {
    "DET": "the a an this that these those every each some any no all both another",
    "ADP": "of in on at by for with from into over under about between through during without within across against among per as to up out off",
    "PRON": "i you he she it we they me him her us them who which what that this these those someone anyone everyone there",
    "CCONJ": "and or but nor",
    "SCONJ": "if because while although whether since when where that as",
    "AUX": "is are was were be been being am has have had do does did can could will would shall should may might must",
    "PART": "to not n't 's",
    "DETPOSS": "my your his her its our their whose",
    "ADV": "very also too well often never always here now then only just more most so soon again together home",
    "ADJ": "new good great high low strong able many other own first last senior junior full small large big red blue green old hot cold young key such same open responsible",
    "VERB": "work build make develop design use look need want know get give take run write seek manage lead sell buy keep help",
    "NOUN": "work design use look need help run lead team time year web data software developer skill experience job company product code test system application service name order",
    "NUM": "one two three four five six seven eight nine ten hundred thousand",
}
TAGS = ("NOUN", "PROPN", "ADJ", "VERB", "ADV", "DET", "ADP", "PRON", "CCONJ", "SCONJ", "AUX", "PART", "NUM", "PUNCT")

#: Classes of unknown words by suffix, the longest first.
SUFFIXES = {
    "ically": {"ADV": 1}, "tion": {"NOUN": 1}, "sion": {"NOUN": 1}, "ment": {"NOUN": 1}, "ness": {"NOUN": 1}, "ship": {"NOUN": 1}, "ance": {"NOUN": 1}, "ence": {"NOUN": 1},
    "able": {"ADJ": 1}, "ible": {"ADJ": 1}, "less": {"ADJ": 1}, "ical": {"ADJ": 1}, "ious": {"ADJ": 1}, "eous": {"ADJ": 1}, "tive": {"ADJ": 0.8, "NOUN": 0.2},
    "ous": {"ADJ": 1}, "ful": {"ADJ": 1}, "ish": {"ADJ": 0.7, "VERB": 0.3}, "ity": {"NOUN": 1}, "ism": {"NOUN": 1}, "ist": {"NOUN": 1}, "ing": {"VERB": 0.6, "NOUN": 0.3, "ADJ": 0.1}, "ize": {"VERB": 1}, "ise": {"VERB": 0.6, "NOUN": 0.4},
    "ify": {"VERB": 1}, "ers": {"NOUN": 0.95, "VERB": 0.05}, "ors": {"NOUN": 1}, "ate": {"VERB": 0.6, "ADJ": 0.2, "NOUN": 0.2}, "est": {"ADJ": 0.7, "NOUN": 0.3},
    "ly": {"ADV": 0.9, "ADJ": 0.1}, "ed": {"VERB": 0.7, "ADJ": 0.3}, "er": {"NOUN": 0.8, "ADJ": 0.1, "VERB": 0.1}, "or": {"NOUN": 0.95, "ADJ": 0.05}, "al": {"ADJ": 0.7, "NOUN": 0.3}, "ic": {"ADJ": 0.8, "NOUN": 0.2}, "en": {"VERB": 0.4, "ADJ": 0.3, "NOUN": 0.3},
    "ss": {"NOUN": 0.8, "VERB": 0.2}, "us": {"NOUN": 0.7, "ADJ": 0.3}, "s": {"NOUN": 0.75, "VERB": 0.25},
}
OTHER = {"NOUN": 0.6, "ADJ": 0.15, "VERB": 0.2, "ADV": 0.05}

#: How well one class follows another, where it is not the usual 1; "" is the start of a text.
FOLLOWS = {
    "": {"DET": 4, "PRON": 4, "PROPN": 3, "NOUN": 3, "VERB": 1.5, "AUX": 0.3, "PART": 0.3, "ADP": 2},
    "DET": {"NOUN": 9, "ADJ": 6, "PROPN": 3, "NUM": 2, "ADV": 0.7, "VERB": 0.15, "DET": 0.05, "ADP": 0.05, "PRON": 0.05, "AUX": 0.05, "CCONJ": 0.02, "SCONJ": 0.02, "PART": 0.02},
    "ADJ": {"NOUN": 9, "PROPN": 2, "ADJ": 2, "CCONJ": 1.5, "VERB": 0.2, "DET": 0.1, "PRON": 0.2, "AUX": 0.4, "ADV": 0.4},
    "NOUN": {"ADP": 4, "AUX": 4, "VERB": 2, "CCONJ": 3, "PUNCT": 4, "NOUN": 2, "SCONJ": 1.5, "ADJ": 0.5, "DET": 0.3, "PRON": 0.8, "ADV": 1.2},
    "PROPN": {"PROPN": 4, "VERB": 3, "AUX": 4, "ADP": 3, "CCONJ": 3, "PUNCT": 4, "NOUN": 2, "ADJ": 0.4},
    "VERB": {"DET": 5, "NOUN": 3, "ADP": 4, "ADV": 2.5, "ADJ": 2, "PRON": 3, "PROPN": 2, "PART": 2, "SCONJ": 1.5, "VERB": 0.4, "AUX": 0.2, "CCONJ": 1.2},
    "AUX": {"VERB": 6, "ADJ": 3, "ADV": 4, "DET": 3, "PART": 3, "AUX": 2, "NOUN": 1, "ADP": 1, "PRON": 0.7},
    "ADV": {"VERB": 4, "ADJ": 4, "ADV": 2, "ADP": 2, "NOUN": 0.7, "PUNCT": 3},
    "ADP": {"DET": 6, "NOUN": 6, "PROPN": 4, "ADJ": 4, "PRON": 3, "NUM": 2, "VERB": 1, "AUX": 0.05, "ADP": 0.3, "CCONJ": 0.05, "SCONJ": 0.2},
    "PRON": {"VERB": 6, "AUX": 6, "ADV": 2, "ADP": 1, "NOUN": 0.3, "ADJ": 0.3, "DET": 0.3},
    "PART": {"VERB": 9, "ADV": 1.5, "AUX": 2, "NOUN": 0.1, "ADJ": 0.2, "DET": 0.3, "PROPN": 0.1},
    "CCONJ": {"NOUN": 3, "ADJ": 2, "VERB": 3, "PROPN": 2, "DET": 2, "PRON": 2, "ADV": 1.5},
    "SCONJ": {"PRON": 4, "DET": 4, "NOUN": 3, "PROPN": 2, "ADJ": 1.5, "VERB": 0.8},
    "NUM": {"NOUN": 8, "ADJ": 2, "PUNCT": 2, "VERB": 0.3},
    "PUNCT": {"NOUN": 2, "DET": 2, "PRON": 2, "CCONJ": 2, "ADJ": 1.5},
}

#: Lemmas that no rule gives.
IRREGULAR = {
    "NOUN": "men man women woman children child people person feet foot teeth tooth mice mouse geese goose lives life wives wife knives knife leaves leaf halves half shelves shelf data datum criteria criterion analyses analysis bases basis crises crisis theses thesis indices index matrices matrix media medium series series species species news news",
    "VERB": "built build made make sold sell bought buy led lead wrote write written write ran run running run went go gone go took take taken take gave give given give knew know known know got get grew grow grown grow kept keep held hold met meet found find brought bring thought think taught teach sought seek spent spend left leave felt feel began begin begun begin chose choose chosen choose drove drive driven drive spoke speak spoken speak understood understand won win paid pay said say sent send set set put put saw see seen see came come done do did do had have has have been be was be were be is be are be am be eating eat treating treat treated treat changing change bringing bring monitoring monitor monitored monitor editing edit edited edit visiting visit visited visit offering offer offered offer entering enter entered enter creating create created create",
    "ADJ": "better good best good worse bad worst bad bigger big biggest big",
    "ADV": "better well best well worse badly worst badly",
}
_IRREGULAR = {tag: dict(zip(words.split()[::2], words.split()[1::2])) for tag, words in IRREGULAR.items()}
_VOWELS = "aeiou"
#: Ends of a verb without -ing or -ed that lost an e.
_LOST_E = re.compile(r"([^aeiou][aeiou](v|z|c|s|g|k|r|d|t|p|m|n|l)|(at|iz|iv|ev|ov|rv|lv|ur|ir|or|ut|ud|id|od|in|un|ag|ng|rg|dg|uc|nc|rc|rs|ns|bl|pl|tl|dl|gl|fl|zl|u|as|is|os|us|ak|ik|ok|ar|er|et|it|am|om|op|ap|yp))$")
_KEPT = re.compile(r"([aeiou]{2}[^aeiou]|[^aeiou](er|en|et|it|or|on|op|in|el|al|om)|[aeiouy][wxy])$")


def _singular(w: str) -> str:
    if w.endswith("ies") and len(w) > 4:
        return w[:-3] + "y"
    if re.search(r"(ss|sh|ch|x|zz|o)es$", w) and len(w) > 4:
        return w[:-2]
    return w[:-1] if w.endswith("s") and not re.search(r"(ss|us|is)$", w) and len(w) > 2 else w


def _bare(stem: str) -> str:
    """A verb's base from what is left without -ing or -ed."""
    if len(stem) < 2 or not re.search("[aeiouy]", stem):
        return ""
    if stem[-1] == stem[-2] and stem[-1] not in "lsz" + _VOWELS:
        return stem[:-1]
    heard = stem.replace("qu", "q")
    short = len(re.findall("[aeiouy]+", heard)) == 1
    if not re.search(r"[aeiou]{2}[^aeiou]$", heard) and _LOST_E.search(stem) and (short or not _KEPT.search(stem) or re.search(r"(at|iz|iv|ut|ud|id|ir|ur|bl|pl|u|ag|os|in|as|or|et)$", stem)):
        return stem + "e"
    return stem


def lemma(word: str, tag: str) -> str:
    """The base form of a word of a class, in lower case but for names."""
    if tag == "PROPN":
        return word
    w = word.lower()
    if found := _IRREGULAR.get(tag, {}).get(w):
        return found
    if tag == "NOUN":
        return _singular(w)
    if tag == "VERB":
        if w.endswith("ied") and len(w) > 4:
            return w[:-3] + "y"
        for end in ("ing", "ed"):
            if w.endswith(end) and not w.endswith("eed") and (base := _bare(w[: -len(end)])):
                return base
        return _singular(w)
    if tag == "ADJ":
        return w[:-3] + "y" if w.endswith("ier") and len(w) > 5 else w[:-4] + "y" if w.endswith("iest") else w
    return w


@dataclass(frozen=True)
class Tagger:
    """Logarithms of how likely a class makes a word, and follows another."""

    words: dict[str, dict[str, float]] = field(repr=False)
    follows: dict[str, dict[str, float]] = field(repr=False)

    @staticmethod
    def default() -> Tagger:
        words: dict[str, dict[str, float]] = {}
        for tag, listed in KNOWN.items():
            for w in listed.split():
                words.setdefault(w, {})["DET" if tag == "DETPOSS" else tag] = 0.0
        return Tagger(words, {a: {b: math.log(FOLLOWS[a].get(b, 1)) for b in TAGS} for a in FOLLOWS})

    @staticmethod
    def trained(tagged: DataFrame, key: str, place: str, word: str, tag: str, most: int = 20_000) -> Tagger:
        """From tagged words in the order of their places: the `most` most frequent words (a bound on the table) and all pairs of classes, with one more of each."""
        rows = tagged.select(F.lower(word).alias("w"), F.col(tag).alias("t"), F.coalesce(F.lag(tag).over(Window.partitionBy(key).orderBy(place)), F.lit("")).alias("p"))
        pairs = {(r["p"], r["t"]): r["n"] for r in rows.groupBy("p", "t").agg(F.count(F.lit(1)).alias("n")).collect()}  # classes squared
        each = {t: sum(n for (_, b), n in pairs.items() if b == t) for t in TAGS}
        best = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(most).select("w")
        words: dict[str, dict[str, float]] = {}
        for r in rows.join(best, "w").groupBy("w", "t").agg(F.count(F.lit(1)).alias("n")).collect():
            words.setdefault(r["w"], {})[r["t"]] = math.log(r["n"] / max(each.get(r["t"], 1), 1))
        starts = {a: sum(n for (x, _), n in pairs.items() if x == a) for a in ("", *TAGS)}
        return Tagger(words, {a: {b: math.log((pairs.get((a, b), 0) + 1) / (starts[a] + len(TAGS))) for b in TAGS} for a in ("", *TAGS)})

    def classes(self, word: str, first: bool) -> dict[str, float]:
        """The classes that a word may have."""
        if not re.search(r"\w", word):
            return {"PUNCT": 0.0}
        known = self.words.get(word.lower()) or {t: p for t, p in self.words.get(_singular(word.lower()), {}).items() if t in ("NOUN", "VERB")}
        if known:
            return known
        if re.fullmatch(r"[\d.,%$]+", word):
            return {"NUM": 0.0}
        if word[0].isupper() and not first:
            return {"PROPN": 0.0, "NOUN": -2.5, "ADJ": -3.0}
        low = word.lower()
        for n in (6, 4, 3, 2, 1):
            if len(low) > n + 1 and low[-n:] in SUFFIXES:
                return {t: math.log(p) for t, p in SUFFIXES[low[-n:]].items()}
        return {t: math.log(p) for t, p in OTHER.items()}

    def tag(self, words: Sequence[str]) -> list[str]:
        """The likeliest classes of a text's words together; the first path of equal ones."""
        if not len(words):
            return []
        paths = {"": (0.0, None)}
        back = []
        for i, w in enumerate(words):
            now = {}
            for t, made in self.classes(w, i == 0 or words[i - 1] in (".", "!", "?")).items():
                best = max(paths, key=lambda p: paths[p][0] + self.follows[p].get(t, 0.0))
                now[t] = (paths[best][0] + self.follows[best].get(t, 0.0) + made, best)
            back.append(now)
            paths = now
        out = [max(paths, key=lambda p: paths[p][0])]
        for now in reversed(back[1:]):
            out.append(now[out[-1]][1])
        return out[::-1]


_TAGGED = ArrayType(StructType([StructField(c, StringType()) for c in ("word", "tag", "lemma")]))


def tagged_words(words: Column, tagger: Tagger | None = None) -> Column:
    """(word, tag, lemma) of each word of a list; null words are left out, a null list stays null."""
    tagger = tagger or Tagger.default()

    @F.pandas_udf(_TAGGED)
    def run(lists: pd.Series) -> pd.Series:
        def one(ws) -> list[dict] | None:
            if ws is None:
                return None
            held = [w for w in ws if w]
            return [{"word": w, "tag": t, "lemma": lemma(w, t)} for w, t in zip(held, tagger.tag(held))]

        return pd.Series([one(ws) for ws in lists], dtype=object)

    return run(words)


def kept_lemmas(words: Column, keep: Sequence[str] = CONTENT, tagger: Tagger | None = None) -> Column:
    """The lemmas of words of the kept classes, in order."""
    kept = F.filter(tagged_words(words, tagger), lambda x: x["tag"].isin(*keep))
    return F.transform(kept, lambda x: x["lemma"])
