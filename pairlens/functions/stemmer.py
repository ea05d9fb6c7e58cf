"""The English (Porter2) stemmer, from its published description."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
_V, _NV = f"[{VOWELS}]", f"[^{VOWELS}]"
# Words with stems of their own, words that step 1a leaves as they are, beginnings after which R1 starts.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
R1_AFTER = ("gener", "commun", "arsen")
# Endings of steps 2, 3 and 4, the longer before the shorter where one ends in the other.
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("lessli", "less"), ("biliti", "ble"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"

_REGION = re.compile(f"{_V}{_NV}")
_SHORT_END = re.compile(f"(?:{_NV}{_V}[^{VOWELS}wxY]|^{_V}{_NV})$")


def _region(word: str, start: int = 0) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def stem_word(word: str) -> str:
    """The stem of a word in lower case."""
    word = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    # A y at the beginning or after a vowel is a consonant, written Y.
    word = re.sub(f"(?<={_V})y", "Y", re.sub("^y", "Y", word))
    r1 = next((len(p) for p in R1_AFTER if word.startswith(p)), None)
    r1 = _region(word) if r1 is None else r1
    r2 = _region(word, r1)
    word = _step_1(_step_0(word), r1)
    if word.lower() in AFTER_1A:
        return word.lower()
    for step in (_step_2, _step_3, _step_4, _step_5):
        word = step(word, r1, r2)
    return word.replace("Y", "y")


def _step_0(word: str) -> str:
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            return word[: -len(end)]
    return word


def _step_1(word: str, r1: int) -> str:
    # 1a: plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b: ed and ing.
    for end in ("eedly", "eed"):
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + "ee"
            break
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), "")
        if end and _has_vowel(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _SHORT_END.search(word):
                word += "e"
    # 1c: y after a consonant that does not begin the word.
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    return word


def _step_2(word: str, r1: int, r2: int) -> str:
    for end, put in STEP_2:
        if word.endswith(end):
            at = len(word) - len(end)
            allowed = word[at - 1 : at] == "l" if end == "ogi" else word[at - 1 : at] in tuple(LI_ENDINGS) if end == "li" else True
            return word[:at] + put if at >= r1 and allowed else word
    return word


def _step_3(word: str, r1: int, r2: int) -> str:
    for end, put in STEP_3:
        if word.endswith(end):
            at = len(word) - len(end)
            return word[:at] + put if at >= r1 and (end != "ative" or at >= r2) else word
    return word


def _step_4(word: str, r1: int, r2: int) -> str:
    for end in STEP_4:
        if word.endswith(end):
            at = len(word) - len(end)
            return word[:at] if at >= r2 and (end != "ion" or word[at - 1 : at] in ("s", "t")) else word
    return word


def _step_5(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or at >= r1 and not _SHORT_END.search(word[:-1])):
        return word[:-1]
    if word.endswith("l") and at >= r2 and word[at - 1 : at] == "l":
        return word[:-1]
    return word
