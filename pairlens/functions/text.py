"""Text rules as Column functions, each of its own; what needs Unicode tables or a parser is in `clean`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character: letters and digits of any script, and the underscore.
W = r"[\p{L}\p{N}_]"
#: Marks that no text holds: where a match begins, where its middle was, where it ends.
_A, _B, _C = "\x02", "\x03", "\x04"

# Rules as (pattern, replacement).
RULES: dict[str, tuple[str, str]] = {
    "period_before_li": (r"\.?\s*</li>", ".</li>"),
    "ampersand_pair": (rf"({W}+)\s*&(?:amp;)?\s*({W}+)", "$1_and_$2"),
    "caps_heading": (r"([A-Z\s]+:)", ". $1"),
    "paren_break": (r"\)\s*([^a-z])", "). $1"),
    "newline_capital": (r"\n([A-Z])", ". $1"),
    "list_end": (r"(<\s*/(?:li|ul|LI|UL)\s*>)", ". $1"),
    "div_end": (r"(<\s*/\s*div\s*>)", ". $1"),
    "break_to_crlf": (r"<br\s*/>", "\r\n"),
    "paragraph_to_stop": (r"</?p>", ". "),
    "strip_tags": (r"<[^>]*>", " "),
    "space_collapse": (r"\s+", " "),
    "repeated_to_stop": (r"(.)\1{2,}", ". "),
    "space_before_dot": (r"\s*\.", "."),
    "dots_to_one": (r"\.+", "."),
    "url_strip": (r"https?://\S+", ""),
    "number_bullets": (r"\s\d+(?:.|\))\s+", " "),
    "camel_split": (r"([a-z])([A-Z])", "$1 $2"),
    "plus_plus": (r"\+\+", "plusplus"),
    "c_sharp": (r"C\s*#", "C_sharp"),
}


def rule(text: Column, name: str) -> Column:
    return F.regexp_replace(text, *RULES[name])


def _joined(text: Column, sign: str, name: str) -> Column:
    """`[a]<sign>b` as [a_]<name>_b until nothing changes, a scheme before it dropped; chains go in one pass, as the right word is only looked at."""
    ahead = rf"{sign}(?={sign}*{W})"
    with_left = F.regexp_replace(text, rf"(?:{W}+://)?({W}+){ahead}", f"$1_{name}_")
    return F.regexp_replace(with_left, rf"(?:{W}+://)?{ahead}", f"{name}_")


def at_words(text: Column) -> Column:
    """`a@b` as a_at_b, `@b` as at_b, chains and schemes included."""
    return _joined(text, "@", "at")


def uri_words(text: Column) -> Column:
    """`http://www.a.b` as www_dot_a_dot_b."""
    return _joined(text, r"\.", "dot")


def dot_words(text: Column) -> Column:
    """`a.b` as a_dot_b and `.b` as dot_b in one pass from the left: in a chain the third word has no left word any more."""
    marked = F.regexp_replace(text, rf"({W}*)\.({W}+)", f"{_A}$1{_B}$2")
    return F.regexp_replace(F.replace(marked, F.lit(_A + _B), F.lit("dot_")), f"{_A}([^{_B}]+){_B}", "$1_dot_")


def slash_words(text: Column) -> Column:
    """`a / b` as a_slash_b, for chains of any length: both words are only looked at."""
    return F.regexp_replace(text, rf"(?<={W})\s*/\s*(?={W})", "_slash_")


def expand_it(text: Column) -> Column:
    """IT or I.T. as information_technology; next to a word character only its dots go."""
    marked = F.regexp_replace(text, rf"({W})?I\.*T\.*({W})?", f"{_A}$1{_B}$2{_C}")
    alone = F.replace(marked, F.lit(_A + _B + _C), F.lit("information_technology"))
    return F.regexp_replace(alone, f"{_A}([^{_B}]?){_B}([^{_C}]?){_C}", "$1IT$2")


#: The rules for stemming in their order, as Column functions.
FOR_STEMMING = (
    lambda t: rule(t, "period_before_li"),
    at_words,
    dot_words,
    lambda t: rule(t, "ampersand_pair"),
    slash_words,
    expand_it,
    lambda t: rule(t, "plus_plus"),
    lambda t: rule(t, "c_sharp"),
)


def for_stemming(text: Column) -> Column:
    return reduce(lambda t, f: f(t), FOR_STEMMING, text)


# Seniority tags and the patterns that give them, for texts in any case. White space in
# them counts for nothing, as they are taken in verbose mode; three of them give a level.
SENIORITY = {
    "senior": r"\bsenior\b|\bsr\b|\bsnr\b",
    "junior": r"\bjunior\b|\bjr\b|\bjnr\b",
    "intern": r"\bintern(ship)?\b|\btrainee\b|\x07pprentice(ship)?",
    "assistant": r"\bassistant\b(?!\W+vice\b)",
    "associate": r"\bassoc.*\b",
    "entry_level": r"\bentry.*level\b|\bbeginner\b|\bfresh.*\b|\bcollegegrad.*\b",
    "master": r"(?<!scrum\s)(?<!web\s)master(?![data management])",
    "principal": r"\bprincipal\b",
    "head": r"\bhead\b",
    "fellow": r"\bfellow\b",
    "advanced": r"\badvanced\b",
    "post_doctoral": r"\bpost.*doctoral\b",
    "president": r"\b(?<!vice\s)president\b",
    "professional": r"\bprofessional\b",
    "expert": r"\bexpert\b",
    "midlevel": r"midlevel|\bmid\b",
    "chief": r"\bchief\b",
    "officer": r"\bofficer\b",
    "certified": r"\bcertif.*\b",
    "graduate": r"\bgraduate\b",
    "degree": r"\bgraduate\b",
    "staff": r"\bstaff\b",
}
LEVEL_PATTERNS = (
    r"\b(?:level|lvl|tier)\b\s+(\b[1-8]\b|one|two|three|iii|ii|iv|viii|vii|vi|v|i)",
    r"\bl(i+|v|[0-9])\b",
    r"\b(i+|v|iv|vi+)\b",
)
#: Levels in words and Roman numbers; viii has none.
LEVELS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "one": 1, "two": 2, "three": 3}


def level_number(level: Column) -> Column:
    """A whole number as it is, a word or Roman number by LEVELS, anything else 0."""
    low = F.lower(F.trim(level))
    pairs = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
    return F.coalesce(F.when(low.rlike(r"^[+-]?[0-9]{1,9}$"), low.cast("int")), F.try_element_at(pairs, low), F.lit(0))


def seniority_tags(title: Column) -> Column:
    """Sorted distinct tags of a title, with `level N` for each level."""
    tags = [F.when(title.rlike(f"(?iU){p}"), F.lit(t)) for t, p in SENIORITY.items()]
    levels = [F.transform(F.regexp_extract_all(title, F.lit(f"(?iU){p}"), F.lit(1)), lambda x: F.concat(F.lit("level "), level_number(x).cast("string"))) for p in LEVEL_PATTERNS]
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*tags)), *levels)))


# What a title loses before it is looked up, after spaces and parentheses became underscores.
TITLE_RANKS = (
    r"[sj]r._level_", r"^[seju]{2}nior[,_]*", r"[seju]{2}nior-?_", r",*_\(*[seju]{2}nior\)*_*", r"[seju]{2}nior\.",
    r"senior[\/-]lead_", r"-[seju]{2}nior", r"[seju]{2}nior\/", r"[seju]{2}nior-level_", r"\/contract\/[seju]{2}nior",
    r"\/[seju]{2}nior", r"[seju]{2}nior[-_]mid_", r"\/*[seju]{2}nior[-_]*level_?", r"\/*mid[-_]*level_?", r"mid[ -_to]{4}[seju]{2}nior[ -_]level[ -_]",
    r"mid\/sr_level_", r"[-_]{0,3}mid_level", r"[-_]{0,3}mid", r"_level_\d+",
)


def normal_title(title: Column) -> Column:
    """Lower case, spaces and parentheses as underscores, words of rank taken out."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[ \(\)]|\\\/", "_"), "|".join(TITLE_RANKS), "")


def title_list(text: Column) -> Column:
    """A one-element list of the title in lower case without punctuation; the punctuation takes the ~ between titles with it. Empty gives []."""
    bare = F.regexp_replace(F.ltrim(F.lower(text)), rf"[^\p{{L}}\p{{N}}_\s]", "")
    return F.filter(F.split(bare, "~"), lambda x: x != "")


def split_list(text: Column, separator: str = "::") -> Column:
    """Trimmed lower-case parts without blanks."""
    parts = F.transform(F.split(text, separator), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def parse_list(text: Column) -> Column:
    """A list written as text, ['a', "b"], in lower case; quotation marks of either kind, never evaluated. What is no list gives null."""
    as_json = F.regexp_replace(F.regexp_replace(text, r"(?<=[\[,\s])'((?:[^'\\]|\\.)*)'(?=\s*[,\]])", '"$1"'), r"\\'", "'")
    return F.transform(F.from_json(as_json, "array<string>"), F.lower)


def split_parentheses(text: Column) -> Column:
    """`X (Y)` as [X, Y]."""
    return F.filter(F.transform(F.split(text, r"\("), lambda x: F.trim(F.replace(x, F.lit(")"), F.lit("")))), lambda x: x != "")


def phrase_words(phrases: Column) -> Column:
    """The distinct words of a list of phrases, sorted."""
    words = F.flatten(F.transform(F.filter(phrases, lambda x: x != ""), lambda x: F.split(x, " ")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda x: x != "")))


def lower_list(items: Column) -> Column:
    return F.coalesce(F.transform(items, F.lower), F.array().cast("array<string>"))


def drop_neighbours(items: Column) -> Column:
    """Sorted distinct tokens that differ from the next one; the last never counts, nor do blanks."""
    # Next to each other by one pass: a lambda that names items would make the list again for each token.
    after = F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(0)))
    keep = F.zip_with(items, after, lambda x, y: F.when((x != y) & (x != ""), x))
    return F.array_sort(F.array_distinct(F.array_compact(keep)))


def keep_minus_stop(words: Column, keep: Column, stop: Column) -> Column:
    """Words that are in keep and not in stop."""
    return F.filter(words, lambda w: F.array_contains(keep, w) & ~F.array_contains(stop, w))


def reconcile_titles(job: Column, current: Column, desired: Column) -> Column:
    """The current titles to match by: the job's title where the desired ones hold it, the desired ones where there is none; with the desired ones, distinct, sorted, joined by ::."""
    taken = F.when(F.contains(desired, job), job).when(current == "", desired).otherwise(current)
    return F.array_join(F.array_sort(F.array_union(F.split(taken, "`"), F.split(desired, "`"))), "::")


def desired_or_current(desired: Column, current: Column) -> Column:
    return F.when(desired == "", current).otherwise(desired)


# A posting's clean-up in its order, as (pattern, replacement).
POSTING = {
    "info_tech": (r" IT |i\.t\.|I\.T\.", " information technology "),
    "urls": (r"https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*)|[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*)", ""),
    "punctuation": (r"(?U)[•™\#\*\|\(\)\"\?\@,:;“”·–_]+|\.(?!\w+)", ""),
    "slashes": (r"/|-", " "),
    "ampersand": (r"&", "and"),
    "period_typos": (r"(?![a-z]+)\.(?=[A-z][a-z]+)", " "),
    "unicode": (r"\x01", ""),
    "camel_case": (r"(?<=[a-z])([A-Z])(?! )", " $1"),
}


def posting_words(text: Column) -> Column:
    """A posting's words after the clean-up, in lower case; two spaces in a row make an empty one."""
    return F.split(F.lower(reduce(lambda t, r: F.regexp_replace(t, *r), POSTING.values(), text)), " ")


def fixed_lemmas(words: Column, lemmas: dict[str, str]) -> Column:
    """Words with some taken for others, such as datum for data."""
    pairs = F.create_map(*(F.lit(x) for kv in lemmas.items() for x in kv))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(pairs, w), w))


def without_stop_words(words: Column, stop: list[str]) -> Column:
    held = F.array(*map(F.lit, stop)).cast("array<string>")
    return F.filter(words, lambda w: ~F.array_contains(held, w))


def years_from_text(text: Column, most: float, units: int = 1) -> Column:
    """Years of a text that gives a number of units, so many of them in a year, or NOT FOUND: cut to -1 and most; -1, as NOT FOUND is taken, becomes null."""
    number = F.when(text == "NOT FOUND", F.lit(-float(units))).otherwise(text.cast("double")) / units
    return F.nullif(F.greatest(F.lit(-1.0), F.least(F.lit(float(most)), number)), F.lit(-1.0))
