"""Secret scan by assignment-aware lexing.

Source and configuration syntax is lexed into (name, expression) pairs: `name = "x"`, `name: x`,
`"name": "x"`, `export NAME=x`, `name := x`, `name => x`, `name: Type = "x"`, `a = b = "x"`, `name = f("x")`,
`#define NAME x` and `<name>x</name>`, with strings in any of three quotation marks and their escapes. String
constants are propagated: a name assigned to another name, or to a concatenation of literals and names, takes the literals that it
stands for, however many: the references between assignments are kept as a graph, and each assignment
takes the greatest weight of a name that leads to it. A name stands for its last assignment before, or
where there is none for the first after. Each literal is scored by how sensitive the names are that it
reaches and by how random it looks; those over a threshold are secrets, on top of three fixed patterns.
A literal with a blank in it is prose and no secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_chunks, table

# The base patterns, and the least lengths that a match needs.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "literal")

#: What a part of a target name adds to the score of a literal assigned to it.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "private": 0.6, "access": 0.4, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "key": 0.5, "signing": 0.4, "encryption": 0.4, "session": 0.3, "client": 0.2,
}
SENSITIVE, LEAST_LITERAL, LEAST_SCORE = 0.5, 8, 1.2

_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A string in quotation marks of one kind, with escapes; a call with strings and names; a bare value.
_STRING = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`)"""
_CALL = rf"""(?:[A-Za-z_$][\w.$]*+\((?:{_STRING}|[^()"'`\n])*+\))"""
_BARE = r"[A-Za-z0-9_$./+=-]+"
_BLANK = r"[\x20\t]*"
_PAIR = re.compile(
    # A name with a type takes a string or a call alone: `host: name=x` is none.
    rf"""["']?(?<![\w.$-])(?P<name>[A-Za-z_$][\w.$]*+(?:-[\w.$]++)*+)["']?(?:{_BLANK}:{_BLANK}[A-Za-z_&*][\w.$&*?]*+(?:[<\[][^<>\[\]\n=]{{0,80}}[>\]])?{_BLANK}={_BLANK}(?={_STRING}|{_CALL})|{_BLANK}(?::=|=>|[:=](?![=:])){_BLANK})"""
    rf"""(?P<value>(?:{_STRING}|{_CALL}|{_BARE})(?:{_BLANK}\+{_BLANK}(?:{_STRING}|{_CALL}|[A-Za-z_$][\w.$]*))*)"""
    rf"""|\#{_BLANK}define[\x20\t]+(?P<macro>\w+)[\x20\t]+(?P<body>{_STRING}|{_BARE})"""
    r"""|<(?P<tag>[A-Za-z_][\w.-]*+)>(?P<text>[^<>\n]+)</(?P=tag)>"""
)
_TERM = re.compile(r""""(?P<d>(?:[^"\\\n]|\\.)*+)"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>(?:[^`\\\n]|\\.)*+)`|(?P<w>[A-Za-z0-9_$./=-]++)(?!\()""")
#: What is itself a target, as in `a = b = "x"`.
_CHAIN = re.compile(rf"""(?P<next>[A-Za-z_$][\w.$]*+){_BLANK}={_BLANK}(?:[A-Za-z_$][\w.$]*+{_BLANK}={_BLANK})*+["'`]""")
#: Words that a call takes as the name of something.
_WORDS = re.compile(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*\Z")
_NAME = re.compile(r"[A-Za-z_$][\w.$]*\Z", re.A)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed patterns in code points, kind as its place in KINDS."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    return sum(NAME_WEIGHTS.get(p, 0.0) for p in {*parts, *map("".join, zip(parts, parts[1:]))})


def randomness(literal: str) -> float:
    """Shannon bits for each character, over 4, and a share for mixed character classes; 0 to about 1.5."""
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in (literal.count(x) for x in set(literal)))
    classes = sum(map(bool, (re.search("[a-z]", literal), re.search("[A-Z]", literal), re.search("[0-9]", literal), re.search("[^A-Za-z0-9]", literal))))
    return bits / 4 + 0.1 * (classes - 1)


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the literals that sensitive names stand for."""
    # An assignment is a node: its own literals, and the assignments that its names stand for.
    own: list[list[tuple[int, int]]] = []
    refers: list[list[int]] = []
    weights: list[float] = []
    known: dict[str, int] = {}
    waiting: dict[str, list[tuple[int, tuple[int, int]]]] = {}
    at = 0
    while m := _PAIR.search(text, at):
        reach, nodes, node, at = [], [], len(own), m.end()
        if m["tag"]:
            name = m["tag"]
            reach.append(m.span("text"))
        elif m["name"] and (chain := _CHAIN.match(text, m.start("value"))):
            # The next target is read as a name of its own, and this one stands for it.
            name, at = m["name"], m.start("value")
            waiting.setdefault(chain["next"], []).append((node, chain.span("next")))
        else:
            name, value = (m["name"], "value") if m["name"] else (m["macro"], "body")
            begin = m.start(value)
            for t in _TERM.finditer(m[value]):
                quoted = next((q for q in "dsb" if t[q] is not None), "")
                if quoted:
                    if "(" not in m[value][: t.start()] or not _WORDS.match(t[quoted]):
                        reach.append((begin + t.start(quoted), begin + t.end(quoted)))
                elif t["w"] in known:
                    nodes.append(known[t["w"]])
                else:
                    waiting.setdefault(t["w"], []).append((node, (begin + t.start(), begin + t.end())))
        for other, _ in waiting.pop(name, ()):
            if other != node:
                refers[other].append(node)
        known[name] = node
        own.append(reach)
        refers.append(nodes)
        weights.append(name_weight(name))
    # What no assignment explains is a literal itself if it can't be a plain name.
    for word, places in waiting.items():
        if not _NAME.match(word) or any(c.isdigit() for c in word):
            for node, span in places:
                own[node].append(span)
    # The most sensitive names first: each node is reached once, with the greatest weight that leads to it.
    best: dict[tuple[int, int], float] = {}
    reached = [False] * len(own)
    for k in sorted((k for k, w in enumerate(weights) if w >= SENSITIVE), key=lambda k: -weights[k]):
        todo = [k]
        while todo:
            j = todo.pop()
            if not reached[j]:
                reached[j] = True
                todo += refers[j]
                for span in own[j]:
                    best.setdefault(span, weights[k])
    out = []
    for (a, b), weight in best.items():
        literal = text[a:b]
        if len(literal) >= LEAST_LITERAL and " " not in literal and weight + randomness(literal) >= LEAST_SCORE:
            out.append((a, 3, b))
    return sorted(out)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text in (t.decode() for _, texts in byte_chunks(batch.column(1)) for t in texts):
            base = base_spans(text)
            own = literal_spans(text) if "=" in text or ":" in text or "</" in text or "#" in text else []
            covered = {(a, b) for a, _, b in base}
            spans = sorted(base + [x for x in own if (x[0], x[2]) not in covered])
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((*n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text of docs(doc_id, text, ...), one row for each row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end in code points,
    end exclusive, by start, then kind). Null and empty texts give zeros and empty spans; a null
    doc_id stays null; repeated rows give repeated results; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
