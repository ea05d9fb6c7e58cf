"""BPE encoding and decoding.

A word is encoded left to right: an Aho-Corasick automaton gives the longest token that ends at each
place, a pair table tells whether two tokens may stand side by side in an exact merge sequence, and
where they may not the encoder backs up to the next shorter token. Each place is given up once at
most, so the time is linear in the word. Decoding looks each id up in a table of offsets into one
string that holds all tokens one after the other.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import byte_chunks, table, trimmed

#: Words, and pairs of tokens, that a worker remembers at most: half of them are of the generation before, and go when the present one is full.
REMEMBERED, PAIRS = 220_000, 200_000


def _byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level vocabularies: printable Latin-1 bytes are themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


class Codec:
    """Encodes and decodes as a tokenizers file of type BPE with byte letters and a word-end suffix says."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_names = {i: t for t, i in self.special.items()}
        self.letters = _byte_letters()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # The same splits in plain texts, by ranges: white space, lower-case letters and digits up to U+024F.
        self.plain_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f\u00aa\u00b5\u00ba]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\t-\r \u0085\u00a0a-z\u00df-\u00f6\u00f8-\u024f\u00aa\u00b5\u00ba0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+")
        # The library's own normaliser and splitter, for texts beyond Latin letters and general punctuation: their Unicode tables decide there.
        whole = Tokenizer.from_file(path)
        self.normaliser, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.odd = re.compile("[^\\x00-\u024f\u2010-\u2027\u20a0-\u20b9]")
        # Ranks and parts of merges. A word's last letter and its end mark are one unit.
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = self.vocab.get(a + b)
            if made is None or a not in self.vocab or b not in self.vocab:
                continue
            pair = self.vocab[a], self.vocab[b]
            self.rank.setdefault(pair, (rank, made))
            self.parts.setdefault(made, pair)
        self.mark = "\x00"  # stands for the end mark, one character, which no byte letter is
        self.units = {i: self._unit(t) for i, t in self.tokens.items()}
        # Only tokens that merges can make take part; the others never come out of an exact merge sequence.
        self.usable = {i for i in self.units if i not in self.parts and self._size(i) == 1}
        for made in sorted(self.parts, key=lambda m: self.rank[self.parts[m]][0]):
            if all(p in self.usable for p in self.parts[made]):
                self.usable.add(made)
        self.usable = {i for i in self.usable if self._size(i) == 1 or self._merged(self.units[i]) == [i]}
        self.find = ahocorasick.Automaton()
        for i in self.usable:
            self.find.add_word(self.units[i], (i, len(self.units[i])))
        self.find.make_automaton()
        self.by_unit = {self.units[i]: i for i in self.usable}
        self.shorter = {i: self._prefix(u) for u, i in self.by_unit.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        # The text of token i is joined[offset[i]:offset[i + 1]]. Ids without a token have no text.
        texts = [self.special_names.get(i, self.tokens.get(i, "")) for i in range(max([*self.tokens, *self.special_names]) + 1)]
        self.joined, self.offset = "".join(texts), [0, *accumulate(map(len, texts))]
        self.sizes = {i: len(u) for i, u in self.units.items()}
        self.written = list(map(str, range(len(texts))))

    def _unit(self, token: str) -> str:
        return token[: -len(self.end)] + self.mark if self.end and token.endswith(self.end) and token != self.end else token

    def _size(self, i: int) -> int:
        return len(self.units[i]) - self.units[i].endswith(self.mark)

    def _prefix(self, unit: str) -> int | None:
        """The longest usable token that is a proper prefix."""
        for n in range(len(unit) - 1, 0, -1):
            if (i := self.by_unit.get(unit[:n])) is not None:
                return i
        return None

    def _merged(self, unit: str) -> list[int]:
        """Plain merging by rank; for building the tables only."""
        marked = unit.endswith(self.mark)
        letters = unit[:-1] if marked else unit
        now = [self.vocab[x + (self.end if marked and k == len(letters) - 1 else "")] for k, x in enumerate(letters)]
        while True:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(now, now[1:])) if p in self.rank), default=None)
            if best is None:
                return now
            k = best[1]
            now[k : k + 2] = [self.rank[now[k], now[k + 1]][1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether exact merging leaves a and b side by side where they meet: no merge across the seam comes before those that make a and b."""
        key = (a, b)
        if (known := self.compatible.get(key)) is not None:
            return known
        limit, left, right, fine = len(self.rank) + 1, a, b, True
        # Undo the later of the two tokens' merges, again and again; a merge across the seam that ranks before what was undone since would have come first.
        while True:
            across = self.rank.get((left, right))
            if across is not None and across[0] < limit:
                fine = False
                break
            l_rank = self.rank[self.parts[left]][0] if left in self.parts else -1
            r_rank = self.rank[self.parts[right]][0] if right in self.parts else -1
            if l_rank < 0 and r_rank < 0:
                break
            if l_rank > r_rank:
                # At equal ranks of seam and left merge the left one comes first, as leftmost pairs merge first.
                limit, left = l_rank, self.parts[left][1]
            else:
                limit, right = r_rank + 1, self.parts[right][0]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[key] = fine
        return fine

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of byte letters."""
        text, sizes, compatible = word + self.mark, self.sizes, self.compatible
        n = len(text)
        longest: list[int | None] = [None] * n  # longest token that starts at each place
        for last, (i, size) in self.find.iter(text):
            longest[last - size + 1] = i  # of those with one start, the last to end is the longest
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while token is not None:
            end = at + sizes[token]
            # A token must not leave the end mark alone.
            if end != n - 1 and end not in dead and (not out or (compatible[pair] if (pair := (out[-1], token)) in compatible else self.fits(*pair))):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                dead.add(at)
                if not out:
                    break
                token = out.pop()
                at -= sizes[token]
                token = self.shorter[token]
                while token is None and out:
                    dead.add(at)
                    token = out.pop()
                    at -= sizes[token]
                    token = self.shorter[token]
        raise ValueError("the vocabulary lacks single letters")

    def _word(self, word: str) -> tuple[int, str, str]:
        """Number of ids, the ids written, and the decoded text of a word of plain characters."""
        made = self.older.get(word) or self._made(self.encode_word(word if word.isascii() and word.isalnum() else "".join([self.letters[b] for b in word.encode()])))
        if len(self.known) >= REMEMBERED // 2:
            self.older, self.known = self.known, {}
        if len(word) <= 32:
            self.known[word] = made
        return made

    def _made(self, ids: list[int]) -> tuple[int, str, str]:
        written = self.written
        return len(ids), " ".join([written[i] for i in ids]), self.decode(ids)

    def _plain(self, text: str) -> list[str]:
        """Words of a text without special tokens. Lower case and white space alone change common letters; composition has nothing to do."""
        return self.plain_words.findall(text.lower())

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """What the words and special tokens of a text become."""
        out: list[tuple[int, str, str]] = []
        known = self.known
        for part in self.split_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self._made([self.special[part]]))
            elif self.odd.search(part.lower()):  # some letters of the plain range have a lower case beyond it
                for letters, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(part)):
                    out.append(self._made(self.encode_word(letters)))
            else:
                out += [known.get(w) or self._word(w) for w in self._plain(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, written, _ in self.pieces(text) for i in written.split()]

    def decode(self, ids: list[int]) -> str:
        joined, offset = self.joined, self.offset
        return " ".join([joined[offset[i] : offset[i + 1]] for i in ids])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every whole text of docs(doc_id, text, ...) and decodes it again, one row for each row.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256. Null texts count as empty: no ids and an empty
    decoded text. A null doc_id stays null; repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in trimmed(batches):
            n, ids_sha, decoded_sha = [], [], []
            for text in (t.decode() for _, texts in byte_chunks(batch.column(1)) for t in texts):
                pieces = c.pieces(text)
                counts, written, decoded = zip(*pieces) if pieces else ((), (), ())
                n.append(sum(counts))
                ids_sha.append(hashlib.sha256(" ".join(written).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(" ".join(decoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
