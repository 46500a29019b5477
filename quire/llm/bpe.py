"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves; a leaf holds the rank of the pair that it makes with the next live symbol, and a node
the smallest (rank, place) below it, packed in one number, so the root yields the leftmost lowest-rank merge. A merge updates two leaves and
their paths. Words recur, so a worker keeps up to ``kept`` encoded words and then starts anew.

The vocabulary file is a parameter. It is one with word ends: texts are composed (NFC), runs of white space become one
space, letters become lower case, and words are taken by the file's pattern. Special strings in a text become their
tokens before any of that.

Defined cases: null is the empty text, with no tokens; repeated rows are encoded each; words of any length work, in
O(n log n); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = 1 << 60
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
ODD_SPACE = re.compile("[\\x1c-\\x1f]")  # white space to Python alone
SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: visible Latin-1 ones for themselves, the rest from U+0100 up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def merge_word(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """``ids`` after all merges, the leftmost of lowest rank first. ranks: of pairs as ``a << 32 | b``; made: ids by rank."""
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    bits = n.bit_length()
    place = (1 << bits) - 1
    width = 1 << (n - 1).bit_length()
    rank = ranks.get
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        if (r := rank(ids[i] << 32 | ids[i + 1])) is not None:
            tree[width + i] = r << bits | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != NONE:
        i = root & place
        j = after[i]
        ids[i] = left = made[root >> bits]
        ids[j] = -1
        after[i] = k = after[j]
        changed = [(width + j, NONE)] if tree[width + j] != NONE else []
        if k < n:
            before[k] = i
            r = rank(left << 32 | ids[k])
            changed.append((width + i, NONE if r is None else r << bits | i))
        else:
            changed.append((width + i, NONE))
        if (h := before[i]) >= 0:
            r = rank(ids[h] << 32 | left)
            value = NONE if r is None else r << bits | h
            if tree[width + h] != value:
                changed.append((width + h, value))
        for at, value in changed:
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    return [x for x in ids if x >= 0]


class WordBpe:
    """Encodes and decodes by the vocabulary in ``path``."""

    def __init__(self, path: str, kept: int = 200_000):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model = given["model"]
        self.ids, self.end, self.kept = model["vocab"], model["end_of_word_suffix"] or "", kept
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner, self.last = [self.ids[x] for x in letters], [self.ids[x + self.end] for x in letters]
        split = next(x for x in given["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE[1:-2]))
        self.special = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.first_mark = os.path.commonprefix(list(self.special))
        self.space = re.compile(SPACE)
        self.names = {str(i): s for s, i in [*self.ids.items(), *self.special.items()]}
        self.seen: dict[str, tuple[int, str]] = {}  # of words
        self.former: dict[str, tuple[int, str]] = {}  # of words, the generation before
        self.chunks: dict[str, tuple[int, str] | None] = {}  # of what stands between white space, as given

    def words(self, chunk: str) -> list[str]:
        chunk = unicodedata.normalize("NFC", chunk)
        lower = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()  # a final sigma is not special here
        return self.word.findall(lower)

    def of_word(self, word: str) -> tuple[int, str]:
        """Number of tokens, and the ids joined by spaces."""
        *inner, last = word.encode()
        ids = merge_word([*map(self.inner.__getitem__, inner), self.last[last]], self.ranks, self.made)
        return len(ids), " ".join(map(str, ids))

    def of_chunk(self, chunk: str) -> tuple[int, str]:
        found = []
        for word in self.words(chunk):
            if (got := self.seen.get(word)) is None:
                got = self.seen[word] = self.former.get(word) or self.of_word(word)
            found.append(got)
        if len(found) == 1:
            return found[0]
        return sum(n for n, _ in found), " ".join(i for _, i in found)

    def encode(self, text: str) -> tuple[int, str]:
        """Number of tokens, and the ids joined by spaces."""
        if len(self.seen) > self.kept:
            self.former, self.seen = self.seen, {}
        if len(self.chunks) > self.kept:
            self.chunks.clear()
        known, found = self.chunks, []
        for k, part in enumerate(self.marks.split(text) if self.first_mark in text else [text]):
            if k % 2:
                found.append((1, str(self.special[part])))
                continue
            for chunk in self.space.split(part) if ODD_SPACE.search(part) else part.split():
                if (got := known.get(chunk)) is None:
                    got = known[chunk] = self.of_chunk(chunk)
                found.append(got)
        found = [x for x in found if x[0]]
        if not found:
            return 0, ""
        return sum(x[0] for x in found), " ".join([x[1] for x in found])

    def decode(self, ids: str) -> str:
        """The strings of ``ids`` (as encode gives them) joined by spaces, special ones too: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids.split(" "))) if ids else ""


@functools.lru_cache(2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document; with ``digests``, SHA-256 of the two."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                texts = [(i, bpe.decode(i)) for _, i in done]
                if digests:
                    texts = [(sha256(i), sha256(d)) for i, d in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([n for n, _ in done], pa.int64()), pa.array([i for i, _ in texts], pa.string()), pa.array([d for _, d in texts], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(encode, DIGEST if digests else SCHEMA)
