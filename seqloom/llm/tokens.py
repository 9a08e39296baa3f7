"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

A vocabulary has pieces that begin a word and pieces that go on in one. Greedy longest match takes
the longest beginning piece, then the longest continuing pieces. All pieces are put in one trie with
two roots. Where the trie has no way on, the failure link of a node leads to the node of what is
left after the longest pieces have been taken off its front, and the number of pieces taken is
stored with it; so a word is read once, its pieces are counted and never built.

A beginning piece may have an empty body, as the bare word-begin mark of byte-level vocabularies: it
is taken where no longer beginning piece fits, and the word is cut into continuing pieces after it.

A word that cannot be cut into pieces counts as one unknown token. Under a byte-level vocabulary,
which has the bare mark and every byte as a continuing piece, no word is unknown.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The vocabulary of a byte-level tokenizer marks word beginnings with this character.
WORD_BEGIN = "Ġ"

CACHED_WORDS = 500_000


def byte_letters() -> dict[str, int]:
    """Byte of each character in byte-level vocabularies: printable ones stand for themselves, the
    others, in order, for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Beginning and continuing pieces, as bytes, of a byte-level tokenizer file at `path`.

    The bare word-begin mark is the beginning piece of no bytes.
    Read on the driver only; the file's size bounds what is sent to tasks.
    """
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    first, later = [], []
    for name in names:
        begins = name.startswith(WORD_BEGIN)
        body = name[1:] if begins else name
        if name and all(c in letters for c in body):
            (first if begins else later).append(bytes(letters[c] for c in body))
    return first, later


class LongestMatch:
    """Automaton: `go` by node * 256 + byte, `fail` node or -1, `popped` pieces on failing."""

    FIRST, LATER = 0, 1

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        self.go: dict[int, int] = {}
        ends = {}
        self.size = 2
        bare = False
        for root, words in ((self.FIRST, first), (self.LATER, later)):
            for word in words:
                if not word:
                    bare |= root == self.FIRST
                    continue
                node = root
                for b in word:
                    key = node << 8 | b
                    nxt = self.go.get(key)
                    if nxt is None:
                        nxt = self.go[key] = self.size
                        self.size += 1
                    node = nxt
                ends[node] = True
        self.fail, self.popped = [-1] * self.size, [0] * self.size
        if bare:
            self.fail[self.FIRST], self.popped[self.FIRST] = self.LATER, 1
        children: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]
        for key, node in self.go.items():
            children[key >> 8].append((key & 255, node))
        queue = deque([self.FIRST, self.LATER])
        while queue:
            node = queue.popleft()
            for b, child in children[node]:
                queue.append(child)
                if child in ends:
                    self.fail[child], self.popped[child] = self.LATER, 1
                    continue
                # What the parent takes off goes first, then on from there until `b` fits.
                count, at = self.popped[node], self.fail[node]
                while at >= 0 and at << 8 | b not in self.go:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.go[at << 8 | b], count

    def count(self, word: bytes) -> int:
        """Pieces of a word, 1 (the unknown token) if it has no cut into pieces."""
        go, fail, popped = self.go.get, self.fail, self.popped
        node, total = self.FIRST, 0
        for b in word:
            nxt = go(node << 8 | b)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = go(node << 8 | b)
            node = nxt
        while node != self.LATER:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


# The automaton of this worker process, by the name of its vocabulary; made once, not per task.
_MADE: dict[str, LongestMatch] = {}


def token_counts(docs: DataFrame, first: list[bytes], later: list[bytes], doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) per row; null, empty and blank texts have none of either.

    Words are runs of characters other than blanks (see `common`). Repeated rows give repeated rows;
    other columns are not looked at. The vocabulary goes to every task: its size is that of the file.
    """
    pieces = docs.sparkSession.sparkContext.broadcast((list(first), list(later)))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = LongestMatch(*pieces.value)
        count = _MADE[name].count
        known: dict[bytes, int] = {}
        for batch in batches:
            words, tokens = [], []
            for body in batch["text"]:
                found = (body or b"").split()
                sizes = [known.get(w) for w in found]
                if None in sizes:
                    for i, n in enumerate(sizes):
                        if n is None:
                            sizes[i] = known[found[i]] = count(found[i])
                    if len(known) > CACHED_WORDS:
                        known.clear()
                words.append(len(found))
                tokens.append(sum(sizes))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n_words": np.array(words, np.int64), "n_tokens": np.array(tokens, np.int64)}
            )

    asked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return asked.mapInPandas(run, "doc_id long, n_words long, n_tokens long")
