"""Counts of greedy word pieces in time linear in the text, without the pieces.

A trie over the vocabulary gets failure links: where no edge goes on, a node's link
leads to the node of what is left after the longest first pieces of its string are
taken off, and with the link goes how many pieces those are.  So a word is read once,
each step adds precomputed counts, and no piece is ever built or looked up.

The vocabulary is that of the public byte-level BPE: its pieces with a leading space
open a word, all others continue one.  The lone space opens a word too, where no
longer piece does.  Words are runs without ASCII white space.  A word that the
vocabulary can't spell counts as one unknown piece.

Null and empty texts have no words.  Repeated rows are each counted; an empty table
gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.encoder import VOCABULARY, _byte_letters
from terraloom.llm.shingles import slices

COUNTS = "doc_id long, n_words long, n_tokens long, n_unknown long"


class Automaton:
    """first: pieces that open a word; later: pieces that continue it (both without
    any mark; an empty first piece is a mark that stands alone).  ``count(word)`` is the number of greedy pieces, or -1 if there are none."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        first = set(first)
        # node 0 opens words, node 1 continues them
        self.edges: list[dict[str, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (after := self.edges[node].get(c)) is None:
                        after = self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = after
                ends[node] = node > 1
        self.link, self.popped = [-1] * len(ends), [0] * len(ends)
        if "" in first:
            self.link[0], self.popped[0] = 1, 1
        queue = deque((r, c, n) for r in (0, 1) for c, n in self.edges[r].items())
        while queue:
            up, c, node = queue.popleft()
            if ends[node]:
                self.link[node], self.popped[node] = 1, 1
            else:
                at, popped = self.link[up], self.popped[up]
                while at >= 0 and c not in self.edges[at]:
                    popped += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.edges[at][c], popped
            queue.extend((node, d, n) for d, n in self.edges[node].items())

    def count(self, word: str) -> int:
        edges, link, popped, node, n = self.edges, self.link, self.popped, 0, 0
        for c in word:
            while (after := edges[node].get(c)) is None:
                n += popped[node]
                if (node := link[node]) < 0:
                    return -1
            node = after
        while node > 1:
            n += popped[node]
            if (node := link[node]) < 0:
                return -1
        return n if node == 1 or not word else -1


class Counter:
    """The automaton of a vocabulary file, with a bounded cache of words."""

    def __init__(self, path: str | None = None, room: int = 300_000):
        from tokenizers import Tokenizer

        pieces = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY)).get_vocab(with_added_tokens=False)
        self.letters, space = _byte_letters(), _byte_letters()[32]
        self.automaton = Automaton([p[1:] for p in pieces if p[0] == space], [p for p in pieces if p[0] != space])
        self.room, self.new, self.old = room, {}, {}

    def word(self, word: bytes) -> int:
        n = self.new.get(word)
        if n is None:
            n = self.old.get(word)
            if n is None:
                text = word.decode("latin-1")
                n = self.automaton.count(text if text.isascii() and text.isprintable() else text.translate(self.letters))
            if len(self.new) >= self.room:
                self.old, self.new = self.new, {}
            if len(word) <= 64:
                self.new[word] = n
        return n

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, pieces and unknown words of each text; an unknown word is a piece."""
        pieces = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        flat, bounds = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = flat.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        told = np.fromiter(map(self.word, words), np.int64, len(words))
        full = np.fromiter(map(bool, words), np.int64, len(words))
        at = coded.indices.to_numpy(zero_copy_only=False)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at])])[bounds])
        return total(full), total(np.where(told < 0, 1, told) * full), total((told < 0) * full)


_counters: dict[str | None, Counter] = {}


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """COUNTS of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = Counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, _counters[tokenizer].texts(part.column("text")))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COUNTS)
