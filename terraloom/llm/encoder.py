"""Exact ids of the public byte-level BPE, a column at a time.

The vocabulary's pre-tokeniser never lets a token run across a single space that
stands between two characters that aren't white space: the space opens the next
token.  So a text's ids are those of its chunks, cut at each such space, one after
another.  A batch's distinct chunks are found by Arrow and encoded once each, and
the ids of whole texts are put together by numpy.  The library's BPE model gives
the ids of each run of letters; a bounded cache keeps them for later batches.
Chunks of any other shape go through the library's whole tokeniser.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of text that are encoded together.
SLICE_BYTES = 16_000_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for
    code points from 256 on, in ascending order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``texts(column)`` gives the ids of all texts and their offsets.

    Strings of special tokens in a text are ordinary text.  A null text is empty.
    ``room`` bounds each of the cache's two generations.
    """

    def __init__(self, path: str | None = None, room: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.library.encode_special_tokens = True
        self.size = self.library.get_vocab_size()
        self.model, self.letters, self.room = self.library.model, _byte_letters(), room
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a run of letters, with or without a space before it."""
        text = word if word[-1:].isascii() and word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text.replace(" ", self.letters[32]))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of letters and then punctuation, perhaps after a space; or of any text."""
        word = piece.rstrip(string.punctuation)
        if not (word[1:] if word[:1] == " " else word).isalpha():
            return self.whole(piece)
        tail = piece[len(word) :]
        ids = self.tails.get(tail)
        if ids is None:
            ids = self.whole(tail)
            if len(self.tails) < 10_000 and len(tail) <= 64:
                self.tails[tail] = ids
        return self._word(word) + ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and ``chunk``, which starts and ends without white space."""
        if "\n" in chunk:
            lines = chunk.split("\n")
            if all(x and x.strip() == x for x in lines):  # each break stands alone, and is a token of its own
                return self.line.join([self._piece(" " + lines[0]), *map(self._piece, lines[1:])])
            return self.whole(" " + chunk)
        return self._piece(" " + chunk)

    def _chunks(self, distinct: list[str]) -> list[bytes]:
        """``_chunk`` of each; white space at an end gives None."""
        found = list(map(self.new.get, distinct))
        for i in [i for i, x in enumerate(found) if x is None]:
            chunk = distinct[i]
            ids = self.old.get(chunk)
            if ids is None:
                if not chunk or chunk.strip() != chunk:
                    continue
                ids = self._chunk(chunk)
            if len(chunk) <= 64:
                self.new[chunk] = ids
            found[i] = ids
        if len(self.new) > self.room:
            self.old, self.new = self.new, {}
        return found

    def text(self, text: str) -> bytes:
        """The ids of one text, chunk by chunk; it may hold any white space."""
        chunks = BETWEEN.split(text)
        if len(chunks) == 1:
            return self.whole(text)
        return b"".join([self.whole(chunks[0]), *map(self._chunk, chunks[1:-1]), self.whole(" " + chunks[-1])])

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, one after another, and each text's offsets."""
        pieces = pc.split_pattern(pc.fill_null(column.cast(pa.large_string()), ""), " ")
        flat, bounds = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = flat.dictionary_encode()
        at, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        parts = self._chunks(distinct)
        odd = [i for i, x in enumerate(parts) if x is None]
        for i in odd:
            parts[i] = b""
        first = bounds[:-1]  # a list of pieces is never empty, not even of an empty text
        heads = flat.take(pa.array(first)).to_pylist()
        whole = np.zeros(len(heads), bool)
        if odd:
            marks = np.zeros(len(distinct) + 1, bool)
            marks[odd] = True
            hit = marks[at]
            hit[first] = [bool(h) and (h[0].isspace() or h[-1].isspace()) for h in heads]
            lone = np.diff(bounds) == 1
            hit[first] |= np.array([not h for h in heads]) & ~lone
            whole = np.logical_or.reduceat(hit, first)
        for i, head in enumerate(heads):
            parts.append(self.text(column[i].as_py()) if whole[i] else self.whole(head) if head else b"")
        at = at.astype(np.int32)
        at[first] = len(distinct) + np.arange(len(heads))
        length = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        start = np.cumsum(length, dtype=np.int32) - length
        size = length[at]
        if whole.any():
            keep = ~np.repeat(whole, np.diff(bounds))
            keep[first] = True
            size = np.where(keep, size, 0)
        ends = np.cumsum(size, dtype=np.int32)
        ids = np.frombuffer(b"".join(parts), "<u4")
        out = ids[np.repeat(start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        return out, np.concatenate([[0], ends[bounds[1:] - 1]]).astype(np.int64) if len(heads) else np.zeros(1, np.int64)

    def batches(self, batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of ``batch`` of about SLICE_BYTES of text, with ids and offsets."""
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // SLICE_BYTES
        for lo, hi in zip(cuts := np.flatnonzero(np.diff(group, prepend=-1)), [*cuts[1:], len(group)], strict=True):
            part = batch.slice(lo, hi - lo)
            yield part, *self.texts(part.column(text))


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
