"""Benchmark items in documents, also with their numbers, names and units changed.

A text's words, without their punctuation and in lower case, are canonicalised:
words with a digit become one typed placeholder, units after a number another, and in
a second form capitalised words inside a sentence become a third.  In a third form
capitalised words that open a sentence are names too, and each run of names or of
numbers is one placeholder.  Windows of WINDOW words or placeholders of all forms are
hashed, and documents' windows are looked up in the hash table of the benchmark's
windows.  The windows of a document that match an item at one offset make an
alignment, and so do those at offsets that drift by at most DRIFT words from one to
the next; its words say how much of the item is there.

An alignment is a leak if it covers MIN_COVERAGE of the item's words, or a run of
MIN_RUN words of it, and if its slots are consistent: one value of the item always
stands for one value of the document, and the other way round.  Inconsistent slots
count as a leak only if MIN_LITERAL of the item's words are there as they are.

The table of the benchmark's windows goes to the executors in blocks of at most
BLOCK_WINDOWS windows, one pass over the documents for each block.

Null and empty texts match nothing, nor do items of fewer than MIN_WORDS words; an
item shorter than a window is one window.  Repeated items and documents are each
reported.  Empty tables give an empty result; other columns are kept by ``clean``
and ignored by ``leaks``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.shingles import slices, windows

WINDOW, MIN_WORDS, MIN_RUN = 8, 5, 13
MIN_COVERAGE, MIN_LITERAL = 0.5, 0.8
#: Words by which the offset of one alignment may change between windows.
DRIFT = 4
BLOCK_WINDOWS = 400_000
FILTER_BITS = 22
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Units of measure that may follow a number.
UNITS = "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg t lb lbs oz ml cl l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar c f k degrees percent usd eur gbp dollar dollars euro euros cent cents pound pounds kb mb gb tb bit bits byte bytes mph kmh".split()
MARKS = re.compile(r"[\W_]+")
SENTENCE_END = re.compile(r"[.!?:][\"')\]]*$")
LEAKS = "doc_id long, item_id long, n_windows long, n_words long, coverage double, n_slots long, n_changed long, consistent boolean, doc_word long"


class Words:
    """Canonical words of a column of texts; ``at`` are the texts' offsets."""

    def __init__(self, column: pa.Array):
        pieces = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        flat, bounds = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = flat.dictionary_encode()
        raw, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        cores = [MARKS.sub("", w) for w in raw]
        low = [c.lower() for c in cores]
        units = set(UNITS)
        digest = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in low), np.uint64, len(low))
        kind = np.fromiter((NUMBER if any(x.isdigit() for x in c) else UNIT if c in units else WORD for c in low), np.int8, len(low))
        capital = np.fromiter((c[:1].isupper() and c != c.upper() for c in cores), bool, len(cores))
        ends = np.fromiter((bool(SENTENCE_END.search(w)) for w in raw), bool, len(raw))
        full = np.fromiter(map(bool, cores), bool, len(cores))[index]
        self.at = np.concatenate([[0], np.cumsum(full)])[bounds].astype(np.int64)
        index = index[full]
        self.words, self.index = low, index
        first = np.zeros(len(index) + 1, bool)
        first[self.at] = True
        first = first[:-1]
        kinds = kind[index]
        after_number = np.concatenate([[False], kinds[:-1] == NUMBER]) & ~first if len(kinds) else np.zeros(0, bool)
        kinds = np.where((kinds == UNIT) & ~after_number, WORD, kinds)
        opens = first | np.concatenate([[True], ends[index][:-1]]) if len(kinds) else first
        self.kinds = np.where((kinds == WORD) & capital[index] & ~opens, NAME, kinds)
        self.exact = digest[index]
        self.plain = np.where((kinds == NUMBER) | (kinds == UNIT), kinds.astype(np.uint64), self.exact)
        self.typed = np.where(self.kinds == NAME, np.uint64(NAME), self.plain)
        loose = np.where((kinds == WORD) & capital[index], NAME, kinds)
        joins = np.concatenate([[False], (loose[1:] == loose[:-1]) & ((loose[1:] == NAME) | (loose[1:] == NUMBER))]) & ~first if len(kinds) else first
        heads = np.flatnonzero(~joins)
        run = np.where(loose == NAME, np.uint64(NAME), self.plain)[heads]
        each = np.arange(len(kinds) + 1)
        #: (hashes, the word that each one starts at, and where each text starts)
        self.forms = [(self.plain, each, self.at), (self.typed, each, self.at), (run, np.append(heads, len(kinds)), np.searchsorted(heads, self.at))]


class Table:
    """Windows of benchmark items (id, text), for lookups."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        w = self.words = Words(pa.array([t for _, t in items], pa.string()))
        found: list[tuple[np.ndarray, int, np.ndarray, int]] = []
        short: set[int] = set()
        at = w.at.tolist()
        for k, (lo, hi) in enumerate(zip(at, at[1:])):
            if hi - lo >= MIN_WORDS:
                for f, (form, _, bounds) in enumerate(w.forms):
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    if b - a >= MIN_WORDS:
                        h = windows(form[a:b], min(WINDOW, b - a))
                        found.append((h, k, np.arange(len(h)), f))
                        short.add(min(WINDOW, b - a))
        self.short = sorted(short - {WINDOW})
        self.hash = np.concatenate([h for h, *_ in found]) if found else np.zeros(0, np.uint64)
        self.item = np.concatenate([np.full(len(h), k) for h, k, *_ in found]) if found else np.zeros(0, np.int64)
        self.pos = np.concatenate([p for _, _, p, _ in found]) if found else np.zeros(0, np.int64)
        self.form = np.concatenate([np.full(len(h), f) for h, _, _, f in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.pos, self.form = self.hash[order], self.item[order], self.pos[order], self.form[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hash >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, w: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, form, place in the form, window size, entry of the table)."""
        for size in [*self.short, WINDOW]:
            for f, (form, _, bounds) in enumerate(w.forms):
                h = windows(form, size)
                at = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
                lo, hi = np.searchsorted(self.hash, h[at]), np.searchsorted(self.hash, h[at], "right")
                at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
                row = np.searchsorted(bounds, at, "right") - 1
                fits = at + size <= bounds[row + 1]
                for r, p, a, b in zip(row[fits].tolist(), at[fits].tolist(), lo[fits].tolist(), hi[fits].tolist()):
                    for k in range(a, b):
                        if self.form[k] == f:
                            yield r, f, p, size, k

    def leaks(self, column: pa.Array) -> Iterator[tuple]:
        """(row, item id, ...) in the order of LEAKS, for each item found in each text."""
        w = Words(column)
        if not len(self.hash) or not len(w.exact):
            return
        # each hit: first word there, its offset to the item's word, and the pairs of word ranges
        found: dict[tuple[int, int], dict[tuple, None]] = defaultdict(dict)
        for row, f, p, size, k in self.hits(w):
            item, q = int(self.item[k]), int(self.pos[k])
            own, there = self.words.forms[f], w.forms[f]
            q += int(own[2][item])
            first, base = int(there[1][p]), int(self.words.at[item])
            found[row, item][first, first - int(own[1][q]) + base, f, p, q, size] = None
        for (row, item), hits in sorted(found.items()):
            best = None
            for group in self._alignments(sorted(hits)):
                told = self._judge(w, row, item, group)
                if told and (best is None or (told[1], -told[-1]) > (best[1], -best[-1])):
                    best = told
            if best:
                yield row, self.ids[item], *best

    @staticmethod
    def _alignments(hits: list[tuple]) -> Iterator[list[tuple]]:
        """Hits at one offset, and chains of hits whose offsets drift."""
        exact: dict[int, list[tuple]] = defaultdict(list)
        for h in hits:
            exact[h[1]].append(h)
        yield from exact.values()
        if len(exact) == 1:
            return
        chains: list[list[tuple]] = []
        for h in hits:  # from the first word on; near: the chain with the closest offset that is not far behind
            near = [c for c in chains if abs(c[-1][1] - h[1]) <= DRIFT and h[0] - h[1] >= c[-1][0] - c[-1][1] - DRIFT]
            if near:
                min(near, key=lambda c: abs(c[-1][1] - h[1])).append(h)
            else:
                chains.append([h])
        yield from (c for c in chains if len({h[1] for h in c}) > 1)

    def _judge(self, w: Words, row: int, item: int, hits: list[tuple]) -> tuple | None:
        b, base = self.words, int(self.words.at[item])
        n = int(b.at[item + 1]) - base
        covered = np.zeros(n, bool)
        pairs: list[tuple[int, int, int, int]] = []
        used: set[int] = set()
        # single words first, then runs for what they leave open; no word stands for two
        for _, _, f, p, q, size in sorted(hits, key=lambda h: (h[2] == 2, h)):
            own, there = b.forms[f][1], w.forms[f][1]
            for k in range(size):
                a, e, x, y = int(own[q + k]), int(own[q + k + 1]), int(there[p + k]), int(there[p + k + 1])
                if covered[a - base : e - base].any() or any(j in used for j in range(x, y)):
                    continue
                covered[a - base : e - base] = True
                used.update(range(x, y))
                pairs.append((a, e, x, y))
        if not pairs:
            return None
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
        run = int((edges[1::2] - edges[::2]).max())
        text = lambda v, lo, hi: " ".join(v.words[v.index[i]] for i in range(lo, hi))
        forward: dict[str, set[str]] = defaultdict(set)
        back: dict[str, set[str]] = defaultdict(set)
        slots = slot_words = changed = literal = 0
        for a, e, x, y in pairs:
            s = e - a == y - x and bool((b.exact[a:e] == w.exact[x:y]).all())
            literal += (e - a) * s
            if b.kinds[a] != WORD or not s:
                mine, other = text(b, a, e), text(w, x, y)
                forward[mine].add(other)
                back[other].add(mine)
                slots, slot_words, changed = slots + 1, slot_words + e - a, changed + (not s)
        consistent = all(len(v) == 1 for m in (forward, back) for v in m.values())
        total = int(covered.sum())
        coverage = total / n
        if not (coverage >= MIN_COVERAGE or run >= MIN_RUN) or total - slot_words < MIN_WORDS - 1:
            return None
        if not consistent and literal / n < MIN_LITERAL:
            return None
        starts = {h[4] for h in hits if h[2] != 2} or {h[4] for h in hits}
        return len(starts), total, coverage, slots, changed, consistent, min(x for _, _, x, _ in pairs) - int(w.at[row])


def _tables(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Table]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")) + 1)).first()[0] or 0
    blocks = -(-3 * total // BLOCK_WINDOWS)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        yield Table([(r.item_id, r.text) for r in part.collect()])  # bounded by BLOCK_WINDOWS


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """LEAKS: one row for each document and item that it leaks, at its best alignment."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for t in _tables(benchmark, item_col, item_text_col):
        known = docs.sparkSession.sparkContext.broadcast(t)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id")
                    rows = [(ids[r].as_py(), *rest) for r, *rest in known.value.leaks(part.column("text"))]
                    if rows:
                        kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2 + [pa.bool_(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], [x.split()[0] for x in LEAKS.split(", ")])

        found = found.unionByName(docs.mapInArrow(run, LEAKS))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that leak no item; nothing is shuffled."""
    for t in _tables(benchmark, item_col, item_text_col):
        known = docs.sparkSession.sparkContext.broadcast(t)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    for r, *_ in known.value.leaks(part.column(text_col)):
                        keep[r] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
