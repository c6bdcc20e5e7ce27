"""Language of a text by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary.  For each language a probability
of each piece is learnt by expectation maximisation: a forward and a backward pass
over a word give the expected number of times that each piece occurs in it, over all
ways to cut the word.  A text's likelihood in a language is the product of those of
its words, each the forward algorithm's sum over all segmentations.

Words are runs of letters, and of marks after letters, in lower case, opened by the
vocabulary's word mark.  A character that no piece covers counts as a piece of
probability UNSEEN.  Distinct words are scored together, one array operation for each
position and piece length; a run of any length, as in scripts without spaces, is read
whole, a part of it at a time.

Learning takes whole texts of about SAMPLE_DOCS documents of each language, those of
which a hash of the id is low enough, and of those words up to LEARN_WORD letters; the
model is languages x pieces, for at most MAX_LANGS languages, those with most documents.
``score`` is the winning
language's share of the likelihoods, each raised to the power 1 / sqrt(letters), as
letters of a text are far from independent.

A null text, or one without a letter, is ``und`` with score 0.  Documents without a
language teach nothing; with none to learn from, all is ``und``.  Ties go to the
language that sorts first.  Repeated rows are answered alike; an empty table gives an
empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.shared import materialise
from terraloom.llm.shingles import slices

VOCABULARY, MARK = "piece_bpe_32k.model", "▁"
SAMPLE_DOCS, ROUNDS, SMOOTHING, UNSEEN = 2000, 3, 0.1, 1e-7
#: Bounds of what is learnt: letters of a word, and languages.
LEARN_WORD, MAX_LANGS = 200, 500
#: Positions of words that are scored together, and of a long run at a time.
ROOM, LONG = 160_000, 64
#: All that isn't a digit, mark or sign counts as a letter, which is right for texts
#: without the characters of ``ODD``; the others are read by ``LETTERS``.
PLAIN, ODD = re.compile(r"[^\W\d_]+"), regex.compile(r"[\p{M}\p{Nl}\p{No}]")
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
NAMES = "doc_id long, held_out boolean, lang_pred string, score double"
UND = "und"


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces that words can hold: letters in lower case, perhaps after the mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    letters = regex.compile(rf"{MARK}?[\p{{L}}\p{{M}}]*")
    return sorted({p for p in pieces if p and p == p.lower() and letters.fullmatch(p)})


class Lattice:
    """For words: which piece, if any, ends at each position with each length."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.longest = max(map(len, pieces), default=1)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def ends(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and ids [word, end, length - 1] with -1 for no piece; the first
        position of each word is the mark."""
        return self._ends([MARK + w for w in words])

    def ends_of(self, text: str) -> np.ndarray:
        """ids [end, length - 1] of one text as it is."""
        return self._ends([text])[1][0]

    def _ends(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words])
        width = int(size.max())
        chars = np.zeros((len(words), width), np.uint64)
        joined = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        chars[np.repeat(np.arange(len(words)), size), np.arange(len(joined)) - np.repeat(np.cumsum(size) - size, size)] = joined + 1
        ids = np.full((len(words), width, self.longest), -1, np.int32)
        prime = np.uint64(0x100000001B3)
        part = np.zeros_like(chars)
        for length in range(1, min(self.longest, width) + 1):
            # part[:, i]: key of the piece of this length that starts at i
            part = part[:, : width - length + 1] * prime + chars[:, length - 1 :]
            if length == 1:
                part = chars.copy()
            at = np.minimum(np.searchsorted(self.keys, part), len(self.keys) - 1)
            ids[:, length - 1 :, length - 1] = np.where(self.keys[at] == part, self.order[at], -1)
        return size, ids


def forward(size: np.ndarray, ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the sums over all segmentations up to each position [word, position,
    language], and those of whole words.  p: pieces x languages."""
    n, width, longest = ids.shape
    scale = np.zeros((n, width + 1, p.shape[1]))
    padded = np.vstack([p, np.zeros((1, p.shape[1]))])
    for i in range(1, width + 1):
        live = np.flatnonzero(size >= i)
        top = scale[live, i - 1]
        total = np.maximum(padded[ids[live, i - 1, 0]], UNSEEN)
        for length in range(2, min(longest, i) + 1):
            own = ids[live, i - 1, length - 1]
            some = np.flatnonzero(own >= 0)
            if len(some):
                at = live[some]
                total[some] += p[own[some]] * np.exp(scale[at, i - length] - top[some])
        scale[live, i] = top + np.log(total)
    return scale, scale[np.arange(n), size]


def expected(size: np.ndarray, ids: np.ndarray, p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece in words of one language, weighted by count."""
    n, width, longest = ids.shape
    told, whole = forward(size, ids, p[:, None])
    a = told[:, :, 0]
    b = np.full((n, width + 1), -np.inf)
    b[np.arange(n), size] = 0
    out = np.zeros(len(p))
    with np.errstate(divide="ignore"):
        logp = np.log(np.append(p, 0))
        least = np.log(UNSEEN)
    for i in range(width, 0, -1):
        for length in range(1, min(longest, i) + 1):
            own = ids[:, i - 1, length - 1]
            some = np.flatnonzero((size >= i) & ((own >= 0) | (length == 1)))
            if not len(some):
                continue
            k = own[some]
            w = np.where(k >= 0, logp[k], least)
            w = np.maximum(w, least) if length == 1 else w
            step = w + b[some, i]
            b[some, i - length] = np.logaddexp(b[some, i - length], step)
            seen = k >= 0
            share = np.exp(a[some, i - length] + step - whole[some, 0]) * count[some]
            out += np.bincount(k[seen], weights=share[seen], minlength=len(p))
    return out


def word_list(text: str | None) -> list[str]:
    """Words of a text."""
    low = (text or "").lower()
    return PLAIN.findall(low) if low.isascii() or not ODD.search(low) else LETTERS.findall(low)


def together(sizes: list[int]) -> Iterator[slice]:
    """Slices of words in order of size, each of about ROOM positions in all."""
    lo = 0
    for hi in range(1, len(sizes) + 1):
        if hi == len(sizes) or (hi + 1 - lo) * (sizes[hi] + 1) > ROOM:
            yield slice(lo, hi)
            lo = hi


def whole_run(lattice: Lattice, word: str, p: np.ndarray) -> np.ndarray:
    """What ``forward`` gives for one word, in memory that doesn't grow with it."""
    longest, padded = lattice.longest, np.vstack([p, np.zeros((1, p.shape[1]))])
    recent = [np.zeros(p.shape[1])]  # of the last positions, the newest last
    text = MARK + word
    for lo in range(0, len(text), ROOM // 8):
        # the part's pieces may start in what came before it
        head = text[max(0, lo - longest + 1) : lo]
        ids = lattice.ends_of(head + text[lo : lo + ROOM // 8])[len(head) :]
        for own in ids:
            top = recent[-1]
            k = min(len(recent), longest)
            before = np.array(recent[: -k - 1 : -1])
            ways = padded[own[:k]]
            ways[0] = np.maximum(ways[0], UNSEEN)
            recent = [*recent[-longest + 1 :], top + np.log((ways * np.exp(before - top)).sum(axis=0))] if longest > 1 else [top + np.log(ways[0])]
    return recent[-1]


class Scorer:
    def __init__(self, pieces: list[str], p: np.ndarray, room: int = 200_000):
        self.lattice, self.p, self.room = Lattice(pieces), p, room
        self.new: dict[str, int] = {}
        self.rows = np.zeros((room + 1, p.shape[1]))

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        out = np.zeros((len(words), self.p.shape[1]))
        order = sorted((i for i in range(len(words)) if len(words[i]) <= LONG), key=lambda i: len(words[i]))
        for at in together([len(words[i]) for i in order]):
            part = order[at]
            size, ids = self.lattice.ends([words[i] for i in part])
            out[part] = forward(size, ids, self.p)[1]
        for i in range(len(words)):
            if len(words[i]) > LONG:
                out[i] = whole_run(self.lattice, words[i], self.p)
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods and letters of each text."""
        counts = [Counter(word_list(t)) for t in texts]
        vocabulary = set().union(*counts)
        if len(self.new) + len(vocabulary) > self.room:
            self.new = {}
            if len(vocabulary) > self.room:
                self.room = len(vocabulary)
                self.rows = np.zeros((self.room + 1, self.p.shape[1]))
        missing = [w for w in vocabulary if w not in self.new]
        if missing:
            start = len(self.new)
            self.rows[start : start + len(missing)] = self.words(missing)
            self.new.update(zip(missing, range(start, start + len(missing))))
        total = np.zeros((len(texts), self.p.shape[1]))
        letters = np.zeros(len(texts))
        for i, c in enumerate(counts):
            if c:
                at = np.fromiter(map(self.new.__getitem__, c), np.int64, len(c))
                n = np.fromiter(c.values(), np.int64, len(c))
                total[i] = n @ self.rows[at]
                letters[i] = n @ np.fromiter(map(len, c), np.int64, len(c))
        return total, letters


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, *, tokenizer: str | None = None) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and probabilities (pieces x languages) from (doc_id, text, lang)."""
    spark = docs.sparkSession
    taught = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = taught.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).select("lang", (F.lit(SAMPLE_DOCS * 2.0**31) / F.col("n")).alias("rate"))
    sample = taught.join(F.broadcast(rates), "lang").where(F.xxhash64("doc_id").bitwiseAND(F.lit(2**31 - 1)) < F.col("rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict[str, Counter] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    found.setdefault(lang, Counter()).update(w for w in word_list(text) if len(w) <= LEARN_WORD)
                rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "word", "n"])

    words = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words, "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    pieces = vocabulary(tokenizer)
    p = np.full((len(pieces), len(langs)), 1 / max(1, len(pieces)))
    for _ in range(ROUNDS if langs else 0):
        known = spark.sparkContext.broadcast((pieces, langs, p))

        def expect(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            own, names, prob = known.value
            lattice, total = Lattice(own), np.zeros((len(own), len(names)))
            for batch in batches:
                rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))), key=lambda r: (r[0], len(r[1]), r[1]))
                for k, name in enumerate(names):
                    mine = [r for r in rows if r[0] == name]
                    for at in together([len(r[1]) for r in mine]):
                        size, ids = lattice.ends([r[1] for r in mine[at]])
                        total[:, k] += expected(size, ids, prob[:, k], np.array([r[2] for r in mine[at]], float))
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        told = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()  # pieces x languages
        sums = np.full((len(pieces), len(langs)), SMOOTHING)
        sums[told.column("piece").to_numpy(), told.column("lang").to_numpy()] += told.column("n").to_numpy()
        p = sums / sums.sum(axis=0)
    return langs, pieces, np.round(p, 15)


def predict(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tokenizer: str | None = None) -> DataFrame:
    """NAMES for all documents, with a model learnt from those not held out."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = docs.sparkSession.sparkContext.broadcast(learn(docs, tokenizer=tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, p = known.value
        scorer = Scorer(pieces, p) if langs else None
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                pred, score = [UND] * len(texts), np.zeros(len(texts))
                if scorer:
                    total, letters = scorer.texts(texts)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        x = (total - total.max(axis=1, keepdims=True)) / np.sqrt(letters)[:, None]
                    best = total.argmax(axis=1)
                    share = np.exp(x)
                    score = np.where(letters > 0, share.max(axis=1) / share.sum(axis=1), 0.0)
                    pred = [langs[k] if n else UND for k, n in zip(best.tolist(), letters.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, NAMES)
