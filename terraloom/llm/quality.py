"""Quality rules: counted properties of a text, then its likeness to trusted text.

Hashed n-grams (words, pairs of neighbouring words, runs of ASCII punctuation) fall
into a fixed number of buckets.  Two multinomials over the buckets are estimated,
one from all documents and one from trusted ones; a document's score is the mean,
over its n-grams, of the log-likelihood ratio of the two.  A document passes when
no base rule rejects it and its score reaches a fixed threshold, so the verdict on
a document never depends on chance or on the other documents of its partition.

Only DataFrame functions are used.  The counts of all documents are combined by
bucket before they are shuffled; the weights are one array of BUCKETS numbers.

Null text has no words; a text of fewer than ``MIN_WORDS`` words fails the base
rules.  Without trusted documents all weights are 0 and the base rules decide.
Repeated rows are judged alike, an empty table gives an empty result, and columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.shared import SPACE, let, materialise

BUCKETS = 8192
#: Trusted ids that the target model is estimated from, at most: those of least hash.
#: The ids (8 bytes each) are broadcast; raw counts come from all documents.
MAX_TRUSTED = 50_000
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Least mean log-likelihood ratio (natural logarithm) of a document that is kept.
MIN_SCORE = -0.12
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
PUNCTUATION = r"[!-/:-@\[-`{-~]+"


def _split(text) -> F.Column:
    """Words of a text that has one at least; of any other text one empty string."""
    return F.split(F.btrim(text, F.lit(BLANKS)), SPACE)


def _pairs(hashes, step: int) -> F.Column:
    """Each hash combined with the one ``step`` places on; the last ``step`` are void."""
    return let(hashes, lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda a, b: F.xxhash64(a, b)))


def _head(values, drop: int) -> F.Column:
    return let(values, lambda x: F.slice(x, 1, F.greatest(F.size(x) - drop, F.lit(0))))


def hashed(docs: DataFrame) -> DataFrame:
    """Adds h (hashes of words) and h2 (of pairs of neighbours, the last one void)."""
    empty = F.array().cast("array<bigint>")
    h = F.when(F.btrim("text", F.lit(BLANKS)) == "", empty).otherwise(F.transform(_split("text"), lambda w: F.xxhash64(w)))
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", h).withColumn("h2", _pairs(F.col("h"), 1))


def features() -> F.Column:
    """Hashes of a text's n-grams, from the columns text, h and h2."""
    marks = F.transform(F.regexp_extract_all("text", F.lit(PUNCTUATION), 0), lambda p: F.xxhash64(p))
    return F.concat(F.col("h"), _head(F.col("h2"), 1), marks)


def repeated_words() -> F.Column:
    """Words that lie in windows found twice or more, from the column h2."""
    windows = _head(_pairs(_pairs(F.col("h2"), 2), 4), WINDOW - 1)

    def starts(s):  # of windows with an equal neighbour in the sorted array
        n = F.size(s)
        same = lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

    def covered(p):
        steps = F.transform(p, lambda x, j: F.when(j == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, j - 1))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(g):
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeats = let(let(ordered, starts), covered)
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(repeats)

    return F.when(F.size("h2") < WINDOW, F.lit(0).cast("bigint")).otherwise(let(windows, count))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts that the base rules use to ``hashed`` documents."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return docs.withColumns({
        "n_words": F.size("h").cast("bigint"),
        "word_chars": F.length(F.regexp_replace("text", SPACE, "")).cast("bigint"),
        "n_symbols": F.size(F.regexp_extract_all("text", F.lit(SYMBOLS), 0)).cast("bigint"),
        "n_dup_lines": F.when(F.instr("text", "\n") == 0, F.lit(0)).otherwise(repeats).cast("bigint"),
        "n_repeat_words": repeated_words(),
    })


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with ``weights``: the log-likelihood ratio of each bucket.

    labels (doc_id, quality): documents of quality 1 are trusted.
    """
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRUSTED)
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("trusted", F.lit(1))), "doc_id", "left")
    grams = hashed(flagged).select(F.explode(features()).alias("g"), "trusted")
    counts = grams.groupBy(F.col("g").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    counts = materialise(counts, "grams")
    total = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(F.broadcast(counts), "bucket", "left").join(F.broadcast(total))
    log = lambda n, of: F.log((F.coalesce(n, F.lit(0)) + F.lit(SMOOTHING)) / (F.col(of) + F.lit(SMOOTHING * BUCKETS)))
    ratio = F.when(F.col("all_target") > 0, log("target", "all_target") - log("raw", "all_raw")).otherwise(F.lit(0.0))
    pairs = every.select(F.struct("bucket", ratio.alias("ratio")).alias("p"))
    return pairs.agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["ratio"]).alias("weights"))


def _judged(docs: DataFrame, labels: DataFrame, min_score: float) -> DataFrame:
    """Adds the counts, base_failed, score and kept to rows with doc_id and text."""
    model = materialise(weights(docs, labels), "weights")
    told = base_counts(hashed(docs)).withColumn("g", features()).withColumn("weights", model.scalar())
    score = F.aggregate("g", F.lit(0.0), lambda a, x: a + F.get("weights", x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    told = told.withColumns({"base_failed": failed, "score": F.when(F.size("g") > 0, score / F.size("g"))})
    return told.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= min_score, F.lit(False)))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, the counts, base_failed, score (null without n-grams) and kept."""
    told = _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, min_score)
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, with all their columns, that ``judge`` keeps; nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    # the row number keeps the filter above the counts: pushed below, it would make them anew
    told = _judged(rows, labels, min_score).withColumn("at", F.monotonically_increasing_id())
    return told.where("kept AND at >= 0").select("row.*")
