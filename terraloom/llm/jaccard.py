"""Exact Jaccard self-join of word-shingle sets, by what is known of other sets.

1. Documents with equal sets are one class; classes are what is joined.
2. Index lists hold, for each shingle of a set's prefix, the sets that have it.
   Prefixes follow one global order, rare shingles first; two sets that link share
   a shingle of both prefixes.  How rare a shingle is comes from a sketch of fixed
   size, counts by hash of all sets, against its mean.  A shingle that only one
   set's prefix has is dropped as soon as lists are dealt out; those of the sketch's
   highest counts are dealt out by class too, so no task gets a whole hot list.
3. Each list names a pivot, its smallest class, and each set's overlap with its
   pivots is computed once.  While lists hold more pairs of different components than
   PAIRS_A_ROW for each of their entries, further rounds choose more pivots, each
   in one of LIST_SHARE lists.  So the
   sets of a group of near copies become one component through a few times as many
   comparisons as there are sets.
4. From the answers of the pivot those of the other sets follow: sets of one
   component need no comparison, and what x and y share is at most
   min(|x & p|, |y & p|) + min(|x - p|, |y - p|).
5. Lists are cut into blocks by set size and position; a pair of blocks is skipped
   when sizes, positions or components can't give a new link.  What is left is
   compared set by set.

The links kept join all that link: components are those of all links.

Sets are of 64-bit hashes: one of a billion different shingles shares its hash with
another with a probability of 5 in 100, which changes a link only if both texts are at
the very threshold.  Null text, empty text and text without words have an
empty set and link with nothing.  Very long texts are read whole, a slice at a time.
Repeated rows are each answered.  A document without an id has its class's component;
a class of which no document has an id isn't compared.  Columns other than the id and
the text are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import shingles
from terraloom.llm.graph import components
from terraloom.llm.shared import Scratch, let_go, materialise

#: The sketch has 2**SKETCH_BITS counts of half a byte; the driver and each worker hold it.
#: It decides how many candidates there are, never which links are found.
SKETCH_BITS, CHUNK_BITS = 26, 20
#: The highest code of a count, and the salts that lists of such shingles are dealt out by.
HOT, HOT_SALTS = 15, 64
#: Classes whose shingles a task counts once, at most.
SEEN = 200_000
#: Pivots of each list in the rounds after the first, which go on as long as lists hold
#: this many pairs of different components for each entry.
PIVOTS, PAIRS_A_ROW = (8, 64), 2
#: Each of these rounds looks at one in so many lists, as sets that link share many.
LIST_SHARE = 2
#: Rows of ids or classes are broadcast up to this number (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A component's rows are dealt out by so many salts.
SALTS = 32
CLASSES = "doc_id long, text_key long, class long, n_shingles long, chunk long, counts binary"
POSTINGS = "shingle long, class long, n int, pos int"


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has few rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _class(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def class_table(docs: DataFrame, size: int, lower: bool) -> DataFrame:
    """CLASSES of all documents (doc_id, text_key, text); the class of an empty set is
    null.  After its documents each task gives, as rows with a chunk, how often it has
    seen the shingles of each bucket, up to 255 times."""
    names = [x.split()[0] for x in CLASSES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint8), set()
        for batch in batches:
            for part in shingles.slices(batch, "text"):
                own, new = [], []
                for s in shingles.sets(part.column("text"), size, lower):
                    c = _class(s) if len(s) else None
                    own.append((c, len(s)))
                    if c is not None and c not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(c)
                        new.append(s)
                if new:
                    at, n = np.unique(_bucket(np.concatenate(new)), return_counts=True)
                    counts[at] = np.minimum(counts[at] + n, 255)
                classes, sizes = zip(*own)
                nulls = [pa.nulls(len(own), t) for t in (pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), *nulls], names)
        zstd = pa.Codec("zstd", compression_level=1)
        for k in range(0, len(counts), 1 << CHUNK_BITS):
            if (chunk := counts[k : k + (1 << CHUNK_BITS)]).any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([k]), pa.array([zstd.compress(chunk.tobytes(), asbytes=True)], pa.binary())], names)

    return docs.mapInArrow(run, CLASSES)


def sketch(chunks: DataFrame, mean: float, scratch: Scratch) -> np.ndarray:
    """Codes of all buckets' counts, two in a byte: twice the logarithm (base 2) of the
    count's ratio to the mean, or to 1 if the mean is less."""
    size = 1 << CHUNK_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, total = pa.Codec("zstd"), {}
        for batch in batches:
            for k, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                own = total.setdefault(k, np.zeros(size, np.uint32))
                own += np.frombuffer(zstd.decompress(counts.as_buffer(), size), np.uint8)
        for k, n in total.items():
            code = np.clip(np.ceil(2 * np.log2(np.maximum(n, 1) / max(1.0, mean))), 0, HOT).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([(code[::2] | code[1::2] << 4).tobytes()], pa.binary())], ["chunk", "counts"])

    # written first, as that lets the shuffle's files go at once
    told = scratch.write(chunks.repartition("chunk").mapInArrow(add, "chunk long, counts binary"), "codes").toArrow()  # half a byte for each bucket
    scratch.drop()
    out = np.zeros(1 << (SKETCH_BITS - 1), np.uint8)
    for k, codes in zip(told.column("chunk").to_pylist(), told.column("counts").to_pylist()):
        out[k // 2 : (k + size) // 2] = np.frombuffer(codes, np.uint8)
    return out


def _code(codes: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    at = _bucket(shingle)
    return codes[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & np.uint8(15)


def index_lists(docs: DataFrame, percent: int, known: Broadcast[np.ndarray], size: int, lower: bool) -> DataFrame:
    """POSTINGS, of documents (class, text): for each shingle of each set's prefix, the
    set's class and size and the shingle's place; only of shingles that several have.
    known: the sketch's codes."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles.slices(batch, "text"):
                own = list(shingles.sets(part.column("text"), size, lower))
                flat, n = np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))
                who = np.repeat(np.arange(len(n)), n)
                code = _code(known.value, flat)
                # sets are sorted, so shingles of one code stay in the order of hashes
                order = np.argsort(who * 16 + code, kind="stable")
                pos = np.arange(len(flat)) - (np.cumsum(n) - n)[who]
                keep = pos < (n - -(-percent * n // 100) + 1)[who]
                at, who, pos = order[keep], who[keep], pos[keep]
                classes = part.column("class").to_numpy()[who]
                salt = np.where(code[at] == HOT, classes % HOT_SALTS, -1)
                yield pa.RecordBatch.from_arrays([pa.array(flat[at].view(np.int64)), pa.array(classes), pa.array(n[who].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(salt.astype(np.int32))], ["shingle", "class", "n", "pos", "salt"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows whose shingle comes with another class too; those with a salt all.
        ``held`` is the last row so far, if its shingle has come once only."""
        held, last, last_class = None, None, None
        for batch in batches:
            key, who = batch.column("shingle").to_numpy(), batch.column("class").to_numpy()
            again = np.concatenate([[last is not None and key[0] == last and who[0] == last_class], (key[1:] == key[:-1]) & (who[1:] == who[:-1])]) if len(key) else np.zeros(0, bool)
            batch = batch.filter(pa.array(~again)) if again.any() else batch
            key = batch.column("shingle").to_numpy()
            if not len(key):
                continue
            if held is not None and key[0] == last:
                yield held
            before = np.concatenate([[last is not None and key[0] == last], key[1:] == key[:-1]])
            keep = before | np.append(before[1:], False) | (batch.column("salt").to_numpy() >= 0)
            held = None if keep[-1] else batch.slice(len(key) - 1, 1).drop_columns(["salt"])
            last, last_class = key[-1], batch.column("class")[-1].as_py()
            yield batch.filter(pa.array(keep)).drop_columns(["salt"])

    rows = docs.mapInArrow(post, f"{POSTINGS}, salt int")
    return rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "class").mapInArrow(shared, POSTINGS)


def set_table(docs: DataFrame, size: int, lower: bool) -> DataFrame:
    """class, set (sorted shingles) of documents (class, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles.slices(batch, "text"):
                own = list(shingles.sets(part.column("text"), size, lower))
                ends = np.cumsum([0, *map(len, own)])
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own).astype(np.int64)))], ["class", "set"])

    return docs.mapInArrow(run, "class long, set array<bigint>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, o (shared shingles), na, nb for pairs of classes (a, b).  Only the sets of
    classes in pairs are dealt out."""
    members = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    sets = sets.join(small(members), "class", "left_semi").dropDuplicates(["class"])
    a = sets.select(F.col("class").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("class").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("o"), F.size("sa").alias("na"), F.size("sb").alias("nb"))


def linked(o, na, nb, percent: int) -> F.Column:
    return 100 * o >= percent * (na + nb - o)


def least(x, y, percent: int) -> F.Column:
    """Overlap that sets of x and y shingles need for a link."""
    return F.ceil((x + y) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def open_lists(rows: DataFrame) -> DataFrame:
    """shingle, k (entries) and pairs (of different components) of lists with any."""
    parts = rows.groupBy("shingle", "component").agg(F.count("*").alias("k"))
    lists = parts.groupBy("shingle").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
    return lists.where("own < k * k").select("shingle", "k", ((F.col("k") * F.col("k") - F.col("own")) / 2).alias("pairs"))


def pivot_pairs(rows: DataFrame, percent: int, pivots: int) -> DataFrame:
    """Pairs (a, b) of each class and its lists' pivots, where they are of different
    components and their sizes and positions allow a link.  Without a number of pivots
    the column pivot names that of a list; else about so many classes of each list are
    pivots, those of least hash.  rows: shingle, class, n, pos, pivot, component."""
    if pivots:
        rows = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("k")), "shingle")
    chosen = F.pmod(F.xxhash64("class", F.lit(pivots)), F.col("k")) < pivots if pivots else F.col("class") == F.col("pivot")
    p = rows.where(chosen).select("shingle", *(F.col(x).alias(f"p_{x}") for x in ("class", "n", "pos", "component")))
    c = F.col
    near = (c("component") != c("p_component")) & (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")) & (F.least(c("n") - c("pos"), c("p_n") - c("p_pos")) >= least(c("n"), c("p_n"), percent))
    return rows.join(p, "shingle").where(near).select(F.least("class", "p_class").alias("a"), F.greatest("class", "p_class").alias("b")).distinct()


def block_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a list and that no
    bound rules out.  lists: shingle, class, n, pos, component, lo and hi (bounds of
    the overlap with the list's pivot)."""
    r = percent / 100
    rows = lists.withColumns({"by_size": F.floor(F.log(F.col("n").cast("double")) / F.lit(-float(np.log(r)))).cast("int"), "by_pos": F.floor(F.log2(F.col("pos") + F.lit(1.0))).cast("int")})
    blocks = rows.groupBy("shingle", "by_size", "by_pos").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("component").alias("c0"), F.max("component").alias("c1"))

    def side(df: DataFrame, k: str) -> DataFrame:
        return df.select("shingle", *(F.col(c).alias(f"{k}_{c}") for c in df.columns if c != "shingle"))

    c = F.col
    size_pos = lambda k: F.struct(f"{k}_by_size", f"{k}_by_pos")
    near = side(blocks, "x").join(side(blocks, "y"), "shingle").where(
        (size_pos("x") <= size_pos("y"))
        & (100 * c("x_n1") >= percent * c("y_n0"))
        & (F.least("x_rest", "y_rest") >= least(c("x_n0"), c("y_n0"), percent))
        & ~((c("x_c0") == c("x_c1")) & (c("y_c0") == c("y_c1")) & (c("x_c0") == c("y_c0")))
    ).select("shingle", "x_by_size", "x_by_pos", "y_by_size", "y_by_pos")
    x, y = side(rows, "x"), side(rows, "y")
    within = F.least("x_hi", "y_hi") + F.least(c("x_n") - c("x_lo"), c("y_n") - c("y_lo"))
    bound = F.least(within, c("x_n") - c("x_pos"), c("y_n") - c("y_pos"))
    open_ = (c("x_component") != c("y_component")) & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & (bound >= least(c("x_n"), c("y_n"), percent))
    once = (size_pos("x") < size_pos("y")) | (c("x_class") < c("y_class"))
    found = near.join(x, ["shingle", "x_by_size", "x_by_pos"]).join(y, ["shingle", "y_by_size", "y_by_pos"]).where(open_ & once)
    return found.select(F.least("x_class", "y_class").alias("a"), F.greatest("x_class", "y_class").alias("b")).distinct()


def _links(lists: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node, component of all classes that link.  lists: shingle, class, n, pos, pivot."""
    known, found = None, None
    rows = lists.withColumn("component", F.col("class"))
    for pivots in (0, *PIVOTS):
        let_go(sets.sparkSession)
        if pivots:  # lists whose sets are of one component stay closed
            own = found.select(F.col("node").alias("class"), "component")
            rows = rows.drop("component").join(small(own), "class", "left").withColumn("component", F.coalesce("component", "class"))
            work = scratch.write(open_lists(rows), "open")
            rows = scratch.write(rows.join(small(work.select("shingle")), "shingle", "left_semi"), "rows")
            entries, pairs = work.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
            if pairs <= PAIRS_A_ROW * entries:
                break
        more = pivot_pairs(rows.where(F.pmod(F.xxhash64("shingle", F.lit(pivots)), F.lit(LIST_SHARE)) == 0) if pivots else rows, percent, pivots)
        if known is not None:
            more = more.join(known.select("a", "b"), ["a", "b"], "left_anti")
        told = scratch.write(overlaps(scratch.write(more, "pairs"), sets), "overlaps")
        known = told if known is None else known.union(told)
        links = told.where(linked(F.col("o"), F.col("na"), F.col("nb"), percent)).select("a", "b")
        found = components(links if found is None else links.union(found.select("node", "component")))
    else:
        own = found.select(F.col("node").alias("class"), "component")
        rows = rows.drop("component").join(small(own), "class", "left").withColumn("component", F.coalesce("component", "class"))
        rows = scratch.write(rows.join(small(open_lists(rows).select("shingle")), "shingle", "left_semi"), "rows")

    let_go(sets.sparkSession)
    both = known.select(F.col("a").alias("class"), F.col("b").alias("pivot"), "o").union(known.select("b", "a", "o"))
    rows = rows.join(both, ["class", "pivot"], "left")
    self_ = F.when(F.col("class") == F.col("pivot"), F.col("n")).otherwise(F.col("o"))
    rows = rows.select("shingle", "class", "n", "pos", "component", F.coalesce(self_, F.lit(0)).alias("lo"), F.coalesce(self_, F.col("n")).alias("hi"))
    rest = block_pairs(rows, percent).join(known.select("a", "b"), ["a", "b"], "left_anti")
    rest = overlaps(scratch.write(rest, "pairs"), sets).where(linked(F.col("o"), F.col("na"), F.col("nb"), percent)).select("a", "b")
    rest = scratch.write(rest, "rest")
    let_go(sets.sparkSession)
    return components(rest.union(found.select("node", "component")))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of all
    documents; two link when 100 * shared >= percent * all of their shingles."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    let_go(spark)
    with Scratch(spark) as scratch:
        table = scratch.write(class_table(docs, size, lower), "seen")
        classes = materialise(table.where("chunk IS NULL").drop("chunk", "counts"), "classes")
        n = classes.where("class IS NOT NULL").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
        codes = spark.sparkContext.broadcast(sketch(table.where("chunk IS NOT NULL").select("chunk", "counts"), n / 2**SKETCH_BITS, scratch))
        scratch.drop()  # the counts aren't needed any more
        first = classes.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("d"))
        first = scratch.write(first.select("class", "d.doc_id", "d.text_key"), "first")

        def texts(of: DataFrame) -> DataFrame:  # class and text of the documents that stand for classes
            return docs.join(small(of), ["doc_id", "text_key"]).select("class", "text")

        lists = scratch.write(index_lists(texts(first), percent, codes, size, lower), "postings")
        codes.destroy()
        let_go(spark)
        lists = scratch.write(lists.join(lists.groupBy("shingle").agg(F.min("class").alias("pivot")), "shingle"), "lists")
        members = scratch.write(first.join(lists.select("class").distinct(), "class", "left_semi"), "members")
        sets = scratch.write(set_table(texts(members), size, lower), "sets")
        of = _links(lists, sets, percent, scratch).select(F.col("node").alias("class"), "component")

        named = of.join(first.select("class", "doc_id"), "class")
        salt = F.array(*map(F.lit, range(SALTS)))
        least_ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumn("salt", F.explode(salt))
        named = named.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(least_ids, ["component", "salt"]).select("class", "component_id")
        labels = first.join(named, "class", "left").select("class", F.coalesce("component_id", "doc_id").alias("component_id"))
        labels = materialise(labels, "labels")
    return classes.join(small(labels), "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
