"""Drop lines whose template recurs across documents, by a fixed-depth parse tree.

A line's tokens are what white space separates; tokens with a digit count as the
wildcard.  The tree has two levels: token count, then the first DEPTH tokens.  In a
leaf, lines are matched to templates: a line joins the most similar template that
agrees with it in SIMILARITY of its tokens, and tokens that differ become gaps.  A gap
agrees with nothing, so all lines of a template agree in SIMILARITY of their tokens.
A template found in MIN_DOCS documents or more is recurring: its lines are dropped
everywhere but in the document of least id that has it; what differs between them, in
up to 1 - SIMILARITY of their tokens, goes with the lines.

Lines are counted before they are compared: only leaves with lines of MIN_DOCS
documents are parsed, each distinct line once.  A leaf of more than BLOCK lines is
parsed by connected groups: lines that can share a template have a run of tokens at one
place in common, and are linked by it.  Groups don't touch one another's templates, so
what is found is that of the leaf parsed whole; a group comes to one task whole.

Lines of fewer than MIN_TOKENS tokens are never dropped.  Null text stays null and
has no lines.  Rows with one id count as one document, null ids together too, and all
rows with the id that keeps a line keep it.  A very long line is one line, compared
whole.  An empty table gives an empty result.  The input's columns are kept, but for
those with a name of ``KEYS`` or of the three counts, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terraloom.llm.graph import components
from terraloom.llm.shared import materialise
from terraloom.llm.shingles import slices

DEPTH, MIN_TOKENS, SIMILARITY, MIN_DOCS = 3, 5, 0.75, 5
BLOCK = 2000
#: Lines to drop are broadcast up to this number (16 bytes each), else joined by document.
BROADCAST_ROWS = 1_000_000
ANY = "\u0001*"
#: Code of a token in which a template's lines differ; no line has it.
GAP = -1
DIGIT = re.compile(r"\d")
NO_ID = -(2**63)
#: Columns of our own; the input's columns of these names are left out.
KEYS = ("_tl_id", "_tl_row", "_tl_line", "_tl_leaf", "_tl_drop")


def tokens(line: str) -> list[str]:
    found = line.split()
    return [ANY if DIGIT.search(t) else t for t in found] if DIGIT.search(line) else found


def key(parts: list[str]) -> int:
    h = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def leaf(parts: list[str]) -> int:
    return key([str(len(parts)), *parts[:DEPTH]])


def gaps(n: int) -> int:
    """In how many of n tokens lines of one template may differ."""
    return int(n - np.ceil(SIMILARITY * n))


def segments(n: int, start: int = 0) -> list[tuple[int, int]]:
    """The places from ``start`` to n in gaps(n) + 1 runs: lines that are equal before
    ``start`` and differ in no more than gaps(n) places are equal in one of them.  A run
    may be empty; then all such lines are."""
    parts = gaps(n) + 1
    cuts = [start + (n - start) * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def templates(lines: list[list[str]]) -> tuple[list[int], list[list[str]]]:
    """For token lists of one length, in order: each one's template's number, and the
    templates.  They are found greedily; ties go to the earlier template."""
    codes: dict[str, int] = {ANY: 0}
    rows = np.array([[codes.setdefault(t, len(codes)) for t in line] for line in lines], np.int64)
    n = rows.shape[1]
    varying = np.flatnonzero((rows != rows[0]).any(axis=0))
    start = int(varying[0]) if len(varying) else 0
    runs = segments(n, start)
    made, count, told = np.zeros((16, n), np.int64), 0, []
    # a template's fixed tokens are its first line's, so it is found by that line's runs
    having: dict[tuple[int, bytes], list[int]] = {}
    for row in rows:
        keys = [(k, row[a:b].tobytes()) for k, (a, b) in enumerate(runs)]
        near = np.array(sorted({t for key_ in keys for t in having.get(key_, ())}), np.int64)
        k = -1
        if len(near):
            equal = made[near] == row
            same = np.where((equal & (row != 0)).any(axis=1), equal.sum(axis=1), 0)
            best = int(np.argmax(same))
            k = int(near[best]) if same[best] >= SIMILARITY * n else -1
        if k >= 0:
            made[k][made[k] != row] = GAP
        else:
            if count == len(made):
                made = np.concatenate([made, np.zeros_like(made)])
            made[count], k = row, count
            for key_ in keys:
                having.setdefault(key_, []).append(k)
            count += 1
        told.append(k)
    names = {v: t for t, v in codes.items()} | {GAP: "\u0001?"}
    return told, [[names[c] for c in m] for m in made[:count].tolist()]


def _parse(df: DataFrame, by: list[str]) -> DataFrame:
    """leaf, line, template (tokens) of rows (leaf, line, tokens, *by), parsed by group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        told, made = templates([list(t) for t in pdf["tokens"]])
        return pd.DataFrame({"leaf": pdf["leaf"], "line": pdf["line"], "template": [made[k] for k in told]})

    return df.groupBy(*by).applyInPandas(run, "leaf long, line long, template array<string>")


def _hash(column: str) -> F.Column:
    return F.xxhash64(F.array_join(column, "\0"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """line, run (hash of leaf, place and tokens) for each run of each line."""
    for batch in batches:
        lines, found = [], []
        for h, own, t in zip(batch.column("line").to_pylist(), batch.column("leaf").to_pylist(), batch.column("tokens").to_pylist()):
            for a, b in segments(len(t), min(DEPTH, len(t))):
                lines.append(h)
                found.append(key([str(own), str(a), *t[a:b]]))
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(found, pa.int64())], ["line", "run"])


def parse_tree(lines: DataFrame) -> DataFrame:
    """line, template (hash) of distinct lines (leaf, line, tokens)."""
    sizes = lines.groupBy("leaf").agg(F.count("*").alias("n"))
    large = lines.join(sizes.where(F.col("n") > BLOCK).select("leaf"), "leaf", "left_semi")
    runs = materialise(large.select("leaf", "line", "tokens").mapInArrow(_runs, "line long, run long"), "runs")
    links = runs.join(runs.groupBy("run").agg(F.min("line").alias("least")), "run").select(F.col("line").alias("a"), F.col("least").alias("b"))
    groups = components(links).select(F.col("node").alias("line"), F.col("component").alias("of"))
    small = lines.join(sizes.where(F.col("n") <= BLOCK).select("leaf"), "leaf", "left_semi").withColumn("block", F.lit(0).cast("long"))
    apart = large.join(groups, "line", "left").select(*lines.columns, F.coalesce("of", "line").alias("block"))
    told = _parse(small.unionByName(apart), ["leaf", "block"])
    return told.select("line", F.xxhash64("leaf", _hash("template")).alias("template")).distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with _tl_id, _tl_row (a number of its own), and for the lines of each text, in order, _tl_line and
    _tl_leaf.  A line that is too short has neither; a repeated one has no leaf.

    This is the only pass that hashes lines; what comes later reads what it wrote."""
    fields = [f for f in docs.schema.fields if f.name not in KEYS]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in fields), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_tl_id"), F.monotonically_increasing_id().alias("_tl_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                leaves, lines = [], []
                for text in part.column(text_col).to_pylist():
                    seen: set[int] = set()
                    own_leaves, own_lines = [], []
                    for line in (text or "").split("\n"):
                        t = tokens(line)
                        h = key(t) if len(t) >= MIN_TOKENS else None
                        own_lines.append(h)
                        own_leaves.append(None if h is None or h in seen else leaf(t))
                        seen.add(h)
                    leaves.append(own_leaves)
                    lines.append(own_lines)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lines, longs), pa.array(leaves, longs)], [*part.schema.names, "_tl_line", "_tl_leaf"])

    return materialise(rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("_tl_line array<long>, _tl_leaf array<long>").fields])), "line_keys")


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([tokens(x) for x in batch.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("line"), words], ["leaf", "line", "tokens"])


def recurring(docs: DataFrame, text_col: str, min_docs: int) -> DataFrame:
    """line, first (least id that has its template) of all lines of recurring templates,
    from ``keyed`` documents."""
    found = docs.select(F.col("_tl_id").alias("doc_id"), F.explode(F.arrays_zip("_tl_leaf", "_tl_line")).alias("k")).select("doc_id", F.col("k._tl_leaf").alias("leaf"), F.col("k._tl_line").alias("line")).where("leaf IS NOT NULL")
    counted = found.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    counted = materialise(counted, "lines")
    open_ = counted.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("lines")).where(F.col("n") >= min_docs)
    # a leaf with one line is its own template; others are parsed
    lone = counted.join(open_.where("lines = 1").select("leaf"), "leaf", "left_semi").where(F.col("first") < F.col("last")).select("leaf", "line", F.col("line").alias("template"))
    mixed = materialise(open_.where("lines > 1").select("leaf"), "leaves")
    mixed = F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed
    # a line's words come from the first document that has it, so each is read once
    wanted = counted.join(mixed, "leaf", "left_semi").select("line", F.col("first").alias("doc_id"))
    spelt = docs.select(F.col("_tl_id").alias("doc_id"), F.explode(F.arrays_zip("_tl_leaf", "_tl_line", F.split(F.col(f"`{text_col}`"), "\n").alias("text"))).alias("k")).select("doc_id", F.col("k._tl_leaf").alias("leaf"), F.col("k._tl_line").alias("line"), F.col("k.text").alias("text")).where("leaf IS NOT NULL")
    texts = spelt.join(mixed, "leaf", "left_semi").join(wanted, ["line", "doc_id"], "left_semi").select("leaf", "line", "text").mapInArrow(_tokenised, "leaf long, line long, tokens array<string>").dropDuplicates(["line"])
    told = parse_tree(texts).select("line", "template")
    told = materialise(told.union(lone.select("line", "template")), "tree")
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told
    # documents of a template: each one counts once, however many of its lines it has
    of_docs = found.join(told, "line").select("template", "doc_id").distinct()
    wide = of_docs.groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= min_docs)
    return told.join(wide, "template").select("line", "first")


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, drop_emptied: bool = False) -> DataFrame:
    """The documents with recurring lines dropped from the text, and n_lines,
    n_dropped_lines, n_dropped_words.  With ``drop_emptied``, documents that lose all
    their words this way are left out."""
    spark = docs.sparkSession
    counts = "n_lines long, n_dropped_lines long, n_dropped_words long"
    out_columns = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped_lines", "n_dropped_words", *KEYS)]
    names = [f.name for f in out_columns]
    docs = keyed(docs, id_col, text_col)
    drops = materialise(recurring(docs, text_col, min_docs), "drops")
    rows = docs.select(*(F.col(f"`{n}`") for n in names), "_tl_id", "_tl_row", "_tl_line")
    if drops.count() <= BROADCAST_ROWS:
        table = drops.toArrow()
        line = table.column("line").to_numpy()
        order = np.argsort(line)
        known = spark.sparkContext.broadcast((line[order], table.column("first").to_numpy()[order]))
    else:
        known = None
        mine = docs.select("_tl_id", "_tl_row", F.explode("_tl_line").alias("line")).where("line IS NOT NULL")
        per_doc = mine.join(drops, "line").where("_tl_id <> first").groupBy("_tl_row").agg(F.collect_set("line").alias("_tl_drop"))  # of one document's lines
        rows = rows.join(per_doc, "_tl_row", "left")

    def lost_lines(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Which lines of a batch go, and where each document's lines start and end."""
        lists = part.column("_tl_line")
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        lines, real = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), pc.is_valid(flat).to_numpy(zero_copy_only=False)
        if known is not None:
            line, first = known.value
            if not len(line):
                return np.zeros(len(lines), bool), at
            who = np.repeat(part.column("_tl_id").to_numpy(zero_copy_only=False), np.diff(at))
            near = np.minimum(np.searchsorted(line, lines), len(line) - 1)
            return real & (line[near] == lines) & (first[near] != who), at
        gone = np.zeros(len(lines), bool)
        for i, own in enumerate(part.column("_tl_drop").to_pylist()):
            gone[at[i] : at[i + 1]] = np.isin(lines[at[i] : at[i + 1]], np.array(own or [], np.int64))
        return real & gone, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                gone, at = lost_lines(part)
                before = np.concatenate([[0], np.cumsum(gone)])
                n_gone = before[at[1:]] - before[at[:-1]]
                texts = part.column(text_col)
                n_words, keep, changed = np.zeros(len(n_gone), np.int64), np.ones(len(n_gone), bool), []
                for i in np.flatnonzero(n_gone):  # all other texts pass through as they are
                    lines, lost = texts[i].as_py().split("\n"), gone[at[i] : at[i + 1]]
                    changed.append("\n".join(x for x, g in zip(lines, lost) if not g))
                    n_words[i] = sum(len(x.split()) for x, g in zip(lines, lost) if g)
                    keep[i] = bool(changed[-1].strip())
                if changed:
                    texts = pc.replace_with_mask(texts, pa.array(n_gone > 0), pa.array(changed, texts.type))
                n_lines = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
                columns = [texts if n == text_col else part.column(n) for n in names]
                columns += [pa.array(x.astype(np.int64)) for x in (n_lines, n_gone, n_words)]
                made = pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped_lines", "n_dropped_words"])
                yield made.filter(pa.array(keep)) if drop_emptied else made

    return rows.mapInArrow(run, StructType(out_columns + StructType.fromDDL(counts).fields))
