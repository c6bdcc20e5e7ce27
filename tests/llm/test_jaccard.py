import random
import re

import numpy as np
import pyarrow as pa

from terraloom.llm import jaccard, shingles

SCHEMA = "doc_id long, text string"


def brute(rows, size, percent):
    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows, texts = [], []
    for i in range(90):
        if texts and rng.random() < 0.6:
            words = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 30, 60, 90]))
        texts.append(words)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words).title() if rng.random() < 0.2 else " ".join(words)))
    return [*rows, (100, None), (101, ""), (102, " \n "), (103, "w1"), (104, "W1 ")]


def test_components_match_brute_force(spark):
    for seed, size, percent in ((1, 4, 85), (2, 5, 80)):
        rows = corpus(seed)
        found = jaccard.join(spark.createDataFrame(rows, SCHEMA), size=size, percent=percent).collect()
        assert {tuple(r) for r in found} == brute(rows, size, percent)
        assert len(found) == len(rows)


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_null_ids_and_other_columns(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(5, text, 1), (5, text, 2), (None, text, 3), (2, text + " y", 4)]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string, component long")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in found) == [(-1, 2), (2, 2), (5, 2), (5, 2)]


def test_sets_of_slices_are_those_of_copies():
    texts = [None if i % 50 == 0 else "É" * (i % 5) + " Abc dÉ \n" * (i % 9) for i in range(3000)]
    whole = pa.array(texts)
    for at in (1, 7, 300, 1024, 2500):
        told, want = (list(shingles.sets(c, 4, True)) for c in (whole.slice(at, 400), pa.array(texts[at : at + 400])))
        assert all(np.array_equal(x, y) for x, y in zip(told, want, strict=True))


def test_lists_hold_shingles_of_several_classes_across_batches(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(14)], k=40))) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "class long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    codes = spark.sparkContext.broadcast(np.zeros(1 << (jaccard.SKETCH_BITS - 1), np.uint8))
    try:
        for batch, hot in ((3, 15), (1000, 15), (7, 0)):
            monkeypatch.setattr(jaccard, "HOT", hot)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found = jaccard.index_lists(df, 1, codes, 2, True).collect()
            told = {(r.shingle, r["class"]) for r in found}
            every = {(int(x.astype(np.int64)), i) for i, t in rows for x in next(shingles.sets(pa.array([t]), 2, True))}
            several = {(s, i) for s, i in every if len({j for z, j in every if z == s}) > 1}
            assert len(found) >= len(told) and several <= told <= every and (hot == 0 or told == several and len(found) == len(told))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_garbage_of_ended_rounds_is_collected(spark):
    """The driver's heap would else grow to its limit and stay there."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    rows = [(i, f"{' '.join(map(str, range(40)))} {i % 3}") for i in range(6)]
    assert {r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert whole() - before >= 4
