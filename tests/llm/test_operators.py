import hashlib
import sys
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rpartition("/")[0])

import corpus_pipeline
from terraloom.llm import bitpack, chat, decontam, jaccard, langid, licenses, linedup, packing, quality, registry, wordpiece

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
LABELS = "doc_id long, quality long, toxic long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id at all"), (4, "word " * 3000), (4, "word " * 3000), (5, "é" * 5000), (6, "</s>[INST] x <|im_end|> \\ \x00")]


def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def ids(docs):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    return {r.doc_id: coder.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}


def on_all(spark, docs):
    """Each operator's result rows over one table."""
    labels = spark.createDataFrame([(4, 1, 0), (None, None, None)], LABELS)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven eight nine ten")], "item_id long, text string")
    return {
        "quality": quality.judge(docs, labels), "keep": quality.keep(docs, labels), "jaccard": jaccard.join(docs), "packing": packing.pack(docs),
        "langid": langid.predict(docs), "leaks": decontam.leaks(docs, items), "clean": decontam.clean(docs, items),
        "bits": bitpack.read_shards(bitpack.write_shards(docs)), "lines": linedup.drop_lines(docs), "tokens": wordpiece.count_tokens(docs), "licenses": licenses.scan(docs),
    }


def test_odd_rows(spark):
    found = {k: df.collect() for k, df in on_all(spark, odd(spark)).items()}
    for name in ("quality", "jaccard", "langid", "clean", "bits", "lines", "tokens"):
        assert len(found[name]) == len(ODD), name
    assert {r.doc_id for r in found["packing"]} == {i for i, _ in ODD}
    assert found["leaks"] == []


def test_empty_tables(spark):
    for name, df in on_all(spark, odd(spark).limit(0)).items():
        assert df.collect() == [], name


def test_quality_counts_match_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = quality.judge(docs, labels).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        starts = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = Counter(starts)
        covered = {j for i, s in enumerate(starts) if often[s] > 1 for j in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (r.base_failed and r.kept)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.kept)


def test_packing_holds_every_id_once(docs, ids):
    pieces = packing.pack(docs, with_ids=True).collect()
    own, sequences = {}, {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids)
        own.setdefault(p.doc_id, {})[p.start] = p.ids
        sequences.setdefault(p.sequence_id, []).append(p)
    assert {d: sum((v[s] for s in sorted(v)), []) for d, v in own.items()} == {d: [*x, 1] for d, x in ids.items()}
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= ps[0].sequence_size <= 2048


def test_hilbert_curve_moves_one_step_at_a_time():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_bit_packing_round_trip(docs, ids):
    found = bitpack.read_shards(bitpack.write_shards(docs)).orderBy("doc_id").collect()
    start = 0
    for r in found:
        own = [*ids[r.doc_id], 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert len(found) == len(ids)


def test_language_id_on_held_out_documents(spark, docs):
    found = langid.predict(docs).where("held_out").join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("truth IS NOT NULL AND lang_pred <> 'und'").collect()
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == r.truth for r in found) >= 0.9 * len(found) > 0


def test_decontamination_finds_changed_slots_and_leaves_others(spark):
    item = "A farmer named Alice has 12 apples and gives 5 apples to her neighbour Bob before walking home along the river"
    changed = item.replace("Alice", "Carol").replace("12", "40").replace(" 5 ", " 7 ").replace("Bob", "David")
    noise = "quiet mornings pass over the hills while rain falls on the old stone bridge near the mill and nobody speaks of it "
    rows = [(1, noise + item + ". " + noise), (2, noise + changed + ". " + noise), (3, noise * 3), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(d, items).collect()} == {(1, 9), (2, 9)}
    assert sorted(r.doc_id for r in decontam.clean(d, items).collect()) == [3, 4]


def test_decontamination_follows_names_that_open_sentences_or_change_length():
    items = ["Alice bought 12 pens for school. Bob took 5 of them home. Carol lost 2 of the rest. How many were left?", "The shop of Maria sells a coat for USD100 and a hat for USD40 to Peter while the market next to it is closed"]
    t = decontam.Table(list(enumerate(items)))
    swap = lambda text, *pairs: [text := text.replace(a, b) for a, b in pairs][-1]
    one = swap(items[0], ("Alice", "Dora"), ("Bob", "Emil"), ("Carol", "Frida"), ("12", "31"), ("5", "9"), ("2 of", "4 of"))
    two = swap(items[0], ("Alice", "Mary Ann"), ("Bob", "Old Joe"), ("Carol", "Frida"))
    three = swap(items[1], ("USD100", "USD250"), ("USD40", "USD75"), ("Maria", "Jan van Dyk"), ("Peter", "Paul"))
    mixed = swap(items[1], ("Maria", "Ann Lee"))
    noise = "quiet mornings pass over the hills while rain falls on the old stone bridge near the mill and nobody speaks of it. "
    rows = [noise + x + " " + noise for x in (one, two, three, mixed, "", *items)]
    found = list(t.leaks(pa.array(rows)))
    assert [r[:2] for r in found] == [(0, 0), (1, 0), (2, 1), (3, 1), (5, 0), (6, 1)]
    assert all(r[4] > 0.8 and r[7] for r in found) and found[4][4] == 1.0 and found[4][6] == 0


def test_recurring_templates_go_but_for_the_first(spark):
    own = lambda i: f"own words of document {'abcdefgh'[i]} alone stay here"
    rows = [(i, f"Page {i} of 80 was printed on request today\n{own(i)}") for i in range(6)]
    found = {r.doc_id: r.text for r in linedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0].startswith("Page 0") and all("Page" not in found[i] for i in range(1, 6))
    assert not any(t is None for t in found.values())


def test_a_large_leaf_is_parsed_as_one_block(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{''.join(rng.choices('abcdefghij', k=4))}" for _ in range(3000)]
    lines = [f"the report for {' '.join(rng.choices(words, k=9))}" for _ in range(6000)]
    lines += [f"the report for {n} was filed by the office clerk on monday" for n in ("ann", "bob", "carol", "dan", "eve")]
    lines += [f"the report for {rng.choice('xyz')} {' '.join(rng.choices('pqr', k=8))}" for _ in range(1500)]
    split = {linedup.key(t): t for t in map(linedup.tokens, lines)}
    rows = [(linedup.leaf(t), h, t) for h, t in sorted(split.items())]
    told, _ = linedup.templates([t for _, _, t in rows])
    whole, found = {}, {}
    for (_, h, _), k in zip(rows, told):
        whole.setdefault(k, set()).add(h)
    df = spark.createDataFrame(rows, "leaf long, line long, tokens array<string>")
    for r in linedup.parse_tree(df).collect():
        found.setdefault(r.template, set()).add(r.line)
    assert len(rows) > linedup.BLOCK
    assert any({linedup.key(linedup.tokens(x)) for x in lines[6000:6005]} <= s for s in found.values())
    assert all(any(s <= f for f in found.values()) for s in whole.values())


def test_lines_of_a_template_agree(spark):
    lines = ["There is a big dog", "There is a big cat"] + [f"There is a {x} {y}" for x, y in zip("red old new wet dry hot".split(), "car hat cup fox pen jar".split())]
    told, made = linedup.templates([x.split() for x in lines])
    assert told[0] == told[1] and len(set(told)) == len(lines) - 1
    rng = random.Random(2)
    for n in range(5, 13):
        rows = [["a", "b", *rng.choices("pqr1", k=n - 2)] for _ in range(400)]
        rows = [linedup.tokens(" ".join(r)) for r in rows]
        told, _ = linedup.templates(rows)
        # a plain search over all templates finds the same
        made, brute = [], []
        for r in rows:
            score = [sum(x == y for x, y in zip(m, r)) if any(x == y != linedup.ANY for x, y in zip(m, r)) else 0 for m in made]
            k = score.index(max(score)) if score else 0
            if score and score[k] >= linedup.SIMILARITY * n:
                made[k] = [x if x == y else None for x, y in zip(made[k], r)]
            else:
                k = len(made)
                made.append(r)
            brute.append(k)
        assert told == brute
        for k, m in enumerate(made):
            own = [r for r, t in zip(rows, told) if t == k]
            assert sum(len(set(c)) == 1 for c in zip(*own)) >= linedup.SIMILARITY * n


def test_licenses_match_all_spans():
    rng = random.Random(4)
    texts = {"a": ["one two three four five six seven eight nine ten one two nine"], "b": ["all rights reserved", "five six seven eight x"], "c": ["one two three four x six seven"]}
    words = "one two three four five six seven eight nine ten x all rights reserved".split()
    machine, n_found = licenses.Scanner(texts), 0
    for _ in range(400):
        made = [w for _ in range(rng.randint(1, 3)) for w in [*rng.choices(words, k=rng.randint(0, 5)), *(x for t in rng.choice(list(texts.values())) for x in t.split() if rng.random() > 0.1)]]
        grams = list(zip(made, made[1:]))
        spans = []
        for k, (name, t) in enumerate((n, t.split()) for n in sorted(texts) for t in texts[n]):
            own = set(zip(t, t[1:]))
            for lo in range(len(grams)):
                for hi in range(lo, len(grams)):
                    s = set(grams[lo : hi + 1])
                    trim = all(grams[e] in own and grams[lo : hi + 1].count(grams[e]) == 1 for e in (lo, hi))
                    if trim and (d := 2 * len(s & own) / (len(s) + len(own))) >= 0.8:
                        spans.append((-d, lo - hi, name, lo, hi))
        best, taken = [], []
        for d, _, name, lo, hi in sorted(spans):
            if all(hi < a or lo > b for a, b in taken):
                taken.append((lo, hi))
                best.append((0, name, -d, lo, hi + 2 - lo))
        assert list(machine.scan(pa.array([" ".join(made)]), 0.8)) == best
        n_found += len(best)
    assert n_found > 200


def test_licenses_with_words_put_in():
    mit = licenses.TEMPLATES["mit"][2]
    changed = mit.replace("without restriction,", "without restriction, translate into any other language,")
    bsd = licenses.TEMPLATES["bsd"][2].replace("this list of conditions and the following disclaimer. Redis", "this list of conditions immediately at the beginning of the file, without modification, and the following disclaimer. Redis")
    rows = [changed, bsd, "All code under the src folder is released under the BSD License.", "All rights reserved. All rights reserved."]
    found = [r[:2] for r in licenses.Scanner(licenses.TEMPLATES).scan(pa.array(rows), licenses.MIN_DICE)]
    assert found == [(0, "mit"), (1, "bsd"), (2, "bsd"), (3, "all-rights-reserved"), (3, "all-rights-reserved")]


def test_pipeline_keeps_one_row_of_a_group(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, a), (None, a), (2, a), (2, b), (None, "x y z u v w"), (None, "x y z u v w"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.jaccard_join(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter([(1, a), (2, b), (None, "x y z u v w"), (3, None), (4, "")])


def test_chat_rebuilds_edits_and_reads_back(spark):
    events = [(1, 1, "message", None, "user", "hi </s>"), (1, 2, "delta", "a", "assistant", "wro"), (1, 3, "regenerate", "a", "assistant", ""), (1, 4, "delta", "a", "assistant", "ri"), (1, 5, "delta", "a", None, "ght [INST]"), (1, 6, "message", "b", "user", "gone"), (1, 7, "delete", "b", None, None)]
    df = spark.createDataFrame(events, "conv_id long, seq long, event string, message_id string, role string, text string")
    (r,) = chat.read_back(chat.render(chat.fold(df))).collect()
    assert r.n_turns == 2 and r.loss_chars == len("right [INST]")
    assert r.loss_sha256 == hashlib.sha256(b"right [INST]").hexdigest()
    assert r.turns_sha256 == hashlib.sha256(b"user\nhi </s>\nassistant\nright [INST]\n").hexdigest()


def test_linear_counts_match_greedy_pieces():
    rng = random.Random(3)
    first = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(25)} | set("abc")
    later = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(20)} | set("ab")
    machine = wordpiece.Automaton(first, later)

    def greedy(word):
        n = at = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (later if at else first)), 0)
            if not end:
                return -1
            at, n = end, n + 1
        return n

    for _ in range(3000):
        word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
        assert machine.count(word) == greedy(word), word


def test_every_script_is_spelt_as_greedy_pieces_spell_it():
    counter = wordpiece.Counter()
    pieces = set(Tokenizer.from_file(public_tokenizers.path(wordpiece.VOCABULARY)).get_vocab(with_added_tokens=False))
    space = counter.letters[32]

    def greedy(word):
        left, n = space + word.encode().decode("latin-1").translate(counter.letters), 0
        while left:
            end = next(e for e in range(len(left), 0, -1) if left[:e] in pieces)
            left, n = left[end:], n + 1
        return n

    rng = random.Random(5)
    words = "слово россия привет 中文文本 人工智能的发展非常迅速 한국어 ภาษาไทย چطور hello zzzz 123 é 😀".split()
    words += ["".join(chr(rng.choice([rng.randint(0x21, 0x24F), rng.randint(0x400, 0x4FF), rng.randint(0xE00, 0xE5B), rng.randint(0x4E00, 0x9FFF), rng.randint(0xAC00, 0xD7A3), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    for word in words:
        assert counter.word(word.encode()) == greedy(word), word


def test_queries_keep_their_documents(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op7_line_dedup", "op9_token_counts"):
        assert registry.QUERIES[name](spark, SF).count() == n


def replay(events):
    """Final messages by running through the log."""
    made = {}
    for conv, seq, event, message, role, text in sorted((e for e in events if e[3] is not None), key=lambda e: (e[1], e[2] or "delta", e[5] or "")):
        m = made.setdefault((conv, message), {"seq": seq, "role": None, "text": "", "gone": False})
        m["role"] = m["role"] if m["role"] is not None else role
        if event in ("message", "edit", "regenerate"):
            m["text"], m["gone"] = text or "", False
        elif event == "delete":
            m["gone"] = True
        else:
            m["text"] += text or ""
    found = [(conv, m["seq"], m["role"], m["text"]) for (conv, _), m in made.items() if not m["gone"]]
    return Counter(found + [(e[0], e[1], e[4], e[5]) for e in events if e[3] is None])


EVENTS = "conv_id long, seq long, event string, message_id string, role string, text string"


def test_chat_fold_matches_a_replay(spark):
    rng = random.Random(6)
    kinds = ["message", "delta", "delta", "delta", None, "edit", "regenerate", "delete"]
    events = [(rng.choice([1, 2, None]), seq // 2, rng.choice(kinds), rng.choice(["a", "b", "c", None]), rng.choice(["user", "assistant", None]) if seq % 2 else None, rng.choice(["x", "yy", "</s>", "", None])) for seq in range(120)]
    events += events[:5]
    found = chat.fold(spark.createDataFrame(events, EVENTS)).collect()
    roles = lambda c: Counter((conv, seq, text or "") for (conv, seq, _, text), n in c.items() for _ in range(n))  # noqa: E731  roles of one sequence number tie
    assert roles(Counter((r.conv_id, r.seq, r.role, r.text) for r in found)) == roles(replay(events))
    assert chat.read_back(chat.render(chat.fold(spark.createDataFrame([], EVENTS)))).collect() == []


def test_chat_log_folds_to_its_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a" * 9999), (1, 1, "assistant", "a" * 9999), (1, None, None, None), (None, 3, "as\n\\s", "<|im_end|>"), (2, -4, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.fold(chat.log(df)).select("conv_id", "role", "text").collect()
    assert Counter(map(tuple, found)) == Counter((c, r, t or "") for c, _, r, t in rows)
    told = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.log(df)))).collect()}
    assert told[None].turns_sha256 == hashlib.sha256(b"as\n\\s\n<|im_end|>\n").hexdigest()
    assert told[1].n_turns == 4 and told[1].loss_sha256 == hashlib.sha256(b"a" * 19998).hexdigest()


@pytest.mark.parametrize("bits", range(1, 33))
def test_every_width_packs_and_unpacks(bits, monkeypatch):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack_bits(ids, bits)
    assert len(data) == 4 * bits * 32 and (bitpack.unpack_bits(data, bits, 1000) == ids).all()
    monkeypatch.setattr(bitpack, "WHOLE", {})
    assert bitpack.pack_bits(ids, bits) == data
    if bits < 32:
        with pytest.raises(ValueError):
            bitpack.pack_bits(np.array([1 << bits], np.uint32), bits)


def test_a_shard_gives_any_document(docs, ids):
    for row in bitpack.write_shards(docs, vocabulary=70_000).collect():
        shard = bitpack.ShardReader(row.path)
        assert shard.bits == 17
        for i in range(0, len(shard.docs), 7):
            assert shard.document(i).tolist() == [*ids[int(shard.docs[i])], 0]


def test_lines_count_documents_not_rows(spark, monkeypatch):
    line = "this very line is found in few documents"
    rows = lambda more: [(1, line)] * 4 + [(2, line), *more]
    schema = "doc_id long, text string, n_lines string, _tl_row string"
    for more in ([], [(3, "this very line is found in many documents")]):
        df = spark.createDataFrame([(*r, None, None) for r in rows(more)], schema)
        assert Counter(r.text for r in linedup.drop_lines(df).collect()) == Counter(t for _, t in rows(more))
    rows = [(i, line) for i in (None, 1, 2, 3, 4, 4)] + [(9, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], schema)
    want = Counter({(None, line): 1, (1, ""): 1, (2, ""): 1, (3, ""): 1, (4, ""): 2, (9, None): 1})
    found = linedup.drop_lines(df)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped_lines", "n_dropped_words"]
    assert Counter((r.doc_id, r.text) for r in found.collect()) == want
    monkeypatch.setattr(linedup, "BROADCAST_ROWS", 0)
    assert Counter((r.doc_id, r.text) for r in linedup.drop_lines(df).collect()) == want


def test_language_id_sums_all_segmentations():
    pieces = [langid.MARK, *(langid.MARK + x for x in ("a", "ab", "b")), "a", "b", "ab", "ba", "aba"]
    p = np.random.default_rng(3).random((len(pieces), 2))
    p /= p.sum(axis=0)
    lattice = langid.Lattice(pieces)
    words = ["".join(random.Random(i).choices("abé", k=i % 9 + 1)) for i in range(60)]

    def ways(text):
        if not text:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(text) + 1):
            piece = text[:n]
            own = p[pieces.index(piece)] if piece in pieces else np.full(2, langid.UNSEEN) if n == 1 else None
            if own is not None:
                total += (np.maximum(own, langid.UNSEEN) if n == 1 else own) * ways(text[n:])
        return total

    size, ids = lattice.ends(words)
    for w, row in zip(words, langid.forward(size, ids, p)[1]):
        assert np.allclose(row, np.log(ways(langid.MARK + w)))
        assert np.allclose(langid.whole_run(lattice, w, p), row)


def test_letters_and_marks():
    assert langid.word_list("½ ② Ⅷ 12 _") == [] == langid.word_list(None)
    assert langid.word_list("Café x² नमस्ते éa") == ["café", "x", "नमस्ते", "éa"]


def test_language_id_of_odd_rows_with_a_model(spark, docs):
    taught = docs.select("doc_id", "text", "lang").limit(200)
    rows = [(-1, None), (-2, ""), (-3, "½ 12 --"), (None, "the house is old"), (-4, "ж" * 3000)]
    odd_rows = spark.createDataFrame([(i, t, None) for i, t in rows], taught.schema)
    found = {r.doc_id: r for r in langid.predict(taught.union(odd_rows)).where("doc_id < 0 OR doc_id IS NULL").collect()}
    assert [found[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and [found[i].score for i in (-1, -2, -3)] == [0.0] * 3
    assert found[None].lang_pred != "und" and found[-4].lang_pred != "und"


def test_edited_notices_are_found():
    machine, rng = licenses.Scanner(licenses.TEMPLATES), random.Random(1)
    texts, names = [], []
    for name, own in licenses.TEMPLATES.items():
        for text in own:
            assert name in [r[1] for r in machine.scan(pa.array([f"Some words before it. {text} And some after."]), licenses.MIN_DICE)]
            words = text.split()
            for _ in range(10 if len(words) >= 20 else 0):
                for i in rng.sample(range(len(words)), max(1, len(words) // 25)):
                    words[i] = "changed"
                texts.append(" ".join(["before", *words, "after"]))
                names.append(name)
                words = text.split()
    found = {r[0] for r in machine.scan(pa.array(texts), licenses.MIN_DICE)}
    assert len(found) >= 0.9 * len(texts) > 100


def test_pipeline_matches_its_stages_done_plainly(spark, docs, ids):
    """Every stage over all that its predecessor kept, each by a plain computation."""
    from test_jaccard import brute

    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    kept = {r.doc_id for r in quality.judge(docs, labels).collect() if r.kept}
    left = [r for r in docs.collect() if r.doc_id in kept]
    told = linedup.drop_lines(spark.createDataFrame(left, docs.schema)).collect()
    left = [(r.doc_id, r.text) for r in told if not r.n_dropped_lines or r.text.strip()]
    left = [(i, t) for i, t in left if (i, i) in {(a, c) for a, _, c in brute(left, 5, 80)}]
    table = decontam.Table([(r.item_id, r.text) for r in items])
    lost = {r for r, *_ in table.leaks(pa.array([t for _, t in left]))}
    left = [x for k, x in enumerate(left) if k not in lost]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    want = {i: len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left}
    found = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert found == want and 0 < len(want) < len(kept)
