"""Words that linear hashes mix up, and odd rows in the operators and the pipeline's stages."""


import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import bpe, chat_format, decontaminate, near_dedup, quality, substring_dedup, token_files, toxicity
from corpusmill.llm import queries as Q
from corpusmill.llm import textkernel as tk

from . import brute
from .test_operators import DOCS, frame, words


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


ONE, OTHER = thue_morse(1024)


def test_hashes_of_words_that_linear_hashes_mix_up():
    data = np.frombuffer((ONE + OTHER).encode(), np.uint8)
    for seed in (0, 1):
        a, b = tk.hash_runs(data, np.array([0, 1024]), np.array([1024, 2048]), seed)
        assert a != b
    texts = [w.encode() for w in {words(random.Random(1), 1)[: k % 7] + "x" * k for k in range(200)}]
    data, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])
    assert len(set(tk.hash_runs(data, end - [len(x) for x in texts], end).tolist())) == len(texts)


def test_such_words_in_every_operator(spark):
    rows = [(1, ONE), (2, OTHER)]
    assert [r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).orderBy("doc_id").collect()] == [1, 2]
    bench = spark.createDataFrame([(1, ONE)], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(frame(spark, rows), bench).orderBy("doc_id").collect()] == [1, 0]
    tail = " ".join(f"t{k}" for k in range(12))
    got = substring_dedup.remove_repeats(frame(spark, [(1, f"{ONE} {tail}"), (2, f"{OTHER} {tail}")])).collect()
    assert [r.n_removed for r in got] == [0, 0]
    path = Q.tokenizer_path("byte_bpe_50k.json")
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark, rows), path), path).collect()} == dict(rows)
    path = Q.tokenizer_path("word_bpe_49k.json")
    library = bpe.splitter(path).library
    want = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in token_files.write_and_read(frame(spark, rows), path).collect()} == want


def test_maximal_repeats(spark):
    rng = random.Random(3)
    passage, other = words(rng, 40), words(rng, 20)
    rows = [(5, f"{words(rng, 10)} {passage} {words(rng, 10)}"), (7, f"{words(rng, 3)} {passage} {words(rng, 4)} {other}"), (6, f"{other} {words(rng, 9)}"), (7, f"{words(rng, 3)} {passage}")]
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    found = sorted((r.doc_id, tuple(x)) for r in got for x in r.repeats)
    assert found == [(7, (3, 40, 5, 10)), (7, (3, 40, 5, 10)), (7, (47, 20, 6, 0))]


def test_quality_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 30, 90) + (" ## !!" * 9 if i % 5 == 0 else "")) for i in range(120)] + [(500, None), (7, words(rng, 9, 90))]
    labels = [(i, int(i % 5 != 0)) for i in range(0, 120, 3)]
    df = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")

    def slots(text):
        import pyarrow as pa

        c = next(tk.chunks(pa.array([text or ""]), tk.TOKENS, True), (0, 0, None))[2]
        h = c.hash
        return [int(x) % quality.SLOTS for x in h] + [int(x) % quality.SLOTS for x in tk.join(h[:-1], h[1:])]

    good = {i for i, q in labels if q}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(slots(t))
        if i in good:
            target.update(slots(t))
    n, m = sum(raw.values()) + quality.SLOTS, sum(target.values()) + quality.SLOTS
    noise = {r.doc_id: r.g for r in frame(spark, rows).select("doc_id", quality.gumbel(F.col("doc_id")).alias("g")).collect()}
    weight = [sum(math.log((target[x] + 1) / m) - math.log((raw[x] + 1) / n) for x in slots(t)) for _, t in rows]
    key = [w + noise[i] for w, (i, _) in zip(weight, rows, strict=True)]
    known = dict(labels)
    of = [known[i] for i, _ in rows if i in known]
    k = round(sum(of) / len(of) * len(rows))
    want = {j for _, j in sorted(((-x, j) for j, x in enumerate(key)))[:k]}
    got = sorted((r.doc_id, round(r.log_weight, 6), r.kept) for r in quality.select(frame(spark, rows), df).collect())
    assert got == sorted((i, round(w, 6), j in want) for j, ((i, _), w) in enumerate(zip(rows, weight, strict=True)))
    # contradictory labels are bad ones; only bad labels keep all
    both = df.union(spark.createDataFrame([(0, 1, 0)], df.schema))
    assert quality.known_labels(both).filter("doc_id = 0").first().good == 0
    assert quality.select(frame(spark, rows), df.filter("quality = 0")).filter("not kept").count() == 0


def test_toxicity_on_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 12, 60) + (" grumpfing" if i % 3 == 0 else "")) for i in range(90)]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (4, 1), (4, 0)]  # contradictory labels
    df = spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")
    rows += [(3, "another text"), (3, rows[3][1]), (200, rows[0][1]), (201, "grumpfing " * 30_000)]  # repeats, a tie, a long text
    got = toxicity.score(frame(spark, rows), df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[200].score == by[0].score and by[201].predicted == 1
    again = toxicity.score(frame(spark, rows[::-1], 2), df).collect()
    assert sorted((r.doc_id, r.score) for r in again) == sorted((r.doc_id, r.score) for r in got)


def test_token_files_with_hot_and_null_ids(spark):
    path = Q.tokenizer_path("word_bpe_49k.json")
    rng = random.Random(7)
    rows = [(None, words(rng, 5)) for _ in range(40)] + [(9, words(rng, 5)) for _ in range(60)] + [(9, "same")] * 20 + [(1, None), (10, "")]
    got = token_files.write_and_read(frame(spark, rows), path).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    total = 0
    for r in order:
        assert r.start == total
        total += r.n_tokens


def test_chat_turns(spark):
    rows = [(1, None, "user", "a"), (1, 0, "user", "b"), (2, None, "user", "a"), (3, 0, "user", "x"), (3, 0, "assistant", "y"), (4, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.text for r in chat_format.render(df).collect()}
    piece = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    # rows of one turn enter the state together, so 4 is no prefix of 3
    assert got == {1: piece("user", "a") + piece("user", "b"), 3: piece("assistant", "y") + piece("user", "x"), 4: piece("assistant", "y")}


def stages(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never in any text"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, f in corpus_pipeline.STAGES:
        yield name, docs, f(spark, docs, str(tmp_path))


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    text = words(rng, 50)
    rows = [(1, text), (3, text), (3, words(rng, 30)), (1, text), (None, text), (None, None), (4, ""), (4, None), (5, words(rng, 20_000)), (6, "one")]
    full = [(i, t, None, "s", None, k, "x", 0.5) for k, (i, t) in enumerate(rows)]
    for name, docs, out in stages(spark, tmp_path, full):
        got = out.collect()
        if name == "near-duplicate removal":
            # of doc 3 the copy goes and the unrelated text stays; of the repeated row one stays
            assert sorted(r.part for r in got if r.doc_id == 3) == [2]
            assert len([r for r in got if r.doc_id == 1]) == 1 and len(got) == 8
        else:
            assert len(got) == len(rows), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        if name == "substring deduplication":
            assert {r.part: r.text for r in got if r.part in (0, 4, 5, 6)} == {0: text, 4: text, 5: None, 6: ""}
            assert [r.text for r in got if r.part == 1] == [""]


def test_stages_on_empty_tables(spark, tmp_path):
    for name, _, out in stages(spark, tmp_path, []):
        assert out.count() == 0, name


def test_near_duplicates_hold_whole_sets():
    import pyarrow as pa

    c = next(tk.chunks(pa.array(["a b c a b c", "c a b", "a b", "a", "", "A B C"]), tk.SPACED, True))[2]
    row, _ = near_dedup.exact_sets(c)
    assert np.bincount(row, minlength=6).tolist() == [3, 1, 1, 1, 0, 1]
    sets = near_dedup.shingles(c)[0]
    assert np.bincount(sets, minlength=6).tolist() == [3, 1, 1, 1, 0, 1]



def test_toxicity_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randrange(5, 40), 400) + (f" {rng.choice(['grumpf', 'zorb'])}{rng.choice(['ing', 'ed', 's'])}" * rng.randrange(1, 3) if i % 5 == 0 else "")) for i in range(250)]
    rows += [(900, None), (901, "GRUMPFING w1"), (902, "zorbs " * 5)]
    labels = {i: int(i % 5 == 0) for i in range(0, 250) if zlib.crc32(str(i).encode()) % 4 != 2}
    df = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    hash_of = lambda x: int(tk.hash_runs(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
    want = brute.toxicity(rows, labels, hash_of, toxicity.monotone)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), df).collect()}
    assert np.allclose([got[i] for i, _ in rows], want, atol=1e-6)
