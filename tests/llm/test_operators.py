"""The ten operators against brute force, and on odd input."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, chat_format, decontaminate, knn, near_dedup, quality, token_files, toxicity, url_filter
from corpusmill.llm import queries as Q
from corpusmill.llm.components import components
from corpusmill.llm.substring_dedup import remove_repeats, without_repeats

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, bucket string, score double"


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and long texts, copies, near copies, shared passages; ids aren't in order."""
    rng = random.Random(5)
    long, passage = words(rng, 6000), words(rng, 60)
    out = [None, "", " \n\t", "One", "one", "Two words", "aéß 中文 \U0001f600 <|endoftext|> it's  we'll\n\n x", long, long + " tail", long]
    base = [words(rng, 80) for _ in range(8)]
    out += base + base[:4]
    for b in base[:3]:
        w = b.split()
        w[40] = "changed"
        out.append(" ".join(w))
        w[41] = "Again"
        out.append(" ".join(w).upper())
    out += [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(6)] + ["same words here"] * 30
    rows = [((i * 37) % 101, t) for i, t in enumerate(out)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", 0.5) for i, t in rows], DOCS).repartition(parts)


def test_near_duplicates(spark, texts):
    want = brute.near(texts)
    for more in ({}, {"tile": 2, "local_edges": 0}):
        got = near_dedup.near_duplicates(frame(spark, texts), **more).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (1, "A b c d"), (2, None)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, None, True), (1, 1, True), (2, 2, True), (3, 1, False), (3, 1, False)]
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_pruning_keeps_similar_pairs():
    assert near_dedup.fewest_matches(125) < 125 * 0.85
    assert near_dedup.fewest_matches(25) >= 5


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, k) for k in range(400, 430)]
    df = spark.createDataFrame(edges, "a long, b long")
    small, large = ({r.id: r.component for r in components(df, n).collect()} for n in (10**6, 0))
    assert small == large
    assert all(small[a] == small[b] for a, b in edges if a != b)


def test_decontamination(spark, texts):
    rng = random.Random(9)
    shared = next(t for _, t in texts if t and t.startswith("w") and len(t.split()) == 100)
    bench = [(1, " ".join(shared.split()[25:50])), (10, "same words here"), (2, "ONE"), (None, "two words"), (7, None), (8, ""), (1, words(rng, 30)), (9, words(rng, 12))]
    df = spark.createDataFrame(bench, "item_id long, text string")
    for block in (1_000_000, 20):
        got = decontaminate.digests(decontaminate.contamination(frame(spark, texts), df, block=block)).collect()
        assert sorted(map(tuple, got)) == sorted(brute.contaminated(texts, bench))
    keep = {d for d, *_, bad, _ in brute.contaminated(texts, bench) if not bad}
    left = decontaminate.decontaminate(frame(spark, texts), df)
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.doc_id for r in left.collect()} == keep
    longest = decontaminate.longest_matches(frame(spark, texts), df).filter("item_id = '1'").agg(F.max("n_words")).first()[0]
    assert longest >= 25
    assert decontaminate.contamination(frame(spark, []), df).count() == 0
    assert decontaminate.contamination(frame(spark, texts), df.limit(0)).filter("contaminated").count() == 0


def test_bpe(spark, texts, monkeypatch):
    path = Q.tokenizer_path("byte_bpe_50k.json")
    library = bpe.splitter(path).library
    rows = [*texts, (500, "Ᲊ \U00010d50 " + "x" * 50), (None, "null id")]
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for most in (500_000, 50):
        monkeypatch.setattr(bpe, "CHUNK_WORDS", most)
        monkeypatch.setattr(bpe, "LONG_TEXT", most)
        got = bpe.digests(bpe.encode(frame(spark, rows), path), path).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(frame(spark, rows), path), path).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((d or -1, t or "") for d, t in rows)
    assert bpe.encode(frame(spark, []), path).count() == 0


def test_bpe_gathers_in_slices():
    """The ids of a chunk come back without arrays of 64 bits over all its words."""
    rng = np.random.default_rng(5)
    off = np.concatenate([[0], np.cumsum(rng.integers(0, 4, 5000))])
    flat, index = rng.integers(0, 50_000, off[-1]).astype(np.uint16), rng.integers(0, 5000, 1_500_000).astype(np.uint32)
    rows = np.concatenate([[0, 0], np.sort(rng.integers(0, len(index), 999)), [len(index), len(index)]])
    tracemalloc.start()
    ids, bounds = bpe.gather(flat, off, index, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat)).take(pa.array(index))
    assert ids.tolist() == lists.flatten().to_pylist() and ids.dtype == flat.dtype
    assert bounds.tolist() == np.concatenate([[0], np.cumsum(np.diff(off)[index])])[rows].tolist()
    assert most < 32 << 20
    assert [len(x) for x in bpe.gather(flat, off, index[:0], np.zeros(3, np.int64))] == [0, 3]


def test_url_filter(spark):
    rules = url_filter.rule_table(spark, [*Q.URL_RULES, ("a.org/x", "block"), ("b.a.org/", "allow")])
    urls = [(1, "http://Example.ORG/es/1?x"), (2, "https://m.example.org/en/12#t"), (3, "ftp://x.com/fr/"), (4, "x.com/de/"), (5, None), (6, "http://notexample.org"), (7, "http://a.com/de/?q"), (8, "http://b.a.org/x"), (None, "http://c.net/"), (9, ""), (9, "")]
    pages = spark.createDataFrame([(i, u, "c", "d") for i, u in urls], "page_id long, url string, rule string, host string")
    for size in (4_000_000, 2):
        files, lengths = url_filter.build(rules, size)
        host, path = url_filter.parts("url")
        got = url_filter.judge(pages.select(F.col("page_id").alias("id"), host.alias("host"), path.alias("path")), files, lengths).collect()
        by = {r.id: (r.host, r.path, r.rule, r.verdict) for r in got}
        assert by[1] == ("example.org", "/es/1", "example.org/es/", "block")
        assert by[2][2:] == ("example.org/en/1", "block")
        assert by[3][2:] == ("com/fr/", "allow")
        assert by[4] == by[5] == ("", "", None, "allow")
        assert by[6] == ("notexample.org", "", None, "allow")
        assert by[7] == ("a.com", "/de/", "com/de/", "block")
        assert by[8][2:] == ("b.a.org/", "allow")
        assert len(got) == 11
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).filter("verdict <> 'allow'").count() == 0


def test_knn(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 420)]
    rows += [(1000, None), (1050, []), (1100, [float("nan")] * 6), (1150, [1.0, None] * 3), (None, [1.0] * 6), (1200, [1.0, 2.0])]
    rows += [(7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for more in ({}, {"group": 2, "block": 40}):
        got = {tuple(r) for r in knn.top_k(df, "vec_id % 50 = 0", **more).collect()}
        assert got == brute.knn(plain, 50)
    assert knn.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_knn_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 1.0]), (1, [9e6, 1.0]), (2, [1.0, 2.0]), (3, [-9e6, 3.0]), (4, [3e9, -7e9]), (5, [3e9, -7e9 + 4096]), (50, [1e9, 1e9])]
    rows += [(100 + i, [float(x) for x in np.float32(rng.normal(size=2) * 1e7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {(q, n, i, min(max(s, -(2**63)), 2**63 - 1)) for q, n, i, s in brute.knn(rows, 50)}
    assert {tuple(r) for r in knn.top_k(df, "vec_id % 50 = 0").collect()} == want
    huge = spark.createDataFrame([(0, [3e38, 0.0]), (1, [2e38, 0.0]), (2, [3e38, 1.0]), (3, [-3e38, 0.0]), (4, [1.0, 0.0]), (5, [-2e38, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in knn.top_k(huge, "vec_id = 0").orderBy("rank").collect()]
    assert got == [(2, 2**63 - 1), (1, 2**63 - 1), (4, 2**63 - 1), (5, -(2**63)), (3, -(2**63))]


def test_knn_needs_few_cells_of_clustered_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 100
    x = np.floor(np.concatenate([c + rng.normal(size=(50, 16)) for c in centres]))
    pivots = x[::25]
    cell, far = knn._nearest(x, pivots)
    p, norm = pivots[cell], np.sqrt((x**2).sum(1))
    angle = np.arccos(np.clip((x * p).sum(1) / norm / np.sqrt((p**2).sum(1)), -1, 1))
    used = np.unique(cell)
    pick = lambda f, v: [float(f(v[cell == c])) for c in used]
    summary = pa.table({"cell": pa.array(used.astype(np.int32)), "n": [int((cell == c).sum()) for c in used], "u": pick(np.max, far), "angle": pick(np.max, angle), "low": pick(np.min, norm), "high": pick(np.max, norm)})
    cells = knn.Cells(summary, pivots, np.arange(0, len(x), 25))
    need = cells.needed(x, np.arange(len(x)), 5)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    for q, top in enumerate(np.argsort(-scores, axis=1, kind="stable")[:, :5]):
        assert need[q][np.searchsorted(used, cell[top])].all()
    assert (need @ cells.size).mean() < 0.1 * len(x)


def test_token_files(spark, texts, tmp_path):
    path = Q.tokenizer_path("word_bpe_49k.json")
    library = bpe.splitter(path).library
    manifest = token_files.write_dataset(frame(spark, texts), path, f"file://{tmp_path}", 1, 64)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(manifest, digest=True).collect()}
    start, want, stream = 0, {}, []
    for d, t in sorted(texts, key=lambda x: x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    assert got == want
    first = min(manifest.collect(), key=lambda r: r.part)
    ids, mask = token_files.sequence(token_files.open_shard(first.path), 0)
    assert ids[mask].tolist() == stream[: int(mask.sum())]
    assert len(ids) == 64
    assert token_files.write_and_read(frame(spark, []), path).count() == 0


def test_chat_format(spark):
    turns = ["hello", "hi", "how?", "so"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", turns[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 3)) for t in range(n)]
    rows += [(5, 0, "user", "other"), (5, 0, "user", "other"), (6, 0, None, None), (None, 0, "user", "x"), (7, t := 0, "user", "hello")]
    rows += [(8, k, "user", f"t{k}") for k in range(3000)] + [(9, k, "user", f"t{k}") for k in range(2500)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n string")
    got = {r.conv_id: r for r in chat_format.render(df).collect()}
    assert set(got) == {2, 5, 6, 8}
    assert got[2].text == "".join(f"<|{'user' if t % 2 == 0 else 'assistant'}|>\n{turns[t]}<|end|>\n" for t in range(4))
    assert got[5].n_turns == 1
    assert got[8].n_turns == 3000
    assert chat_format.render(df.limit(0)).count() == 0
    assert t == 0


def test_substring_dedup(spark, texts):
    rows = [*texts, (None, next(t for _, t in texts if t and len(t) > 300))]
    want = sorted((d if d is not None else -1, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for d, n, kept in brute.without_repeats(rows))
    for heavy in (1_000_000, 3):
        got = remove_repeats(frame(spark, rows), digest=True, heavy=heavy).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in got) == want
    assert remove_repeats(frame(spark, []), digest=True).count() == 0
    out = without_repeats(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert out.count() == len(rows)
    spans = remove_repeats(frame(spark, rows)).filter("n_removed > 0 and doc_id is not null").first()
    assert sum(int(b) - int(a) + 1 for a, b in (s.split("-") for s in spans.spans.split(","))) == spans.n_removed


def test_quality(spark):
    rng = random.Random(2)
    good = [(i, words(rng, 60, 300)) for i in range(200)]
    bad = [(i, " ".join(w + "###" for w in words(rng, 60, 300).split())) for i in range(200, 260)]
    rows = [*good, *bad, (900, None), (901, ""), (None, words(rng, 30, 300)), (5, good[5][1])]
    # labels of every other row only; the rest is held out
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 260, 2)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.select(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    assert all(r.kept for r in got if r.doc_id is None or r.doc_id < 200 or r.doc_id >= 900)
    assert not any(r.kept for r in got if r.doc_id is not None and 200 <= r.doc_id < 260)
    assert quality.select(frame(spark, []), labels).count() == 0
    assert quality.select(frame(spark, rows), labels.limit(0)).filter("not kept").count() == 0
    assert quality.select(frame(spark, good), labels, share=0.25).filter("kept").count() == 50


def test_kth_largest(spark):
    rng = random.Random(4)
    x = [rng.choice([rng.gauss(0, 1), 0.0, 5.0]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for k in (1, 3, 700, 1999, 2000):
        assert quality.kth_largest(df, "x", k, bins=8, few=5) == sorted(x, reverse=True)[k - 1]


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        w = words(rng, 40, 500).split()
        if i % 6 == 0:
            w[rng.randrange(40)] = "grumpf" + rng.choice(["ing", "ed", "s"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000, None), (1001, ""), (None, "grumpfing")]
    df = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark, rows), df).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    # labels of held-out rows change nothing
    turned = df.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id or -1, r.score) for r in toxicity.score(frame(spark, rows), turned).collect()) == sorted((r.doc_id or -1, r.score) for r in got)
    assert toxicity.score(frame(spark, []), df).count() == 0
    assert toxicity.score(frame(spark, rows), df.limit(0)).filter("score > 0").count() == 0


def test_nearest_is_exact():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False)).astype(np.uint16)
        rows.append((i, int(t[0] < 5), t.tobytes(), rng.integers(1, 4, len(t)).astype(np.uint32).tobytes()))
    index = toxicity.Index(rows, np.linspace(1, 3, 40), {0: 1.0, 1: 1.0}, k=7, block=16)
    keys = sorted({(r[2], r[3]) for r in rows})
    dense = np.zeros((len(keys), 40))
    for n, key in enumerate(keys):
        t, w = index.vector(*key)
        dense[n, t] = w
    for n, key in enumerate(keys[:100]):
        _, sim = index.nearest(*index.vector(*key))
        best = np.sort(dense @ dense[n])[::-1][:7]
        assert np.allclose(sim, best[: len(sim)], atol=1e-5)


def test_toxicity_keeps_up_to_6000_examples_a_class(spark):
    labels = spark.range(10_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    sample, weight = toxicity.examples(labels)
    learnable = labels.filter(~toxicity.held_out(F.col("doc_id")))
    assert sample.filter("toxic = 1").count() == learnable.filter("toxic = 1").count() > 1500
    assert sample.filter("toxic = 0").count() == learnable.filter("toxic = 0").count() > 1500
    assert weight == {0: 1.0, 1: 1.0}


def test_toxicity_vocabulary_has_terms_of_rare_languages(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, 30, 200) + (" grumpfing" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(1000 + i, f"único{i} zorbent") for i in range(3)]  # toxic, and fewer than five
    sample = spark.createDataFrame([(i, int(i >= 1000 or i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.vectors(docs, toxicity.vocabulary(docs, sample)).filter("length(terms) = 0").join(sample.filter("toxic = 1"), "doc_id")
    assert found.count() == 0
