"""The pipeline against the operators' brute-force versions."""

import random

import corpus_pipeline
from corpusmill.llm import bpe
from corpusmill.llm.queries import tokenizer_path

from . import brute
from .test_operators import words


def test_run(spark, tmp_path):
    rng = random.Random(11)
    good = [words(rng, 70, 3000) for _ in range(60)]
    passage, item = words(rng, 40, 3000), words(rng, 25, 3000)
    rows = list(enumerate(good))
    rows += [(100 + i, good[i]) for i in range(5)]
    rows += [(110 + i, f"{words(rng, 60, 3000)} {passage}") for i in range(4)]
    rows += [(120, f"{words(rng, 60, 3000)} {item}")]
    rows += [(200 + i, " ".join(w + "$$$" for w in words(rng, 60, 3000).split())) for i in range(20)]
    bad = {i for i, _ in rows if i >= 200}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in rows if i not in bad]
    kept = brute.near(left)
    left = [(i, t) for i, t in left if kept[i][2]]
    left = [(i, b" ".join(w).decode()) for i, _, w in brute.without_repeats(left)]
    leaks = {d for d, *_, hit, _ in brute.contaminated(left, [(1, item)]) if hit}
    library = bpe.splitter(tokenizer_path("byte_bpe_50k.json")).library
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in left if i not in leaks}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert 120 not in got
    assert not {*range(100, 105)} & set(got)
    first = corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
