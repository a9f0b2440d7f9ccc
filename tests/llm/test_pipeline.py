"""The pipeline's stages against brute force on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F

from test_corpus_operators import brute_classes, brute_hits, brute_repeats

WORDS = {
    "en": "the of and to in that is was for with as on be at by this from have are not".split(),
    "de": "der die und das nicht ist mit ein zu auf den von sich des dem im auch als wie".split(),
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(11)
    make = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 400)) * (rng.random() < 0.7) for _ in range(n))
    items = [(i, make("en", 30)) for i in range(4)]
    passage, rows = make("en", 60), []
    for i in range(40):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, make(lang, 150), lang))
    rows[5] = (5, f"{rows[5][1]} {passage}", "en")
    rows[8] = (8, f"{passage} {rows[8][1]}", "en")
    rows[11] = (11, f"{rows[11][1]} {items[2][1]} end", "en")
    rows += [(100 + i, rows[2][1].replace(" ", "\n", i), "en") for i in range(3)]  # the same words
    rows += [(200, None, None), (201, "", "en"), (202, "12 34 !", "en"), (203, passage, "en"), (7, rows[7][1], "en")]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages(spark, corpus):
    folder, rows, items = corpus
    want = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    lows, kept = set(), []
    for (i, t), (_, _, low) in zip(want, brute_classes(want), strict=True):
        if low == i and i not in lows:
            lows.add(i)
            kept.append((i, t))
    assert len(kept) < len(want)
    cut = [(i, t if not gone else left) for (i, t), (_, n, gone, left, _) in zip(kept, brute_repeats(kept, 35), strict=True) if gone == 0 or gone < n]
    assert {5, 8} <= {i for (i, t), (_, s) in zip(kept, cut) if t != s} or any(dict(kept)[i] != s for i, s in cut)
    clean = [(i, t) for (i, t), r in zip(cut, brute_hits(cut, items, 10), strict=True) if not r[2]]
    assert 11 not in {i for i, _ in clean}
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.common.stage(stage(spark, docs, folder), f"test-{name}")
        if name != "encoded":
            assert docs.columns == columns
            found[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    assert found["language"] == sorted(want)
    assert found["near_duplicates"] == sorted(kept)
    assert found["repeated_passages"] == sorted(cut)
    assert found["decontaminated"] == sorted(clean)
    assert sorted((r.doc_id, r.ids) for r in docs.collect()) == sorted((i, sp.encode(t)) for i, t in clean)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_an_empty_table_goes_through(spark, corpus, tmp_path):
    folder, _, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
