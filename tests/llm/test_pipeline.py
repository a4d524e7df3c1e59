from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, given = docs.columns, docs
    long = " ".join(f"word{i}" for i in range(30))
    odd = [
        (900_000, None, None, None), (900_001, "", "en", "s"), (900_002, "12 34 %%", "en", "s"), (900_003, "the " * 20_000, None, "s"),
        (900_004, long + " tail one", "en", "s"), (900_005, " ".join(f"head{i}" for i in range(40)) + " " + long, "en", "s"), (None, "the house of the man", "en", "s"),
    ]
    extra = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(extra.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, sf))
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    language, near, passages, benchmark = seen
    assert not {900_000, 900_001, 900_002} & set(language) and {900_003, 900_004, 900_005, None} <= set(language)
    texts = {r.doc_id: r.text for r in given.collect()}
    assert len(language) >= 0.97 * len(texts)
    assert len(set(near.values())) == len(near) and set(near) < set(language)
    assert passages[900_004].startswith(long) and "word3" not in passages[900_005]
    assert all(passages[i] == near[i] for i in passages if len((passages[i] or "").split()) == len((near[i] or "").split()))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(t in x for x in benchmark.values() for t in items)
    assert len(passages) - len(benchmark) <= sum(any(t in x for t in items) for x in passages.values()) + 3
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.encoded(spark, docs, sf).collect():
        assert r.ids == library.encode(benchmark[r.doc_id] or "")


def test_registered():
    from __spark_entry__ import queries

    names = queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()}
