"""The stages one after another, on documents whose fate is known."""

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(5))
    prose = [[word() for _ in range(80)] for _ in range(40)]
    item = [word() for _ in range(30)]
    passage = [word() for _ in range(60)]
    docs = [(k, " ".join(p)) for k, p in enumerate(prose)]
    docs += [(100, docs[3][1]), (101, " ".join(prose[4][:79] + ["zzzzz"])), (102, " ".join(prose[5][:0] + [word() for _ in range(50)] + item)), (103, "12 34 %%"), (104, None)]
    docs += [(110, " ".join([word() for _ in range(70)] + passage)), (111, " ".join(passage + [word() for _ in range(70)]))]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    everything = {*range(40), 100, 101, 102, 103, 104, 110, 111}
    assert everything - kept[0] == {103, 104}
    assert kept[0] - kept[1] == {100, 101}
    assert kept[2] == kept[1] and kept[2] - kept[3] == {102} and kept[4] == kept[3]
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/out-repeated_passages").collect()}
    assert len(texts[110]["text"].split()) == 130 and len(texts[111]["text"].split()) == 70 and texts[111]["n_chars"] == len(texts[111]["text"])


def test_run_equals_the_stages(spark, folder):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == {r["doc_id"] for r in spark.read.parquet(f"{folder}/out-token_ids").collect()}
