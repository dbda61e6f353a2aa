import os

import pytest

from graphspark.session import shared_dir

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    """Each stage against a plain version over the rows that it was given."""
    from graphspark.llm import langid, mixing, pii
    from tests.llm.test_text_operators import jaccard_groups

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "src0", 0), (900_002, "123 456", "en", "src0", 7), (900_003, "the mail is jo@example.com and this is the rest", "en", "src0", 50), (900_003, "the mail is jo@example.com and this is the rest", "en", "src0", 50)], docs.schema)
    docs = docs.union(extra)
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = seen[name] = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        ids, was = [r["doc_id"] for r in docs.select("doc_id").collect()], [r["doc_id"] for r in before.select("doc_id").collect()]
        if name == "language":
            assert sorted(was)[:-4] == sorted(ids)[:-2] and 900_001 not in ids and 900_002 not in ids
        elif name == "near_duplicates":
            # five words and 0.8, against all pairs; the signature may be off near the threshold
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            sure, possible = jaccard_groups(texts, 0.88), jaccard_groups(texts, 0.66)
            assert len(ids) == len(set(ids)) and set(ids) <= {k for k, g in sure.items() if k == g} and set(ids) >= {k for k, g in possible.items() if k == g}
        elif name == "personal_data":
            assert ids.__len__() == len(was)
            assert all(pii.find(r["text"])[0] == [] and r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif name == "mixing":
            plan = mixing.mix(before).collect()
            want = sorted(r["doc_id"] for r in plan for _ in range(int(r["taken"] / max(1, r["size"]) + 0.5)))
            assert sorted(ids) == want
        else:
            total = docs.groupBy("doc_id").sum("length").count()
            assert total == len(set(was))
    folder = shared_dir(spark)
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert not [f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("pipeline-")]
    assert langid.UNKNOWN == "und"


def test_language_without_labels(spark):
    """A null lang column leaves nothing to learn from and empties nothing."""
    docs = spark.createDataFrame([(1, "clean text", None, "src0", 10), (2, None, None, "src0", 0), (3, "123 456", None, "src0", 7), (4, "", None, "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, taken int, row_hash int, sig string, size int"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_hard_inputs(spark, name, stage):
    """No rows; nulls everywhere; a very long text; rows that repeat; columns that clash with those of the operators."""
    rows = [(1, "long word " * 40_000, "en", "a", 400_000), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "some clean text is here", "en", None, 23), (4, "some clean text is here", "en", None, 23), (None, "and a text without an id at all", "en", "b", 31)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], COLUMNS)
    out = stage(spark, docs, "")
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS
    got = sorted((r["doc_id"] or 0) for r in out.select("doc_id").distinct().collect())
    assert got == {"language": [0, 1, 4], "near_duplicates": [0, 1, 2, 4], "personal_data": [0, 1, 2, 3, 4], "mixing": got, "packing": [0, 1, 2, 3, 4]}[name]
    if name in ("language", "personal_data"):
        assert out.where("doc_id = 4").count() == 2
    assert stage(spark, docs.limit(0), "").count() == 0
