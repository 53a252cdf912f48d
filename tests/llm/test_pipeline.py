from pyspark.sql import functions as F

from ferrule.llm import decontaminate, line_dedup, quality_model
from tests.llm.test_simhash import brute_near


def test_stages(spark, sf):
    """Each stage's rows follow from its operator's over what the stage before kept."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = c.quality_classifier(spark, docs, sf).cache()
    assert good.columns == docs.columns
    assert ids(good) == ids(quality_model.quality_scores(docs, read("labels")).where("predicted = 1"))

    cut = c.line_dedup(spark, good, sf).cache()
    assert cut.columns == docs.columns
    expected = {r["doc_id"]: r["kept_text"] for r in line_dedup.line_dedup(good).collect()}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == expected

    one = c.simhash_dedup(spark, cut, sf).cache()
    assert one.columns == docs.columns
    texts = sorted((r["doc_id"], r["text"]) for r in cut.collect())
    assert len({i for i, _ in texts}) == len(texts)
    assert ids(one) == [texts[k][0] for k in sorted(set(brute_near([t for _, t in texts])))]

    clean = c.decontamination(spark, one, sf).cache()
    assert clean.columns == docs.columns
    assert ids(clean) == ids(decontaminate.decontaminate(one, read("benchmark")).where(~F.col("contaminated")))

    packed = c.packing(spark, clean, sf)
    assert sorted({r["doc_id"] for r in packed.collect()}) == ids(clean)
    assert 0 < clean.count() < docs.count()


def test_run(spark, sf):
    import corpus_pipeline as c

    assert len(c.STAGES) == 5 and c.ORACLE_SQL is None
    assert c.run(spark, sf).where("n_tokens > 0").count() > 0


def test_awkward(spark, awkward, empty, sf):
    import corpus_pipeline as c

    for df in (awkward, empty):
        docs = df
        for _, stage in c.STAGES[:-1]:
            before = docs
            docs = stage(spark, docs, sf)
            assert docs.columns == df.columns
            # no stage makes rows, and none changes columns other than the text and its length
            rest = [x for x in df.columns if x not in ("text", "n_chars")]
            assert docs.select(rest).exceptAll(before.select(rest)).count() == 0
        packed = c.STAGES[-1][1](spark, docs, sf)
        assert packed.where("piece = 0").count() == docs.count()


def test_awkward_near_dedup(spark, awkward, sf):
    """Of the copies the smallest id stays; empty texts count as copies; rows without an id stay."""
    import corpus_pipeline as c

    left = sorted((r["doc_id"] for r in c.simhash_dedup(spark, awkward, sf).collect()), key=repr)
    assert left == sorted([1, 4, 7, 8, None, None, 10, 11, 12, 13, 14, 15, 16, 17, 2**62, -5], key=repr)
