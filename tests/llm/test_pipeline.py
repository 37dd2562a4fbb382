import corpus_pipeline
from aperture.llm import common as C


def test_stages(spark):
    docs = C.read(spark, "/root/testdata/sf0.001", "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, "/root/testdata/sf0.001")
        path = C.Scratch(spark, "t").table(after, name)
        assert path.columns == docs.columns and path.where("n_chars <> length(text)").isEmpty()
        assert 0 < path.count() <= before.count()
        assert path.select("doc_id").distinct().count() == path.count()
        before = path
    mixed = C.Scratch(spark, "t").table(corpus_pipeline.source_mixing(spark, before, ""), "m")
    assert mixed.columns == docs.columns
    words = lambda df: sum(len(r.text.split()) for r in df.select("text").collect())
    assert abs(words(mixed) - 1.5 * words(before)) <= 20
    pieces = corpus_pipeline.packing_stage(spark, mixed, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed.select("doc_id").collect()}


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and got.count() > 0
