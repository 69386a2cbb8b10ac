"""The classifier learns from all passages of a sampled document."""

from tablesense.llm import quality_classifier


def test_training_takes_every_passage(spark, monkeypatch):
    seen = []
    fit = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda bags, *a: seen.extend(map(len, bags)) or fit(bags[:0], *a[:0], *[x[:0] for x in a]))
    ids = [i for i in range(30) if spark.range(1).select(~quality_classifier.held_out(quality_classifier.F.lit(i))).first()[0]][:2]
    texts = ["word " * 64 * 200, "some few words"]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    quality_classifier.train(docs, spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id long, quality int"))
    assert sorted(seen) == sorted(len(quality_classifier.encode_passages([t.encode()])[0]) for t in texts) and max(seen) == 200
