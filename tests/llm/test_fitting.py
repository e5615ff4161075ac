"""The labelled sample is drawn among the documents that are there."""

from pyspark.sql import functions as F

from skyweave.llm import fitting


def drawn(docs, labels, rows=1000, longest=100):
    texts, y = fitting.labelled_sample(docs, labels, "quality", F.col("doc_id") % 3 != 1, rows, longest)
    return sorted(zip((t.decode() for t in texts), y.tolist()))


def test_labels_of_other_documents_take_no_places(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    docs = spark.createDataFrame([(k * 190, f"text {k}", k) for k in range(300)], "doc_id long, text string, label long")
    want = sorted((f"text {k}", float(k * 190 % 2)) for k in range(300) if k * 190 % 3 != 1)
    assert drawn(docs, labels) == want
    assert len(drawn(docs, labels, rows=50)) == 50 and set(drawn(docs, labels, rows=50)) <= set(want)


def test_nulls_repeats_and_conflicts(spark):
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, 0), (2, 1), (3, 1), (5, 0), (6, None), (8, 2), (9, 1), (4, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(0, "a"), (0, "b"), (0, "a"), (2, "c"), (3, None), (5, "x" * 101), (6, "d"), (8, "e"), (9, "f"), (4, "g"), (None, "h")], "doc_id long, text string")
    got = drawn(docs, labels)
    assert [t for t, _ in got if t not in ("a", "b")] == ["", "f"] and len(got) == 3  # one of the texts of document 0
    assert drawn(docs.limit(0), labels) == drawn(docs, labels.limit(0)) == []
