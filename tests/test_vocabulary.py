"""Vocabularies keep as many words as the reference unless told otherwise."""

from quillspark.plans import words


def test_vocabulary_keeps_ten_thousand_words(spark):
    rows = spark.range(10_100 * 5).selectExpr("concat('w', id div 5) AS w", "concat('s', id % 5) AS source", "id div 5 + 1 AS n")
    got = [r.w for r in words.vocabulary(rows).collect()]
    assert got == [f"w{i}" for i in range(10_099, 99, -1)]
    assert words.vocabulary(rows, size=500).count() == 500
