"""The classifier does not depend on how its rows are dealt, nor on the type of its ids."""

import random

from pyspark.sql import functions as F

from careframe.llm import classifier


def test_scores_are_equal_however_repeated_ids_are_dealt(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc xyz") for _ in range(200))) for i in range(40) for _ in range(2)]
    docs = spark.createDataFrame(rows + [(3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = set()
    for dealt in (docs.coalesce(1), docs.repartition(3), docs.orderBy(F.desc("text"))):
        model = classifier.fit(dealt, labels)
        found.add(tuple(sorted((r["doc_id"], r["text"] or "", r["score"]) for r in classifier.score(docs, model).collect())))
    assert len(found) == 1


def test_ids_may_be_text(spark):
    docs = spark.createDataFrame([(f"d{i}", "good text " * 9 if i % 2 else "#$% " * 20) for i in range(30)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(30)], "doc_id string, quality int")
    scored = classifier.score(docs, classifier.fit(docs, labels)).collect()
    assert all((r["score"] >= classifier.THRESHOLD) == (r["doc_id"][1:] in {str(i) for i in range(1, 30, 2)}) for r in scored)
