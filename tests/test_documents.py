"""JSON documents read by path."""

from careframe.functions import documents
from pyspark.sql import functions as F

ROWS = [(1, '{"hiv": {"result": "neg", "titre": 3}, "tests": ["a", "b"]}'), (2, "[1, {\"x\": null}]"), (3, "{bad"), (4, " "), (5, None), (6, "7"),
        (7, '{"hiv": {"titre": "many"}}'), (8, '{"a": 1, "a": 2}')]


def test_paths_kinds_and_refused_texts(rows):
    good, bad = documents.split_documents(rows("id int, doc string", *ROWS), "doc")
    assert {r["id"] for r in bad.collect()} >= {3} and {r["id"] for r in bad.collect()} <= {3, 8}
    at = F.col("doc")
    got = {r["id"]: (r["r"], r["t"], r["s"], r["x"]) for r in good.select(
        "id", documents.value_at(at, "$.hiv.result").alias("r"), documents.value_at(at, "$.hiv.titre", "int").alias("t"),
        documents.value_at(at, "$.tests[1]").alias("s"), documents.value_at(at, "$[0]", "int").alias("x")).collect()}
    assert got[1] == ("neg", 3, "b", None) and got[2] == (None, None, None, 1)
    assert got[4] == got[5] == got[6] == got[7] == (None,) * 4


def test_schema_and_entries_are_found(rows):
    good, _ = documents.split_documents(rows("id int, doc string", *ROWS[:2], ROWS[3], ROWS[4]), "doc")
    assert "hiv: OBJECT<result: STRING, titre: BIGINT>" in documents.schema_of(good.filter("id = 1"), "doc")
    found = documents.fields_of(good, "doc", "id").filter("position is not null")
    assert sorted((r["id"], r["position"], r["name"]) for r in found.select("id", "position", "name").collect()) == [
        (1, 0, "hiv"), (1, 1, "tests"), (2, 0, None), (2, 1, None)]
