"""Archives written and read back, in splits of any size, against the rows they were made from."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from careframe.llm import warc
from careframe.session import work_folder

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def expected(pages):
    """(id, bytes, digest, type, refers to) of every row: the contract, row by row."""
    largest = {}
    for i, _, html in pages:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    rows = []
    for i, _, html in pages:
        html = html or ""
        copies = sum((h or "") == html for _, _, h in pages)
        first = largest.get(html)
        again = copies > 1 and i != first
        rows.append((None if i is None else str(i), len(html.encode()), digest(html), "revisit" if again else "response",
                     str(first) if again else None))
    return sorted(rows, key=str)


def nasty(seed, n):
    """Payloads full of magic: fake headers with lengths that lead to other fakes, or to the next true record, or nowhere."""
    rng = random.Random(seed)
    bits = ["a", "\n", "\r\n", "\r\n\r\n", "\nWARC/1.", "WARC/1.1\r\n", "Content-Length: 3\r\n\r\n", "é", FAKE % 0, FAKE % 4, FAKE % 1, "\nWARC/1.WARC/1.1\r\n"]
    return [(i, f"http://x/WARC/1.1/{i}", "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(n)]


EDGES = [(1, "http://a", "same"), (2, None, "same"), (2, None, "same"), (3, "http://b c\r\nX: y", None), (4, "", ""), (None, "u", "same"),
         (5, "u", "only"), (6, "u", FAKE % 10), (7, "u", "x" * 5000 + FAKE % 0 + "y" * 3000), (8, "u", "ends in a break\r\n"), (9, "u", "\n"), (-1, "u", "\n")]


@pytest.mark.parametrize("pages,split,files", [(EDGES, 1 << 20, 2), (EDGES, 400, 1), (nasty(1, 30), 500, 2), (nasty(2, 6), 61, 1)])
def test_archives_equal_their_rows(spark, pages, split, files):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        place = work_folder(spark, "warc")
        warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(files), place)
        records = warc.read_archives(spark, place)
        assert records.columns == [c.split()[0] for c in warc.RECORD.split(", ")]
        rows = records.collect()
        facts = warc.resolve(records)
        assert sorted((tuple(r) for r in facts.collect()), key=str) == sorted((w + (True,) for w in expected(pages)), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["payload"].decode() for r in rows if r["record_type"] == "response" and r["record_id"] != "<urn:none>") == sorted(
        h or "" for (i, _, h), want in zip(pages, [w for p in pages for w in expected_row(pages, p)]) if want == "response" and i is not None)


def expected_row(pages, page):
    """The record type of one row."""
    i, _, html = page
    alike = [j for j, _, h in pages if (h or "") == (html or "")]
    return ["revisit" if len(alike) > 1 and i != max((j for j in alike if j is not None), default=None) else "response"]


def test_header_of_a_url_with_breaks(spark):
    place = work_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "http://b c\r\nX: y", "z")], "page_id long, url string, html string"), place)
    assert warc.read_archives(spark, place).collect()[0]["target_uri"] == "http%3A%2F%2Fb+c%0D%0AX%3A+y"


def test_empty_table_other_columns_and_ids_of_other_types(spark):
    pages = spark.createDataFrame([("a b", "u", "t", 1, "n"), ("c", "u", "t", 2, "m")], "page_id string, url string, html string, size int, key string")
    place = work_folder(spark, "warc")
    warc.write_archives(pages, place)
    assert {tuple(r)[:1] + tuple(r)[3:5] for r in warc.resolve(warc.read_archives(spark, place)).collect()} == {("a b", "revisit", "c"), ("c", "response", None)}
    empty = work_folder(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_small_payloads_stay_responses(spark):
    place = work_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                                              "page_id long, url string, html string"), place, least=3)
    got = {r["id"]: r["record_type"] for r in warc.resolve(warc.read_archives(spark, place)).collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


@pytest.mark.parametrize("cut,left", [(1, 4), (300, 3)])
def test_a_truncated_archive_is_refused(spark, tmp_path, cut, left):
    """A last record that lacks only the end of its closing line breaks has its whole payload."""
    place = work_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([(i, "u", f"text {i}") for i in range(4)], "page_id long, url string, html string").coalesce(1), place)
    text = next(r[0] for r in spark.read.text(place, wholetext=True).collect())
    (tmp_path / "a.warc").write_bytes(text.encode()[:-cut])
    with pytest.raises(ValueError, match="do not add up"):
        warc.read_archives(spark, str(tmp_path))
    assert warc.read_archives(spark, str(tmp_path), strict=False).count() == left


def test_records_of_other_writers(spark, tmp_path):
    """Folded headers, lower case names, a block that is no HTTP answer, and a first record of another type."""
    def record(head, block):
        return b"WARC/1.0\r\n" + head + b"content-length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    (tmp_path / "b.warc").write_bytes(record(b"WARC-Type: warcinfo\r\nX-Note: a\r\n b\r\n", b"software: none\r\n") + record(
        b"warc-type: resource\r\nwarc-record-id: <urn:page:7>\r\n", b"\xff\x00raw\nWARC/1.0\r\n"))
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in rows] == [("warcinfo", b"software: none\r\n"), ("resource", b"\xff\x00raw\nWARC/1.0\r\n")]
    assert warc.resolve(warc.read_archives(spark, str(tmp_path))).select(F.col("id")).collect() == [("7",)]
