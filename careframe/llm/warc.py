"""WARC archives: written by Spark, read back in splits with every record boundary proved.

``write_archives`` makes one record per row.  Of rows with equal payloads the one with the largest id is a response, the others are
revisits that refer to it and carry no payload.  A record is one line of Spark's text writer, whose line separator
is the CR LF CR LF that ends a WARC record, so the archives go wherever Spark can write.

``read_archives`` cuts files of any size into Spark's splits at the magic ``LF WARC/1.``; a payload may hold that too.  Boundary-chain
verification keeps the true records: every occurrence whose header ends and has a length is a candidate, and its length names
its successor's offset.  Each task follows its own candidates to the first offset beyond its split; pointer jumping over these few
exits, from each file's start, doubles the reach per round and finds where the chain enters each split.  Only records on the
chain are returned.  A magic inside a payload is never reached, and its bytes go back into the payload, also across splits.

Splits are known by file and block, so their size must not change between the passes: the reader works in a session of its own,
equal to the caller's but with one fixed split size.  What the chain needs about a split is one row (under 200 bytes per split of,
usually, 128 MB); it is broadcast up to ``MOST_BROADCAST`` splits and joined by a sorted shuffle beyond.

Edge cases: a null payload is the empty text; empty payloads are equal payloads; rows that share the largest id of
equal payloads are all responses; a null id counts below all others and is read back as null; repeated rows are records of
their own; a null URL leaves its header out, one with blanks or control characters is URL-encoded; records may be longer than
a split; an empty table writes no record and reads back none; other columns are not archived.  An archive whose chain does not
end at its last byte is refused, or with ``strict=False`` read up to the break.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from careframe.llm.common import stored, text_of

END = "\r\n\r\n"
MAGIC = "WARC/1."
CUT = "\n" + MAGIC
DATE = "1970-01-01T00:00:00Z"
MOST_BROADCAST = 1_000_000
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
_SKIP = len(MAGIC)

RECORD = ("file string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
          "payload_digest string, payload binary")


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1, five hexadecimal digits (four letters) at a time."""
    digest = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(id_: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(id_.cast("string")), F.lit(">")), F.lit("<urn:none>"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                   least: int = 0) -> None:
    """One record per row of ``pages`` in new archives below ``folder``.  Payloads under ``least`` bytes are always responses."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), text_of(payload_col).alias("payload"))
    rows = rows.withColumns({"key": F.sha2("payload", 256), "size": F.octet_length("payload")})
    # Known size, so that the payloads are not shuffled while the copies are few.
    copied = stored(rows.filter(F.col("size") >= least).groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("first")).filter(
        "n > 1").select("key", "first"), "warc-copies").withColumn("copied", F.lit(True))
    rows = rows.join(copied, "key", "left")
    revisit = F.coalesce("copied", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))
    uri = F.when(F.col("uri").rlike("[\\x00-\\x20\\x7F]"), F.url_encode("uri")).otherwise(F.col("uri"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", F.lit("text/html; charset=utf-8")),
                      _line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    block = F.concat(answer, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\n"), _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("id"))), _line("WARC-Date", F.lit(DATE)),
        F.coalesce(_line("WARC-Target-URI", uri), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("first"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit(HTTP)), _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    rows.select(F.concat(head, block)).write.option("lineSep", END).text(folder)


def _pinned(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose file splits do not depend on how many cores there are just now."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def _by_split(batches, *columns: int):
    """(file, block, last, columns as NumPy or Arrow arrays) for the stretches of rows of one split; splits are contiguous."""
    held = None
    for batch in batches:
        files, blocks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        edges = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        bounds = np.concatenate(([0], edges, [len(files)]))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if start == end:
                continue
            place = (files[start], int(blocks[start]))
            if held is not None:
                yield *held[0], held[0] != place, held[1]
            held = place, [batch.column(c).slice(start, end - start) for c in columns]
    if held is not None:
        yield *held[0], True, held[1]


def _exits(batches):
    """For every candidate its place in the split and where its chain leaves the split; one more row per split with its length."""
    gathered: list[list[np.ndarray]] = []
    for file, block, last, columns in _by_split(batches, 2, 3, 4, 5, 6):
        gathered.append([c.fill_null(-1).to_numpy(zero_copy_only=False) for c in columns[:3]] + [
            columns[3].to_numpy(zero_copy_only=False), columns[4].to_numpy()])
        if not last:
            continue
        size, head, length, magic, file_size = (np.concatenate(c) for c in zip(*gathered))
        gathered = []
        # Row r holds what follows a magic; at[r] is that place, counted from the split's first row (from the file's start in the first).
        upto = np.cumsum(size + len(CUT))
        at, total = upto - size - len(CUT), int(upto[-1])
        start = np.zeros(len(at), bool)
        if block == 0:
            at[0], start[0] = _SKIP, True
        good = (length >= 0) & (magic == start)
        # Header and blank line, block, CR LF CR LF, magic.
        follows = np.where(good, at + head + length + 2 * len(END) + _SKIP, -1)
        # A file's last record holds the line feed that elsewhere begins the next magic, hence the one less.
        inside = good & (follows < total - 1)
        to = np.searchsorted(at, follows)
        found = inside & (at[np.minimum(to, len(at) - 1)] == follows)
        final = np.where(found, to, np.arange(len(at)))
        while (final[final] != final).any():
            final = final[final]
        leaves = (good & ~inside)[final]
        keep = np.flatnonzero(good)
        exits = pa.array(np.where(leaves, follows[final], 0)[keep], pa.int64(), mask=~leaves[keep])
        n = len(keep) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array([*at[keep].tolist(), None], pa.int64()),
             pa.concat_arrays([exits, pa.array([total], pa.int64())]), pa.array([int(file_size[0])] * n, pa.int64())],
            names=["file", "block", "at", "exit", "file_size"])


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between two magics, a row each, in the order of the file."""
    return spark.read.option("lineSep", CUT).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), "value")


def _chain(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(splits, faults).  splits: file, block, base, entry, following; ``entry`` is where the chain enters the split, if it does, and
    ``following`` where it enters next, or the file ends.  faults: file, offset of archives whose chain breaks."""
    magic = F.startswith(F.col("value"), F.lit(MAGIC))
    head = F.when(F.col("value").rlike("^(WARC/1\\.)?[0-9]\\r\\n") & F.contains(F.col("value"), F.lit(END)), F.substring_index("value", END, 1))
    length = F.regexp_extract(head, "(?i)\\r\\nContent-Length:[ \\t]*([0-9]{1,15})[ \\t]*(?=\\r\\n|$)", 1).try_cast("long")
    slim = _rows(spark, folder).select(
        "file", "block", F.octet_length("value").cast("long").alias("size"),
        (F.octet_length(head) - F.when(magic, _SKIP).otherwise(0)).cast("long").alias("head"), length.alias("length"),
        magic.alias("magic"), "file_size")
    found = stored(slim.mapInArrow(_exits, "file string, block long, at long, exit long, file_size long"), "warc-candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = stored(found.filter("at is null").select(
        "file", "block", "file_size", F.coalesce(F.sum("exit").over(before), F.lit(0)).alias("base")), "warc-splits")
    nodes = found.filter("at is not null").drop("file_size").join(splits, ["file", "block"]).select(
        "file", "block", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("exit")).alias("next"))
    ends = nodes.filter("next is not null").select("file", F.col("next").alias("at"), F.lit(True).alias("aim")).distinct()
    start = F.col("at") == _SKIP
    # Only places that some chain of another split leads to can be entries.
    entries = stored(nodes.join(ends, ["file", "at"], "left").filter(start | F.col("aim")).select("file", "block", "at", "next"), "warc-entries")
    reach, jump = entries.filter(start).select("file", "at"), entries.filter("next is not null").select("file", "at", "next")
    known = reach.count() if entries.filter(~start).limit(1).count() else 0
    while known:
        step = reach.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = stored(reach.union(step.join(entries, ["file", "at"], "left_semi")).distinct(), "warc-reach")
        n = grown.count()
        if n == known:
            break
        further = jump.select("file", F.col("at").alias("since"), F.col("next").alias("at")).join(jump, ["file", "at"])
        reach, known = grown, n
        jump = stored(further.select("file", F.col("since").alias("at"), "next"), "warc-jumps")
    reached = entries.join(reach, ["file", "at"], "left_semi")
    # In a file whose chain breaks there is no next place; what follows the break belongs to no record.
    lasts = reached.groupBy("file").agg(F.max_by(F.struct("at", "next"), "at").alias("last"))
    faults = splits.groupBy("file").agg(F.max("file_size").alias("file_size")).join(lasts, "file", "left").filter(
        ~F.coalesce(F.col("last.next") == F.col("file_size") + _SKIP, F.lit(False))).select(
        "file", (F.coalesce(F.col("last.at"), F.lit(_SKIP)) - _SKIP).alias("offset"))
    later = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    entered = splits.join(reached.select("file", "block", F.col("at").alias("entry")), ["file", "block"], "left").withColumn(
        "following", F.coalesce(F.min("entry").over(later), F.col("file_size") + _SKIP))
    return stored(entered.drop("file_size"), "warc-chain"), faults


_FOLD = re.compile(r"\r\n[ \t]+")


def _parsed(raw: bytes) -> tuple:
    """(type, id, uri, refers to, digest, payload) of a record without its magic and its last CR LF CR LF."""
    head, _, block = raw.partition(END.encode())
    fields = {}
    for line in _FOLD.sub(" ", head.decode("utf-8", "replace")).split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(END.encode())[2]
    return (fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            fields.get("warc-payload-digest"), block)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (file, offset, raw record)."""
    parsed = [_parsed(raw) for _, _, raw in rows]
    kinds = [pa.string()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
         *[pa.array([p[i] for p in parsed], kind) for i, kind in enumerate(kinds)]],
        names=["file", "offset", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload"])


_VERSION = re.compile(rb"[0-9]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]{1,15})[ \t]*(?=\r\n|$)", re.I)


def _follows(at: int, value: bytes) -> int:
    """Where the record that begins at ``at`` says the next one is; -1 if it is no candidate."""
    head, end, _ = value.partition(END.encode())
    length = end and _VERSION.match(head) and _LENGTH.search(head)
    return at + len(head) + int(length[1]) + 2 * len(END) + _SKIP if length else -1


def _walk(whole: bool):
    """Follow the chain through each split: its complete records, or (``whole`` false) the pieces of records that cross splits."""
    cut, most = CUT.encode(), 16 << 20

    def piece(file, follow, begin, begins, pieces):
        return pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([follow], pa.int64()), pa.array([begin], pa.int64()), pa.array([begins]),
             pa.array([cut.join(pieces)], pa.binary())], names=["file", "follow", "at", "begins", "piece"])

    def run(batches):
        place, rows, size = None, [], 0
        for file, block, last, (values, bases, entries, followings) in _by_split(batches, 2, 3, 4, 5):
            if place != (file, block):
                # What comes before the chain enters is the end of a record that began in an earlier split.
                place, pieces, begins = (file, block), [], False
                at = begin = bases[0].as_py()
                follow = followings[0].as_py() if entries[0].as_py() is None else entries[0].as_py()
            for value in values.to_pylist():
                if at == 0:
                    value, at = value[_SKIP:], _SKIP
                if at == follow:
                    begin, begins, pieces, follow = at, True, [], _follows(at, value)
                if follow < 0:  # the chain broke
                    continue
                if begins or not whole:
                    pieces.append(value)
                at += len(value) + len(cut)
                if at - follow in (0, 1):  # one more at the end of a file
                    if whole and begins:
                        rows.append((file, begin - _SKIP, cut.join(pieces)[:follow - begin - _SKIP - len(END)]))
                        size += len(rows[-1][2])
                    elif not whole and not begins:
                        yield piece(file, follow, begin, begins, pieces)
                    pieces = []
                    if size >= most or len(rows) >= 1000:
                        yield _records(rows)
                        rows, size = [], 0
            if last and pieces and not whole:
                yield piece(file, follow, begin, begins, pieces)
        if rows:
            yield _records(rows)

    return run


def _joined(batches):
    """Records put together from their pieces, which come in order; one whose start or end is missing is dropped."""
    cut = CUT.encode()
    for batch in batches:
        for i in range(batch.num_rows):
            parts, follow = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            raw, size = cut.join(p["piece"] for p in parts), follow - parts[0]["at"] - _SKIP
            if parts[0]["begins"] and len(raw) >= size - 1:
                yield _records([(batch.column(0)[i].as_py(), parts[0]["at"] - _SKIP, raw[:size - len(END)])])


def read_archives(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """Every record of the archives below ``folder``: file, offset, record_type, record_id, target_uri, refers_to, payload_digest
    (as the headers have them) and payload (without HTTP headers).  Runs the jobs that verify the chain."""
    own = _pinned(spark)
    splits, faults = _chain(own, folder)
    if strict and (broken := faults.orderBy("file").limit(1).collect()):
        raise ValueError(f"the records of {broken[0]['file']} do not add up from offset {broken[0]['offset']}")
    info = splits.select("file", "block", "base", "entry", "following")
    rows = _rows(own, folder).select("file", "block", F.col("value").cast("binary").alias("value"))
    shape = ["file", "block", "value", "base", "entry", "following"]
    if info.count() <= MOST_BROADCAST:
        placed = rows.join(F.broadcast(info), ["file", "block"]).select(*shape)
    else:
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        placed = numbered.join(info, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "row").select(*shape)
    records = placed.mapInArrow(_walk(True), RECORD)
    entered = F.coalesce(F.col("entry") == F.greatest(F.col("base"), F.lit(_SKIP)), F.lit(False))
    if splits.filter(~entered).limit(1).count():
        pieces = placed.mapInArrow(_walk(False), "file string, follow long, at long, begins boolean, piece binary")
        gathered = pieces.groupBy("file", "follow").agg(F.sort_array(F.collect_list(F.struct("at", "begins", "piece"))).alias("parts")).select(
            "file", "parts", "follow")
        records = records.unionByName(gathered.mapInArrow(_joined, RECORD))
    return records


def id_of(urn: Column) -> Column:
    """The id inside a record id; null for the record of a null id."""
    return F.try_url_decode(F.when(F.startswith(urn, F.lit("<urn:page:")), F.regexp_extract(urn, "^<urn:page:(.*)>$", 1)))


def resolve(records: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, intact) of every record: revisits have the facts of the payload they
    refer to; ``intact``: the payload has the digest its header tells.  Writes the facts of all records, without payloads, once."""
    facts = stored(records.select(
        id_of(F.col("record_id")).alias("id"), "record_id", "record_type", F.col("refers_to").alias("urn"), id_of(F.col("refers_to")).alias("refers_to"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("told"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest")), "warc-facts")
    revisit = F.col("record_type") == "revisit"
    full = F.col("record_type").isin("response", "resource")
    plain = facts.filter(full).select("id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to"),
                                          (F.col("told") == F.col("payload_digest")).alias("intact"))
    # A response that was written twice is one target.
    targets = facts.filter(full).groupBy(F.col("record_id").alias("urn"), F.col("payload_digest").alias("told")).agg(
        F.first("payload_bytes").alias("bytes")).withColumn("known", F.lit(True))
    again = facts.filter(revisit).drop("payload_bytes", "payload_digest").join(targets, ["urn", "told"], "left").select(
        "id", F.col("bytes").alias("payload_bytes"), F.col("told").alias("payload_digest"), "record_type", "refers_to",
        F.coalesce("known", F.lit(False)).alias("intact"))
    return plain.unionByName(again)
