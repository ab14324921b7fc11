"""Secret scans over a ledger of content-addressed text versions.

A text version is a blob named by its SHA-256.  The ledger (a Parquet folder in shared storage) has one row
per blob and rule version ever scanned, findings included, so one append records both that a pair was
scanned and what was found: a job that dies leaves no half-recorded pair.  A scan dedupes texts to blobs,
looks up which pairs are new, runs only those rules, appends, and joins the findings of all
wanted rule versions back to every path (row) that holds the blob.

Matches come out of the regex functions as strings between gaps; offsets are running sums over the
pieces of a text, so their cost is linear in the number of matches.  No Python runs on the executors.

Edge cases: a null text is the empty text and is a blob as well; repeated rows share one blob and
each gets all findings; an empty table scans nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from careframe.llm.common import text_of

# The patterns of the three base kinds.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # a run of fewer cannot hold one of 24


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind; ``least`` is the smallest length of a match, or of its group 1 if ``group``."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, ASSIGN, 6, True),
    Rule("access", 1, ACCESS, 20),
    Rule("hex", 1, HEX, 24),
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", 1, "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
)


def blob_of(text_col: str) -> Column:
    return F.sha2(text_of(text_col), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return None
        raise


def unseen(docs: DataFrame, text_col: str, known: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo): every blob with a rule version it was never scanned for.  Copies are dropped map-side."""
    blobs = docs.select(blob_of(text_col).alias("blob"), text_of(text_col).alias("text")).dropDuplicates(["blob"])
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if known is None:
        return blobs.withColumn("todo", wanted)
    seen = known.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)


def pieces(rule: Rule) -> Column:
    """The text cut at the rule's matches: (gap before, length, valid) per match, or null without one."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    inner = (lambda m: F.length(F.regexp_extract(m, rule.pattern, 1))) if rule.group else F.length
    cut = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), found.alias("match")), lambda x: F.struct(
        x["gap"].alias("gap"), F.length(x["match"]).alias("length"), (inner(x["match"]) >= rule.least).alias("valid")))
    return F.when(F.array_contains("todo", rule.key) & text.rlike(rule.pattern), cut)


def scan(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return (blob, kind, start, end) of all its findings for ``rules``.

    Runs one job, which appends to ``ledger``.
    """
    spark = docs.sparkSession
    new = unseen(docs, text_col, read_ledger(spark, ledger), rules)
    results = F.array(*[F.struct(F.lit(r.key).alias("rule"), pieces(r).alias("pieces")) for r in rules])
    new.select("blob", "todo", F.explode(results).alias("x")).filter(F.array_contains(F.col("todo"), F.col("x.rule"))).select(
        "blob", "x.rule", "x.pieces").write.mode("append").parquet(ledger)
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
    cut = spark.read.parquet(ledger).filter(F.col("rule").isin([r.key for r in rules]) & F.col("pieces").isNotNull()).select(
        "blob", "rule", F.posexplode("pieces").alias("place", "piece"))
    upto = Window.partitionBy("blob", "rule").orderBy("place")
    end = F.sum(F.col("piece.gap") + F.col("piece.length")).over(upto)
    return cut.select("blob", "rule", "piece", end.alias("end")).filter("piece.valid").select(
        "blob", kinds[F.col("rule")].alias("kind"), (F.col("end") - F.col("piece.length")).alias("start"), "end")


def per_path(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id_col, spans): every row with the spans of its blob, an array of (start, kind_no, end, kind) in order."""
    number = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    spans = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
        "start", number[F.col("kind")].alias("kind_no"), "end", "kind"))).alias("spans"))
    paths = docs.select(F.col(id_col), blob_of(text_col).alias("blob"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return paths.join(spans, "blob", "left").select(id_col, F.coalesce("spans", empty).alias("spans"))
