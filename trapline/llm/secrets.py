"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the content it holds. The ledger
lists the (blob, rule, rule version) triples already scanned; a scan looks only at
the others, adds its findings and joins all findings back to every path. DataFrame
functions only.

Defined cases: a null text is the empty blob; rows with equal paths and versions
stay separate rows; a null path is kept; an empty table or an empty rule set gives
no findings. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trapline.llm import common, spans
from trapline.session import scratch_path

FINDINGS = "blob binary, rule string, version int, begin int, end int"
LEDGER = "blob binary, rule string, version int"


@dataclass(frozen=True)
class Rule:
    """A pattern, and how long its ``group`` must be; matches that fail are dropped, not retried."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A greedy run that is long enough, or no match: the same as dropping short runs afterwards.
    Rule("access", r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
]


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(common.text_of(text), 256))


def open_ledger(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(scanned triples, findings) kept below ``path``; empty ones without a path."""
    if path is None:
        return spark.createDataFrame([], LEDGER), spark.createDataFrame([], FINDINGS)
    return spark.read.schema(LEDGER).parquet(f"{path}/scanned"), spark.read.schema(FINDINGS).parquet(f"{path}/findings")


def _matches(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of blobs ``blob, text, due`` (names of the rules still to run)."""
    text = F.col("text")
    found = blobs.select("blob", *[
        F.when(F.array_contains("due", r.name), spans.pieces(text, r.pattern, r.group)).alias(f"_{i}")
        for i, r in enumerate(rules)])
    each = F.filter(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                                       F.col(f"_{i}").alias("parts")) for i, r in enumerate(rules)]), lambda x: x["parts"].isNotNull())
    rows = (found.select("blob", F.explode(each).alias("x"))
            .select("blob", "x.rule", "x.version", "x.least", F.posexplode("x.parts").alias("i", "p"))
            .select("blob", "rule", "version", "least", "i", F.length("p.gap").alias("gap"),
                    F.length("p.match").alias("n"), F.length("p.value").alias("size")))
    # Gaps and matches alternate; the gap after the last match has no match.
    upto = F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(Window.partitionBy("blob", "rule", "version").orderBy("i"))
    return (rows.withColumn("end", upto.cast("int")).where(F.col("n").isNotNull() & (F.col("size") >= F.col("least")))
            .select("blob", "rule", "version", (F.col("end") - F.col("n")).alias("begin"), "end"))


def scan(versions: DataFrame, ledger: tuple[DataFrame, DataFrame], *, text_col: str = "text", rules: list[Rule] = RULES):
    """(new triples, new findings): what the ledger lacks, scanned.

    Equal contents are scanned once however many paths and versions hold them.
    """
    spark = versions.sparkSession
    if not rules:
        return spark.createDataFrame([], LEDGER), spark.createDataFrame([], FINDINGS)
    scanned, _ = ledger
    text = common.text_of(text_col)
    blobs = versions.select(blob_id(F.col(text_col)).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    known = scanned.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("known"))
    wanted = F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules])
    due = F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
    todo = blobs.join(known, "blob", "left").withColumn("due", F.transform(due, lambda x: F.substring_index(x, "@", 1))).where(F.size("due") > 0)
    findings = _matches(todo, rules)
    triples = todo.select("blob", F.explode("due").alias("rule")).join(
        F.broadcast(spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")), "rule").select("blob", "rule", "version")
    return triples, findings


def update_ledger(versions: DataFrame, path: str, **options) -> None:
    """Scans what the ledger below ``path`` lacks and appends triples and findings."""
    spark = versions.sparkSession
    for name, schema in (("scanned", LEDGER), ("findings", FINDINGS)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")
    ledger = open_ledger(spark, path)
    triples, findings = scan(versions, ledger, **options)
    # Findings first: a run that dies between the two writes repeats the scan, and findings are read as a set.
    findings.write.mode("append").parquet(f"{path}/findings")
    triples.write.mode("append").parquet(f"{path}/scanned")


def _by_blob(findings: DataFrame, rules: list[Rule]) -> DataFrame:
    """``blob, findings``: an array of ``(begin, kind, end, rule)`` in order of begin, then rule as listed."""
    spark = findings.sparkSession
    if not rules:
        return spark.createDataFrame([], "blob binary, findings array<struct<begin:int,kind:int,end:int,rule:string>>")
    listed = spark.createDataFrame([(r.name, r.version, i) for i, r in enumerate(rules)], "rule string, version int, kind int")
    return (findings.distinct().join(F.broadcast(listed), ["rule", "version"]).groupBy("blob")
            .agg(F.sort_array(F.collect_list(F.struct("begin", "kind", "end", "rule"))).alias("findings")))


def findings_by_path(versions: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None,
                     rules: list[Rule] = RULES) -> DataFrame:
    """``id, blob, findings`` for every row, scanning only what the ledger does not know.

    Without a path the ledger lives below the shared folder and starts empty.
    """
    found = _known_findings(versions, text_col, ledger_path, rules)
    rows = versions.select(F.col(id_col).alias("id"), blob_id(F.col(text_col)).alias("blob"))
    return rows.join(found, "blob", "left").select("id", "blob", "findings")


def _known_findings(versions: DataFrame, text_col: str, ledger_path: str | None, rules: list[Rule]) -> DataFrame:
    spark = versions.sparkSession
    path = ledger_path or scratch_path(spark, "ledger")
    update_ledger(versions, path, text_col=text_col, rules=rules)
    return _by_blob(open_ledger(spark, path)[1], rules)


def redact(documents: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", ledger_path: str | None = None,
           rules: list[Rule] = RULES) -> DataFrame:
    """The rows, all columns kept, with every finding replaced by ``mark``; findings that overlap share one mark."""
    found = _known_findings(documents, text_col, ledger_path, rules)
    rows = documents.select(blob_id(F.col(text_col)).alias("blob"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    text = F.col("row").getField(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, f):
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, f["begin"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], f["end"]).alias("at"), F.when(f["begin"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate("findings", start, step)
    clean = F.when(F.col("findings").isNull(), text).otherwise(
        F.concat(folded["out"], F.substring(text, folded["at"] + 1, F.length(text))))
    return rows.join(found, "blob", "left").select(*[
        (clean if c == text_col else F.col("row").getField(c)).alias(c) for c in documents.columns])
