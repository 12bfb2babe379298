"""Secret scans with an incremental ledger of blobs.

Every text is a blob, named by its SHA-256. The ledger is a folder of Parquet files: one row per blob and
scan, with the rule versions that were scanned and the findings. A scan of a table looks up which (blob, rule version) pairs
the ledger lacks, takes one text of every such blob, searches it with the missing rules alone, and
appends the result. Findings then join back to all rows (paths, versions) that hold the blob.

A scan may be repeated after a failure: Spark commits the rows of a scan together, and pairs that are there already are
not scanned again.

Defined cases: a null text is the empty blob, without findings. Rows with the same text share one
scan and get the same findings, whatever their ids and other columns. An empty table adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.common import SPANS, col, fresh, joined_spans, spans
from paperlake.session import materialise, scratch_path, sized_side

FINDINGS = "array<struct<start:int,order:int,end:int,kind:string,rule:string>>"
LEDGER = f"blob binary, rules array<string>, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its Java pattern, the version of the rule, a cheap test, and what a match must hold."""

    kind: str
    version: int
    pattern: str
    gate: str
    check: str | None = None
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
#: Base rules (fixed values) and the method's own. A match of ``assign`` must end in six characters of a value.
RULES = (
    Rule("assign", 1, ASSIGN, r"[:=]", r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}$", True),
    Rule("access", 1, r"AKIA[A-Z0-9]++", "AKIA", r"^.{20,}$", True),
    Rule("hex", 1, r"[0-9a-f]{24,}+", r"[0-9a-f]{24}", None, True),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("vcs_token", 1, r"gh[pousr]_[A-Za-z0-9]{30,}+", "gh[pousr]_"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}+", "xox[abprs]-"),
    Rule("url_password", 1, r"[a-z]{2,10}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@", "://"),
)


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(text: Column, missing: Column, rules: tuple[Rule, ...]) -> Column:
    """Findings of the rules that ``missing`` names, by start, then rule."""
    def of(i: int, rule: Rule) -> Column:
        check = None if rule.check is None else (lambda v: v.rlike(rule.check))
        hit = F.when(
            F.array_contains(missing, rule.key) & text.rlike(rule.gate), spans(text, rule.pattern, check)
        ).otherwise(F.array().cast(SPANS))
        return F.transform(hit, lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end"),
            F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"),
        ))

    parts = [of(i, rule) for i, rule in enumerate(rules)]
    return F.sort_array(F.concat(*parts))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def open_ledger(spark: SparkSession, path: str) -> str:
    """A ledger without rows at ``path``, unless there is one."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return path


def update_ledger(docs: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
    """Scan the pairs that the ledger lacks; number of blobs that were scanned.

    One text per blob is taken on the map side first, so copies do not travel, and a blob that
    holds a third of the table is one row per partition.
    """
    spark = docs.sparkSession
    wanted = F.array(*[F.lit(r.key) for r in rules])
    t = F.coalesce(col(text), F.lit(""))
    rows = docs.select(blob_id(t).alias("blob"), t.alias("text"))
    ledger = read_ledger(spark, path)
    if ledger.isEmpty():
        todo = rows.withColumn("missing", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = rows.join(seen, "blob", "left").select(
            "blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("missing")
        ).where(F.size("missing") > 0)
    fresh_rows = todo.dropDuplicates(["blob"])
    scanned = fresh_rows.select("blob", F.col("missing").alias("rules"),
                                scan(F.col("text"), F.col("missing"), rules).alias("findings"))
    done = materialise(scanned, "scan")
    n = done.count()
    if n:
        done.write.mode("append").parquet(path)
    return n


def findings(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of the given rule versions; blobs without findings are left out."""
    keys = [r.key for r in rules]
    rows = read_ledger(spark, path).where(F.size("findings") > 0)
    rows = rows.select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(keys))
    return rows.distinct().groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias("findings"))


def secret_table(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, findings) of every row. Without a path, the ledger is a new one in the scratch folder."""
    spark = docs.sparkSession
    path = open_ledger(spark, path or scratch_path(spark, "ledger"))
    update_ledger(docs, path, text, rules)
    paths = docs.select(col(id).alias("doc_id"), blob_id(col(text)).alias("blob"))
    joined = paths.join(findings(spark, path, rules), "blob", "left")
    return joined.select("doc_id", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def secret_digest(table: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The digest columns of ``secret_table``."""
    kinds = [r.kind for r in rules if r.base]
    base = F.filter("findings", lambda s: s["kind"].isin(kinds))
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return table.select(
        "doc_id", *[count(k) for k in kinds], F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("findings")).alias("spans"),
    )


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """``text`` with every found span replaced by a mark; spans that overlap are replaced together.

    Spans are sorted by start. The text from the furthest end so far to the next start is kept.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(kept, F.lit(mark)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    def end(acc: Column) -> Column:
        rest = F.substring(text, acc["at"] + 1, F.char_length(text))
        return F.array_join(F.concat(acc["parts"], F.array(rest)), "")

    return F.when(F.size(found) > 0, F.aggregate(found, start, add, end)).otherwise(text)


def without_secrets(docs: DataFrame, path: str | None = None, text: str = "text", chars: str = "n_chars",
                    rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by a mark, and ``chars`` (if there is one) counted anew.

    Only the rows of blobs with findings change. The findings travel to the texts as a broadcast
    while their measured size allows; beyond, texts and findings meet in a merge join.
    """
    spark = docs.sparkSession
    path = open_ledger(spark, path or scratch_path(spark, "ledger"))
    update_ledger(docs, path, text, rules)
    key, hit = fresh(docs, "blob", "findings")
    bad = materialise(findings(spark, path, rules), "findings").select(
        F.col("blob").alias(key), F.col("findings").alias(hit)
    )
    joined = docs.withColumn(key, blob_id(col(text))).join(sized_side(bad), key, "left")
    joined = joined.withColumn(text, F.when(col(hit).isNull(), col(text)).otherwise(redact(col(text), col(hit))))
    size = lambda c: F.when(col(hit).isNull(), col(c)).otherwise(F.char_length(col(text)))
    return joined.select(*[
        size(c).cast(docs.schema[c].dataType).alias(c) if c == chars else col(c) for c in docs.columns
    ])
