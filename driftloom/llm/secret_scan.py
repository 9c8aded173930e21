"""Secret scans over content-addressed versions, with a ledger of what was scanned."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftloom.llm import arrays
from driftloom.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """Non-overlapping matches, leftmost first, of which `group` has `least` characters."""

    kind: str
    version: int
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1
    #: A text without this (in lower case, if flags ignore case) has no match.
    needs: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three are fixed by the contract of the query; the order is that of the output.
RULES = (
    Rule(
        "assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.ASCII | re.IGNORECASE, 2, 8, ("passw", "secret", "token", "key"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=16, needs=("AKIA",)),
    # A shorter run never matches, wherever in it the search begins, so the run is taken whole.
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("PRIVATE KEY-----",)),
    Rule("forge", 1, r"\bgh[oprsu]_[A-Za-z0-9]{36,}", needs=("gh",)),
    Rule("chat", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("jwt", 1, r"\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}", needs=("eyJ",)),
)

#: Tasks that the copies of one text are masked by.
SALTS = 32
LEDGER = "blob string, rules array<string>, spans array<struct<kind:string,rule:string,start:bigint,end:bigint>>"


def matches(rule: Rule, text: str) -> list[tuple[int, int]]:
    """(start, end) of the rule's findings in code points, end exclusive."""
    if rule.needs:
        held = text.lower() if rule.flags & re.IGNORECASE else text
        if not any(word in held for word in rule.needs):
            return []
    return [
        m.span() for m in re.compile(rule.pattern, rule.flags).finditer(text)
        if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]


def _scanner(rules: tuple[Rule, ...]):
    by_name = {r.name: r for r in rules}

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for part in arrays.slices(batches, "content"):
            spans = []
            for text, missing in zip(part.column("content").to_pylist(), part.column("rules").to_pylist()):
                spans.append([
                    {"kind": by_name[n].kind, "rule": n, "start": a, "end": b}
                    for n in missing for a, b in matches(by_name[n], text)
                ])
            yield pa.record_batch(
                [part.column("blob"), part.column("rules"), pa.array(spans, pa.list_(kind))],
                names=["blob", "rules", "spans"],
            )
    return scan


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rules scanned, spans), one row per scan; empty if nothing was scanned yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) of every row of versions (path, content), scanning only what is new.

    A version's address is the SHA-256 of its content. Pairs of an address and a
    rule's name and version that the ledger lacks are scanned, once however many
    paths hold the content, and added to the ledger; findings are then joined
    back to all paths. The scan is one append: if it fails, nothing was added.

    A null content is empty. A null path is a path like others. Repeated rows
    give repeated results. Further columns are ignored.
    """
    spark = versions.sparkSession
    names = [r.name for r in rules]
    held = versions.select(F.col("path"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    held = held.select("path", "content", F.sha2("content", 256).alias("blob"), F.xxhash64("path").alias("at"))
    seen = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule"))
    seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    wanted = F.array(*[F.lit(n) for n in names])
    # The text of a blob is read at one of its paths only, the one of least hash.
    at = held.groupBy("blob").agg(F.min("at").alias("at")).join(seen, "blob", "left")
    todo = at.select(
        "blob", "at", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")
    ).where(F.size("rules") > 0)
    new = held.select("blob", "at", "content").join(todo, ["blob", "at"]).dropDuplicates(["blob", "at"])
    new.select("blob", "content", "rules").mapInArrow(_scanner(rules), LEDGER).write.mode("append").parquet(ledger)
    known = (
        read_ledger(spark, ledger).groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        .withColumn("spans", F.filter("spans", lambda s: s["rule"].isin(names)))
    )
    return held.select("path", "blob").join(known, "blob").select("path", "blob", "spans")


def in_order(spans: str, rules: tuple[Rule, ...] = RULES):
    """Spans by start, then by the order of the rules."""
    def place(s):
        at = F.lit(len(rules))
        for k, r in reversed(list(enumerate(rules))):
            at = F.when(s["kind"] == r.kind, k).otherwise(at)
        return F.struct(s["start"].alias("start"), at.alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))

    return F.array_sort(F.transform(spans, place))


def joined(spans):
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Digests of the secrets of every document, from a ledger of its own."""
    base = [r.kind for r in RULES[:3]]
    ledger = scratch_path(docs.sparkSession, "ledger")
    found = scan_versions(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), ledger)
    found = found.withColumn("s", in_order("spans")).withColumn("b", F.filter("s", lambda s: s["kind"].isin(base)))

    def count(kind: str):
        return F.size(F.filter("b", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("path").alias("doc_id"), *[count(k) for k in base],
        F.sha2(joined(F.col("b")), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret replaced by `mask` and n_chars counted anew.

    Overlapping spans are one. Text between spans stays as it is; documents
    without a secret, nulls included, are untouched.
    """
    ledger = scratch_path(docs.sparkSession, "ledger")
    found = scan_versions(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), ledger)
    blobs = found.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), "spans").dropDuplicates(["_blob"])
    # Copies of one text are read by SALTS tasks: only blobs with findings are repeated for that.
    blobs = blobs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Columns of `docs` stay in one struct, so no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_blob", F.sha2("_row.text", 256))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_row.doc_id"), F.lit(SALTS)).cast("int"))
    held = rows.join(blobs, ["_salt", "_blob"], "left").withColumn("_text", F.col("_row.text"))
    # (place reached, text so far) over the spans in order.
    state = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].cast("int").alias("a"), s["end"].cast("int").alias("z")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["z"]).alias("at"),
            F.when(s["a"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], F.substring("_text", acc["at"] + 1, s["a"] - acc["at"]), F.lit(mask))
            ).alias("out"),
        ),
    )
    held = held.withColumn("_s", state)
    clean = F.concat(F.col("_s.out"), F.substring(F.col("_text"), F.col("_s.at") + 1, F.length("_text")))
    text = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(clean)
    result = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in result:
        counted = F.when(F.col("spans").isNull(), result["n_chars"]).otherwise(F.length(text))
        result["n_chars"] = counted.cast(docs.schema["n_chars"].dataType)
    return held.select(*[value.alias(c) for c, value in result.items()])
