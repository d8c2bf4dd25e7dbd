"""Operator 4: secret scans over an incremental ledger of blobs.

Every version of every path is a blob, known by the SHA-256 of its content. The
ledger is a Parquet table of what each blob was found to hold under each
version of the rules, which is a digest of the rules. A scan takes the distinct
blobs, leaves out those that the ledger has under the present rules, scans the
rest, adds them to the ledger, and joins the findings back to all paths and
versions. The ledger is only added to; a blob that two scans at once added
counts once when it is read.

Equal blobs meet through map-side aggregation, so a content with very many
copies reaches a later task once per map task and is scanned once, and its
findings reach its rows by broadcast.

Defined results: a null content counts as empty; an empty content has no
findings; contents of any length are scanned whole; repeated rows each get
their findings; columns besides path and content are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, fresh_path, join_by_key
from factloom.shipping import ship

#: Kinds in the order in which spans at the same start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem", "jwt", "service", "url")
RULES = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{8,}+))"),
    "service": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}"),
    "url": re.compile(r"(?<![A-Za-z0-9+.-])[0-9+.-]*+(?P<from>[A-Za-z][A-Za-z0-9+.-]*+)://[^\s:/@]++:[^\s:/@]++@"),
}
ASSIGN_MIN, JWT_MIN = 6, 8
#: A text without one of these cannot match the rule.
_NEEDS = {"access": "AKIA", "pem": "-----BEGIN", "jwt": "eyJ", "url": "://"}
#: Made from the rules themselves: findings under any other rules do not count.
RULES_VERSION = hashlib.sha256(repr([(k, RULES[k].pattern, RULES[k].flags) for k in KINDS] + [ASSIGN_MIN, JWT_MIN]).encode()).hexdigest()[:16]

_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each JSON web token: a run from its first eyJ on, and two more runs. Each run is read from its start, once for each of its three places."""
    free = 0
    for m in RULES["jwt"].finditer(text):
        at = m[1].find("eyJ")
        if at >= 0 and len(m[1]) - at - 3 >= JWT_MIN and m.start(1) + at >= free:
            free = m.end(3)
            yield m.start(1) + at, free


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every finding, sorted; offsets are code points."""
    found = []
    for place, kind in enumerate(KINDS):
        if kind in _NEEDS and _NEEDS[kind] not in text:
            continue
        if kind == "jwt":
            found += [(start, place, end) for start, end in _tokens(text)]
            continue
        for m in RULES[kind].finditer(text):
            if kind != "assign" or len(m.group(2)) >= ASSIGN_MIN:
                found.append((m.start("from") if kind == "url" else m.start(), place, m.end()))
    return sorted(found)


def _digest(text: str) -> tuple[int, int, int, str, str]:
    spans = spans_of(text)
    counts = [sum(place == k for _, place, _ in spans) for k in range(3)]
    listed = [(place, f"{KINDS[place]}:{start}:{end}") for start, place, end in spans]
    base = ",".join(x for place, x in listed if place < 3)
    return *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in listed)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob, content -> blob and its findings."""
    ship(blobs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = pd.DataFrame([_digest(x) for x in pdf["content"]], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
                yield pd.concat([pdf[["blob"]].reset_index(drop=True), found], axis=1)

    return blobs.select("blob", "content").mapInPandas(run, f"blob string, {_FOUND}")


class BlobLedger:
    """The findings by blob and version of the rules, in a Parquet table below a folder that all executors share."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        """The ledger so far; None if nothing was written yet."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in (e.getCondition() or "") or "UNABLE_TO_INFER_SCHEMA" in (e.getCondition() or ""):
                return None
            raise

    def findings(self) -> DataFrame | None:
        """One row for each blob that was scanned by the present rules; scans at once or run twice may have added it more than once."""
        known = self.read()
        return None if known is None else known.where(F.col("rules_version") == RULES_VERSION).dropDuplicates(["blob"]).drop("rules_version")

    def scan(self, versions: DataFrame, path_col: str, content_col: str, version_col: str | None = None) -> DataFrame:
        """path, version (null without version_col), blob and findings of every row of versions, after scanning the blobs that the ledger lacks."""
        content = F.coalesce(F.col(content_col).cast("string"), F.lit(""))
        version = F.col(version_col) if version_col else F.lit(None).cast("string")
        named = versions.select(F.col(path_col).alias("path"), version.alias("version"), F.sha2(content, 256).alias("blob"), content.alias("content"))
        rows = checkpoint(named.drop("content"))
        unseen = named.select("blob", "content")
        if (known := self.findings()) is not None:
            unseen = unseen.join(known.select("blob"), "blob", "left_anti")
        distinct = unseen.groupBy("blob").agg(F.first("content").alias("content"))
        scan_blobs(distinct).withColumn("rules_version", F.lit(RULES_VERSION)).write.mode("append").parquet(self.path)
        found = self.findings().join(rows.groupBy("blob").agg(F.count("*").alias("n_paths")), "blob")
        return join_by_key(rows, checkpoint(found), ["blob"], "n_paths").drop("n_paths")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None) -> DataFrame:
    """doc_id and its findings, by a ledger at ledger_path or by a new one in the shared folder."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark, ledger_path or fresh_path(spark, "blob-ledger"))
    return ledger.scan(docs, id_col, text_col).select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
