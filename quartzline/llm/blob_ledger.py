"""Secret scans: an incremental ledger of scanned contents, in DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.llm.common import materialize

_FINDINGS = "array<struct<start:int,end:int,kind:string,rule:string>>"
#: Marks put around matches; they are replaced in the text beforehand, one for one.
OPEN, MIDDLE, CLOSE = "\ue000", "\ue001", "\ue002"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern in two parts, a prefix and the secret itself.

    A match counts if its value has `least` characters or more; others are dropped after matching,
    so that they still use up the text they cover.
    """

    kind: str
    prefix: str
    value: str
    least: int = 1
    version: int = 1


#: The rules in the order in which spans that start together are listed; fixed values.
#: Runs of a class that must have n characters are searched as such, which finds the same spans.
BASE_RULES = (
    Rule("assign", r"(?:(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?)", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", "", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", "", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"[Bb]earer\x20+", r"[A-Za-z0-9+/_.=-]{16,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:", r"[^\s/:@]{3,64}(?=@)"),
)
RULES = BASE_RULES + MORE_RULES


def spans_of(text: Column, rule: Rule) -> Column:
    """All spans of one rule in a text: array of struct(start, end) in code points, end exclusive.

    The matches are marked in place and the text is split at the marks; running sums of the
    lengths of the pieces give the places.
    """
    marked = F.regexp_replace(text, f"({rule.prefix})({rule.value})", f"{OPEN}$1{MIDDLE}$2{CLOSE}")
    pieces = F.transform(
        F.split(marked, OPEN),
        lambda piece: F.struct(
            F.when(F.instr(piece, CLOSE) > 0, F.length(piece) - 2).otherwise(F.length(piece)).alias("all"),
            (F.instr(piece, CLOSE) - 2).alias("match"),
            (F.instr(piece, CLOSE) - F.instr(piece, MIDDLE) - 1).alias("value"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    walked = F.aggregate(
        pieces,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + p["all"]).alias("at"),
            F.when(
                (p["match"] > 0) & (p["value"] >= rule.least),
                F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + p["match"]).alias("end")))),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
    )["found"]
    return F.when(text.rlike(f"{rule.prefix}(?:{rule.value})"), walked).otherwise(start["found"])


def rule_version(rule: Rule) -> str:
    """A name for a rule as it is; any change to it changes the name."""
    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of each blob by the rules whose versions are in its column `todo`.

    Returns blob, rules (the versions, from `todo`) and findings, an array of struct(start, end, kind, rule).
    Marks of our own in a text are replaced by a character that no rule matches, which moves nothing.
    """
    blobs = blobs.withColumn("text", F.translate(F.coalesce("text", F.lit("")), OPEN + MIDDLE + CLOSE, "�" * 3))

    def found(rule: Rule) -> Column:
        version = rule_version(rule)
        spans = F.transform(spans_of(F.col("text"), rule), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"), F.lit(version).alias("rule")))
        return F.when(F.array_contains("todo", version), spans).otherwise(F.array().cast(_FINDINGS))

    return blobs.select("blob", F.col("todo").alias("rules"), F.concat(*map(found, rules)).alias("findings"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scans the pairs of contents and rule versions that no earlier run has scanned.

    `docs` has one row for each path and version: doc_id (the path's key) and text. `ledger` has
    the rows of earlier runs: blob (SHA-256 of the text), rules (the versions of the rules it was scanned
    by), findings. Returns (paths, new): `paths` is doc_id and blob of each row of docs; `new` is the
    ledger's new rows, one for each distinct blob that lacks a rule, with the rules it lacked. Append
    them to the ledger. So a changed rule is run on all blobs, and no other rule with it.

    A null text is the empty blob. Of equal texts one is scanned: the smallest doc_id is found by
    an aggregation over keys alone, and only its text travels, once, dealt by doc_id; a hot blob
    therefore costs no more than another. Rows that repeat a doc_id are handled: they are dealt
    together, and each blob still is scanned once.
    """
    versions = F.array(*(F.lit(rule_version(r)) for r in rules))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    paths = texts.select("doc_id", "blob")
    owners = paths.groupBy("blob").agg(F.min("doc_id").alias("owner")).withColumn("todo", versions)
    if ledger is not None:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        left = F.array_except("todo", F.coalesce("seen", F.array().cast("array<string>")))
        owners = owners.join(seen, "blob", "left").select("blob", "owner", left.alias("todo")).where(F.size("todo") > 0)
    owned = owners.select("blob", "todo", F.coalesce("owner", F.lit(-(2**63))).alias("key")).hint("shuffle_hash")
    unseen = texts.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).join(owned, ["key", "blob"])
    return paths, scan_blobs(unseen, rules).dropDuplicates(["blob"])


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Joins findings back to all paths: doc_id, blob, findings (empty where there are none).

    `findings` is an array of struct(start, place, kind, end), sorted, where place is the rule's in the list;
    those of versions that are no longer in it are left out. Only blobs with findings are joined; a hot
    blob's paths are split by Spark's skew handling.
    """
    versions = F.array(*(F.lit(rule_version(r)) for r in rules))
    each = ledger.where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).withColumn("place", F.array_position(versions, F.col("f.rule")) - 1)
    listed = F.sort_array(F.collect_list(F.struct("f.start", F.col("place").cast("int").alias("place"), "f.kind", "f.end")))
    hits = each.where("place >= 0").groupBy("blob").agg(listed.alias("findings"))
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    return paths.join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", empty))


def secret_report(docs: DataFrame) -> DataFrame:
    """Digest per row of docs: counts of the base kinds, a hash of the base spans, and all spans.

    The ledger grows by two runs: the older half of the documents, by doc_id, is scanned by the base rules;
    then all of them by all rules, of which the older contents lack the further ones only. Null ids are
    of the second run; where all ids are null, all are.
    """
    middle = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), 0.5).alias("m")).first().m
    older = docs.where(F.col("doc_id").cast("bigint") <= F.lit(middle).cast("bigint"))
    ledger = materialize(update_ledger(older, None, BASE_RULES)[1])
    paths, new = update_ledger(docs, ledger, RULES)
    found = findings_by_path(paths, ledger.unionByName(materialize(new)))
    base = len(BASE_RULES)
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(rule.kind) for rule in BASE_RULES),
        F.sha2(F.encode(listed(F.filter("findings", lambda s: s["place"] < base)), "UTF-8"), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
        "blob",
    )
