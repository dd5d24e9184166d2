"""Merkle manifest of a dataset: hash trees by language, whose proofs spread by butterfly exchange.

Leaves lie in blocks, which are aligned runs of a power of the fanout. A block hashes its own
leaves. Then aligned groups of `fanout` blocks swap the roots that they have, round by round: in
round r a block gets from one block of each sibling subtree that subtree's root, and all blocks of
the group hash the same parent. So after the last round each block has the root and all of its
upper proof, and nothing has to be sent down the tree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzline.llm.common import materialize


@dataclass(frozen=True)
class Tree:
    """Nodes hashed into one, and the levels of a block (a block has fanout ** levels leaves)."""

    fanout: int = 2
    levels: int = 10

    @property
    def block(self) -> int:
        return self.fanout**self.levels


def digest(*fields: Column) -> Column:
    """SHA-256 in lowercase hex of `-` for a null, else the UTF-8 byte count, `:` and the value, of each field."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*(part(f.cast("string")) for f in fields)), 256)


def _div(a: Column, b: Column | int) -> Column:
    """Whole division of whole numbers."""
    return ((a - a % b) / b).cast("bigint")


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def positioned(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds idx, a node's place in its group by `order` from 0, and n, the group's size.

    One sort by ranges, in which a hot group fills many ranges; then only counts by group and range
    meet, at most one for each range of a group.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = materialize(nodes.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()))
    lined = lined.withColumn("range", F.shiftright("at", 33))
    counts = lined.groupBy(group, "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy(group).orderBy("range")
    offsets = counts.select(
        group, "range", "first", F.coalesce(F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy(group)).alias("n")
    )
    return lined.join(offsets, [group, "range"]).withColumn("idx", F.col("at") - F.col("first") + F.col("offset")).drop("at", "range", "first", "offset")


def block_roots(nodes: DataFrame, t: Tree) -> DataFrame:
    """grp, block, blocks (in the group), value: the root of each block of the nodes grp, idx, n, node.

    A group that lies in one block is hashed until one node remains, any other for the block's levels.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n, idx = table.column("n")[0].as_py(), table.column("idx")[0].as_py()
        row = table.column("node").to_pylist()
        for _ in range(t.levels):
            if n == 1:
                break
            row = [_hash(row[i : i + t.fanout]) for i in range(0, len(row), t.fanout)]
            n = -(-n // t.fanout)
        return pa.table({"grp": table.column("grp")[:1], "block": pa.array([idx // t.block]), "blocks": pa.array([-(-table.column("n")[0].as_py() // t.block)]), "value": pa.array(row)})

    keyed = nodes.select("grp", _div(F.col("idx"), t.block).alias("block"), "idx", "n", "node")
    return keyed.groupBy("grp", "block").applyInArrow(run, "grp string, block bigint, blocks bigint, value string")


def butterfly(roots: DataFrame, t: Tree) -> DataFrame:
    """grp, block, blocks, value (now the group's root), proof (the siblings above the block, level by level).

    Each round is one shuffle of `fanout` rows a block. Where the last subtree has fewer blocks than
    its siblings, its blocks serve them in turn.
    """
    state = materialize(roots.withColumn("proof", F.array().cast("array<string>")))
    most, step, rounds = state.agg(F.max("blocks")).first()[0] or 1, 1, 0
    while step < most:
        state = _swapped(state, step, t.fanout)
        step, rounds = step * t.fanout, rounds + 1
        if rounds % 6 == 0:
            state = materialize(state)
    return materialize(state)


def _swapped(state: DataFrame, step: int, fanout: int) -> DataFrame:
    """One round, in which nodes of `step` blocks become nodes of `fanout` times as many. Groups of one node wait."""
    c = F.col
    left = _div(c("blocks") + (step - 1), step)
    node = _div(c("block"), step)
    first = node - node % fanout
    last = F.least(first + fanout, left) - 1
    size = lambda s: F.least(F.lit(step), c("blocks") - s * step)
    offset = c("block") - node * step
    to = lambda s: F.when(offset < size(s), F.transform(F.sequence(offset, size(s) - 1, size(node)), lambda i: s * step + i)).otherwise(F.array().cast("array<bigint>"))
    targets = F.when(left == 1, F.array(c("block"))).otherwise(F.flatten(F.transform(F.sequence(first, last), to)))
    sent = state.select("grp", "block", "blocks", node.alias("node"), "value", "proof", F.explode(targets).alias("target"))
    met = sent.groupBy("grp", c("target").alias("block")).agg(
        F.first("blocks").alias("blocks"),
        F.sort_array(F.collect_list(F.struct("node", "value"))).alias("swap"),
        F.max(F.when(c("target") == c("block"), c("proof"))).alias("proof"),
    )
    values = lambda nodes: F.transform(nodes, lambda x: x["value"])
    siblings = values(F.filter("swap", lambda x: x["node"] != node))
    value = F.when(left == 1, c("swap")[0]["value"]).otherwise(F.sha2(F.array_join(values("swap"), ""), 256))
    return met.select("grp", "block", "blocks", value.alias("value"), F.concat("proof", siblings).alias("proof"))


def _path(t: Tree, idx: int, n: int, at: int, siblings: list[str], node: str) -> tuple[str, int]:
    """Folds a node up its tree of n leaves with the siblings from number `at` on; the root and the next number."""
    while n > 1:
        first = idx // t.fanout * t.fanout
        others = min(t.fanout, n - first) - 1
        run = siblings[at : at + others]
        run.insert(idx - first, node)
        node, at, idx, n = _hash(run), at + others, idx // t.fanout, -(-n // t.fanout)
    return node, at


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", tamper: Column | None = None, t: Tree | None = None, output: str = "digests") -> DataFrame:
    """A Merkle tree over the rows of `docs`: a subtree for each value of `group`, and a tree over their roots.

    Leaves are digests of `fields`. In a group they ascend by doc_id (null first, equal ones by
    leaf); while several nodes remain, every `fanout` of them become their hash, the last ones
    fewer, even one. Groups ascend by value, null first. Returns doc_id, leaf, subroot, root,
    proof_sha256 (of the siblings from the leaf to the root), folded_root (from the leaf as it is
    after tampering, with the siblings) and verified (whether that is the root); with output
    "proofs", the siblings as `proof` in place of their digest. `tamper` is a condition: rows where
    it holds get 1 more in n_chars before they are verified (null stays null).

    One row out for each row in. Rows that repeat are leaves of their own, side by side; null and
    empty texts differ; an empty table gives no rows. Columns that are not among the fields have no part.

    Texts are read once, for their digests. Leaves are sorted by ranges, so that a hot group spreads;
    no task holds more than a block of leaves. Upper levels exchange one row for each block and round.
    """
    t = t or Tree()
    c = F.col
    leaf = digest(*(c(f) for f in fields))
    changed = digest(*(F.try_add(c(f), F.lit(1)) if f == "n_chars" else c(f) for f in fields))
    tampered = F.coalesce(tamper, F.lit(False)) if tamper is not None else F.lit(False)
    leaves = docs.select(c("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.concat(F.lit("="), c(group).cast("string")), F.lit("")).alias("grp"), leaf.alias("node"), F.when(tampered, changed).alias("shown"))
    placed = materialize(positioned(materialize(leaves), "grp", ["doc_id", "node"]))
    state = butterfly(block_roots(placed, t), t)

    # the tree over the groups' roots goes the same way
    subroots = state.where("block = 0").select("grp", c("value").alias("node"), F.lit("").alias("all"))
    tops = materialize(positioned(subroots, "all", ["grp"]))
    over = butterfly(block_roots(tops.select(c("all").alias("grp"), "idx", "n", "node"), t), t).select(c("block").alias("top_block"), c("value").alias("root"), c("proof").alias("top_proof"))
    above = _inner_proofs(tops.select("grp", "idx", "n", "node"), over, t)
    known = state.join(above, "grp").select("grp", "block", c("value").alias("subroot"), "root", F.concat("proof", "above").alias("proof"), "top_idx", "top_n")

    proofs = output == "proofs"
    last = "proof" if proofs else "proof_sha256"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("idx")
        idx, n = left.column("idx").to_pylist(), left.column("n")[0].as_py()
        info = right.to_pylist()[0]
        below = _siblings(left.column("node").to_pylist(), n, t)
        shown = [b or a for a, b in zip(left.column("node").to_pylist(), left.column("shown").to_pylist(), strict=True)]
        out, folded = [], []
        for i, node, own in zip(idx, shown, below, strict=True):
            siblings = own + info["proof"]
            subroot, at = _path(t, i, n, 0, siblings, node)
            folded.append(_path(t, info["top_idx"], info["top_n"], at, siblings, subroot)[0])
            out.append(siblings if proofs else _hash(siblings))
        rows = left.num_rows
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "leaf": left.column("node"),
                "subroot": pa.array([info["subroot"]] * rows),
                "root": pa.array([info["root"]] * rows),
                last: pa.array(out, pa.list_(pa.string()) if proofs else pa.string()),
                "folded_root": pa.array(folded),
                "verified": pa.array([f == info["root"] for f in folded]),
            }
        )

    blocks = placed.withColumn("block", _div(c("idx"), t.block)).groupBy("grp", "block")
    kind = "array<string>" if proofs else "string"
    return blocks.cogroup(known.groupBy("grp", "block")).applyInArrow(run, f"doc_id bigint, leaf string, subroot string, root string, {last} {kind}, folded_root string, verified boolean")


def _siblings(row: list[str], n: int, t: Tree) -> list[list[str]]:
    """For each node of a block, its siblings level by level up to the block's root."""
    out: list[list[str]] = [[] for _ in row]
    width = 1
    for _ in range(t.levels):
        if n == 1:
            break
        for j, own in enumerate(out):
            i = j // width
            first = i // t.fanout * t.fanout
            own += [x for k, x in enumerate(row[first : first + t.fanout], first) if k != i]
        row = [_hash(row[i : i + t.fanout]) for i in range(0, len(row), t.fanout)]
        n, width = -(-n // t.fanout), width * t.fanout
    return out


def _inner_proofs(tops: DataFrame, over: DataFrame, t: Tree) -> DataFrame:
    """grp, top_idx, top_n, root, above: for each group's root, its siblings up to the root of all."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, info = left.sort_by("idx"), right.to_pylist()[0]
        below = _siblings(left.column("node").to_pylist(), left.column("n")[0].as_py(), t)
        return pa.table(
            {
                "grp": left.column("grp"),
                "top_idx": left.column("idx"),
                "top_n": left.column("n"),
                "root": pa.array([info["root"]] * left.num_rows),
                "above": pa.array([x + info["top_proof"] for x in below], pa.list_(pa.string())),
            }
        )

    blocks = tops.withColumn("top_block", _div(F.col("idx"), t.block)).groupBy("top_block")
    return blocks.cogroup(over.groupBy("top_block")).applyInArrow(run, "grp string, top_idx bigint, top_n bigint, root string, above array<string>")


def manifest_report(docs: DataFrame) -> DataFrame:
    """The manifest of documents, where rows are tampered with whose doc_id's crc32 is divisible by 7."""
    return manifest(docs, tamper=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
