"""MinHash near-dedup with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.llm.common import lean, materialize, mix, shingle_hashes, text_slices, word_hashes
from quartzline.llm.components import components


@dataclass(frozen=True)
class Settings:
    """Shingle length and threshold (a fraction, so that the test is exact), and the signature's shape.

    With 32 bands of 4 a pair at the threshold of 0.8 shares no band with a chance of 5e-8.
    `miss` is the chance at which a candidate's posterior probability of reaching the threshold
    prunes it, after each `batch` of signature places.
    """

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-6

    @property
    def places(self) -> int:
        return self.bands * self.rows


#: A set: a document that has it, its number, its name.
_PLACE = ("doc_id", "node", "set_a", "set_b")


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """For each number of compared places, the least matches at which a pair stays.

    The prior of the similarity is uniform, so the posterior is Beta(m + 1, n - m + 1), and the
    chance that it reaches t is that of at most m successes among n + 1 trials of chance t.
    """
    t = s.numerator / s.denominator
    out = []
    for n in range(s.batch, s.places + 1, s.batch):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= s.miss:
                break
        out.append((n, m))
    return out


def _coefficients(places: int) -> tuple[np.ndarray, np.ndarray]:
    a = (mix(np.arange(1, places + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (mix(np.arange(1001, places + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return a, b


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash of a set of hashes: for each place the least of a * x + b modulo 2**32, mixed."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        y = x[at : at + 512, None] * a[None, :] + b[None, :]
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        np.minimum(out, y.min(0), out=out)
    return out


def set_name(found: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set of hashes, as two signed integers."""
    return tuple(int(np.array(x.sum(dtype=np.uint64)).view(np.int64)) for x in (found, mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5))))


def shingle_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set (set_a, set_b) and its signature, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        a, b = _coefficients(s.places)
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                n, x, y, sig = [], [], [], []
                for found in shingle_hashes(*word_hashes(data, offsets), s.words):
                    n.append(len(found))
                    for column, half in zip((x, y), set_name(found), strict=True):
                        column.append(half)
                    sig.append(signature(found, a, b).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(sig, pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signature"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary")


def band_rows(sets: DataFrame, s: Settings) -> DataFrame:
    """One row for each set and band: node, bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mix(np.arange(1, s.rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(nodes):
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(nodes), s.bands, s.rows)
            buckets = mix((values.astype(np.uint64) * factors).sum(2, dtype=np.uint64) + np.arange(s.bands, dtype=np.uint64)[None, :])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(nodes, s.bands)), pa.array(buckets.ravel().view(np.int64))],
                ["node", "bucket"],
            )

    return sets.select("node", "signature").mapInArrow(run, "node bigint, bucket bigint")


def shingle_rows(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """node and shingles, the sorted 64-bit hashes as bytes, of the sets in `wanted` (doc_id, node, set_a, set_b).

    A set is rebuilt from the text of its doc_id, of several texts from the one that has it.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                sets = shingle_hashes(*word_hashes(data, offsets), s.words)
                names = zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True)
                right = [i for i, (x, name) in enumerate(zip(sets, names, strict=True)) if set_name(x) == name]
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())], ["node", "shingles"])

    texts = docs.join(wanted.hint("shuffle_hash"), "doc_id").select("node", "set_a", "set_b", "text")
    return materialize(texts.mapInArrow(build, "node bigint, shingles binary").dropDuplicates(["node"]))


def prefix_pairs(members: DataFrame, whole: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of members (node, label) of different labels that may reach the threshold t; none is missed.

    The shingles of each set are put in one order, the rarest among the members first. Sets that
    reach t share t/(1 + t) of the sum of their sizes, so at least 2t/(1 + t) of the smaller set
    and t of the larger; hence they share a shingle of the first n - ceil(2t/(1 + t) n) + 1 of the
    smaller and of the first n - ceil(t n) + 1 of the larger; and from the first that they share
    on, both have as many left as they must share. Shingles that no other member has
    come first and pair nothing: texts that share only a passage, or the rest of what they were
    edited from, mostly have enough of those to drop out. Order and equality go by 32 bits of
    the hash, of which clashes can only add pairs.
    """

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = (np.frombuffer(raw.as_buffer(), np.uint64) >> np.uint64(16)).astype(np.uint32).view(np.int32)
                for at in range(0, len(found), 1 << 16):
                    piece = found[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), node, np.int64)), pa.array(piece)], ["node", "h"])

    rows = whole.select("node", "shingles").mapInArrow(shorten, "node bigint, h int")
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    held = rows.join(common, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("held"))
    sizes = whole.select("node", (F.length("shingles") / 8).cast("bigint").alias("n"))
    known = held.join(sizes, "node").join(members, "node")
    t, d = s.numerator, s.denominator
    # what is left of both prefixes after the shingles that no other member has
    own = F.expr(f"n - (2 * {t} * n + {t + d - 1}) div {t + d} + 1 - (n - size(held))")
    asked = F.expr(f"cast(greatest(n - ({t} * n + {d - 1}) div {d} + 1 - (n - size(held)), 0) as int)")
    first = known.select("node", "label", "n", own.alias("own"), F.size("held").alias("m"), F.posexplode(F.slice("held", F.lit(1), asked)).alias("pos", "x"))
    first = materialize(first.select("node", "label", "n", F.col("x.h").alias("h"), (F.col("pos") < F.col("own")).alias("own"), (F.col("m") - F.col("pos")).alias("left")))
    # only shingles that members of several labels have can pair any
    several = first.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
    first = first.join(several, "h")
    small = first.where("own").select("h", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
    large = first.select("h", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    enough = F.least("left_a", "left_b") * (t + d) >= (F.col("n_a") + F.col("n_b")) * t
    fits = order & (F.col("label_a") != F.col("label_b")) & (F.col("n_a") * d >= F.col("n_b") * t) & enough
    return small.join(large, "h").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, s: Settings, whole: DataFrame | None = None) -> DataFrame:
    """Of candidate pairs (a, b), those that reach the threshold.

    Signatures are compared batch by batch, and a pair is dropped as soon as its posterior chance
    of reaching the threshold falls below `miss`. The survivors' whole shingle sets, rebuilt from
    their texts if not given, are compared exactly.
    """
    limits = least_matches(s)
    sizes = nodes.select("node", "n_shingles", "signature")
    left = sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
    right = sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
    fits = F.least("n_a", "n_b") * s.denominator >= F.greatest("n_a", "n_b") * s.numerator
    compared = pairs.join(left, "a").join(right, "b").where(fits).select("a", "b", "s_a", "s_b")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, s.places) for c in (2, 3))
            stay, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in limits:
                matches[stay] += (x[stay, done:n] == y[stay, done:n]).sum(1)
                stay, done = stay[matches[stay] >= least], n
            yield batch.select([0, 1]).take(pa.array(stay))

    survivors = materialize(compared.mapInArrow(prune, "a bigint, b bigint"))
    if whole is None:
        asked = survivors.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        whole = shingle_rows(docs, nodes.join(asked, "node").select(*_PLACE), s)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                shared = len(np.intersect1d(u, v, assume_unique=True))
                if shared * s.denominator >= s.numerator * (len(u) + len(v) - shared):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    left = whole.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = whole.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return materialize(survivors.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(exact, "a bigint, b bigint"))


def near_components(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Words are runs of non-separators, A-Z lower-cased; a text with fewer words than a shingle is one
    shingle; null texts and texts without words have none and are linked with nothing. Rows with a
    null doc_id stay, unlinked, with a null component, and are kept. Rows that repeat a doc_id share
    its component, and so do all texts near any of theirs.

    Equal sets are one node, found by aggregation, so copies cost nothing further. The other links come from buckets of equal bands. Inside a bucket no pairs are
    emitted at large: all members are first compared with a pivot, the member with most company in
    all its buckets, which is the original of many near copies. Members of buckets that still hold different
    components are paired between components, where they share one of their rarest shingles
    (`prefix_pairs`): texts that merely share a passage have none of these in common. So every
    bucket is treated in full, without a cap, and loses no link it could give.
    """
    s = settings or Settings(words=4)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = materialize(shingle_sets(texts, s))
    named = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()))
    nodes = materialize(named.join(classes, ["doc_id", "set_a", "set_b"]).select(*_PLACE, "n_shingles", "signature").dropDuplicates(["node"]))

    bands = band_rows(nodes, s)
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(bands.join(sizes, "bucket"))
    # a text that others were copied from shares more and fuller buckets than its copies do
    central = members.groupBy("node").agg(F.sum("n").alias("c"))
    pivots = members.join(central, "node").groupBy("bucket").agg(F.min(F.struct(-F.col("c"), "node"))["node"].alias("pivot"))
    pairs = members.join(pivots, "bucket").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).where("a < b").distinct()
    tried = materialize(pairs)
    edges = verified(tried, nodes, texts, s)

    rest = materialize(_unsettled(members.select("node", "bucket"), components(edges)))
    whole = shingle_rows(texts, nodes.join(rest, "node").select(*_PLACE), s)
    pairs = materialize(prefix_pairs(rest, whole, s).join(tried, ["a", "b"], "left_anti"))
    edges = edges.union(verified(pairs, nodes, texts, s, whole)).union(materialize(_same_document(named, classes)))
    labels = components(edges)

    joined = classes.join(labels, "node", "left").select("set_a", "set_b", "doc_id", F.coalesce("component", "node").alias("label"))
    least = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    # written, so that what the caller does next is not planned together with all of this, again after each exchange
    joined = materialize(joined.join(least, "label").select("set_a", "set_b", "component_id"))
    known = sets.join(joined, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component_id"))
    # a text without shingles is linked with nothing, not even with another of its doc_id
    return known.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _same_document(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the sets of rows that share a doc_id."""
    several = named.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("low"), F.max(F.struct("set_a", "set_b")).alias("high")).where("low <> high").select("doc_id")
    held = named.join(several, "doc_id").select("doc_id", "set_a", "set_b").distinct().join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select("doc_id", "node")
    hubs = held.groupBy("doc_id").agg(F.min("node").alias("b"))
    return held.join(hubs, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node and label (its component) of those members of buckets that lie in more than one component."""
    known = members.join(labels, "node", "left").select("node", "bucket", F.coalesce("component", "node").alias("label"))
    spans = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return known.join(spans, "bucket", "left_semi").select("node", "label").distinct()
