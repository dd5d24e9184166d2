"""Document fingerprints: SpotSigs, chains of content words after common-word anchors."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzline.llm.common import RangeHash, frames, lean, lower, materialize, mix, text_slices, unpacker
from quartzline.llm.components import components
from quartzline.llm.minhash_dedup import set_name

#: Common words of four languages; fixed values.
COMMON = (
    "the of and to in is that it was for on are as with be by at this have from or an a he they which not but what all were when we there can"
    " de la le et les des un une du que qui dans pour pas sur plus par est avec il ne se ce au en"
    " der die und den von zu das mit sich dem ein eine auf als auch es an im nach wie ist nicht"
    " el los las y por con para del al lo su como no una se"
).split()
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


@dataclass(frozen=True)
class Spots:
    """Anchors and the number of content words in a chain."""

    anchors: tuple[str, ...] = tuple(sorted(set(COMMON)))
    chain: int = 2
    #: Two sets are near from this Jaccard on, numerator / denominator.
    numerator: int = 4
    denominator: int = 5
    #: Signatures are counted by so many of their bits, to tell the rare ones; a matter of speed, not of results.
    counted_bits: int = 18


_anchor_hashes: dict[tuple[str, ...], np.ndarray] = {}


def _hash_words(text: bytes) -> np.ndarray:
    data = lower(np.frombuffer(text, np.uint8))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return RangeHash(data)(edge[::2], edge[1::2])


def signatures(text: str | None, spots: Spots) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's spot signatures.

    A signature is an anchor and the next `chain` content words, common words skipped. A text
    without any takes every word and its successor as a signature, one with a single word that
    word, one with characters but no word the whole text. Empty or null: none.
    """
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return np.zeros(0, np.uint32)
    if spots.anchors not in _anchor_hashes:
        _anchor_hashes[spots.anchors] = np.sort(np.concatenate([_hash_words(a.encode()) for a in spots.anchors]))
    words = _hash_words(raw)
    known = _anchor_hashes[spots.anchors]
    common = known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words
    content = np.flatnonzero(~common)
    anchors = np.flatnonzero(common)
    first = np.searchsorted(content, anchors)
    anchors, first = anchors[first + spots.chain <= len(content)], first[first + spots.chain <= len(content)]
    if len(anchors):
        out = words[anchors] * np.uint64(3)
        for i in range(spots.chain):
            out = mix(out + words[content[first + i]])
    elif len(words) > 1:
        out = mix(mix(words[:-1]) + words[1:])
    elif len(words):
        out = mix(words)
    else:
        out = np.frombuffer(hashlib.sha256(raw).digest()[:8], np.uint64)
    return np.unique((out >> np.uint64(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two signature sets, 1 for two empty ones.

    The ratio of the lengths bounds it: pairs that cannot reach `least` count as 0 uncompared.
    """
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def to_string(found: np.ndarray) -> str:
    """A fingerprint as text: its signatures in ascending order, in base 64."""
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def fingerprints(docs: DataFrame, spots: Spots | None = None) -> DataFrame:
    """doc_id, n_signatures and fingerprint of each row; equal texts have equal fingerprints. No shuffle."""
    spots = spots or Spots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(t.as_py(), spots) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array([to_string(x) for x in found], pa.string())], ["doc_id", "n_signatures", "fingerprint"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_signatures int, fingerprint string")


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct fingerprints with a Jaccard of `threshold` or more: fingerprint_a, fingerprint_b, likeness.

    Equal fingerprints are one class: pairs are between classes, so copies are not multiplied; join
    back on `fingerprint` for membership. Sets are partitioned by length into ranges that grow by
    1 / threshold, so that a partner lies in the same range or the next. Inside, sets are compared
    only if they share one of the rarest signatures that a pair must share (the first
    |s| - ceil(threshold |s|) + 1 by frequency), and only if their lengths allow it.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                found = [from_string(f.as_py()).astype(np.int64) for f in some.column(0)]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(rows), some.column(1).take(rows), pa.array(np.concatenate(found))], ["fingerprint", "n", "signature"])

    sets = prints.where("n_signatures > 0").groupBy("fingerprint").agg(F.first("n_signatures").cast("int").alias("n"))
    listed = sets.mapInArrow(unpack, "fingerprint string, n int, signature bigint")
    frequency = listed.groupBy("signature").count()
    ranked = listed.join(frequency, "signature").groupBy("fingerprint", "n").agg(F.sort_array(F.collect_list(F.struct("count", "signature"))).alias("s"))
    length = F.floor(F.log("n") / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    prefix = F.slice("s.signature", 1, F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1)
    index = ranked.select("fingerprint", "n", length.alias("part"), F.explode(prefix).alias("signature"))
    shorter = index.select(F.col("fingerprint").alias("fingerprint_a"), F.col("n").alias("n_a"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "signature")
    longer = index.select(F.col("fingerprint").alias("fingerprint_b"), F.col("n").alias("n_b"), "part", "signature")
    fits = (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & ((F.col("n_a") < F.col("n_b")) | (F.col("fingerprint_a") < F.col("fingerprint_b")))
    pairs = shorter.join(longer, ["part", "signature"]).where(fits).select("fingerprint_a", "fingerprint_b").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [jaccard(from_string(x.as_py()), from_string(y.as_py()), threshold) for x, y in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["fingerprint_a", "fingerprint_b", "likeness"])

    return pairs.mapInArrow(compare, "fingerprint_a string, fingerprint_b string, likeness double").where(F.col("likeness") >= threshold)


def _named_sets(docs: DataFrame, spots: Spots) -> DataFrame:
    """doc_id, n, a 128-bit name of the signature set (set_a, set_b), its signatures as bytes and their `parity`, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part, _, _ in text_slices(batch):
                found = [signatures(t.as_py(), spots) for t in part.column(1)]
                names = [set_name(mix(f.astype(np.uint64))) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([a for a, _ in names], pa.int64()),
                        pa.array([b for _, b in names], pa.int64()),
                        pa.array([f.tobytes() for f in found], pa.binary()),
                        pa.array([parity(f) for f in found], pa.binary()),
                    ],
                    ["doc_id", "n", "set_a", "set_b", "signatures", "parity"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, set_a bigint, set_b bigint, signatures binary, parity binary")


def _ranks(sets: DataFrame, bits: int) -> np.ndarray:
    """The place of each of the 2**bits groups of signatures in the order of their frequency.

    Only one count for each group comes to the driver, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32) >> np.uint32(32 - bits)
            total += np.bincount(found, minlength=1 << bits)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["g", "c"])

    counts = np.zeros(1 << bits, np.float64)
    found = sets.select("signatures").mapInArrow(run, "g int, c bigint").groupBy("g").agg(F.sum("c").alias("c")).toArrow()
    counts[found.column("g").to_numpy()] = found.column("c").to_numpy()
    ranks = np.empty(1 << bits, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << bits, dtype=np.uint64)
    return ranks


def _prefixes(sets: DataFrame, ranks: np.ndarray, spots: Spots) -> DataFrame:
    """signature, row, set_a, n and left for the signatures of each set that a near set must share one of.

    Near sets share t of the larger one, so one of the first n - ceil(t n) + 1 of each, in any order
    that holds for all sets; here rare groups of signatures come first. `left` is the number of
    signatures from there on: from the first that two near sets share, both have at least as many
    left as they must share.
    """
    shift = np.uint32(32 - spots.counted_bits)
    t, d = spots.numerator, spots.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                taken, lengths, left = [], [], []
                for raw in some.column(3):
                    found = np.frombuffer(raw.as_buffer(), np.uint32)
                    n = len(found)
                    order = np.argsort(ranks[found >> shift] << np.uint64(32) | found)
                    first = found[order[: n - -(-t * n // d) + 1]]
                    taken.append(first)
                    lengths.append(len(first))
                    left.append(n - np.arange(len(first)))
                repeats = np.array(lengths, np.int64)
                columns = [np.repeat(some.column(i).to_numpy(zero_copy_only=False), repeats) for i in range(3)]
                columns[2] = columns[2].astype(np.int32)
                if len(taken):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(taken).view(np.int32)), *(pa.array(c) for c in columns), pa.array(np.concatenate(left).astype(np.int32))], ["signature", "row", "set_a", "n", "left"]
                    )

    return sets.select("row", "set_a", "n", "signatures").mapInArrow(run, "signature int, row bigint, set_a bigint, n int, left int")


def parity(found: np.ndarray) -> bytes:
    """256 bits of a set, each the parity of its signatures with that place.

    Two sets' bits differ in no more places than the sets differ in signatures.
    """
    odd = np.bincount(found & np.uint32(255), minlength=256) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _near(pairs: DataFrame, sets: DataFrame, spots: Spots) -> DataFrame:
    """Of pairs (a, b) of rows of `sets`, those with a Jaccard at the threshold or above.

    A pair whose parities differ in more places than near sets of these lengths can differ in
    signatures is dropped; the others' whole sets are compared.
    """
    t, d = spots.numerator, spots.denominator
    left = sets.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("y"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, 4) for i in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(apart * (t + d) <= n * (d - t)))

    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(prune, "a bigint, b bigint")
    pairs = materialize(pairs)
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    whole = materialize(sets.select("row", "signatures").join(asked, "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                u, v = (np.frombuffer(z.as_buffer(), np.uint32) for z in (x, y))
                shared = len(np.intersect1d(u, v, assume_unique=True))
                if shared * spots.denominator >= spots.numerator * (len(u) + len(v) - shared):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    left = whole.select(F.col("row").alias("a"), F.col("signatures").alias("x"))
    right = whole.select(F.col("row").alias("b"), F.col("signatures").alias("y"))
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))


def _classed(docs: DataFrame, spots: Spots) -> DataFrame:
    """doc_id, n, set_a, set_b and class_id of each row with signatures: see `near_classes`."""
    t, d = spots.numerator, spots.denominator
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = materialize(_named_sets(texts, spots).where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    classes = materialize(sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")))

    index = _prefixes(sets, _ranks(sets, spots.counted_bits), spots)
    # a signature that only copies of one text have pairs nothing
    several = index.groupBy("signature").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high")).where("low < high").select("signature")
    length = F.floor(F.log("n") / F.log(F.lit(d / t)) + 1e-9).cast("int")
    live = index.select("signature", "row", "n", "left").join(several, "signature").join(classes.select("row"), "row", "left_semi")
    live = materialize(live.withColumn("part", length).withColumn("c", F.count("*").over(Window.partitionBy("row"))))

    # all sets are compared with the one that has most company among those with their signature, in their range of lengths and the next
    pivots = live.groupBy("signature", "part").agg(F.min(F.struct(-F.col("c"), "row", "n", "left")).alias("p"))
    pivots = pivots.select("signature", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("p.row").alias("pivot"), F.col("p.n").alias("m"), F.col("p.left").alias("rest"))
    fits = (F.col("row") != F.col("pivot")) & (F.least("left", "rest") * (t + d) >= (F.col("n") + F.col("m")) * t)
    asked = live.select("signature", "part", "row", "n", "left").join(pivots, ["signature", "part"]).where(fits)
    tried = materialize(asked.select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b")).distinct())
    edges = _near(tried, sets, spots)

    # then each with those of other classes that it shares one of the rarest signatures with
    known = live.join(components(edges).withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("component", "row")).drop("component")
    mixed = known.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("signature")
    rest = materialize(known.join(mixed, "signature"))
    both = F.explode(F.array("part", F.col("part") + 1)).alias("part")
    small = rest.select("signature", both, F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("label").alias("label_a"))
    large = rest.select("signature", "part", F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), F.col("label").alias("label_b"))
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    enough = F.least("left_a", "left_b") * (t + d) >= (F.col("n_a") + F.col("n_b")) * t
    fits = order & (F.col("label_a") != F.col("label_b")) & enough
    pairs = small.join(large, ["signature", "part"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"))
    labels = components(edges.union(_near(pairs, sets, spots))).withColumnRenamed("node", "row")

    joined = classes.join(labels, "row", "left").select("set_a", "set_b", "doc_id", F.coalesce("component", "row").alias("label"))
    least = joined.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = joined.join(least, "label").select("set_a", "set_b", "class_id")
    return sets.select("doc_id", "n", "set_a", "set_b").join(named, ["set_a", "set_b"])


def near_classes(docs: DataFrame, spots: Spots | None = None) -> DataFrame:
    """doc_id and class_id of each row of docs (doc_id, text) whose text is not empty.

    Texts are linked if the Jaccard of their signature sets reaches the threshold; a class is what
    links join, and its id the smallest doc_id in it, null if it has none. Equal sets are one, so
    copies cost nothing further. Sets meet only by a signature that near sets must share, in ranges
    of lengths that grow by 1 / threshold; those that are already in one class are not paired again,
    so a large group of near copies is not multiplied out. No candidate is dropped.
    """
    return _classed(docs, spots or Spots()).select("doc_id", "class_id")


def successors_report(docs: DataFrame, spots: Spots | None = None) -> DataFrame:
    """Fingerprints of each text (null: empty) and of its edit, which ends like the next text begins.

    In ascending order of doc_id (nulls first, then a hash of the text), the last floor(n_chars / 4) code points
    of a text give way to the first as many, or all, of the next; the last document is followed by
    the first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_signatures and class_id, the smallest doc_id among the texts near it (`near_classes`),
    itself included; a text without signatures is near no other. One row out for each row in.

    Texts are dealt once, by ranges of doc_id taken from quantiles; the first document of a range
    goes to the range before it too, so each task finds the successor of its last one. Only the
    ranges' borders and first ids, one of each for a partition, come to the driver. Of classes only
    the rows that another one gives its id are dealt, and reach the task ahead of their texts.
    """
    spots = spots or Spots()
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    borders = texts.agg(F.percentile_approx(order, shares, 50 * parts).alias("q")).first().q
    borders = np.unique(np.array(borders or [], np.int64))

    def keys_of(ids: pa.Array) -> np.ndarray:
        return ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            keys = np.sort(keys_of(batch.column(0)))
            found, at = np.unique(np.searchsorted(borders, keys, "right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(keys[at])], ["part", "first"])

    firsts = {r.part: r.first for r in texts.select("doc_id").mapInArrow(first_keys, "part int, first bigint").groupBy("part").agg(F.min("first").alias("first")).collect()}
    filled = sorted(firsts)
    before = {firsts[p]: filled[i - 1] for i, p in enumerate(filled)}
    starts = np.array(sorted(before), np.int64)
    targets = np.array([before[s] for s in starts.tolist()], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for some, _, _ in text_slices(batch):
                keys = keys_of(some.column(0))
                at = np.minimum(np.searchsorted(starts, keys), len(starts) - 1)
                # a range's first document is a guest of the range before too, there only as a successor
                twice = np.flatnonzero(starts[at] == keys)
                part = np.concatenate([np.searchsorted(borders, keys, "right"), targets[at[twice]]]).astype(np.int32)
                guest = np.arange(len(part)) >= len(keys)
                rows = pa.array(np.concatenate([np.arange(len(keys)), twice]))
                columns = (some.column(0), frames(some.column(1)), some.column(2))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in columns), pa.array(guest), pa.array(part)], ["doc_id", "text", "h", "guest", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            part = np.searchsorted(borders, keys_of(batch.column(0)), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    none = F.lit(None).cast("bigint")
    dealt = texts.withColumn("h", F.xxhash64("text")).mapInArrow(deal, "doc_id bigint, text binary, h bigint, guest boolean, part int")
    dealt = dealt.select("*", none.alias("set_a"), none.alias("set_b"), none.alias("class_id"))
    classed = _classed(docs, spots).where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "set_a", "set_b", "class_id").distinct()
    classed = classed.mapInArrow(place, "doc_id bigint, set_a bigint, set_b bigint, class_id bigint, part int")
    classed = classed.select("doc_id", F.lit(None).cast("binary").alias("text"), none.alias("h"), F.lit(False).alias("guest"), "part", "set_a", "set_b", "class_id")
    # a range's guest follows all its own, also where it is the very first document; classes come before texts
    rows = dealt.unionByName(classed).repartitionById(max(parts, len(borders) + 1), "part")
    rows = rows.sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), F.col("text").isNotNull(), "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        unpack, held = unpacker(), None
        owner, given = None, {}
        for batch in batches:
            out, chars = [], 0
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "guest", "set_a", "set_b", "class_id")]
            for doc, guest, a, b, class_id, text in zip(*columns, batch.column(1), strict=True):
                if not text.is_valid:
                    if owner != (doc,):
                        owner, given = (doc,), {}
                    given[a, b] = class_id
                    continue
                if held is not None and held[2]:  # further rows of the guest's doc_id
                    continue
                text = unpack(text).decode()
                found = signatures(text, spots)
                near = given.get(set_name(mix(found.astype(np.uint64))), doc) if owner == (doc,) and len(found) else doc
                if held is not None:
                    out.append(edited(*held, text, found))
                    chars += len(held[1])
                held = (doc, text, guest, found, near)
                if len(out) == 1000 or chars >= 1 << 20:  # small batches: they are held twice more on their way out
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, chars = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def edited(doc, text, guest, found, near, next_text, next_found):
        n = len(text)
        cut = n // 4
        new = text[: n - cut] + next_text[:cut]
        found_new = found if new == text else signatures(new, spots)
        return {
            "doc_id": doc,
            "n_chars": n,
            "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
            "fingerprint": to_string(found),
            "edited_fingerprint": to_string(found_new),
            "near_edited": jaccard(found, found_new),
            "near_next": jaccard(found, next_found),
            "n_signatures": len(found),
            "class_id": near,
        }

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64()), ("class_id", pa.int64())])
    return rows.select("doc_id", "text", "guest", "set_a", "set_b", "class_id").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures bigint, class_id bigint"
    )
