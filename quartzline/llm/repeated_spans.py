"""Suffix-array dedup: repeated byte spans, found by difference-cover suffix sorting of block strings.

A suffix array over every byte would hold as many rows as the corpus has bytes. So each text is
first rewritten as a string of overlapping blocks, content-defined, of which only those that occur
twice or more can be part of a repeat. On these strings the difference-cover algorithm runs: the
triples at positions 1 and 2 modulo 3 are sorted and named, the names are used again as symbols,
the remaining suffixes are merged by one symbol and a name, and suffixes with equal prefixes side
by side give repeated spans. What lies at their ends, where less than a block is shared, is
compared window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzline.llm.common import RangeHash, materialize, mix, packed, text_slices, unpacker

_GRAM = 16
_PIECE = 1 << 22


@dataclass(frozen=True)
class Spans:
    """Length of a repeat in bytes, and how many window starts share a block."""

    length: int = 400
    stride: int = 96

    @property
    def core(self) -> int:
        return self.length - self.stride + 1


# A text by its hash and its size in bytes, and a row of it.
_TEXT = ["text_hash", "text_size"]
_KEY = ["key", *_TEXT]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("key"),
        F.xxhash64(text).alias("text_hash"),
        F.octet_length(text).alias("text_size"),
        text.alias("text"),
    )


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of `length` bytes: the place of its gram with the least hash, the first of equals.

    It depends on the window's bytes alone, so equal windows have it in the same place.
    """
    width = length - _GRAM + 1
    raw = data.tobytes()
    n = len(raw) - _GRAM + 1
    low = np.ndarray((n,), "<u8", raw, strides=(1,))
    high = np.ndarray((n,), "<u8", raw[8:], strides=(1,))
    hashed = mix(low * np.uint64(0x9E3779B97F4A7C15) + mix(high + np.uint64(1)))
    packed = (hashed & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = packed
    table = padded.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(raw) - length + 1
    return (np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def _blocks(data: np.ndarray, s: Spans) -> tuple[np.ndarray, ...]:
    """The blocks of a text or piece: core hash, context hash, first window start, number of starts, core's start.

    Windows with the same anchor whose starts lie in the same `stride` before it form a block. All
    of them contain its core; together they cover its context.
    """
    anchor = _anchors(data, s.length)
    starts = np.arange(len(anchor))
    group = (anchor - starts) // s.stride
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(anchor)))
    at = anchor[first] - group[first] * s.stride
    hashed = RangeHash(data)
    core = mix(hashed(at, at + s.core) + group[first].astype(np.uint64))
    place = ((at - first) * s.length + count).astype(np.uint64)
    context = mix(mix(hashed(first, first + count - 1 + s.length) ^ np.uint64(0x5851F42D4C957F2D)) + place)
    return core, context, first, count, at


def block_rows(texts: DataFrame, s: Spans) -> DataFrame:
    """One row for each block of each text: core, context, key, text_hash, text_size, start, starts, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                columns: list[list[np.ndarray]] = [[] for _ in names]
                keys, hashes, sizes = (part.column(c).to_numpy(zero_copy_only=False) for c in _KEY)
                for i in range(part.num_rows):
                    # long texts in overlapping pieces; a window lies in exactly one
                    for begin in range(int(offsets[i]), int(offsets[i + 1]) - s.length + 1, _PIECE):
                        piece = data[begin : min(begin + _PIECE + s.length - 1, int(offsets[i + 1]))]
                        core, context, first, count, at = _blocks(piece, s)
                        shift = begin - int(offsets[i])
                        for column, x in zip(columns, (core.view(np.int64), context.view(np.int64), np.full(len(core), keys[i]), np.full(len(core), hashes[i]), np.full(len(core), sizes[i]), first + shift, count, at + shift), strict=True):
                            column.append(x)
                arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), kind) for c, kind in zip(columns, [pa.int64()] * 4 + [pa.int32()] * 4, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["core", "context", *_KEY, "start", "starts", "at"]
    return texts.select(*_KEY, "text").mapInArrow(run, "core bigint, context bigint, key bigint, text_hash bigint, text_size int, start int, starts int, at int")


def sorted_names(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Names the distinct values of `columns` by their place in a distributed sort and joins the names on."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.select(*columns).distinct().repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    named = materialize(distinct.withColumn(name, F.monotonically_increasing_id() + 1))
    return rows.join(named, columns)


def difference_cover_spans(hits: DataFrame, s: Spans) -> DataFrame:
    """Spans of texts that occur again: key, text_hash, text_size, begin, end (bytes, end exclusive).

    `hits` are the blocks that occur twice or more. The symbol of a block is its core and the
    distance to the next block's core, if they overlap; equal symbols in a row then mean equal bytes
    from the first core's start to the last core's end. Texts that are equal count as one, twice:
    all their bytes are repeated.
    """
    copies = hits.select(*_KEY).distinct().groupBy(*_TEXT).agg(F.count("*").alias("n"))
    line = Window.partitionBy(*_TEXT).orderBy("start", "at")
    one = hits.groupBy(*_TEXT, "start").agg(F.first("at").alias("at"), F.first("core").alias("core"))
    gap = F.lead("at").over(line) - F.col("at")
    string = one.select(*_TEXT, "start", "at", "core", (F.row_number().over(line) - 1).alias("i"), F.when(gap.between(1, s.core), gap).otherwise(0).alias("gap"))
    string = materialize(sorted_names(string, ["core", "gap"], "symbol"))
    place = Window.partitionBy(*_TEXT).orderBy("i")
    ahead = lambda c, k: F.coalesce(F.lead(c, k).over(place), F.lit(0))

    # sample: positions 1 and 2 modulo 3; names of their triples, and names of triples of those names
    triples = string.select("*", *(ahead("symbol", k).alias(f"t{k}") for k in range(3)), *(ahead("gap", k).alias(f"g{k}") for k in range(9)))
    sample = triples.where("i % 3 <> 0 AND t1 > 0 AND t2 > 0 AND g0 > 0 AND g1 > 0")
    named = sorted_names(sample.select(*_TEXT, "i", "t0", "t1", "t2"), ["t0", "t1", "t2"], "name").select(*_TEXT, "i", "name")
    ranked = materialize(triples.join(named, [*_TEXT, "i"], "left"))
    again = ranked.select("*", ahead("name", 1).alias("n1"), ahead("name", 2).alias("n2"), ahead("name", 3).alias("n3"), ahead("name", 6).alias("n6"))

    # prefixes that stand side by side in the sorted order: names themselves within the sample; one
    # symbol and a name for positions 0 against 1; two symbols and a name for 0 against 2
    def prefix(kind: int, words: int, columns: list, when: Column) -> DataFrame:
        end = F.col("at") + sum((F.col(f"g{k}") for k in range(words - 1)), F.lit(0)) + s.core
        whole = when
        for k in range(words - 1):
            whole = whole & (F.col(f"g{k}") > 0)
        cells = [F.coalesce(c.cast("bigint"), F.lit(0)) for c in columns]
        cells += [F.lit(0).cast("bigint")] * (3 - len(cells))
        return again.where(whole).select(*_TEXT, F.lit(kind).alias("kind"), *(c.alias(f"k{j}") for j, c in enumerate(cells)), F.col("at").alias("begin"), end.alias("end"))

    c = F.col
    prefixes = (
        prefix(0, 3, [c("name")], (c("i") % 3 != 0) & c("name").isNotNull())
        .union(prefix(1, 9, [c("name"), c("n3"), c("n6")], (c("i") % 3 != 0) & c("name").isNotNull() & (c("n3") > 0) & (c("n6") > 0)))
        .union(prefix(2, 4, [c("symbol"), c("n1")], (c("i") % 3 <= 1) & (c("n1") > 0)))
        .union(prefix(3, 5, [c("symbol"), c("t1"), c("n2")], (c("i") % 3 != 1) & (c("n2") > 0)))
    )
    prefixes = materialize(prefixes.where(c("end") - c("begin") >= s.length))
    keys = ["kind", "k0", "k1", "k2"]
    repeated = prefixes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = prefixes.join(repeated, keys, "left_semi").groupBy(*_TEXT, "begin").agg(F.max("end").alias("end"))
    # a copied text is repeated as a whole
    owners = hits.select(*_KEY).distinct()
    whole = owners.join(copies.where("n > 1").select(*_TEXT), _TEXT).select(*_KEY, F.lit(0).alias("begin"), F.lit(2**31 - 1).alias("end"))
    return owners.join(shared, _TEXT).select(*_KEY, "begin", "end").union(whole)


def _uncovered(hits: DataFrame, spans: DataFrame, s: Spans) -> DataFrame:
    """The blocks with a window start that no single span covers."""
    events = spans.select(*_KEY, F.col("begin").alias("x"), F.lit(0).alias("kind"), "end", *(F.lit(None).cast(t).alias(n) for n, t in (("core", "bigint"), ("context", "bigint"), ("start", "int"), ("starts", "int"), ("at", "int"))))
    asked = hits.select(*_KEY, F.col("start").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("end"), "core", "context", "start", "starts", "at")
    reach = F.max("end").over(Window.partitionBy(*_KEY).orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0))
    covered = events.union(asked).withColumn("reach", reach).where("kind = 1")
    # 64-bit sum: a span of a whole text ends at the largest int
    return covered.where(F.col("reach").isNull() | (F.col("reach").cast("bigint") < F.col("start").cast("bigint") + F.col("starts") - 1 + s.length)).drop("x", "kind", "end", "reach")


def window_matches(texts: DataFrame, hits: DataFrame, rest: DataFrame, s: Spans) -> DataFrame:
    """The exact comparison at the ends: spans of the blocks in `rest` whose windows occur again.

    Only blocks whose core a block of `rest` has are compared, each distinct context once, by the
    hash of every window. A context that occurs twice is repeated throughout.
    """
    # equal contexts become one before their cores meet, so that a core of many copies is not one task's
    contexts = hits.groupBy("core", "context").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "start", "starts", "at")).alias("first"))
    contexts = materialize(contexts.select("core", "context", "n", "first.*").join(rest.select("core").distinct(), "core", "left_semi"))
    several = contexts.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core")
    wanted = contexts.join(several, "core", "left_semi").groupBy(*_KEY).agg(F.collect_list(F.struct("core", "context", "start", "starts", "at")).alias("blocks"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = unpacker()
        for batch in batches:
            for text, blocks in zip(batch.column(0), batch.column(1), strict=True):
                found = blocks.values.flatten()
                core, context, start, starts, at = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found)
                order = np.argsort(start, kind="stable")
                data = np.frombuffer(unpack(text), np.uint8)
                for a in range(0, len(order), 4096):
                    o = order[a : a + 4096]
                    base = int(start[o].min())
                    hashed = RangeHash(data[base : int((start[o] + starts[o]).max()) - 1 + s.length])
                    begins = np.concatenate([np.arange(x, x + y) for x, y in zip(start[o], starts[o], strict=True)])
                    owner = np.repeat(o, starts[o])
                    windows = hashed(begins - base, begins - base + s.length) + (at[owner] - begins).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core[owner]), pa.array(context[owner]), pa.array((begins - start[owner]).astype(np.int32)), pa.array(mix(windows).view(np.int64))],
                        ["core", "context", "shift", "window"],
                    )

    each = packed(texts.select(*_KEY, "text")).join(wanted.hint("shuffle_hash"), _KEY).select("text", "blocks").mapInArrow(windows, "core bigint, context bigint, shift int, window bigint")
    each = materialize(each)
    # rows that repeat a text make the same windows twice: only different places count
    place = F.struct("context", "shift")
    # windows are compared within a core only: two hashes have to clash for a byte to go wrongly
    twice = each.groupBy("core", "window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("core", "window")
    partial = each.join(twice, ["core", "window"], "left_semi").groupBy("core", "context").agg(F.collect_set("shift").alias("shifts"))
    single = rest.join(contexts.where("n = 1").select("core", "context"), ["core", "context"], "left_semi").join(partial, ["core", "context"])
    single = single.select(*_KEY, F.explode("shifts").alias("shift"), "start").select(*_KEY, (F.col("start") + F.col("shift")).alias("begin"), (F.col("start") + F.col("shift") + s.length).alias("end"))
    multiple = rest.join(contexts.where("n > 1").select("core", "context"), ["core", "context"], "left_semi")
    return single.union(multiple.select(*_KEY, F.col("start").alias("begin"), (F.col("start") + F.col("starts") - 1 + s.length).alias("end")))


def repeated_spans(texts: DataFrame, s: Spans) -> DataFrame:
    """All spans of keyed texts that lie in a repeat: key, text_hash, text_size, begin, end."""
    blocks = block_rows(texts, s)
    twice = blocks.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    hits = materialize(blocks.join(twice, "core", "left_semi"))
    spans = materialize(difference_cover_spans(hits, s))
    rest = materialize(_uncovered(hits, spans, s))
    return spans.union(window_matches(texts, hits, rest, s))


def remove_repeats(docs: DataFrame, spans: Spans | None = None, output: str = "digests") -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts anywhere else.

    Texts are UTF-8 bytes (null: empty); matches never cross documents, and are judged on the
    input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256, or
    with output "bytes" the remaining bytes as `kept`, and removed_share (of the bytes; 0 of none). One row out for each row in; a text that
    occurs twice, in rows that repeat a doc_id too, loses all its bytes if it has `length` of them.
    """
    s = spans or Spans()
    texts = _keyed(docs)
    # rows that repeat doc_id and text are one key; they repeat each other as a whole
    doubles = texts.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").select(*_KEY, F.lit(0).alias("begin"), F.lit(2**31 - 1).alias("end"))
    found = repeated_spans(texts, s).union(doubles).groupBy(*_KEY).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = packed(texts).join(found.hint("shuffle_hash"), _KEY, "left").select("doc_id", "text", "spans")
    bytes_out = output == "bytes"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = unpacker()
        for batch in batches:
            size, removed, runs, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(unpack(text), np.uint8)
                n, gone = len(data), np.zeros(0, bool)
                count = 0
                if spans.is_valid and n >= s.length:
                    begin, end = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.values.flatten())
                    depth = np.zeros(n + 1, np.int32)
                    np.add.at(depth, np.minimum(begin, n), 1)
                    np.add.at(depth, np.minimum(end, n), -1)
                    gone = np.cumsum(depth[:n]) > 0
                    count = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    data = data[~gone]
                size.append(n)
                removed.append(int(gone.sum()))
                runs.append(count)
                kept.append(data.tobytes() if bytes_out else hashlib.sha256(data.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary() if bytes_out else pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", last],
            )

    last = "kept" if bytes_out else "kept_sha256"
    cleaned = joined.mapInArrow(run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'binary' if bytes_out else 'string'}")
    return cleaned.withColumn("removed_share", F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0))
