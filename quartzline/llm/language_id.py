"""Language identification with string kernels, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzline.llm.common import lean, text_slices

UNKNOWN = "und"
#: A known language takes so much less than 99 % of its labelled rows have.
SLACK = 0.3
_BUCKETS_LOG2 = 14
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
    return _LETTER


def spectrum(text: str | None, orders: int = 3) -> np.ndarray | None:
    """The blended spectrum of a text: which hashed letter n-grams, n = 1 to `orders`, it holds.

    Case is folded; each run of other characters is one word break. None if there is no letter.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[np.minimum(codes, (1 << 16) - 1)]
    for c in np.unique(codes[codes >= 1 << 16]).tolist():
        letter[codes == c] = chr(c).isalpha()
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    codes = np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)])).astype(np.uint64)
    present = np.zeros(1 << _BUCKETS_LOG2, bool)
    gram = np.zeros(len(codes), np.uint64)
    shift = np.uint64(64 - _BUCKETS_LOG2)
    for n in range(1, orders + 1):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        present[((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift] = True
    return present


@dataclass(frozen=True)
class LanguageModel:
    """Landmarks as packed spectra, and for each language the weight of each landmark's kernel.

    `seen` has the n-grams of each language's landmarks, packed; `least` the share of a text's
    n-grams among those of some language that it takes to be of a known one, by predicted language.
    Its size is bounded: (landmarks + languages) x 2 KB and landmarks x languages x 4 bytes.
    """

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    orders: int
    seen: np.ndarray
    least: np.ndarray


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).astype(np.float32)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalized presence kernel: shared n-grams over the geometric mean of both counts."""
    return (a @ b.T) / np.sqrt(np.maximum(a.sum(1), 1))[:, None] / np.sqrt(np.maximum(b.sum(1), 1))[None, :]


def shares(rows: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The share of each row's n-grams that each language's landmarks have."""
    return (rows @ seen.T) / np.maximum(rows.sum(1), 1)[:, None]


def train(packed: np.ndarray, languages: list[str], n_landmarks: int = 128, ridge: float = 0.1, orders: int = 3) -> LanguageModel:
    """Kernel ridge regression in the space of the landmarks, one target of +1 / -1 a language.

    Landmarks are taken in turn from each language, in the order of the rows, so that rare ones have some.
    The least share of known n-grams of a language is SLACK below what 99 % of its rows have, where a
    landmark is held against the language's others. So a language with few rows asks for little, and one
    with a single row for nothing.
    """
    names = tuple(sorted(set(languages)))
    seen = dict.fromkeys(names, 0)
    turn = []
    for i, name in enumerate(languages):
        turn.append((seen[name], name, i))
        seen[name] += 1
    taken = [i for *_, i in sorted(turn)[:n_landmarks]]
    chosen = packed[taken]
    rows, marks = unpacked(packed), unpacked(chosen)
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    features = kernel(rows, marks) @ root
    mean = features.mean(0)
    targets = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    centred = features - mean
    beta = np.linalg.solve(centred.T @ centred + ridge * np.eye(len(marks)), centred.T @ (targets - targets.mean(0)))
    of = np.array(languages)
    seen = np.stack([np.bitwise_or.reduce(chosen[of[taken] == name], axis=0, initial=0) for name in names])
    bits = unpacked(seen)
    known = shares(rows, bits)
    for place, i in enumerate(taken):
        own = names.index(languages[i])
        fellows = np.bitwise_or.reduce(chosen[(of[taken] == languages[i]) & (np.arange(len(taken)) != place)], axis=0, initial=0)
        known[i, own] = (marks[place] @ unpacked(np.broadcast_to(fellows, (1, packed.shape[1])).astype(np.uint8))[0]) / max(marks[place].sum(), 1)
    least = np.array([np.quantile(known[of == name].max(1), 0.01) - SLACK for name in names])
    return LanguageModel(names, chosen, (root @ beta).astype(np.float32), (targets.mean(0) - mean @ beta).astype(np.float32), orders, seen, least)


def fit(docs: DataFrame, *, rows_per_language: int = 400, max_rows: int = 4000, n_landmarks: int = 128, orders: int = 3) -> LanguageModel | None:
    """Fits on a bounded sample: `rows_per_language` labelled rows of each language, `max_rows` in all.

    `docs` has doc_id, text and lang. The rows of a language with the smallest hashes of doc_id are
    taken (equal ones by a hash of the text); only ids are ranked, with the limit applied before the
    shuffle. Spectra of whole texts are made on the executors and come to the driver as 2 KB each.
    Rows without lang or letters teach nothing and take no place; None without any row to learn from.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    named = docs.where(lang.isNotNull() & text.rlike(r"\p{L}")).select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("hash"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "hash")
    ranked = named.select("doc_id", "lang", "hash").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows_per_language)
    ids = ranked.orderBy("rank", "lang").limit(max_rows).select(F.col("doc_id").alias("d"), F.col("lang").alias("l"), F.col("hash").alias("h"), "rank")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, rank, s) for lang, rank, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "rank", "text")), strict=True) if (s := spectrum(text, orders)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([np.packbits(x[2]).tobytes() for x in found], pa.binary())],
                ["lang", "rank", "bits"],
            )

    sample = named.join(F.broadcast(ids), F.expr("doc_id <=> d AND lang = l AND hash = h")).select("lang", "rank", "text")
    # rows that repeat are joined with each of their ranks: one stays
    rows = sample.mapInArrow(encode, "lang string, rank int, bits binary").groupBy("lang", "rank").agg(F.min("bits").alias("bits")).collect()
    rows = sorted(rows, key=lambda r: (r.rank, r.lang))
    if not rows:
        return None
    return train(np.stack([np.frombuffer(r.bits, np.uint8) for r in rows]), [r.lang for r in rows], n_landmarks, orders=orders)


class Judge:
    """A model made ready to score batches of texts, by two matrix products each."""

    def __init__(self, model: LanguageModel | None):
        self.model = model
        if model is not None:
            self.marks = unpacked(model.landmarks)
            self.norms = np.sqrt(np.maximum(self.marks.sum(1), 1))
            self.seen = unpacked(model.seen)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score, and whether the text is of a known language at all."""
        names, scores, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        model = self.model
        if model is None:
            return names, scores, known
        spectra = {i: s for i, text in enumerate(texts) if (s := spectrum(text, model.orders)) is not None}
        if spectra:
            a = np.stack(list(spectra.values())).astype(np.float32)
            k = (a @ self.marks.T) / np.sqrt(a.sum(1))[:, None] / self.norms[None, :]
            f = k @ model.weights + model.bias
            best = f.argmax(1)
            enough = shares(a, self.seen).max(1) >= model.least[best]
            for i, b, s, e in zip(spectra, best, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1), enough, strict=True):
                names[i], scores[i], known[i] = model.languages[b], float(s), bool(e)
        return names, scores, known


def _judged(batch: pa.RecordBatch, judge: Judge, batch_rows: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[float], list[bool]]]:
    """Runs of rows with about a megabyte of text, `batch_rows` at most, and their predictions."""
    for part, *_ in text_slices(batch):
        for at in range(0, part.num_rows, batch_rows):
            rows = part.slice(at, batch_rows)
            yield rows, *judge(rows.column("text").to_pylist())


def identify(docs: DataFrame, model: LanguageModel | None, batch_rows: int = 256) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each whole text; one row out for each row in.

    `und` with score 0 if the text is null or has no letters, or if there is no model. Of equal
    scores the first language by name wins. One pass without a shuffle; a task holds `batch_rows`
    spectra at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        judge = Judge(model)
        for batch in batches:
            for rows, names, scores, _ in _judged(batch, judge, batch_rows):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, batch_rows: int = 256) -> DataFrame:
    """The rows of docs whose text is of a known language, with `lang` filled in where it is null.

    One pass over whole rows without a shuffle. Other columns stay as they are.
    """
    whole = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in ("text", "lang") else F.col(f"`{c}`") for c in docs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        judge = Judge(model)
        for batch in batches:
            for rows, names, _, known in _judged(batch, judge, batch_rows):
                at = rows.schema.get_field_index("lang")
                filled = pc.coalesce(rows.column(at), pa.array(names, rows.column(at).type))
                columns = [filled if i == at else c for i, c in enumerate(rows.columns)]
                yield pa.RecordBatch.from_arrays(columns, rows.schema.names).filter(pa.array(known, pa.bool_()))

    return whole.mapInArrow(run, whole.schema)


def language_report(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out (crc32 of doc_id, modulo 4, is 2) and predicts all."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs.where(F.coalesce(~held_out, F.lit(False))))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
