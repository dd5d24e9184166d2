"""BPE encoding with content-defined chunks: chunks that documents share are encoded once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.llm.common import kept, lean, materialize, packed, unpacker

_MIN_CHUNK = 64
_CACHE_WORDS = 100_000
_PUNCTUATION = ".,;:!?-()\"#*$%&|"
_SPACE = b" \t\n\r\x0b\x0c"
_coders: dict[str, Coder] = kept.setdefault("chunk_bpe", {})


class Coder:
    """A tokenizer file that folds case and drops white space, so that white space bounds every token.

    Keeps the ids of words seen lately: at most _CACHE_WORDS of them, and as many of their cores.
    Words of Latin letters with punctuation around them go straight to the file's merges, since
    its normalizer leaves them alone but for case, and its pattern cuts them at the punctuation;
    all others go through the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        check_kind(self.tokenizer.to_str())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.wide = np.uint16 if n <= 1 << 16 else np.uint32
        self.pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(n)]
        width = len(str(n)) + 1
        self.decimal = np.array([list(f" {i}".encode().ljust(width, b"\0")) for i in range(n)], np.uint8)
        self.words: dict[bytes, bytes] = {b"": b""}
        self.cores: dict[str, bytes] = {"": b""}
        self.bytes_as_letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def _merge(self, piece: str) -> bytes:
        """Ids of one pre-token, by the file's merges."""
        found = self.cores.get(piece)
        if found is None:
            if len(self.cores) > _CACHE_WORDS:
                self.cores = {"": b""}
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes_as_letters)
            found = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], self.wide).tobytes()
            self.cores[piece] = found
        return found

    def _word(self, word: str) -> bytes | None:
        core = word.strip(_PUNCTUATION)
        if not core.isalpha() or max(core) > "\u024f" or "\u0130" in core or "'" in word or "<|" in word:
            return None
        at = word.index(core)
        return self._merge(word[:at]) + self._merge(core.lower()) + self._merge(word[at + len(core) :])

    def encode(self, words: list[bytes]) -> bytes:
        """Ids of words that stand between white space, as packed integers."""
        known = self.words
        if new := set(words).difference(known):
            if len(known) + len(new) > _CACHE_WORDS:
                known.clear()
                known[b""] = b""
                new = set(words)
            rest = []
            for w in new:
                text = w.decode()
                found = self._word(text)
                if found is None:
                    rest.append((w, text))
                else:
                    known[w] = found
            if rest:
                encoded = self.tokenizer.encode_batch_fast([x for _, x in rest], add_special_tokens=False)
                known.update((w, np.array(x.ids, self.wide).tobytes()) for (w, _), x in zip(rest, encoded, strict=True))
        return b"".join(map(known.__getitem__, words))

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        """Count, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded text."""
        numbers = np.frombuffer(ids, self.wide)
        decimal, decoded = hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(numbers), 1 << 16):  # bounded memory for very long texts
            part = numbers[at : at + (1 << 16)]
            digits = self.decimal[part].ravel()
            decimal.update(memoryview(digits[digits != 0])[at == 0 :])
            decoded.update(b" " * (at > 0) + b" ".join(map(self.pieces.__getitem__, part.tolist())))
        return len(numbers), decimal.hexdigest(), decoded.hexdigest()

    def decode(self, ids: bytes) -> str:
        """What the library's decode gives where the file names no decoder: tokens joined by spaces."""
        return b" ".join(map(self.pieces.__getitem__, np.frombuffer(ids, self.wide).tolist())).decode()


def check_kind(definition: str) -> None:
    """Fails for a tokenizer that words cannot be encoded by, one by one: its steps must be those below."""
    found = json.loads(definition)
    steps = {
        "normalizer": [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)],
        "pre_tokenizer": [("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}), ("ByteLevel", None)],
    }
    wrong = [name for name in ("decoder", "post_processor") if found[name] is not None]
    for name, wanted in steps.items():
        step = found[name] or {}
        if [(x["type"], x.get("pattern")) for x in step.get("normalizers") or step.get("pretokenizers") or []] != wanted:
            wrong.append(name)
    if found["model"]["type"] != "BPE" or found["model"].get("dropout") or found["model"].get("unk_token"):
        wrong.append("model")
    if wrong:
        raise ValueError(f"not a tokenizer that folds case and drops white space: {', '.join(wrong)}")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def cuts(text: bytes, bits: int) -> list[int]:
    """Chunk borders: where the rolling hash of the last 8 bytes has `bits` zero bits.

    They depend on the bytes around them alone, fall between characters, and lie _MIN_CHUNK bytes
    apart at least; a text without such a place is one chunk. First 0, last the length.
    """
    n = len(text)
    if n <= _MIN_CHUNK + 8:
        return [0, n] if n else [0]
    data = np.frombuffer(text, np.uint8)
    windows = np.ndarray((n - 8,), "<u8", text, strides=(1,))
    hashed = (windows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    at = np.flatnonzero((hashed == 0) & ((data[8:] & 0xC0) != 0x80)) + 8
    out = [0]
    for p in at.tolist():
        if p - out[-1] >= _MIN_CHUNK:
            out.append(p)
    return [*out, n]


def split_chunk(chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
    """The part of a word that a chunk begins with, its whole words, and the part it ends with.

    Middle None: the chunk has no white space, so it is a part of one word throughout.
    """
    first = len(chunk) - len(chunk.lstrip(_SPACE)) if chunk[:1].isspace() else -1
    if first >= 0:
        head, rest = b"", chunk
    else:
        parts = chunk.split(None, 1)
        if len(parts) == 1 and not chunk[-1:].isspace():
            return chunk, None, b""
        head = parts[0]
        rest = chunk[len(head) :]
    if rest[-1:].isspace():
        return head, rest, b""
    tail = rest.rsplit(None, 1)[-1] if rest.strip() else b""
    return head, rest[: len(rest) - len(tail)], tail


def encode_text(text: bytes, known: dict[int, bytes], coder: Coder, bits: int) -> bytes:
    """Encodes a text chunk by chunk; `known` has the ids of the whole words of shared chunks.

    A chunk border may cut a word. The tokens of its two parts are not those of the word, so every
    join is repaired: the parts on both sides are re-encoded together, over as many chunks as it
    takes to reach white space. From there on the tokens agree with those of the whole text, as no
    token and no normalization reaches across white space.
    """
    borders = cuts(text, bits)
    out, open_word, words = [], b"", []
    for k, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
        head, middle, tail = split_chunk(text[a:b])
        open_word += head
        if middle is None:
            continue
        words.append(open_word)
        open_word = tail
        if k in known:
            out.append(coder.encode(words))
            out.append(known[k])
            words = []
        else:
            words += middle.split()
    words.append(open_word)
    out.append(coder.encode(words))
    return b"".join(out)


_KEY = ["key", "text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("key"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )


def encode_documents(docs: DataFrame, path: str, *, bits: int = 10, output: str = "digests") -> DataFrame:
    """Encodes each whole text (null: empty) and decodes the ids; one row out for each row in.

    Returns doc_id, n_tokens, and by `output` either ids_sha256 and decoded_sha256 ("digests"), or
    ids (array of int) and decoded ("tokens").

    Chunks are found by a rolling hash and named by a 128-bit hash. Names that occur more than once
    form the shared set: the first of their rows encodes the chunk, and its ids are joined back to
    all rows by name, in Spark joins whose hot keys are split. Texts are dealt by row once, packed, and that
    exchange serves both the encoding of shared chunks and the final pass. Repeated rows share all
    their chunks. Nothing is collected; a task holds one text and its ids.
    """
    texts = _keyed(docs)

    def name_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            key, hashed, seq, name = [], [], [], []
            for k, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                borders = cuts(raw, bits)
                for i, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
                    key.append(k)
                    hashed.append(h)
                    seq.append(i)
                    name.append(xxhash.xxh3_128_digest(raw[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(hashed, pa.int64()), pa.array(seq, pa.int32()), pa.array(name, pa.binary())], [*_KEY, "seq", "name"])

    chunks = materialize(texts.select(*_KEY, "text").mapInArrow(name_chunks, "key bigint, text_hash bigint, seq int, name binary"))
    first = F.min(F.struct(*_KEY, "seq")).alias("first")
    shared = chunks.groupBy("name").agg(first, F.count("*").alias("n")).where("n > 1").select("name", "first")
    owned = shared.select("first.key", "first.text_hash", F.struct("first.seq", "name").alias("chunk")).groupBy(*_KEY).agg(F.collect_list("chunk").alias("chunks"))

    def encode_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("chunk_bpe")
        use, unpack = coder(path), unpacker()
        for batch in batches:
            names, ids, done = [], [], set()
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = unpack(text)
                borders = cuts(raw, bits)
                for x in wanted:
                    if x["name"] not in done:
                        done.add(x["name"])
                        middle = split_chunk(raw[borders[x["seq"]] : borders[x["seq"] + 1]])[1]
                        names.append(x["name"])
                        ids.append(use.encode((middle or b"").split()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["name", "ids"])

    dealt = packed(texts)
    encoded = dealt.join(owned.hint("shuffle_hash"), _KEY).select("text", "chunks").mapInArrow(encode_owned, "name binary, ids binary")
    encoded = encoded.dropDuplicates(["name"])
    # a set, as repeated rows give their chunks twice
    given = chunks.join(encoded, "name").groupBy(*_KEY).agg(F.collect_set(F.struct("seq", "ids")).alias("given"))
    # the same frame as above, so that Spark reuses the exchange of the texts
    joined = dealt.join(given.hint("shuffle_hash"), _KEY, "left")
    rows = joined.select(F.when(F.col("key") != -(2**63), F.col("key")).alias("doc_id"), "text", "given")

    tokens = output == "tokens"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("chunk_bpe")
        use, unpack = coder(path), unpacker()
        for batch in batches:
            count, a, b = [], [], []
            for text, given in zip(batch.column(1), batch.column(2), strict=True):
                known = {x["seq"]: x["ids"] for x in given.as_py() or ()}
                ids = encode_text(unpack(text), known, use, bits)
                if tokens:
                    a.append(np.frombuffer(ids, use.wide).tolist())
                    b.append(use.decode(ids))
                    count.append(len(a[-1]))
                else:
                    n, x, y = use.digests(ids)
                    count.append(n)
                    a.append(x)
                    b.append(y)
            kind = pa.list_(pa.int32()) if tokens else pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(a, kind), pa.array(b, pa.string())], names)

    names = ["doc_id", "n_tokens", *(("ids", "decoded") if tokens else ("ids_sha256", "decoded_sha256"))]
    kind = "array<int>" if tokens else "string"
    return rows.mapInArrow(finish, f"doc_id bigint, n_tokens bigint, {names[2]} {kind}, {names[3]} string")
