"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder of its ids.

Of all ways to cut a string into tokens, the one that the merges give is the only one in which each
two neighbours alone merge back into just these two. (The first merge across a border would be the
lowest one between these neighbours as well.) So a nondeterministic transducer reads tokens byte by
byte, and may pass from one to the next where the pair is such a couple. Determinised, a state is
each token sequence still possible after what was emitted, its last token, and the trie node of the
bytes read beyond it; where few tokens are below that node, one of them must fit. What all sequences
begin with is emitted at once, which happens within a bounded number of bytes, as a sequence dies when
no token goes on with the bytes read.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.llm.common import kept, lean

_MAX_STATES = 600_000
_CACHE_PIECES = 300_000
_CACHED_BYTES = 64
_AT_ONCE = 1 << 16
_NONE = 1 << 62
_FEW = 4
_encodings: dict[tuple[str, str], Encoding] = kept.setdefault("byte_bpe", {})

Path = tuple[int, ...]


class Transducer:
    """The merges of a rank file as a deterministic transducer, whose states are made when first reached.

    `ranks` has an id for each token, which is its rank too: of two neighbours that are a token
    together, those of the lowest rank merge first, the leftmost of equals.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack {len(lacking)} of the 256 single bytes")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.children: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, i in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.children:
                    self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.children[key]
            self.token_at[node] = i
        #: for trie nodes above few tokens only: which
        self.few: list[list[int] | None] = [[] for _ in self.token_at]
        for token, i in ranks.items():
            node = 0
            for b in token:
                found = self.few[node]
                if found is not None:
                    found.append(i)
                    if len(found) > _FEW:
                        self.few[node] = None
                node = self.children[node << 8 | b]
        self.couples: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: state << 8 | byte -> next state, inverted where something is emitted
        self.steps: dict[int, int] = {}
        self.emitted: dict[int, Path] = {}
        self.start = self._number(((-1, (), 0),))

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges one by one, for strings of two tokens at most."""
        rank = lambda pair: self.ranks.get(pair, _NONE)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while ranks and (lowest := min(ranks)) < _NONE:
            i = ranks.index(lowest)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1])
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i])
        return parts

    def couple(self, left: int, right: int) -> bool:
        """Whether two tokens, side by side, are what the merges make of their bytes (left -1: none before)."""
        key = left << 32 | right
        found = self.couples.get(key)
        if found is None:
            if len(self.couples) > _MAX_STATES:
                self.couples.clear()
            pair = [self.tokens[t] for t in (left, right) if t >= 0]
            found = self.couples[key] = self.merged(b"".join(pair)) == pair
        return found

    def _step(self, key: int) -> int:
        """Makes a transition, and the state that it leads to."""
        byte, couple, after, whole = key & 255, self.couple, [], None
        for before, path, node in self.states[key >> 8]:
            below = self.children.get(node << 8 | byte)
            if below is None:
                continue
            if self.inner[below]:
                few = self.few[below]
                if few is None:
                    after.append((before, path, below))
                else:
                    for token in few:
                        if couple(before, token):
                            after.append((before, path, below))
                            break
            # just one, as each string has one tokenization
            if whole is None and (token := self.token_at[below]) >= 0 and couple(before, token):
                whole = (*path, token)
        if whole is None:
            raise AssertionError("a string without a tokenization")
        n = 0
        for n, token in enumerate(whole):  # noqa: B007
            if any(len(path) <= n or path[n] != token for _, path, _ in after):
                break
        else:
            n = len(whole)
        if n:
            after = [(before, path[n:], node) for before, path, node in after]
            self.emitted[key] = whole[:n]
        after.append((whole[-1], whole[n:], 0))
        to = self._number(tuple(after))
        self.steps[key] = found = ~to if n else to
        return found

    def __call__(self, piece: bytes) -> list[int]:
        """The ids of a string, by one transition a byte."""
        if len(self.states) > _MAX_STATES:
            self._clear()
        state, out, steps = self.start, [], self.steps
        for byte in piece:
            key = state << 8 | byte
            state = steps.get(key)
            if state is None:
                state = self._step(key)
            if state < 0:
                state = ~state
                out += self.emitted[key]
        out += self.states[state][-1][1]
        return out


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoding:
    """A rank file and the pattern that splits texts before the merges.

    A match of the pattern that is a token itself is that token; any other goes through the
    transducer. Ids of short matches are kept: the _CACHE_PIECES used last at least, twice as many at most.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.ranks = ranks
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.pieces[i] = token
        #: tokens that begin and end between characters
        self.closed = np.array([_closed(t) for t in self.pieces], bool)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        if (found := self.older.pop(piece, None)) is not None:
            self.known[piece] = found
            return found
        raw = piece.encode()
        whole = self.ranks.get(raw)
        found = _packed([whole] if whole is not None else self.transducer(raw))
        if len(raw) <= _CACHED_BYTES:
            if len(self.known) >= _CACHE_PIECES:
                self.older, self.known = self.known, {}
            self.known[piece] = found
        return found

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian unsigned 32-bit integers, some thousand matches at a time."""
        ids = self._ids
        matches = self.pattern.finditer(text)
        while True:
            # long texts are not cut up as a whole
            pieces = self.pattern.findall(text) if len(text) < _AT_ONCE else [m.group() for m in islice(matches, _AT_ONCE)]
            known = self.known  # which a full table replaces; until then it only misses what is new
            yield b"".join([known.get(p) or ids(p) for p in pieces])
            if len(text) < _AT_ONCE or len(pieces) < _AT_ONCE:
                return


def encoding(path: str, pattern: str) -> Encoding:
    if (path, pattern) not in _encodings:
        _encodings[path, pattern] = Encoding(path, pattern)
    return _encodings[path, pattern]


def _utf8_states() -> list[list[int]]:
    """The state machine of UTF-8: state and byte -> state, -1 for a byte that cannot follow.

    State 0 stands between characters; 1 to 3 await so many bytes; 4 to 7 follow E0, ED, F0 and F4,
    after which not all second bytes are allowed.
    """
    table = [[-1] * 256 for _ in range(8)]
    table[0] = [0] * 128 + [-1] * 66 + [1] * 30 + [4] + [2] * 12 + [5] + [2] * 2 + [6] + [3] * 3 + [7] + [-1] * 11
    for state, low, high, then in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        for b in range(low, high + 1):
            table[state][b] = then
    return table


_UTF8 = _utf8_states()


def _closed(token: bytes) -> bool:
    state = 0
    for b in token:
        state = _UTF8[state][b]
        if state < 0:
            return False
    return state == 0


class StreamDecoder:
    """Turns ids into text as they come: a character is given out with its last byte.

    What is not UTF-8 becomes U+FFFD, one for each longest beginning of a character, as Python's
    decoder with errors="replace" has it.
    """

    def __init__(self, encoding: Encoding):
        self.encoding = encoding
        self.state = 0
        self.held = bytearray()

    def _walk(self, token: bytes, out: list[bytes]) -> None:
        for b in token:
            after = _UTF8[self.state][b]
            if after < 0 and self.state:
                out.append(b"\xef\xbf\xbd")
                self.held.clear()
                after = _UTF8[0][b]
            if after < 0:
                out.append(b"\xef\xbf\xbd")
                after = 0
            else:
                self.held.append(b)
                if after == 0:
                    out.append(bytes(self.held))
                    self.held.clear()
            self.state = after

    def feed(self, ids: np.ndarray) -> bytes:
        """The text that more ids complete, in UTF-8. Only tokens that cut characters are walked by byte."""
        pieces, out, at = self.encoding.pieces, [], 0
        for i in [0] * (self.state > 0) + np.flatnonzero(~self.encoding.closed[ids]).tolist():
            if i < at:
                continue
            out += [pieces[t] for t in ids[at:i].tolist()]
            at = i
            while at < len(ids):
                self._walk(pieces[ids[at]], out)
                at += 1
                if self.state == 0:
                    break
        out += [pieces[t] for t in ids[at:].tolist()]
        return b"".join(out)

    def finish(self) -> bytes:
        """What is left at the end: U+FFFD for a character begun."""
        cut, self.state = self.state, 0
        self.held.clear()
        return b"\xef\xbf\xbd" if cut else b""


def encode_documents(docs: DataFrame, path: str, pattern: str, *, output: str = "digests") -> DataFrame:
    """Encodes each whole text of `docs` (null: empty) and decodes the ids; one row out for each row in.

    Returns doc_id, n_tokens, and by `output` either ids_sha256 (of little-endian unsigned 32-bit
    integers) and decoded_sha256 ("digests"), or ids (array of int) and decoded ("tokens"). Bytes
    that are not UTF-8 count as U+FFFD. Null ids stay null, repeated rows are encoded each, other
    columns are left out, an empty table gives none.

    One pass without a shuffle; the file named by `path` must be where the executors run. A task
    holds one text and its ids, and a worker's states and kept matches are bounded in number.
    """
    tokens = output == "tokens"
    names = ["doc_id", "n_tokens", *(("ids", "decoded") if tokens else ("ids_sha256", "decoded_sha256"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("byte_bpe")
        use = encoding(path, pattern)
        for batch in batches:
            count, first, second = [], [], []
            for value in batch.column(1):
                text = value.as_buffer().to_pybytes().decode("utf-8", "replace") if value.is_valid else ""
                decoder, n, ids, decoded = StreamDecoder(use), 0, hashlib.sha256(), hashlib.sha256()
                all_ids, all_text = [], []
                for part in use.encode(text):
                    numbers = np.frombuffer(part, "<u4")
                    n += len(numbers)
                    said = decoder.feed(numbers)
                    if tokens:
                        all_ids.append(numbers)
                        all_text.append(said)
                    else:
                        ids.update(part)
                        decoded.update(said)
                rest = decoder.finish()
                count.append(n)
                if tokens:
                    first.append(np.concatenate(all_ids).astype(np.int32))
                    second.append((b"".join(all_text) + rest).decode())
                else:
                    decoded.update(rest)
                    first.append(ids.hexdigest())
                    second.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(first, pa.list_(pa.int32()) if tokens else pa.string()), pa.array(second, pa.string())], names)

    kind = "array<int>" if tokens else "string"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id bigint, n_tokens bigint, {names[2]} {kind}, {names[3]} string")
