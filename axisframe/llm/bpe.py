"""Byte-level BPE by a lazily determinised transducer, and streaming UTF-8 decoding.

A token sequence is the BPE encoding of its bytes exactly if every token encodes to itself and every
two neighbours stay apart when they are merged on their own. The vocabulary trie with that neighbour
test is a nondeterministic transducer: a path has finished some tokens and is inside another one. A
state of the transducer below is the set of paths alive after a prefix; it is built when a text first
reaches it. Tokens that all paths agree on are emitted at once, so the lookahead is at most the
length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import kept, map_arrow, text_bytes


@dataclass(frozen=True)
class Bounds:
    """What a task remembers at most; beyond it the task starts afresh, with the same results."""

    states: int = 250_000
    pairs: int = 500_000
    pieces: int = 400_000


#: For tasks that share an executor's memory with those of other operators.
NARROW = Bounds(90_000, 150_000, 150_000)


class Merges:
    """Ranks of a byte-level vocabulary and the two questions that the transducer asks of them."""

    def __init__(self, ranks: dict[bytes, int], bounds: Bounds = Bounds()):
        self.ranks, self.bounds = ranks, bounds
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}

    @classmethod
    def parse(cls, raw: bytes, bounds: Bounds = Bounds()) -> Merges:
        lines = (line.split() for line in raw.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in lines}, bounds)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token no merge reaches."""
        if token not in self.parts:
            ranks, piece = self.ranks, self.bytes_of[token]
            parts = [piece[i:i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                best = min((ranks.get(a + b, token), i)
                           for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] >= token:
                    break
                i = best[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.parts[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.parts[token]

    def stands_alone(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens.

        Undo the merges of both sides from the last to the first. A pair across the border that
        could merge before the merge just undone would have been taken instead; of two equal
        merges the left one comes first.
        """
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.bounds.pairs:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        before = None  # merges of a lower rank than this would have been taken
        while True:
            merged = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if merged is not None and (before is None or merged < before):
                return False
            a = self.halves(left) if len(self.bytes_of[left]) > 1 else None
            b = self.halves(right) if len(self.bytes_of[right]) > 1 else None
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]


class Transducer:
    """Bytes in, token ids out.

    A path is a pair (last finished token, trie node inside the next one), packed into one number.
    A state is the tuple of the paths alive; ``ends`` holds the token that its prefix ends with, the
    transducer's output. Tokens up to a border that all living paths have in common are settled:
    paths die within the longest token's length, so the lookahead is bounded.
    """

    NODE_BITS = 24
    MASK = (1 << NODE_BITS) - 1

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: dict[int, int] = {}
        self.depth = [0]
        self.token_at = [-1]
        for token, rank in merges.ranks.items():
            node = 0
            for byte in token:
                step = node << 8 | byte
                node = self.child.get(step, 0)
                if not node:
                    node = self.child[step] = len(self.depth)
                    self.depth.append(self.depth[step >> 8] + 1)
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.length = {rank: len(token) for token, rank in merges.ranks.items()}
        self.reset()

    def reset(self) -> None:
        start = (0,)
        self.keys = [start]
        self.number = {start: 0}
        self.moves: dict[int, int] = {}
        self.steps: dict[int, int] = {}
        self.ends = [-1]

    def _step(self, path: int, byte: int) -> int:
        """A path one byte on, doubled; plus one if a token may end here; zero if no token goes on so."""
        node = self.child.get((path & self.MASK) << 8 | byte)
        if node is None:
            return 0
        token, last = self.token_at[node], (path >> self.NODE_BITS) - 1
        fits = (token >= 0 and self.merges.stands_alone(token)
                and (last < 0 or self.merges.stay_apart(last, token)))
        return (path & ~self.MASK | node) << 1 | fits

    def _follow(self, state: int, byte: int) -> int:
        """Determinise one move: from ``state`` by ``byte``."""
        paths, done, steps = [], -1, self.steps
        for path in self.keys[state]:
            step = path << 8 | byte
            grown = steps.get(step)
            if grown is None:
                grown = steps[step] = self._step(path, byte)
            if grown:
                paths.append(grown >> 1)
                if grown & 1 and done < 0:
                    done = self.token_at[grown >> 1 & self.MASK]
        if done < 0:
            raise ValueError("the vocabulary lacks single bytes")
        key = (*paths, done + 1 << self.NODE_BITS)
        following = self.number.get(key)
        if following is None:
            following = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.ends.append(done)
        self.moves[state << 8 | byte] = following
        return following

    def _back(self, states: list[int], stop: int) -> list[int]:
        """The tokens of the first ``stop`` bytes."""
        out, ends, length = [], self.ends, self.length
        while stop:
            token = ends[states[stop - 1]]
            out.append(token)
            stop -= length[token]
        out.reverse()
        return out

    def _settled(self, states: list[int]) -> int:
        """How many bytes are settled: the last border that all living paths have in common."""
        at = {len(states) - self.depth[path & self.MASK] for path in self.keys[states[-1]]}
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            at.add(last - self.length[self.ends[states[last - 1]]])
        return at.pop()

    def encode(self, piece: bytes, window: int = 4096) -> list[int]:
        """The ids of one piece; a piece that is a token itself is that token."""
        whole = self.merges.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.keys) > self.merges.bounds.states:
            self.reset()
        out: list[int] = []
        states: list[int] = []
        state, move = 0, self.moves.get
        for start in range(0, len(piece), window):
            for byte in piece[start:start + window]:
                following = move(state << 8 | byte)
                state = self._follow(state, byte) if following is None else following
                states.append(state)
            final = self._settled(states)
            out += self._back(states, final)
            del states[:final]
        return out + self._back(states, len(states))


class Utf8Stream:
    """Incremental decoding: a state machine over the bytes that a chunk leaves open.

    Its state is the started character: the bytes seen and how many are still due. Whole characters
    are handed on at once; malformed bytes become U+FFFD.
    """

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def _due(lead: int) -> int:
        return 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0

    def feed(self, chunk: bytes) -> str:
        chunk = self.open + chunk
        cut = len(chunk)
        for back in range(1, min(3, len(chunk)) + 1):
            byte = chunk[-back]
            if byte & 0xC0 == 0x80:
                continue
            if self._due(byte) >= back:
                cut = len(chunk) - back
            break
        self.open = chunk[cut:]
        return chunk[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """A vocabulary with its pre-token pattern; what it has worked out stays in the Python worker."""

    def __init__(self, raw: bytes, pattern: str, bounds: Bounds = Bounds()):
        self.merges = Merges.parse(raw, bounds)
        self.transducer = Transducer(self.merges)
        self.findall = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.table = [self.merges.bytes_of.get(i, b"") for i in range(max(self.merges.bytes_of) + 1)]

    @classmethod
    def shared(cls, raw: bytes, pattern: str, bounds: Bounds = Bounds()) -> Codec:
        return kept(("bpe", hash(raw), pattern, bounds), lambda: cls(raw, pattern, bounds))

    def _piece(self, piece: str) -> tuple[bytes, str]:
        ids = self.transducer.encode(piece.encode())
        if len(self.pieces) >= self.merges.bounds.pieces:
            self.pieces.clear()
        known = np.asarray(ids, np.int32).tobytes(), " ".join(map(str, ids))
        if len(piece) <= 64:
            self.pieces[piece] = known
        return known

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of a text, as numbers and as decimals joined by spaces."""
        known, new = self.pieces.get, self._piece
        parts = [known(piece) or new(piece) for piece in self.findall(text)]
        return (np.frombuffer(b"".join([p[0] for p in parts]), np.int32),
                " ".join([p[1] for p in parts]))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids: np.ndarray, chunk: int = 65_536) -> Iterator[str]:
        """The text of the ids, chunk by chunk."""
        stream = Utf8Stream()
        for i in range(0, len(ids), chunk):
            yield stream.feed(self.decode_bytes(ids[i:i + chunk].tolist()))
        yield stream.close()


def _broadcast(df: DataFrame, vocabulary: str):
    """The rank file, read once on the driver; a vocabulary is fixed, so its size is bounded."""
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _text(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def _ids(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    for value in batch.column(column):
        items = value.values
        yield (np.zeros(0, np.int32) if items is None
               else items.drop_null().to_numpy(zero_copy_only=False))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode(df: DataFrame, key: str, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``(key, ids)``: the token ids of every text, pieces of ``pattern`` apart, no special tokens.

    A null or empty text has no ids; rows with a null or repeated key stay as they are.
    """
    raw = _broadcast(df, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.shared(raw.value, pattern)
        ids = [codec.encode(_text(value))[0] for value in batch.column("body")]
        return pa.RecordBatch.from_arrays([batch.column("key"), _lists(ids)], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), text_bytes(text).alias("body"))
    return map_arrow(source, run, f"key {kind}, ids array<int>", "body", keeps=True).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``(key, text)``: ids back to text. Malformed UTF-8 becomes U+FFFD; null ids are an empty text."""
    raw = _broadcast(df, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.shared(raw.value, r"\S+|\s+")
        texts = ["".join(codec.decode(row)) for row in _ids(batch, "ids")]
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return map_arrow(source, run, f"key {kind}, text string", keeps=True).withColumnRenamed("key", key)


def round_trip(df: DataFrame, key: str, vocabulary: str, pattern: str, text: str = "text",
               with_ids: bool = False, bounds: Bounds = Bounds()) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``, and ``ids`` if asked for: encode and decode again.

    The same codec as ``encode`` and ``decode``, in one pass over the texts; decoded texts stay in the
    task that made them.
    """
    raw = _broadcast(df, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.shared(raw.value, pattern, bounds)
        counts, digests, decoded, rows = [], [], [], []
        for value in batch.column("body"):
            ids, decimals = codec.encode(_text(value))
            counts.append(len(ids))
            if with_ids:
                rows.append(ids)
            digests.append(hashlib.sha256(decimals.encode()).hexdigest())
            back = hashlib.sha256()
            for chunk in codec.decode(ids):
                back.update(chunk.encode())
            decoded.append(back.hexdigest())
        columns = [batch.column("key"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
        names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(_lists(rows))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), text_bytes(text).alias("body"))
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(source, run, schema, "body", keeps=True).withColumnRenamed("key", key)
