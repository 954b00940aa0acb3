"""Token counts of a unigram vocabulary, by a Viterbi pass that keeps counts only.

An Aho-Corasick automaton enumerates the pieces that end at each character. The best score up to a
place and the number of pieces of its path go forward together; the path itself is never kept. Ties
follow the tokenizer: of several best paths into a place, the piece that starts first wins. Where no
piece of one character starts, an unknown character may stand in, at ten below the worst score; its
tokens are its UTF-8 bytes.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import kept, map_arrow, text_bytes

#: How much worse than the worst piece an unknown character is (a fixed value of the tokenizers).
UNKNOWN_PENALTY = 10.0
BLANK = "▁"
#: A task remembers the counts of so many segments.
MAX_SEGMENTS = 300_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with their scores; no control or byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter(dict):
    """``counter[segment]`` is (tokens, score) of a segment; results are kept up to a bound."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        inner = {c for piece, _ in pieces if len(piece) > 1 for c in piece}
        leads = all(BLANK not in piece.lstrip(BLANK) for piece, _ in pieces)
        self.segments = self._pattern(inner, leads)

    @staticmethod
    def _pattern(inner: set[str], leads: bool) -> re.Pattern:
        """Cuts that no piece crosses: around characters of no longer piece, and before blanks if
        blanks only lead pieces. Segments are then counted on their own."""
        if not inner:
            return re.compile(".", re.S)
        letters = "".join(map(re.escape, sorted(inner - {BLANK} if leads else inner)))
        if not leads or BLANK not in inner:
            return re.compile(f"[{letters}]+|.", re.S)
        return re.compile(f"{BLANK}*[{letters}]+|{BLANK}+|." if letters else f"{BLANK}+|.", re.S)

    def __missing__(self, segment: str) -> tuple[int, float]:
        known = self.count(segment)
        if len(segment) <= 64:
            if len(self) >= MAX_SEGMENTS:
                self.clear()
            self[segment] = known
        return known

    def count(self, segment: str) -> tuple[int, float]:
        """The Viterbi pass over one segment."""
        n = len(segment)
        best: list[float | None] = [0.0] + [None] * n
        tokens = [0] * (n + 1)
        reached, single = 0, False

        def close(place: int, single: bool) -> None:
            # the last start for this place is the character before it
            if not single:
                value = best[place - 1] + self.unknown
                if best[place] is None or value > best[place]:
                    best[place] = value
                    tokens[place] = tokens[place - 1] + len(segment[place - 1].encode("utf-8", "replace"))

        for end, (length, score) in self.automaton.iter(segment):
            place = end + 1
            while reached < end:
                reached += 1
                close(reached, single)
                single = False
            value = best[place - length] + score
            if best[place] is None or value > best[place]:
                best[place] = value
                tokens[place] = tokens[place - length] + 1
            single = single or length == 1
        while reached < n:
            reached += 1
            close(reached, single)
            single = False
        return tokens[n], best[n]

    def total(self, text: str) -> tuple[int, float]:
        """Tokens and score of a text: blanks are visible, and one leads the text."""
        if not text:
            return 0, 0.0
        parts = list(map(self.__getitem__, self.segments.findall(BLANK + text.replace(" ", BLANK))))
        return sum([p[0] for p in parts]), sum([p[1] for p in parts])


def count_tokens(df: DataFrame, pieces: list[tuple[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, score)`` of every whole text.

    A null or empty text has no tokens and score zero; rows with a null or repeated key are counted
    like others. The vocabulary is fixed and is sent to the tasks once.
    """
    shared, name = df.sparkSession.sparkContext.broadcast(pieces), hash(tuple(pieces))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = kept(("token counts", name), lambda: Counter(shared.value))
        totals = [counter.total(v.as_py().decode("utf-8", "replace")) for v in batch.column("body")]
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array([t[0] for t in totals], pa.int64()),
             pa.array([t[1] for t in totals], pa.float64())], ["key", "n_tokens", "score"])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), text_bytes(text).alias("body"))
    return map_arrow(source, run, f"key {kind}, n_tokens long, score double", "body", keeps=True).withColumnRenamed("key", key)
