"""SentencePiece encoding by a lattice of pieces, and decoding.

Text is a model's usual form: a blank sign before it and for every blank, nothing else changed.
It is cut into words (a blank sign and what follows it, also before a mark that follows a letter,
which no piece crosses; line ends alone), however long a run without blanks is. Each different word of a batch is worked out once: its substrings up to the longest
piece are listed, equi-joined with the piece table on their hash (and compared), grouped by word and
end, and the best path is folded over the places of all words at once: at each place the best of the
edges that end there, ties to the longer piece (Viterbi). A place that no piece reaches takes its
UTF-8 bytes as byte pieces. A word of over ``WORD`` code points is folded alone, a block of places after
the other; scores are kept for the longest piece's places, the step back for all. Documents stay where they are read, nothing is shuffled, and a worker
keeps a bounded number of words and ids.

Models whose scores are log probabilities are used as they are. A merge model's scores are negated
merge ranks; with them -5 - ln(1 + rank) stands in (Zipf's law), and pieces the model never merges
to stay out.

Decoding joins pieces, turns byte pieces into bytes and blank signs into blanks, and drops the
first blank: decode(encode(text)) is the text, if it holds no blank sign itself.

Null and empty texts have no ids. Repeated rows each get their own answer. Other columns and
columns of the same names stay untouched. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import give_back, whole_text, worker_tables
from .windows import _power_tables
from .wordtable import WordTable

SIGN = "▁"
WORD = 64
BLOCK = 1 << 14
KNOWN_IDS = 1 << 22
#: words a worker keeps; as keys of a dictionary they take some 200 bytes each
KNOWN_WORDS = 340_000
#: no piece holds a letter before one of these marks (checked), so a cut there loses no path
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?|"
PATTERN = f"{SIGN}?[{_LETTER}]+(?=[{_MARK}])|{SIGN}?[^{SIGN}\n]+|{SIGN}|\n"
NEVER = -1e8
SLICE_CHARS = 1 << 19
#: documents whose texts are Python objects at a time
SLICE_ROWS = 512
SOLVED_AT_ONCE = 6_000
_BASE = 0x8CB92BA72F3D8DD7
_U = np.uint64


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Pieces:
    """A model file's pieces: id to bytes, and the scored pieces of the lattice by length."""

    def __init__(self, model: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.get_piece_size()
        self.bytes: list[bytes] = []
        self.rows: list[tuple[str, int, float]] = []
        self.byte_ids = [0] * 256
        scores = [m.get_score(i) for i in range(n)]
        ranks = all(s == int(s) for s in scores)  # merge ranks, not log probabilities
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(SIGN, " ").encode())
                if (scores[i] > NEVER or len(piece) == 1) and "\n" not in piece and SIGN not in piece[1:]:
                    self.rows.append((piece, i, -5 - math.log1p(min(-scores[i], n)) if ranks else scores[i]))
        self.longest = max(len(p) for p, _, _ in self.rows)
        if any(re.search(f"[{_LETTER}][{_MARK}]", p) for p, _, _ in self.rows):
            raise ValueError("a piece crosses from a letter to a mark: words can't be cut there")
        self.by_length = []
        for size in range(1, self.longest + 1):
            own = [r for r in self.rows if len(r[0]) == size]
            signs = _points("".join(p for p, _, _ in own)).reshape(-1, size)
            key = (signs.astype(_U) * _power_tables(_BASE, size + 1)[0][:size]).sum(axis=1, dtype=_U)
            order = np.argsort(key)
            self.by_length.append((key[order], signs[order], np.array([i for _, i, _ in own], np.int64)[order], np.array([s for *_, s in own])[order]))

    def edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) by piece length - 1 and first place; no piece: minus infinity, -1.

        ``ends`` has the end of the word that each place belongs to.
        """
        power, inverse = _power_tables(_BASE, len(points) + 1)
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(points.astype(_U) * power[: len(points)], dtype=_U)))
        score, ids = np.full((self.longest, len(points)), -np.inf), np.full((self.longest, len(points)), -1, np.int32)
        for size, (keys, signs, piece, value) in enumerate(self.by_length, 1):
            at = np.flatnonzero(np.arange(size, size + len(points)) <= ends)
            if not len(at) or not len(keys):
                continue
            hashed = (sums[at + size] - sums[at]) * inverse[at]
            found = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            same = keys[found] == hashed
            at, found = at[same], found[same]
            same = (points[at[:, None] + np.arange(size)] == signs[found]).all(axis=1)
            at, found = at[same], found[same]
            score[size - 1, at], ids[size - 1, at] = value[found], piece[found]
        return score, ids

    def solve(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each word's best path."""
        for at in range(0, len(words), SOLVED_AT_ONCE):
            part = words[at : at + SOLVED_AT_ONCE]
            short = self._solve([w for w in part if len(w) <= WORD])
            for word in part:
                yield next(short) if len(word) <= WORD else self._fold(word)

    def _fold(self, word: str) -> list[int]:
        """The ids of a long word's best path, the same as ``_solve`` finds."""
        points, lowest = _points(word), -math.inf
        back, piece = bytearray(len(points) + 1), array("i", bytes(4 * (len(points) + 1)))
        ahead = [0.0] + [lowest] * self.longest
        for at in range(0, len(points), BLOCK):
            size = min(BLOCK, len(points) - at)
            part = points[at : at + size + self.longest - 1]
            score, ids = self.edges(part, np.full(len(part), len(part)))
            start, length = np.nonzero(ids[:, :size].T >= 0)
            value, found = score[length, start].tolist(), ids[length, start].tolist()
            first, length, best = np.searchsorted(start, np.arange(size + 1)).tolist(), (length + 1).tolist(), ahead + [lowest] * size
            for place in range(size):
                here = best[place]
                for k in range(first[place], first[place + 1]):
                    end = place + length[k]
                    path = here + value[k]
                    if path > best[end]:  # pieces come longest first at each end: ties stay with them
                        best[end], back[at + end], piece[at + end] = path, length[k], found[k]
                if best[place + 1] == lowest:
                    best[place + 1] = here + NEVER
            ahead = best[size : size + self.longest + 1]
        out: list[int] = []
        end = len(points)
        while end:
            if back[end]:
                out.append(piece[end])
            else:
                out.extend(self.byte_ids[b] for b in reversed(chr(points[end - 1]).encode("utf-8", "replace")))
            end -= back[end] or 1
        return out[::-1]

    def _solve(self, words: list[str]) -> Iterator[list[int]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")  # the words that reach a place come first
        sizes = sizes[order]
        points = _points("".join(words[i] for i in order.tolist()))
        first = np.cumsum(sizes) - sizes
        score, ids = self.edges(points, np.repeat(first + sizes, sizes))
        slot = first + np.arange(len(words))  # a word of n code points has n + 1 places
        best, back = np.zeros(len(points) + len(words)), np.zeros(len(points) + len(words), np.int64)
        for place in range(1, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes, -place, side="right"))
            top, size = np.full(n, -np.inf), np.zeros(n, np.int64)
            for length in range(1, min(place, self.longest) + 1):
                path = best[slot[:n] + place - length] + score[length - 1, first[:n] + place - length]
                better = (path >= top) & (path > -np.inf)
                top, size = np.where(better, path, top), np.where(better, length, size)
            top = np.where(size == 0, best[slot[:n] + place - 1] + NEVER, top)
            best[slot[:n] + place], back[slot[:n] + place] = top, size
        left, who = sizes.copy(), np.arange(len(words))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who := who[left[who] > 0]):
            size = back[slot[who] + left[who]]
            start = first[who] + left[who] - np.maximum(size, 1)
            steps.append((who, np.where(size > 0, ids[size - 1, start], -1 - points[start].astype(np.int64))))
            left[who] -= np.maximum(size, 1)
        out: list[list[int]] = [[] for _ in words]
        place = order.tolist()
        for who, found in reversed(steps):
            for w, i in zip(who.tolist(), found.tolist(), strict=True):
                if i >= 0:
                    out[place[w]].append(i)
                else:
                    out[place[w]].extend(self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "replace"))
        return iter(out)


def _model(model: str) -> tuple[Pieces, WordTable]:
    """A worker's pieces and known words of a model."""

    def load() -> tuple[Pieces, WordTable]:
        pieces = Pieces(model)
        return pieces, WordTable(pieces.solve, [], KNOWN_WORDS)

    return worker_tables(("pieces", model), load)


def words_of(text: str) -> list[str]:
    return re.findall(PATTERN, SIGN + text.replace(" ", SIGN)) if text else []


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids), one row per document. Executors read the model file at the same path."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _model(model)[1]
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(first, SLICE_ROWS)
                if len(table.ids) > KNOWN_IDS:
                    table.reset()
                texts, at = batch.column("text").to_pylist(), 0
                while at < len(texts):  # slices of bounded size, or one long document
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                        size += len(texts[end])
                        end += 1
                    ids, counts = table.encode([words_of(t) for t in texts[at:end]])
                    cuts = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.ListArray.from_arrays(cuts, pa.array(ids.astype(np.int32)))], schema=schema)
                    at = end
        give_back()

    return rows.mapInArrow(look_up, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the ``decoded`` text of their ids; an id the model lacks fails."""

    @F.pandas_udf("string")
    def spell(column):
        pieces = _model(model)[0].bytes
        texts = column.map(lambda i: b"".join(map(pieces.__getitem__, i.tolist())) if i is not None else b"")
        return texts.map(lambda t: (t[1:] if t[:1] == b" " else t).decode("utf-8", "replace"))

    return rows.withColumn("decoded", spell(ids))


def encoded_rows(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, ids) of every document."""

    @F.pandas_udf("long")
    def checksum(column):
        return column.map(lambda i: zlib.crc32(np.asarray(i, "<u4").tobytes()))

    done = decode(encode(docs, model), model)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), checksum("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")
