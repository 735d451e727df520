"""SentencePiece encoding and decoding by a streaming Viterbi search over a vocabulary's pieces."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kbspark.llm.common import slices

SPACE = "▁"
#: Stands for a literal U+2581 while a text is encoded; it occurs in no valid text.
_LITERAL = "\udc81"
#: Below the least score of a piece, what a character outside the vocabulary costs.
UNKNOWN = 10.0
#: Lengths of the longest piece that may pass before paths are traced for a common boundary.
PATIENCE = 8
#: Scores that are held at once for all spans that are searched side by side.
HELD = 1 << 22
#: Bytes of text whose spans are searched together.
TOGETHER = 8 << 20


class Pieces:
    """Pieces, scores and bytes of a SentencePiece model file.

    A unigram model's scores are taken as they are. A BPE model scores a piece
    by its negated rank, which is no probability; by Zipf's law a piece of rank
    r has one of 1 / (r + 1) up to a constant, and its logarithm is the score.
    A character outside the vocabulary becomes its bytes, or the unknown id where the vocabulary has no pieces for bytes."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = np.array([sp.get_score(i) for i in plain])
        if (scores == np.round(scores)).all():
            rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable") + 1.0
            scores = -np.log(rank + 1) - math.log((1 / (rank + 1)).sum())
        self.of_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.whole, self.unknown_id = len(self.of_byte) == 256, sp.unk_id()
        self.score = {sp.id_to_piece(i): (i, x) for i, x in zip(plain, scores.tolist())}
        self.bytes = [b""] * sp.get_piece_size()
        for piece, (i, _) in self.score.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode("utf-8")
        for byte, i in self.of_byte.items():
            self.bytes[i] = bytes([byte])
        self.longest = max(map(len, self.score), default=1)
        self.unknown = float(scores.min()) - UNKNOWN
        #: No piece goes on with a space mark after another character: every path meets there.
        self.meets_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        #: Characters of no longer piece: every path meets before and after them.
        self.alone = "\n" not in {c for p in self.score if len(p) > 1 for c in p}
        inside = " +[^ {0}]*|[^ {0}]+" if self.meets_at_space else "[^{0}]+"
        self.spans = re.compile((r"\n|" + inside.format(r"\n")) if self.alone else inside.format("") if self.meets_at_space else r"[\s\S]+")


class Trie:
    """All beginnings of pieces, as a hash table from (node, character) to the next node; node 0 is the root."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: Pieces):
        nodes: dict[str, int] = {"": 0}
        for piece in pieces.score:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        self.piece, self.score = np.full(len(nodes), -1, np.int32), np.full(len(nodes), -math.inf)
        for text, (i, x) in pieces.score.items():
            self.piece[nodes[text]], self.score[nodes[text]] = i, x
        some = [(t, n) for t, n in nodes.items() if n]
        keys = np.array([nodes[t[:-1]] << 21 | ord(t[-1]) for t, _ in some], np.uint64)
        to = np.array([n for _, n in some], np.int32)
        self.goes_on = np.zeros(len(nodes), bool)
        self.goes_on[[nodes[t[:-1]] for t, _ in some]] = True
        bits = max((4 * len(keys)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, 2**64 - 1, np.uint64), np.zeros(1 << bits, np.int32)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):  # each free slot takes one of those that want it, the others go on to the next
            free = left[self.keys[at[left]] == 2**64 - 1]
            self.keys[at[free]] = keys[free]
            self.to[at[free]] = to[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        won = self.keys[at] == keys
        self.to[at[won]] = to[won]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.STEP) >> self.shift).astype(np.int64)

    def next(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node after each node and character, or 0 where no piece begins so."""
        keys = nodes.astype(np.uint64) << np.uint64(21) | chars.astype(np.uint64)
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.to[at], 0)
        left = np.flatnonzero((held != keys) & (held != 2**64 - 1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            out[left] = np.where(held == keys[left], self.to[at[left]], 0)
            left = left[(held != keys[left]) & (held != 2**64 - 1)]
        return out


class Encoder:
    """Best paths through the pieces that spell texts.

    Texts are divided into spans where the vocabulary has no piece across, so that every path meets there; equal
    spans of a batch are searched once, all side by side, one character at a time. Scores and backpointers are kept for
    an open window. When a span is longer, the positions ahead that a piece already reaches are all that any further path can pass
    through; once their backpointers lead to one boundary, the ids up to it are committed and the window starts there.
    Every span goes this way, whatever its length."""

    def __init__(self, model_file: str):
        self.pieces = Pieces(model_file)
        self.trie = Trie(self.pieces)
        self.commits = 0
        self.table = pa.array(self.pieces.bytes, pa.large_binary())

    def spans(self, text: str) -> list[str]:
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        return self.pieces.spans.findall(" " + text) if text else []

    def paths(self, spans: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans one after the other, where each begins and the last ends)."""
        sizes = np.fromiter(map(len, spans), np.int64, len(spans))
        chars = np.frombuffer("".join(spans).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
        found, at = [], 0
        while at < len(order):  # spans of like lengths together
            room = min(int(sizes[order[at]]), PATIENCE * self.pieces.longest) + 2 * self.pieces.longest
            some = order[at:at + max(HELD // room, 1)]
            found += self._search(chars, begins[some], sizes[some], some)
            at += len(some)
        span, turn, ids = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 3))
        place = np.lexsort((turn, span))
        ends = np.concatenate([[0], np.cumsum(np.bincount(span, minlength=len(spans)))])
        return ids[place].astype(np.int32), ends

    def _search(self, chars: np.ndarray, begin: np.ndarray, size: np.ndarray, name: np.ndarray) -> list[tuple]:
        """Committed (span, place, id) of spans in falling order of length."""
        trie, longest = self.trie, self.pieces.longest
        patience = PATIENCE * longest
        width = min(int(size[0]), patience) + longest + 1
        best = np.full((len(size), width), -math.inf)
        step, piece = np.zeros((len(size), width), np.int16), np.full((len(size), width), -1, np.int32)
        best[:, 0] = 0.0
        base, start, out = 0, np.zeros(len(size), np.int64), []  # start: up to where a span's ids are committed

        def commit(rows: np.ndarray, ends: np.ndarray):
            rows, ends = rows.copy(), ends.copy()
            while True:
                some = ends > start[rows]
                rows, ends = rows[some], ends[some]
                if not len(rows):
                    return
                ids, long = piece[rows, ends - base], step[rows, ends - base]
                plain = ids >= 0
                out.append((name[rows[plain]], 8 * (ends[plain] - long[plain]), ids[plain]))
                for r, end in zip(rows[~plain], ends[~plain]):
                    out.append(self._outside(int(chars[begin[r] + end - 1]), name[r], 8 * (end - 1)))
                ends = ends - long

        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, side="left"))  # spans longer than t
            if t - base >= patience and (t - base) % longest == 0:
                meet = np.array([self._meeting(best[r], step[r], t - base) for r in range(n)]) + base
                moved = np.flatnonzero(meet > start[:n])
                commit(moved, meet[moved])
                self.commits += len(moved)
                start[moved] = meet[moved]
                done = np.flatnonzero((size > base) & (size <= t))
                commit(done, size[done])
                start[done] = size[done]
                cut = int(start[:n].min()) - base
                best, step, piece = best[:n, cut:], step[:n, cut:], piece[:n, cut:]
                base += cut
            if t - base + longest + 1 > best.shape[1]:
                more = max(longest + 1, t - base)  # room ahead, or paths that do not meet for long
                best = np.pad(best, ((0, 0), (0, more)), constant_values=-math.inf)
                step, piece = np.pad(step, ((0, 0), (0, more))), np.pad(piece, ((0, 0), (0, more)), constant_values=-1)
            rows, here = np.arange(n), best[:n, t - base].copy()
            node = np.zeros(n, np.int32)
            for length in range(1, longest + 1):
                node = trie.next(node, chars[begin[rows] + t + length - 1])
                ids, score = trie.piece[node], here[rows] + trie.score[node]
                if length == 1:
                    ids = np.where(node > 0, ids, -1)
                    score = np.where(ids >= 0, score, here + self.pieces.unknown)
                to = t - base + length
                wins = score > best[rows, to]
                won = rows[wins]
                best[won, to], step[won, to], piece[won, to] = score[wins], length, ids[wins]
                on = (node > 0) & trie.goes_on[node] & (size[rows] > t + length)
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
        left = np.flatnonzero(start[:len(best)] < size[:len(best)])
        commit(left, size[left])
        return out

    @staticmethod
    def _meeting(best: np.ndarray, step: np.ndarray, at: int) -> int:
        """The last boundary that all paths to the positions from ``at`` on have in common."""
        ahead = set((np.flatnonzero(best[at:] > -math.inf) + at).tolist())
        while len(ahead) > 1:
            last = max(ahead)
            ahead.remove(last)
            ahead.add(last - int(step[last]))
        return ahead.pop()

    def _outside(self, char: int, span: int, place: int) -> tuple:
        """The bytes of a character outside the vocabulary, in the eight places that a character has."""
        if not self.pieces.whole:
            return np.array([span]), np.array([place]), np.array([self.pieces.unknown_id])
        data = (SPACE if chr(char) == _LITERAL else chr(char)).encode("utf-8", "replace")
        return np.full(len(data), span), place + np.arange(len(data)), np.array([self.pieces.of_byte[b] for b in data])

    def encode_all(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each begins and the last ends)."""
        number: dict[str, int] = {}
        rows, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            spans = self.spans(text or "")
            counts[i] = len(spans)
            rows.append(np.fromiter([number.setdefault(s, len(number)) for s in spans], np.int32, len(spans)))
        which = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        ids, ends = self.paths(list(number))
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids))
        values = lists.take(pa.array(which)).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(np.diff(ends)[which])])
        bounds = upto[np.concatenate([[0], np.cumsum(counts)])]
        if not self.pieces.whole:  # unknown characters that follow each other are one unknown piece
            again = np.zeros(len(values), bool)
            again[1:] = (values[1:] == self.pieces.unknown_id) & (values[:-1] == self.pieces.unknown_id)
            again[bounds[:-1][bounds[:-1] < len(values)]] = False
            bounds = bounds - np.concatenate([[0], np.cumsum(again)])[bounds]
            values = values[~again]
        return values, bounds

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text spell."""
        spelt = self.table.take(pa.array(ids))
        where = np.frombuffer(spelt.buffers()[1], np.int64)[spelt.offset:spelt.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = spelt.buffers()[2].to_pybytes() if len(ids) and spelt.buffers()[2] is not None else b""
        return [data[a + (data[a:a + 1] == b" " and a < b):b] for a, b in zip(where[bounds[:-1]].tolist(), where[bounds[1:]].tolist())]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a missing or empty one."""
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids that ``encode`` gave, exactly; other ids decode to what their pieces spell."""
        return self.decode_all(np.asarray(ids, np.int32), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """One per worker process, for all its tasks."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Encoder(model_file)
    return _LOADED[model_file]


def _array_type(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType()), False)


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids",
           same: str = "round_trip") -> DataFrame:
    """``docs`` with the ids of each whole text and whether they decode to that very text.

    Missing and empty texts have no ids and are the same if decoded (a missing
    text as empty). Repeated rows have equal ids; an empty table gives no rows;
    columns called as the new ones are replaced. Rows are handled where they are, batch by batch."""
    kept = [c for c in docs.columns if c not in (ids, same)]
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept]
                          + [_array_type(ids), T.StructField(same, T.BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model_file)
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text), TOGETHER):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                values, bounds = pieces.encode_all(texts)
                alike = [b == (t or "").encode("utf-8", "replace") for b, t in zip(pieces.decode_all(values, bounds), texts)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values)), pa.array(alike, pa.bool_())],
                    names=[*kept, ids, same])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text that the ids spell; a missing list decodes to a missing text."""
    kept = [c for c in rows.columns if c != text]
    schema = T.StructType([f for f in rows.schema.fields if f.name in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model_file)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).fill_null([])
            bounds = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            spelt = pieces.decode_all(lists.flatten().to_numpy(zero_copy_only=False), bounds)
            there = batch.column(batch.schema.get_field_index(ids)).is_valid().to_pylist()
            texts = [b.decode("utf-8", "replace") if v else None for b, v in zip(spelt, there)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, text])

    return rows.select(*kept).mapInArrow(run, schema)
