"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice of a text has a state at every character boundary and an edge for every piece.
Each state keeps one backpointer, so only the last ``longest piece`` states can still be
extended: they are the window.  Whenever the backpointer paths of all states in the window
meet in one boundary, the ids up to it are final; they are emitted and the states dropped, so
memory does not grow with the text.

Two kinds of model, as the model file says:

* unigram: a state's backpointer is the edge of the best sum of log probabilities;
* BPE: a state's backpointer is the one edge that is *valid* after the state it comes from.
  Two neighbouring pieces are valid when merging their joined text gives these two pieces
  again, and a sequence is the BPE encoding exactly when all neighbours are valid, so one path
  survives at each state and ids equal the library's.  (Summing a BPE model's scores, which are
  merge ranks, would not give them.)

A pair of characters that stands inside no piece is a boundary on every path.  Texts are cut
there, and the ids of a cut part are remembered (at most ``limit`` words and as many segments).

Defined cases: null is encoded like an empty text (no ids); characters without a piece become
byte pieces, or the unknown id where the model has none; U+2581 counts as a space, as in the
library, so it decodes to one; decoding removes the added first space.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_worker_cache, fresh_name, worker_cache

SPACE = "▁"
_START = (1 << 31) - 1  # number of the text's start
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6


class _Lengths(dict):
    """Lengths of the pieces (and of a lone character) that can end in given last characters."""

    def __init__(self, score):
        ends: dict[str, set[int]] = {}
        for p in score:
            ends.setdefault(p[-3:], set()).add(len(p))
        self.ends = ends

    def __missing__(self, suffix: str) -> tuple[int, ...]:
        found = {1} | {n for k in (1, 2) for n in self.ends.get(suffix[-k:], ()) if n == k <= len(suffix)}
        if len(suffix) == 3:
            found |= self.ends.get(suffix, set())
        self[suffix] = out = tuple(sorted(found, reverse=True))
        return out


class PieceModel:
    """Pieces, scores and kind of a SentencePiece model with identity normalisation."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: str, add_prefix: bool = True):
        self.kind, self.add_prefix = kind, add_prefix
        self.pieces = pieces
        self.score = {p: s for p, s, t in pieces if t == _NORMAL}
        self.id_of = {p: i for i, (p, _, t) in enumerate(pieces) if t == _NORMAL}
        self.bytes_of = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == _UNKNOWN), 0)
        self.longest = max((len(p) for p in self.score), default=1)
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self.inside = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        self.lengths = _Lengths(self.score)
        self.numbers = {p: i for i, p in enumerate(self.score)}  # pieces, then unknown characters met
        self.known: dict[int, bool] = {}                         # of valid()

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        if m.trainer_spec.model_type not in (1, 2) or any(p.type in (_USER, _UNUSED) for p in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        return cls([(p.piece, p.score, p.type) for p in m.pieces],
                   "bpe" if m.trainer_spec.model_type == 2 else "unigram", m.normalizer_spec.add_dummy_prefix)

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: join the best-scoring neighbours, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def number(self, piece: str) -> int:
        return self.numbers.setdefault(piece, len(self.numbers))

    def valid(self, left: str, right: str) -> bool:
        """May ``right`` follow ``left`` ('' at the start) in a BPE encoding?"""
        if left and left[-1] + right[0] not in self.inside:
            return self.merge(left) == [left] and self.merge(right) == [right]
        return self.merge(left + right) == ([left, right] if left else [right])

    def ids(self, piece: str) -> list[int]:
        known = self.id_of.get(piece)
        if known is not None:
            return [known]
        if self.bytes_of:
            return [self.bytes_of[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]


class Lattice:
    """Streaming pass over one stretch of text: ``feed`` characters, take committed pieces."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.text = ""               # characters from the last committed boundary on
        self.back = [0]              # length of the last piece of the path to each boundary
        self.best = [0.0]
        self.last = [_START]         # BPE: number of that piece
        self.left = ""               # last committed piece
        self.widest = 0

    def _bpe_edges(self, first: int) -> None:
        """For each new boundary the one piece that is valid after the path to its start."""
        m, text, back, last = self.m, self.text, self.back, self.last
        numbers, known, lengths = m.numbers, m.known, m.lengths
        for i in range(first, len(text) + 1):
            for n in lengths[text[i - 3 if i > 3 else 0:i]]:
                if n > i:
                    continue
                piece = text[i - n:i]
                number = numbers.get(piece)
                if number is None:
                    if n > 1:
                        continue
                    number = m.number(piece)
                left = last[i - n]
                ok = known.get(left << 32 | number)
                if ok is None:
                    j = i - n
                    ok = m.valid(text[j - back[j]:j] if j else self.left, piece)
                    if len(known) < 500_000:
                        known[left << 32 | number] = ok
                if ok:
                    back.append(n)
                    last.append(number)
                    break
            else:
                raise AssertionError("no valid piece")  # cannot happen: every prefix has an encoding

    def _unigram_edges(self, first: int) -> None:
        """For each new boundary the piece with the best sum of scores; the longest of equals."""
        m, text, total = self.m, self.text, self.best
        for i in range(first, len(text) + 1):
            best, take = None, 1
            for n in m.lengths[text[i - 3 if i > 3 else 0:i]]:
                if n > i:
                    continue
                s = m.score.get(text[i - n:i], m.unknown_score if n == 1 else None)
                if s is not None and (best is None or total[i - n] + s > best):
                    best, take = total[i - n] + s, n
            self.back.append(take)
            total.append(best)

    def feed(self, chars: str) -> list[str]:
        """Add characters; return the pieces that have become final."""
        out, at = [], 0
        full = 4 * self.m.longest
        extend = self._bpe_edges if self.m.kind == "bpe" else self._unigram_edges
        while at < len(chars):
            n = len(self.text)
            more = chars[at:at + max(1, full - n)]
            at += len(more)
            self.text += more
            extend(n + 1)
            if len(self.text) >= full:
                self.widest = max(self.widest, len(self.text))
                out += self._commit(len(self.text) - self.m.longest + 1)
        return out

    def _path(self, i: int) -> list[int]:
        path = [i]
        while i:
            i -= self.back[i]
            path.append(i)
        return path

    def _commit(self, first: int) -> list[str]:
        """Commit up to the last boundary that the paths of all states from ``first`` on share."""
        n = len(self.text)
        shared = set(self._path(n))
        for i in range(first, n):
            shared &= set(self._path(i))
            if len(shared) == 1:
                break
        return self._take(max(shared))

    def _take(self, to: int) -> list[str]:
        cuts = self._path(to)[::-1]
        pieces = [self.text[a:b] for a, b in zip(cuts, cuts[1:])]
        if pieces:
            self.left = pieces[-1]
            self.text, self.back = self.text[to:], self.back[to:]
            if self.m.kind == "bpe":
                self.last = self.last[to:]
            else:
                self.best = [b - self.best[to] for b in self.best[to:]]
            self.back[0] = 0
        return pieces

    def finish(self) -> list[str]:
        return self._take(len(self.text))


class _Parts(dict):
    """Ids (as bytes) of remembered parts of texts."""

    def __init__(self, coder: "Coder", prefix: str):
        self.coder, self.prefix = coder, prefix

    def __missing__(self, part: str) -> bytes:
        out = self.coder.stretch(self.prefix + part)
        if len(self) < self.coder.limit and len(part) <= 48:
            self[part] = out
        return out


class Coder:
    """Encodes and decodes texts with one model."""

    def __init__(self, model: PieceModel, limit: int = 1_000_000):
        self.model, self.limit = model, limit
        self.words = _Parts(self, SPACE)
        self.segments: dict[str, bytes] = {}
        self.apart = not any(x[1] == SPACE != x[0] for x in model.inside)  # always cut before a space
        self.raw = [bytes([int(p[3:5], 16)]) if t == _BYTE else b"" if t not in (_NORMAL, _USER, _UNUSED)
                    else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p, _, t in model.pieces]

    def stretch(self, text: str) -> bytes:
        """Ids of a normalised text, cut at the boundaries that every path has."""
        inside, out, a = self.model.inside, [], 0
        for i, (x, y) in enumerate(zip(text, text[1:]), 1):
            if x + y not in inside:
                out.append(self._segment(text[a:i]))
                a = i
        out.append(self._segment(text[a:]))
        return b"".join(out)

    def _segment(self, text: str) -> bytes:
        known = self.segments.get(text)
        if known is None:
            lattice = Lattice(self.model)
            pieces = lattice.feed(text) + lattice.finish()
            known = np.array([i for p in pieces for i in self.model.ids(p)], "<i4").tobytes()
            if len(self.segments) < self.limit and len(text) <= 32:
                self.segments[text] = known
        return known

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        text = text.replace(SPACE, " ")
        if self.model.add_prefix and self.apart and "  " not in text and text[0] != " ":
            raw = b"".join(map(self.words.__getitem__, text.split(" ")))
        else:
            text = text.replace(" ", SPACE)
            raw = self.stretch(SPACE + text if self.model.add_prefix else text)
        return np.frombuffer(raw, "<i4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.add_prefix and text[:1] == " " else text


def with_ids(docs: DataFrame, text_col: str, model_path: str, *, out: str = "ids", only: tuple[str, ...] | None = None,
             digests: bool = False, limit: int = 1_000_000, keep_memo: bool = True) -> DataFrame:
    """``only`` columns (default all) plus ``out`` (array of ids); with ``digests``, instead of the
    ids: n_tokens, ids_crc32 (ids as little-endian 32-bit integers), decoded_chars, round_trip.

    ``limit`` bounds the remembered words; ``keep_memo`` keeps them in the worker between tasks."""
    keep = list(docs.columns if only is None else only)
    plain = fresh_name(docs, "_text")
    staged = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias(plain))
    at = len(keep)
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
             T.StructField("decoded_chars", T.LongType()), T.StructField("round_trip", T.BooleanType())] if digests \
        else [T.StructField(out, T.ArrayType(T.IntegerType()))]
    schema = T.StructType(staged.schema.fields[:at] + extra)

    def run(batches):
        if keep_memo:
            yield from coded(batches, worker_cache(("pieces", model_path, limit), lambda: Coder(PieceModel.load(model_path), limit)))
        else:
            yield from coded(batches, Coder(PieceModel.load(model_path), limit))
            free_worker_cache()

    def coded(batches, coder):
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = batch.column(at).to_pylist()
                ids = [coder.encode(t) for t in texts]
                if digests:
                    back = [coder.decode(x) for x in ids]
                    cols = [pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                            pa.array([len(b) for b in back], pa.int64()),
                            pa.array([b == (t or "") for b, t in zip(back, texts)], pa.bool_())]
                else:
                    edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    cols = [pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(at)] + cols,
                                                 names=[*batch.schema.names[:at], *[f.name for f in extra]])

    return staged.mapInArrow(run, schema)


def decoded(rows: DataFrame, ids_col: str, model_path: str, *, out: str = "text") -> DataFrame:
    """All columns plus the decoded text."""
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.StringType())])
    at = rows.columns.index(ids_col)

    def run(batches):
        coder = worker_cache(("pieces", model_path, 0), lambda: Coder(PieceModel.load(model_path), 0))
        for batch in batches:
            col = [None if x is None else coder.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(col, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)
