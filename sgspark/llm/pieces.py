"""Exact encoding with a merge-type sentencepiece vocabulary by backtracking, and decoding.

Merging starts from characters and joins, again and again, the neighbours whose union is the piece of the highest score
(the leftmost of equal ones). A sequence of pieces is the result of that if and only if each two neighbours are: merging
their joined text anew must give the two back. So a text is walked from its start:

1. an Aho-Corasick automaton of the pieces gives the longest piece that starts at each place;
2. it is taken if it is compatible with the piece before it, by merging the two anew (remembered by pair), and if it
   doesn't end at a place that has failed; else the next shorter piece that starts there is tried;
3. if none is left, the place is marked in a bit field of failed places and the walk goes back a piece. The pieces before
   a place are the only ones that can stand there, so a failed place fails for good, and the walk is linear.

Pieces that merging never makes (their own text merges to something else) are left out. Characters without a piece
become their bytes, or the unknown id where the vocabulary has no byte pieces. Characters that no chain of pieces connects
are never merged, so texts are cut between them and before runs of space marks; short cuts are remembered by a worker.

Null and empty texts encode to the end id alone and decode to an empty text. Texts of any length are encoded whole; a
row, with its ids, has to fit a worker. Repeated rows are repeated, no rows give no rows, and columns of the input that
share the operator's names are replaced. The model's file is read by the driver (its size is checked) and broadcast.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sgspark.llm.runtime import map_arrow
from sgspark.llm.tokens import vocabulary

MARK = "▁"
#: Cuts of a text (twice as many, for those in use before) and pairs of pieces that a worker remembers at most, and the longest remembered cut.
CUTS, PAIRS, CUT_LENGTH = 400_000, 1_000_000, 32
#: Texts encoded at a time.
BATCH = 64


def _cuts(joins: set[str]) -> str:
    """A pattern of parts of a text that are never merged with each other: space marks, then characters of one component
    of the graph of those that stand side by side (joins) in a piece. Where pieces have marks elsewhere than at their start,
    these are all characters of joins."""
    if any(x[1] == MARK != x[0] for x in joins):
        return f"[{re.escape(''.join(sorted({c for x in joins for c in x})))}]+|."
    root: dict[str, str] = {}

    def top(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    for a, b in joins:
        if a != MARK:
            root[top(a)] = top(b)
    kinds: dict[str, list[str]] = {}
    for c in sorted(root):
        kinds.setdefault(top(c), []).append(c)
    of_kind = [f"[{re.escape(''.join(x))}]+" for x in sorted(kinds.values(), key=len, reverse=True)]
    return f"{MARK}*+(?:{'|'.join([*of_kind, f'[^{MARK}]'])})|{MARK}+"


class Pieces:
    """The pieces of a model and what encoding has found out about them so far."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        if proto.trainer_spec.model_type != 2 or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("not a merge-type model, or one with user-defined or unused pieces")
        self.model = SentencePieceProcessor(model_proto=model)
        self.unknown, self.end = self.model.unk_id(), self.model.eos_id()
        self.fallback = proto.trainer_spec.byte_fallback
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if self.fallback else []
        self.text = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1 and self.merged(p.piece) == [p.piece]}
        # characters that occur in pieces only stand for themselves until they are merged
        for c in sorted({c for p in self.score for c in p} - set(self.id)):
            self.id[c] = len(self.text)
            self.text.append(c)
        self.size = [len(t) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if len(piece) > 1:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.plain = self.score.keys() >= self.id.keys()
        self.cuts = re.compile(_cuts({p[k : k + 2] for p in self.score for k in range(len(p) - 1)}), re.DOTALL)
        self._next: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._end = array("i", [self.end]).tobytes()

    def merged(self, text: str) -> list[str]:
        """The text's characters merged by score, as the definition says; for short texts."""
        parts = list(text)
        scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while any(s is not None for s in scores):
            best = max(s for s in scores if s is not None)
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            for k in (at - 1, at):
                if 0 <= k < len(scores):
                    scores[k] = self.score.get(parts[k] + parts[k + 1])
        return parts

    def shorter(self, i: int) -> int:
        """The longest proper beginning of piece i that merging makes; -1: none."""
        found = self._next.get(i)
        if found is None:
            found = self._next[i] = next((self.id[t] for n in range(self.size[i] - 1, 0, -1) if (t := self.text[i][:n]) in self.id), -1)
        return found

    def compatible(self, i: int, j: int) -> bool:
        """Whether merging the text of two pieces gives the two."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        found = self._pairs[i << 32 | j] = self.merged(self.text[i] + self.text[j]) == [self.text[i], self.text[j]]
        return found

    def walked(self, text: str) -> list[int]:
        """Pieces of a text, each of whose characters has one, by backtracking."""
        n, size, pairs = len(text), self.size, self._pairs
        longest = [self.id[c] for c in text] if n <= CUT_LENGTH else array("i", map(self.id.__getitem__, text))
        for last, i in self.automaton.iter(text):
            longest[last - size[i] + 1] = i  # later ends are longer
        failed = None  # a bit a place
        out: list[int] = []
        at, before, i = 0, -1, longest[0]
        while True:
            while i >= 0:
                to = at + size[i]
                if failed is None or not failed[to >> 3] >> (to & 7) & 1:
                    if before < 0:
                        break
                    fits = pairs.get(before << 32 | i)
                    if self.compatible(before, i) if fits is None else fits:
                        break
                i = self.shorter(i)
            if i >= 0:
                out.append(i)
                if to == n:
                    return out
                at, before, i = to, i, longest[to]
                continue
            if failed is None:
                failed = bytearray((n >> 3) + 1)
            failed[at >> 3] |= 1 << (at & 7)
            if not out:
                raise RuntimeError("no sequence of pieces is compatible")  # a model whose scores don't order its merges
            i = out.pop()
            at -= size[i]
            before = out[-1] if out else -1
            i = self.shorter(i)

    def _plain(self, text: str) -> bytes:
        """A character that isn't a piece."""
        return np.array([self.bytes[b] for b in text.encode()] if self.fallback else [self.unknown], "<i4").tobytes()

    def _ids(self, text: str) -> bytes:
        """Ids of a cut of a normalised text, 4 bytes each."""
        found = self._older.get(text)
        if found is None:
            own = len(text) if text[-1] in self.id else len(text) - 1  # a character in no piece ends its cut
            made = self.walked(text[:own]) if own else []
            if self.plain:
                found = array("i", made).tobytes()
            else:
                found = b"".join(array("i", [i]).tobytes() if self.text[i] in self.score else self._plain(self.text[i]) for i in made)
            if own < len(text):
                found += self._plain(text[-1])
        if len(text) <= CUT_LENGTH:
            if len(self._known) >= CUTS:
                self._known, self._older = {}, self._known
            self._known[text] = found
        return found

    def encoded(self, text: str) -> np.ndarray:
        """Ids of a text, with the end id."""
        cuts = self.cuts.findall(self.model.normalize(text))
        ids = list(map(self._known.get, cuts))
        if None in ids:
            for k, found in enumerate(ids):
                if found is None:
                    ids[k] = self._known.get(cuts[k]) or self._ids(cuts[k])
        ids.append(self._end)
        out = np.frombuffer(b"".join(ids), "<i4")
        if not self.fallback:  # characters without a piece in a row are one unknown
            unknown = out == self.unknown
            out = out[~(unknown & np.concatenate([[False], unknown[:-1]]))]
        return out

    def decoded(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist()) or ""


_loaded: dict[int, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The pieces of a model, kept for the life of a worker."""
    at = hash(model)
    if at not in _loaded:
        _loaded[at] = Pieces(model)
    return _loaded[at]


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the column ``ids`` (array<int>) of their texts' ids and an end id, and, if named, a column of what these
    decode to, in the same pass."""
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c not in (ids, decoded)]
    schema = StructType([docs.schema[i] for i in kept] + StructType.fromDDL(f"{ids} array<int>" + (f", {decoded} string" if decoded else "")).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                made = [pieces.encoded(t.as_py() or "") for t in part.column(at)]
                offsets = np.cumsum([0, *map(len, made)], dtype=np.int32)
                columns = [*(part.column(i) for i in kept), pa.ListArray.from_arrays(offsets, np.concatenate(made))]
                if decoded:
                    columns.append(pa.array([pieces.decoded(x) for x in made], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_arrow(docs, run, schema)


def decoded(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the column ``text`` of what their ids say; null ids say nothing."""
    from pyspark.sql.types import StructType

    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(path))
    at = rows.columns.index(ids)
    kept = [i for i, c in enumerate(rows.columns) if c != text]
    schema = StructType([rows.schema[i] for i in kept] + StructType.fromDDL(f"{text} string").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                made = pa.array([pieces.decoded(np.asarray(x.as_py() or [], "<i4")) for x in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), made], schema.names)

    return map_arrow(rows, run, schema)
