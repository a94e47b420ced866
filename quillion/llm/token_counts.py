"""Token counts at every prefix (operator 5), for merge-type SentencePiece vocabularies.

For each prefix of a text the dynamic program keeps its last token and its
number of tokens. The last token of a prefix is the one piece, among those that
end there, which does not merge with the last token of the prefix before it;
the count is then that prefix's count plus one. Whether two neighbouring tokens
stay apart is found once for each pair by encoding their union. Texts are cut
into units as for encoding, and the program runs once for each distinct unit,
over many short units at a time, in one pass over each long one.

The counts are stored as one signed byte for each character of the escaped
text: the change from the prefix before. They answer, without encoding again,
how many tokens a truncated text has (:func:`tokens_at`) and how far a text may
go within a budget (:func:`longest_within`).

Defined results: a null or empty text has no tokens and an empty store;
repeated rows are handled one by one; an empty table gives an empty table;
other columns are ignored, whatever their names; texts of any length are
counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillion.llm.batches import keyed_map
from quillion.llm.piece_bpe import KEPT_UNITS, LONG, PairTable, PieceModel, load

#: Pairs of neighbouring tokens whose verdict a worker keeps.
KEPT_PAIRS = 1 << 20
#: Characters of one matrix of units.
AREA = 1 << 18
BASE = np.uint64(0x5851F42D4C957F2D)


def _as_bytes(changes: np.ndarray) -> np.ndarray:
    """Changes as one signed byte each: a vocabulary whose pieces change a count by more cannot be stored so."""
    if changes.size and (changes.min() < -128 or changes.max() > 127):
        raise ValueError("a count changes by more than a signed byte holds")
    return changes.astype(np.int8)


class PrefixCounts:
    """Unit -> (its tokens, change of the count at each of its characters), for the units met so far."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, tuple[int, bytes]] = {}
        self.apart: dict[int, bool] = {}
        self.power = np.array([pow(int(BASE), k, 1 << 64) for k in range(model.longest + 1)], np.uint64)
        self.names = [*model.text, *[""] * (model.other - len(model.text) + 1)]
        for point in np.flatnonzero((model.symbol_of >= len(model.text)) & (model.symbol_of < model.other)):
            self.names[model.symbol_of[point]] = chr(point)
        pieces = [(p, i) for p, i in model.ids.items() if len(p) > 1]
        ids = np.array([i for _, i in pieces], np.int64)
        points, symbols, size = model.matrix([p for p, _ in pieces])
        keys = self._hashes(points)[np.arange(len(ids)), size]
        self.pieces = PairTable(*self._halves(keys), np.zeros(len(ids), np.int32), ids)
        # Pieces that their own characters merge into: only they can be tokens.
        self.whole = np.ones(model.other + 1, bool)
        self.whole[ids] = model.merged(symbols, size)[2] == 1
        # Beginnings of pieces, with the piece's id where it can be a token.
        self.heads: dict[str, int] = {p[:k]: -1 for p, _ in pieces for k in range(2, len(p) + 1)}
        self.heads |= {p: i for p, i in pieces if self.whole[i]}

    @staticmethod
    def _hashes(points: np.ndarray) -> np.ndarray:
        """Polynomial hash of every prefix of every row, from the empty one on."""
        out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        for i in range(points.shape[1]):
            out[:, i + 1] = out[:, i] * BASE + points[:, i].astype(np.uint64) + np.uint64(1)
        return out

    @staticmethod
    def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def _stay_apart(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the union of two tokens is encoded as these two."""
        keys, back = np.unique(before.astype(np.int64) << 32 | piece, return_inverse=True)
        found = [self.apart.get(k) for k in keys.tolist()]
        if ask := [i for i, f in enumerate(found) if f is None]:
            if len(self.apart) > KEPT_PAIRS:
                self.apart = {}
            a, b = keys[ask] >> 32, keys[ask] & 0xFFFFFFFF
            verdict = np.ones(len(ask), bool)
            both = np.flatnonzero((a != self.model.other) & (b != self.model.other))
            if len(both):
                _, symbols, size = self.model.matrix([self.names[x] + self.names[y] for x, y in zip(a[both], b[both], strict=True)])
                symbols, _, size = self.model.merged(symbols, size)
                verdict[both] = (size == 2) & (symbols[:, 0] == a[both])
            for i, v in zip(ask, verdict.tolist(), strict=True):
                found[i] = v
                self.apart[int(keys[i])] = v
        return np.array(found, bool)[back]

    def prefix_changes(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """Tokens of each escaped text, and the change of the count at each of its characters; the program runs over all texts at once."""
        model = self.model
        points, symbols, size = model.matrix(texts)
        hashes = self._hashes(points)
        spelled = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        last = np.full((len(texts), points.shape[1] + 1), -1, np.int64)
        counts = np.zeros(last.shape, np.int32)
        for end in range(1, points.shape[1] + 1):
            rows = np.flatnonzero(size >= end)
            at, start, piece = [rows], [np.full(len(rows), end - 1)], [symbols[rows, end - 1].astype(np.int64)]
            for k in range(2, min(end, model.longest) + 1):
                there, ids = self.pieces.find(*self._halves(hashes[rows, end] - hashes[rows, end - k] * self.power[k]))
                hit = np.flatnonzero(there == 0)
                at.append(rows[hit])
                start.append(np.full(len(hit), end - k))
                piece.append(ids[hit].astype(np.int64))
            at, start, piece = np.concatenate(at), np.concatenate(start), np.concatenate(piece)
            fits = self.whole[piece]
            inner = np.flatnonzero(fits & (start > 0))
            fits[inner] = self._stay_apart(last[at[inner], start[inner]], piece[inner])
            at, start, piece = at[fits], start[fits], piece[fits]
            if len(at) != len(rows):
                raise RuntimeError("a prefix has no last token, or more than one")
            last[at, end] = piece
            counts[at, end] = counts[at, start] + np.where(piece < len(model.text), 1, spelled[at, end - 1])
        wide = points.shape[1]
        stored = _as_bytes(np.diff(counts, axis=1)).tobytes()
        total = counts[np.arange(len(texts)), size].tolist()
        return [(t, stored[i * wide : i * wide + n]) for i, (t, n) in enumerate(zip(total, size.tolist(), strict=True))]

    def _apart(self, before: int, piece: int) -> bool:
        """As :meth:`_stay_apart`, for one pair."""
        key = before << 32 | piece
        verdict = self.apart.get(key)
        if verdict is None:
            if len(self.apart) > KEPT_PAIRS:
                self.apart = {}
            known = self.model.other not in (before, piece)
            verdict = not known or self.model.merge(self.names[before] + self.names[piece]) == [self.names[before], self.names[piece]]
            self.apart[key] = verdict
        return verdict

    def prefix_changes_of_long(self, text: str) -> tuple[int, bytes]:
        """The same program for one long text: from each prefix, whose last token is known, to those that one piece more ends."""
        model, apart, heads = self.model, self._apart, self.heads
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        symbols = model.symbol_of[points].tolist()
        alone = np.where(model.symbol_of[points] < len(model.text), 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).tolist()
        n = len(text)
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, so_far = last[start], counts[start]
            if start and before < 0:
                raise RuntimeError("a prefix has no last token")
            end, piece = start + 1, symbols[start]
            while True:
                if piece >= 0 and (not start or apart(before, piece)):
                    if last[end] >= 0:
                        raise RuntimeError("a prefix has more than one last token")
                    last[end], counts[end] = piece, so_far + (1 if end > start + 1 else alone[start])
                end += 1
                # None: no piece begins so. -1: some do, but this is none that can be a token.
                if end > n or (piece := heads.get(text[start:end])) is None:
                    break
        return counts[n], _as_bytes(np.diff(np.array(counts, np.int64))).tobytes()

    def learn(self, units: set[str], check: bool) -> dict[str, tuple[int, bytes]]:
        """A table that holds all of ``units``."""
        if len(self.known) > KEPT_UNITS:
            self.known = {}
        new = sorted((u for u in units if u not in self.known), key=len)
        long = [u for u in new if len(u) > LONG]
        found = {u: self.prefix_changes_of_long(self.model.escaped(u)) for u in long}
        end, at = len(new) - len(long), 0
        while at < end:
            rows = new[at:end][: max(1, AREA // (len(new[at]) + 1))]
            while len(rows) > 1 and len(rows) * (len(rows[-1]) + 1) > 2 * AREA:
                rows = rows[: len(rows) // 2]
            at += len(rows)
            found |= zip(rows, self.prefix_changes([self.model.escaped(u) for u in rows]), strict=True)
        if check and new:
            ids = self.model.encode_units(new)
            self.model.check_units(new, ids)
            for u, i in zip(new, ids, strict=True):
                if len(i) != found[u][0]:
                    raise RuntimeError(f"unit {u!r}: {found[u][0]} tokens counted, {len(i)} encoded")
        if long:
            extra = {u: found.pop(u) for u in long}
            self.known |= found
            return self.known | extra
        self.known |= found
        return self.known


_tables: dict[str, PrefixCounts] = {}


def _counter(path: str, check: bool):
    def run(texts: pa.Array) -> dict[str, pa.Array]:
        if path not in _tables:
            _tables[path] = PrefixCounts(load(path))
        prefixes = _tables[path]
        cut = [prefixes.model.cut(t or "") for t in texts.to_pylist()]
        table = prefixes.learn(set().union(*cut), check)
        n_bytes = [t.as_buffer().size if t.is_valid else 0 for t in texts]
        n_tokens, stores = [], []
        for units in cut:
            found = [table[u] for u in units]
            n_tokens.append(sum([f[0] for f in found]))
            stores.append(b"".join([f[1] for f in found]))
        return {"n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "prefix_changes": pa.array(stores, pa.binary())}

    return run


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(id, n_bytes, n_tokens, prefix_changes) of every text. ``check`` holds every new unit against the library."""
    return keyed_map(docs, [id_col], text_col, _counter(path, check), [("n_bytes", "long"), ("n_tokens", "long"), ("prefix_changes", "binary")])


def counts_by_prefix(prefix_changes: bytes) -> np.ndarray:
    """Tokens of text[:0], text[:1], ... text[:len(text)]."""
    if not prefix_changes:
        return np.zeros(1, np.int64)
    counts = np.cumsum(np.frombuffer(prefix_changes, np.int8).astype(np.int64))
    counts[0] = 0  # the space put in front stands alone only for the empty prefix, which has no tokens
    return counts


def tokens_at(prefix_changes: bytes, characters: int) -> int:
    """Tokens of the text cut after so many characters."""
    return int(counts_by_prefix(prefix_changes)[characters])


def longest_within(prefix_changes: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts_by_prefix(prefix_changes) <= budget)[-1])
