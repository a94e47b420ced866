"""Merge-type SentencePiece vocabularies: a score-ordered agenda of adjacent symbol pairs, and its decoding.

The vocabulary file is read by the sentencepiece library; encoding and decoding
are done here. A text is escaped (each space becomes U+2581, one more is put in
front), and cut into units at places that no piece spans: before U+2581 that
follows something else, and before a line end if no piece holds one. Merges
cannot cross such a place, so units are encoded one by one, and the distinct
ones are kept in a bounded table.

New units are encoded many at once: each is a row of a matrix of symbols with
its agenda, the ranks of its adjacent pairs; in every round each row merges its
best pair, the leftmost of equal ones. Very long units go through a heap.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np

SPACE = "▁"

#: Distinct units kept by a worker; the table starts anew when it is full.
KEPT_UNITS = 1 << 19
#: Longer units are not kept beyond their Arrow batch, and go through the heap.
LONG = 64
#: Rows of one matrix of symbols.
ROWS = 1 << 14
NONE = np.iinfo(np.int32).max


class PairTable:
    """(a, b) -> (rank, union) for pairs of symbol ids: open addressing, looked up for whole arrays."""

    def __init__(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray, union: np.ndarray):
        bits = max(4, int(len(a) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.union = np.zeros(1 << bits, np.int32)
        key = a.astype(np.int64) << 32 | b
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.rank[slot[put]], self.union[slot[put]] = key[put], rank[put], union[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair does not merge) and union of each pair."""
        shape = a.shape
        key = (a.astype(np.int64) << 32 | b).ravel()
        slot = self._slot(key)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            open_ = open_[(self.keys[slot[open_]] != key[open_]) & (self.keys[slot[open_]] != -1)]
        return self.rank[slot].reshape(shape), self.union[slot].reshape(shape)

    def merge(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, their widths in characters, and their number in each row, when no pair is left to merge."""
        symbols, size = symbols.copy(), size.copy()
        width = np.where(symbols >= 0, 1, 0).astype(np.int32)
        end_symbols, end_width = symbols.copy(), width.copy()
        rank, union = self._ranked(symbols)
        alive = np.arange(len(symbols))
        while len(alive):
            best = rank.argmin(1)
            row = np.arange(len(alive))
            going = rank[row, best] != NONE
            if not going.all():
                done = alive[~going]
                end_symbols[done, : symbols.shape[1]], end_width[done, : symbols.shape[1]] = symbols[~going], width[~going]
                end_symbols[done, symbols.shape[1] :], end_width[done, symbols.shape[1] :] = -1, 0
                alive, symbols, width, rank, union, best = (x[going] for x in (alive, symbols, width, rank, union, best))
                if not len(alive):
                    break
                row = np.arange(len(alive))
            # The pair becomes its union; what follows moves up by one.
            symbols[row, best] = union[row, best]
            width[row, best] += width[row, best + 1]
            size[alive] -= 1
            cols = np.arange(symbols.shape[1] - 1)
            move = cols + (cols > best[:, None])
            symbols, width = np.take_along_axis(symbols, move, 1), np.take_along_axis(width, move, 1)
            if symbols.shape[1] == 1:
                end_symbols[alive, 0], end_width[alive, 0] = symbols[:, 0], width[:, 0]
                end_symbols[alive, 1:], end_width[alive, 1:] = -1, 0
                break
            cols = cols[:-1]
            move = cols + (cols > best[:, None])
            rank, union = np.take_along_axis(rank, move, 1), np.take_along_axis(union, move, 1)
            # A row that was full ends one earlier now: its last column is past the end.
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < rank.shape[1]))
                r, c = row[ok], at[ok]
                rank[r, c], union[r, c] = self._pair(symbols[r, c], symbols[r, c + 1])
        return end_symbols, end_width, size

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, union = self.find(np.maximum(a, 0), np.maximum(b, 0))
        return np.where((a >= 0) & (b >= 0), rank, NONE), union

    def _ranked(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if symbols.shape[1] == 1:
            return np.full(symbols.shape, NONE, np.int32), np.zeros(symbols.shape, np.int32)
        return self._pair(symbols[:, :-1], symbols[:, 1:])


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        ids = range(lib.get_piece_size())
        self.text = [lib.id_to_piece(i) for i in ids]
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in ids:
            if lib.is_byte(i):
                b = int(self.text[i][3:5], 16)
                self.byte_ids[b], self.byte_of[i] = i, b
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[self.text[i]], self.score[self.text[i]] = i, lib.get_score(i)
        if len(self.byte_of) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        longer = [p for p in self.ids if len(p) > 1]
        self.longest = max(map(len, longer), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece holds a space after another character: segments cannot be told apart")
        inside = set("".join(longer))
        #: Whether a line end is always a place to cut.
        self.line_cut = "\n" not in inside
        self._cuts = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*" if self.line_cut else f"{SPACE}+[^{SPACE}]*", re.DOTALL)
        # Symbols are pieces, characters of pieces that are no pieces themselves, and one for all other characters.
        chars = sorted(inside - self.ids.keys())
        symbol = self.ids | {c: len(self.text) + i for i, c in enumerate(chars)}
        self.other = len(self.text) + len(chars)
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = [(symbol[p[:k]], symbol[p[k:]], order[self.score[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.pairs = PairTable(*np.array(pairs, np.int64).T)

    def cut(self, text: str) -> list[str]:
        """The units of a whole text, by name: a unit's characters, without U+2581 where that is one and stands in front."""
        if not text:
            return []
        if not self.line_cut or SPACE in text or "  " in text or text[0] == " ":
            return self._cuts.findall(SPACE + text.replace(" ", SPACE))
        # A line end belongs to the word after it; a single space that ends a line or the text leaves an empty name.
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def escaped(unit: str) -> str:
        return unit if unit[:1] in (SPACE, "\n") and unit else SPACE + unit

    def merge(self, segment: str) -> list[str]:
        """The agenda: the adjacent pair whose union scores highest is merged first, of equal ones the leftmost."""
        n = len(segment)
        symbols = list(segment)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        score, agenda = self.score, []
        for i in range(n - 1):
            if (s := score.get(segment[i : i + 2])) is not None:
                agenda.append((-s, i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has been merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
            for a, b in ((left[i], i), (i, after)):
                if a >= 0 and b >= 0 and (s := score.get(symbols[a] + symbols[b])) is not None:
                    heapq.heappush(agenda, (-s, a, b, len(symbols[a]) + len(symbols[b])))
        return [s for s in symbols if s]

    def piece_ids(self, symbol: str) -> list[int]:
        """A piece's id, or the ids of its UTF-8 bytes where the vocabulary lacks it."""
        i = self.ids.get(symbol)
        return [i] if i is not None else [self.byte_ids[b] for b in symbol.encode()]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit."""
        out: list[list[int]] = [[]] * len(units)
        text = [self.escaped(u) for u in units]
        short = [i for i, t in enumerate(text) if len(t) <= LONG]
        for i in set(range(len(units))).difference(short):
            out[i] = [x for s in self.merge(text[i]) for x in self.piece_ids(s)]
        short.sort(key=lambda i: len(text[i]))  # rows of a matrix are then about equally long
        for at in range(0, len(short), ROWS):
            rows = short[at : at + ROWS]
            for i, ids in zip(rows, self._merge_rows([text[i] for i in rows]), strict=True):
                out[i] = ids
        return out

    def matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, symbols (-1 beyond the end) and lengths of short texts, a row each."""
        size = np.array([len(t) for t in texts])
        width = int(size.max(initial=1))
        inside = np.arange(width) < size[:, None]
        points = np.zeros(inside.shape, np.int64)
        points[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return points, np.where(inside, self.symbol_of[points], -1), size

    def merged(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.pairs.merge(symbols, size)

    def _merge_rows(self, texts: list[str]) -> list[list[int]]:
        _, symbols, size = self.matrix(texts)
        symbols, width, size = self.merged(symbols, size)
        rows = [r[:n] for r, n in zip(symbols.tolist(), size.tolist(), strict=True)]
        for i in np.flatnonzero((symbols >= len(self.text)).any(1)):  # characters that are spelled in bytes
            ends = np.cumsum(width[i])
            rows[i] = [x for s, w, e in zip(rows[i], width[i], ends, strict=False) for x in ([s] if s < len(self.text) else self.piece_ids(texts[i][e - w : e]))]
        return rows

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_units(self.cut(text)) for i in ids]

    def decode_unit(self, ids: list[int]) -> str:
        """Text of a run of ids: bytes are gathered until another piece comes; bytes that are no UTF-8 become U+FFFD."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if i >= 0:
                out.append(self.text[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_unit(ids).removeprefix(" ")

    def check_units(self, units: list[str], ids: list[list[int]], decoded: list[str] | None = None) -> None:
        """Raises unless the library gives the same ids (and texts) for these units."""
        head = self.piece_ids(SPACE)
        asked = [u if u[:1] != SPACE else u[1:] for u in units]
        # The library puts U+2581 in front also of a line end. It has nothing to say of U+2581 alone.
        got = [g[len(head) * (u[:1] == "\n") :] if a else head for u, a, g in zip(units, asked, self.library.encode(asked, num_threads=1), strict=True)]
        for u, a, b in zip(units, ids, got, strict=True):
            if a != b:
                raise RuntimeError(f"unit {u!r}: encoded as {a}, by the library as {b}")
        if decoded is not None:
            for u, a, b in zip(units, decoded, self.library.decode([head + x for x in ids], num_threads=1), strict=True):
                if a != b:
                    raise RuntimeError(f"unit {u!r}: decoded as {a!r}, by the library as {b!r}")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """One model for each worker process."""
    return PieceModel(path)
