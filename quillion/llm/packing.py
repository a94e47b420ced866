"""Shortest-pack-first packing over the length histogram (operator 3).

Documents are tokenized and cut into pieces of at most a sequence's length. The
histogram of piece lengths, of bounded size, is packed on the driver: lengths
are placed longest first, each into the packs with most room, and what is kept
is counts of equal packs (patterns), never single pieces. Pieces are then
numbered within their length, in parallel, and a piece's number gives its
pattern, the pattern's copy (its sequence) and its place there.

Defined results: a null text is empty and has only the end id; repeated rows
are packed one by one; pieces of equal length are interchangeable, so which of
them gets which place is not defined, but every piece gets one; an empty table
gives an empty table; other columns are ignored, whatever their names; texts of
any length are tokenized whole.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.batches import bound_batches, released, steps
from quillion.llm.cluster import checkpointed, numbered, part_of
from quillion.llm.piece_bpe import PairTable

#: Parts of words whose ids a worker keeps (some 50 MB); the table starts anew when it is full.
KEPT_PARTS = 1 << 18
END_ID = 1

#: A pattern: (length, copies) in the order of placing.
Pattern = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: np.ndarray, room: int) -> list[tuple[int, Pattern]]:
    """``histogram[n]`` pieces of length n (1 to room) as (count, pattern) with the same pieces in all.

    A step either ends a length or uses up a pattern that was open, so there are
    at most a few patterns for each length, however many pieces there are.
    """
    open_packs: dict[int, list[tuple[int, Pattern]]] = {}
    spaces: list[int] = []  # keys of open_packs, sorted
    full: list[tuple[int, Pattern]] = []

    def keep(count: int, pattern: Pattern, space: int) -> None:
        if not count:
            return
        if not space:
            full.append((count, pattern))
            return
        if space not in open_packs:
            open_packs[space] = []
            bisect.insort(spaces, space)
        open_packs[space].append((count, pattern))

    for length in range(room, 0, -1):
        left = int(histogram[length])
        while left:
            if not spaces or spaces[-1] < length:
                # Nothing has room: open packs of as many copies as fit, and one for the rest.
                each = room // length
                keep(left // each, ((length, each),), room - each * length)
                if left % each:
                    keep(1, ((length, left % each),), room - left % each * length)
                break
            space = spaces[-1]
            count, pattern = open_packs[space].pop()
            if not open_packs[space]:
                del open_packs[space]
                spaces.pop()
            taken = min(count, left)
            keep(count - taken, pattern, space)
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            keep(taken, grown, space - length)
            left -= taken
    return full + [x for space in spaces for x in open_packs[space]]


def places(patterns: list[tuple[int, Pattern]], room: int) -> dict[str, np.ndarray]:
    """For runs of piece numbers of a length: where each run starts, and the sequences and offsets that it fills.

    Pieces ``first`` on of ``length`` go to the pattern's sequences from
    ``sequence`` on, ``copies`` to each, from ``offset`` on.
    """
    runs, used, sequence = [], np.zeros(room + 1, np.int64), 0
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            runs.append((length, used[length], sequence, copies, offset))
            used[length] += count * copies
            offset += length * copies
        sequence += count
    runs.sort(key=lambda r: r[:2])
    cols = np.array(runs, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "copies", "offset"), cols, strict=True))


def byte_characters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + others.index(b)) for b in range(256)]


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[start[i] : start[i] + size[i]]`` of all i, one after the other."""
    end = np.cumsum(size)
    return flat[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings, one after the other, and where each begins (and the last ends)."""
    n = len(texts)
    texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    where = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[where[0] : where[-1]], where - where[0]


def strings(data: np.ndarray, start: np.ndarray) -> pa.DictionaryArray:
    """The strings that begin at ``start`` and fill ``data``, each distinct one once."""
    where = np.append(start, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()


class WordIds:
    """Ids of texts by a byte-level vocabulary with word ends, as the tokenizers library gives them.

    The tokenizer drops white space and never joins what stands on both sides
    of it, so a text's ids are those of its runs of other characters. In the
    same way a run's ids are those of the parts that the tokenizer's pattern
    cuts it into. Texts are cut at spaces as one array of bytes, distinct runs
    are told apart by Arrow and cut where the class of their bytes changes;
    runs with an apostrophe are cut by the pattern itself. New parts of a step
    are merged all at once, as the rows of a matrix, the first of them checked against
    the library. A run with characters beyond the Latin letters, or that could
    hold a special token, goes to the library whole. Ids of parts stand in one
    array, from which those of runs, then of texts, are gathered.
    """

    #: The pattern in the tokenizer's file; letters and digits are those below U+0250.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    #: Latin characters that Arrow, Python and the tokenizer class and lower alike; numerals such as ² are not among them.
    PLAIN = "^[!-;=-~À-ÖØ-öø-ĭĲ-ƺǍ-ɏ]+$"
    LONG = 64
    ROWS = 1 << 13
    #: New parts of each step that are held against the library.
    CHECKED = 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(*np.array([(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)], np.int64).T)
        self.inner = np.array([vocab[c] for c in byte_characters()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_characters()], np.int32)
        #: 0 for bytes of letters, 1 for digits, 2 for what else a plain run holds.
        self.kind = np.full(256, 2, np.uint8)
        self.kind[128:] = self.kind[97:123] = 0
        self.kind[48:58] = 1
        self.forget()

    def forget(self) -> None:
        """Empties the table of parts."""
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.size: list[np.ndarray] = [np.zeros(0, np.int64)]

    def _merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of at most LONG characters, one after the other, and their numbers."""
        raw = [p.encode() for p in parts]
        order = sorted(range(len(parts)), key=lambda i: len(raw[i]))
        found, sizes = [], []
        for at in range(0, len(order), self.ROWS):
            rows = order[at : at + self.ROWS]
            size = np.array([len(raw[i]) for i in rows])
            inside = np.arange(int(size.max())) < size[:, None]
            symbols = np.full(inside.shape, -1, np.int32)
            symbols[inside] = self.inner[np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8)]
            symbols[np.arange(len(rows)), size - 1] = self.last[[raw[i][-1] for i in rows]]
            symbols, _, size = self.pairs.merge(symbols, size)
            found.append(symbols[np.arange(symbols.shape[1]) < size[:, None]].astype(np.uint32))
            sizes.append(size)
        size, place = np.concatenate(sizes), np.argsort(order)
        start = np.cumsum(size) - size
        return gathered(np.concatenate(found), start[place], size[place]), size[place]

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _keep(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.known |= zip(names, range(len(self.known), len(self.known) + len(names)), strict=True)
        self.ids.append(ids)
        self.size.append(size)

    def _learn(self, parts: list[str], runs: list[str]) -> None:
        """Puts new parts, and runs that are not cut (known with a space in front), into the table."""
        new = list(dict.fromkeys(itertools.filterfalse(self.known.__contains__, parts)))
        if short := [p for p in new if len(p) <= self.LONG]:
            ids, size = self._merge(short)
            asked, sizes = self._by_library(short[: self.CHECKED])
            if not np.array_equal(size[: len(sizes)], sizes) or not np.array_equal(ids[: len(asked)], asked):
                raise RuntimeError("parts of words are not encoded as by the library")
            self._keep(short, ids, size)
        if long := [p for p in new if len(p) > self.LONG]:
            self._keep(long, *self._by_library(long))
        if runs := [r for r in dict.fromkeys(runs) if " " + r not in self.known]:
            self._keep([" " + r for r in runs], *self._by_library(runs))

    def _rows(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The table's rows that the distinct runs are made of, one run after the other, and their numbers."""
        plain = pc.match_substring_regex(runs, self.PLAIN).to_numpy(zero_copy_only=False)
        simple = plain & ~pc.match_substring(runs, "'").to_numpy(zero_copy_only=False)
        data, where = bytes_of(pc.utf8_lower(runs.filter(pa.array(simple))))
        kind = self.kind[data]
        cut = np.ones(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        cut[where[:-1]] = True
        start = np.flatnonzero(cut)
        parts = strings(data, start)
        names, other = parts.dictionary.to_pylist(), np.flatnonzero(~simple)
        special = [(self.PARTS.findall(r.lower()) if p else [" " + r]) for r, p in zip(runs.take(pa.array(other)).to_pylist(), plain[other].tolist(), strict=True)]
        listed = [x for each in special for x in each]
        self._learn(names + [x for x in listed if x[0] != " "], [x[1:] for x in listed if x[0] == " "])
        known = self.known
        rows = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[parts.indices.to_numpy()]
        rows = np.concatenate([rows, np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))])
        # Rows of simple runs come first, then those of the others; a run's are found by where they start.
        count = np.zeros(len(runs), np.int64)
        count[simple] = np.diff(np.searchsorted(start, where))
        count[other] = [len(x) for x in special]
        order = np.concatenate([np.flatnonzero(simple), other])
        begin = np.zeros(len(runs), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return gathered(rows, begin, count), count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after the other, and where each text's begin (and the last ends)."""
        if len(self.known) > KEPT_PARTS:
            self.forget()
        data, where = bytes_of(pc.fill_null(texts, ""))
        inside = (data != 32) & (data != 10)
        first = inside.copy()
        edge = np.zeros(len(data) + 1, bool)
        edge[where] = True
        first[1:] &= ~inside[:-1] | edge[1:-1]
        start = np.flatnonzero(first)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        runs = strings(data[inside], np.cumsum(inside)[start] - 1)
        rows, count = self._rows(runs.dictionary)
        self.ids, self.size = [np.concatenate(self.ids)], [np.concatenate(self.size)]
        flat, size = self.ids[0], self.size[0]
        ids = gathered(flat, (np.cumsum(size) - size)[rows], size[rows])  # of the distinct runs
        # A run's ids end where those of its last row do; every run has a row.
        size = np.add.reduceat(size[rows], np.cumsum(count) - count)
        at = runs.indices.to_numpy()
        ends = np.append(0, np.cumsum(size[at]))
        return gathered(ids, (np.cumsum(size) - size)[at], size[at]), ends[np.searchsorted(start, where)]


_words: dict[str, WordIds] = {}

PIECES = "start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, room: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of every piece: the first pieces of a document are full, the last is the rest."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(PIECES + (", ids binary" if keep_ids else ""))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = WordIds(path)
        for batch in batches:
            for part in steps(batch, 1):
                ids, where = _words[path].encode(part.column(1))
                ids = np.insert(ids, where[1:], END_ID).astype("<u4")
                where = where + np.arange(len(where))
                n = np.diff(where)
                of = -(-n // room)  # pieces of each text
                at = np.repeat(np.arange(len(n)), of)
                start = room * (np.arange(len(at)) - np.repeat(np.cumsum(of) - of, of))
                length = np.minimum(n[at] - start, room)
                begin = where[at] + start
                raw = [ids[b : b + k].tobytes() for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
                cols = [part.column(0).take(pa.array(at)), pa.array(start), pa.array(length.astype(np.int32)), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(n[at])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * keep_ids, names=schema.names)

    def forget() -> None:
        _words[path].forget()

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run, forget), schema).withColumnRenamed("id", id_col)


def _placer(table: dict[str, np.ndarray], schema: T.StructType):
    # (length, number) as one sorted key; numbers stay below 2**50.
    key = (table["length"] << 50) + table["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column("length").to_numpy().astype(np.int64), b.column("number").to_numpy()
            r = np.searchsorted(key, (length << 50) + number, "right") - 1
            nth = number - table["first"][r]
            sequence = table["sequence"][r] + nth // table["copies"][r]
            offset = table["offset"][r] + nth % table["copies"][r] * length
            cols = {n: b.column(n) for n in b.schema.names if n != "number"} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([cols[n] for n in schema.names], names=schema.names)

    return run


def pack(cut: DataFrame, room: int) -> DataFrame:
    """``cut`` (length of 1 to room, any other columns but number, sequence_id, offset and part) with sequence_id and offset."""
    cut = checkpointed(cut.withColumn("part", part_of(*[F.col(c) for c in cut.columns if c != "ids"])))
    histogram = np.zeros(room + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``room`` rows
        histogram[length] = n
    table = places(shortest_pack_first(histogram, room), room)
    order = [F.col(c) for c in cut.columns if c not in ("length", "part", "ids")]
    ranked = numbered(cut, ["length"], "part", order or [F.lit(0)], "number")
    kept = [f for f in ranked.schema if f.name != "number"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_placer(table, schema), schema)


def pack_documents(docs: DataFrame, path: str, room: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset) of every piece."""
    # Inside, the id has a name of its own, so that any column can serve as id.
    cut = pieces(docs, path, room, id_col, text_col, keep_ids).withColumnRenamed(id_col, "__id")
    names = ["start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids, "sequence_id", "offset"]
    return pack(cut, room).select(F.col("__id").alias(id_col), *[F.col(n).cast("long") if n != "ids" else F.col(n) for n in names])
