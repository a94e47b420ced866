"""N-gram Jaccard join by universe partition and pigeonhole (operator 7).

A document's set holds its distinct shingles of k words. Sizes fall into bands.
For a band, at most H shingles can tell apart two of its linked sets; tokens
are hashed into H + 1 segments. A set's key of a segment is a hash of its
shingles there (a subset); in the first few segments, the zone, it also has the
keys of that subset with any one shingle left out (its one-deletion
neighbourhood). Sharing the subset's key takes 0 differences in the segment,
sharing one of the neighbourhood at most 1: a segment is worth 1, or 2 in the
zone, and linked sets must share a key in segments worth H + 1 together.

Allocation by cost: a key that all its sets keep costs a row for each pair of
them. One that they go without costs a row for each set, and from each a part of
what it can spare, at the price of a set that has spent all: its text is fetched
and compared with others in full (DEAR_COST). The cheaper of the two is taken for
each key, so keys are dropped first where many sets share them and can spare
them. A set that still has segments worth H + 1 does without its dropped, heavy
keys. Of two linked sets it is enough that one can: the pair meets in a cheap
key. Only pairs of sets that both cannot are left; they are compared in blocks,
of which most are ruled out by the shingles that a set shares with no other.

A pair that meets in a cheap key is a candidate if all that it shares, and
could share in heavy keys, is worth as much as linked sets must share. A set is
first held against the smallest of its candidates; what is then in one component
needs no further comparison, the rest are compared across components.
Candidates are verified exactly, on words. Equal texts are one from the start.

Defined results: without words, or for a null text, a set is empty and linked
with nothing, its component is the row's own id; with fewer than k words the
whole sequence is the one shingle; rows with equal texts are linked (if not
empty) whatever their ids; a component's id is the smallest id that is not null
in it, or null; an empty table gives an empty table; other columns are ignored,
whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillion.llm.batches import array_steps, bound_batches, keyed_map, released, steps
from quillion.llm.cluster import checkpointed, written
from quillion.llm.components import components

#: Cost of a set that cannot do without its heavy keys, in rows of pairs: a text of some 1.5 KB against a row of 24 bytes.
DEAR_COST = 64
#: Cost of a row of a heavy key, likewise: it is grouped by segment and by set, joined to the sets that are short and to the pairs. Of 1, 4 and 8, tried on one table, 8 left the fewest sets that are short.
ROW_COST = 8
#: Part of a band's segments that is its zone.
ZONE = 0.05
#: Growth of sizes from band to band.
BAND = 1.5
#: Sets of one block, about, and shingles of all of them: long texts have blocks of fewer sets.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Cells of the matrix of sets and shingles that is multiplied at once (16 MB).
CELLS = 1 << 22
#: Distinct words whose hash a worker keeps.
KEPT_WORDS = 1 << 17
#: Texts that a task remembers to have handled; it may handle later copies again.
KEPT_NODES = 1 << 17
#: Bits of the filter that picks the texts to fetch: fixed, so that it can be sent to all tasks whatever the corpus (1 MB).
PICK_BITS = 23

_MULT = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_hashes = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: ``bytes.lower`` and ``bytes.split`` know just the letters and spaces of ASCII."""
    return (text or "").encode().lower().split()


def node_of(words: list[bytes]) -> bytes:
    """128 bits of a word sequence: the name of all texts that have it."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


#: Bits of a class. Tests take fewer, so that different texts fall into one class.
CLASS_BITS = 64


def class_of(node: bytes, bits: int = CLASS_BITS) -> int:
    """The first bits of a node, which stand for it in keys and pairs. Texts of one class are told apart by node wherever a link or a size depends on it."""
    return int.from_bytes(node[:8], "little", signed=True) >> (64 - bits)


def rest_of(node: bytes) -> int:
    return int.from_bytes(node[8:], "little", signed=True)


def shingle_sets(docs: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document (with a word at least), sorted, one document after the other, and their numbers."""
    if len(_hashes) > KEPT_WORDS:
        _hashes.clear()
    sizes = np.array([len(d) for d in docs])
    flat = np.fromiter((_hashes[w] for d in docs for w in d), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    h = flat.copy()
    for j in range(1, k):
        h[:-j] = h[:-j] * _MULT + flat[j:] if j < len(flat) else h[:-j]
    h = mix(h)
    parts = []
    for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        if n >= k:
            own = h[end - n : end - k + 1]
            own.sort()
            parts.append(own)
        else:
            whole = np.uint64(n)
            for x in flat[end - n : end]:
                whole = np.uint64((int(whole) * int(_MULT) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            parts.append(mix(np.array([whole], np.uint64)))
    many = np.concatenate(parts)
    owner = np.repeat(np.arange(len(docs)), [len(p) for p in parts])
    new = np.ones(len(many), bool)
    new[1:] = (many[1:] != many[:-1]) | (owner[1:] != owner[:-1])
    return many[new], np.bincount(owner[new], minlength=len(docs))


class Bands:
    """Sizes up to ``upper[b]`` are in band b; its segments, zone and difference bound."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        upper = [1]
        while upper[-1] < 1 << 40:
            upper.append(max(upper[-1] + 1, int(upper[-1] * BAND)))
        self.upper = np.array(upper, np.int64)
        #: Differences of linked sets of which the smaller is in the band: (1 - t) / t of its size.
        self.bound = (den - num) * self.upper // num
        self.segments = self.bound + 1
        self.zone = np.ceil(self.segments * ZONE).astype(np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upper, size)

    def spare(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Worth that a set can lose: all segments' worth, less one more than the differences that it can have from a set that signs in the band."""
        # A set that reaches down meets sets of the band; one in its own band also larger ones, which reach down to it.
        most = np.where(size > self.upper[band], self.upper[band], size * self.den // self.num)
        differences = (self.den - self.num) * (size + most) // (self.den + self.num)
        return self.segments[band] + self.zone[band] - differences - 1


# Bits of ``info``: spare 0-19, deletion 20, zone 21, segment 22-47, band 48-55. Rows of a set's size have -1 - size.
_DELETION, _ZONE, _SEGMENT, _BAND_AT = 20, 21, 22, 48
_SPARE = (1 << 20) - 1
#: Kinds of rows that come out of the meeting of keys.
SIZE, PAIR, HEAVY_ROW = 0, 1, 2


def keys_of(shingles: np.ndarray, sizes: np.ndarray, cls: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, info) of every segment of every set, for one band of each set."""
    segments = bands.segments[band]
    base = np.cumsum(segments) - segments
    owner = np.repeat(np.arange(len(sizes)), sizes)
    salt = mix(band.astype(np.uint64) + np.uint64(77))
    segment = (mix(shingles ^ salt[owner]) % segments[owner].astype(np.uint64)).astype(np.int64)
    at = base[owner] + segment
    total = int(segments.sum())
    # Sums of 64-bit hashes modulo 2**64, from halves that stay exact as floats.
    low = np.bincount(at, (shingles & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(at, (shingles >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    subset = low + (high << np.uint64(32))
    of = np.repeat(np.arange(len(sizes)), segments)
    number = np.arange(total) - base[of]
    place = mix(salt[of] + number.astype(np.uint64))
    spare = np.clip(bands.spare(sizes, band), 0, _SPARE)
    zone = number < bands.zone[band][of]
    info = spare[of] | zone.astype(np.int64) << _ZONE | number << _SEGMENT | band[of] << _BAND_AT
    out = [(mix(subset ^ place), cls[of], info)]
    inside = np.flatnonzero(zone[at])
    if len(inside):
        own = at[inside]
        out.append((mix((subset[own] - shingles[inside]) ^ place[own]), cls[of[own]], info[own] | 1 << _DELETION))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signer(k: int, num: int, den: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        names = ["key", "cls", "info"]
        for batch in batches:
            for part in steps(batch, 0):
                docs, nodes = [], []
                if len(seen) > KEPT_NODES:
                    seen.clear()
                for text in part.column(0).to_pylist():
                    words = words_of(text)
                    if words and (node := node_of(words)) not in seen:  # copies near each other sign once
                        seen.add(node)
                        docs.append(words)
                        nodes.append(node)
                if not docs:
                    continue
                shingles, sizes = shingle_sets(docs, k)
                cls = np.array([class_of(n, bits) for n in nodes], np.int64)
                # The row of a set's size has the whole name: its class as key, the rest as class.
                out = [(cls.view(np.uint64), np.array([rest_of(n) for n in nodes], np.int64), -1 - sizes)]
                band = bands.of(sizes)
                # Its own band, and the one below if that may hold a linked set.
                below = np.maximum(band - 1, 0)
                reach = (band > 0) & (-(-num * sizes // den) <= bands.upper[below])
                for b, take in ((band, np.ones(len(docs), bool)), (below, reach)):
                    take = np.flatnonzero(take)
                    if len(take):
                        mask = np.repeat(np.isin(np.arange(len(docs)), take), sizes)
                        out.append(keys_of(shingles[mask], sizes[take], cls[take], b[take], bands))
                key, who, info = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who), pa.array(info)], names=names)

    return run


def signatures(docs: DataFrame, text_col: str, k: int, num: int, den: int, bits: int = CLASS_BITS) -> DataFrame:
    """(key, cls, info): every key of every distinct text of a task, and its set's size."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(released(_signer(k, num, den, bits), _hashes.clear), "key long, cls long, info long")


def most_sets(cost: int, row: int) -> int:
    """A key of more sets is heavy whatever they can spare: half of their number less one, the pairs for each, is more than all that it costs a set to go without."""
    return 2 * (cost + row) + 1


def cheaper_without(info: np.ndarray, start: np.ndarray, size: np.ndarray, cost: int, row: int) -> np.ndarray:
    """Of each key's group of rows, whether going without the key costs less than its pairs do."""
    worth = np.where(info >> _DELETION & 1, 1, 1 + (info >> _ZONE & 1))
    each = row + cost * np.minimum(1, worth / ((info & _SPARE) + 1))
    return size * (size - 1) / 2 > np.add.reduceat(each, start)


def _light_pairs(key: np.ndarray, cls: np.ndarray, info: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, what) of the pairs in cheap keys' groups: a < b; ``what`` has the worth of the segment that they share, the worth that linked ones must share in all, and the band.

    Two deletions that agree say nothing that the pigeonhole needs, and are left
    out, so a pair shares a key of a segment once at most.
    """
    out = []
    for n in range(2, int(size.max(initial=0)) + 1):
        groups = start[size == n]
        if not len(groups):
            continue
        i, j = np.triu_indices(n, 1)
        x, y = (groups[:, None] + i).ravel(), (groups[:, None] + j).ravel()
        deleted = info[x] >> _DELETION & 1, info[y] >> _DELETION & 1
        keep = (deleted[0] & deleted[1]) == 0
        x, y, exact = x[keep], y[keep], ((deleted[0] | deleted[1]) == 0)[keep]
        worth = 1 + (exact & (info[x] >> _ZONE & 1 == 1))
        need = np.maximum(info[x] & _SPARE, info[y] & _SPARE) + 1
        out.append((cls[x], cls[y], worth | need << 2 | (info[x] >> _BAND_AT) << _BAND_AT))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (cls[:0], cls[:0], info[:0])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and class: PAIR rows of cheap keys (a, b: classes), HEAVY_ROW rows of dear ones (a: key, b: class), SIZE rows (a: class, b: rest of the name).

    A key's rows are held until it ends or has more classes than a cheap key can have.
    """

    def batch_of(kind: int, a, b, info) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in (a, b, info)]], names=["kind", "a", "b", "info"])

    held: tuple[np.ndarray, ...] | None = None  # rows of the last key, if it may still be cheap
    dear: int | None = None  # the last key, if it is dear

    def groups(key, cls, info, last: bool):
        nonlocal held, dear
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, info = key[fresh], cls[fresh], info[fresh]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        heavy = (size > most_sets(DEAR_COST, ROW_COST)) | cheaper_without(info, start, size, DEAR_COST, ROW_COST)
        if not last:
            heavy[-1] = size[-1] > most_sets(DEAR_COST, ROW_COST)  # it may have more rows
        if dear is not None and key[0] == dear:
            heavy[0] = True
        held = None
        if not last:
            dear = int(key[-1]) if heavy[-1] else None
            if dear is None:
                held = (key[start[-1] :], cls[start[-1] :], info[start[-1] :])
                start, size, heavy = start[:-1], size[:-1], heavy[:-1]
        rows = np.repeat(heavy, size)
        rows = np.flatnonzero(rows)
        if len(rows):
            yield batch_of(HEAVY_ROW, key[rows], cls[rows], info[rows])
        pairs = _light_pairs(key, cls, info, start[~heavy], size[~heavy])
        for at in range(0, len(pairs[0]), 1 << 18):
            yield batch_of(PAIR, *[p[at : at + (1 << 18)] for p in pairs])

    for b in batches:
        key, cls, info = (c.to_numpy() for c in b.columns)
        sizes = info < 0
        if sizes.any():
            yield batch_of(SIZE, key[sizes], cls[sizes], info[sizes])
            key, cls, info = key[~sizes], cls[~sizes], info[~sizes]
        if not len(key):
            continue
        if held is not None:
            key, cls, info = (np.concatenate(x) for x in zip(held, (key, cls, info), strict=True))
        yield from groups(key, cls, info, last=False)
    if held is not None:
        yield from groups(*held, last=True)


def linked(a: list[bytes], b: list[bytes], k: int, num: int, den: int) -> bool:
    """Whether two texts' shingle sets are similar enough, by words: each distinct word of the two has a number, a shingle's numbers make one."""
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (a, b)]
    base = len(number)
    if base**k >= 1 << 63 or min(len(a), len(b)) < k:
        sets = [set(zip(*[i.tolist()[j:] for j in range(k)], strict=False)) if len(i) >= k else {tuple(i.tolist())} for i in ids]
        both, sizes = len(sets[0] & sets[1]), [len(x) for x in sets]
    else:
        codes = []
        for i in ids:
            code = i[: len(i) - k + 1]
            for j in range(1, k):
                code = code * base + i[j : len(i) - k + 1 + j]
            codes.append(np.unique(code))
        both, sizes = len(np.intersect1d(*codes, assume_unique=True)), [len(c) for c in codes]
    return den * both >= num * (sum(sizes) - both)


def _verifier(k: int, num: int, den: int):
    """(node a, node b) of the pairs that are linked; hashes rule out most others first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[list[bytes], np.ndarray]] = {}

        def of(text: str) -> tuple[list[bytes], np.ndarray]:
            words = words_of(text)
            return words, shingle_sets([words], k)[0]

        for batch in batches:
            for part in steps(batch, 3):
                a, b = [], []
                for x, tx, y, ty in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if x not in held:
                        held = {x: of(tx)}  # pairs of one text tend to follow each other
                    (wx, sx), (wy, sy) = held[x], of(ty)
                    if den * min(len(sx), len(sy)) < num * max(len(sx), len(sy)):
                        continue
                    both = len(np.intersect1d(sx, sy, assume_unique=True))
                    if den * both >= num * (len(sx) + len(sy) - both) and linked(wx, wy, k, num, den):
                        a.append(x)
                        b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _block_linker(k: int, num: int, den: int):
    """Links across components of two blocks (side 0 and 1, or a block with itself): sizes of all intersections at once by a matrix product."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return linked_across(table)
        finally:
            _hashes.clear()

    def linked_across(table: pa.Table) -> pa.Table:
        side = np.array(table.column("side").to_pylist())
        nodes, roots, texts = (table.column(c).to_pylist() for c in ("node", "root", "text"))
        parts = [shingle_sets([words_of(t)], k) for t in texts]  # word lists are not kept: they take far more room than texts
        shingles, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        value, column = np.unique(shingles, return_inverse=True)
        often = np.bincount(column) > 1  # a shingle of one set is in no intersection
        place = np.cumsum(often) - 1
        owner = np.repeat(np.arange(len(texts)), sizes)
        keep = often[column]
        owner, column = owner[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        x = np.flatnonzero(side == 0)
        y = np.flatnonzero(side == 1) if (side == 1).any() else x
        both = np.zeros((len(x), len(y)), np.float32)
        wide = max(1, CELLS // len(texts))
        for first in range(0, int(often.sum()), wide):
            lo, hi = np.searchsorted(column, [first, first + wide])
            rows = np.zeros((len(texts), wide), np.float32)
            rows[owner[lo:hi], column[lo:hi] - first] = 1
            both += rows[x] @ rows[y].T
        near = np.argwhere(den * both >= num * (sizes[x][:, None] + sizes[y][None, :] - both))
        a, b = [], []
        joined = {r: r for r in roots}

        def top(r: bytes) -> bytes:
            while joined[r] != r:
                r = joined[r]
            return r

        for i, j in near.tolist():
            p, q = x[i], y[j]
            if top(roots[p]) != top(roots[q]) and linked(words_of(texts[p]), words_of(texts[q]), k, num, den):
                joined[top(roots[p])] = top(roots[q])  # one link for each pair of components is enough
                a.append(nodes[p])
                b.append(nodes[q])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _shingler(k: int):
    """(node, shingle) of every distinct shingle of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                found, sizes = shingle_sets([words_of(t) for t in part.column(1).to_pylist()], k)
                owner = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), pa.array(found.view(np.int64))], names=["node", "shingle"])

    return run


def _picker(table: bytes, bits: int):
    """Texts whose class is in the filter; copies near each other once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked, seen = np.frombuffer(table, np.uint8), set()
        for batch in batches:
            for part in steps(batch, 0):
                nodes, texts = [], []
                if len(seen) > KEPT_NODES:
                    seen.clear()
                for text in part.column(0).to_pylist():
                    words = words_of(text)
                    if not words:
                        continue
                    node = node_of(words)
                    if in_filter(picked, class_of(node, bits)) and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        texts.append(b" ".join(words).decode())
                cols = [pa.array(nodes, pa.binary()), pa.array([class_of(n, bits) for n in nodes], pa.int64()), pa.array([rest_of(n) for n in nodes], pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "cls", "rest", "text"])

    return run


def filter_bits(classes: DataFrame) -> bytes:
    """A filter of fixed size for ``classes`` (cls): what is not in it is surely in none of them."""
    low = F.col("cls").bitwiseAND(F.lit((1 << PICK_BITS) - 1))
    words = classes.select(F.shiftright(low, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**PICK_BITS / 64 rows
    table = np.zeros(1 << (PICK_BITS - 6), np.int64)
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return table.astype("<i8").tobytes()


def in_filter(bits: np.ndarray, cls: int) -> bool:
    at = cls & ((1 << PICK_BITS) - 1)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def texts_of(docs: DataFrame, text_col: str, classes: DataFrame, bits: int = CLASS_BITS) -> DataFrame:
    """(node, cls, rest, text) of the texts whose class is in ``classes`` (distinct), once each. The filter spares the shuffle most others."""
    near = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(released(_picker(filter_bits(classes), bits)), "node binary, cls long, rest long, text string")
    # Grouped by class first: the join's exchange serves the grouping too.
    return near.join(classes, "cls", "left_semi").groupBy("cls", "rest", "node").agg(F.first("text").alias("text")).select("node", "cls", "rest", "text")


def links(docs: DataFrame, text_col: str, k: int, num: int, den: int, bits: int = CLASS_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) between texts by node, enough to make every component; (node, root) of their components; and (cls, rest, n) of all texts."""
    signed = signatures(docs, text_col, k, num, den, bits).repartition("key").sortWithinPartitions("key", "cls")
    met = written(signed.mapInArrow(released(_meet), "kind int, a long, b long, info long"))
    sizes = met.where(F.col("kind") == SIZE).select(F.col("a").alias("cls"), F.col("b").alias("rest"), "info").repartition("cls").groupBy("cls", "rest").agg((-1 - F.min("info")).alias("n"))
    # Where two texts fall into one class, its bounds are the loosest of theirs, and the two are a pair.
    by_class = sizes.groupBy("cls").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("texts"))
    twins = by_class.where("texts > 1").select(F.col("cls").alias("x"), F.col("cls").alias("y"))

    # Allocation: the worth of heavy keys that a set would lose, and who cannot do without them.
    band = F.shiftright("info", _BAND_AT).alias("band")
    segment = F.shiftright("info", _SEGMENT).bitwiseAND(F.lit((1 << (_BAND_AT - _SEGMENT)) - 1))
    flag = lambda bit: F.shiftright("info", bit).bitwiseAND(F.lit(1)).cast("int")
    heavy = met.where(F.col("kind") == HEAVY_ROW).select(F.col("a").alias("key"), F.col("b").alias("cls"), "info")
    lost = heavy.groupBy("cls", band, segment.alias("segment")).agg(F.max(F.when(flag(_DELETION) == 0, 1 + flag(_ZONE)).otherwise(1)).alias("lost"), F.min(F.col("info").bitwiseAND(F.lit(_SPARE))).alias("spare"))
    lost = checkpointed(lost.groupBy("cls", "band").agg(F.sum("lost").alias("lost"), F.min("spare").alias("spare")))
    short = lost.where("lost > spare").select("cls", "band")
    dear = checkpointed(heavy.select("key", "cls", band).join(short, ["cls", "band"]).select("key", "cls").distinct())
    dear_rep = dear.groupBy("key").agg(F.min("cls").alias("rep"))

    # Pairs that meet in cheap keys, and share enough: what they could share in heavy keys is what either loses there.
    shared = met.where(F.col("kind") == PAIR).groupBy("a", "b", band).agg(F.sum(F.col("info").bitwiseAND(F.lit(3))).alias("worth"), F.min(F.shiftright("info", 2).bitwiseAND(F.lit((1 << (_BAND_AT - 2)) - 1))).alias("need"))
    of_a, of_b = (lost.select(F.col("cls").alias(c), "band", F.col("lost").alias(f"lost_{c}")) for c in "ab")
    shared = shared.join(of_a, ["a", "band"], "left").join(of_b, ["b", "band"], "left")
    shared = shared.where(F.col("worth") + F.least(F.coalesce("lost_a", F.lit(0)), F.coalesce("lost_b", F.lit(0))) >= F.col("need"))

    def of_like_size(pairs: DataFrame) -> DataFrame:
        """Sets of too different sizes are not linked."""
        for c in "xy":
            pairs = pairs.join(by_class.select(F.col("cls").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}")), c)
        return pairs.where(den * F.least("hi_x", "hi_y") >= num * F.greatest("lo_x", "lo_y")).select("x", "y")

    candidates = checkpointed(of_like_size(shared.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()).unionByName(twins))
    dear_stars = of_like_size(dear.join(dear_rep, "key").where("rep <> cls").select(F.col("rep").alias("x"), F.col("cls").alias("y")).distinct())
    stars = checkpointed(candidates.groupBy("y").agg(F.min("x").alias("x")).select("x", "y").unionByName(dear_stars).distinct())

    # Both ends of a star are those of a candidate, or of sets that share a dear key. The list is made once: it is the filter's and the join's.
    classes = checkpointed(candidates.select(F.explode(F.array("x", "y")).alias("cls")).unionByName(dear.select("cls")).distinct())
    texts = written(texts_of(docs, text_col, classes, bits))

    def verified(pairs: DataFrame) -> DataFrame:
        x = texts.select(F.col("cls").alias("x"), F.col("node").alias("a"), F.col("text").alias("ta"))
        y = texts.select(F.col("cls").alias("y"), F.col("node").alias("b"), F.col("text").alias("tb"))
        return pairs.join(y, "y").join(x, "x").select("a", "ta", "b", "tb").mapInArrow(released(_verifier(k, num, den), _hashes.clear), "a binary, b binary")

    # First each set against the smallest that it meets; then those that are in different components still.
    found = checkpointed(verified(stars))
    roots = components(found)
    rooted = checkpointed(texts.select("node", "cls", "rest").join(roots, "node", "left").select("node", "cls", "rest", F.coalesce("root", "node").alias("root")))
    root_x, root_y = (rooted.select(F.col("cls").alias(c), F.col("root").alias(f"root_{c}")) for c in "xy")
    across = candidates.join(stars, ["x", "y"], "left_anti").join(root_x, "x").join(root_y, "y").where("root_x <> root_y").select("x", "y").distinct()
    more = verified(across)

    # Pairs of sets that both need their heavy keys: groups that such keys hold together, in blocks.
    groups = components(checkpointed(dear.join(dear_rep, "key").select(F.col("rep").alias("a"), F.col("cls").alias("b")).distinct()))
    dense = groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")).join(rooted, "cls").select("grp", "node", "cls", "rest", "root")
    several = dense.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("grp")
    dense = checkpointed(dense.join(several, "grp"))
    # A shingle of one set only is in no intersection: what is left of a set bounds its similarity to any other.
    shingles = dense.select("node").distinct().join(texts.select("node", "text"), "node").mapInArrow(released(_shingler(k), _hashes.clear), "node binary, shingle long")
    rare = shingles.groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1").groupBy("node").agg(F.count("*").alias("rare"))
    sized = dense.join(sizes, ["cls", "rest"]).join(rare, "node", "left").withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0)))
    # Blocks hold sets of about the same size and common part. A large component has blocks of its own, small ones are pooled.
    share = Window.partitionBy("grp", "root")
    sized = sized.withColumn("own", F.when(F.count("*").over(share) >= BLOCK, F.col("root")))
    sized = sized.withColumns({"s": F.floor(F.log("n") / math.log(1.03)).cast("int"), "c": F.floor(50 * F.col("common") / F.col("n")).cast("int")})
    cell = ["grp", "own", "s", "c"]
    of_cell = Window.partitionBy(*cell)
    sized = checkpointed(sized.withColumn("blocks", F.ceil(F.greatest(F.count("*").over(of_cell) / BLOCK, F.sum("n").over(of_cell) / BLOCK_SHINGLES)).cast("int")))
    part = F.pmod(F.xxhash64("node"), F.col("blocks"))
    of_block = sized.withColumn("name", F.concat_ws("-", F.coalesce(F.hex("own"), F.lit("")), "s", "c", part))
    each = of_block.groupBy("grp", "name", "own").agg(F.min("n").alias("n"), F.max("common").alias("c"))
    x, y = (each.select("grp", *[F.col(c).alias(f"{c}{i}") for c in ("name", "own", "n", "c")]) for i in (0, 1))
    both = F.least("c0", "c1")
    # Blocks of one component are not compared, nor those in which no two sets can be similar enough.
    block_pairs = x.join(y, "grp").where("name0 <= name1 and (own0 is null or own1 is null or own0 <> own1)").where(den * both >= num * (F.col("n0") + F.col("n1") - both))
    block_pairs = block_pairs.withColumn("pair", F.concat_ws("/", F.hex("grp"), "name0", "name1"))
    sides = block_pairs.select("grp", F.explode(F.array(F.struct(F.col("name0").alias("name"), F.lit(0).alias("side"), F.col("pair")), F.struct(F.col("name1").alias("name"), F.when(F.col("name0") == F.col("name1"), F.lit(0)).otherwise(F.lit(1)).alias("side"), F.col("pair")))).alias("s")).select("grp", "s.*").distinct()
    rows = of_block.join(sides, ["grp", "name"]).join(texts.select("node", "text"), "node").select("pair", "side", "node", "root", "text")
    blocks = rows.groupBy("pair").applyInArrow(_block_linker(k, num, den), "a binary, b binary")

    every = checkpointed(found.unionByName(more).unionByName(blocks))
    return every, components(every), sizes


def _namer(bits: int):
    def named(texts: pa.Array) -> dict[str, pa.Array]:
        nodes = [node_of(w) if (w := words_of(t)) else None for t in texts.to_pylist()]
        return {"node": pa.array(nodes, pa.binary()), "cls": pa.array([n and class_of(n, bits) for n in nodes], pa.int64()), "rest": pa.array([n and rest_of(n) for n in nodes], pa.int64())}

    return named


def _fates(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, node, cls, rest) of every row, and (node, cls, root, id, n, n_shingles) of every text: its least id and number of rows."""
    _, roots, sizes = links(docs, text_col, k, num, den, bits)
    named = keyed_map(docs, [id_col], text_col, _namer(bits), [("node", "binary"), ("cls", "long"), ("rest", "long")])
    named = checkpointed(named.withColumnRenamed(id_col, "id"))
    # What is known of a text is found once, then joined to its copies.
    least = named.where(F.col("node").isNotNull()).groupBy("node", "cls", "rest").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    least = least.join(sizes.withColumnRenamed("n", "n_shingles"), ["cls", "rest"], "left").join(roots, "node", "left")
    return named, least.select("node", "cls", F.coalesce("root", "node").alias("root"), "id", "n", "n_shingles")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, bits: int = CLASS_BITS) -> DataFrame:
    """(id, n_shingles, component_id) of every row; two sets are linked where den * |both| >= num * |either|."""
    named, texts = _fates(docs, id_col, text_col, k, num, den, bits)
    of_root = texts.groupBy("root").agg(F.min("id").alias("component_id"))
    of_node = texts.join(of_root, "root").select("node", "n_shingles", "component_id")
    whole = named.where(F.col("node").isNotNull()).join(of_node, "node").select("id", "n_shingles", "component_id")
    empty = named.where(F.col("node").isNull()).select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return whole.unionByName(empty).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _marker(table: bytes, bits: int):
    """A text's node where its class is in the filter; null for all others. Spark's rows wait in the JVM."""

    picked = np.frombuffer(table, np.uint8)

    def of_batch(texts: pa.Array) -> pa.Array:
        found: list[bytes | None] = []
        for part in array_steps(texts):
            nodes = [node_of(w) if (w := words_of(t)) else None for t in part.to_pylist()]
            found += [n if n and in_filter(picked, class_of(n, bits)) else None for n in nodes]
        return pa.array(found, pa.binary())

    of_task = released(lambda batches: map(of_batch, batches))

    @F.arrow_udf("binary")
    def crowded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from of_task(batches)

    return crowded


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, bits: int = CLASS_BITS) -> DataFrame:
    """One row of each component, with its own columns only: that of the smallest id; texts without words all stay.

    Only rows of a component of several rows (and a few that the filter cannot
    tell from them) are shuffled with their texts.
    """
    _, texts = _fates(docs, id_col, text_col, k, num, den, bits)
    # A null id comes after all others; among texts with the same id the first by name stays.
    texts = checkpointed(texts)
    keeper = texts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("node").alias("node"))).alias("keeper"), F.sum("n").alias("rows"))
    crowded = checkpointed(texts.join(keeper.where("rows > 1"), "root").select("node", "cls", (F.col("node") == F.col("keeper.node")).alias("stays"), F.col("keeper.id").alias("keeper_id")))
    table = filter_bits(crowded.select("cls"))
    node = _marker(table, bits)
    # Most rows pass by their text alone. For the others the node is kept as well: found once, since a filter on what
    # counts as not deterministic is not pushed below it.
    apart = docs.where(node(F.col(f"`{text_col}`")).isNull())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _marker(table, bits).asNondeterministic()(F.col(f"`{text_col}`")).alias("node"))
    judged = rows.where(F.col("node").isNotNull()).join(crowded.drop("cls"), "node", "left")
    own_id = F.col("row")[id_col]
    kept = judged.where(F.col("stays").isNull() | (F.col("stays") & own_id.eqNullSafe(F.col("keeper_id"))))
    first = F.row_number().over(Window.partitionBy("node", own_id).orderBy(F.to_json("row")))
    return apart.unionByName(kept.withColumn("nth", first).where("stays is null or nth = 1").select("row.*"))
