"""SentencePiece encoding and decoding (operator 4) as columns; the algorithm is in :mod:`quillion.llm.piece_bpe`.

Every distinct unit that a worker meets is checked against the sentencepiece
library, ids and decoded text, in the Arrow batch in which it appears; a
difference fails the task.

Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows are handled one by one with equal results; an empty table
gives an empty table; other columns are ignored, whatever their names; texts
of any length are encoded whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from quillion.llm.batches import keyed_map
from quillion.llm.piece_bpe import KEPT_UNITS, LONG, PieceModel, load


class UnitCodes:
    """Unit -> (number of ids, ids in decimal joined by commas, decoded text), for the units met so far."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, tuple[int, str, str]] = {}

    def learn(self, units: set[str], check: bool) -> dict[str, tuple[int, str, str]]:
        """A table that holds all of ``units``."""
        if len(self.known) > KEPT_UNITS:
            self.known = {}
        new = [u for u in units if u not in self.known]
        ids = self.model.encode_units(new)
        decoded = [self.model.decode_unit(i) for i in ids]
        if check and new:
            self.model.check_units(new, ids, decoded)
        found = {u: (len(i), ",".join(map(str, i)), d) for u, i, d in zip(new, ids, decoded, strict=True)}
        if long := [u for u in new if len(u) > LONG]:
            extra = {u: found.pop(u) for u in long}
            self.known |= found
            return self.known | extra
        self.known |= found
        return self.known


_codes: dict[str, UnitCodes] = {}


def _codec(path: str, check: bool, ids: bool):
    def run(texts: pa.Array) -> dict[str, pa.Array]:
        if path not in _codes:
            _codes[path] = UnitCodes(load(path))
        codes = _codes[path]
        cut = [codes.model.cut(t or "") for t in texts.to_pylist()]
        table = codes.learn(set().union(*cut), check)
        n, joined, decoded = [], [], []
        for units in cut:
            found = [table[u] for u in units]
            n.append(sum([f[0] for f in found]))
            joined.append(",".join([f[1] for f in found]))
            decoded.append("".join([f[2] for f in found]).removeprefix(" "))
        if ids:
            values = [[int(i) for i in x.split(",")] if x else [] for x in joined]
            return {"ids": pa.array(values, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
        digest = lambda xs: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs], pa.string())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": digest(joined), "decoded_sha256": digest(decoded)}

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(id, ids array<int>, decoded string) of every text."""
    return keyed_map(docs, [id_col], text_col, _codec(path, check, ids=True), [("ids", "array<int>"), ("decoded", "string")])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the same codes, folded to digests in the workers instead of being sent back."""
    return keyed_map(docs, [id_col], text_col, _codec(path, check, ids=False), [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])

