"""Telephony audio as media columns (operator 1).

A payload of 8-bit codes is stored verbatim in a RIFF/WAVE file of one of
three telephony formats: G.711 mu-law (tag 7), G.711 A-law (tag 6) or IMA ADPCM
in blocks of 64 bytes (tag 17). Reading parses the file, expands mu-law and
A-law by lookup tables of 256 entries, decodes ADPCM with numpy across all
blocks of a step at once, and resamples the PCM by a polyphase filter in
integer arithmetic, so that results are the same on every machine.

Defined results: a null text is an empty one (64 zero bytes); equal texts have
equal outputs; repeated rows are handled one by one; an empty table gives an
empty table; other columns are ignored, whatever their names. A step holds
about 4 MB of payload, or one longer value.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillion.llm.batches import keyed_map

UNIT = 64
RATE_IN, RATE_OUT = 8000, 16000
TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
CODECS = tuple(TAGS)
SAMPLES_A_BLOCK = 1 + 2 * (UNIT - 4)

#: Fixed values of the IMA ADPCM format: the change of the step index by nibble, and the 89 step sizes.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEP_SIZES = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """Linear 16-bit value of every mu-law code: sign, 3 bits of exponent and 4 of mantissa, all inverted, with a bias of 33 in 14 bits."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit value of every A-law code: even bits inverted, sign bit set for positive values."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n, 64) of uint8 to samples (n, 121) of int16; the loop is over the 120 nibbles of a block, each step over all blocks."""
    out = np.empty((SAMPLES_A_BLOCK, len(blocks)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = value
    for i in range(2 * len(data)):
        nibble = data[i >> 1] >> 4 if i & 1 else data[i >> 1] & 15
        step = STEP_SIZES[index]
        change = step >> 3
        for bit, shift in ((4, 0), (2, 1), (1, 2)):
            change += np.where(nibble & bit, step >> shift, 0)
        value += np.where(nibble & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_CHANGE[nibble]
        np.clip(index, 0, 88, out=index)
        out[i + 1] = value
    return out.T


def polyphase(up: int, half: int = 4) -> np.ndarray:
    """Taps (up, 2 * half) of a Hann-windowed sinc in units of 1 / 16384; each phase sums to 16384."""
    at = np.arange(-half + 1, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    taps = np.round(np.sinc(at) * (0.5 + 0.5 * np.cos(np.pi * at / (half + 1))) * 16384).astype(np.int64)
    taps[np.arange(up), np.argmax(np.abs(taps), 1)] += 16384 - taps.sum(1)
    return taps.astype(np.int32)


def resample(pcm: np.ndarray, up: int, half: int = 4) -> np.ndarray:
    """``up`` output samples for each sample of ``pcm``, with silence beyond both ends."""
    taps = polyphase(up, half)
    padded = np.concatenate([np.zeros(half - 1, np.int32), pcm, np.zeros(half, np.int32)]).astype(np.int32)
    out = np.empty((len(pcm), up), np.int16)
    out[:, 0] = pcm
    for phase in range(1, up):
        total = np.full(len(pcm), 8192, np.int32)
        for k, tap in enumerate(taps[phase]):
            if tap:
                total += tap * padded[k : k + len(pcm)]
        out[:, phase] = np.clip(total >> 14, -32768, 32767)
    return out.reshape(-1)


def wav_file(payload: bytes, codec: str) -> bytes:
    block, samples = (UNIT, len(payload) // UNIT * SAMPLES_A_BLOCK) if codec == "ima_adpcm" else (1, len(payload))
    rate = RATE_IN * UNIT // SAMPLES_A_BLOCK if codec == "ima_adpcm" else RATE_IN
    extra = struct.pack("<HH", 2, SAMPLES_A_BLOCK) if codec == "ima_adpcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE_IN, rate, block, 4 if codec == "ima_adpcm" else 8) + extra
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x for name, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a stored file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, codec = 12, ""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(c for c, t in TAGS.items() if t == tag)
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(max(UNIT, -len(raw) // UNIT * -UNIT) - len(raw))


def codec_of(payload: bytes) -> str:
    """The corpus is spread over the three formats by content."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def _store(texts: pa.Array) -> dict[str, pa.Array]:
    media, sizes = [], []
    for text in texts:
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        payload = payload_of(raw)
        media.append(wav_file(payload, codec_of(payload)))
        sizes.append(len(raw))
    return {"media": pa.array(media, pa.binary()), "n_bytes": pa.array(sizes, pa.int64())}


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media, n_bytes): every text's bytes as the samples of a stored file."""
    return keyed_map(docs, [id_col], text_col, _store, [("media", "binary"), ("n_bytes", "long")])


def _expand(codec: str, codes: np.ndarray) -> np.ndarray:
    if codec == "ima_adpcm":
        return decode_adpcm(codes.reshape(-1, UNIT)).reshape(-1)
    return TABLES[codec][codes]


def _reader(keep_pcm: bool):
    def read(stored: pa.Array) -> dict[str, pa.Array]:
        files = [x.as_py() if x.is_valid else None for x in stored]
        parsed = [parse_wav(x) if x is not None else ("", b"") for x in files]
        pcm: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
        # Blocks of all files of a codec are decoded together, then cut apart.
        for codec in CODECS:
            rows = [i for i, (c, _) in enumerate(parsed) if c == codec]
            if rows:
                samples = _expand(codec, np.frombuffer(b"".join(parsed[i][1] for i in rows), np.uint8))
                each = [len(parsed[i][1]) // UNIT * SAMPLES_A_BLOCK if codec == "ima_adpcm" else len(parsed[i][1]) for i in rows]
                for i, part in zip(rows, np.split(samples, np.cumsum(each)[:-1]), strict=True):
                    pcm[i] = part
        out: dict[str, list] = {n: [] for n, _ in READ_FIELDS}
        for file, (codec, payload), samples in zip(files, parsed, pcm, strict=True):
            wide = resample(samples, RATE_OUT // RATE_IN)
            energy = int(np.square(samples.astype(np.int64)).sum()) // max(1, len(samples))
            peak = int(np.abs(samples.astype(np.int32)).max(initial=0))
            crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
            row = {
                "codec": codec, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
                "media_bytes": len(file or b""), "media_sha256": hashlib.sha256(file or b"").hexdigest(),
                "feature": f"{codec}:n={len(samples)}:energy={energy}:peak={peak}:crossings={crossings}:pcm16k={len(wide)}:{zlib.crc32(wide.astype('<i2').tobytes()):08x}",
                "pcm": wide.astype("<i2").tobytes() if keep_pcm else None,
            }
            for name, value in row.items():
                out[name].append(value)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return {n: pa.array(out[n], kinds[t]) for n, t in READ_FIELDS}

    return read


READ_FIELDS = [("codec", "string"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("pcm", "binary")]


def read(media: DataFrame, id_cols: list[str], media_col: str = "media", keep_pcm: bool = True) -> DataFrame:
    """What the stored files hold: digests of payload and file, features, and the PCM at 16 kHz (16-bit little-endian) as a column to store."""
    return keyed_map(media, id_cols, media_col, _reader(keep_pcm), READ_FIELDS)
