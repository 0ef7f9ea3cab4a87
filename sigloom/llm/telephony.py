"""Telephony audio in a table: companded and ADPCM samples stored, decoded and resampled.

Payload bytes are stored as they are in a RIFF/WAVE container: mu-law or A-law codes, one
byte a sample, or IMA ADPCM blocks: a four-byte header, whose predictor is the block's first
sample, and 64 data bytes of two codes each, so 129 samples a block.  Decoding expands
companded codes by lookup tables and runs ADPCM with numpy across all blocks at once, step
by step inside a block; the PCM is resampled from 8 to 16 kHz by polynomial interpolation.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigloom.llm.common import slices, with_text

RATE, RESAMPLED = 8_000, 16_000
#: Payloads are whole multiples of this many bytes; an ADPCM block holds as many.
UNIT = 64
#: Samples of an ADPCM block: the header's predictor and two for each data byte.
BLOCK_SAMPLES = 2 * UNIT + 1
#: Samples to either side from which one between two neighbours is interpolated.
REACH = 4
#: Format tags of the container.
ALAW, MULAW, ADPCM = 6, 7, 17
CODECS = (MULAW, ALAW, ADPCM)
#: Step index changes of IMA ADPCM by the code's three magnitude bits.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Step sizes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """PCM of the 256 mu-law codes."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of the 256 A-law codes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, mantissa = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, mantissa + 8, mantissa + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def container(payload: bytes, codec: int) -> bytes:
    """A WAVE file that holds the payload losslessly in the codec's samples."""
    if codec == ADPCM:
        data = b"".join(b"\0\0\0\0" + payload[k : k + UNIT] for k in range(0, len(payload), UNIT))
        fmt = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * (UNIT + 4) // BLOCK_SAMPLES, UNIT + 4, 4, 2, BLOCK_SAMPLES)
        held = len(payload) // UNIT * BLOCK_SAMPLES
    else:
        data, held = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    return chunk(b"RIFF", b"WAVE" + chunk(b"fmt ", fmt) + chunk(b"fact", struct.pack("<I", held)) + chunk(b"data", data))


def samples(media: bytes) -> tuple[int, bytes]:
    """Codec and data chunk of a WAVE file; chunks are walked, unknown ones skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("a chunk is cut short")
        if name == b"fmt ":
            codec = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            if codec not in CODECS:
                raise ValueError("no telephony samples")
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(codec: int, data: bytes) -> bytes:
    """The payload back from the stored samples."""
    if codec != ADPCM:
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, UNIT + 4)[:, 4:].tobytes()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (rows of header and data bytes), decoded side by side; the header's predictor comes first."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.clip(head[:, 2].astype(np.int32), 0, len(STEPS) - 1)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * data.shape[0], len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * data.shape[0]):
        code = data[k >> 1] >> 4 if k & 1 else data[k >> 1] & 15
        step = STEPS[index]
        size = step >> 3
        size = size + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def decode(parts: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """PCM at 8 kHz of (codec, data) pairs; the ADPCM blocks of all of them run together."""
    pcm: list[np.ndarray | None] = [TABLES[c][np.frombuffer(d, np.uint8)] if c != ADPCM else None for c, d in parts]
    mine = [k for k, p in enumerate(pcm) if p is None]
    if mine:
        blocks = [np.frombuffer(parts[k][1], np.uint8).reshape(-1, UNIT + 4) for k in mine]
        done = adpcm(np.concatenate(blocks))
        at = 0
        for k, own in zip(mine, blocks, strict=True):
            pcm[k] = done[at : at + len(own)].ravel()
            at += len(own)
    return pcm


def halfway_taps(reach: int = REACH) -> np.ndarray:
    """Weights, in 2048ths, of the samples around a midpoint: the polynomial through all of them, taken there."""
    at = np.arange(-reach + 0.5, reach)
    return np.rint([2048 * np.prod([-b / (a - b) for b in at if b != a]) for a in at]).astype(np.int64)


TAPS = halfway_taps()


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: every sample, and between neighbours the polynomial through the nearest; the ends are held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    wide = np.pad(pcm.astype(np.int32), (REACH - 1, REACH), mode="edge") if len(pcm) else np.zeros(0, np.int32)
    middle = sum(int(t) * wide[k : k + len(pcm)] for k, t in enumerate(TAPS))
    out[1::2] = np.clip(middle + 1024 >> 11, -32768, 32767) if len(pcm) else 0
    return out


def feature(codec: int, pcm: np.ndarray) -> str:
    """Codec, samples, peak, mean square and sign changes, in whole numbers."""
    wide = pcm.astype(np.int64)
    flips = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"codec={codec};rate={RESAMPLED};samples={len(pcm)};peak={int(np.abs(wide).max(initial=0))};power={int((wide * wide).sum()) // max(1, len(pcm))};flips={flips}"


def _media_rows(columns: tuple[str, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = [t.encode() for t in batch.column("text").to_pylist()]
                payloads = [t + bytes(-len(t) % UNIT if t else UNIT) for t in texts]
                media = [container(p, CODECS[zlib.crc32(p) % len(CODECS)]) for p in payloads]
                read = [samples(m) for m in media]
                pcm = [resample(x) for x in decode(read)]
                back = [payload_of(*x) for x in read]
                made = {
                    "n_bytes": lambda: pa.array([len(t) for t in texts], pa.int64()),
                    "payload_bytes": lambda: pa.array([len(p) for p in back], pa.int64()),
                    "payload_sha256": lambda: pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                    "tail_crc32": lambda: pa.array([zlib.crc32(p[-UNIT:]) for p in back], pa.int64()),
                    "media_bytes": lambda: pa.array([len(m) for m in media], pa.int64()),
                    "media_sha256": lambda: pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                    "feature": lambda: pa.array([feature(c, x) for (c, _), x in zip(read, pcm, strict=True)], pa.string()),
                    "media": lambda: pa.array(media, pa.binary()),
                    "pcm": lambda: pa.array([x.tobytes() for x in pcm], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(made[c]() for c in columns)], names=["doc_id", *columns])

    return rows


KINDS = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(), "media": T.BinaryType(), "pcm": T.BinaryType()}
DIGESTS = tuple(c for c in KINDS if c not in ("media", "pcm"))


def as_media(docs: DataFrame, columns: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """One row per row of ``docs``: doc_id and the ``columns`` asked for.

    ``media`` is the WAVE file, ``pcm`` the resampled 16-bit samples; the rest are their
    digests.  The codec follows from the payload, so equal texts have equal values.  Texts of
    any length are stored whole.  Null texts count as empty: one unit of zero bytes.  An empty table gives an empty result;
    repeated rows are stored alike; other columns are not read.
    """
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, KINDS[c]) for c in columns)])
    return with_text(docs, "doc_id").mapInArrow(_media_rows(columns), shape)
