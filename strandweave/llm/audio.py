"""Telephony audio: mu-law, A-law and IMA ADPCM in WAVE containers.

Companded bytes are expanded by 256-entry tables.  ADPCM blocks are decoded
step by step with numpy across all blocks at once (each block carries its own
predictor and step index, so blocks are independent).  The samples are
resampled by a whole-number polyphase filter and stored as 16-bit PCM.  All
arithmetic is in integers: equal bytes give equal results on any machine.

Nulls and empty texts are one unit of zero bytes; long payloads are worked on
whole, a group of about ``GROUP`` bytes at a time.  Each row stands alone, so
ties, repeats and hot sources need no care.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_groups

#: Bytes of a unit: payloads are padded to whole units, and a unit is an ADPCM block.
UNIT = 64
#: Samples an ADPCM block holds: one in its header, two in each byte after.
BLOCK_SAMPLES = 1 + 2 * (UNIT - 4)
RATE, TARGET_RATE = 8000, 16000
#: Bytes of payload decoded at a time.
GROUP = 1 << 20
CODECS = {7: "mulaw", 6: "alaw", 17: "ima"}
TAGS = {v: k for k, v in CODECS.items()}


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    mag = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -mag, mag).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    seg = (a & 0x70) >> 4
    mag = ((a & 0x0F) << 4) + 8
    mag = np.where(seg == 0, mag, (mag + 0x100) << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, mag, -mag).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
     544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
     12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
_nib = np.arange(16)
#: Signed difference for (step index, nibble).
DIFF = (np.where(_nib & 8, -1, 1) * ((STEPS[:, None] >> 3) + np.where(_nib & 4, STEPS[:, None], 0) + np.where(_nib & 2, STEPS[:, None] >> 1, 0) + np.where(_nib & 1, STEPS[:, None] >> 2, 0))).astype(np.int32)
NEXT = np.clip(np.arange(len(STEPS))[:, None] + INDEX_STEP, 0, len(STEPS) - 1).astype(np.int32)


def decode_ima(data: np.ndarray) -> np.ndarray:
    """Bytes of whole blocks to int16 samples; step indices above 88 count as 88."""
    blocks = data.reshape(-1, UNIT)
    out = np.empty((BLOCK_SAMPLES, len(blocks)), np.int16)
    pred = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    out[0] = pred
    diff, nxt = DIFF.ravel(), NEXT.ravel()
    for i in range(2 * (UNIT - 4)):
        at = (index << 4) | ((body[i >> 1] >> (4 * (i & 1))) & 15)
        pred = np.clip(pred + diff[at], -32768, 32767)
        index = nxt[at]
        out[i + 1] = pred
    return out.T.reshape(-1)


def encode_ima(pcm: np.ndarray) -> bytes:
    """int16 samples to blocks, with numpy across blocks; the last is padded with zeros."""
    n = max(1, -(-len(pcm) // BLOCK_SAMPLES))
    x = np.zeros(n * BLOCK_SAMPLES, np.int32)
    x[: len(pcm)] = pcm
    x = x.reshape(n, BLOCK_SAMPLES)
    out = np.zeros((n, UNIT), np.uint8)
    pred, index = x[:, 0].copy(), np.zeros(n, np.int32)
    out[:, :2] = pred.astype("<i2").view(np.uint8).reshape(n, 2)
    for i in range(1, BLOCK_SAMPLES):
        nib = np.abs(DIFF[index] + (pred - x[:, i])[:, None]).argmin(1)
        pred = np.clip(pred + DIFF[index, nib], -32768, 32767)
        index = NEXT[index, nib]
        out[:, 4 + ((i - 1) >> 1)] |= (nib << (4 * ((i - 1) & 1))).astype(np.uint8)
    return out.tobytes()


def encode_law(pcm: np.ndarray, table: np.ndarray) -> bytes:
    """Nearest code of a companding table for each int16 sample."""
    order = np.argsort(table, kind="stable")
    levels = table[order].astype(np.int32)
    mid = (levels[1:] + levels[:-1] + 1) >> 1
    return order[np.searchsorted(mid, pcm.astype(np.int32), side="right")].astype(np.uint8).tobytes()


def write_wave(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAVE file around companded, ADPCM or ("pcm") 16-bit data."""
    tag = TAGS.get(codec, 1)
    bits, align = {"ima": (4, UNIT), "pcm": (16, 2)}.get(codec, (8, 1))
    per_s = rate * UNIT // BLOCK_SAMPLES if codec == "ima" else rate * align
    extra = struct.pack("<HH", 2, BLOCK_SAMPLES) if codec == "ima" else b"" if codec == "pcm" else b"\0\0"
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_s, align, bits) + extra
    pad = len(payload) & 1
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, bytes]:
    """Codec name, sample rate and data of a mono WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, tag, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, channels, rate = struct.unpack_from("<HHI", media, at + 8)
            if channels != 1:
                raise ValueError("only mono is read")
        elif name == b"data":
            if len(media) < at + 8 + size or tag is None:
                raise ValueError("WAVE file is cut short")
            return CODECS.get(tag, "pcm"), rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("WAVE file without data")


def decode(data: np.ndarray, codec: str) -> np.ndarray:
    if codec == "ima":
        return decode_ima(data)
    return data.view("<i2") if codec == "pcm" else (MULAW if codec == "mulaw" else ALAW)[data]


def _phases(up: int, half: int = 8) -> np.ndarray:
    """Windowed-sinc taps for each phase, scaled to 2**14 each."""
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    h = np.sinc(t) * np.cos(np.pi * t / (2 * half)) ** 2
    h = np.round(h / h.sum(1, keepdims=True) * (1 << 14)).astype(np.int32)
    h[:, half - 1] += (1 << 14) - h.sum(1)
    return h


def resample(pcm: np.ndarray, up: int, down: int = 1) -> np.ndarray:
    """By ``up``/``down``, for up >= down; each output is a fixed-point dot product."""
    taps = _phases(up)
    half = taps.shape[1] // 2
    pad = np.concatenate([np.zeros(half - 1, np.int32), pcm.astype(np.int32), np.zeros(half, np.int32)])
    full = np.empty((len(pcm), up), np.int16)
    for p in range(up):
        acc = np.full(len(pcm), 1 << 13, np.int32)
        for t, h in enumerate(taps[p]):
            if h:
                acc += pad[t : t + len(pcm)] * h
        full[:, p] = np.clip(acc >> 14, -32768, 32767)
    return full.reshape(-1)[::down]


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes((-len(text)) % UNIT or (0 if text else UNIT))


def codec_of(payload: bytes) -> str:
    """Which of the three formats a text is stored in; equal texts agree."""
    return ("mulaw", "alaw", "ima")[zlib.crc32(payload) % 3]


#: Zero samples between neighbours, so that a filter over many at once keeps them apart.
GAP = 16
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string,"
    " codec string, n_samples long, pcm_bytes long, pcm_crc32 long"
)


def features(media: list[bytes], keep_pcm: bool = False) -> Iterator[dict]:
    """Read stored files back, decode, resample and measure; files of a codec are decoded together."""
    read = [read_wave(m) for m in media]
    pcm: list[np.ndarray] = [np.zeros(0, np.int16)] * len(media)
    for codec in (*CODECS.values(), "pcm"):
        at = [i for i, r in enumerate(read) if r[0] == codec]
        if at:
            samples = decode(np.frombuffer(b"".join(read[i][2] for i in at), np.uint8), codec)
            sizes = np.cumsum([len(read[i][2]) * (BLOCK_SAMPLES if codec == "ima" else 1) // {"ima": UNIT, "pcm": 2}.get(codec, 1) for i in at])
            for i, part in zip(at, np.split(samples, sizes[:-1])):
                pcm[i] = part
    gap = np.zeros(GAP, np.int16)
    wide = resample(np.concatenate([y for x in pcm for y in (x, gap)]), TARGET_RATE // RATE) if pcm else gap
    at = 0
    for (codec, _, data), x in zip(read, pcm):
        y = wide[2 * at : 2 * (at + len(x))]
        at += len(x) + GAP
        z = x.astype(np.int64)
        crossings = int(np.count_nonzero((z[1:] < 0) != (z[:-1] < 0)))
        crc = zlib.crc32(y)
        feature = f"{codec}|n={len(x)}|energy={int(z @ z)}|sum={int(z.sum())}|peak={int(np.abs(z).max(initial=0))}|cross={crossings}|pcm={crc:08x}"
        yield {"codec": codec, "data": data, "n_samples": len(x), "pcm_bytes": 2 * len(y), "pcm_crc32": crc, "feature": feature} | ({"pcm": y.tobytes()} if keep_pcm else {})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        payloads = [payload_of(t) for t in texts]
        for a, b in byte_groups(payloads, GROUP):
            media = [write_wave(p, codec_of(p)) for p in payloads[a:b]]
            rows = [
                {
                    "doc_id": ids[i], "n_bytes": len(texts[i] or b""), "payload_bytes": len(f["data"]), "payload_sha256": sha(f["data"]), "tail_crc32": zlib.crc32(f["data"][-UNIT:]),
                    "media_bytes": len(m), "media_sha256": sha(m), "feature": f["feature"], "codec": f["codec"], "n_samples": f["n_samples"], "pcm_bytes": f["pcm_bytes"], "pcm_crc32": f["pcm_crc32"],
                }
                for i, m, f in zip(range(a, b), media, features(media))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in SCHEMA.split(",")])


def telephony_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a telephony file, read it back, and return digests and features."""
    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(_digests, SCHEMA)


def decode_media(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Stored WAVE files to 16 kHz PCM files: id, codec, n_samples, pcm (a WAVE file), feature; null media give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("codec", pa.string()), ("n_samples", pa.int64()), ("pcm", pa.binary()), ("feature", pa.string())])
        for batch in batches:
            ids, media = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in byte_groups([m or b"" for m in media], GROUP):
                found = features([m for m in media[a:b] if m is not None], keep_pcm=True)
                rows = []
                for i in range(a, b):
                    f = next(found) if media[i] is not None else {}
                    rows.append({"id": ids[i], "codec": f.get("codec"), "n_samples": f.get("n_samples"), "pcm": write_wave(f["pcm"], "pcm", TARGET_RATE) if f else None, "feature": f.get("feature")})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.selectExpr(f"cast(`{id_col}` as string) as id", f"`{media_col}` as media").mapInArrow(run, "id string, codec string, n_samples long, pcm binary, feature string")
