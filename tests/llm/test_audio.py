import hashlib
import zlib

import numpy as np
import pytest
from helpers import ODD, by_id, documents, table

from strandweave.llm import audio, queries


def ima_plainly(block):
    pred, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [pred]
    for byte in block[4:]:
        for nib in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            d = step >> 3
            d += (step >> 2) * (nib & 1) + (step >> 1) * (nib >> 1 & 1) + step * (nib >> 2 & 1)
            pred = max(-32768, min(32767, pred - d if nib & 8 else pred + d))
            index = max(0, min(88, index + int(audio.INDEX_STEP[nib])))
            out.append(pred)
    return out


def test_tables():
    assert [int(audio.MULAW[c]) for c in (0x00, 0x7F, 0x80, 0xFF, 0x0F)] == [-32124, 0, 32124, 0, -16764]
    assert [int(audio.ALAW[c]) for c in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    for t in (audio.MULAW, audio.ALAW):
        codes = np.frombuffer(audio.encode_law(t, t), np.uint8)
        assert (t[codes] == t).all()


def test_adpcm_blocks():
    data = np.random.default_rng(1).integers(0, 256, 40 * audio.UNIT, np.uint8)
    got = audio.decode_ima(data).reshape(40, -1)
    for i in range(40):
        assert got[i].tolist() == ima_plainly(data[i * audio.UNIT : (i + 1) * audio.UNIT].tobytes())
    tone = (8000 * np.sin(np.arange(5000) / 9)).astype(np.int16)
    back = audio.decode_ima(np.frombuffer(audio.encode_ima(tone), np.uint8))[: len(tone)]
    assert np.abs(back.astype(int) - tone)[200:].mean() < 400


def test_resampling_keeps_a_tone():
    tone = (10000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)).astype(np.int16)
    y = audio.resample(tone, 2)
    want = 10000 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert len(y) == 16000 and np.abs(y - want)[100:-100].max() < 60


def test_wave_round_trip():
    for codec in ("mulaw", "alaw", "ima", "pcm"):
        assert audio.read_wave(audio.write_wave(b"\1" * 64, codec)) == (codec, 8000, b"\1" * 64)
    for bad in (b"", b"RIFF", audio.write_wave(b"\1" * 64, "ima")[:-9]):
        with pytest.raises(ValueError):
            audio.read_wave(bad)


@pytest.mark.parametrize("odd", [True, False])
def test_digests(spark, odd):
    df = table(spark, ODD) if odd else documents(spark)
    rows = audio.telephony_digests(df).collect()
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    assert len(rows) == df.count()
    for r in rows:
        t = next(x for x in texts[r.doc_id] if len(x) == r.n_bytes)
        p = t + bytes((-len(t)) % 64 or (0 if t else 64))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        media = audio.write_wave(p, r.codec)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    if odd:
        assert by_id(audio.telephony_digests(df))[1].feature == by_id(audio.telephony_digests(df))[2].feature


def test_stored_media(spark):
    x = (9000 * np.sin(np.arange(3000) / 5)).astype(np.int16)
    rows = [("a", bytearray(audio.write_wave(audio.encode_law(x, audio.MULAW), "mulaw"))), ("b", None), ("c", bytearray(audio.write_wave(audio.encode_ima(x), "ima")))]
    got = {r.id: r for r in audio.decode_media(spark.createDataFrame(rows, "id string, m binary"), "id", "m").collect()}
    assert got["b"].pcm is None and got["a"].n_samples == 3000
    codec, rate, data = audio.read_wave(bytes(got["a"].pcm))
    assert (codec, rate, len(data)) == ("pcm", 16000, 4 * 3000)


def test_empty_table(spark):
    assert audio.telephony_digests(table(spark, [])).collect() == []
    assert "op1_telephony_audio" in queries.queries()
