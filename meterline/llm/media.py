"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM decoded with numpy across blocks, resampled PCM."""

from __future__ import annotations

import math
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, documents, stage

#: WAVE format tags of the stored forms.
ALAW, MULAW, IMA = 6, 7, 0x11
NAMES = {ALAW: "alaw", MULAW: "mulaw", IMA: "ima"}
RATE = 8000
#: Samples that are resampled or measured at once.
PART = 1 << 18
#: Compression level of the stored audio: it is written once and read often.
LEVEL = 9
#: Data bytes of an ADPCM block, after its header of four bytes.
UNIT = 192

# Fixed values of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    seg, low = (a >> 4) & 7, ((a & 15) << 4) + 8
    size = np.where(seg == 0, low, low + 256 << np.maximum(seg - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


_LAWS = {MULAW: mulaw_table(), ALAW: alaw_table()}


def wav(tag: int, data: bytes, samples: int) -> bytes:
    """A WAVE file of one channel at 8 kHz around coded data."""
    if tag == IMA:
        block = UNIT + 4
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * block // (2 * UNIT + 1), block, 4, 2, 2 * UNIT + 1)
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
    pad = b"\0" * (len(data) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[int, int, int, memoryview] | None:
    """Format tag, rate, block size and coded data of a WAVE file, or None where it isn't one of the three forms."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    view = memoryview(media)
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            fmt = struct.unpack_from("<HHIIH", media, at + 8)
        elif kind == b"data" and fmt and fmt[0] in NAMES and fmt[1] == 1:
            return fmt[0], fmt[2], fmt[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return None


def encode(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a multiple of UNIT: its bytes are the codes; its length picks the form."""
    tag = (MULAW, ALAW, IMA)[len(payload) // UNIT % 3]
    if tag != IMA:
        return wav(tag, payload, len(payload))
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    headed = np.zeros((len(blocks), UNIT + 4), np.uint8)  # predictor 0, step index 0
    headed[:, 4:] = blocks
    return wav(tag, headed.tobytes(), len(blocks) * (2 * UNIT + 1))


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM of equal ADPCM blocks (one a row): each step decodes one sample of all blocks at once."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(head[:, 2].astype(np.int32), 0, 88)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(data) + 1, len(blocks)), np.int16)
    out[0] = value
    for i, row in enumerate(data):
        for half in (0, 1):
            code = (row >> 4 if half else row & 15).astype(np.int32)
            step = STEPS[index]
            move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
            index = np.clip(index + INDEX_SHIFT[code & 7], 0, 88)
            out[2 * i + half + 1] = value
    return np.ascontiguousarray(out.T)


@lru_cache(64)
def filters(up: int, down: int, taps: int = 8) -> np.ndarray:
    """Integer polyphase taps (sum 2 ** 14 a phase) of a windowed sinc that resamples by up / down."""
    at = np.arange(taps) - taps // 2 + 1
    x = at[None, :] - np.arange(up)[:, None] / up
    cut = min(1.0, up / down)
    h = np.sinc(x * cut) * np.cos(np.pi * x / (taps + 2)) ** 2
    h = np.rint(h / h.sum(axis=1, keepdims=True) * 16384).astype(np.int32)
    h[:, taps // 2 - 1] += 16384 - h.sum(axis=1)
    return h


def resample(pcm: np.ndarray, up: int, down: int, h: np.ndarray, part: int = PART) -> np.ndarray:
    """PCM resampled by up / down, `part` samples at a time, so a long text needs little beyond its samples."""
    if not len(pcm) or up == down:
        return pcm
    taps, n = h.shape[1], len(pcm)
    x = np.pad(pcm, (taps // 2 - 1, taps // 2), "edge")
    out = np.empty(-(-n * up // down), np.int16)
    for a in range(0, n, part):
        m = min(part, n - a)
        wide = x[a : a + m + taps - 1].astype(np.int32)
        made = np.empty((m, up), np.int16)
        for p in range(up):
            acc = np.zeros(m, np.int32)
            for k in range(taps):
                if h[p, k]:
                    acc += (wide[k : k + m] * h[p, k]) >> 4  # keeps the sum within 32 bits
            made[:, p] = np.clip((acc + 512) >> 10, -32768, 32767)
        first = -(a * up) % down
        got = made.ravel()[first::down]
        at = (a * up + first) // down
        out[at : at + len(got)] = got
    return out


_PACKED = struct.Struct("<4sIHHQB")  # mark, rate, up, reserved, samples, which planes follow


def pack_pcm(pcm: np.ndarray, rate: int, up: int) -> bytes:
    """PCM in a lossless form that general compression shrinks well; `unpack_pcm` gives the very samples back.

    As lossless audio coders do, it stores a prediction's residue: every `up`-th sample is kept, the samples between are
    predicted from those by the interpolation filter, and a plane of residues follows only where it isn't zero. Kept samples of at
    most 256 different values are a sorted palette and one byte each, others differences. Any PCM survives, whatever made it.
    """
    up = max(1, up)
    kept = np.ascontiguousarray(pcm[::up])
    guess = resample(kept, up, 1, filters(up, 1))[: len(pcm)] if up > 1 else pcm
    rest = (pcm - guess) if up > 1 else np.zeros(0, np.int16)
    palette, index = _palette(kept)
    flags = (1 if palette is not None else 0) | (2 if rest.any() else 0)
    out = [_PACKED.pack(b"pcm1", rate, up, 0, len(pcm), flags)]
    out += [struct.pack("<H", len(palette) - 1), palette.astype("<i2").tobytes(), index.tobytes()] if palette is not None else [np.diff(kept, prepend=np.int16(0)).astype("<i2").tobytes()]
    if rest.any():
        out.append(rest.astype("<i2").tobytes())
    return b"".join(out)


def _palette(kept: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    seen = np.zeros(65536, bool)
    at = kept.view(np.uint16)
    seen[at] = True
    if not len(kept) or np.count_nonzero(seen) > 256:
        return None, None
    values = np.sort(np.flatnonzero(seen).astype(np.uint16).view(np.int16))
    place = np.zeros(65536, np.uint8)
    place[values.view(np.uint16)] = np.arange(len(values))
    return values, place[at]


def unpack_pcm(data: bytes) -> tuple[np.ndarray, int]:
    """The samples (16 bits) and their rate that `pack_pcm` stored."""
    mark, rate, up, _, n, flags = _PACKED.unpack_from(data)
    if mark != b"pcm1":
        raise ValueError("not packed PCM")
    at, held = _PACKED.size, -(-n // up)
    if flags & 1:
        size = struct.unpack_from("<H", data, at)[0] + 1
        palette = np.frombuffer(data, "<i2", size, at + 2)
        at += 2 + 2 * size
        kept = palette[np.frombuffer(data, np.uint8, held, at)]
        at += held
    else:
        kept = np.cumsum(np.frombuffer(data, "<i2", held, at), dtype=np.int16)
        at += 2 * held
    pcm = resample(kept, up, 1, filters(up, 1))[:n] if up > 1 else kept
    return (pcm + np.frombuffer(data, "<i2", n, at) if flags & 2 else pcm), rate


def describe(name: str, pcm: np.ndarray) -> str:
    """Codec, samples, root mean square, peak and zero crossings of PCM, and the CRC-32 of its bytes."""
    power = peak = 0
    for a in range(0, len(pcm), PART):
        wide = pcm[a : a + PART].astype(np.int64)
        power, peak = power + int((wide * wide).sum()), max(peak, int(np.abs(wide).max()))
    rms = math.isqrt(power // len(pcm)) if len(pcm) else 0
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{name}:{len(pcm)}:{rms}:{peak}:{turns}:{zlib.crc32(np.ascontiguousarray(pcm, '<i2')):08x}"


def encode_media(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `n_bytes` and `media`: the text's UTF-8 bytes, filled with spaces to a positive multiple of 192, as a WAVE file.

    Null and empty texts are one unit of spaces; columns named n_bytes or media are replaced.
    """

    def make():
        def run(columns):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in columns[0].to_pylist()]
            return [pa.array([len(r) for r in raw], pa.int64()), pa.array([encode(r + b" " * (-len(r) % UNIT if r else UNIT)) for r in raw], pa.binary())]

        return run

    return append_columns(df, [text], pa.schema([("n_bytes", pa.int64()), ("media", pa.binary())]), "n_bytes bigint, media binary", make)


def pcm_wave(data: bytes) -> bytes:
    """Packed PCM as a WAVE file of 16-bit samples."""
    pcm, rate = unpack_pcm(data)
    raw = np.ascontiguousarray(pcm, "<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(raw)) + raw


def decode_media(df: DataFrame, media: str = "media", rate: int = 16000) -> DataFrame:
    """df with `payload` (the coded bytes, without block headers), `codec`, and `pcm`: 16-bit samples at `rate`, as `pack_pcm`
    stores them.

    A null, or bytes that aren't mu-law, A-law or IMA ADPCM in a WAVE file of one channel, give nulls; equal bytes give equal
    values, repeated rows too; an empty table stays empty; columns of these names are replaced. Blocks of one batch are decoded
    together, whichever files they are from.
    """

    def make():
        h: dict[int, np.ndarray] = {}

        def run(columns):
            files = [None if m is None else parse(m) for m in columns[0].to_pylist()]
            payload: list = [None] * len(files)
            plain: list = [None] * len(files)
            groups: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, f in enumerate(files):
                if f is None:
                    continue
                data = np.frombuffer(f[3], np.uint8)
                if f[0] == IMA:
                    blocks = data[: len(data) // f[2] * f[2]].reshape(-1, f[2])
                    payload[i] = blocks[:, 4:].tobytes()
                    groups.setdefault(f[2], []).append((i, blocks))
                else:
                    payload[i], plain[i] = f[3].tobytes(), _LAWS[f[0]][data]
            for members in groups.values():
                made, at = decode_ima(np.concatenate([b for _, b in members])), 0
                for i, b in members:
                    plain[i], at = made[at : at + len(b)].ravel(), at + len(b)
            pcm = []
            for f, x in zip(files, plain):
                if f is None:
                    pcm.append(None)
                    continue
                g = np.gcd(rate, f[1])
                up, down = int(rate // g), int(f[1] // g)
                if f[1] not in h:
                    h[f[1]] = filters(up, down)
                pcm.append(pack_pcm(resample(x, up, down, h[f[1]]), rate, up if down == 1 else 1))
            return [pa.array(payload, pa.binary()), pa.array([None if f is None else NAMES[f[0]] for f in files], pa.string()), pa.array(pcm, pa.binary())]

        return run

    return append_columns(df, [media], pa.schema([("payload", pa.binary()), ("codec", pa.string()), ("pcm", pa.binary())]), "payload binary, codec string, pcm binary", make)


def describe_pcm(df: DataFrame, pcm: str = "pcm", codec: str = "codec") -> DataFrame:
    """df with `feature`, measured on the stored samples; null where there are none. A column named feature is replaced."""

    def make():
        def run(columns):
            return [pa.array([None if p is None else describe(c, unpack_pcm(p)[0]) for p, c in zip(columns[0].to_pylist(), columns[1].to_pylist())], pa.string())]

        return run

    return append_columns(df, [pcm, codec], pa.schema([("feature", pa.string())]), "feature string", make)


def op9_telephony_audio(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` stored as coded telephony audio, read back, decoded and resampled; the PCM is stored too,
    read back and measured."""
    stored = stage(encode_media(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "media"), "media", level=LEVEL)
    decoded = decode_media(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "codec",
        "pcm",
    )
    # samples of one codec side by side compress better
    return describe_pcm(stage(decoded.sortWithinPartitions("codec"), "pcm", level=LEVEL)).drop("codec", "pcm")
