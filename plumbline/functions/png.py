"""Decode and encode image samples; small helpers run inside tasks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the PNG format: signature and samples per pixel by color type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES_PER_PIXEL = {0: 1, 2: 3, 4: 2, 6: 4}


class UnsupportedImage(ValueError):
    """The bytes are not the kind of PNG the caller needs."""


def header(data: bytes) -> tuple[int, int, int, int]:
    """``(width, height, bit_depth, color_type)`` from the IHDR chunk."""
    if len(data) < 33 or data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise UnsupportedImage("not a PNG")
    width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    if interlace:
        raise UnsupportedImage("interlaced PNG")
    return width, height, depth, color


def lines(data: bytes, bit_depth: int, color_type: int) -> np.ndarray:
    """The unpacked rows, a filter byte before each; all that can be wrong with an image is found here."""
    width, height, depth, color = header(data)
    if (depth, color) != (bit_depth, color_type):
        raise UnsupportedImage(f"bit depth {depth} color type {color}")
    packed, at = [], 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8:at + 8 + size])
        at += 12 + size
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as error:
        raise UnsupportedImage(f"broken image data: {error}") from error
    stride = width * SAMPLES_PER_PIXEL[color] * depth // 8
    if len(raw) != height * (stride + 1):
        raise UnsupportedImage("truncated image data")
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    if rows[:, 0].max(initial=0) > 4:
        raise UnsupportedImage(f"filter {rows[:, 0].max()}")
    return rows


def samples(stack: np.ndarray, bit_depth: int, color_type: int) -> np.ndarray:
    """Exact samples as ``images x height x width x channels`` of images of one size, given as their stacked :func:`lines`."""
    channels = SAMPLES_PER_PIXEL[color_type]
    step = channels * bit_depth // 8
    count, height, stride = stack.shape[0], stack.shape[1], stack.shape[2] - 1
    width = stride // step
    out = _unfiltered(stack[:, :, 0], stack[:, :, 1:].reshape(count, height, width, step))
    if bit_depth == 16:
        return np.ascontiguousarray(out).reshape(count, height, width, channels, 2).view(">u2").astype(np.uint16).reshape(count, height, width, channels)
    return out.reshape(count, height, width, channels)


def decode(data: bytes, bit_depth: int, color_type: int) -> np.ndarray:
    """Exact samples as ``height x width x channels``; any other encoding is rejected."""
    return samples(lines(data, bit_depth, color_type)[None], bit_depth, color_type)[0]


def _guess(kinds: np.ndarray, left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What each filter takes off a byte: 0 nothing, 1 left, 2 above, 3 their mean, 4 the nearest of the three to left + above - corner."""
    near_left, near_above, near_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
    nearest = np.where((near_left <= near_above) & (near_left <= near_corner), left, np.where(near_above <= near_corner, above, corner))
    return np.choose(kinds, [np.zeros_like(left), left, above, (left + above) // 2, nearest])


def _unfiltered(filters: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Bytes of ``images x height x width x step`` with the row filters undone.

    A byte needs its left, upper and upper left neighbours, so all pixels of one diagonal of all images are computed at once.
    """
    if not filters.any():
        return body
    count, height, width, step = body.shape
    coded, out = body.astype(np.int32), np.zeros((count, height + 1, width + 1, step), np.int32)
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        kinds = np.broadcast_to(filters[:, y, None], (count, len(y), step))
        out[:, y + 1, x + 1] = (coded[:, y, x] + _guess(kinds, out[:, y + 1, x], out[:, y, x + 1], out[:, y, x])) & 255
    return out[:, 1:, 1:].astype(np.uint8)


def encode(samples: np.ndarray, bit_depth: int, color_type: int, filters: np.ndarray | None = None) -> bytes:
    """Inverse of :func:`decode`, for sinks and test captures; ``filters`` holds a kind per row (none: 0)."""
    return encode_all(samples[None], bit_depth, color_type, filters)[0]


def encode_all(samples: np.ndarray, bit_depth: int, color_type: int, filters: np.ndarray | None = None) -> list[bytes]:
    """:func:`encode` for images of one size, ``images x height x width x channels``."""
    count, height, width = samples.shape[:3]
    body = np.frombuffer(samples.astype(">u2" if bit_depth == 16 else np.uint8).tobytes(), np.uint8).reshape(count, height, width, -1)
    kinds = np.zeros(height, np.uint8) if filters is None else filters.astype(np.uint8)
    framed = np.pad(body.astype(np.int32), ((0, 0), (1, 0), (1, 0), (0, 0)))
    guess = _guess(np.broadcast_to(kinds[:, None, None], body.shape), framed[:, 1:, :-1], framed[:, :-1, 1:], framed[:, :-1, :-1])
    coded = ((framed[:, 1:, 1:] - guess) & 255).astype(np.uint8).reshape(count, height, -1)
    raw = np.concatenate([np.broadcast_to(kinds[:, None], (count, height, 1)), coded], axis=2)

    def chunk(kind: bytes, payload: bytes) -> bytes:
        return struct.pack(">I", len(payload)) + kind + payload + struct.pack(">I", zlib.crc32(kind + payload))

    ihdr = struct.pack(">IIBBBBB", width, height, bit_depth, color_type, 0, 0, 0)
    return [SIGNATURE + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(image.tobytes())) + chunk(b"IEND", b"") for image in raw]
