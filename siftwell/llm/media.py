"""Media columns by signature sniffing.

Aho-Corasick locates magic bytes, a validator for each format confirms structure and
lengths, and what is confirmed at the start of a blob corrects its declared type; what
is confirmed further inside is carved as embedded media.

`store_texts` keeps each text as the samples of an 8-bit mono WAV: UTF-8, padded by
spaces to a positive multiple of 192 bytes.  It is read back through the sniffer, which
knows nothing of how the blob was made.

Defined results: null and empty texts are 192 spaces; equal texts give equal values;
magic bytes inside a text are carved only if a whole valid file follows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import append_columns, column, sliced, text_bytes

UNIT = 192
RATE = 8000


class Media(NamedTuple):
    kind: str
    start: int
    length: int
    body: tuple[int, int]  # where the payload lies, if it is stored as it is


def _wav(b: bytes, at: int) -> Media | None:
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if size < 44 or at + size > len(b):
        return None
    pos, fmt = at + 12, None
    while pos + 8 <= at + size:
        name, n = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + n > at + size:
            return None
        if name == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, pos + 8)
            if fmt[3] != fmt[2] * fmt[4] or fmt[4] != fmt[1] * fmt[5] // 8:
                return None
        elif name == b"data":
            return Media("audio/wav", at, size, (pos + 8, n)) if fmt and fmt[4] and n % fmt[4] == 0 else None
        pos += 8 + n + n % 2
    return None


def _png(b: bytes, at: int) -> Media | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        if pos + 12 + n > len(b) or first != (name == b"IHDR") or first and n != 13:
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if name == b"IEND":
            return Media("image/png", at, pos - at, (at, pos - at))
    return None


def _gif(b: bytes, at: int) -> Media | None:
    if b[at + 3 : at + 6] not in (b"87a", b"89a") or len(b) - at < 14:
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return Media("image/gif", at, pos + 1 - at, (at, pos + 1 - at))
        if b[pos] == 0x2C and pos + 10 < len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0)
        elif b[pos] == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _bmp(b: bytes, at: int) -> Media | None:
    if len(b) - at < 54:
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    wide, high, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    row = (abs(wide) * bits + 31) // 32 * 4
    if zero or planes != 1 or head < 40 or bits not in (1, 4, 8, 24, 32) or not wide or not high or size != offset + row * abs(high) or at + size > len(b):
        return None
    return Media("image/bmp", at, size, (at + offset, size - offset))


def _gzip(b: bytes, at: int) -> Media | None:
    if b[at + 2 : at + 3] != b"\x08":
        return None
    reader, pos = zlib.decompressobj(31), at
    try:
        while not reader.eof and pos < len(b):  # in steps, so that memory is bounded
            reader.decompress(reader.unconsumed_tail or b[pos : (pos := pos + 65536)], 1 << 20)
    except zlib.error:
        return None
    n = min(pos, len(b)) - at - len(reader.unused_data)
    return Media("application/gzip", at, n, (at, n)) if reader.eof else None


# Magic bytes, declared types and the validators that confirm them.
SIGNATURES = {b"RIFF": _wav, b"\x89PNG\r\n\x1a\n": _png, b"GIF8": _gif, b"BM": _bmp, b"\x1f\x8b\x08": _gzip}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, check in SIGNATURES.items():
        out.add_word(magic.decode("latin-1"), (len(magic), check))
    out.make_automaton()
    return out


def sniff(blob: bytes, declared: str | None, finder: ahocorasick.Automaton) -> tuple[str | None, Media | None, list[Media]]:
    """(corrected type, the medium that the blob is, media embedded in it).

    The type is what was confirmed at the start, else the declared one.  Embedded media
    may lie inside the outer one, but not inside one another.
    """
    outer, inner, free = None, [], 0
    for end, (size, check) in finder.iter(blob.decode("latin-1")):
        at = end + 1 - size
        if at and at < free:
            continue
        if found := check(blob, at):
            if at:
                inner.append(found)
                free = at + found.length
            else:
                outer = found
    return outer.kind if outer else declared, outer, inner


def store(text: bytes) -> bytes:
    """The text, padded, as the samples of a WAV file."""
    n = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + text.ljust(n, b" ")


def features(kind: str, samples: bytes, inner: list[Media]) -> str:
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return f"{kind};rate={RATE};samples={len(x)};sum={int(counts @ np.arange(256))};peak={int(x.max())};crossings={crossings};bits={float(-(share * np.log2(share)).sum()):.4f};embedded={'+'.join(f'{m.kind}@{m.start}:{m.length}' for m in inner) or 'none'}"


def describe(text: bytes, finder: ahocorasick.Automaton) -> tuple:
    blob = store(text)
    kind, outer, inner = sniff(blob, "application/octet-stream", finder)
    if outer is None:
        raise ValueError("a stored text can't be read back")
    at, n = outer.body
    payload = blob[at : at + n]
    sha = hashlib.sha256
    return len(text), n, sha(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), sha(blob).hexdigest(), features(kind, payload, inner)


def store_texts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, with_blob: bool = False) -> DataFrame:
    """`keep` (default: all columns) with n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256 and feature; with_blob adds the stored form."""

    def kernel():
        finder = automaton()

        def run(column):
            texts = text_bytes(column)
            made = list(zip(*[describe(t, finder) for t in texts], strict=True))
            return [*made, [store(t) for t in texts]] if with_blob else made

        return run

    long, text = T.LongType(), T.StringType()
    kinds = {"n_bytes": long, "payload_bytes": long, "payload_sha256": text, "tail_crc32": long, "media_bytes": long, "media_sha256": text, "feature": text} | ({"media": T.BinaryType()} if with_blob else {})
    return append_columns(docs, text_col, T.StructType([T.StructField(k, v) for k, v in kinds.items()]), kernel, keep)


def sniff_media(blobs: DataFrame, blob_col: str, declared_col: str, keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with media_type (the declared type, corrected) and
    embedded: array<struct<kind, start, length>>.  Null blobs keep their declared type."""
    names = [c for c in (blobs.columns if keep is None else keep) if c.lower() not in ("media_type", "embedded")]
    places = [column(c).alias(f"c{i}") for i, c in enumerate(names)]  # places stand for names until the end
    source = blobs.select(*places, column(declared_col).cast("string").alias("declared"), column(blob_col).cast("binary").alias("blob"))
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    out = T.StructType([*source.schema.fields[:-2], T.StructField("media_type", T.StringType()), T.StructField("embedded", T.ArrayType(item))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        finder = automaton()
        for batch in batches:
            for part in sliced(batch, len(names) + 1):  # so many bytes of blobs at once, or one larger blob
                found = [sniff(b or b"", d, finder) for b, d in zip(part.column(len(names) + 1).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                inner = [[{"kind": m.kind, "start": m.start, "length": m.length} for m in x[2]] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array([x[0] for x in found], pa.string()), pa.array(inner, to_arrow_type(T.ArrayType(item)))], names=out.names)

    return source.mapInArrow(run, out).toDF(*names, "media_type", "embedded")
