"""SentencePiece encoding with original byte spans, and decoding.

The model file's normaliser is read as it is compiled: a map from character sequences to replacements in a
double-array trie. Normalising takes the longest entry that matches at each place, else one character, and
notes which original bytes each normalised byte came from; then come the model's rules for spaces. The normalised
text is segmented by the library, which is given the model without its normaliser. As the pieces spell the
normalised text end to end, their lengths project every piece through the notes to the bytes of the original
text that it stands for.

Defined results: a null text is empty; an empty text has the begin and end ids only and spans of no bytes;
malformed UTF-8 is read as U+FFFD, whose spans are the malformed bytes; a piece that the model doesn't know spans what
it stands for; texts over ``long_text`` characters are segmented in parts, cut before a space mark, which no
piece of the model crosses, so that memory stays bounded and ids don't change.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

SPACE = "▁"


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + size], at + size
        yield number, value


@dataclass
class ModelFile:
    """What the encoder needs of a model file."""

    pieces: list[str]
    kinds: list[int]
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix: bool = False
    unknown: int = 0

    @classmethod
    def read(cls, path: str) -> ModelFile:
        with open(path, "rb") as f:
            raw = f.read()
        out = cls([], [])
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                out.pieces.append(piece.get(1, b"").decode())
                out.kinds.append(piece.get(3, 1))
            elif number == 2:
                out.suffix = bool(dict(fields(value)).get(24, 0))
            elif number == 3:
                spec = dict(fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.remove_extra, out.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        out.unknown = out.kinds.index(2)
        return out


class CharacterMap:
    """The compiled map: longest entry at a place of a byte string."""

    def __init__(self, compiled: bytes):
        self.units, self.replacements = np.zeros(0, np.uint32), b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, np.uint32, size // 4, 4)
            self.replacements = compiled[4 + size :]
        #: Bytes that begin an entry; elsewhere nothing needs to be looked up.
        self.begins = np.array([len(self.units) > 0 and self._step(0, b) is not None for b in range(256)])

    def _step(self, node: int, byte: int) -> int | None:
        node ^= self._offset(int(self.units[node])) ^ byte
        return node if node < len(self.units) and int(self.units[node]) & 0x800000FF == byte else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest entry at ``at``."""
        node, found = 0, None
        for n, place in enumerate(range(at, len(raw)), 1):
            node = self._step(node, raw[place])
            if node is None:
                break
            unit = int(self.units[node])
            if unit >> 8 & 1:
                leaf = int(self.units[node ^ self._offset(unit)]) & 0x7FFFFFFF
                found = n, self.replacements[leaf : self.replacements.index(b"\0", leaf)]
        return found


@dataclass
class Normalised:
    """Normalised bytes; ``source[i]`` is the original byte offset at normalised byte i, one more at the end."""

    raw: bytes
    source: np.ndarray


_malformed: list[tuple[int, int]] = []


def _note(error: UnicodeError) -> tuple[str, int]:
    _malformed.append((error.start, error.end))
    return "\ufffd", error.end


codecs.register_error("note-malformed", _note)


def repaired(text: bytes) -> tuple[bytes, np.ndarray | None]:
    """The text with U+FFFD for what is malformed and, if there was any, the original offset of each byte and the end."""
    _malformed.clear()
    good = text.decode("utf-8", "note-malformed")
    if not _malformed:
        return text, None
    parts, done = [], 0
    for start, end in _malformed:
        parts += [np.arange(done, start), np.full(3, start)]
        done = end
    return good.encode(), np.concatenate([*parts, np.arange(done, len(text) + 1)])


def without_normaliser(raw: bytes) -> bytes:
    """A model file whose normaliser (field 3) leaves texts as they are: no map, prefix, squeezing or escapes."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    out = []
    for number, value in fields(raw):
        if number != 3:
            out += [varint(number << 3 | 2), varint(len(value)), value]
    plain = bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
    return b"".join([*out, varint(3 << 3 | 2), varint(len(plain)), plain])


class PieceCodec:
    def __init__(self, path: str, long_text: int = 1 << 20):
        import sentencepiece

        self.file, self.long_text = ModelFile.read(path), long_text
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=without_normaliser(f.read()))
        #: Symbols that are never normalised, longest first.
        self.symbols = sorted((p.encode() for p, k in zip(self.file.pieces, self.file.kinds, strict=True) if k == 4), key=len, reverse=True)
        self.map = CharacterMap(self.file.charsmap)
        byte = 6  # the kind of a piece that stands for one byte
        self.sizes = np.array([0 if k == 3 else 1 if k == byte else len(p.encode()) for p, k in zip(self.file.pieces, self.file.kinds, strict=True)], np.int64)
        self.mark = SPACE if self.file.escape else " "
        self.cuttable = not any(self.mark in p.lstrip(self.mark) for p in self.file.pieces)

    def normalise(self, text: bytes) -> Normalised:
        out, source = self._mapped(text)
        mark = self.mark.encode()
        if self.file.remove_extra:
            keep = np.ones(len(out), bool)
            spaces = np.frombuffer(out, np.uint8) == 32
            keep[1:] &= ~(spaces[1:] & spaces[:-1])
            words = np.flatnonzero(~spaces)
            keep[: words[0] if len(words) else len(out)] = False
            keep[words[-1] + 1 if len(words) else 0 :] = False
            out, source = np.frombuffer(out, np.uint8)[keep].tobytes(), np.append(source[:-1][keep], source[-1])
        if not out:
            return Normalised(b"", np.array([len(text)]))
        at = np.frombuffer(out, np.uint8)
        wide = np.where(at == 32, len(mark), 1)
        # The bytes of a mark lie where its space does; the next byte ends it.
        starts = np.repeat(source[:-1], wide)
        raw = out.replace(b" ", mark)
        if self.file.dummy_prefix:
            raw = raw + mark if self.file.suffix else mark + raw
            starts = np.concatenate([starts, np.full(len(mark), source[-1])]) if self.file.suffix else np.concatenate([np.full(len(mark), source[0]), starts])
        return Normalised(raw, np.append(starts, source[-1]))

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text after the character map, with source offsets."""
        if not self.map.begins.any():
            return text, np.arange(len(text) + 1)
        begins = self.map.begins.copy()
        begins[[x[0] for x in self.symbols]] = True
        hits = np.flatnonzero(begins[np.frombuffer(text, np.uint8)]).tolist()
        parts, sources, done = [], [], 0
        for at in hits:
            if at < done or text[at] & 0xC0 == 0x80:
                continue
            symbol = next((x for x in self.symbols if text.startswith(x, at)), None)
            found = (len(symbol), symbol) if symbol else self.map.longest(text, at)
            if found is None:
                continue
            parts += [text[done:at], found[1]]
            same = symbol or found[0] == len(found[1]) == 1
            sources += [np.arange(done, at), np.arange(at, at + found[0]) if same else np.full(len(found[1]), at)]
            done = at + found[0]
        parts.append(text[done:])
        sources.append(np.arange(done, len(text) + 1))
        return b"".join(parts), np.concatenate(sources)

    def parts(self, text: str) -> Iterator[str]:
        """A normalised text in parts of about ``long_text`` characters, cut before marks that follow other characters."""
        at = 0
        while self.cuttable and len(text) - at > self.long_text:
            to = at + self.long_text
            while (to := text.find(self.mark, to)) >= 0 and text[to - 1] == self.mark:
                to += 1
            if to < 0:
                break
            yield text[at:to]
            at = to
        yield text[at:] if at else text

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, spans), begin and end included: for each id the first original byte and the one after its last."""
        text, origin = repaired(text)
        normal = self.normalise(text)
        ids, sizes = [[self.library.bos_id()]], [np.zeros(1, np.int64)]
        for part in self.parts(normal.raw.decode()):
            found = np.array(self.segmenter.encode(part), np.int64)
            size = self.sizes[found]
            if self.file.unknown in found:  # pieces of any length
                size = np.array([len(p.surface.encode()) for p in self.segmenter.encode(part, out_type="immutable_proto").pieces], np.int64)
            ids.append(found)
            sizes.append(size)
        sizes = np.concatenate([*sizes, np.zeros(1, np.int64)])
        ends = np.cumsum(sizes)
        spans = np.stack([normal.source[ends - sizes], normal.source[ends]], axis=1)
        return np.concatenate([*ids, [self.library.eos_id()]]), spans if origin is None else origin[spans]

    def ids(self, text: bytes) -> list[int]:
        return self.encode(text)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and, for each text: ids, starts and ends (original bytes) of its pieces, and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch, texts in slices(batches, "text"):
            found = [c.encode(t) for t in texts]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([s[:, 0] for _, s in found], longs), pa.array([s[:, 1] for _, s in found], longs),
                 pa.array([c.decode(i.tolist()) for i, _ in found], pa.string())],
                [*keep, "ids", "starts", "ends", "decoded"],
            )

    rows = docs.select(F.col(text_col).alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[1:]), "ids array<int>, starts array<bigint>, ends array<bigint>, decoded string"]))


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids, decoded text and spans (starts and ends by turns, as little-endian unsigned
    64-bit integers) for every document: ``encoded`` digested in the task."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch, texts in slices(batches, "text"):
            n, ids_sha, text_sha, spans_sha = [], [], [], []
            for t in texts:
                ids, spans = c.encode(t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids.tolist()).encode()).hexdigest())
                spans_sha.append(hashlib.sha256(spans.astype("<u8").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (ids_sha, text_sha, spans_sha))], names)

    rows = docs.select("text", "doc_id")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
