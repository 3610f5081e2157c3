"""SentencePiece encoding that keeps the byte span of every piece in the text as given, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm import common

SPACE_MARK = "▁"
MALFORMED = "�".encode()
# Words whose pieces a worker remembers before it starts afresh.
REMEMBERED = 200_000


class CharMap:
    """The compiled character map of a model: a double-array trie over UTF-8 bytes, and the strings it leads to.

    The blob is the trie's size in bytes, the trie's 32-bit units and the zero-ended replacements.
    """

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]
        self.known: dict[int, bytes] = {}

    def replacement(self, at: int) -> bytes:
        if at not in self.known:
            self.known[at] = self.strings[at : self.strings.index(b"\0", at)]
        return self.known[at]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that the data has at this place."""
        if not self.units:
            return None
        best, node = None, self._jump(self.units[0])
        for i in range(start, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                best = (i + 1 - start, self.units[node] & 0x7FFFFFFF)
        return best and (best[0], self.replacement(best[1]))


class Encoded(NamedTuple):
    """Ids, the end id last, and for each but that one the bytes [begin, end) of the text that it stands for.

    ``shown`` are the ids as decimal numbers with single spaces between them.
    """

    ids: np.ndarray
    shown: str
    begins: np.ndarray
    ends: np.ndarray


class Encoder:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb2

        self.model = SentencePieceProcessor(model_file=path)
        spec = pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        self.rules, train = spec.normalizer_spec, spec.trainer_spec
        self.suffix = train.treat_whitespace_as_suffix
        self.map = CharMap(self.rules.precompiled_charsmap)
        self.unknown = self.model.unk_id()
        kinds = pb2.ModelProto.SentencePiece
        own = sorted((p.piece.encode() for p in spec.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, own))).match if own else None
        # Bytes that each piece takes up in the normalised text.
        self.sizes = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in spec.pieces], dtype="int64")
        # Characters stay as they are, but for spaces.
        self.plain = not self.map.units and not self.rules.remove_extra_whitespaces and self.rules.escape_whitespaces
        # Byte-pair pieces that hold the mark in front only never reach over the beginning of a word.
        self.by_word = (
            self.plain
            and self.own is None
            and train.model_type == pb2.TrainerSpec.BPE
            and train.byte_fallback
            and self.rules.add_dummy_prefix
            and not self.suffix
            and not any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in spec.pieces if p.type == kinds.NORMAL)
        )
        self.seen: dict[str, tuple[bytes, str]] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the place in the text that it comes from."""
        data = text.encode()
        mark = SPACE_MARK.encode() if self.rules.escape_whitespaces else b" "
        if self.plain:
            return self._plain(data)
        parts: list[tuple[bytes, int, int]] = []  # (replacement, from, to)
        at = 0
        while at < len(data):
            found = self.own and self.own(data, at)
            if found:
                took, put = len(found[0]), found[0]
            else:
                match = self.map.longest(data, at)
                took, put = match or self._character(data, at)
            parts.append((put, at, at + took))
            at += took
        if self.rules.remove_extra_whitespaces:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
        out, origin = bytearray(), []
        tidy = self.rules.remove_extra_whitespaces
        first = parts[0][1] if parts else 0
        if parts and self.rules.add_dummy_prefix and not self.suffix:
            out += mark
            origin += [first] * len(mark)
        after_space = tidy
        for put, begin, _ in parts:
            if tidy and after_space:
                put = put.lstrip(b" ")
            for byte in put:
                unit = mark if byte == 32 else bytes((byte,))
                out += unit
                origin += [begin] * len(unit)
            if put:
                after_space = put.endswith(b" ")
        stop = parts[-1][2] if parts else first
        if tidy:
            while out.endswith(mark) and len(out) >= len(mark) and origin:
                stop = origin[len(out) - len(mark)]
                del out[-len(mark) :], origin[-len(mark) :]
        if parts and self.rules.add_dummy_prefix and self.suffix:
            out += mark
            origin += [stop] * len(mark)
        return bytes(out), np.array([*origin, stop], dtype="int64")

    @staticmethod
    def _character(data: bytes, at: int) -> tuple[int, bytes]:
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, data[at : at + size]

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        mark = SPACE_MARK.encode()
        if not data:
            return b"", np.zeros(1, dtype="int64")
        widths = np.where(np.frombuffer(data, "u1") == 32, len(mark), 1)
        origin = np.append(np.repeat(np.arange(len(data)), widths), len(data))
        body = data.replace(b" ", mark)
        if not self.rules.add_dummy_prefix:
            return body, origin
        if self.suffix:
            return body + mark, np.append(origin, [len(data)] * len(mark))
        return mark + body, np.append(np.zeros(len(mark), dtype="int64"), origin)

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids without the end id, the bytes each takes up in the normalised text, and the ids as text."""
        if not self.by_word or SPACE_MARK in text:
            ids = np.array(self.model.encode(text), dtype="int64")
            sizes = self.sizes[ids]
            if (ids == self.unknown).any():
                surfaces = self.model.encode(text, out_type=str)
                sizes = np.where(ids == self.unknown, [len(p.encode()) for p in surfaces], sizes)
            return ids, sizes, list(map(str, ids))
        if not text:
            return np.empty(0, "int64"), np.empty(0, "int64"), []
        # The prefix is a space more in front; each word is encoded with its own spaces, of which the model adds one.
        tight = "  " not in text and text[0] != " " and text[-1] != " "
        words = text.split(" ") if tight else [w[1:] for w in re.findall(r" +[^ ]+| +$", " " + text)]
        seen, parts = self.seen, []
        for word in words:
            found = seen.get(word)
            if found is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                own = self.model.encode(word) if word else [self.model.piece_to_id(SPACE_MARK)]
                found = seen[word] = (np.array(own, "<i4").tobytes(), " ".join(map(str, own)))
            parts.append(found)
        ids = np.frombuffer(b"".join([p[0] for p in parts]), "<i4")
        return ids, self.sizes[ids], [p[1] for p in parts]

    def encode(self, text: str) -> Encoded:
        ids, sizes, shown = self._ids(text)
        normal, origin = self.normalise(text)
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        end = self.model.eos_id()
        return Encoded(np.append(ids, end), " ".join([*shown, str(end)]), origin[ends - sizes], origin[ends])

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, kept with what it remembers from task to task."""
    return Encoder(path)


def _encoders(path: str, docs: DataFrame, text: str, key: str, row, schema: str) -> DataFrame:
    """Apply ``row(encoder, encoded)`` to every text; null texts count as empty, every row is returned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        for batch in batches:
            rows = [row(encoder, encoder.encode(t)) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out.insert(0, "key", batch["key"].to_numpy())
            yield out

    common.bounded_batches(docs.sparkSession)
    rows = common.spread(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per text its ids with the end id, the byte span of each but that one, and the decoded text.

    ``begins`` and ``ends`` count bytes of the UTF-8 text as given; the spans follow each other and cover it but for
    what normalisation drops.
    """

    def row(encoder: Encoder, found: Encoded) -> tuple:
        return found.ids.tolist(), found.begins.tolist(), found.ends.tolist(), encoder.decode(found.ids)

    return _encoders(path, docs, text, key, row, "ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What ``encode`` gives, as counts and digests made where it is encoded, so that no arrays travel."""

    def row(encoder: Encoder, found: Encoded) -> tuple:
        spans = np.stack([found.begins, found.ends], axis=1).astype("<i8").tobytes()
        return (
            len(found.ids),
            hashlib.sha256(found.shown.encode()).hexdigest(),
            hashlib.sha256(encoder.decode(found.ids).encode()).hexdigest(),
            zlib.crc32(spans),
        )

    return _encoders(path, docs, text, key, row, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
