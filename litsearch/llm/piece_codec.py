"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by longest prefix through the model's compiled character
map (a double-array trie). While it is rewritten, every byte of the normalised
text records the source byte it came from, so that each piece can be projected
back to a span of the original UTF-8 bytes.

The normalised text is then cut where no piece of the vocabulary can reach
across: before a word mark that follows another character, and around white
space characters that occur in no piece. Merges never cross such a cut, so
each unit can be segmented on its own and the result remembered; a unit that
was seen before costs one dictionary look-up.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import narrow

MARK = "▁"  # the word mark that stands for a space; fixed by the format
UNITS_REMEMBERED = 300_000  # look-up entries per task before the memory is cleared


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class CharacterMap:
    """The compiled map: a double-array trie from UTF-8 keys to replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", count=size // 4, offset=4).tolist()
            self.replacements = blob[4 + size:]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(key length, replacement) of the longest key that ``data`` has at ``start``."""
        if not self.units:
            return None
        node, found = self._jump(0), None
        for length, byte in enumerate(data[start:], 1):
            node ^= byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = length, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1]:end]

    def _jump(self, node: int) -> int:
        return node ^ self._offset(self.units[node])

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class PieceCodec:
    """Encoder and decoder for one model file; built once per task."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.dummy_prefix = rules.add_dummy_prefix
        self.squeeze = rules.remove_extra_whitespaces
        self.space = MARK.encode() if rules.escape_whitespaces else b" "
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with the word mark as a suffix are not supported")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # the same vocabulary for text that is already normalised
        rules.precompiled_charsmap = b""
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = False
        self.units = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [p.piece for p in model.pieces if p.type not in (2, 3, 6)]  # but control, unknown and byte pieces
        self.byte_ids = frozenset(i for i, p in enumerate(model.pieces) if p.type == 6)
        self.lengths = [struct.pack("<H", 1 if p.type == 6 else len(p.piece.encode())) for p in model.pieces]
        self.written = [str(i) for i in range(len(model.pieces))]
        inside = any(MARK in p.lstrip(MARK) for p in pieces)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in pieces))
        self.short_lines = "\n" in alone and not inside and model.trainer_spec.byte_fallback
        if inside or not model.trainer_spec.byte_fallback:
            self.cut = re.compile(r"(?s).+")  # pieces may reach across words: no cuts
        else:
            self.cut = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.known: dict[str, tuple[list[int], str, bytes]] = {}

    # normalisation ---------------------------------------------------------
    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, per byte and for the end, the source byte it came from."""
        data = text.encode()
        if not self.map.units and not self.squeeze:
            return self._plain(data)
        out, source = bytearray(), []

        def emit(piece: bytes, at: int):
            for byte in piece:
                part = self.space if byte == 0x20 else bytes([byte])
                out.extend(part)
                source.extend([at] * len(part))

        at, end = 0, len(data)
        if self.squeeze:
            while at < end:
                length, piece = self._step(data, at)
                if piece != b" ":
                    break
                at += length
        if at < end and self.dummy_prefix:
            emit(b" ", at)
        after_space = self.squeeze
        while at < end:
            length, piece = self._step(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                emit(piece, at)
                after_space = self.squeeze and piece.endswith(b" ")
            at += length
        if self.squeeze:
            while out.endswith(self.space):
                at = source[len(out) - len(self.space)]
                del out[-len(self.space):], source[-len(self.space):]
        return bytes(out), np.array([*source, at], np.int64)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same without a map: only spaces change, each source byte once."""
        width = np.ones(len(data), np.uint8)
        width[np.frombuffer(data, np.uint8) == 0x20] = len(self.space)
        source = np.repeat(np.arange(len(data), dtype=np.int32), width)
        lead = self.space if data and self.dummy_prefix else b""
        return (lead + data.replace(b" ", self.space),
                np.concatenate([np.zeros(len(lead), np.int32), source, [np.int32(len(data))]]))

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at)
        if found is not None:
            return found
        first = data[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return length, data[at:at + length]

    # encoding --------------------------------------------------------------
    def units_of(self, normal: str) -> list[str]:
        """Cut a normalised text into units.

        A text whose word marks all stand alone takes the short way: cut at the
        marks, and before line ends. There a unit's leading mark is left out, and
        one without a mark begins with its line end. ``_full`` undoes this. Units
        of the other way have a NUL before them, so that the two never mix.
        """
        if self.short_lines and normal[:1] == MARK and MARK * 2 not in normal and "\0" not in normal:
            return normal.replace("\n", MARK + "\n").split(MARK)[1:]
        return ["\0" + u for u in self.cut.findall(normal)]

    @staticmethod
    def _full(unit: str) -> str:
        return unit[1:] if unit[:1] == "\0" else unit if unit[:1] == "\n" else MARK + unit

    def learn(self, units: set[str]) -> None:
        """Segment the units that are not known yet, in one call."""
        if len(self.known) > UNITS_REMEMBERED:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        known, lengths, written = self.known, self.lengths, self.written
        for unit, ids in zip(new, self.units.encode([self._full(u) for u in new], num_threads=1) if new else []):
            known[unit] = (ids, ",".join([written[i] for i in ids]), b"".join([lengths[i] for i in ids]))

    def segment(self, normals: list[str]) -> Iterator[list[tuple[list[int], str, bytes]]]:
        """Per normalised text what is known of its units, in order."""
        cuts = [self.units_of(n) for n in normals]
        self.learn(set().union(*cuts))
        for units in cuts:
            yield [self.known[u] for u in units]

    @staticmethod
    def ids_of(units: list) -> list[int]:
        return list(chain.from_iterable([u[0] for u in units]))

    @staticmethod
    def ends(units: list, source: np.ndarray) -> np.ndarray:
        """Per piece the source byte just after it; a piece begins where the one before ended."""
        return source[np.cumsum(np.frombuffer(b"".join([u[2] for u in units]), "<u2"), dtype=np.int64)]

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


def _encoded(batches: Iterator[pd.Series], path: str, digest: bool) -> Iterator[pd.DataFrame]:
    codec = PieceCodec(path)
    for texts in batches:
        rows = []
        values = texts.tolist()
        for k in range(0, len(values), 200):  # so many texts at a time are held normalised
            normals = [codec.normalize(t) for t in values[k:k + 200]]
            plain = [n.decode() for n, _ in normals]
            for units, (_, source) in zip(codec.segment(plain), normals):
                ids = codec.ids_of(units)
                ends = codec.ends(units, source)
                text = codec.decode(ids)
                if digest:
                    rows.append((len(ids), hashlib.sha256(",".join([u[1] for u in units]).encode()).hexdigest(),
                                 hashlib.sha256(text.encode()).hexdigest(),
                                 hashlib.sha256(ends.astype("<i8").tobytes()).hexdigest()))
                else:
                    rows.append((ids, np.concatenate([[0], ends[:-1]]).astype(np.int64) if ids else [], ends, text))
        names = (["n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"] if digest
                 else ["ids", "begins", "ends", "decoded"])
        yield pd.DataFrame(rows, columns=names)


def encode(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """Encode and decode every whole text (null: empty).

    Returns doc_id and ``ids``, ``begins``, ``ends`` (source byte span of every
    piece; spans join without gaps) and ``decoded``; with ``digest`` instead
    ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``ends_sha256``, so that
    no id leaves the task. One row per input row: nulls, repeated rows and very
    long texts are ordinary rows, an empty text has no ids.
    """
    path = path or model_path()
    fields = ("n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string" if digest else
              "ids array<int>, begins array<long>, ends array<long>, decoded string")

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _encoded(batches, path, digest)

    return narrow(docs).select("doc_id", run("text").alias("_e")).select("doc_id", "_e.*")
