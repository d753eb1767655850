"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (its wire format is small), and the tokenizer is rebuilt
from it: normaliser, metaspace marker, pieces with scores (unigram, or the merges that BPE
scores stand for) and byte fallback.  Texts are cut before each run of spaces, where no
piece crosses, and each distinct piece of text is encoded once in multithreaded batches.
Parity is verified: what the rebuilt tokenizer gives for each distinct chunk is compared
with the SentencePiece library, and where the two differ (ties between merges of one score)
the latter's ids are used and the row is marked.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.memo import Memo, kept
from ledgerline.llm.shared import ready, utf8

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message; 4 and 8 byte values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} is not part of a model file")
            size = varint()
        yield number, data[at:at + size]
        at += size


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in wire_fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in wire_fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in wire_fields(value):
                    if n == 3:
                        model.kind = v
                    elif n == 35:
                        model.byte_fallback = bool(v)
            elif number == 3:
                for n, v in wire_fields(value):
                    if n == 2:
                        model.charsmap = v
                    elif n == 3:
                        model.add_dummy_prefix = bool(v)
                    elif n == 4:
                        model.remove_extra_whitespaces = bool(v)
        return model

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def tokenizer(self):
        """The rebuilt tokenizer.  It takes chunks: the dummy prefix is the caller's."""
        from tokenizers import Regex, Tokenizer, models, normalizers
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra_whitespaces:
            steps.append(normalizers.Replace(Regex(" {2,}"), " "))
        steps.append(normalizers.Replace(" ", MARK))
        if self.kind == UNIGRAM:
            inner = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            inner = models.BPE(ids, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True,
                               byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are known")
        out = Tokenizer(inner)
        out.normalizer = normalizers.Sequence(steps)
        return out

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces in the order in which BPE joins them: by the joined piece's score."""
        known = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        ranked = sorted((p for p in known if len(p) > 1), key=lambda p: -known[p])
        return [(p[:i], p[i:]) for p in ranked for i in range(1, len(p)) if p[:i] in known and p[i:] in known]

    @property
    def cuttable(self) -> bool:
        """Whether no piece holds the mark after another character."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER)) \
            and not self.charsmap and not self.remove_extra_whitespaces


_CHUNK = re.compile(rb"[^ ]+| +[^ ]*")


class Codec:
    """Encoder and decoder of one model.  ``threads``: of the library's batches."""

    def __init__(self, data: bytes, threads: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece
        self.threads = threads
        self.model = Model.parse(data)
        self.cuttable = self.model.cuttable
        self.tokenizer = self.model.tokenizer()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.unequal: set[bytes] = set()  # chunks on which the libraries differ: rare
        self.unlike: set[bytes] = set()   # chunks that do not decode to themselves
        self.memo = Memo(self._encode)
        self.dummy = b" " if self.model.add_dummy_prefix else b""
        self.bytes_of = [self._surface(p, kind) for p, _, kind in self.model.pieces]

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def chunks(self, text: bytes) -> list[bytes]:
        """The text with its dummy prefix, cut before each run of spaces; or whole."""
        if not text:
            return []
        return _CHUNK.findall(self.dummy + text) if self.cuttable else [text]

    def _verified(self, chunks: list[bytes]) -> list[list[int]]:
        """The SentencePiece library's ids of chunks.  It puts the dummy prefix itself."""
        spaced = self.cuttable and bool(self.dummy)
        found = self.library.encode([(c[1:] if spaced and c[:1] == b" " else c).decode() for c in chunks],
                                    num_threads=self.threads)
        if spaced and b" " in chunks:  # the library gives nothing for the empty text
            found[chunks.index(b" ")] = self.library.encode("a ", num_threads=1)[1:]
        return found

    def _encode(self, chunks: list[bytes]) -> Iterator[bytes]:
        prefix = b"" if self.cuttable else self.dummy
        found = self.tokenizer.encode_batch_fast([(prefix + c).decode() for c in chunks], add_special_tokens=False)
        mark = MARK.encode()
        for chunk, encoding, truth in zip(chunks, found, self._verified(chunks)):
            ids = encoding.ids
            if ids != truth:
                self.unequal.add(chunk)
                ids = truth
            if self.decode_bytes(ids) != (prefix + chunk).replace(mark, b" "):
                self.unlike.add(chunk)
            yield np.array(ids, "<u4").tobytes()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ids: marks are spaces again, the dummy prefix goes, bytes that are no
        UTF-8 become the replacement character."""
        out = self.decode_bytes(ids)
        return (out[1:] if self.dummy and out.startswith(b" ") else out).decode(errors="replace")

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bool, bool]]:
        """Ids (little-endian u32) of each text, whether the two libraries agree on all its
        chunks, and whether all of them decode to themselves."""
        cut = [self.chunks(t) for t in texts]
        self.memo.learn(cut)
        return [(b"".join(map(self.memo.__getitem__, chunks)), self.unequal.isdisjoint(chunks),
                 self.unlike.isdisjoint(chunks)) for chunks in cut]


def encode_pieces(df: DataFrame, text_col: str, model_file: str, keep: dict[str, str], threads: int = 2,
                  with_ids: bool = True) -> DataFrame:
    """One row for each row of ``df``: the columns of ``keep`` (new name: column),
    ``n_pieces``, ``ids_crc32`` (of the ids as little-endian u32), ``parity`` (the rebuilt
    tokenizer gave these very ids), ``round_trip`` (decoding gives the text, a literal mark
    read as a space) and, if asked for, ``ids``.

    Null and empty texts have no pieces; repeated rows are rows of their own; an empty table
    gives no rows; other columns take no part."""
    spark = df.sparkSession
    ready(spark)
    with open(model_file, "rb") as f:  # on the driver; executors get the contents
        shipped = spark.sparkContext.broadcast(f.read())
    rows = df.select(*[F.col(c).alias(f"k_{n}") for n, c in keep.items()], F.col(text_col).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("pieces", hash(shipped.value), threads), lambda: Codec(shipped.value, threads))
        for batch in batches:
            found = codec.encode(utf8(batch.column("text")))
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([len(f[0]) // 4 for f in found], pa.int64()),
                        pa.array([zlib.crc32(f[0]) for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.bool_())]
            if with_ids:
                ends = np.cumsum([0, *(len(f[0]) // 4 for f in found)])
                ids = np.frombuffer(b"".join([f[0] for f in found]), "<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [f"k_{n}" for n in keep] + ["n_pieces", "ids_crc32", "parity", "round_trip"] + ["ids"] * with_ids
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    fields += ["n_pieces long", "ids_crc32 long", "parity boolean", "round_trip boolean"] + ["ids array<int>"] * with_ids
    out = rows.mapInArrow(encoded, ", ".join(fields))
    return out.select(*[F.col(f"k_{n}").alias(n) for n in keep], *names[len(keep):])


def decode_pieces(df: DataFrame, ids_col: str, model_file: str, keep: dict[str, str], threads: int = 1) -> DataFrame:
    """One row for each row of ``df``: the columns of ``keep`` and ``text``, the decoded ids.
    Null ids give a null text."""
    spark = df.sparkSession
    ready(spark)
    with open(model_file, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    rows = df.select(*[F.col(c).alias(f"k_{n}") for n, c in keep.items()], F.col(ids_col).alias("ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("pieces", hash(shipped.value), threads), lambda: Codec(shipped.value, threads))
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string())],
                                             names=[*batch.schema.names[:-1], "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    out = rows.mapInArrow(decoded, ", ".join([*fields, "text string"]))
    return out.select(*[F.col(f"k_{n}").alias(n) for n in keep], "text")
