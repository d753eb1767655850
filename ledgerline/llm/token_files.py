"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries.

Documents are range-partitioned by id and sorted, so the files hold them in ascending
order.  Each task cuts its documents into segments; a segment's file image holds the ids of
its documents, concatenated, and their boundaries as an Elias-Fano sequence: the low bits
of each offset packed, the high bits in unary, and a sample of every 64th offset's place,
so one offset is found without decoding the others.  Segments are rows of a Parquet table
(Spark's committer keeps retries and lost executors safe); a second table holds the number
of ids before each task, one row per task.

File image: ``EFT1``, then little-endian u64 documents, u64 ids, u64 bytes of the low bits,
u64 bytes of the high bits, u8 low bits per offset, u8 bytes per id, and the four arrays:
low bits, high bits, u32 samples, ids.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.memo import kept
from ledgerline.llm.shared import ready, shared_dir

MAGIC = b"EFT1"
_HEADER = struct.Struct("<4sQQQQBB")
SAMPLE = 64
#: Bytes of the texts that are encoded together (and one batch more).
GATHERED_BYTES = 6 << 20
#: A segment is closed after the batch with which it holds so many ids or documents.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1 << 16


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places.astype(np.int64)] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, then over the few bits that follow it."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        got = int.from_bytes(self.low[first // 8:(first + self.low_bits + 7) // 8], "little") >> (first % 8)
        return (place - i) << self.low_bits | got & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        out = (places - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[:self.n * self.low_bits]
            out |= low.reshape(self.n, -1).astype(np.int64) @ (1 << np.arange(self.low_bits))
        return out


def pack(documents: list[bytes], width: int) -> bytes:
    """The file image of documents given as little-endian ids of ``width`` bytes."""
    return image_of(np.array([len(d) // width for d in documents], np.int64), documents, width)


def image_of(lengths: np.ndarray, parts: list, width: int) -> bytes:
    """The file image of documents of so many ids, whose ids follow each other in ``parts``."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    ef = EliasFano.of(ends)
    head = _HEADER.pack(MAGIC, len(lengths), int(ends[-1]), len(ef.low), len(ef.high), ef.low_bits, width)
    return b"".join([head, ef.low, ef.high, ef.samples.tobytes(), *parts])


def unpack(image: bytes) -> tuple[EliasFano, np.ndarray]:
    """Boundaries (one more than documents) and ids of a file image."""
    magic, n, n_ids, low, high, low_bits, width = _HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = _HEADER.size
    samples = -(-(n + 1) // SAMPLE)
    ef = EliasFano(n + 1, low_bits, image[at:at + low], image[at + low:at + low + high],
                   np.frombuffer(image, "<u4", samples, at + low + high))
    return ef, np.frombuffer(image, f"<u{width}", n_ids, at + low + high + 4 * samples)


_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: Second bytes of lower-case Latin-1 letters, which begin with 0xC3.
_LATIN = np.isin(np.arange(256), [*range(0x9F, 0xB7), *range(0xB8, 0xC0)])


def chunks_of(data: np.ndarray, ends: np.ndarray, worded: bool) -> tuple[pa.Array, np.ndarray]:
    """The chunks of texts that follow each other in ``data`` (each up to its end), and how
    many each text has.

    Chunks lie between white space.  ``worded``: A-Z is lower-cased, and one closing mark
    between a letter or digit and white space is a chunk of its own; texts in which this could
    matter to the tokenizer's own first steps (combining marks, special tokens) are only cut
    at white space."""
    n = len(data)
    firsts = np.concatenate([[0], ends[:-1]])
    opens = np.zeros(n + 1, bool)
    opens[firsts] = True
    white = _WHITE[data]
    before = np.concatenate([[True], white[:-1]]) | opens[:n]
    start = ~white & before
    text = data
    if worded and n:
        text = _LOWER[data]
        odd = (data == 0xCC) | (data == 0xCD)
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        mark = np.flatnonzero(_MARK[text] & ~before)
        last = (mark + 1 == n) | opens[mark + 1]
        last |= white[np.minimum(mark + 1, n - 1)]
        mark = mark[last]
        one, two = text[mark - 1], text[np.maximum(mark - 2, 0)]
        letter = _ALNUM[one] | (_LATIN[one] & (two == 0xC3) & ~opens[mark - 1])
        mark = mark[letter]
        if odd.any():
            spared = np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right"))
            for i in spared.tolist():
                text[firsts[i]:ends[i]] = data[firsts[i]:ends[i]]
            mark = mark[~np.isin(np.searchsorted(ends, mark, "right"), spared)]
        start[mark] = True
    at = np.flatnonzero(start)
    kept = ~white
    places = np.cumsum(kept)
    offsets = np.concatenate([places[at] - 1, places[-1:] if n else [0]]).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(text[kept])])
    return chunks, np.diff(np.concatenate([[0], np.searchsorted(at, ends)]))


class ChunkTable:
    """Ids of chunks, one behind the other, by the chunk's slot.  Bounded by bytes: a table
    over ``most`` is emptied before it takes more, and chunks over ``longest`` bytes, which
    hardly come again, are forgotten after the batch.  Slot 0 holds the end id."""

    def __init__(self, answer, width: int, end_id: int, most: int = 128 << 20, longest: int = 64):
        self.answer, self.width, self.end_id, self.most, self.longest = answer, width, end_id, most, longest
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids = np.array([self.end_id], f"<u{self.width}")
        self.ends = np.array([0, 1], np.int64)
        self.held = 0

    def slots_of(self, chunks: list[bytes]) -> np.ndarray:
        """Slots of distinct chunks; what is new is answered and added."""
        if self.held > self.most:
            self.clear()
        new = [c for c in chunks if c not in self.slots]
        if new:
            ids, lengths = self.answer(new)
            base = len(self.ends) - 1
            self.slots.update(zip(new, range(base, base + len(new))))
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            # a slot costs its chunk, its ids, its end and about 150 bytes of Python
            self.held += sum(map(len, new)) + int(lengths.sum()) * self.width + 158 * len(new)
        out = np.fromiter(map(self.slots.__getitem__, chunks), np.int64, len(chunks))
        for c in [c for c in new if len(c) > self.longest]:
            del self.slots[c]
        return out

    def joined(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of slots, one behind the other, and how many each has."""
        lengths = (self.ends[1:] - self.ends[:-1])[slots]
        behind = np.cumsum(lengths)
        places = np.arange(behind[-1] if len(behind) else 0) + np.repeat(self.ends[slots] - (behind - lengths), lengths)
        return self.ids[places], lengths


class _Encoder:
    """The tokenizers library behind a table of chunks: its pre-tokenizer drops white space, so
    a text's ids are those of its chunks, and each distinct chunk of a batch is looked up once.

    Where the tokenizer's own first steps are known (:func:`splits_words`), chunks are cut as
    those steps would (:func:`chunks_of`), so there are fewer distinct ones; and plain
    lower-case words go through the same model without the steps that would leave them as
    they are.  A tokenizer whose tokens hold white space encodes whole texts."""

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(spec)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.worded, self.chunked = splits_words(spec), drops_white_space(spec)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # the model's tokens spell a byte with a character; one at a word's end has a suffix
        suffix = json.loads(spec)["model"].get("end_of_word_suffix") or ""
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.token_bytes = np.array([len(t) - len(suffix) * bool(suffix and t.endswith(suffix)) for t in tokens], np.int64)
        self.table = ChunkTable(self._answers if self.worded else self._encode, self.width, end_id)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one behind the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))

    def _answers(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter(map(is_plain, chunks), bool, len(chunks))
        parts = self._plain(list(compress(chunks, plain))), self._encode(list(compress(chunks, ~plain)))
        lengths = np.zeros(len(chunks), np.int64)
        lengths[plain], lengths[~plain] = parts[0][1], parts[1][1]
        ids, of_plain = np.zeros(int(lengths.sum()), np.int64), np.repeat(plain, lengths)
        ids[of_plain], ids[~of_plain] = parts[0][0], parts[1][0]
        return ids, lengths

    def _plain(self, words: list[bytes], step: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Words go through the model many at a time; as each of its tokens stands for so many
        bytes, the words' own bytes tell where each ends."""
        lines = [b" ".join(words[i:i + step]) for i in range(0, len(words), step)]
        found = self.plain.encode_batch_fast([x.decode() for x in lines], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64)
        bytes_upto = np.cumsum(self.token_bytes[ids])
        ends = np.searchsorted(bytes_upto, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))) + 1
        return ids, np.diff(np.concatenate([[0], ends])) if len(words) else ends[:0]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a batch of texts (none null), each with the end id behind, and how many
        each text has."""
        texts = texts.cast(pa.large_binary())
        if not self.chunked:
            ids, lengths = self._encode(texts.to_pylist())
            return np.insert(ids, np.cumsum(lengths), self.table.end_id).astype(f"<u{self.width}"), lengths + 1
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer else np.zeros(0, np.uint8)
        chunks, counts = chunks_of(data, offsets[1:] - offsets[0], self.worded)
        coded = chunks.dictionary_encode()
        known = self.table.slots_of(coded.dictionary.to_pylist())
        # the end id's slot goes behind each text's chunks
        ends = np.cumsum(counts)
        slots = np.insert(known[coded.indices.to_numpy()] if len(chunks) else np.zeros(0, np.int64), ends, 0)
        ids, lengths = self.table.joined(slots)
        last = ends + np.arange(len(ends))  # where each text's end slot lies
        upto = np.cumsum(lengths)[last]
        return ids, np.diff(np.concatenate([[0], upto]))


_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def is_plain(chunk: bytes) -> bool:
    """Whether a chunk is one word of letters that normalising leaves as it is."""
    if chunk.isascii() or _PLAIN(chunk):
        return chunk.isalpha() and chunk.islower() if chunk.isascii() else True
    word = chunk.decode()
    return word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word) and \
        "".join(map(str.lower, word)) == word


def splits_words(spec: str) -> bool:
    """Whether the tokenizer composes (NFC), lower-cases, takes runs of letters and runs of
    other signs apart, and maps bytes, and does nothing else before its model."""
    known = json.loads(spec)
    steps = (known.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = steps[0].get("pattern", {}).get("Regex", "") if steps else ""
    return [n["type"] for n in (known.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] \
        and [n["type"] for n in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"] \
        and not steps[1]["use_regex"] and first.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") \
        and all(a.startswith("'") for a in first.split("|")[:-3]) and drops_white_space(spec)


def drops_white_space(spec: str) -> bool:
    """Whether no token of this tokenizer spans or holds white space."""
    steps = json.loads(spec).get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    return first.get("type") == "Split" and bool(first.get("invert")) and first.get("behavior") == "Removed" \
        and "\\s" in str(first.get("pattern")) and " " not in str(first["pattern"].get("Regex"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of several batches at a time, so common chunks are looked up less often."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            size += batch.column("text").nbytes
        if held and (batch is None or size >= GATHERED_BYTES):
            yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))
            held, size = [], 0


SEGMENT = "part int, segment int, start long, n_docs long, n_ids long, doc_ids array<long>, image binary"


def write_token_files(df: DataFrame, id_col: str, text_col: str, tokenizer_file: str, end_id: int,
                      path: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text, append ``end_id``, and write the files under ``path``.

    Null texts are empty and hold the end id alone; null ids come first; rows of one id
    follow each other in the order of a hash of their texts, repeated rows included; an
    empty table gives files without documents; other columns take no part."""
    spark = df.sparkSession
    ready(spark)
    with open(tokenizer_file, encoding="utf-8") as f:  # on the driver; executors get the contents
        spec = f.read()
    shipped = spark.sparkContext.broadcast(spec)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("ids", hash(shipped.value), end_id), lambda: _Encoder(shipped.value, end_id))
        part, number, start = TaskContext.get().partitionId(), 0, 0
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = n_docs = 0

        def closed() -> pa.RecordBatch:
            nonlocal number, start, size, n_docs, names, held, lengths
            row = {"part": part, "segment": number, "start": start, "n_docs": n_docs, "n_ids": size,
                   "doc_ids": pa.chunked_array(names).to_pylist(),
                   "image": image_of(np.concatenate(lengths), held, encoder.width)}
            number, start, size, n_docs, names, held, lengths = number + 1, start + size, 0, 0, [], [], []
            return pa.RecordBatch.from_pylist([row], _SEGMENT_SCHEMA)

        for doc_ids, texts in _gathered(batches):
            ids, own = encoder.ids(texts)
            names.append(doc_ids)
            held.append(ids)
            lengths.append(own)
            size, n_docs = size + len(ids), n_docs + len(texts)
            if size >= segment_ids or n_docs >= SEGMENT_DOCS:
                yield closed()
        if n_docs:
            yield closed()

    (rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(segments, SEGMENT)
     .write.parquet(f"{path}/segments"))
    totals = (spark.read.schema(SEGMENT).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
              .orderBy("part").collect())  # one row for each task that wrote
    before = np.cumsum([0, *(r.n for r in totals)]).tolist()
    bases = [(r.part, b) for r, b in zip(totals, before)]
    spark.createDataFrame(bases, "part int, before long").write.parquet(f"{path}/parts")


_SEGMENT_SCHEMA = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()),
                             ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                             ("image", pa.binary())])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) for each document of the files, each found
    by the boundaries' ``select``.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers."""
    ready(spark)
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    parts = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    rows = segments.join(parts, "part").select((F.col("before") + F.col("start")).alias("start"), "doc_ids", "image")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ef, ids = unpack(batch.column("image")[i].as_py())
                bounds = np.fromiter(map(ef.select, range(ef.n)), np.int64, ef.n)
                wide = np.ascontiguousarray(ids, "<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                base = batch.column("start")[i].as_py()
                out = {"doc_id": batch.column("doc_ids")[i].values.cast(pa.int64()),
                       "start": pa.array(bounds[:-1] + base, pa.int64()),
                       "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(wide.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(documents, schema)


def token_files_in_shared_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-token-files-{uuid.uuid4().hex}"
