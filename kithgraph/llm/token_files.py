"""Token ids of documents in files: frequency-ranked ids, byte-aligned, with separate control bytes.

The format is a folder with three Parquet tables, so that any store that Spark reaches can hold it:

- ``blocks``: consecutive documents in ascending doc_id order (null ids first, rows of one id by their
  ids' hash). ``part`` and ``seq`` give the order of blocks, ``before`` counts the part's tokens ahead of
  the block, ``doc_ids`` holds int64, ``lengths`` uint32, ``missing`` one byte for each document (1: its
  id is null), ``control`` two bits for each token (its bytes less one, four tokens in a byte, low bits
  first) and ``data`` the tokens' ranks, little-endian in 1 to 4 bytes.
- ``vocab``: for each rank its token id. Rank 0 is the commonest id of these documents; ties go by id.
- ``parts``: tokens of each part, from which a reader adds up where a part starts.

A null or empty text has the end id alone. Columns other than id and text are not kept. An empty table
gives no blocks.
"""

from __future__ import annotations

import array
import gc
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kithgraph.llm import words

#: Tokens after which a block ends with the document at hand; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 18
#: Words whose ids a worker remembers; when there are more it starts anew.
REMEMBERED = 300_000
#: Bytes of text that are encoded at a time, and rows that a worker gets at a time.
PORTION, ROWS = 1 << 20, 1000
TEMP = "kind byte, doc_id long, n long, ids binary"
BLOCKS = "part int, seq int, before long, n_docs int, n_tokens long, missing binary, doc_ids binary, lengths binary, control binary, data binary"
DECODED = "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long"

# -- the code -----------------------------------------------------------------------------------

_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
_OFFSETS = np.zeros((256, 4), np.int64)
_OFFSETS[:, 1:] = np.cumsum(_CODES + 1, axis=1)[:, :3]
_TOTAL = (_CODES + 1).sum(axis=1)
_MASK = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    code = np.concatenate([code, np.zeros(-len(code) % 4, np.uint8)]).reshape(-1, 4)
    return (code << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers, found by tables over the control bytes."""
    c = np.frombuffer(control, np.uint8)
    size = _TOTAL[c]
    at = ((np.cumsum(size) - size)[:, None] + _OFFSETS[c]).ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    mask = _MASK[_CODES[c].ravel()[:n]]
    for k in (1, 2, 3):
        if (more := np.flatnonzero(mask >> np.uint32(8 * k))).size:
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# -- tokenizing ---------------------------------------------------------------------------------

#: Of the word-level tokenizer whose pieces never cross white space (fixed values: its file's settings).
_WORD_LEVEL = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN = re.compile('([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:()"#$%&*-]*)')


def _byte_letters() -> dict[int, int]:
    """The character by which byte-level tokenizers write each byte: itself if it prints, else 256 and on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: b if b in prints else next(rest) for b in range(256)}


class _Encoder(dict):
    """Index of each word's ids in ``flat``; words are bytes between ASCII white space."""

    def __init__(self, settings: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(settings)
        kind = json.loads(settings)
        steps = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [x.get("type") for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        extra = [x["content"] for x in kind.get("added_tokens") or [] if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or re.search(r"\s", x["content"])]
        self.by_word = norm == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern") == {"Regex": _WORD_LEVEL} and not extra and kind["model"].get("dropout") is None
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.forget(None)

    def forget(self, end: int | None) -> None:
        self.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        self.flat, self.at, self.end = array.array("I"), array.array("q", [0]), end

    def _piece(self, text: str) -> bytes:
        spelled = text.encode().decode("latin-1").translate(self.letters)
        found = self.pieces[text] = array.array("I", [x.id for x in self.tokenizer.model.tokenize(spelled)]).tobytes()
        return found

    def __missing__(self, word: bytes) -> int:
        text, flat, pieces = word.decode("utf-8", "replace"), self.flat, self.pieces
        if m := _PLAIN.fullmatch(text):
            head, tail = m.groups()
            head = head.lower()
            flat.frombytes(pieces.get(head) or self._piece(head))
            if tail:
                flat.frombytes(pieces.get(tail) or self._piece(tail))
        else:
            flat.extend(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self._close(word)

    def _close(self, word: bytes) -> int:
        """The ids added to ``flat`` since the last word are this word's."""
        self.at.append(len(self.flat))
        self[word] = k = len(self.at) - 2
        return k

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the end id after each, and each text's number of ids."""
        if not self.by_word:
            found = [x.ids + [end] for x in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        if self.end != end or len(self) > REMEMBERED:
            self.forget(end)
            self.flat.append(end)
            self._close(b" ")  # no word is a space
        split: list[bytes] = []
        counts = []
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects, no cycles
        for t in texts:
            own = (t if b"<|" in t else t.lower()).split()  # special tokens are told from text by case
            own.append(b" ")
            split += own
            counts.append(len(own))
        index = np.fromiter(map(self.__getitem__, split), np.int64, len(split))
        if collecting:
            gc.enable()
        at, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.flat, np.uint32)
        start = at[index]
        size = at[index + 1] - start
        ends = np.cumsum(size)
        out = flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        del at, flat
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return out, np.diff(upto)


_encoders: dict[str, _Encoder] = {}


def _encode(settings, end: int, vocabulary: int, width: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.md5(settings.value.encode()).hexdigest()
        if key not in _encoders:
            _encoders[key] = _Encoder(settings.value)
        encoder, counts = _encoders[key], np.zeros(vocabulary, np.int64)
        for batch in batches:
            at, data = words.text_buffers(batch.column(1))
            for i, j in words.spans(at, PORTION):
                raw = data[at[i] : at[j]].tobytes()
                ids, size = encoder.encode([raw[a - at[i] : b - at[i]] for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)], end)
                counts += np.bincount(ids, minlength=vocabulary)
                stops = np.concatenate([[0], np.cumsum(size)]) * np.dtype(width).itemsize
                held = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(ids.astype(width))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int8)), batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(size), held], ["kind", "doc_id", "n", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["kind", "doc_id", "n", "ids"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            now = np.frombuffer(x.as_py(), np.int64)
            total = now.copy() if total is None else total + now
    if total is not None:
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])


def _write(rank_of, width: type, block_tokens: int):
    def block(part: int, seq: int, before: int, ids: list, sizes: list, flat: list) -> tuple[pa.RecordBatch, int]:
        tokens = np.frombuffer(b"".join(flat), width)
        control, data = pack(rank_of.value[tokens])
        missing = bytes(x is None for x in ids)
        held = np.array([x or 0 for x in ids], "<i8").tobytes()
        row = [part, seq, before, len(ids), len(tokens), missing, held, np.array(sizes, "<u4").tobytes(), control, data]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 5
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names), before + len(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, flat, held = [], [], [], 0
        for batch in batches:
            for i, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(i)
                sizes.append(n)
                flat.append(x.as_py())
                held += n
                if held >= block_tokens:
                    out, before = block(part, seq, before, ids, sizes, flat)
                    yield out
                    ids, sizes, flat, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield block(part, seq, before, ids, sizes, flat)[0]

    return run


def _read(id_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                tokens = id_of.value[unpack(b["control"], b["data"], b["n_tokens"])]
                sizes = np.frombuffer(b["lengths"], "<u4").astype(np.int64)
                stops = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(np.ascontiguousarray(tokens, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                ids = pa.array(np.frombuffer(b["doc_ids"], "<i8"), mask=np.frombuffer(b["missing"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(sizes), b["part"], np.int32)), pa.array(stops[:-1] + b["before"]), pa.array(sizes), pa.array(crc, pa.int64())], [x.split()[0] for x in DECODED.split(", ")])

    return run


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Python gets so many rows at a time, so that two workers' batches of long texts are small beside an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end: int = 1, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the documents' ids to the folder ``out``; tokenizer is the path of a tokenizers file, end the id after each document."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        settings = f.read()
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_str(settings).get_vocab(with_added_tokens=True).values(), default=0) + 1
    vocabulary = max(vocabulary, end + 1)
    width = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with _batches(spark, ROWS):
        rows.mapInArrow(_encode(spark.sparkContext.broadcast(settings), end, vocabulary, width), TEMP).write.mode("overwrite").parquet(f"{out}/temp")
    temp = spark.read.schema(TEMP).parquet(f"{out}/temp")
    # one row for each id of the vocabulary at most
    counts = temp.where("kind = 1").select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(k, int(x)) for k, x in enumerate(order)], "rank long, id long").coalesce(1).write.mode("overwrite").parquet(f"{out}/vocab")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = F.xxhash64("ids")
    rows = temp.where("kind = 0").select("doc_id", "n", "ids").repartitionByRange(parts, "doc_id", told).sortWithinPartitions("doc_id", told)
    with _batches(spark, ROWS):
        rows.mapInArrow(_write(spark.sparkContext.broadcast(rank_of), width, block_tokens), BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{out}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    blocks.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.mode("overwrite").parquet(f"{out}/parts")
    return out


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    vocab = spark.read.schema("rank long, id long").parquet(f"{folder}/vocab").orderBy("rank").collect()
    id_of = spark.sparkContext.broadcast(np.array([r["id"] for r in vocab] or [0], np.uint32))
    rows = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(_read(id_of), DECODED)
    # a row for each part that was written
    parts = spark.read.schema("part int, n_tokens long").parquet(f"{folder}/parts")
    starts = parts.select("part", (F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens")).alias("ahead"))
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("ahead") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")
