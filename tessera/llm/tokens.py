"""Token ids as Arrow files of equal-length sequences and masks (operator 2).

Each file is an Arrow IPC file. Its batches hold BATCH sequences in two columns: ids, a fixed-size list of LENGTH unsigned
integers, and mask, a fixed-size list of LENGTH booleans that are false on padding. A memory-mapped file gives any sequence
without copying. Beside each file lies an index, an Arrow file too: doc_id, first (place of the document's first id in the
file) and n_tokens.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize, session_folder

LENGTH, BATCH, END = 2048, 256, 0
#: Encoded chunks that a worker remembers. Frequent ones are met early; the rest are encoded for each batch anew.
REMEMBERED = 500_000
#: Unknown chunks that are encoded as one text, and how a byte-level BPE spells a space.
TOGETHER, SPACE = 200, "\u0120"
#: Where a space is followed by white space, or ends the text, the text isn't cut at spaces.
_UNSAFE = re.compile(r" (?:\s|$)")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes whole texts with the tokenizers library.

    A byte-level BPE of this kind never joins what stands before a single space to what follows, so texts are cut before
    spaces and equal chunks are encoded once. A text in which a space meets other white space, or that spells an added token such
    as <|endoftext|>, which the library takes as that token, is encoded in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        ids = range(self.tokenizer.get_vocab_size())
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE) for i in ids])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks that begin with their only space, TOGETHER in one text: a token that begins with a space begins a chunk."""
        found = {}
        groups = [chunks[i : i + TOGETHER] for i in range(0, len(chunks), TOGETHER)]
        for group, ids in zip(groups, self._encode(["".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(group):
                data, step = ids.tobytes(), self.width.itemsize
                bounds = [*(starts * step).tolist(), len(data)]
                found.update((c, data[i:j]) for c, i, j in zip(group, bounds[:-1], bounds[1:], strict=True))
            else:
                found.update(zip(group, (x.tobytes() for x in self._encode(group)), strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of the type width."""
        chunks, whole = [], {}
        for text in texts:
            if _UNSAFE.search(text) or any(t in text for t in self.added):
                whole[text] = b""
                chunks.append([text])
            else:
                first, *rest = text.split(" ")
                rest = [" " + x for x in rest]
                if first:
                    whole[first] = b""
                    rest.insert(0, first)
                chunks.append(rest)
        whole = dict(zip(whole, (x.tobytes() for x in self._encode(list(whole))), strict=True))
        known = self.known
        missing = list({x for parts in chunks for x in parts if x not in known}.difference(whole))
        if len(known) < REMEMBERED:
            known.update(self._encode_chunks(missing))
            found = whole
        else:
            found = self._encode_chunks(missing) | whole
        return [b"".join([known[x] if x in known else found[x] for x in parts]) for parts in chunks]


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches; only the open batch is held."""

    def __init__(self, sink, width: np.dtype, length: int):
        self.length, self.width = length, width
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(width), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[bytes] = []
        self.bytes = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.bytes += len(ids)
        if self.bytes >= BATCH * self.length * self.width.itemsize:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.width)
        step = BATCH * self.length
        full = len(ids) if last else len(ids) // step * step
        for low in range(0, full, step):
            part = ids[low : min(low + step, full)]
            padded = np.zeros(-(-len(part) // self.length) * self.length, self.width)
            padded[: len(part)] = part
            columns = [padded, np.arange(len(padded)) < len(part)]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in columns]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        rest = ids[full:].tobytes()
        self.waiting, self.bytes = [rest] if rest else [], len(rest)

    def close(self) -> None:
        self._write(last=True)
        self.writer.close()


def write_sequences(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = LENGTH) -> DataFrame:
    """Write all docs (doc_id, text) as token sequences below folder (a URI that all executors reach; by default in the
    application's scratch folder) and return the files: part, path, n_docs, n_tokens.

    Parts are ranges of doc_id in ascending order, and rows ascend within a part (null ids first, equal ids in no fixed
    order). Each text's ids are followed by id 0. Null texts are empty; extra columns are left out. A task writes under a
    name of its attempt and moves the file into place when it is complete, so a task that is run again does no harm.
    """
    spark = docs.sparkSession
    folder = folder or f"{session_folder(spark)}/tokens-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (fs, base) = _encoder(tokenizer), _filesystem(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}"
        ids_of, first_of, count_of, at = [], [], [], 0
        end = np.array([END], encoder.width).tobytes()
        with fs.open_output_stream(f"{name}.{attempt}.open") as sink:
            writer = SequenceWriter(sink, encoder.width, length)
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    some = batch.slice(low, 512)
                    for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode([x or "" for x in some.column(1).to_pylist()]), strict=True):
                        writer.add(ids + end)
                        count = len(ids) // encoder.width.itemsize + 1
                        ids_of.append(doc_id)
                        first_of.append(at)
                        count_of.append(count)
                        at += count
            writer.close()
        index = pa.table({"doc_id": pa.array(ids_of, pa.int64()), "first": pa.array(first_of, pa.int64()), "n_tokens": pa.array(count_of, pa.int64())})
        with fs.open_output_stream(f"{name}.{attempt}.open-index") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        if not ids_of:
            fs.delete_file(f"{name}.{attempt}.open")
            fs.delete_file(f"{name}.{attempt}.open-index")
            return
        fs.move(f"{name}.{attempt}.open", f"{name}.arrow")
        fs.move(f"{name}.{attempt}.open-index", f"{name}.index.arrow")
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}"], "n_docs": [len(ids_of)], "n_tokens": [at]})

    return materialize(rows.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-files")


class SequenceFile:
    """Random access to one part: sequence(i) and mask(i) are views of the mapped file; document(k) joins its pieces."""

    def __init__(self, path: str):
        fs, plain = _filesystem(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        opened = [pa.memory_map(f"{plain}{end}") if local else fs.open_input_file(f"{plain}{end}") for end in (".arrow", ".index.arrow")]
        self.reader = pa.ipc.open_file(opened[0])
        self.index = pa.ipc.open_file(opened[1]).read_all()
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches
        self._open: tuple[int, pa.RecordBatch | None] = (-1, None)

    def _batch(self, k: int) -> pa.RecordBatch:
        if self._open[0] != k:
            self._open = (k, self.reader.get_batch(k))
        return self._open[1]

    def sequence(self, i: int) -> np.ndarray:
        column = self._batch(i // BATCH).column(0)
        low = i % BATCH * self.length
        return column.values.to_numpy(zero_copy_only=True)[low : low + self.length]

    def mask(self, i: int) -> pa.BooleanArray:
        return self._batch(i // BATCH).column(1)[i % BATCH].values

    def ids(self, first: int, count: int) -> np.ndarray:
        """count ids from place first on: a view if they lie in one batch."""
        step, parts = BATCH * self.length, []
        while count > 0:
            k, low = divmod(first, step)
            values = self._batch(k).column(0).values.to_numpy(zero_copy_only=True)
            parts.append(values[low : low + min(count, step - low)])
            first, count = first + len(parts[-1]), count - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 for every document, read back from the files."""
    totals = sorted((r["part"], r["n_tokens"]) for r in files.select("part", "n_tokens").collect())  # a row per file
    before, at = [], 0
    for part, count in totals:
        before.append((part, at))
        at += count
    starts = spark.createDataFrame(before, "part long, before long")
    tasks = files.select("part", "path").join(F.broadcast(starts), "part").repartition(max(1, len(before)), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                file = SequenceFile(path)
                first, count = (file.index.column(c).to_numpy() for c in ("first", "n_tokens"))
                sums = [zlib.crc32(file.ids(f, c).astype("<u4").tobytes()) for f, c in zip(first.tolist(), count.tolist(), strict=True)]
                doc_id = file.index.column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(first + start), pa.array(count), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
