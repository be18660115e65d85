"""Token ids in length-delimited binary record files, with a separate offset index.

File format. A file is a row of frames: length (unsigned 64-bit), masked checksum of
those 8 bytes, payload, masked checksum of the payload; numbers are little-endian, a
checksum is CRC-32 rotated right by 15 bits plus 0xa282ead8 (a fixed value of this
format), so that data holding checksums of its own stays checkable. A payload is a
byte that says whether there is an id, the bytes of a token id (2, or 4 where the
vocabulary or the end id needs it), the id (signed 64-bit), the document's number of tokens
(unsigned 32-bit) and its ids. Beside each file lies ``<file>.idx``:
per record doc_id, byte offset in the file, and ids of the file's records before it, so that
records can be read in any order (``read_shuffled``). Reading back goes by these offsets and
tests every checksum.

Documents are dealt by ranges of doc_id and sorted, so the files in order of their number
hold ascending doc_ids. A task writes under a name of its own (task attempts never share
one) and its manifest row is what makes a file count: a file left by a lost attempt is
never read. The manifest is written once to the shared folder.

Defined results: null text is empty (the end id alone); a very long text is one record;
rows with equal doc_ids are kept, each a record, in order of a hash of their text (so that
a hot id is dealt to several tasks); rows without id come first; an empty table writes no
file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokoro.llm.common import id_and_text, map_arrow, shared_dir, written
from tokoro.llm.subwords import word_bpe

MASK_DELTA = 0xA282EAD8
#: A file is closed and the next one begun beyond so many bytes.
FILE_BYTES = 128 << 20
#: Bytes of a payload before its ids.
HEAD = struct.calcsize("<?BqI")
MANIFEST = "part int, file int, path string, first_doc long, records long, tokens long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(stream) -> Iterator[bytes]:
    """The payloads of a file; ValueError where a length or checksum doesn't hold."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("damaged record length")
        (n,) = struct.unpack("<Q", head[:8])
        body = stream.read(n + 4)
        if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
            raise ValueError("damaged record")
        yield body[:n]


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<?BqI", doc_id is not None, width, doc_id or 0, len(ids)) + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    known, width, doc_id, n = struct.unpack_from("<?BqI", data)
    if len(data) != HEAD + n * width:
        raise ValueError("damaged record")
    return doc_id if known else None, np.frombuffer(data, f"<u{width}", n, HEAD).astype("<u4")


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def id_width(largest: int) -> int:
    """Bytes of a token id."""
    if not 0 <= largest < 1 << 32:
        raise ValueError("token ids must fit 32 bits")
    return 2 if largest < 1 << 16 else 4


def write_records(docs: DataFrame, tokenizer: str, end_id: int, at: str) -> DataFrame:
    """Encode, append the end id, write the files under ``at``; the manifest, written."""
    width = id_width(max(word_bpe(tokenizer).largest, end_id))

    def write(batches):
        from pyspark import TaskContext

        store, top = filesystem(at)
        store.create_dir(top, recursive=True)
        coder, part = word_bpe(tokenizer), TaskContext.get().partitionId()
        rows, out, number = [], None, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                with store.open_output_stream(f"{rows[-1][2]}.idx") as index:
                    index.write(np.array(marks, "<i8").tobytes())
                out = None

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if out is None:
                    path = f"{top}/part-{part:05d}-{number:04d}-{uuid.uuid4().hex}.rec"
                    rows.append([part, number, path, doc_id, 0, 0, 0])
                    out, marks, number = store.open_output_stream(path), [], number + 1
                ids = np.append(np.frombuffer(coder.ids(text), "<u4"), np.uint32(end_id))
                data, row = frame(payload(doc_id, ids, width)), rows[-1]
                marks.append((doc_id or 0, row[6], row[5]))
                out.write(data)
                row[4:] = row[4] + 1, row[5] + len(ids), row[6] + len(data)
                if row[6] >= FILE_BYTES:
                    close()
        close()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # As many ranges as the input has splits, so that a range doesn't grow with the table.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    order = ["doc_id", F.xxhash64("text")]
    sorted_docs = id_and_text(docs).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(map_arrow(sorted_docs, write, MANIFEST), f"{at}-manifest")


def read_records(manifest: DataFrame, at: str) -> DataFrame:
    """Per record of the manifest's files: doc_id, the ids of all records before it, number
    of ids and their checksum. A file is read from front to back, each record held against the
    offset index's entry; ``read_shuffled`` and ``read_one`` go by the index alone."""

    def read(batches):
        store, _ = filesystem(at)
        for batch in batches:
            for row in batch.to_pylist():
                marks = read_index(store, row["path"])
                with store.open_input_stream(row["path"]) as stream:
                    out, place = [], 0
                    for data, (own_id, offset, start) in zip(unframe(stream), marks, strict=True):
                        doc_id, ids = parse(data)
                        if place != offset or own_id != (doc_id or 0):
                            raise ValueError("the offset index doesn't fit its file")
                        place += len(data) + 16
                        out.append((doc_id, row["base"] + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(out) == 4096:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)

    # One row a file: a running sum over so few rows needs no dealing out.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "file", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return dealt(files, ["part", "file"]).mapInArrow(read, READ)


def dealt(files: DataFrame, order: list) -> DataFrame:
    """Rows of a small table of files dealt to tasks: the number is given, as Spark would
    else join so few bytes, and with them all the files' reading, into one task."""
    n = min(files.count(), 8 * files.sparkSession.sparkContext.defaultParallelism)
    return files.repartitionByRange(max(1, n), *order)


def read_index(store, path: str) -> list[list[int]]:
    """(doc_id, offset, ids before) of each record of a file."""
    with store.open_input_stream(f"{path}.idx") as index:
        return np.frombuffer(index.read(), "<i8").reshape(-1, 3).tolist()


def read_shuffled(manifest: DataFrame, at: str, seed: int) -> DataFrame:
    """doc_id and ids of every record in an order drawn from a seed, by offsets alone: the
    indexes' entries are shuffled, not the records; a task reads its records one by one."""

    def entries(batches):
        store, _ = filesystem(at)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                marks = read_index(store, path)
                columns = [pa.array([path] * len(marks)), pa.array([m[1] for m in marks], pa.int64()), pa.array(range(len(marks)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "n"])

    def read(batches):
        store, _ = filesystem(at)
        for batch in batches:
            rows, files = [], {}
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path not in files:
                    files[path] = store.open_input_file(path)
                files[path].seek(offset)
                rows.append(parse(next(unframe(files[path]))))
            for stream in files.values():
                stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x.tolist() for _, x in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    index = dealt(manifest.select("path"), ["path"]).mapInArrow(entries, "path string, offset long, n long")
    drawn = index.orderBy(F.xxhash64(F.regexp_extract("path", "part-([0-9]+-[0-9]+)", 1), "n", F.lit(seed)))
    return map_arrow(drawn.select("path", "offset"), read, "doc_id long, ids array<long>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in READ.split(", ")])


def read_one(at: str, path: str, n: int) -> tuple[int, np.ndarray]:
    """Record ``n`` of a file through its offset index alone."""
    store, _ = filesystem(at)
    with store.open_input_file(f"{path}.idx") as index:
        _, offset, _ = np.frombuffer(index.read_at(24, 24 * n), "<i8").tolist()
    with store.open_input_file(path) as stream:
        stream.seek(offset)
        return parse(next(unframe(stream)))


def tokenise_to_files(docs: DataFrame, tokenizer: str, end_id: int = 2, at: str | None = None) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32."""
    at = at or shared_dir(docs.sparkSession)
    return read_records(write_records(docs, tokenizer, end_id, at), at)
