"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record is: length as u64, masked CRC-32C of those 8 bytes as u32, the serialised ids, their masked CRC-32C as
u32, all little-endian. Ids are serialised as u16 where the vocabulary has at most 65,536 ids, else as u32.
Beside each data file stands an index with (offset, doc_id, ids) for every record, so a reader can shuffle
records without touching the data, and a manifest row tells how many ids all earlier files hold.

Files are in ascending doc_id order (range-partitioned), null ids first; equal ids are ordered by a hash of the text,
and dealt by it, so that one id with very many texts fills no file. Null and
empty texts give a record of the end id alone. Repeated rows give repeated records. An empty table writes no
record. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, open_input, partitions, read_array, scratch, slices, task_id, write_file
from .encode import default_path, encoder, with_end

INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("null_id", "u1"), ("ids", "<u8")])
#: CRC-32C (Castagnoli), reflected, and the usual mask constant of such files.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
WIDE = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _block_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to a block's checksum from each place, and what WIDE zero bytes make of a checksum's bytes."""
    one = _byte_table()
    places = np.empty((WIDE, 256), np.uint32)
    t = one.copy()
    for i in range(WIDE - 1, -1, -1):
        places[i] = t
        t = (t >> 8) ^ one[t & 255]
    shift = np.empty((4, 256), np.uint32)
    for k in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(WIDE):
            c = (c >> 8) ^ one[c & 255]
        shift[k] = c
    return places, shift


_TABLES: list = []


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of many slices of a byte array at once."""
    if not _TABLES:
        _TABLES.extend(_block_tables())
    places, shift = _TABLES
    n = len(starts)
    blocks = -(-np.maximum(sizes, 1) // WIDE)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    crc_of = np.empty(total, np.uint32)
    # each slice is padded on its left, where zeros don't count; all ones at the start flip its first four bytes
    pad = blocks * WIDE - sizes
    room, to = np.zeros(total * WIDE, np.uint8), first * WIDE + pad
    for a, i, s in zip(to.tolist(), starts.tolist(), sizes.tolist()):
        room[a : a + s] = data[i : i + s]
    for k in range(4):
        room[(to + k)[sizes > k]] ^= 255
    room = room.reshape(total, WIDE)
    step = (1 << 17) // WIDE  # what is looked up at once stays in the processor's cache
    place = np.arange(WIDE)
    for i in range(0, total, step):
        crc_of[i : i + step] = np.bitwise_xor.reduce(places[place, room[i : i + step]], axis=1)
    out = np.zeros(n, np.uint32)
    for r in range(int(blocks.max()) if n else 0):
        on = np.flatnonzero(blocks > r)
        c = out[on]
        out[on] = shift[0][c & 255] ^ shift[1][(c >> 8) & 255] ^ shift[2][(c >> 16) & 255] ^ shift[3][c >> 24] ^ crc_of[first[on] + r]
    for i in np.flatnonzero(sizes < 4):  # all ones reach beyond a short slice
        one, c = _byte_table(), 0xFFFFFFFF
        for b in data[starts[i] : starts[i] + sizes[i]].tolist():
            c = (c >> 8) ^ int(one[(c ^ b) & 255])
        out[i] = c ^ 0xFFFFFFFF
    return np.where(sizes < 4, out, out ^ np.uint32(0xFFFFFFFF))


def masked(crc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Records one after another, and where each begins."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    data = np.frombuffer(b"".join(payloads), np.uint8)
    starts = np.cumsum(sizes) - sizes
    heads = sizes.astype("<u8").view(np.uint8).reshape(-1)
    eights = np.arange(len(payloads)) * 8
    head_crc = masked(crc32c(heads, eights, np.full(len(payloads), 8))).astype("<u4").tobytes()
    crc = masked(crc32c(data, starts, sizes)).astype("<u4").tobytes()
    heads = heads.tobytes()
    parts = [x for i, p in enumerate(payloads) for x in (heads[8 * i : 8 * i + 8], head_crc[4 * i : 4 * i + 4], p, crc[4 * i : 4 * i + 4])]
    return b"".join(parts), np.cumsum(sizes + 16) - (sizes + 16)


def unframe(data: bytes, offsets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The payloads of records; raises if a length or checksum is wrong."""
    raw = np.frombuffer(data, np.uint8)
    word = lambda at, n, kind: raw[at[:, None] + np.arange(n)].copy().view(kind).reshape(-1)
    if not len(offsets):
        return []
    ok = (word(offsets, 8, "<u8").astype(np.int64) == sizes).all()
    ok = ok and (word(offsets + 8, 4, "<u4") == masked(crc32c(raw, offsets, np.full(len(offsets), 8)))).all()
    ok = ok and (word(offsets + 12 + sizes, 4, "<u4") == masked(crc32c(raw, offsets + 12, sizes))).all()
    if not ok:
        raise ValueError("a record's length or checksum is wrong")
    return [data[o + 12 : o + 12 + s] for o, s in zip(offsets.tolist(), sizes.tolist())]


def write_records(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Encode, range-partition by id, write a data file and an index for each partition. Returns the manifest:
    (part, path, index, n_records, n_ids, first_id), where first_id counts the ids in all earlier files."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder, tokenizer = folder or scratch(spark, "records"), tokenizer or default_path()

    def write(batches):
        part, enc = task_id(), encoder(tokenizer)
        path, index, offset, n_ids, n = f"{folder}/part-{part:06d}.rec", [], 0, 0, 0

        def pieces():
            nonlocal offset, n_ids, n
            for batch in slices(batches, 1, fresh=False):
                keys = batch.column(0)
                flat, n_each = with_end(*enc.encode(batch.column(1)), end_id)
                if width == 2 and len(flat) and flat.max() > 65535:
                    raise ValueError("ids over 65535 need width=4")
                flat = flat.astype(f"<u{width}").tobytes()
                ends = np.cumsum(n_each) * width
                data, at = frame([flat[a:b] for a, b in zip((ends - n_each * width).tolist(), ends.tolist())])
                rows = np.zeros(len(keys), INDEX)
                rows["offset"], rows["ids"] = at + offset, n_each
                rows["doc_id"], rows["null_id"] = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)
                index.append(rows)
                offset, n_ids, n = offset + len(data), n_ids + int(rows["ids"].sum()), n + len(rows)
                yield data

        write_file(path, pieces())
        write_file(f"{path}.idx", [np.concatenate([np.zeros(0, INDEX), *index]).tobytes()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_records": pa.array([n], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    mark = F.xxhash64("text")  # rows of one id are dealt over files too
    rows = rows.repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), mark).sortWithinPartitions(F.asc_nulls_first("doc_id"), mark, "text")
    written = sorted(rows.mapInArrow(write, "part int, path string, n_records long, n_ids long").collect())  # a row for each file
    manifest, first = [], 0
    for r in written:
        manifest.append((r.part, r.path, f"{r.path}.idx", r.n_records, r.n_ids, first))
        first += r.n_ids
    return spark.createDataFrame(manifest, "part int, path string, index string, n_records long, n_ids long, first_id long")


def read_records(manifest: DataFrame, shuffle_seed: int | None = None, width: int = 2, at_once: int = 8 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids): read every file's index and records, checking lengths and checksums.

    ids are little-endian unsigned 32-bit integers. With a seed, each file's records come in a shuffled order
    taken from the index; else in file order.
    """
    spark = manifest.sparkSession
    files = [(r.path, r.first_id) for r in manifest.orderBy("part").collect()]  # a row for each file
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def read(batches):
        for i in (int(i) for b in batches for i in b.column(0).to_pylist()):
            path, first = files[i]
            index = np.array(read_array(f"{path}.idx", INDEX))
            sizes = index["ids"].astype(np.int64) * width
            starts = first + np.cumsum(index["ids"]).astype(np.int64) - index["ids"].astype(np.int64)
            ends = np.cumsum(sizes + 16)
            with open_input(path) as f:
                if shuffle_seed is not None:
                    for k in np.random.default_rng([shuffle_seed, i]).permutation(len(index)):
                        f.seek(int(index["offset"][k]))
                        data = f.read(int(sizes[k]) + 16)
                        yield batch_of(index[k : k + 1], starts[k : k + 1], unframe(data, np.zeros(1, np.int64), sizes[k : k + 1]))
                    continue
                at = 0
                while at < len(index):
                    base = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, base + at_once, side="right")))
                    f.seek(base)
                    data = f.read(int(ends[to - 1]) - base)
                    yield batch_of(index[at:to], starts[at:to], unframe(data, index["offset"][at:to].astype(np.int64) - base, sizes[at:to]))
                    at = to

    def batch_of(index, starts, payloads):
        flat = np.frombuffer(b"".join(payloads), f"<u{width}").astype("<u4").tobytes()
        ends = np.cumsum(index["ids"].astype(np.int64)) * 4
        ids = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        keys = pa.array(index["doc_id"].astype(np.int64), mask=index["null_id"].astype(bool))
        return pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(index["ids"].astype(np.int64)), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, schema)
