"""Token ids in a byte-aligned variable-length binary format.

Texts are encoded with a public tokenizer file (its path is a parameter), an
end id is appended to each document, and the ids are written in ascending
doc_id order.  Ids are replaced by their frequency rank, so the commonest take
one byte; control bytes (four lengths of two bits each) stand apart from the
data bytes, and decoding is a numpy table lookup on the control bytes.

Segment layout (little endian): magic ``DTK1``, uint32 number of ids, uint32
length of the control bytes, the control bytes, the data bytes.  The rank
table (ids by falling frequency, ties by id) is written beside the segments.
Segments are rows of a Parquet table in the shared folder, so any store that
Spark writes will do and Spark's committer settles retried tasks; each segment
holds whole documents, about ``SEGMENT_IDS`` ids (a longer document is one
segment), its range partition and its place there.

Encoding: the byte-level tokenizer splits a text before a space that stands
alone, and encodes what lies between such places alone.  So the different
units between spaces are found for a batch of texts at a time; those not yet
known are encoded by the tokenizers library, some dozens in one text, which is
cut again at the ids that begin with a space.  Known units are held in a
bounded Arrow table and looked up as columns; the ids are those of the whole
text.  Texts with other white space beside a space, or with characters that
libraries may file differently (numbers other than digits, separators, beyond
the basic plane), are encoded as a whole.

Defined results: null text is empty (only the end id); documents with one
doc_id are ordered by their ids' hash; a null doc_id comes first; special
strings in a text are ordinary text; extra columns are ignored; an empty table
gives no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dispensa.plans.lineage import materialize

from .common import slices

MAGIC = b"DTK1"
SEGMENT_IDS = 1 << 18
END_ID = 2
# known units held at most between batches, and the longest of them
MEMO, LONGEST = 600_000, 40
UNITS_AT_ONCE = 64
SPACE = "\u0120"  # fixed value: a space in the byte-level vocabulary
WHITE = r"[\s\pZ\x{0b}\x{85}]"
ODD = rf"^ | $|{WHITE} | {WHITE}|[\x{{1c}}-\x{{1f}}\x{{10000}}-\x{{10ffff}}\p{{Nl}}\p{{No}}]|^$"

# decode tables: per control byte its four lengths and their sum
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.int64)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


# -- the format -------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """One segment of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[:len(v)] = size - 1
    q = codes.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return MAGIC + struct.pack("<II", len(v), len(control)) + control.astype(np.uint8).tobytes() + data.tobytes()


def unpack(segment: bytes) -> np.ndarray:
    """The values of one segment: lengths by table lookup on the control
    bytes, then four bytes from each start, cut to its length."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment")
    n, k = struct.unpack("<II", segment[4:12])
    control = np.frombuffer(segment, dtype=np.uint8, count=k, offset=12)
    size = _LENGTHS[control].ravel()[:n]
    data = np.frombuffer(segment + b"\0\0\0", dtype=np.uint8, offset=12 + k)
    start = np.cumsum(size) - size
    if n and start[-1] + size[-1] != len(data) - 3:
        raise ValueError("segment of the wrong length")
    wide = sum(data[start + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4)) if n else np.empty(0, np.uint32)
    return wide & _MASKS[size]


# -- encoding ---------------------------------------------------------------

class Encoder:
    """Encodes texts as little-endian uint16 or uint32 ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2") if len(vocabulary) <= 1 << 16 else np.dtype("<u4")
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.ids, self.size, self.used = np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, bool)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts in a row, and the number of each."""
        # one text at a time: the library's results take some hundred bytes an id
        out = [np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, dtype=self.kind)
               for t in texts]
        return np.concatenate([np.empty(0, self.kind), *out]), np.array([len(x) for x in out], dtype=np.int64)

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, each with a space in front, and the number of each."""
        texts = [" " + " ".join(units.slice(i, UNITS_AT_ONCE).to_pylist()) for i in range(0, len(units), UNITS_AT_ONCE)]
        ids, _ = self._whole(texts)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(units):
            raise ValueError("the tokenizer does not split texts before spaces")
        return ids, np.diff(starts, append=len(ids))

    def _table(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and number of those of each of different units."""
        at = pc.fill_null(pc.index_in(units, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at[at >= 0]] = True
        fresh = np.flatnonzero(at < 0)
        new = units.take(pa.array(fresh))
        ids, size = self._units(new)
        at[fresh] = len(self.names) + np.arange(len(fresh))
        ids, size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        start = np.cumsum(size) - size
        # what stays known: not the long ones; once they are many, those met again since the last time, and the new
        new_ones = pc.utf8_length(new).to_numpy(zero_copy_only=False) <= LONGEST
        keep, used = np.concatenate([np.ones(len(self.names), bool), new_ones]), np.concatenate([self.used, new_ones])
        if keep.sum() > MEMO:
            keep &= used
            keep &= keep.cumsum() <= MEMO
            used[:] = False
        else:
            used[len(self.names):] = False
        self.names = pa.concat_arrays([self.names, new]).filter(pa.array(keep))
        self.ids, self.size, self.used = ids[np.repeat(keep, size)], size[keep], used[keep]
        return ids, start[at], size[at]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the end id, and the number
        of ids of each."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        plain, others = np.flatnonzero(~odd), np.flatnonzero(odd)
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        # a text's first unit has no space in front; the end of its text closes it
        firsts = flat.take(pa.array(bounds[:-1]))
        inner = np.ones(len(flat), dtype=bool)
        inner[bounds[:-1]] = False
        coded = flat.filter(pa.array(inner)).dictionary_encode()
        ids, start, size = self._table(coded.dictionary)
        whole, n_whole = self._whole(firsts.to_pylist() + texts.take(pa.array(others)).to_pylist())
        ids = np.concatenate([ids, whole, np.array([end_id], self.kind)])
        start = np.concatenate([start, len(ids) - 1 - len(whole) + np.cumsum(n_whole) - n_whole, [len(ids) - 1]])
        size = np.concatenate([size, n_whole, [1]])
        # the units of each text in the order of the texts, closed by the end id
        per = np.ones(len(texts), dtype=np.int64)
        per[plain] = np.diff(bounds)
        stops = np.cumsum(per + 1)
        at = stops - per - 1
        row = np.full(int(stops[-1]) if len(stops) else 0, len(size) - 1, dtype=np.int64)
        codes = np.empty(len(flat), dtype=np.int64)
        codes[inner] = coded.indices.to_numpy(zero_copy_only=False)
        codes[bounds[:-1]] = len(coded.dictionary) + np.arange(len(plain))
        row[np.repeat(at[plain] - bounds[:-1], per[plain]) + np.arange(len(codes))] = codes
        row[at[others]] = len(coded.dictionary) + len(plain) + np.arange(len(others))
        n = size[row]
        place = np.repeat((start[row] - (np.cumsum(n) - n)).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        return ids[place], np.add.reduceat(n, at) if len(at) else per


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for b in batches:
        for start, length in slices(b.column(1), 4 << 20):
            ids, n = enc.encode(b.column(1).slice(start, length), end_id)
            raw, stops = memoryview(ids.tobytes()), np.cumsum(n) * enc.kind.itemsize
            each = [raw[s:e] for s, e in zip([0, *stops.tolist()], stops.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(start, length), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64()),
                 pa.array(each, pa.binary())], names=["doc_id", "n_tokens", "tie", "ids"])
        pa.default_memory_pool().release_unused()


def _histogram(batches: Iterator[pa.RecordBatch], kind: str, vocabulary: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(vocabulary, dtype=np.int64)
    for b in batches:
        # parts of some 500,000 ids, so that a count costs more than the table it is added to
        held, n = [], 0
        for x in b.column(0):
            held.append(np.frombuffer(x.as_buffer(), dtype=kind))
            n += len(held[-1])
            if n > 1 << 19:
                total += np.bincount(np.concatenate(held), minlength=vocabulary)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=vocabulary)
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["id", "n"])


def _write(ranks_b, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, part = ranks_b.value, TaskContext.get().partitionId()
        docs, sizes, held, start, place = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            nonlocal start, place
            values = ranks[np.concatenate(held)]
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([start], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([pack(values)], pa.binary())],
                names=["part", "place", "part_start", "doc_ids", "sizes", "segment"])
            start, place = start + len(values), place + 1
            return row

        count = 0
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(x.as_buffer(), dtype=kind)
                if held and count + len(ids) > SEGMENT_IDS:
                    yield segment()
                    docs, sizes, held, count = [], [], [], 0
                docs.append(d)
                sizes.append(len(ids))
                held.append(ids)
                count += len(ids)
        if held:
            yield segment()
    return run


SEGMENTS = "part int, place int, part_start bigint, doc_ids array<bigint>, sizes array<bigint>, segment binary"


def write_segments(docs: DataFrame, path: str, end_id: int = END_ID, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode and write all documents; returns the written tables of segments
    (see SEGMENTS) and ranks (rank, id)."""
    spark = docs.sparkSession
    # the file is opened here once to learn its vocabulary size
    enc = encoder(path)
    vocabulary, kind = max(enc.tokenizer.get_vocab_size(), end_id + 1), enc.kind.str
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = materialize(rows.mapInArrow(partial(_encode, path=path, end_id=end_id),
                                          "doc_id bigint, n_tokens bigint, tie bigint, ids binary"), "token-ids")
    counts = encoded.select("ids").mapInArrow(partial(_histogram, kind=kind, vocabulary=vocabulary), "id bigint, n bigint") \
        .groupBy("id").agg(F.sum("n").alias("n"))
    # one row per vocabulary id
    by_rank = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    ranks = np.zeros(vocabulary, dtype=np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    table = materialize(spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id int").coalesce(1),
                        "token-ranks")
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie") \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    segments = ordered.select("doc_id", "ids").mapInArrow(_write(spark.sparkContext.broadcast(ranks), kind), SEGMENTS)
    return materialize(segments, "token-segments"), table


def _read(ids_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = ids_b.value[unpack(b.column("segment")[r].as_py())]
                sizes = np.array(b.column("sizes")[r].as_py(), dtype=np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != ends[-1]:
                    raise ValueError("segment and document sizes disagree")
                starts = ends - sizes
                whole = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(b.column("doc_ids")[r].as_py(), pa.int64()), pa.array(b.column("start")[r].as_py() + starts),
                    pa.array(sizes), pa.array([whole[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])
    return run


def read_segments(segments: DataFrame, ranks: DataFrame) -> DataFrame:
    """Decode written segments: doc_id, start (ids of all documents before
    it), n_tokens and ids (little-endian uint32 bytes)."""
    ids = np.zeros(ranks.count(), dtype=np.uint32)  # at most one row per vocabulary id
    for r in ranks.collect():
        ids[r["rank"]] = r["id"]
    total = segments.select("part", "part_start", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    per = total.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    offsets = F.broadcast(per.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o")))
    placed = segments.join(offsets, F.col("part") == F.col("_p")).select(
        (F.col("_o") + F.col("part_start")).alias("start"), "doc_ids", "sizes", "segment")
    return placed.mapInArrow(_read(segments.sparkSession.sparkContext.broadcast(ids)),
                             "doc_id bigint, start bigint, n_tokens bigint, ids binary")
