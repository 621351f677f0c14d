"""Token-id files with a minimal perfect hash index (op10).

A store is a folder of shard files plus a manifest table. Documents are
range-partitioned by doc_id, so shard k holds the ids that follow those of
shard k-1. A shard file is::

    payload     ids of all its documents, little-endian, 2 bytes each when no id
                of the tokenizer file is over 65,535, else 4
    sections    arrays listed in the footer
    footer      JSON {section: [offset, count, dtype], ...}
    tail        footer length (8 bytes, little-endian) and the magic bytes

Sections: ``row_start`` (first id of each row, plus the end), the levels of
the minimal perfect hash (``bits``, ``ranks``, ``level_start``), and per hash
slot ``fingerprint`` (32 bits), ``first_row``, ``rows`` and ``key``. Looking
a key up costs a few hashes, one fingerprint comparison and a few ranged reads,
whatever the shard holds: sections are read as far as they are asked for.
Files are named by attempt, and the manifest names the files of successful
attempts only, so a task that runs again leaves no wrong file behind.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from dpframe.llm.common import new_folder, read, written
from dpframe.llm.tokens import DEFAULT_TOKENIZER, ID_BYTES, encoder, id_width

MAGIC = b"DPTOKIDX"
SHARD_ROWS = 8192
#: Bits per key in each level of the hash.
GAMMA = 2.0
SEED = np.uint64(0x9E3779B97F4A7C15)
MANIFEST_SCHEMA = "shard int, path string, docs long, tokens long, min_key long, max_key long, nulls long"
READ_IDS = 1 << 21
#: Items of a section that are read one by one; more load the section.
FEW = 64
#: Shards whose key ranges a lookup holds at a time (24 bytes each).
LOOKUP_SHARDS = 1 << 20


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """64-bit finaliser (splitmix64) of the keys, different for each level."""
    with np.errstate(over="ignore"):
        z = x + SEED * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64), 1_000_003) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys.

    Level by level, keys are hashed into a bit array of ``GAMMA`` bits a key;
    keys alone in their cell set its bit, the others go to the next level.
    The slot of a key is the number of bits set before its own.
    """

    def __init__(self, bits: np.ndarray, level_start: np.ndarray, ranks: np.ndarray | None = None):
        self.bits, self.level_start = bits, level_start
        self.ranks = ranks if ranks is not None else \
            np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little"))]).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        left = np.unique(keys.astype(np.int64)).view(np.uint64)
        levels, start = [], [0]
        while len(left):
            cells = max(8, int(GAMMA * len(left) + 7) // 8 * 8)
            at = (_mix(left, len(levels)) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            levels.append(alone)
            start.append(start[-1] + cells)
            left = left[~alone[at]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.packbits(flat, bitorder="little"), np.array(start, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that falls through all levels."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        h = keys.astype(np.int64).view(np.uint64)
        for level in range(len(self.level_start) - 1):
            if not len(todo):
                break
            a, b = self.level_start[level:level + 2]
            at = a + (_mix(h[todo], level) % np.uint64(b - a)).astype(np.int64)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit]
        return out


def open_path(path: str):
    """(file system, path) for a local path or a URI such as file:// or hdfs://."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and "://" not in path:
            path = "file://" + path[5:]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_shard(folder: str, shard: int, rows, width: int) -> tuple | None:
    """Write ``(doc_id or None, id bytes)`` rows, sorted with nulls first; returns the manifest row."""
    store, base = open_path(folder)
    path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
    keys, starts, nulls, n_ids = [], [0], 0, 0
    out = None
    for key, raw in rows:
        if out is None:
            store.create_dir(base, recursive=True)
            out = store.open_output_stream(path, buffer_size=1 << 20)
        if key is None:
            nulls += 1
        else:
            keys.append(key)
        n_ids += len(raw) // ID_BYTES
        starts.append(n_ids)
        if width < ID_BYTES:
            ids = np.frombuffer(raw, "<u4")
            if ids.max(initial=0) >> 8 * width:
                raise ValueError(f"an id does not fit in {width} bytes")
            raw = ids.astype(f"<u{width}").tobytes()
        out.write(raw)
    if out is None:
        return None
    keys = np.array(keys, np.int64)
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    order = np.empty(len(distinct), np.int64)
    order[slot] = np.arange(len(distinct))
    sections = {
        "row_start": np.array(starts, "<u8"), "bits": mph.bits, "ranks": mph.ranks.astype("<u4"),
        "level_start": mph.level_start.astype("<i8"), "fingerprint": fingerprints(distinct)[order].astype("<u4"),
        "first_row": (first[order] + nulls).astype("<u4"), "rows": count[order].astype("<u4"),
        "key": distinct[order].astype("<i8")}
    at, footer = n_ids * width, {"width": width, "nulls": nulls, "sections": {}}
    for name, a in sections.items():
        out.write(a.tobytes())
        footer["sections"][name] = [at, len(a), a.dtype.str]
        at += a.nbytes
    tail = json.dumps(footer).encode()
    out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
    out.close()
    full = path if folder == base else folder.rstrip("/") + path[len(base.rstrip("/")):]
    return (shard, full, len(starts) - 1, n_ids, int(keys.min()) if len(keys) else None,
            int(keys.max()) if len(keys) else None, nulls)


class Section:
    """An array in a shard file: a few items are read from their places, more load it whole."""

    def __init__(self, file, at: int, count: int, dtype: str):
        self.file, self.at, self.count, self.dtype = file, at, count, np.dtype(dtype)
        self.array = None

    def __len__(self):
        return self.count

    def load(self) -> np.ndarray:
        if self.array is None:
            self.array = np.frombuffer(self.file.read_at(self.count * self.dtype.itemsize, self.at), self.dtype)
        return self.array

    def __getitem__(self, i):
        i = np.asarray(i)
        if self.array is None and i.size <= FEW:
            size = self.dtype.itemsize
            raw = b"".join(self.file.read_at(size, self.at + size * k) for k in i.ravel().tolist())
            return np.frombuffer(raw, self.dtype).reshape(i.shape)
        return self.load()[i]


class ShardReader:
    """Keyed access to one shard file."""

    def __init__(self, path: str):
        store, p = open_path(path)
        self.file = store.open_input_file(p)
        size = self.file.size()
        self.file.seek(size - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        n = int.from_bytes(tail[:8], "little")
        self.file.seek(size - 16 - n)
        footer = json.loads(self.file.read(n))
        self.width, self.nulls = footer["width"], footer["nulls"]
        for name, (at, count, dtype) in footer["sections"].items():
            setattr(self, name, Section(self.file, at, count, dtype))
        self.hash = PerfectHash(self.bits, self.level_start.load(), self.ranks)

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, number of rows) per key; number 0 where the fingerprint says the key is absent."""
        keys = np.asarray(keys, np.int64)
        slot = self.hash.slots(keys)
        if not len(self.fingerprint):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        ok = (slot >= 0) & (self.fingerprint[np.maximum(slot, 0)] == fingerprints(keys))
        at = np.where(ok, slot, 0)
        return self.first_row[at].astype(np.int64), np.where(ok, self.rows[at], 0).astype(np.int64)

    def ids(self, row: int, rows: int = 1) -> np.ndarray:
        """Ids of ``rows`` rows from ``row`` on, one ranged read."""
        a, b = int(self.row_start[row]), int(self.row_start[row + rows])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def close(self):
        self.file.close()


def write_store(docs: DataFrame, folder: str, tokenizer: str = DEFAULT_TOKENIZER,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns the manifest.

    Null texts are the end id alone. Null doc_ids come first and are read by
    position; rows that repeat a doc_id follow each other and share one index
    entry. An empty table gives an empty manifest. Extra columns are ignored.
    Rows of one doc_id are ordered by a hash of the text, and may span shards.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    shards = max(1, -(-src.count() // shard_rows), src.sparkSession.sparkContext.defaultParallelism)
    tie = F.xxhash64("text")
    ordered = src.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), tie) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    width = id_width(tokenizer)

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext
        enc = encoder(tokenizer)

        def rows():
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at:at + 256]
                    for key, raw in zip(part["doc_id"], enc.encode(part["text"])):
                        yield (None if pd.isna(key) else int(key)), raw

        row = write_shard(folder, TaskContext.get().partitionId(), rows(), width)
        cols = [c.split()[0] for c in MANIFEST_SCHEMA.split(", ")]
        out = pd.DataFrame([row] if row else [], columns=cols)
        for c in cols[2:]:
            out[c] = out[c].astype("Int64")
        yield out

    # bounded: one row a shard
    return written(ordered.mapInPandas(write, MANIFEST_SCHEMA), "manifest")


def read_store(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored row, each found through the shard's hash index."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)    # one row a shard
    shards = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def scan(batches):
        import pandas as pd
        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"]):
                shard = ShardReader(path)
                keys = np.sort(shard.key.load())
                first, count = shard.rows_of(keys)
                if (count < 1).any():
                    raise ValueError(f"index of {path} misses a stored key")
                key_of = np.repeat(keys, count)
                rows = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                rows = np.concatenate([np.arange(shard.nulls), rows]).astype(np.int64)
                doc = pd.array([None] * shard.nulls + key_of.tolist(), dtype="Int64")
                start = shard.row_start[rows].astype(np.int64)
                length = shard.row_start[rows + 1].astype(np.int64) - start
                crc = np.zeros(len(rows), np.int64)
                at = 0
                while at < len(rows):          # rows are consecutive: read some millions of ids at a time
                    end = max(at + 1, int(np.searchsorted(start, start[at] + READ_IDS)))
                    ids = shard.ids(int(rows[at]), int(rows[end - 1] - rows[at] + 1)).astype("<u4")
                    for i in range(at, end):
                        a = int(start[i] - start[at])
                        crc[i] = zlib.crc32(ids[a:a + int(length[i])].tobytes())
                    at = end
                shard.close()
                yield pd.DataFrame({"doc_id": doc, "start": start + base, "n_tokens": length, "ids_crc32": crc})

    return shards.repartition(n).mapInPandas(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _shards_of(wanted: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, shard) for the shards whose key range holds the key; ``ranges`` has at most LOOKUP_SHARDS rows."""
    rows = ranges.orderBy("shard").toPandas()
    shard, least, most = (rows[c].to_numpy(np.int64) for c in ("shard", "min_key", "max_key"))

    def meet(batches):
        import pandas as pd
        for pdf in batches:
            key = pdf["doc_id"].to_numpy(np.int64)
            # shards are in key order, so those that hold a key follow each other
            lo, hi = np.searchsorted(most, key, "left"), np.searchsorted(least, key, "right")
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            yield pd.DataFrame({"doc_id": np.repeat(key, n), "shard": shard[at]})

    return wanted.mapInPandas(meet, "doc_id long, shard long")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids by key: ``keys`` has a doc_id column; returns doc_id, ids (one row per stored row of the key).

    A key finds its shards by binary search over their key ranges (one row a
    shard, ``LOOKUP_SHARDS`` of them at a time); absent and null keys give no
    row, repeated ones count once.
    """
    spark = manifest.sparkSession
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    ranges = manifest.where("min_key IS NOT NULL")
    last = ranges.agg(F.max("shard")).first()[0]
    met = spark.createDataFrame([], "doc_id long, shard long")
    for a in range(0, -1 if last is None else last + 1, LOOKUP_SHARDS):
        met = met.unionByName(_shards_of(wanted, ranges.where(F.col("shard").between(a, a + LOOKUP_SHARDS - 1))))
    met = met.join(manifest.select("shard", "path"), "shard")

    def find(batches):
        import pandas as pd
        frame = lambda doc, ids: pd.DataFrame({"doc_id": np.array(doc, np.int64), "ids": ids})
        for pdf in batches:
            for path, part in pdf.groupby("path"):
                shard = ShardReader(path)
                want = part["doc_id"].to_numpy(np.int64)
                doc, ids, held = [], [], 0
                for key, row, k in zip(want, *shard.rows_of(want)):
                    for j in range(k):
                        doc.append(key)
                        ids.append(shard.ids(int(row) + j).astype(np.int64))
                        held += len(ids[-1])
                        if held > READ_IDS:
                            yield frame(doc, ids)
                            doc, ids, held = [], [], 0
                shard.close()
                yield frame(doc, ids)

    return met.repartition("path").sortWithinPartitions("path").mapInPandas(find, "doc_id long, ids array<long>")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    return read_store(write_store(read(spark, sf_dir, "documents"), folder))
