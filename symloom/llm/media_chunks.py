"""Media columns: payloads cut where their content says, equal chunks kept once, and read back from chunk lists."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.text import cut, mix, pack, unpack
from symloom.plans.lineage import shared_folder

LINE = 192
LEAST, MOST, MASK_BITS = 512, 8192, 10
#: A random number for each byte, drawn by a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def payload(text: str | None) -> bytes:
    """UTF-8 with spaces up to a positive multiple of LINE bytes."""
    raw = (text or "").encode("utf-8")
    return raw + b" " * (max(1, -(-len(raw) // LINE)) * LINE - len(raw))


def to_media(raw: bytes) -> bytes:
    """A grey picture (binary PGM) of LINE samples a row, one byte a sample."""
    return b"P5\n%d %d\n255\n" % (LINE, len(raw) // LINE) + raw


def from_media(media: bytes) -> bytes:
    kind, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a picture of this kind")
    return samples


def cuts(media: bytes) -> list[int]:
    """Ends of the content-defined chunks: a gear hash of the last 32 bytes has MASK_BITS zero bits at the top.

    The rolling sum over 32 bytes is made by five doublings: the sum of two neighbours, of four, and so on.
    """
    h = GEAR[np.frombuffer(media, dtype=np.uint8)]
    for reach in (1, 2, 4, 8, 16):
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(reach)
        h = more
    ends, last = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST:
            ends.append(end)
            last = end
    while len(media) - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, len(media)] if last < len(media) else ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(raw: bytes) -> str:
    """Mean, deviation and the shares of eight ranges of the samples."""
    x = np.frombuffer(raw, dtype=np.uint8)
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    return f"mean={x.mean():.4f};std={x.std():.4f};hist={','.join(f'{s:.4f}' for s in shares)}"


def restore(listed: list[bytes], kept: dict[int, bytes]) -> bytes:
    """The media of an ordered chunk list, from its chunks by place; every chunk's digest is verified."""
    for place, name in enumerate(listed):
        if place not in kept or digest(kept[place]) != name:
            raise ValueError("a stored chunk is missing or damaged")
    return b"".join(kept[place] for place in range(len(listed)))


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def described(media: bytes, n_bytes: int) -> tuple:
    raw = from_media(media)
    return n_bytes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(raw)


PACK = "key binary, doc_id long, alone boolean, n_bytes long, digests array<binary>, own array<int>, given array<int>, lengths array<int>, blob binary"
_PACK_KINDS = [pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def _pack(key: bytes, doc_id: int | None, alone: bool, n_bytes: int, media: bytes, taken: set[int], given: list[int]) -> tuple:
    """A row of the store: the ordered list of all chunks' digests, and the bytes of those chunks that live here."""
    every = chunks(media)
    own = [i for i in range(len(every)) if i not in taken]
    return key, doc_id, alone, n_bytes, [digest(c) for c in every], own, given, [len(every[i]) for i in own], pack(b"".join(every[i] for i in own))


def _own_chunks(own: list[int], lengths: list[int], blob: bytes) -> dict[int, bytes]:
    data, ends = unpack(blob), np.cumsum(lengths).tolist()
    return {place: data[end - size : end] for place, size, end in zip(own, lengths, ends, strict=True)}


def _marked(keys: DataFrame, bits: int) -> np.ndarray:
    """Words of a bitmap of 2**``bits`` bits in which the keys' hashes are set."""
    cell = keys.select(F.expr(f"xxhash64(key) & {(1 << bits) - 1}").alias("cell"))
    words = cell.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits"))
    found = words.toArrow()  # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def store(docs: DataFrame, folder: str, mark_bits: int = 25) -> None:
    """Write the media of all documents to ``folder``: packs (the chunk store and the ordered chunk lists) and documents.

    Equal media have one key and one pack. A chunk that occurs in several places is stored once, in the pack of its
    least place (key, order); the others list its digest only. Digests are counted and joined by Spark. To spare the
    rest of the corpus a shuffle of its bytes, a bitmap of 2**``mark_bits`` bits marks the keys that give or take
    chunks or occur twice: unmarked media are packed where they are read, marked ones travel to their lists of given
    and taken chunks. A false mark costs a journey and changes nothing in what is stored.
    """
    key = F.expr("substring(unhex(sha2(coalesce(text, ''), 256)), 1, 16)").alias("key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key)

    def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out: tuple[list, list, list] = ([], [], [])
                for text, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    names = [digest(c) for c in chunks(to_media(payload(text)))]
                    out[0].extend(names)
                    out[1].extend([key] * len(names))
                    out[2].extend(range(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())], ["digest", "key", "place"])

    listed = cut(rows.select("text", "key").mapInArrow(list_chunks, "digest binary, key binary, place int"))
    at = F.struct("key", "place")
    shared = listed.groupBy("digest").agg(F.min(at).alias("home"), F.count(F.lit(1)).alias("often")).filter(F.col("often") > 1).select("digest", "home")
    shared = cut(shared)
    taken = listed.join(shared, "digest").filter(at != F.col("home")).select("key", "place").distinct()
    flags = taken.select("key", "place", F.lit(False).alias("gives")).unionByName(shared.select("home.key", "home.place", F.lit(True).alias("gives")))
    flags = cut(flags.groupBy("key").agg(F.collect_list(F.struct("place", "gives")).alias("flags")))  # chunks of one medium
    marks = docs.sparkSession.sparkContext.broadcast(_marked(flags, mark_bits))
    hashed = rows.withColumn("cell", F.expr(f"xxhash64(key) & {(1 << mark_bits) - 1}"))

    def sift(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(3).to_numpy()
            found = batch.filter(pa.array(((marks.value[cell >> 6] >> (cell & 63)) & 1 == 1) == wanted))
            for first in range(0, found.num_rows, 256):
                yield found.slice(first, 256)

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sift(batches, False):
            made = [_pack(key, doc_id, True, len((text or "").encode()), to_media(payload(text)), set(), []) for doc_id, text, key in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
            yield _batch(made, PACK, _PACK_KINDS)

    travelling = "doc_id long, key binary, n_bytes long, packed binary"

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sift(batches, True):
            made = []
            for doc_id, text, key in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                made.append((doc_id, key, len(raw), pack(raw)))
            yield _batch(made, travelling, [pa.int64(), pa.binary(), pa.int64(), pa.binary()])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                made = []
                for key, n_bytes, packed, flags in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    taken = {f["place"] for f in flags or () if not f["gives"]}
                    made.append(_pack(key, None, False, n_bytes, to_media(payload(unpack(packed).decode())), taken, [f["place"] for f in flags or () if f["gives"]]))
                yield _batch(made, PACK, _PACK_KINDS)

    moving = hashed.mapInArrow(travel, travelling)
    moving.select("doc_id", "key").write.parquet(f"{folder}/documents")
    media = moving.select("key", "n_bytes", "packed").dropDuplicates(["key"]).join(flags, "key", "left")
    hashed.mapInArrow(lone, PACK).unionByName(media.mapInArrow(parted, PACK)).write.parquet(f"{folder}/packs")


def stored_chunks(spark: SparkSession, folder: str, given: bool = False) -> DataFrame:
    """(digest, bytes) of every chunk in the store, or of those only that other media list too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                made = []
                for digests, own, gives, lengths, blob in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    have = _own_chunks(own, lengths, blob)
                    made += [(digests[i], have[i]) for i in (gives if given else own)]
                yield _batch(made, "digest binary, bytes binary", [pa.binary(), pa.binary()])

    packs = spark.read.parquet(f"{folder}/packs")
    packs = packs.filter(F.size("given") > 0) if given else packs
    return packs.select("digests", "own", "given", "lengths", "blob").mapInArrow(run, "digest binary, bytes binary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and the values computed from every document's payload, rebuilt from the chunk lists and chunks in ``folder``.

    Packs that hold all their chunks for one document are rebuilt where they are read; the others fetch the chunks
    that they do not hold by a join on the digest, and documents meet their media by key. Every chunk is verified
    against the digest listed for its place.
    """
    packs = spark.read.parquet(f"{folder}/packs")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, made = batch.slice(first, 256), []
                for n_bytes, digests, own, lengths, blob, got in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                    kept = _own_chunks(own, lengths, blob) | {g["place"]: g["bytes"] for g in got or ()}
                    made.append(described(restore(digests, kept), n_bytes))
                values = _batch(made, RESULT, _KINDS)
                yield pa.RecordBatch.from_arrays([part.column(0), *values.columns], [part.schema.names[0], *values.schema.names])

    parts = ["n_bytes", "digests", "own", "lengths", "blob"]
    nothing = F.lit(None).cast("array<struct<place:int,bytes:binary>>").alias("fetched")
    alone = packs.filter("alone").select("doc_id", *parts, nothing).mapInArrow(rebuilt, f"doc_id long, {RESULT}")
    several = packs.filter(~F.col("alone"))
    wanted = several.select("key", "own", F.posexplode("digests").alias("place", "digest")).filter(~F.array_contains("own", F.col("place"))).select("key", "place", "digest")
    fetched = wanted.join(stored_chunks(spark, folder, given=True), "digest").groupBy("key").agg(F.collect_list(F.struct("place", "bytes")).alias("fetched"))  # chunks of one medium
    media = several.join(fetched, "key", "left").select("key", *parts, "fetched").mapInArrow(rebuilt, f"key binary, {RESULT}")
    documents = spark.read.parquet(f"{folder}/documents")
    return alone.unionByName(documents.join(media, "key").select("doc_id", *_NAMES))


def store_and_read(docs: DataFrame, mark_bits: int = 25) -> DataFrame:
    """doc_id and the values computed from every document's payload, as read back from the chunk store.

    The store is written to a new folder in the session's shared one. Null texts count as empty; null ids are kept;
    repeated rows and equal texts give equal values; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    store(docs, folder, mark_bits)
    return read(spark, folder)
