"""Directly addressable codes for token ids.

An id is split into chunks of ``CHUNK_BITS`` bits, lowest first.  Level 0 holds
the first chunk of every id, level ``l`` the next chunk of those ids that go on;
one continuation bit per chunk says whether its id goes on, and a rank directory
(set bits before every block of ``BLOCK`` bits) turns a place on one level into
the place on the next.  So token ``i`` is read with one lookup per level and no
block is decoded.

A shard image is: magic, then a header of unsigned 32-bit numbers (documents,
tokens, levels), the document directory (ids as signed 64-bit numbers, a null
flag each, first token of each as unsigned 32-bit numbers), then per level its
length, the chunks, the bitmap and the rank directory.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlane.llm.common import shuffle_partitions, small_batches, text_or_empty, work_path
from pairlane.llm.tokens import encoder

MAGIC = b"DAC1"
CHUNK_BITS = 8
BLOCK = 512
SHARD_TOKENS = 1 << 20
#: Tokens that are read in one call: arrays that stay near the processor.
READ_TOKENS = 1 << 15
#: Bytes of text that are encoded in one call.
TOGETHER = 1 << 23

TOKENISED = "doc_id long, pl_bucket int, n_tokens long, ids binary"
SHARDS = "bucket int, shard int, before long, n_docs long, n_tokens long, image binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap words, rank directory) per level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        more = rest >> np.uint32(CHUNK_BITS)
        goes_on = more != 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        per_block = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4") if len(per_block) else \
            np.zeros(0, "<u4")
        levels.append((chunks, bits, ranks))
        rest = more[goes_on]
        if not len(rest):
            return levels


def write_image(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u4")
    out = [MAGIC, struct.pack("<3I", len(lengths), len(ids), len(levels)),
           np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
           np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(), starts.tobytes()]
    for chunks, bits, ranks in levels:
        out += [struct.pack("<I", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Image:
    """Reads a shard image: ``token(i)`` is random access, ``tokens(a, b)`` a
    range, neither decodes what lies before it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard image")
        docs, self.n_tokens, n_levels = struct.unpack_from("<3I", data, 4)
        at = 16

        def take(dtype, n):
            nonlocal at
            got = np.frombuffer(data, dtype, n, at)
            at += got.nbytes
            return got
        ids, null = take("<i8", docs), take(np.uint8, docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.starts = take("<u4", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u4", 1)[0])
            chunks = take(np.uint8, n)
            blocks = -(-n // BLOCK)
            bits = take(np.uint8, blocks * BLOCK // 8)
            self.levels.append((chunks, bits, take("<u4", blocks)))

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def tokens(self, begin: int, end: int) -> np.ndarray:
        place = np.arange(begin, end)
        out = np.zeros(len(place), np.uint32)
        open_ = np.arange(len(place))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[open_] |= chunks[place].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            on = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            place, open_ = place[on], open_[on]
            if not len(place):
                break
            # the places that go on ascend: rank of the first, then one by one
            first = int(place[0])
            block = first // BLOCK
            head = np.unpackbits(bits[block * BLOCK // 8:first // 8 + 1], bitorder="little")
            rank = int(ranks[block]) + int(head[:first - block * BLOCK].sum())
            place = rank + np.arange(len(place))
        return out


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """At most ``n - 1`` doc_ids that cut the documents into even ranges."""
    if n < 2:
        return []
    got = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0]
    return sorted({int(x) for x in got or []})


def _together(batches):
    """Lists of batches with about ``TOGETHER`` bytes of text: words that come again
    in them are met once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch["text"].nbytes
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Tokenise whole texts (null: empty), append ``end_id`` to each and write
    shard images in ascending doc_id order (null ids first, repeated ids next
    to each other).  A task streams through its sorted range and holds one
    shard at a time; ids travel as compressed 16-bit numbers where the
    vocabulary allows."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    bounds = _bounds(docs, shuffle_partitions(spark))
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    bucket = F.coalesce(F.size(F.filter(cuts, lambda b: b <= F.col("doc_id"))), F.lit(0))

    def tokenise(batches):
        import zstandard
        enc = encoder(tokenizer_path, keeps_space=True)
        wide = max(enc.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        press = zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], "<u4").tobytes()
        for held in _together(batches):
            found = iter(enc.encode_column(pa.concat_arrays([b["text"].cast(pa.large_string()) for b in held])))
            for batch in held:
                ids = [np.frombuffer(next(found) + end, "<u4") for _ in range(len(batch))]
                packed = [press.compress((i if wide else i.astype("<u2")).tobytes()) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["pl_bucket"], pa.array(map(len, ids), pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "pl_bucket", "n_tokens", "ids"])

    def to_images(batches):
        import zstandard
        held_bucket, shard, before, ids, held, docs_, n = None, 0, 0, [], [], [], 0
        unpress = zstandard.ZstdDecompressor()

        def flush():
            image = write_image(docs_, held, np.concatenate(ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([held_bucket], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([len(held)], pa.int64()), pa.array([n], pa.int64()), pa.array([image], pa.binary())],
                names=["bucket", "shard", "before", "n_docs", "n_tokens", "image"])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("doc_id", "pl_bucket", "n_tokens", "ids")]
            for doc, b, count, data in zip(*columns):
                raw = unpress.decompress(data)
                if held and (b != held_bucket or n + count > shard_tokens):
                    yield flush()
                    shard, before = (shard + 1, before + n) if b == held_bucket else (0, 0)
                    ids, held, docs_, n = [], [], [], 0
                held_bucket = b
                ids.append(np.frombuffer(raw, "<u4" if len(raw) == 4 * count else "<u2").astype(np.uint32))
                held.append(count)
                docs_.append(doc)
                n += count
        if held:
            yield flush()

    (docs.withColumn("pl_bucket", bucket).mapInArrow(tokenise, TOKENISED)
         .repartition(len(bounds) + 1, "pl_bucket")
         .sortWithinPartitions("pl_bucket", "doc_id", "n_tokens", F.crc32("ids"))
         .mapInArrow(to_images, SHARDS)
         .write.option("compression", "zstd").parquet(path))


def read_shards(spark, path: str) -> DataFrame:
    """One row per document, read back from the images at ``path``."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # one row per bucket, at most as many as the writer had partitions
    totals = sorted((r["bucket"], r["n"]) for r in
                    shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())
    base, at = {}, 0
    for b, n in totals:
        base[b] = at
        at += n

    def decode(batches):
        for batch in batches:
            for b, before, data in zip(*(batch[c].to_pylist() for c in ("bucket", "before", "image"))):
                image = Image(data)
                ids = np.concatenate([image.tokens(k, min(k + READ_TOKENS, image.n_tokens)).astype("<u4")
                                      for k in range(0, max(image.n_tokens, 1), READ_TOKENS)])
                s = image.starts
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(s[:-1], s[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(image.doc_ids, pa.int64()), pa.array(base[b] + before + s[:-1], pa.int64()),
                     pa.array(s[1:] - s[:-1], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(spark, 16)
    return shards.select("bucket", "before", "image").mapInArrow(decode, READ)


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int,
               shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` as shard images into the shared folder and read them back."""
    path = work_path(docs.sparkSession, "dac")
    write_shards(docs, tokenizer_path, end_id, path, shard_tokens)
    return read_shards(docs.sparkSession, path)
