"""SentencePiece encoding and decoding.

A unigram model is encoded by joins: the distinct chunks of a block of documents
are exploded into substrings up to the longest piece, equi-joined to the piece table,
grouped back by chunk, and the lattice is folded by ``aggregate`` (Viterbi) into ids;
the documents of the block then take the ids of their chunks.

A BPE model has no lattice: its pieces come from merges in the order of their ranks.
``encode_merges`` does them for each distinct chunk, where the texts are, without
any shuffle.

For the joins, documents are dealt round robin into blocks, ``BLOCKS`` for every shuffle partition
set, so a word that fills a third of all texts is one row in every block and never a hot key,
and the texts are shuffled once: all that follows is grouped by block.  The edges of
a block are about thirty times its text and are sorted in memory; more shuffle
partitions make blocks smaller.

The piece table has as many rows as the model file has pieces, so its broadcast
is bounded by the file.  Rules of both models: see ``pieces``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm.common import Recent, shuffle_partitions, small_batches, text_or_empty
from pairlane.llm.pieces import BLANK, Pieces, chunks, load, merged

#: Latin letters; where no piece joins them to other characters, a chunk is cut
#: between them and the rest, so that ``word`` and ``word,`` share their edges.
LETTERS = "A-Za-z\u00c0-\u024f"
#: Blocks to a shuffle partition: the edges of one are sorted without spilling.
BLOCKS = 4
#: Chunks kept by a Python worker, and the longest that is kept.
MAX_CACHED, MAX_CHUNK = 300_000, 200
CODED = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


def chunk_pattern(pieces: Pieces) -> str:
    """What one chunk is, for Java and Python alike: blanks and what follows them."""
    letter = re.compile(f"[{LETTERS}]")
    bare = [p.lstrip(BLANK) for p in pieces.score]
    apart = all(len({letter.match(c) is None for c in p}) < 2 for p in bare)
    body = f"(?:[{LETTERS}]+|[^{LETTERS} {BLANK}]+)" if apart else f"[^ {BLANK}]+"
    return f"[ {BLANK}]*{body}|[ {BLANK}]+$"


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([(p, s, pieces.id[p]) for p, s in pieces.score.items()],
                                 "piece string, piece_score double, id int")


def word_array(text):
    """The words of a text as an array, each with the blanks before it as blank
    marks, one blank put before the text; an empty text has none."""
    marked = F.concat(F.lit(" "), text)
    runs = F.regexp_extract_all(marked, F.lit(r" *[^ ]+| +$"), F.lit(0))
    return (F.when(F.length(text) == 0, F.array().cast("array<string>"))
            .when(marked.contains("  ") | text.endswith(" "), F.transform(runs, lambda w: F.replace(w, F.lit(" "), F.lit(BLANK))))
            .otherwise(F.transform(F.split(text, " "), lambda w: F.concat(F.lit(BLANK), w))))


def encode_chunks(words: DataFrame, pieces: Pieces) -> DataFrame:
    """The folded lattice (see ``follow``) of every row of a table of distinct
    (block, chunk), grouped by block."""
    spark = words.sparkSession
    # the hash is the key of the join, as a number; the piece decides
    table = F.broadcast(piece_table(spark, pieces).withColumnRenamed("piece", "known").withColumn("hash", F.xxhash64("known")))
    n = F.length("chunk")
    # one number a chunk, ascending within a task: the groups below come in order
    places = (words.select("block", "chunk", F.monotonically_increasing_id().alias("word"))
              .select("*", F.explode(F.sequence(F.lit(1), n)).alias("stop")))
    parts = places.select("*", F.explode(F.sequence(
        F.lit(1), F.least(F.col("stop"), F.lit(pieces.longest)))).alias("len"))
    parts = parts.withColumn("start", F.col("stop") - F.col("len")) \
                 .withColumn("piece", F.expr("substring(chunk, start + 1, len)"))
    edges = (parts.join(table, (F.xxhash64("piece") == F.col("hash")) & (F.col("piece") == F.col("known")), "left").where("id IS NOT NULL OR len = 1")
             .select("word", "block", "chunk", "stop", "start",
                     F.coalesce("piece_score", F.lit(pieces.unknown_score)).alias("s"),
                     F.coalesce("id", F.lit(-1)).alias("id")))
    nodes = edges.groupBy("word", "block", "chunk", "stop").agg(
        F.sort_array(F.collect_list(F.struct("start", "s", "id"))).alias("edges"))
    lattice = nodes.groupBy("word", "block", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("stop", "edges"))).alias("nodes")).withColumn("n", F.size("nodes"))
    kind = "struct<score:double,start:int,id:int>"

    def node(state, row):
        # ascending start; only a strictly better score replaces
        best = F.aggregate(
            row["edges"], F.lit(None).cast(kind),
            lambda b, e: F.when(b.isNull() | (F.get(state, e["start"])["score"] + e["s"] > b["score"]), F.struct(
                (F.get(state, e["start"])["score"] + e["s"]).alias("score"), e["start"].alias("start"),
                e["id"].alias("id"))).otherwise(b))
        return F.concat(state, F.array(best))

    path = lattice.select("block", "chunk", "n", F.aggregate(
        "nodes", F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id")).cast(kind)),
        node).alias("path"))
    return path.select("block", "chunk", F.transform("path", lambda x: x["start"]).alias("starts"),
                       F.transform("path", lambda x: x["id"]).alias("ids"))


def follow(chunk: str, starts: list, ids: list, pieces: Pieces) -> list[int]:
    """The ids of a chunk from its folded lattice: ``starts`` and ``ids`` of the best
    last piece at every place; an unknown character becomes the pieces of its bytes."""
    at, out = len(chunk), []
    while at > 0:
        if ids[at] >= 0:
            out.append(ids[at])
        elif pieces.byte_id:
            out.extend(pieces.byte_id[b] for b in reversed(chunk[at - 1].encode("utf-8", "surrogatepass")))
        else:
            out.append(pieces.unknown_id)
        at = starts[at]
    return out[::-1]


def decode_ids(rows: DataFrame, pieces: Pieces, key: str) -> DataFrame:
    """(``key``, ``decoded``) of rows with ``ids``: the text of each id list, blank
    marks as blanks.  Bytes that are no text become the replacement character."""
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(i, bytearray(p.encode())) for p, i in pieces.id.items()]
        + [(i, bytearray([b])) for b, i in pieces.byte_id.items()], "id int, data binary")
    parts = rows.select(key, F.posexplode("ids").alias("at", "id")).join(F.broadcast(table), "id")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.hex("data").alias("h")))), lambda r: r["h"]), "")
    return parts.groupBy(key).agg(F.replace(F.decode(F.unhex(joined), "utf-8"), F.lit(BLANK), F.lit(" ")).alias("decoded"))


def coded_row(doc, ids: np.ndarray, text: str, data: dict) -> tuple:
    marked = (" " + text).replace(" ", BLANK) if text else ""
    back = b"".join([data.get(i, b"") for i in ids.tolist()]).decode(errors="replace")
    return doc, len(ids), ids, back == marked


class Merger:
    """Ids of texts by the merges of a BPE model."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, Recent(MAX_CACHED)
        self.data = {i: p.encode() for p, i in pieces.id.items()} | {i: bytes([b]) for b, i in pieces.byte_id.items()}

    def chunk(self, chunk: str) -> bytes:
        p, ids = self.pieces, []
        for piece in merged(chunk, p.score):
            if piece in p.id:
                ids.append(p.id[piece])
            elif p.byte_id:
                ids.extend(p.byte_id[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                ids.append(p.unknown_id)
        return np.array(ids, np.int32).tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        known, extra = self.known.turn(), {}
        cut = [chunks(t) for t in texts]
        for c in self.known.unknown(set().union(*cut)):
            (known if len(c) <= MAX_CHUNK else extra)[c] = self.chunk(c)
        return [np.frombuffer(b"".join([known[w] if w in known else extra[w] for w in c]), np.int32) for c in cut]


_MERGERS: dict = {}


def encode_merges(docs: DataFrame, model_path: str) -> DataFrame:
    """``encode_documents`` for a BPE model."""
    small_batches(docs.sparkSession)

    def run(batches):
        if model_path not in _MERGERS:
            _MERGERS[model_path] = Merger(load(model_path))
        merger = _MERGERS[model_path]
        for pdf in batches:
            texts = pdf["text"].tolist()
            out = pd.DataFrame([coded_row(doc, ids, t, merger.data) for doc, ids, t
                                in zip(pdf["doc_id"].astype("Int64"), merger.ids(texts), texts)],
                               columns=["doc_id", "n_tokens", "ids", "round_trip"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInPandas(run, CODED))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (the ids decode to the text again, a
    blank mark in it read as a blank) of every row of ``docs``; a null or empty text
    has no ids.  For a unigram model sorted grouping is set for the session: the edges arrive in order,
    and hashed grouping would write them out."""
    pieces = load(model_path)
    if pieces.bpe:
        return encode_merges(docs, model_path)
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.useObjectHashAggregateExec", "false")
    pattern = chunk_pattern(pieces)
    blocks = BLOCKS * shuffle_partitions(spark)
    # id and text are one column, so that both readers below share one shuffle
    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"),
                                text_or_empty()).alias("row"),
                       F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"))
    rows = rows.repartitionById(blocks, "block")
    words = rows.select("block", F.explode(word_array(F.expr("substring(row, instr(row, ':') + 1)"))).alias("word")).distinct()
    words = words.select("block", F.explode(F.regexp_extract_all("word", F.lit(pattern), F.lit(0))).alias("chunk")).distinct()
    coded = encode_chunks(words, pieces).withColumnRenamed("block", "of_block")
    data = {i: p.encode() for p, i in pieces.id.items()} | {i: bytes([b]) for b, i in pieces.byte_id.items()}

    def assemble(texts: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        cut = re.compile(pattern)
        known = {c: np.array(follow(c, a.tolist(), i.tolist(), pieces), np.int32)
                 for c, a, i in zip(chunks["chunk"], chunks["starts"], chunks["ids"])}
        out = []
        for row in texts["row"]:
            doc, text = row.split(":", 1)
            parts = [known[c] for c in cut.findall((" " + text).replace(" ", BLANK))] if text else []
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            out.append(coded_row(int(doc) if doc else None, ids, text, data))
        got = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids", "round_trip"])
        got["doc_id"] = got["doc_id"].astype("Int64")
        return got

    return rows.groupBy("block").cogroup(coded.groupBy("of_block")).applyInPandas(assemble, CODED)
