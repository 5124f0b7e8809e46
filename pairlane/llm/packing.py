"""Packing of token pieces into sequences: first-fit decreasing with a
tournament tree of bin capacities, run independently in randomised groups.

Every document is tokenised and cut at whole sequence lengths; full pieces are
sequences of their own and only the rest of a document is packed.  Groups are
drawn by a hash, so a group is a random sample of bounded expected size
whatever the source or order of the documents, and no task sees more than its
groups.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlane.llm.common import small_batches, stored, text_or_empty
from pairlane.llm.tokens import encoder

GROUP_PIECES = 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class CapacityTree:
    """Tournament tree over bins; an inner node holds the larger free capacity
    below it, so the first bin with room is found from the root down."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put ``length`` into the first bin with room: (bin, room before)."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < length:
                node += 1
        room = free[node]
        free[node] = room - length
        at = node >> 1
        while at:
            left, right = free[2 * at], free[2 * at + 1]
            free[at] = left if left > right else right
            at >>= 1
        return node - self.leaves, room


def first_fit_decreasing(lengths, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, given in decreasing order; lengths are
    1 to ``capacity``."""
    tree = CapacityTree(len(lengths), capacity)
    bins, offsets = [], []
    for n in lengths:
        b, room = tree.place(int(n))
        bins.append(b)
        offsets.append(capacity - room)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of each document: whole sequence lengths from its
    start, then the rest.  A null text counts as an empty one, so every
    document has at least the end id."""
    small_batches(docs.sparkSession)

    def cut(batches):
        enc = encoder(tokenizer_path, keeps_space=False)
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, ids in zip(pdf["doc_id"], enc.encode(pdf["text"].tolist())):
                ids += end
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    part = ids[4 * at:4 * (at + capacity)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), total))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")) \
               .mapInPandas(cut, PIECES)


def pack(pieces: DataFrame, capacity: int, seed: int = 1,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Assign ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to
    ``capacity``.  Rows are told apart by their place alone, so repeated rows
    are packed once each; ties in length go by document and start."""
    pieces = stored(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    keyed = pieces.withColumn(
        "pl_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed)), F.lit(groups)))

    def fill(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"],
                              ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = (int(key[0]) << 32) + np.array(bins, dtype="int64")
        pdf["offset"] = np.array(offsets, dtype="int64")
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.drop(columns="pl_group")

    return keyed.groupBy("pl_group").applyInPandas(fill, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
                   seed: int = 1) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (``doc_id``, ``text``; other columns are
    not read).  An empty table gives no rows."""
    return pack(token_pieces(docs, tokenizer_path, end_id, capacity), capacity, seed)
