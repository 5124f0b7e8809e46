"""Token counts without tokens.  For a unigram model, Aho-Corasick enumerates the
vocabulary matches of a chunk by their ends, and dynamic programming carries the
best score and its piece count, nothing else, under the tokenizer's tie rule.  For
a BPE model the merges of a chunk are done and counted (see ``pieces`` for both).
Every distinct chunk is counted once while it is in the cache."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlane.llm.common import Recent, small_batches, text_or_empty
from pairlane.llm.pieces import Pieces, chunks, load, merged

MAX_CACHED, MAX_CHUNK = 600_000, 200


class Counter:
    def __init__(self, pieces: Pieces):
        import ahocorasick
        self.pieces, self.known = pieces, Recent(MAX_CACHED)
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces.score.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()

    def count(self, chunk: str) -> tuple[int, float]:
        """(pieces, score) of the best path."""
        n = len(chunk)
        score, count = [None] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        p, at = self.pieces, 0
        single, bytes_ = p.score, bool(p.byte_id)

        def unknown(i):  # the character before place i, if no piece is it
            c = chunk[i - 1]
            if c not in single:
                s = score[i - 1] + p.unknown_score
                if score[i] is None or s > score[i]:
                    score[i], count[i] = s, count[i - 1] + (len(c.encode("utf-8", "surrogatepass")) if bytes_ else 1)

        # matches come by ascending end and, at one end, longest first
        for end, (length, s) in self.matches.iter(chunk):
            while at < end:
                at += 1
                unknown(at)
            s += score[end + 1 - length]
            if score[end + 1] is None or s > score[end + 1]:
                score[end + 1], count[end + 1] = s, count[end + 1 - length] + 1
        while at < n:
            at += 1
            unknown(at)
        return count[n], score[n]

    def counts(self, texts: list[str]) -> list[tuple[int, float]]:
        known, extra = self.known.turn(), {}
        cut = [chunks(t) for t in texts]
        for c in self.known.unknown(set().union(*cut)):
            (known if len(c) <= MAX_CHUNK else extra)[c] = self.count(c)
        out = []
        for c in cut:
            got = [known[w] if w in known else extra[w] for w in c] if extra else list(map(known.__getitem__, c))
            out.append((sum(g[0] for g in got), float(sum(g[1] for g in got))))
        return out


class MergeCounter(Counter):
    """The same for a BPE model; the score is the sum over the pieces chosen."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, Recent(MAX_CACHED)

    def count(self, chunk: str) -> tuple[int, float]:
        p, n, score = self.pieces, 0, 0.0
        for piece in merged(chunk, p.score):
            s = p.score.get(piece)
            n += 1 if s is not None or not p.byte_id else len(piece.encode("utf-8", "surrogatepass"))
            score += p.unknown_score if s is None else s
        return n, score


_COUNTERS: dict = {}


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and score (sum over its pieces; 0 for an empty or null text)
    of every row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches):
        if model_path not in _COUNTERS:
            pieces = load(model_path)
            _COUNTERS[model_path] = MergeCounter(pieces) if pieces.bpe else Counter(pieces)
        for pdf in batches:
            got = _COUNTERS[model_path].counts(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_tokens": [g[0] for g in got],
                                "score": [g[1] for g in got]})

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInPandas(run, "doc_id long, n_tokens long, score double"))
