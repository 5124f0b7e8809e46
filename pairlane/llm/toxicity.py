"""Toxicity: a bag of subwords whose embeddings are averaged into a linear
softmax, embeddings and output layer trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams and
of itself; a text's vector is the weighted mean over its distinct words, the
weight of a word being softmax(SHARPNESS * its own logit) within the text.  An
unweighted mean drowns one insult in a thousand harmless words (measured:
recall 0.62 on held-out rows); the weights start out even and sharpen as the
two layers learn.  Unseen misspellings and inflections share n-grams with what
was seen and so score alike.

Training reads a bounded sample of labelled rows (``MAX_TOXIC`` and
``MAX_CLEAN``, lowest hash first); everything else runs over all rows.  After
training the two layers fold into one number per n-gram bucket, so a worker
scores a word once and a text by looking its words up.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlane.llm.common import Recent, small_batches, table, text_or_empty

#: Bounds of the training sample (rows of each class).
MAX_TOXIC, MAX_CLEAN = 1200, 3000
BUCKETS = 1 << 18
DIM = 8
MIN_GRAM, MAX_GRAM = 3, 6
EPOCHS = 120
LEARNING_RATE = 0.03
SHARPNESS = 2.0
#: Words a worker keeps scored, in each of two generations.
MAX_CACHED = 400_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> set:
    """Distinct lower-case words of a whole text, without the marks around them."""
    return set(text.lower().split())


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, so the low bits depend on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every character n-gram of each word with its edges
    marked, and of the whole word; n-grams are hashed for all words at once."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.array([len(w) for w in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), length)
    end = np.cumsum(length)
    left = end[owner] - np.arange(len(code))  # characters from here to the word's end
    base = np.uint64(0x9E3779B97F4A7C15)
    got_word, got_hash = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, MAX_GRAM + 1):
        shifted = np.zeros(len(code), np.uint64)
        shifted[:max(0, len(code) - n + 1)] = code[n - 1:]
        h = h * base + shifted + np.uint64(1)
        if n >= MIN_GRAM:
            ok = left >= n
            got_word.append(owner[ok])
            got_hash.append(h[ok] + np.uint64(n))
    place = np.arange(len(code)) - (end - length)[owner]
    whole = np.bincount(owner, (_mix(code * base + place.astype(np.uint64)) >> np.uint64(20)).astype(np.float64),
                        len(words))
    got_word.append(np.arange(len(words)))
    got_hash.append(whole.astype(np.uint64) + np.uint64(1 << 60))
    return (np.concatenate(got_word),
            (_mix(np.concatenate(got_hash)) % np.uint64(BUCKETS)).astype(np.int64))


def core_of(word: str) -> str:
    return word if word.isalnum() else _EDGE.sub("", word)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def train(texts: list[str], labels: list[int], seed: int = 7) -> bytes:
    """Fit on texts and 0/1 labels; returns the folded model: float32 bias, then
    float32 per bucket.  With one class alone every score is that class's
    smoothed share."""
    y = np.array(labels, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.25
        bias = np.float32(np.log(share / (1 - share)))
        return bias.tobytes() + np.zeros(BUCKETS, "<f4").tobytes()
    vocab, doc_words, keep = {}, [], []
    for k, text in enumerate(texts):
        ids = {vocab.setdefault(c, len(vocab)) for c in map(core_of, words_of(text)) if c}
        if ids:
            doc_words.append(sorted(ids))
            keep.append(k)
    y = y[keep]
    if len(y) == 0 or y.min() == y.max():
        return train([], [], seed) if len(y) == 0 else train([""] * len(y), y.tolist(), seed)
    doc_len = np.array([len(d) for d in doc_words])
    doc_index = np.concatenate(doc_words)
    gram_word, bucket = gram_table(list(vocab))
    used, gram = np.unique(bucket, return_inverse=True)
    word_len = np.bincount(gram_word, minlength=len(vocab))

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(used), DIM))
    out = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    doc_at = _starts(doc_len)
    params = [emb, out, bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        # with two classes only the difference of their logits matters, so the
        # layers are applied as one number per n-gram, word and text
        side = out[:, 1] - out[:, 0]
        word_logit = np.bincount(gram_word, (emb @ side)[gram], len(vocab)) / word_len
        inside = word_logit[doc_index]
        top = np.maximum.reduceat(inside, doc_at)
        share = np.exp(SHARPNESS * (inside - np.repeat(top, doc_len)))
        share /= np.repeat(np.add.reduceat(share, doc_at), doc_len)
        logit = np.add.reduceat(share * inside, doc_at) + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y) / len(y)
        by_word = np.bincount(doc_index, np.repeat(error, doc_len) * share, len(vocab)) / word_len
        by_gram = np.bincount(gram, by_word[gram_word], len(used))
        d_side = emb.T @ by_gram
        grads = [by_gram[:, None] * side, np.stack([-d_side, d_side], axis=1),
                 np.array([-error.sum(), error.sum()])]
        for x, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= LEARNING_RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    folded = np.zeros(BUCKETS, "<f4")
    folded[used] = emb @ (out[:, 1] - out[:, 0])
    return np.float32(bias[1] - bias[0]).tobytes() + folded.tobytes()


class Scorer:
    def __init__(self, model: bytes):
        self.bias = float(np.frombuffer(model, "<f4", 1)[0])
        self.by_bucket = np.frombuffer(model, "<f4", offset=4)
        self.known = Recent(MAX_CACHED)

    def learn(self, words: set) -> None:
        """Score words that are not known yet, all at once; a word of marks
        alone has no score."""
        known = self.known.turn()
        new = self.known.unknown(words)
        cores = [core_of(w) for w in new]
        full = [c for c in cores if c]
        if full:
            word, bucket = gram_table(full)
            mean = np.bincount(word, self.by_bucket[bucket], len(full)) / np.bincount(word, minlength=len(full))
        at = iter(mean.tolist() if full else [])
        known.update((w, next(at) if c else None) for w, c in zip(new, cores))

    def scores(self, texts: list[str]) -> list[float]:
        """The probability of label 1; a text without words has the bias alone."""
        out, step = [], 100
        for k in range(0, len(texts), step):
            cut = [words_of(t) for t in texts[k:k + step]]
            self.learn(set().union(*cut))
            out += [self._one(words) for words in cut]
        return out

    def _one(self, words: set) -> float:
        got = [s for s in map(self.known.new.__getitem__, words) if s is not None]
        logit = self.bias
        if got:
            s = np.sort(np.array(got))  # a fixed order, so a fixed sum
            share = np.exp(SHARPNESS * (s - s[-1]))
            logit += float(share @ s / share.sum())
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, logit))))


def training_rows(docs: DataFrame, labels: DataFrame, train_filter=None) -> DataFrame:
    """The bounded labelled sample: (text, toxic).  Rows with null ids or labels
    take no part; a doc_id with several labels counts as toxic if any says so.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)"))
    if train_filter is not None:
        known = known.where(train_filter)
    # only labels whose document is there, so the sample is as large as it may be
    known = (known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = (known.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC)
              .unionByName(known.where("toxic = 0").orderBy(*order).limit(MAX_CLEAN)))
    # at most MAX_TOXIC + MAX_CLEAN rows of two numbers: broadcast is bounded; of
    # the rows of one id the least text is taken
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, train_filter=None) -> bytes:
    """Train in one task on the bounded sample; the model (1 MB) comes back.
    Without a labelled row it is the model of no rows, which calls nothing toxic."""
    def run(batches):
        texts, y = [], []
        for pdf in batches:
            texts += pdf["text"].tolist()
            y += pdf["toxic"].tolist()
        if not y:
            return
        order = sorted(range(len(y)), key=lambda k: (zlib.crc32(texts[k].encode()), texts[k], y[k]))
        yield pd.DataFrame({"model": [train([texts[k] for k in order], [int(y[k]) for k in order])]})

    rows = training_rows(docs, labels, train_filter).select("text", "toxic")
    got = rows.coalesce(1).mapInPandas(run, "model binary").first()
    return bytes(got[0]) if got else train([], [])


def score(docs: DataFrame, model: bytes, into: str = "score", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1 (null text: as an
    empty one)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 4 * BUCKETS bytes, whatever the input

    def run(batches):
        scorer = Scorer(shared.value)
        for s in batches:
            yield pd.Series(scorer.scores(s.tolist()), dtype="float64")

    return docs.withColumn(into, F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(text_or_empty(text)))


def held_out(col: str = "doc_id"):
    """crc32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(False))


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; labels
    are learnt only where ``held_out`` is false."""
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
