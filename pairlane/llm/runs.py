"""Periodic runs of words, by Lyndon roots.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the
same) that no neighbour extends.  Every run holds a Lyndon word of length ``q``
that is the longest Lyndon word from its place on, under the order of the words
or under the reverse one.  Phase one of Baier's suffix sorter groups the
suffixes by exactly these longest Lyndon prefixes: groups are taken from the
highest down, each appends its prefix to the suffixes before it, and what it
appended to differently often falls into groups of its own.  It runs once for
each order; no suffix array is built.  Each Lyndon root is then extended to
both sides by longest common extensions of the text with itself ``q`` words on.

Any total order of words serves; first occurrence in the text is the one taken.
Words are compared as bytes, so results are exact.  The work of a text is linear
but for the extensions, which a root inside a run that is known skips.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run in words and in periods.
MIN_WORDS, MIN_PERIODS = 6, 4

FOUND = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
         "collapsed string")


def lyndon_lengths(ids: list[int], values: int, reverse: bool) -> list[int]:
    """Length of the longest Lyndon word from each place on.  ``ids`` are below
    ``values``; ``reverse`` takes the larger id for the smaller letter.  A proper
    prefix is the smaller one under both orders."""
    n = len(ids)
    group = [0, *ids, -1]  # of the suffix at each place, from 1 on
    members: list[list[int]] = [[] for _ in range(values)]
    for place, g in enumerate(ids, 1):
        members[g].append(place)
    size = list(map(len, members))
    length = [1] * values  # of a group's common prefix
    # neighbours of a group in the order; -1: none
    steps = range(values)
    down = [g + 1 if g + 1 < values else -1 for g in steps] if reverse else [g - 1 for g in steps]
    up = [g - 1 for g in steps] if reverse else [g + 1 if g + 1 < values else -1 for g in steps]
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))
    out = [0] * (n + 2)
    at = (0 if reverse else values - 1) if values else -1

    def above(g: int, places: list[int], grown: int) -> None:
        """A new group for ``places``, next above ``g``."""
        new, high = len(members), up[g]
        members.append(places)
        size.append(len(places))
        length.append(grown)
        down.append(g)
        up.append(high)
        up[g] = new
        if high >= 0:
            down[high] = new
        size[g] -= len(places)
        for p in places:
            group[p] = new

    while at >= 0:
        if size[at]:
            grown = length[at]
            if size[at] == 1 and len(members[at]) == 1:
                place = members[at][0]
                before, after = left[place], right[place]
                right[before], left[after] = after, before
                out[place] = grown
                if before:
                    g = group[before]
                    if size[g] == 1:  # alone there already: its prefix grows in place
                        length[g] += grown
                    else:
                        above(g, [before], length[g] + grown)
            else:
                # places ascend, so those of one stretch leave from its left end on
                times: dict[int, int] = {}
                for place in members[at]:
                    if group[place] == at:
                        before, after = left[place], right[place]
                        right[before], left[after] = after, before
                        out[place] = grown
                        if before:
                            times[before] = times.get(before, 0) + 1
                parted: dict[tuple[int, int], list[int]] = {}
                for before, k in times.items():
                    key = (k, group[before])
                    if key in parted:
                        parted[key].append(before)
                    else:
                        parted[key] = [before]
                for k, g in sorted(parted, reverse=True) if len(parted) > 1 else parted:
                    places = parted[k, g]
                    if size[g] == len(places):
                        length[g] += k * grown
                        if len(members[g]) > size[g]:
                            members[g] = places
                    else:
                        above(g, places, length[g] + k * grown)
        at = down[at]
    return out[1:n + 1]


def _same(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """Places from ``a`` and ``b`` > ``a`` on (``step`` 1) or back (-1) that agree."""
    room = len(ids) - b if step > 0 else a + 1
    done, width = 0, 16
    while done < room:
        k = min(width, room - done)
        if step > 0:
            differ = ids[a + done:a + done + k] != ids[b + done:b + done + k]
        else:
            differ = (ids[a - done - k + 1:a - done + 1] != ids[b - done - k + 1:b - done + 1])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, width = done + k, min(4 * width, 1 << 16)
    return done


def _stretch_runs(line: np.ndarray, min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``line``, an array of ids."""
    n = len(line)
    values, code = np.unique(line, return_inverse=True)
    ids = code.tolist()
    start = np.concatenate([np.arange(n)] * 2)
    period = np.array(lyndon_lengths(ids, len(values), False) + lyndon_lengths(ids, len(values), True))
    # a run goes on beyond the root on at least one side
    padded = np.concatenate([[-1], line, [-2]])
    fits = period * min_periods <= n
    start, period = start[fits], period[fits]
    goes = (line[start] == padded[start + period + 1]) | (padded[start] == line[start + period - 1])
    start, period = start[goes], period[goes]
    order = np.lexsort((start, period))
    found, known, stop = set(), 0, 0
    for s, q in zip(start[order].tolist(), period[order].tolist()):
        if q == known and s + q <= stop:
            continue  # a root of the run before
        ahead = _same(line, s, s + q, 1) if s + q < n else 0
        back = _same(line, s - 1, s + q - 1, -1) if s else 0
        length = back + q + ahead
        if length >= 2 * q:
            known, stop = q, s + q + ahead
            if length >= max(min_words, min_periods * q):
                found.add((s - back, length, q))
    return list(found)


def word_runs(words: list, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_words`` words and
    ``min_periods`` (2 or more) periods, by start, then period.

    A run holds each of its words ``min_periods`` times, so a word with fewer
    occurrences in the text is in none: the text falls apart there, and phase one
    takes each stretch between such words on its own."""
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(words) < max(min_words, min_periods) or len(code) == len(words):
        return []
    line = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    often = np.concatenate([[False], np.bincount(line)[line] >= min_periods, [False]])
    edges = np.flatnonzero(often[1:] != often[:-1])
    found = []
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if z - a >= max(min_words, min_periods):
            found += [(a + s, length, q) for s, length, q in _stretch_runs(line[a:z], min_words, min_periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[k] for k in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, rewrite: Callable[[int | None, list], list] | None = None,
              min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period)
    and collapsed text of every row of ``docs`` (``doc_id``, ``text``).

    Words are `[^\\x20\\x09-\\x0D]+`; ``rewrite(doc_id, words)`` may change them
    first.  Null and empty texts have no words, no runs and an empty collapsed
    text; rows without an id and repeated rows each give a row; other columns are
    not read; an empty table gives no rows.  No row meets another, so nothing is
    shuffled, and a long text costs its own length."""
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                rows = []
                for doc, text in zip(pdf["doc_id"].iloc[at:at + 256], pdf["text"].iloc[at:at + 256]):
                    doc = None if pd.isna(doc) else int(doc)
                    # bytes.split takes exactly the six ASCII blanks
                    words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                    if rewrite:
                        words = rewrite(doc, words)
                    runs = word_runs(words, min_words, min_periods)
                    rows.append((doc, len(words), runs,
                                 b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")))
                out = pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["runs"] = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in out["runs"]]
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInPandas(run, FOUND)


def planted(doc_id: int | None, words: list) -> list:
    """Makes every tenth id (by crc32) periodic from some word on; rows without an
    id stay as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def report(docs: DataFrame) -> DataFrame:
    """One row per document over its planted words: the longest run (ties: the
    smallest start, then period; four nulls where there is none), the number of
    runs and digests of all runs and of the collapsed text."""
    rows = find_runs(docs, planted)
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"]))
                        .when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
                        .otherwise(F.signum(x["period"] - y["period"])).cast("int"))[0]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return (rows.withColumn("best", F.when(F.size("runs") > 0, best))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"),
                    F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                    F.col("best.period").alias("period"),
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
