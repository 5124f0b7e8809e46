"""Token ids of whole texts with the ``tokenizers`` library, word by word.

A text is cut where the tokenizer's own pre-tokenizer always cuts: before a
blank that follows a character that is no white space.  The ids of a text are
then the ids of its chunks in order, and a chunk that was seen before need not
be encoded again; a new one is cut further (``parts``), so that ``word`` and
``word,`` are encoded once.  Every part is encoded by the library itself, many
in one call; the cache holds at most twice ``MAX_CACHED`` chunks and parts in a
worker, the latest used.

Where blanks belong to the ids, the words of many texts are told apart by Arrow's
dictionary encoding: Python meets every distinct word of a call once, and the ids
of the texts are gathered from those of the words by numpy.
"""

from __future__ import annotations

import gc
import os
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pairlane.llm.common import Recent

MAX_CACHED = 800_000
#: Longer chunks are encoded but not kept, so the cache is bounded in bytes.
MAX_CHUNK = 200

#: White space followed by a blank: there the blank is no safe cut.  Arrow's \s is
#: ASCII only, so the characters are listed.
_RUN = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
        r"\x{205f}\x{3000}] ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: A line break on its own between other characters is a part of its own.
_LINE = re.compile(r"(?<=\S)(\n)(?=\S)")
#: Signs that end a run of letters and never start a contraction.
_SIGNS = string.punctuation.replace("'", "")
#: Letters below are letters in every version of Unicode.
_LATIN = "\u0250"
#: Words whose ids are gathered at a time.
GATHERED = 1 << 15


def _byte_letters() -> str:
    """The letters that stand for the 256 bytes in a byte-level vocabulary; a line
    break, which is in no word of letters, stays."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(own, map(chr, own)))
    letters.update((b, chr(256 + k)) for k, b in enumerate(b for b in range(256) if b not in letters))
    return "".join("\n" if b == 10 else letters[b] for b in range(256))


_BYTE_LETTERS = _byte_letters()


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids (as bytes).

    ``keeps_space``: blanks belong to the ids (byte-level vocabularies); else
    white space only separates words.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # the strings of special tokens are ordinary text in a document
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        self.known = Recent(MAX_CACHED)
        self.bare = self.tokenizer
        if not keeps_space:  # for text that the library has normalised already
            from tokenizers import normalizers
            self.bare = Tokenizer.from_file(path)
            self.bare.encode_special_tokens = True
            self.bare.normalizer = normalizers.Sequence([])
        self.letters = self._letters_alone() if keeps_space else None
        # one character of a token stands for one byte
        self.width = np.zeros(self.bare.get_vocab_size(), dtype=np.int64)
        for token, i in self.bare.get_vocab().items():
            self.width[i] = len(token if keeps_space else token.removesuffix("</w>"))

    def _letters_alone(self):
        """The library's model for words of letters in their byte letters, a line
        break between two: the pre-tokenizer would leave each of them whole.  None
        where it may not."""
        from tokenizers import Tokenizer, pre_tokenizers
        cut = self.tokenizer.pre_tokenizer
        if not (isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
                and self.tokenizer.normalizer is None
                and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())):
            return None
        alone = Tokenizer(self.tokenizer.model)
        alone.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        return alone

    def chunks(self, text: str) -> list[str]:
        """The words of a text whose blanks only separate them."""
        # ASCII white space only: every engine's \s has these six
        return [w.decode() for w in text.encode().split()]

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut where the pre-tokenizer cuts it in any text: at a single
        line break, and between a letter and the signs that end it.  ASCII words
        of a lower-casing vocabulary come in lower case."""
        if not self.keeps_space:
            lines = [chunk.lower() if chunk.isascii() else chunk]
        else:
            head = chunk.rstrip(_SIGNS)
            if head.removeprefix(" ").isalpha() and head[-1] < _LATIN:  # by far the most
                return [head, chunk[len(head):]] if len(head) < len(chunk) else [chunk]
            lines = _LINE.split(chunk) if "\n" in chunk else [chunk]
        out = []
        for line in lines:
            head = line.rstrip(_SIGNS)
            if len(head) < len(line) and head and head[-1] < _LATIN and head[-1].lower().isalpha():
                out += [head, line[len(head):]]
            else:
                out.append(line)
        return out

    def _singly(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> list[bytes] | None:
        """Ids of parts that the pre-tokenizer keeps apart, from one call; cut by
        the bytes of the tokens.  None where the cuts do not meet the parts."""
        if self.keeps_space:
            text, words = "".join(parts), parts
        else:
            text = " ".join(parts)
            if not text.isascii():
                text = self.tokenizer.normalizer.normalize_str(text)
            words = text.split(" ")
        if len(words) != len(parts):
            return None
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        return self._cut(ids, [len(w) if w.isascii() else len(w.encode()) for w in words])

    def _letters(self, parts: list[str]) -> list[bytes] | None:
        """The same for words of letters, a blank before them or not."""
        text = "\n".join(parts).encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        return self._cut(ids, list(map(len, text.split("\n"))))

    def _cut(self, ids: np.ndarray, bytes_: list[int]) -> list[bytes] | None:
        """``ids`` cut into parts of so many bytes; None where no token ends there."""
        stops, wanted = np.cumsum(self.width[ids]), np.cumsum(bytes_)
        ends = np.searchsorted(stops, wanted) + 1
        if not len(ids) or stops[-1] != wanted[-1] or (stops[ends - 1] != wanted).any():
            return None
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:z] for a, z in zip([0, *ends], ends)]

    def _way(self, part: str) -> str:
        if not self.keeps_space:
            return "_together"
        if self.letters and part.removeprefix(" ").isalpha() and (part.isascii() or max(part) < _LATIN):
            return "_letters"
        apart = part[:1] == " " and len(part) > 1 and not part[1].isspace() and not part[-1].isspace()
        return "_together" if apart else "_singly"

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each of ``parts``, in the given order."""
        places, out = {}, [b""] * len(parts)
        for k, p in enumerate(parts):
            places.setdefault(self._way(p), []).append(k)
        for way, at in places.items():
            for k, ids in zip(at, self._batches([parts[k] for k in at], way)):
                out[k] = ids
        return out

    def _batches(self, parts: list[str], way: str) -> list[bytes]:
        out = []
        for at in range(0, len(parts), 1024):
            part = parts[at:at + 1024]
            got = getattr(self, way)(part)
            out += self._singly(part) if got is None else got
        return out

    def _learn(self, chunks) -> dict:
        """Chunks that are not among the newest go into the cache; returns the ids
        of those too long for it."""
        known, extra = self.known.new, {}
        new = self.known.unknown(chunks)
        # letters alone, by far the most, are their only part
        lone = [w for w in new if w.removeprefix(" ").isalpha()] if self.keeps_space else []
        cut = [(w, self.parts(w)) for w in new if not (self.keeps_space and w.removeprefix(" ").isalpha())]
        fresh = lone + self.known.unknown(set().union(*(ps for _, ps in cut)))
        known.update(zip(fresh, self.encode_parts(fresh)))
        for w, ps in cut:
            if len(ps) > 1 or ps[0] != w:
                known[w] = b"".join(map(known.__getitem__, ps))
        for long in {c for c in chain(new, fresh) if len(c) > MAX_CHUNK}:
            extra[long] = known.pop(long)
        return extra

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.keeps_space:
            return self.encode_column(pa.array(texts, pa.large_string()))
        known = self.known.turn()
        cut = [self.chunks(t) for t in texts]
        found = [list(map(known.get, c)) for c in cut]
        holes = [[k for k, ids in enumerate(f) if ids is None] if None in f else () for f in found]
        extra = self._learn({c[k] for c, h in zip(cut, holes) for k in h})
        for c, f, h in zip(cut, found, holes):
            for k in h:
                f[k] = known[c[k]] if c[k] in known else extra[c[k]]
        return [b"".join(f) for f in found]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The same for texts (large strings) whose blanks belong to the ids."""
        if not len(texts):
            return []
        collects = gc.isenabled()
        gc.disable()  # the many small lists made here hold no cycles
        try:
            runs = pc.match_substring_regex(texts, _RUN)
            if not pc.any(runs).as_py():
                return self._gather(pc.split_pattern(texts, " "))
            # a blank after white space is no safe cut; the others leave their blank out
            cut = [_CUT.split(t) for t in texts.filter(runs).to_pylist()]
            cut = [[c[0], *(w[1:] for w in c[1:])] for c in cut]
            with_runs = iter(self._gather(pa.array(cut, pa.list_(pa.large_string()))))
            rest = texts.filter(pc.invert(runs))
            without = iter(self._gather(pc.split_pattern(rest, " ")) if len(rest) else [])
            return [next(with_runs if r else without) for r in runs.to_pylist()]
        finally:
            if collects:
                gc.enable()

    def _gather(self, cut: pa.ListArray) -> list[bytes]:
        """Ids of texts given as the words between the blanks where they are cut."""
        words, bounds = cut.flatten(), cut.offsets.to_numpy()
        every, first = words.dictionary_encode(), words.take(pa.array(bounds[:-1])).dictionary_encode()
        code = every.indices.to_numpy().copy()
        code[bounds[:-1]] = len(every.dictionary) + first.indices.to_numpy()
        # no blank comes before the first word of a text
        blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        chunks = pa.concat_arrays([pc.binary_join_element_wise(blank, every.dictionary, nothing), first.dictionary])
        table, size = self._tables(chunks)
        ends = np.cumsum(size[code])[bounds[1:] - 1].tolist()
        out = _ragged(table, size, code)
        return [out[a:z].tobytes() for a, z in zip([0, *ends], ends)]

    def _tables(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks one after the other, and how many each has.  Letters
        and the signs that end them are looked up apart, as ``parts`` cuts them."""
        head = pc.utf8_rtrim(chunks, characters=_SIGNS)
        last = pc.utf8_slice_codeunits(head, -1, 1 << 30)
        ended = pc.and_(pc.and_(pc.utf8_is_alpha(last), pc.less(last, pa.scalar(_LATIN, pa.large_string()))),
                        pc.and_(pc.not_equal(pc.binary_length(head), pc.binary_length(chunks)),
                                pc.invert(pc.match_substring(chunks, "\n"))))
        at = np.flatnonzero(ended.to_numpy(zero_copy_only=False))
        lone = pc.if_else(ended, head, chunks).dictionary_encode()
        signs: dict = {}
        tail = np.full(len(chunks), len(lone.dictionary))
        tail[at] += np.array([signs.setdefault(c[len(h):], len(signs) + 1) for c, h in
                              zip(_strings(chunks.take(pa.array(at))), _strings(head.take(pa.array(at))))], np.int64)
        ids = self._ids([*_strings(lone.dictionary), "", *signs])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        both = np.stack([lone.indices.to_numpy(), tail], axis=1)
        return _ragged(np.frombuffer(b"".join(ids), "<u4"), size, both.ravel()), size[both].sum(axis=1)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        known = self.known.turn()
        ids = list(map(known.get, chunks))
        holes = [k for k, i in enumerate(ids) if i is None]
        extra = self._learn([chunks[k] for k in holes])
        for k in holes:
            ids[k] = extra[chunks[k]] if chunks[k] in extra else known[chunks[k]]
        return ids


def _ragged(table: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The entries of ``table`` (so many of each code) for a sequence of codes."""
    start, out = np.cumsum(size) - size, []
    for at in range(0, len(code), GATHERED):
        c = code[at:at + GATHERED]
        n = size[c]
        stop = np.cumsum(n)
        out.append(table[np.arange(stop[-1]) + np.repeat(start[c] - stop + n, n)])
    return np.concatenate(out)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


_ENCODERS: dict = {}


def encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary (workers are reused)."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, keeps_space)
    return _ENCODERS[key]
