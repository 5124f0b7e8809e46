"""The piece table of a SentencePiece model, and how texts fall into chunks.

No piece holds the blank mark after another character, so the pieces of a text
are those of its chunks (blanks, then what follows up to the next blank) one after
the other; ``load`` checks that.  What the scores mean is the model type's:

BPE: ranks of the merges.  Of all neighbours that make a piece together, those of
the best score are merged, the leftmost of equals first, until none are left; the
sum of scores is not what is maximised.  A character that is no piece becomes the
pieces of its bytes.

Unigram: the best sum of scores.  Tie rule: nodes are filled by ascending start,
and only a strictly better score replaces, so of equal paths into a place the one
with the longest last piece wins, and an unknown character only where no piece is
as good.  Scores are added in double precision.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

BLANK = "▁"
#: An unknown character costs the lowest score and this much more (fixed value).
UNKNOWN_PENALTY = 10.0

#: Model types of the file format.
UNIGRAM, BPE = 1, 2
#: Up to so many characters the best merge is looked for in a list, else in a heap.
SHORT = 48

_CHUNK = re.compile(r" *[^ ]+| +$")


@dataclass
class Pieces:
    score: dict = field(default_factory=dict)    # piece -> score
    id: dict = field(default_factory=dict)       # piece -> id
    byte_id: dict = field(default_factory=dict)  # byte -> id
    unknown_id: int = 0
    unknown_score: float = 0.0
    longest: int = 1
    bpe: bool = False


def load(path: str) -> Pieces:
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as proto
    sp = spm.SentencePieceProcessor(model_file=path)
    kind = proto.ModelProto.FromString(sp.serialized_model_proto()).trainer_spec.model_type
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    out = Pieces(unknown_id=sp.unk_id(), bpe=kind == BPE)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            out.byte_id[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if BLANK in piece.lstrip(BLANK):
                raise ValueError(f"piece {piece!r} crosses a blank")
            out.score[piece], out.id[piece] = float(sp.get_score(i)), i
    out.unknown_score = min(out.score.values()) - UNKNOWN_PENALTY
    out.longest = max(map(len, out.score))
    return out


def chunks(text: str) -> list[str]:
    """The chunks of a text, blanks as blank marks, one put before the text;
    an empty text has none."""
    if not text:
        return []
    if BLANK in text:
        text = text.replace(BLANK, " ")
    if "  " in text or text[0] == " ":
        return [c.replace(" ", BLANK) for c in _CHUNK.findall(" " + text)]
    return [BLANK + w for w in text.split(" ")]


def merged(chunk: str, score: dict) -> list[str]:
    """The pieces of a chunk after all merges; characters that are no piece stay
    as they are."""
    if len(chunk) > SHORT:
        return _merged_long(chunk, score)
    low, get, parts = float("-inf"), score.get, list(chunk)
    gains = [get(a + b, low) for a, b in zip(parts, parts[1:])]
    while gains:
        best = max(gains)
        if best == low:
            break
        k = gains.index(best)
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
        del gains[k]
        if k:
            gains[k - 1] = get(parts[k - 1] + parts[k], low)
        if k < len(gains):
            gains[k] = get(parts[k] + parts[k + 1], low)
    return parts


def _merged_long(chunk: str, score: dict) -> list[str]:
    n = len(chunk)
    parts, before, after = list(chunk), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def meet(a, b):
        both = parts[a] + parts[b]
        s = score.get(both)
        if s is not None:
            heapq.heappush(heap, (-s, a, b, len(both)))

    for k in range(n - 1):
        meet(k, k + 1)
    while heap:
        _, a, b, size = heapq.heappop(heap)
        if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
            continue  # one of them was merged since
        parts[a] += parts[b]
        parts[b] = ""
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
            meet(a, after[a])
        if before[a] >= 0:
            meet(before[a], a)
    return [p for p in parts if p]
