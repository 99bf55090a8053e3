"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's encoding is a path through its lattice: places are nodes, pieces are steps, and the best sum of steps' weights wins.
In a unigram model a step weighs the piece's score (of paths of equal score the one that is found first).  In a BPE model an encoding is
what is left when adjacent symbols that form the piece of best rank (ties: the leftmost) are merged until no two form a piece.  That is
a path as well: pieces follow one another in an encoding exactly if merging the two of them alone leaves them as they are, for the first
merge across a border between neighbours would happen there too.  So a step weighs 0 if its piece may follow the last one and
minus infinity if not, one path of weight 0 is left, and the state at a place is the last piece.

A giant text is split into chunks of fixed length.  The states at a border are the pieces that end at it or reach across (for unigram models only
how far they reach).  Each chunk alone gives a transfer matrix: entry (a, b) is the best weight from state a at its
start to state b at its end.  Matrices combine in the max-plus algebra, which is associative: sixteen neighbours at a time give
the matrix of a longer stretch, until one covers the text.  On the way back down every stretch is told its first and last state and finds those at its inner borders,
and with its own two states each chunk is traced back independently.  A text of one chunk has no borders and goes through
the last step alone.

Where a run of spaces begins, no piece spans (in most vocabularies), so all paths meet there; between such places pieces of a word are looked up
in a table, and only the ends of a chunk, or a chunk without such places, go through the lattice.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, small_batches

SPACE = "\u2581"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, matrices that are combined at a time, and chunks that are cut from a longer slice of a text.
CHUNK, FAN, SLICE = 32_768, 16, 64
#: Words, and pairs of pieces, that a Python worker remembers (twice as many words at most).
REMEMBERED, REMEMBERED_PAIRS = 40_000, 50_000
#: Characters of the longest word that is remembered; words, and characters of texts, that are handled at a time.
SHORT, WORDS_AT_ONCE, CHARS_AT_ONCE = 24, 1 << 12, 1 << 19
#: Unknown characters cost this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
LOW = float("-inf")


@dataclass
class Vocabulary:
    """Pieces with ids and scores.  Small and of fixed size (checked when it is read)."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: dict[int, int]
    names: list[str]
    unknown_id: int
    #: Whether scores are ranks of merges (BPE).
    by_rank: bool = False
    remembered: dict[str, bytes] = field(default_factory=dict, repr=False)
    older: dict[str, bytes] = field(default_factory=dict, repr=False)
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict, repr=False)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def prefixes(self) -> dict[str, tuple[int, float] | None]:
        """Every beginning of a piece; None where it is no piece itself."""
        begins = {p[:n]: None for p in self.pieces for n in range(1, len(p))}
        return begins | self.pieces

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (left symbol << 32 | right symbol), the pieces that they form, and scores by piece id.  Symbols are pieces' ids."""
        ids = {p: i for p, (i, _) in self.pieces.items()} | self.loose
        keys, to = [], []
        for p, (i, _) in self.pieces.items():
            for n in range(1, len(p)):
                left, right = ids.get(p[:n]), ids.get(p[n:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    to.append(i)
        scores = np.full(len(self.names), LOW)
        for i, score in self.pieces.values():
            scores[i] = score
        order = np.argsort(keys)
        return np.array(keys, np.int64)[order], np.array(to, np.int64)[order], scores

    @cached_property
    def loose(self) -> dict[str, int]:
        """Numbers from len(names) on for characters that occur in pieces and are none."""
        chars = sorted({c for p in self.pieces for c in p}.difference(self.pieces))
        return {c: len(self.names) + n for n, c in enumerate(chars)}

    @cached_property
    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted code points of the characters of pieces, and their symbols."""
        found = sorted([(ord(p), i) for p, (i, _) in self.pieces.items() if len(p) == 1] + [(ord(c), i) for c, i in self.loose.items()])
        return np.array([c for c, _ in found], np.int64), np.array([i for _, i in found], np.int64)

    @cached_property
    def neighbours(self) -> np.ndarray:
        """Sorted pairs (first << 21 | second) of characters that are neighbours in some piece."""
        return np.array(sorted({ord(a) << 21 | ord(b) for p in self.pieces for a, b in zip(p, p[1:])}), np.int64)

    @cached_property
    def unknown_score(self) -> float:
        return min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def spaces_start_words(self) -> bool:
        """Whether no piece has a space after another character."""
        return not any(SPACE in p.lstrip(SPACE) for p in self.pieces)

    @cached_property
    def touching(self) -> frozenset[str]:
        return frozenset(x for p in self.pieces for x in map(str.__add__, p, p[1:]))

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "byte_ids": self.byte_ids, "names": self.names, "unknown_id": self.unknown_id, "by_rank": self.by_rank, "remembered": {}, "older": {}, "pairs": {}}

    def unknown(self, char: str) -> tuple[int, ...]:
        if not self.byte_ids:
            return (self.unknown_id,)
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))


def read_vocabulary(path: str = MODEL, most: int = 2_000_000) -> Vocabulary:
    """Reads a model file on the driver; more than `most` pieces are refused, since the vocabulary is broadcast.

    So are models whose ids would not come out as SentencePiece's: other kinds than unigram and BPE, other normalising than
    spaces to SPACE with one added in front, pieces that the user defined or that are not used, BPE without pieces for bytes.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n, kind, to = len(model.pieces), sentencepiece_model_pb2.ModelProto.SentencePiece, model.normalizer_spec
    if n > most:
        raise ValueError(f"{n} pieces; at most {most} are broadcast")
    by_rank = model.trainer_spec.model_type == model.trainer_spec.BPE
    byte_ids = {int(x.piece[3:5], 16): i for i, x in enumerate(model.pieces) if x.type == kind.BYTE}
    if not (by_rank or model.trainer_spec.model_type == model.trainer_spec.UNIGRAM):
        raise ValueError("neither a unigram nor a BPE model")
    if to.precompiled_charsmap or to.remove_extra_whitespaces or not (to.add_dummy_prefix and to.escape_whitespaces) or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model normalises texts in another way")
    if any(x.type in (kind.USER_DEFINED, kind.UNUSED) for x in model.pieces) or (by_rank and len(byte_ids) < 256):
        raise ValueError("the model has pieces that the user defined or that are not used, or is BPE without all bytes")
    usual = {x.piece: (i, x.score) for i, x in enumerate(model.pieces) if x.type == kind.NORMAL}
    unknown = next(i for i, x in enumerate(model.pieces) if x.type == kind.UNKNOWN)
    return Vocabulary(usual, byte_ids, [x.piece for x in model.pieces], unknown, by_rank)


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def steps(text: str, i: int, v: Vocabulary) -> list[tuple[int, float]]:
    """(length, weight) of the pieces that start at i; a character that is no piece is one as well."""
    out, find = [], v.prefixes.get
    for j in range(i + 1, min(i + v.longest, len(text)) + 1):
        hit = find(text[i:j], 0)
        if hit:
            out.append((j - i, 0.0 if v.by_rank else hit[1]))
        elif hit == 0:
            break
    if not out or out[0][0] > 1:
        out.insert(0, (1, 0.0 if v.by_rank else v.unknown_score))
    return out


def fits(before: str, piece: str, v: Vocabulary) -> bool:
    """Whether a piece may follow another one (nothing: whether it may stand at all)."""
    if not v.by_rank or (before and len(piece) == 1 and before[-1] + piece not in v.touching):
        return True
    known = v.pairs.get((before, piece))
    if known is None:
        if len(v.pairs) >= REMEMBERED_PAIRS:
            v.pairs.clear()
        ends = [len(before), len(before) + len(piece)] if before else [len(piece)]
        known = v.pairs[before, piece] = merged_ends(before + piece, v) == ends
    return known


def spread(text: str, states: dict, stop: int, v: Vocabulary, back: dict | None = None) -> dict:
    """Best weights of the states (place, length of the last piece) at or past stop that pieces starting before it reach.

    Weights are numbers or, for many starts at once, arrays.  Lengths are 0 where they don't matter.  back notes the state before, and the piece's length.
    """
    at: dict[int, dict] = {}
    for (p, last), x in states.items():
        at.setdefault(p, {})[last] = x
    for p in range(min(at, default=stop), stop):
        here = at.pop(p, None)
        for n, weight in steps(text, p, v) if here else ():
            piece, key = text[p : p + n], n if v.by_rank else 0
            for last, x in here.items():
                if fits(text[p - last : p], piece, v):
                    there, new = at.setdefault(p + n, {}), x + weight
                    old = there.get(key)
                    if back is None:
                        there[key] = new if old is None else np.maximum(old, new)
                    elif old is None or new > old:
                        there[key], back[p + n, key] = new, (p, last, n)
    return {(p, last): x for p, lasts in at.items() for last, x in lasts.items()}


def path_ids(text: str, state: tuple[int, int], back: dict, v: Vocabulary) -> list[int]:
    """Ids of the pieces that lead to a state."""
    parts = []
    while state in back:
        p, last, n = back[state]
        hit = v.pieces.get(text[p : p + n])
        parts.append((hit[0],) if hit else v.unknown(text[p : p + n]))
        state = p, last
    return [i for part in reversed(parts) for i in part]


def known_words(words: Collection[str], v: Vocabulary) -> Callable[[str], bytes]:
    """A function from each of the words, which stand between places where all paths meet, to its ids (int32)."""
    if len(v.remembered) >= REMEMBERED:  # words that come up again move to the new generation
        v.older, v.remembered = v.remembered, {}
    new, long = [], {}
    needed = set(words)
    split = {w: stretches(w, v) for w in needed if len(w) > SHORT} if v.by_rank else {}
    needed = needed.difference(split).union(*split.values())
    for w in needed.difference(v.remembered):
        if (got := v.older.get(w)) is not None:
            v.remembered[w] = got
        elif not v.by_rank:
            long[w] = scored_word(w, v)[1]
        elif len(w) <= SHORT:
            new.append(w)
        else:
            long[w] = merged_stretch(w, v)
    for at in range(0, len(new), WORDS_AT_ONCE):
        part = new[at : at + WORDS_AT_ONCE]
        v.remembered.update(zip(part, merged_words(part, v)))
    known = v.remembered
    for w, parts in split.items():
        long[w] = b"".join([long[x] if x in long else known[x] for x in parts])
    return (lambda w: long[w] if w in long else known[w]) if long else known.__getitem__


def scored_word(word: str, v: Vocabulary) -> tuple[float, bytes]:
    """Weight and ids of a word of a unigram model."""
    back: dict = {}
    ends = spread(word, {(0, 0): 0.0}, len(word), v, back)
    return ends.get((len(word), 0), 0.0), np.array(path_ids(word, (len(word), 0), back, v), np.int32).tobytes()


def cuts(text: str, v: Vocabulary) -> np.ndarray:
    """The places of a text that no merge crosses."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    pairs = points[:-1] << 21 | points[1:]
    known = v.neighbours
    if not len(known):
        return np.arange(1, len(points))
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] != pairs) + 1


def stretches(text: str, v: Vocabulary) -> list[str]:
    at = [0, *cuts(text, v).tolist(), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def merged_ends(text: str, v: Vocabulary) -> list[int]:
    """Where the pieces of a stretch of any length end: a heap of merges, best rank first, then leftmost."""
    size, find = len(text), v.pieces.get
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(-hit[1], i, i + 2) for i in range(size - 1) if (hit := find(text[i : i + 2]))]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        middle = end[i]
        if middle <= i or middle >= size or end[middle] != to:
            continue  # one side has been merged otherwise
        end[i], end[middle] = to, -1
        if to < size:
            before[to] = i
            if hit := find(text[i : end[to]]):
                heapq.heappush(heap, (-hit[1], i, end[to]))
        if i and (hit := find(text[before[i] : to])):
            heapq.heappush(heap, (-hit[1], before[i], to))
    out, i = [], 0
    while i < size:
        i = end[i]
        out.append(i)
    return out


def merged_stretch(text: str, v: Vocabulary) -> bytes:
    """Ids (int32) of one stretch."""
    out, i = [], 0
    for end in merged_ends(text, v):
        hit = v.pieces.get(text[i:end])
        out += (hit[0],) if hit else v.unknown(text[i:end])
        i = end
    return np.array(out, np.int32).tobytes()


def merged_words(words: list[str], v: Vocabulary) -> list[bytes]:
    """Ids (int32) of each word: in each round every word merges its pair of best rank, for all words together."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(w) for w in words], np.int64)
    word, at = np.repeat(np.arange(len(words)), size), np.arange(len(points))
    chars, numbers = v.characters
    keys, formed, scores = v.merges
    k = np.minimum(np.searchsorted(chars, points), len(chars) - 1)
    symbol = np.where(chars[k] == points, numbers[k], -1) if len(chars) else np.full(len(points), -1)
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(i: np.ndarray) -> np.ndarray:
        """The pieces that the symbols at i form with the next ones, -1 for none."""
        j = np.minimum(i + 1, len(symbol) - 1)
        key = np.where((i < j) & (word[i] == word[j]) & (symbol[i] >= 0) & (symbol[j] >= 0), symbol[i] << 32 | symbol[j], -1)
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[k] == key, formed[k], -1)

    piece = pairs(np.arange(len(symbol))) if len(keys) else np.full(len(symbol), -1)
    while len(symbol):
        rank = np.where(piece >= 0, scores[piece], LOW)
        begin = np.append(True, word[1:] != word[:-1])
        part = np.cumsum(begin) - 1
        best = np.maximum.reduceat(rank, np.flatnonzero(begin))[part]
        over = best == LOW
        done.append((at[over], symbol[over]))
        won = np.flatnonzero(~over & (rank == best))
        won = won[np.append(True, part[won][1:] != part[won][:-1])] if len(won) else won  # the leftmost of each word
        symbol[won] = piece[won]
        changed, stays = np.zeros(len(symbol), bool), ~over
        changed[won], stays[won + 1] = True, False
        changed[np.maximum(won - 1, 0)] = True
        symbol, word, at, piece, changed = symbol[stays], word[stays], at[stays], piece[stays], np.flatnonzero(changed[stays])
        if len(changed):
            piece[changed] = pairs(changed)
    at, symbol = (np.concatenate(x) for x in zip(*done)) if done else (at, symbol)
    order = np.argsort(at)
    at, symbol = at[order], symbol[order]
    home = np.repeat(np.arange(len(words)), size)[at]
    last = np.cumsum(np.bincount(home, minlength=len(words))).tolist()
    strange = set(home[(symbol < 0) | (symbol >= len(v.names))].tolist())
    raw, out, first, text = symbol.astype(np.int32).tobytes(), [], 0, "".join(words)
    for w, to in enumerate(last):
        mine = raw[4 * first : 4 * to]
        if w in strange:
            parts = zip(symbol[first:to].tolist(), at[first:to].tolist())
            mine = np.array([x for i, c in parts for x in ((i,) if 0 <= i < len(v.names) else v.unknown(text[c]))], np.int32).tobytes()
        out.append(mine)
        first = to
    return out


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MEETING = re.compile(f"(?<=[^{SPACE}]){SPACE}")


@dataclass(frozen=True)
class Chunk:
    """text[left : left + n] with what pieces can reach on both sides; k of m chunks of a text."""

    text: str
    left: int
    n: int
    k: int = 0
    m: int = 1

    def middle(self, v: Vocabulary) -> tuple[int, int] | None:
        """The first and last place of the chunk where all paths meet, a text's own ends included; None without any."""
        a, z = self.left, self.left + self.n
        first, last = a if self.k == 0 else None, z if self.k == self.m - 1 else None
        if v.spaces_start_words and first is None and (found := _MEETING.search(self.text, a, z)):
            first = found.start()
        if first is None:
            return None
        if last is None:
            last = first
            if v.spaces_start_words:
                last = z - 1
                while last > first and not (self.text[last] == SPACE and self.text[last - 1] != SPACE):
                    last -= 1
        return first, last

    def words(self, span: tuple[int, int], v: Vocabulary) -> list[str]:
        return _WORDS.findall(self.text[span[0] : span[1]]) if v.spaces_start_words else [self.text[span[0] : span[1]]] * (span[1] > span[0])

    def entries(self, v: Vocabulary) -> dict[int, tuple[int, int]]:
        """Numbers of the states at the chunk's start, and their place and length of the last piece in text."""
        if self.k == 0:
            return {0: (self.left, 0)}
        out, size = {}, v.longest + 1
        for b in range(min(v.longest, len(self.text) - self.left + 1)):
            if not v.by_rank:
                out[b * size] = (self.left + b, 0)
                continue
            to = self.left + b
            for last in range(b + 1, min(v.longest, to) + 1):
                piece = self.text[to - last : to]
                if (last == 1 or piece in v.pieces) and fits("", piece, v):
                    out[b * size + last] = (to, last)
        return out

    def number(self, state: tuple[int, int], v: Vocabulary) -> int:
        return (state[0] - self.left - self.n) * (v.longest + 1) + state[1]


def transfer_matrix(chunk: Chunk, v: Vocabulary) -> tuple[list[int], list[int], np.ndarray]:
    """Numbers of the states at the chunk's start and end, and the best weights between them."""
    entries = chunk.entries(v)
    ins, end, span = list(entries), chunk.left + chunk.n, chunk.middle(v)
    start = {state: np.where(np.arange(len(ins)) == i, 0.0, LOW) for i, state in enumerate(entries.values())}
    if span is None:
        ends = spread(chunk.text, start, end, v)
        outs = {chunk.number(state, v): x for state, x in ends.items()}
        return ins, list(outs), np.stack(list(outs.values()), 1) if outs else np.empty((len(ins), 0))
    first, last = span
    head = spread(chunk.text, start, first, v)
    met = [x for (p, _), x in head.items() if p == first]
    head = np.max(met, 0) if met else np.full(len(ins), LOW)
    if not v.by_rank:
        head = head + sum(scored_word(w, v)[0] for w in chunk.words(span, v))
    tail = spread(chunk.text, {(last, 0): 0.0}, end, v, {}) if last < end else {(end, 0): 0.0}
    outs = {chunk.number(state, v): x for state, x in tail.items()}
    return ins, list(outs), head[:, None] + np.array(list(outs.values()))


def chunk_ids(chunks: list[Chunk], ways: list[tuple[int, int]], v: Vocabulary) -> Iterator[np.ndarray]:
    """Ids (int32) of the pieces that start in each chunk, given the states at its start and end; all words are looked up together."""
    spans = [c.middle(v) for c in chunks]
    words = [c.words(s, v) if s else [] for c, s in zip(chunks, spans)]
    lookup = known_words(set().union(*words), v)
    for chunk, span, inner, (into, out) in zip(chunks, spans, words, ways):
        if chunk.m == 1:
            yield np.frombuffer(b"".join(map(lookup, inner)), np.int32)
            continue
        size, end = v.longest + 1, chunk.left + chunk.n
        start = chunk.left + into // size, into % size
        goal = end + out // size, out % size
        if span is None:
            back: dict = {}
            spread(chunk.text, {start: 0.0}, end, v, back)
            yield np.array(path_ids(chunk.text, goal, back, v), np.int32)
            continue
        first, last = span
        back, rest = {}, {}
        met = [(x, state) for state, x in spread(chunk.text, {start: 0.0}, first, v, back).items() if state[0] == first]
        head = path_ids(chunk.text, max(met, key=lambda x: x[0])[1], back, v)
        if last < end:
            spread(chunk.text, {(last, 0): 0.0}, end, v, rest)
        tail = path_ids(chunk.text, goal, rest, v)
        yield np.concatenate([np.array(head, np.int32), np.frombuffer(b"".join(map(lookup, inner)), np.int32), np.array(tail, np.int32)])


def encode_texts(texts: list[str | None], v: Vocabulary) -> Iterator[np.ndarray | None]:
    """Ids of whole texts of one chunk each; None for None."""
    first = 0
    while first < len(texts):
        to, chars = first, 0
        while to < len(texts) and (to == first or chars + len(texts[to] or "") <= CHARS_AT_ONCE):
            chars += len(texts[to] or "")
            to += 1
        full = [normalise(t or "") for t in texts[first:to]]
        ids = chunk_ids([Chunk(t, 0, len(t)) for t in full], [(0, 0)] * len(full), v)
        yield from (None if t is None else i for t, i in zip(texts[first:to], ids))
        first = to


def encode_text(text: str, v: Vocabulary) -> list[int]:
    """Ids of a whole text, in one chunk."""
    return next(encode_texts([text], v)).tolist()


Matrix = tuple[list[int], list[int], np.ndarray]


def _joined(left: Matrix, right: Matrix) -> np.ndarray:
    """Weights of left (start, state between) and right (state between, end) for all three."""
    place = {state: i for i, state in enumerate(right[0])}
    both = [(i, place[state]) for i, state in enumerate(left[1]) if state in place]
    a, b = [i for i, _ in both], [j for _, j in both]
    return left[2][:, a, None] + right[2][None, b]


def product(matrices: list[Matrix]) -> Matrix:
    """The max-plus product of neighbours' matrices."""
    out = matrices[0]
    for m in matrices[1:]:
        out = out[0], m[1], _joined(out, m).max(1, initial=LOW)
    return out


def route(matrices: list[Matrix], into: int, out: int | None) -> list[tuple[int, int]]:
    """(state at its start, state at its end) of each of the neighbours on the best way from state `into` to `out` (None: to the best)."""
    best, origin = {into: 0.0}, []
    for ins, outs, weights in matrices:
        known = [(i, best[s]) for i, s in enumerate(ins) if s in best]
        rows = np.array([w for _, w in known])[:, None] + weights[[i for i, _ in known]]
        top = rows.argmax(0)
        origin.append({s: ins[known[t][0]] for s, t, x in zip(outs, top, rows.max(0)) if x > LOW})
        best = {s: x for s, x in zip(outs, rows.max(0)) if x > LOW}
    state, ways = max(best, key=best.__getitem__) if out is None else out, []
    for step in reversed(origin):
        ways.append((step[state], state))
        state = step[state]
    return ways[::-1]


MATRIX = "ins:array<int>,outs:array<int>,weights:array<double>"


def _matrix(x) -> Matrix:
    ins, outs = list(x["ins"]), list(x["outs"])
    return ins, outs, np.reshape(np.asarray(x["weights"], np.float64), (len(ins), len(outs)))


def _plain(m: Matrix) -> dict:
    """A matrix without the states that no path uses."""
    some, other = np.flatnonzero((m[2] > LOW).any(1)), np.flatnonzero((m[2] > LOW).any(0))
    return {"ins": [m[0][i] for i in some], "outs": [m[1][i] for i in other], "weights": m[2][np.ix_(some, other)].ravel()}


def _cut(rows: DataFrame, text: str, chunk: int, reach: int) -> DataFrame:
    """rows(row, `text`) as chunks (row, k, m, left, n, part): first slices of many chunks, then these, so a long text is copied twice only."""

    def spans(length: Column, size: int) -> Column:
        return F.sequence(F.lit(0), F.call_function("div", length - 1, F.lit(size)).cast("int"))

    wide = SLICE * chunk
    whole = rows.where(F.length(text) > 0).select("row", F.concat(F.lit(SPACE), F.replace(F.col(text), F.lit(" "), F.lit(SPACE))).alias("whole"))
    whole = whole.select("row", "whole", F.length("whole").alias("size")).select("row", "whole", "size", F.explode(spans(F.col("size"), wide)).alias("s"))
    before = F.least(F.lit(reach), F.col("s") * wide)
    slices = whole.select(
        "row", "size", "s", before.alias("before"), F.least(F.lit(wide), F.col("size") - F.col("s") * wide).alias("wide"),
        F.substring("whole", F.col("s") * wide - before + 1, before + wide + reach).alias("slice"),
    )
    parts = slices.select("*", F.explode(spans(F.col("wide"), chunk)).alias("j")).withColumn("k", F.col("s") * SLICE + F.col("j"))
    left = F.least(F.lit(reach), F.col("k") * chunk)
    return parts.select(
        "row", "k", F.ceil(F.col("size") / chunk).cast("int").alias("m"), left.alias("left"), F.least(F.lit(chunk), F.col("wide") - F.col("j") * chunk).alias("n"),
        F.substring("slice", F.col("before") + F.col("j") * chunk - left + 1, left + chunk + reach).alias("part"),
    )


def _scanned(rows: DataFrame, shared, chunk: int, reach: int) -> DataFrame:
    """(row, ids) of rows(row, text)."""

    @F.pandas_udf(f"struct<{MATRIX}>")
    def matrix(part: pd.Series, left: pd.Series, n: pd.Series, k: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_plain(transfer_matrix(Chunk(*c), shared.value)) for c in zip(part, left, n, k, m)], columns=["ins", "outs", "weights"])

    @F.pandas_udf(f"struct<{MATRIX}>")
    def combined(groups: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_plain(product([_matrix(x) for x in g])) for g in groups], columns=["ins", "outs", "weights"])

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def routed(groups: pd.Series, into: pd.Series, out: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in route([_matrix(x) for x in g], a, None if b < 0 else b)] for g, a, b in zip(groups, into, out)])

    @F.pandas_udf("array<int>")
    def traced(part: pd.Series, left: pd.Series, n: pd.Series, k: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(chunk_ids([Chunk(*c) for c in zip(part, left, n, k, m)], list(zip(a, b)), shared.value)), dtype=object)

    parts = materialise(_cut(rows, "text", chunk, reach).repartition("row", "k"))
    most = parts.agg(F.max("m")).first()[0] or 1
    level, groups = parts.select("row", "k", matrix("part", "left", "n", "k", "m").alias("x")), []
    for _ in range(max(1, math.ceil(math.log(most, FAN) - 1e-9))):
        node = F.call_function("div", F.col("k"), F.lit(FAN)).cast("int")
        some = level.groupBy("row", node.alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("xs"))
        groups.append(materialise(some.select("row", "k", F.col("xs.x").alias("xs"))))
        level = groups[-1].select("row", "k", combined("xs").alias("x"))
    ways = groups[-1].select("row", "k", F.lit(0).alias("a"), F.lit(-1).alias("b"))
    for some in reversed(groups):
        inner = some.join(ways, ["row", "k"]).select("row", F.col("k").alias("up"), F.posexplode(routed("xs", "a", "b")).alias("j", "way"))
        ways = inner.select("row", (F.col("up") * FAN + F.col("j")).alias("k"), "way.a", "way.b")
    ids = parts.join(ways, ["row", "k"]).select("row", "k", traced("part", "left", "n", "k", "m", "a", "b").alias("ids"))
    return ids.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("c")).select("row", F.flatten(F.col("c.ids")).alias("ids"))


def encode(docs: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text", to: str = "piece_ids", chunk: int = CHUNK) -> DataFrame:
    """docs with `to`: array<int>, the ids of the whole text; a column of that name is replaced.

    A null text gives null, an empty one an empty array.  Repeated rows are encoded alike.  Texts of one chunk are
    encoded where they are; longer ones are split, and their chunks spread over the cluster.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def short(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encode_texts([None if t is None else t for t in texts], shared.value)), dtype=object)

    is_long = F.coalesce(F.length(text_col) >= chunk, F.lit(False))
    near = docs.where(~is_long).withColumn(to, short(F.col(text_col)))
    row = fresh(docs, "piece_row")
    far = materialise(docs.where(is_long).withColumn(row, F.monotonically_increasing_id()))
    found = _scanned(far.select(F.col(row).alias("row"), F.col(text_col).alias("text")), shared, chunk, vocabulary.longest)
    kept = [c for c in docs.columns if c != to]
    joined = far.join(found.select(F.col("row").alias(row), F.col("ids").alias(fresh(far, "piece_ids_found"))), row)
    joined = joined.select(*kept, F.col(joined.columns[-1]).alias(to))
    return near.select(*kept, to).unionByName(joined)


def decode(docs: DataFrame, vocabulary: Vocabulary, *, ids_col: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """docs with the text of each row's ids, as built-in expressions; null ids give null, no ids an empty text.

    Bytes join to characters (invalid ones become U+FFFD), spaces come back, the added first one goes.  A null among the ids counts as
    nothing, and an id that the vocabulary lacks raises an error.
    """
    raw = [name.replace(SPACE, " ").encode("utf-8", "surrogatepass") for name in vocabulary.names]
    for byte, i in vocabulary.byte_ids.items():
        raw[i] = bytes([byte])
    table = F.split(F.lit(",".join(r.hex() for r in raw)), ",")
    ids = F.filter(ids_col, lambda i: i.isNotNull())
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")).cast("string"))
    return docs.withColumn(to, text).withColumn(to, F.when(F.startswith(to, F.lit(" ")), F.substring(to, F.lit(2), F.length(to))).otherwise(F.col(to)))
