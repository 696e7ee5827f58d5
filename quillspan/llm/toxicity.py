"""Toxicity of disguised text: noisy-channel decoding, then a score of the restored text.

The source model is a character language model (order 4, within words) counted
over every document, accents folded. The channel writes letters as look-alike
symbols, puts separators or blanks between them and repeats them. What looks like
its work is gated by shape and by the model, never by a word list:

* a token with a letter and, within it, marks, digits, look-alikes, letters of
  another script or one letter three times in a row;
* a doubled letter that the model would rather do without (``COST_REPEAT``);
* successive tokens of one character each, with any white space between them, and
  disguised tokens with short ones beside them;
* two words that the model would rather have as one, by more than ``COST_BLANK``.

Each such stretch becomes a lattice of possible letters, deletions and word ends;
the exact Viterbi path (states: the last letters; no state is dropped) is the
restored text. The rest of a text restores to itself. A document's words are its
words as they stand and those of its restored stretches.

The score is a classifier's over the distinct restored words. Its features are word
parts, that is whole words and word beginnings, as they stand and without accents.
From the labelled documents, of which near copies count once, comes each part's rate
among toxic and among clean words; a part is used if ``FAMILIES`` unrelated toxic
documents have it, its rate is ``LIFT`` times the clean one and that is no chance
among all parts tried (``CHANCE``), and of nested parts the one that says most. A
document's log-odds are the prior's, those of the rates for each word with a part,
less what so many words should have had if they were toxic (counts are taken as
Poisson). The threshold is the one that does best on held-out halves of the labels,
and a document is toxic from score 0.5, the threshold, on.

The classifier is fitted on at most ``SAMPLE`` labelled documents, the first by
hash; the language model counts all documents and every text is scored whole.
The channel has three bounds that define it: a character repeated more than three
times says what three say, over ``MARKS`` characters in a row that aren't letters
part words, and over ``EDGING`` marks at a token's edge are decoration.

Defined results: null and empty texts score 0 and aren't toxic, as all texts without
a word part that weighs; without labels, or with labels of one kind, every score is
0; equal texts score the same and repeated rows come back each; an empty table gives
an empty result; a null ``doc_id`` is kept; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import mixing, shared, textbuf

SAMPLE = 6000
#: A word part stands in so many unrelated toxic documents at least, is so many times as frequent there, and is so unlikely to be by chance.
FAMILIES, LIFT, CHANCE = 3, 5.0, 0.05
#: Lengths of word beginnings that may weigh.
SHORTEST, LONGEST = 3, 8
SYMBOLS = 32
EDGE, OTHER, DIGIT = 0, 27, 28
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "&": "a", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiouh", "%": "o"}
#: Letters of other scripts that look like Latin ones.
_FOREIGN = dict(zip("асеорхуікмтнвѕјԁӏαβεικνορτυχω", "aceopxyikmthbsjdlabeiknoptuxw", strict=True))
PAIRS = {"()": "o", "[]": "o", "vv": "w", "|<": "k", "|)": "d", "|-|": "h", "\\/": "v", "/\\": "a", "|\\|": "n", "\\/\\/": "w", "uu": "w"}
SEPARATORS = frozenset("\r.-_*~'`,^=:/ ​‌‍﻿·•")
#: Costs of the channel, in nats. A blank between single characters is a way of spacing; elsewhere it mostly ends a word.
COST_LOOKALIKE, COST_PAIR, COST_DROP, COST_REPEAT, COST_KEEP = 0.7, 1.2, 0.3, 2.0, 2.0
COST_SPACED, COST_BLANK = 1.0, 4.0
#: Characters in a row that aren't letters and still belong to a word; at a token's edge more than so many are decoration.
MARKS, EDGING = 6, 2

_ASCII = np.zeros(128, np.uint8)
_ASCII[97:123] = np.arange(1, 27)
_ASCII[65:91] = np.arange(1, 27)
_ASCII[48:58] = DIGIT


@lru_cache(1 << 16)
def _plain(c: str) -> str:
    """A letter without its accents, in lower case."""
    return unicodedata.normalize("NFKD", c)[0].lower()


def symbol(letter: str) -> int:
    """0 for a word's edge, 1 to 26 for a to z, 27 for other letters, 28 for digits."""
    if "a" <= letter <= "z":
        return ord(letter) - 96
    return DIGIT if letter.isdigit() else OTHER if letter.isalpha() or letter == "~" else EDGE


_LATIN = np.array([symbol(_plain(chr(0xC0 + (k & 0x3F)))) for k in range(256)], np.uint8)
_STRONG = np.zeros(256, bool)
_STRONG[[ord(c) for c in "@$|+&*#%"]] = True
_STRONG[[0xE2, 0xC2]] = True
_OPENING = _STRONG.copy()
_OPENING[[ord(c) for c in "(<{[!"]] = True
_SCRIPT = np.zeros(256, bool)
_SCRIPT[[0xCE, 0xCF, 0xD0, 0xD1, 0xD3, 0xD4, 0xEF]] = True


@dataclass
class Characters:
    """The characters of a chunk of texts: symbol, first byte, place of that byte; ``rows``: first character of each text (rows + 1)."""

    symbol: np.ndarray
    lead: np.ndarray
    at: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, offsets: np.ndarray, data: np.ndarray) -> Characters:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        s = np.where(lead < 128, _ASCII[lead & 0x7F], np.uint8(OTHER))
        s[(lead == 0xC2) | (lead == 0xE2)] = EDGE  # marks, currency and such
        latin = np.flatnonzero(lead == 0xC3)
        s[latin] = _LATIN[data[np.minimum(at[latin] + 1, len(data) - 1)]]
        return cls(s, lead, at, np.searchsorted(at, offsets))


def codes(s: np.ndarray) -> np.ndarray:
    """Code of the four symbols that end at each position; what lies before the word's start counts as edge."""
    s = s.astype(np.int64)
    pad = np.concatenate([np.zeros(3, np.int64), s])
    a = pad[2:-1]
    b = np.where(a == EDGE, EDGE, pad[1:-2])
    c = np.where(b == EDGE, EDGE, pad[:-3])
    return ((c * SYMBOLS + b) * SYMBOLS + a) * SYMBOLS + s


def grams(data: np.ndarray) -> np.ndarray:
    """Codes of all positions in a word and just after one."""
    s = Characters.of(np.array([0, len(data)]), data).symbol
    before = np.concatenate([[EDGE], s[:-1]])
    return codes(s)[(s != EDGE) | (before != EDGE)]


def count_grams(docs: DataFrame) -> np.ndarray:
    """Counts of all four-symbol codes over every document; tasks send what they found, cut in 32 ranges that merge apart."""
    ranges = 32
    width = SYMBOLS**4 // ranges

    def run(batches):
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(0))
            for _, _, _, part in textbuf.chunks(offsets, data):
                total += np.bincount(grams(np.append(part, 10).astype(np.uint8)), minlength=len(total))
        found = np.flatnonzero(total)
        for k in range(ranges):
            mine = found[(found >= k * width) & (found < (k + 1) * width)]
            if len(mine):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([mine.astype(np.uint32).tobytes()], pa.binary()), pa.array([total[mine].tobytes()], pa.binary())], ["part", "codes", "counts"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(SYMBOLS**4, np.int64)
        for found, n in zip(group["codes"].to_pylist(), group["counts"].to_pylist(), strict=True):
            total[np.frombuffer(found, np.uint32)] += np.frombuffer(n, np.int64)
        found = np.flatnonzero(total)
        return pa.table({"codes": pa.array([found.astype(np.uint32).tobytes()], pa.binary()), "counts": pa.array([total[found].tobytes()], pa.binary())})

    # Between texts lies a line end, as texts of a chunk follow each other without one.
    lines = docs.where(F.col("text").isNotNull()).select(F.concat("text", F.lit("\n")).alias("text"))
    out = np.zeros(SYMBOLS**4, np.int64)
    for row in lines.mapInArrow(run, "part int, codes binary, counts binary").groupBy("part").applyInArrow(merge, "codes binary, counts binary").toLocalIterator():
        out[np.frombuffer(row["codes"], np.uint32)] += np.frombuffer(row["counts"], np.int64)
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative logs) of the last symbol of each code: orders one to four interpolated by Witten and Bell's rule."""
    n4 = counts.reshape(-1, SYMBOLS).astype(np.float64)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in (1, 2, 3, 4):
        n = n4.reshape(-1, SYMBOLS ** (order - 1), SYMBOLS).sum(axis=0)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (len(n) // max(1, p.reshape(-1, SYMBOLS).shape[0]), 1)) if order > 1 else p[None]
        p = (n + kinds * lower) / np.maximum(total + kinds, 1)
        p = np.where(total > 0, p, lower)
    return (-np.log(np.maximum(p, 1e-12))).astype(np.float32).ravel()


def edges(text: str, i: int, last: str) -> list[tuple[int, str | None, float]]:
    """What the channel may have made of the characters at ``i`` after the letter ``last``: width, letter (None: nothing written,
    a blank: a word's end) and cost."""
    c = text[i]
    out: list[tuple[int, str | None, float]] = []
    if c.isalpha():
        readings = {c: 0.0} | ({_FOREIGN[c]: COST_LOOKALIKE} if c in _FOREIGN else {})
    else:
        readings = dict.fromkeys(LOOKALIKES.get(c, ""), COST_LOOKALIKE) | ({c: COST_KEEP} if c.isdigit() else {})
    for letter, cost in readings.items():
        out.append((1, letter, cost))
        if letter == last:
            out.append((1, None, cost + COST_REPEAT))
    if c.isspace():
        single = (i < 2 or text[i - 2].isspace()) and (i + 2 >= len(text) or text[i + 2].isspace())
        out += [(1, " ", 0.0), (1, None, COST_SPACED if single else COST_BLANK)]
    elif not c.isalnum():
        out.append((1, " ", COST_KEEP))
        if c in SEPARATORS:
            out.append((1, None, COST_DROP))
        elif not last:
            out.append((1, None, COST_DROP))
    for width in (2, 3, 4):
        for letter in PAIRS.get(text[i : i + width], "") if i + width <= len(text) else "":
            out.append((width, letter, COST_PAIR))
    return out


def prepared(stretch: str) -> str:
    """Lower case without accents, one blank for each run of white space, at most three of a character in a row."""
    folded = stretch.lower()
    if not folded.isascii():
        folded = "".join(map(_plain, folded))
    return _SAME_APART.sub(r"\1 \1 \1", _SAME.sub(r"\1\1\1", " ".join(folded.split())))


def decode(stretch: str, costs) -> str:
    """The cheapest restoration of ``stretch``: lower-case letters (``~`` for letters beyond a to z), words apart by blanks."""
    text = prepared(stretch)
    n = len(text)
    # at[i]: state (last three symbols, last letter) -> cost, end of the path so far
    at: list[dict[tuple[int, str], tuple[float, tuple]]] = [{} for _ in range(n + 1)]
    at[0][(0, "")] = (0.0, ())
    for i in range(n):
        c, after = text[i], at[i + 1]
        if "a" <= c <= "z" and text[i : i + 2] not in PAIRS:  # one reading: the moves of ``edges`` in short
            s = ord(c) - 96
            for state, (cost, path) in at[i].items():
                code = state[0] * SYMBOLS + s
                total = cost + costs[code]
                key = (code % SYMBOLS**3, c)
                old = after.get(key)
                if old is None or total < old[0]:
                    after[key] = (total, (path, c))
                if c == state[1]:
                    old = after.get(state)
                    if old is None or cost + COST_REPEAT < old[0]:
                        after[state] = (cost + COST_REPEAT, path)
            at[i] = {}
            continue
        known: dict[str, list] = {}
        for (history, last), (cost, path) in at[i].items():
            moves = known.get(last)
            if moves is None:
                moves = known[last] = edges(text, i, last)
            for width, letter, more in moves:
                if letter is None:
                    state, total, way = (history, last), cost + more, path
                else:
                    s = symbol(letter)
                    if s == EDGE and not history % SYMBOLS:
                        state, total, way = (0, ""), cost + more, path  # an edge beside another says nothing
                    else:
                        code = history * SYMBOLS + s
                        state, total, way = ((0, "") if s == EDGE else (code % SYMBOLS**3, letter)), cost + more + costs[code], (path, letter)
                old = at[i + width].get(state)
                if old is None or total < old[0]:
                    at[i + width][state] = (total, way)
        at[i] = {}
    best, path = np.inf, ()
    for (history, _), (cost, p) in at[n].items():
        ended = cost + (costs[history * SYMBOLS + EDGE] if history % SYMBOLS else 0)
        if ended < best:
            best, path = ended, p
    out = []
    while path:
        path, letter = path
        out.append("~" if letter.isalpha() and not "a" <= letter <= "z" else letter)
    return "".join(reversed(out)).strip()


_SAME = re.compile(r"(.)\1{3,}", re.S)
_SAME_APART = re.compile(r"(?<!\S)(\S)(?: \1(?!\S)){3,}")
_APART = re.compile(rf"(?:(?!\s)[\W\d_]){{{MARKS + 1},}}")


def _between(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return total[hi] - total[lo]


def _sums(mark: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(mark)])


class Restorer:
    """Restored words of whole texts."""

    def __init__(self, costs: np.ndarray, kept: int = 200_000):
        self.costs, self.kept = costs, kept
        self.quick = costs.tolist()  # single numbers come faster from a list
        self.seen: dict[str, frozenset[str]] = {}

    def restored(self, stretch: str) -> frozenset[str]:
        """Words of a disguised stretch; answers are kept, as stretches recur."""
        got = self.seen.get(stretch)
        if got is None:
            if len(self.seen) >= self.kept:
                self.seen.clear()
            got = self.seen[stretch] = frozenset(w for piece in _APART.split(stretch) for w in decode(piece, self.quick).split())
        return got

    def _joins(self, s: np.ndarray, left: np.ndarray, start: np.ndarray, right: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How much cheaper the model finds two words (``start`` to ``left``, ``right`` to ``end``, ends excluded) as one."""
        s = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
        back = [np.where(left - 1 - k >= start, s[left - 1 - k], EDGE) for k in range(3)]
        ahead = [np.where(right + k < end, s[right + k], EDGE) for k in range(3)]
        c = self.costs

        def path(history: list[np.ndarray]) -> np.ndarray:
            total, over = np.zeros(len(left)), np.zeros(len(left), bool)
            h2, h1, h0 = history
            for x in ahead:  # until the next word ends, or the words before no longer matter
                cost = c[((h2 * SYMBOLS + h1) * SYMBOLS + h0) * SYMBOLS + x]
                total += np.where(over, 0, cost)
                over |= x == EDGE
                h2, h1, h0 = h1, h0, x
            return total

        none = np.zeros(len(left), np.int64)
        apart = c[((back[2] * SYMBOLS + back[1]) * SYMBOLS + back[0]) * SYMBOLS] + path([none, none, none])
        return apart - path([back[2], back[1], back[0]])

    def stretches(self, chars: Characters) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of what looks disguised."""
        s, lead = chars.symbol, chars.lead
        n = len(s)
        none = np.zeros(0, np.int64)
        blank = (lead <= 32) | (lead == 0x7F)
        solid = ~blank
        bound = np.zeros(n + 1, bool)
        bound[chars.rows] = True
        starts = np.flatnonzero(solid & (bound[:-1] | np.concatenate([[True], blank[:-1]]))) if n else none
        if not len(starts):
            return none, none
        ends = np.flatnonzero(solid & (bound[1:] | np.concatenate([blank[1:], [True]]))) + 1
        size = ends - starts
        letter = (s > EDGE) & (s <= OTHER)
        sound = np.flatnonzero(s > EDGE)
        letters, digits, sounds = _sums(letter), _sums(s == DIGIT), _sums(s > EDGE)
        has = _between(sounds, starts, ends) > 0
        sound = np.append(sound, n)
        first = np.where(has, sound[sounds[starts]], ends)
        last = np.where(has, sound[np.maximum(sounds[ends] - 1, 0)] + 1, starts)
        inner = np.where(has, (last - first) - _between(sounds, first, np.maximum(first, last)), 0)
        strong, opening, script, basic = _sums(_STRONG[lead]), _sums(_OPENING[lead]), _sums(_SCRIPT[lead]), _sums(letter & (lead < 128))
        front, back = np.where(has, _between(opening, starts, first), 0), np.where(has, _between(strong, np.maximum(first, last), ends), 0)
        edged = (front > 0) & (front <= EDGING) | (back > 0) & (back <= EDGING)
        again = np.zeros(n, bool)
        if n > 2:
            again[2:] = letter[2:] & (s[2:] == s[1:-1]) & (s[1:-1] == s[:-2])
        again |= self._doubles(s)
        marked = (_between(letters, starts, ends) > 0) & ((inner > 0) | (_between(digits, starts, ends) > 0) | edged | (_between(script, starts, ends) > 0) & (_between(basic, starts, ends) > 0))
        odd = marked | (_between(_sums(again), starts, ends) > 0)
        # Gaps between successive tokens of one text.
        row = np.searchsorted(chars.rows, starts, "right")
        same = row[1:] == row[:-1]
        single = (size <= 2) & (_between(sounds, starts, ends) <= 1)
        short = size <= 2
        plain = (inner == 0) & (_between(letters, starts, ends) > 0) & (_between(digits, starts, ends) == 0)
        meet = np.flatnonzero(same & plain[:-1] & plain[1:] & (last[:-1] == ends[:-1]) & (first[1:] == starts[1:]))
        opens = same & ((single[:-1] & single[1:]) | (marked[:-1] & marked[1:]) | (odd[:-1] & short[1:]) | (odd[1:] & short[:-1]))
        opens[meet] |= self._joins(s, last[meet], first[meet], first[meet + 1], last[meet + 1]) > COST_BLANK
        begins = np.flatnonzero(np.concatenate([[True], ~opens]))
        stops = np.append(begins[1:], len(starts))
        many = stops - begins
        wanted = ((many > 1) | odd[begins]) & (np.add.reduceat(_between(letters, starts, ends), begins) > 0)
        wanted &= ~((many == 2) & single[begins] & single[stops - 1] & ~odd[begins] & ~odd[stops - 1])  # two single letters aren't spacing yet
        return starts[begins[wanted]], ends[stops[wanted] - 1]

    def _doubles(self, s: np.ndarray) -> np.ndarray:
        """Letters that repeat the one before and that the model would rather do without."""
        n = len(s)
        out = np.zeros(n, bool)
        at = np.flatnonzero((s[1:] == s[:-1]) & (s[1:] > EDGE) & (s[1:] <= OTHER)) + 1 if n > 1 else np.zeros(0, np.int64)
        if not len(at):
            return out
        code = codes(s)
        wide = np.concatenate([s.astype(np.int64), np.zeros(2, np.int64)])
        one, two = np.minimum(wide[at + 1], DIGIT), np.minimum(wide[at + 2], DIGIT)
        c = self.costs
        before = code[at] // SYMBOLS  # the three symbols before the second of the pair
        follows = np.append(code, [0, 0])
        kept = c[code[at]] + np.where(one == EDGE, c[code[at] % SYMBOLS**3 * SYMBOLS], c[follows[at + 1]] + np.where(two == EDGE, c[follows[at + 1] % SYMBOLS**3 * SYMBOLS], c[follows[at + 2]]))
        less = before * SYMBOLS + one
        without = np.where(one == EDGE, c[before * SYMBOLS], c[less] + np.where(two == EDGE, c[less % SYMBOLS**3 * SYMBOLS], c[less % SYMBOLS**3 * SYMBOLS + two]))
        out[at] = kept - without > COST_REPEAT
        return out

    def chunk(self, offsets: np.ndarray, data: np.ndarray) -> tuple[Characters, str, list[set[str]]]:
        """Characters, the chunk's text in lower case, and the restored words of each text's disguised stretches."""
        chars = Characters.of(offsets, data)
        out: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
        text = data.tobytes().decode("utf-8", "replace")
        lo, hi = self.stretches(chars)
        for a, b, r in zip(lo.tolist(), hi.tolist(), (np.searchsorted(chars.rows, lo, "right") - 1).tolist(), strict=True):
            out[r] |= self.restored(text[a:b])
        low = text.lower()
        return chars, low if len(low) == len(text) else "".join(c.lower()[0] for c in text), out

    def words(self, text: str) -> set[str]:
        """All restored words of one text."""
        data = np.frombuffer(text.encode(), np.uint8)
        _, low, found = self.chunk(np.array([0, len(data)]), data)
        return plain_words(low) | found[0]


_WORD = re.compile(r"[^\W\d_]+")


def plain_words(low: str) -> set[str]:
    return set(_WORD.findall(low))


_REPEATED = re.compile(r"(.)\1+")


def squeezed(word: str) -> str:
    return _REPEATED.sub(r"\1", word)


def parts(word: str) -> list[str]:
    """Word beginnings, and the whole word with an end mark."""
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + "$"] * (len(word) >= SHORTEST)


def variants(word: str) -> tuple[str, ...]:
    """A word as it stands and without accents."""
    return (word,) if word.isascii() else (word, "".join(map(_plain, word)))


@lru_cache(1 << 16)
def tried_parts(word: str) -> tuple[str, ...]:
    """The distinct parts of a word and of its variant without accents."""
    return tuple(dict.fromkeys(q for v in variants(word) for q in parts(v)))


class Classifier:
    """Word parts with weights, the prior's log-odds, the toxic rate of all parts together and the threshold."""

    def __init__(self, weights: dict[str, float], prior: float, expected: float, threshold: float = 0.0):
        self.weights, self.prior, self.expected, self.threshold = weights, prior, expected, threshold
        self.hidden = {squeezed(variants(p)[-1]): p for p in sorted(weights)}
        self.known: dict[str, str | None] = {}
        self.starts = np.zeros(SYMBOLS**3, bool)
        for p in weights:
            a, b, c = (symbol(x) for x in variants(p)[-1][:3])
            self.starts[(a * SYMBOLS + b) * SYMBOLS + c] = True

    def part(self, word: str, restored: bool = False) -> str | None:
        """The heaviest part of a word; a restored word may differ from it in accents and repetitions, which the channel hides."""
        if word not in self.known:
            if len(self.known) >= 1 << 18:
                self.known.clear()
            self.known[word] = self._heaviest([p for p in tried_parts(word) if p in self.weights])
        found = self.known[word]
        return found if found or not restored else self._heaviest([self.hidden[p] for p in parts(squeezed(word)) if p in self.hidden])

    def _heaviest(self, found: list[str]) -> str | None:
        return max(found, key=lambda p: (self.weights[p], p)) if found else None

    def candidates(self, chars: Characters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end character, and text, of the words as they stand that begin like a part."""
        s = chars.symbol
        letter = np.concatenate([[False], (s > EDGE) & (s <= OTHER), [False]])
        bound = np.zeros(len(s) + 1, bool)
        bound[chars.rows] = True
        lo = np.flatnonzero(letter[1:-1] & (~letter[:-2] | bound[:-1]))
        hi = np.flatnonzero(letter[1:-1] & (~letter[2:] | bound[1:])) + 1
        keep = hi - lo >= SHORTEST
        lo, hi = lo[keep], hi[keep]
        w = s.astype(np.int64)
        keep = self.starts[(w[lo] * SYMBOLS + w[lo + 1]) * SYMBOLS + w[lo + 2]]
        lo, hi = lo[keep], hi[keep]
        return lo, hi, np.searchsorted(chars.rows, lo, "right") - 1

    def evidence(self, plain: Iterable[str], restored: Iterable[str]) -> dict[str, str]:
        """Words of a text with a part that weighs."""
        known = self.known
        out = {w: p for w in plain if (p := known[w] if w in known else self.part(w))}
        return out | {w: p for w in restored if w not in out and (p := self.part(w, True))}

    def logit(self, found: dict[str, str], words: int) -> float:
        return self.prior + sum(self.weights[p] for p in found.values()) - self.expected * words

    def score(self, found: dict[str, str], words: int) -> float:
        """0.5 at the threshold; 0 without evidence."""
        return float(1 / (1 + np.exp(np.clip(self.threshold - self.logit(found, words), -500, 500)))) if found else 0.0


def families(sketches: list[list[int]]) -> list[int]:
    """A number for each text, equal for near copies: those that share one of their min-hashes."""
    parent = list(range(len(sketches)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, sketch in enumerate(sketches):
        for k, least in enumerate(sketch):
            parent[top(i)] = top(first.setdefault((k, least), i))
    return [top(i) for i in range(len(sketches))]


def sketch(text: bytes, hashes: int = 8) -> list[int]:
    """Min-hashes of a text's runs of three words; none without words."""
    raw = np.frombuffer(text, np.uint8)
    _, h = textbuf.shingles(textbuf.Words(np.array([0, len(raw)]), raw), 3)
    return [int(textbuf.mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))).min().view(np.int64)) for k in range(hashes)] if len(h) else []


@dataclass
class Tally:
    """Labelled documents of one label: families, their distinct words, and of each part the words and (without ``wanted`` parts only) the families that have it."""

    families: int
    total: int
    words: Counter
    holders: Counter

    @classmethod
    def of(cls, rows: list[tuple[str, int, frozenset[str]]], wanted: set[str] | None = None) -> Tally:
        held: dict[int, set[str]] = defaultdict(set)
        for _, family, found in rows:
            held[family].update(found)
        words, holders, forms = Counter(), Counter(), Counter()
        for found in held.values():
            forms.update(found)
            if wanted is None:
                holders.update(set(chain.from_iterable(map(tried_parts, found))))
        for form, n in forms.items():
            for p in tried_parts(form):
                if wanted is None or p in wanted:
                    words[p] += n
        return cls(len(held), sum(map(len, held.values())), words, holders)

    def __add__(self, other: Tally) -> Tally:
        return Tally(self.families + other.families, self.total + other.total, self.words + other.words, self.holders + other.holders)


def _model(toxic: Tally, clean: Tally) -> Classifier:
    tried = [p for p, n in toxic.holders.items() if n >= FAMILIES]
    base = toxic.total / max(1, toxic.total + clean.total)
    says: dict[str, tuple[float, float, float]] = {}
    for p in tried:
        t, c = toxic.words[p], clean.words[p]
        high, low = (t + 0.5) / (toxic.total + 1), (c + 0.5) / (clean.total + 1)
        share = t / (t + c)
        surprise = t * np.log(share / base) + (c * np.log((1 - share) / (1 - base)) if c else 0.0)
        if high / low >= LIFT and share > base and surprise >= np.log(len(tried) / CHANCE):
            says[p] = (float(surprise), float(np.log(high / low)), high - low)
    chosen: dict[str, float] = {}
    taken: set[str] = set()  # beginnings of what is chosen
    expected = 0.0
    for p, (_, weight, more) in sorted(says.items(), key=lambda x: (-round(x[1][0], 6), -len(x[0]), x[0])):
        if p not in taken and not any(p[:k] in chosen for k in range(SHORTEST, len(p))):
            chosen[p] = weight
            taken.update(p[:k] for k in range(SHORTEST, len(p)))
            expected += more
    return Classifier(chosen, float(np.log(max(toxic.families, 0.5) / max(clean.families, 0.5))), expected)


def fit(sample: list[tuple[str, list[int], list[str]]]) -> Classifier | None:
    """From (label, sketch, restored words); None without labels of both kinds."""
    if {label for label, _, _ in sample} < {"0", "1"}:
        return None
    rows = [(label, family, frozenset(words)) for (label, _, words), family in zip(sample, families([s for _, s, _ in sample]), strict=True)]
    halves = [[r for r in rows if r[1] % 2 == k] for k in (0, 1)]
    toxic = [Tally.of([r for r in h if r[0] == "1"]) for h in halves]
    wanted = {p for p, n in (toxic[0].holders + toxic[1].holders).items() if n >= FAMILIES}
    clean = [Tally.of([r for r in h if r[0] == "0"], wanted) for h in halves]
    whole = _model(toxic[0] + toxic[1], clean[0] + clean[1])
    held = []  # log-odds and label of every document by the half that doesn't hold it
    for k in (0, 1):
        if toxic[1 - k].families and clean[1 - k].families:
            half = _model(toxic[1 - k], clean[1 - k])
            held += [(half.logit(found, len(r[2])), r[0] == "1") for r in halves[k] if (found := half.evidence(r[2], ()))]
    whole.threshold = threshold(held)
    return whole


def threshold(held: list[tuple[float, bool]]) -> float:
    """The log-odds from which on documents count as toxic: most right against wrong, and midway between two documents; 0, even odds, if that is as good."""
    if not held:
        return 0.0
    x, toxic = (np.array(v) for v in zip(*sorted(held), strict=True))
    # Right with the cut before document k: clean ones below, toxic ones from it on.
    right = np.concatenate([[0], np.cumsum(~toxic)]) + np.concatenate([np.cumsum(toxic[::-1])[::-1], [0]])
    even = int(np.searchsorted(x, 0.0))
    between = np.flatnonzero(np.diff(x) > 0) + 1
    best = between[right[between].argmax()] if len(between) else even
    return float((x[best - 1] + x[best]) / 2) if right[best] > right[even] else 0.0


def learn(docs: DataFrame, labels: DataFrame, costs: np.ndarray) -> Classifier | None:
    sent = docs.sparkSession.sparkContext.broadcast(costs)
    sample = mixing.sampled(docs, labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("string").alias("label")), ["label"], SAMPLE)

    def run(batches):
        restorer = Restorer(sent.value)
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(1))
            for lo, hi, off, part in textbuf.chunks(offsets, data):
                chars, low, found = restorer.chunk(off, part)
                words = [sorted(w for w in plain_words(low[a:b]) | f if len(w) >= SHORTEST) for a, b, f in zip(chars.rows, chars.rows[1:], found, strict=False)]
                sketches = [sketch(part[a:b].tobytes()) for a, b in zip(off, off[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sketches, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))], ["label", "sketch", "words"])

    got = sample.where(F.col("text").isNotNull()).mapInArrow(run, "label string, sketch array<long>, words array<string>").toLocalIterator()
    same: dict[str, str] = {}  # one copy of each word
    return fit(sorted((r["label"], list(r["sketch"]), [same.setdefault(w, w) for w in r["words"]]) for r in got))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, toxic, words`` of every row; words: the restored words that speak for toxicity, sorted."""
    spark = docs.sparkSession
    costs = language_model(count_grams(docs))
    sent = spark.sparkContext.broadcast((costs, learn(docs, labels, costs)))

    def run(batches):
        costs, classifier = sent.value
        restorer = Restorer(costs)
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(1))
            for lo, hi, off, part in textbuf.chunks(offsets, data):
                found: list[dict[str, str]] = [{}] * (hi - lo)
                scores = np.zeros(hi - lo)
                if classifier is not None and classifier.weights:
                    chars, low, restored = restorer.chunk(off, part)
                    plain: list[set[str]] = [set() for _ in restored]
                    for a, b, r in zip(*(x.tolist() for x in classifier.candidates(chars)), strict=True):
                        plain[r].add(low[a:b])
                    found = [classifier.evidence(p, r) for p, r in zip(plain, restored, strict=True)]
                    for r in (r for r, f in enumerate(found) if f):
                        every = {w for w in plain_words(low[chars.rows[r] : chars.rows[r + 1]]) | restored[r] if len(w) >= SHORTEST}
                        scores[r] = round(classifier.score(found[r], len(every)), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scores, pa.float64()), pa.array(scores >= 0.5), pa.array([sorted(f) for f in found], pa.list_(pa.string()))], ["doc_id", "score", "toxic", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, toxic boolean, words array<string>")
