"""Exact byte-pair encoding by dynamic programming over prefixes, as a stream.

A sequence of tokens is the encoding of its text exactly when each token encodes to itself and no merge of
two neighbours' edges would have come before the merges that made them. So the encoding of every prefix ends
in one token that can be found from the encodings of shorter prefixes: the one token that ends there and
agrees with the last token of what stands before it. Each position keeps that token and its length as its
backpointer, and the number of tokens so far.

`Stream` reads a text as it arrives. An automaton over the vocabulary gives the pieces that end at each
position, the longest first. Tokens are committed once the backpointer paths of all positions from which a
piece could still start have met in one boundary; what stands before it is forgotten.

`Bpe.windows` does the same for many texts at once that are hardly longer than the window, a position of all
of them at a time; nothing is committed before their ends, where all paths meet.

`Memo` keeps what was found for texts that repeat, within a number of bytes.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import ahocorasick
import numpy as np

_NEVER = 1 << 40
#: Bits for a token in a key of two, and pairs of neighbours of which it is kept whether they fit.
_SHIFT, _PAIRS = 20, 1 << 16
#: A character that no vocabulary has: it isn't assigned and never will be.
_GAP = "\U0010FFFF"


class Memo:
    """Values by string, of at most about `most` bytes together with their keys, in two halves: when `now` is full
    it becomes `old`, what was there is forgotten, and what is asked for again comes back."""

    #: Bytes of an entry beside the characters of its key and the items of its value.
    EACH = 180

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.now, self.old, self.held = {}, {}, 0

    def put(self, keys: list[str], values: list) -> None:
        self.now.update(zip(keys, values))
        self.held += self.EACH * len(keys) + 2 * sum(map(len, keys)) + sum(len(v) * getattr(v, "itemsize", 1) for v in values)

    def missing(self, keys: set[str]) -> list[str]:
        """The keys without a value, sorted; all others are in `now`."""
        if 2 * self.held > self.most:
            self.old, self.now, self.held = self.now, {}, 0
        rest = keys.difference(self.now)
        known = list(rest.intersection(self.old))
        self.put(known, [self.old[k] for k in known])
        return sorted(rest.difference(known))


class _Index:
    """Finds the positions of 64-bit keys: a few tables, each with the keys that found their slot taken in the one before."""

    def __init__(self, keys: np.ndarray, bits: int = 18):
        self.keys, self.tables = np.append(keys, np.uint64(0)), []
        rest = np.arange(len(keys), dtype=np.int32)
        shift = 0
        while len(rest):
            table = np.full(1 << bits, len(keys), np.int32)
            slot = self._slot(keys[rest], shift, bits)
            table[slot] = rest
            self.tables.append((shift, bits, table))
            rest = rest[table[slot] != rest]
            shift += 1

    @staticmethod
    def _slot(keys: np.ndarray, shift: int, bits: int) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * shift) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        for shift, bits, table in self.tables:
            at = table[self._slot(keys, shift, bits)]
            hit = self.keys[at] == keys
            hit &= at < len(self.keys) - 1
            out[hit] = at[hit]
        return out


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


class Bpe:
    """codes: the text of each token (for bytes, a character each), None for tokens that no text gives.
    rank: the order of the merge that makes a token, -1 for single units. split: its two halves.
    pairs: (left, right) -> rank of the merge of the two. sound: whether a token encodes to itself."""

    def __init__(self, codes: list[str | None], rank: list[int], split: list[tuple[int, int]], pairs: dict[tuple[int, int], int], sound: list[bool] | None):
        n = len(codes)
        self.n, self.codes = n, codes
        # One more token stands for a unit outside the vocabulary: it joins with nothing.
        self.rank, self.split = [*rank, -1], [*split, (0, 0)]
        self.pairs = {l << _SHIFT | r: k for (l, r), k in pairs.items()}
        self.fitting: dict[int, bool] = {}
        ids = [i for i, c in enumerate(codes) if c]
        self.longest = max(len(codes[i]) for i in ids)
        self.size = [len(c) if c else 1 for c in codes] + [1]
        if sound is None:
            sound = [True] * n
            for i in sorted((i for i in ids if rank[i] >= 0), key=rank.__getitem__):
                l, r = split[i]
                sound[i] = sound[l] and sound[r] and self.fits(l, r, rank[i])
        ids = [i for i in ids if sound[i]]
        self.pieces = ahocorasick.Automaton()
        for i in ids:
            self.pieces.add_word(codes[i], i)
        self.pieces.make_automaton()
        # The same for many texts at once.
        self._rank = np.array(self.rank, np.int64)
        self._left, self._right = (np.array([x[i] for x in self.split], np.int32) for i in (0, 1))
        self._size = np.array(self.size, np.int64)
        self._pair_rank = np.array([*pairs.values(), -1], np.int64)
        self._pair = _Index(_pair_key(*(np.array([p[i] for p in pairs], np.int64) for i in (0, 1))))

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits() of many pairs."""
        ok = np.ones(len(a), bool)
        at, x, y, limit = np.arange(len(a)), a, b, np.full(len(a), _NEVER)
        while len(at):
            r = self._pair_rank[self._pair(_pair_key(x, y))]
            bad = (r >= 0) & (r < limit)
            ok[at[bad]] = False
            rx, ry = self._rank[x], self._rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            on_left = rx > ry
            limit = np.where(on_left, rx, ry + 1)
            x, y = np.where(on_left, self._right[x], x), np.where(on_left, y, self._left[y])
        return ok

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last tokens, their sizes, token counts) of every prefix of many short texts at once: a row for each text, a column for each position, 0 beyond its end.

        All of a text's positions are held, so texts are to be short: of the longest piece's length or so.
        """
        lens = np.array([len(x) for x in texts], np.int64)
        top, n = int(lens.max(initial=0)), len(texts)
        token, step, count = np.zeros((top + 1, n), np.int32), np.zeros((top + 1, n), np.int16), np.zeros((top + 1, n), np.int16)
        starts = np.cumsum(lens + 1) - lens - 1
        # The pieces that end anywhere, by place in their text, the longest first; no piece goes across _GAP.
        found = np.fromiter(chain.from_iterable(self.pieces.iter(_GAP.join(texts))), np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(n, dtype=np.int32), lens + 1)[found[:, 0]]
        place = (found[:, 0] - starts[row] + 1).astype(np.int16)
        order = np.argsort(place, kind="stable")
        piece, row = found[order, 1].astype(np.int32), row[order]
        size, edges = self._size[piece], np.searchsorted(place[order], np.arange(1, top + 2))
        for i in range(1, top + 1):
            here = slice(edges[i - 1], edges[i])
            t, r, m = piece[here], row[here], size[here]
            on = lens >= i
            token[i, on], step[i, on], count[i, on] = self.n, 1, count[i - 1, on] + 1
            good = m == i
            if not good.all():
                done = np.zeros(n, bool)
                done[r[good]] = True
                w = np.flatnonzero(~done[r])
                good[w] = self._fits(token[i - m[w], r[w]], t[w])
            t, r, m = t[good], r[good], m[good]
            token[i, r], step[i, r], count[i, r] = t, m, count[i - m, r] + 1
        return token, step, count

    def paths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, all tokens in order) of many short texts: each path is followed back from the text's end, where all meet."""
        token, step, count = self.windows(texts)
        pos = np.array([len(x) for x in texts], np.int64)
        row = np.arange(len(texts))
        counts = count[pos, row].astype(np.int64)
        out, last = np.empty(int(counts.sum()), np.int32), np.cumsum(counts)
        row = row[pos > 0]
        while len(row):
            last[row] -= 1
            out[last[row]] = token[pos[row], row]
            pos[row] -= step[pos[row], row]
            row = row[pos[row] > 0]
        return counts, out

    def fits(self, x: int, y: int, limit: int = _NEVER) -> bool:
        """Whether tokens x and y stay apart next to each other: goes back in time through the merges on both sides of the border."""
        rank, pairs = self.rank, self.pairs
        while True:
            r = pairs.get(x << _SHIFT | y)
            if r is not None and r < limit:
                return False
            rx, ry = rank[x], rank[y]
            if rx > ry:  # of two equal merges the left one came first
                limit, x = rx, self.split[x][1]
            elif ry >= 0:
                limit, y = ry + 1, self.split[y][0]
            else:
                return True

    def fit(self, x: int, y: int) -> bool:
        """fits(), kept for the pairs met lately."""
        key = x << _SHIFT | y
        if (ok := self.fitting.get(key)) is None:
            if len(self.fitting) >= _PAIRS:
                self.fitting.clear()
            ok = self.fitting[key] = self.fits(x, y)
        return ok

    def encode(self, text: str) -> list[int]:
        s = Stream(self)
        return s.feed(text) + s.finish()

    def prefix_counts(self, segment) -> np.ndarray:
        """The number of tokens of every prefix, the empty one first."""
        return np.array(self.prefixes(segment)[0], np.int64)

    def prefixes(self, segment) -> tuple[list[int], list[int]]:
        """For every prefix, the empty one first: the number of its tokens, and the length of the last one."""
        s = Stream(self)
        s.extend(segment.decode("latin-1") if isinstance(segment, bytes) else segment)
        return s.count, s.step


class Stream:
    """Encodes a text that arrives in parts. Holds what isn't committed yet and a window of the longest piece's length."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.found = bpe, None
        #: text: what isn't committed; token, step, count: at each of its positions, the last committed one first; done: units before it.
        self.text, self.token, self.step, self.count, self.done = "", [-1], [0], [0], 0

    def feed(self, part: str) -> list[int]:
        """Takes the next units; gives the tokens that no further unit can change."""
        longest, out = self.bpe.longest, []
        room = 4 * longest
        if len(self.text) + len(part) < longest:
            self.extend(part)
            return out
        for k in range(0, len(part), room):
            self.extend(part[k : k + room])
            if len(self.text) > longest:
                out += self._commit(range(len(self.text) - longest + 1, len(self.text) + 1))
        return out

    def extend(self, part: str) -> None:
        """Finds the last token of each prefix that ends in part."""
        b, token, step, count, done = self.bpe, self.token, self.step, self.count, self.done
        size, fit, other = b.size, b.fit, b.n
        if self.found is None:
            self.found = b.pieces.iter(part)
        else:
            self.found.set(part)
        at = len(token)
        for end, t in self.found:
            p = end + 1 - done
            if p < at:
                continue  # a longer piece is the one
            while at < p:
                token.append(other)
                step.append(1)
                count.append(count[-1] + 1)
                at += 1
            m = size[t]
            before = token[p - m]
            if before < 0 or fit(before, t):
                token.append(t)
                step.append(m)
                count.append(count[p - m] + 1)
                at += 1
        self.text += part
        while at <= len(self.text):
            token.append(other)
            step.append(1)
            count.append(count[-1] + 1)
            at += 1

    def _commit(self, ends) -> list[int]:
        """Follows the paths of all ends back to the boundary where they meet."""
        alive = set(ends)
        while len(alive) > 1:
            p = max(alive)
            alive.remove(p)
            alive.add(p - self.step[p])
        meet = p = alive.pop()
        out = []
        while p > 0:
            out.append(self.token[p])
            p -= self.step[p]
        if meet:
            # Position 0 of what is left keeps the last committed token.
            self.text, self.token, self.step = self.text[meet:], self.token[meet:], [0, *self.step[meet + 1 :]]
            self.count, self.done = self.count[meet:], self.done + meet
        return out[::-1]

    def finish(self) -> list[int]:
        return self._commit((len(self.text),))


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in files of byte-level vocabularies: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def from_tokenizer_json(data: bytes) -> tuple[Bpe, dict[str, int]]:
    """A byte-level vocabulary with merges, and its added tokens."""
    j = json.loads(data)
    to_byte, vocab = _byte_of_char(), j["model"]["vocab"]
    added = {x["content"]: x["id"] for x in j.get("added_tokens", [])}
    n = max([*vocab.values(), *added.values()]) + 1
    codes, rank, split, pairs = [None] * n, [-1] * n, [(0, 0)] * n, {}
    for s, i in vocab.items():
        if s not in added:
            codes[i] = "".join(chr(to_byte[c]) for c in s)
    for k, m in enumerate(j["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        l, r, t = vocab[a], vocab[b], vocab[a + b]
        rank[t], split[t], pairs[l, r] = k, (l, r), k
    return Bpe(codes, rank, split, pairs, None), added


def from_sentencepiece(data: bytes) -> tuple[Bpe, list[int]]:
    """A BPE model of code points whose merges follow from the scores, and the token of each byte (empty without byte fallback)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    n = sp.get_piece_size()
    codes, score = [None] * n, {}
    for i in range(n):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            codes[i], score[i] = sp.id_to_piece(i), sp.get_score(i)
    by = {c: i for i, c in enumerate(codes) if c}
    order = {i: k for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))}
    rank, split, pairs, sound = [-1] * n, [(0, 0)] * n, {}, [True] * n
    for c, t in by.items():
        if len(c) < 2:
            continue
        for k in range(1, len(c)):
            l, r = by.get(c[:k], -1), by.get(c[k:], -1)
            if l >= 0 and r >= 0:
                pairs[l, r] = order[t]
    for c, t in by.items():
        if len(c) < 2:
            continue
        parts = [by.get(x, -1) for x in c]
        while len(parts) > 2:
            best = min(((pairs.get((a, b), 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 40:
                break
            k = best[1]
            parts[k : k + 2] = [by[codes[parts[k]] + codes[parts[k + 1]]]]
        sound[t] = len(parts) == 2 and tuple(parts) in pairs
        if sound[t]:
            rank[t], split[t] = order[t], tuple(parts)
    fallback = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Bpe(codes, rank, split, pairs, sound), fallback if sp.is_byte(fallback[0]) else []


def cut_pattern(bpe: Bpe, spaces: str = "▁") -> re.Pattern | None:
    """Splits a text where all paths must meet: before a space after something else, and around line ends, if no piece goes across these."""
    pieces = [c for c in bpe.codes if c]
    if any(re.search(f"[^{spaces}]{spaces}", c) for c in pieces):
        return None
    alone = "\n" if not any("\n" in c for c in pieces) else ""
    return re.compile(f"{alone}|{spaces}+[^{spaces}{alone}]*|[^{spaces}{alone}]+" if alone else f"{spaces}+[^{spaces}]*|[^{spaces}]+")
