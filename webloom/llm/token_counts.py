"""Token counts by prefix dynamic programming.

A text is split as the byte-level tokenizer splits it; within a part, the number of tokens of every prefix
comes from shorter prefixes (bpe.py), so one pass gives the exact count at each byte, and with it where the
last token of each prefix starts. Both are stored for each part, and everything else is read from there: a
text's total, where its first `limit` tokens end, and the count of any prefix. Nothing is encoded a second
time, but for a prefix whose cut splits the text otherwise: parts that the text doesn't have are counted once.

Parts repeat, so each worker keeps the counts of those it has met, KEPT bytes of them at most, until its task
ends. The vocabulary file is broadcast: its size doesn't depend on the data.

Null texts are empty: 0 bytes, 0 tokens, 0 bytes that fit. Very long texts are read whole. An added token's
string inside a text is one token, as is the library's default. Rows stay as they are, in any number; a table
without rows gives none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import bpe
from .common import small_batches, trimmed

LIMIT, KEPT, SLICE = 512, 96 << 20, 1 << 20
#: Parts of at most LONG bytes are counted AT_ONCE at a time.
LONG, AT_ONCE = 96, 1 << 14
#: The split of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = r"\t-\r "
_WIDE = regex.compile(SPLIT)
_ASCII = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^{_SPACE}A-Za-z0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Counter:
    """Counts tokens of texts."""

    def __init__(self, data: bytes):
        self.bpe, self.added = bpe.from_tokenizer_json(data)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: Of each part: the token counts of its prefixes by bytes, the whole first, then the sizes of their last tokens.
        self.known = bpe.Memo(KEPT)

    def parts(self, text: str) -> list[str]:
        """What is encoded apart; an added token is a part."""
        if self.special and any(x in text for x in self.added):
            out = []
            for k, x in enumerate(self.special.split(text)):
                out += [x] if k % 2 else self._split(x)
            return out
        return self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        return (_ASCII if text.isascii() else _WIDE).findall(text)

    def learn(self, parts: set[str]) -> None:
        """Stores the counts of all parts. Those of others may be forgotten."""
        new = [p for p in self.known.missing(parts) if p not in self.added]
        raw = {p: p.encode().decode("latin-1") for p in new}
        short = [p for p in new if len(raw[p]) <= LONG]
        for lo in range(0, len(short), AT_ONCE):
            some = short[lo : lo + AT_ONCE]
            _, steps, counts = self.bpe.windows([raw[p] for p in some])
            # For each part its counts and sizes up to its length, from the end.
            both = np.stack([counts, steps], 1)[::-1].T.astype(np.uint8)
            size = np.array([len(raw[p]) + 1 for p in some])
            flat = both[np.broadcast_to((np.arange(len(steps))[::-1] < size[:, None])[:, None, :], both.shape)].tobytes()
            cuts = [0, *(2 * np.cumsum(size)).tolist()]
            self.known.put(some, [flat[x:y] for x, y in zip(cuts, cuts[1:])])
        for p in new:
            if len(raw[p]) > LONG:
                counts, steps = self.bpe.prefixes(raw[p])
                self.known.put([p], [array("I", counts[::-1] + steps[::-1])])
        for p in self.added.keys() & parts:
            n = len(p.encode())
            self.known.put([p], [array("I", [1] + [0] * n + [n] + [0] * n)])

    def stored(self, part: str):
        if part not in self.known.now:
            self.learn({part})
        return self.known.now[part]

    def at(self, part: str, size: int) -> int:
        """The number of tokens of a part's first bytes."""
        v = self.stored(part)
        return v[(len(v) >> 1) - 1 - size]

    def ends(self, part: str) -> list[int]:
        """Where each of a part's tokens ends, in bytes."""
        v = self.stored(part)
        n, out = len(v) >> 1, []
        p = n - 1
        while p > 0:
            out.append(p)
            p -= v[2 * n - 1 - p]
        return out[::-1]

    def counts(self, texts: list[str]) -> list[int]:
        return [n for n, _ in self.totals(texts)]

    def totals(self, texts: list[str], limit: int | None = None) -> list[tuple[int, int | None]]:
        """Each text's tokens; of those with more than `limit`, how many bytes the first `limit` hold."""
        split = [self.parts(t) for t in texts]
        self.learn(set().union(*split))
        get, first, out = self.known.now.__getitem__, itemgetter(0), []
        for parts in split:
            n = sum(map(first, map(get, parts)))
            out.append((n, None if limit is None or n <= limit else self._fit(parts, map(first, map(get, parts)), limit)))
        return out

    def _fit(self, parts: list[str], own: Iterable[int], limit: int) -> int:
        size = 0
        for p, n in zip(parts, own):
            if n > limit:
                return size + (self.ends(p)[limit - 1] if limit else 0)
            size += len(p.encode())
            limit -= n
        return size


class PrefixCounts:
    """The token counts of a text's prefixes, from the stored counts of its parts."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text = counter, text
        self.parts = counter.parts(text)
        counter.learn(set(self.parts))
        self.own = [counter.stored(p)[0] for p in self.parts]
        self.starts = list(accumulate((len(p) for p in self.parts), initial=0))
        self.tokens = list(accumulate(self.own, initial=0))

    def at(self, chars: int) -> int:
        """How many tokens text[:chars] has. Only the last parts can be split otherwise at the cut; they are split anew."""
        k = max(0, bisect_right(self.starts, chars) - 1)
        while k and (self.parts[k - 1].isspace() or self.starts[k] == chars and k == len(self.starts) - 1 and chars < len(self.text)):
            k -= 1
        if k:
            k -= 1
        n, at, added = self.tokens[k], self.starts[k], self.counter.added
        for p in self.counter.parts(self.text[at:chars]):
            k = bisect_right(self.starts, at) - 1
            whole = self.parts[k] if self.starts[k] == at and self.parts[k] not in added and self.parts[k].startswith(p) else p
            n += 1 if p in added else self.counter.at(whole, len(p.encode()))
            at += len(p)
        return n

    def fit(self, limit: int) -> int:
        """The number of bytes that the first `limit` tokens hold."""
        return self.counter._fit(self.parts, self.own, limit)


def texts_of(batch: pa.RecordBatch):
    """A batch's texts one by one, so that no second copy of all of them is held."""
    return (x.as_py() for x in batch.column("text"))


def slices(texts: Iterable[str | None], most: int = SLICE):
    """Runs of texts of about `most` characters, null as empty."""
    run, n = [], 0
    for t in texts:
        t = t or ""
        if run and n + len(t) > most:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def _counting(docs: DataFrame, path: str, run, schema: str) -> DataFrame:
    data = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def count(batches):
        yield from run(Counter(data.value), batches)  # goes with the task: workers live on

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(trimmed(count), f"doc_id {kind}, {schema}")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_bytes (how many bytes the first `limit` tokens hold) for each row."""

    def run(counter, batches):
        for b in batches:
            found = [x for texts in slices(texts_of(b)) for x in counter.totals(texts, limit)]
            n, fit = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
            size = pc.fill_null(pc.cast(pc.binary_length(b.column("text")), pa.int64()), 0)
            fit = pc.coalesce(fit, size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n, pc.greater(n, limit), fit], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    return _counting(docs, path, run, "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint")


def truncated(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, text: what the first `limit` tokens hold. A character whose bytes they hold only in part is left out."""

    def run(counter, batches):
        for b in batches:
            text = []
            for texts in slices(texts_of(b)):
                text += [t if fit is None else t.encode()[:fit].decode("utf-8", "ignore") for t, (_, fit) in zip(texts, counter.totals(texts, limit))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return _counting(docs, path, run, "text string")
