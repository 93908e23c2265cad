"""SentencePiece encoding and decoding by a streaming Viterbi pass.

Each position keeps one backpointer, to the start of the piece that ends there in the encoding of the text
so far. A piece reaches back at most as far as the longest one, so only a window of that length can still
be the start of a path; once the paths from all of it have met in one boundary, the ids before it are
committed and forgotten (bpe.Stream). The model at hand is a BPE model, whose best path isn't the one of the
largest sum of scores: a step is allowed where its piece agrees with the one before by the order of merges,
which leaves one path to each position and gives the library's ids.

Where no piece goes across (before a space that follows something else, around line ends) all paths meet,
whatever comes after. So the text between two such boundaries has the same ids wherever it stands: a text is
read from boundary to boundary, and commits at each. A stretch that is longer than the window is streamed; the
windows of shorter ones are filled side by side, AT_ONCE of them (bpe.Bpe.windows), and their ids committed at
their ends. The ids of a stretch are kept for when it comes again, KEPT bytes at most, until the task ends;
digests(), which runs alone, keeps ALONE bytes at most for the worker's next tasks.

Null and empty texts have no ids. Decoding gives the text back but for U+2581, which stands for a space, and
ids of no piece, which give U+FFFD. Very long texts and stretches are read whole. Rows stay as they are, in
any number; a table without rows gives none. Other columns pass encode_documents(), whatever their names,
but one named ids, which is replaced; the others read doc_id and text (or ids) only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from .common import plain, quoted, small_batches, trimmed
from .token_counts import slices, texts_of

#: Bytes that are kept of known stretches: beside the other stages of a pipeline, and by an encoding alone.
KEPT, ALONE, AT_ONCE, SPACE = 24 << 20, 192 << 20, 1 << 15, "▁"
#: Texts are encoded so many characters at a time.
SLICE = 1 << 19


class Codec:
    def __init__(self, data: bytes, kept: int = KEPT):
        self.bpe, self.fallback = bpe.from_sentencepiece(data)
        self.cut = bpe.cut_pattern(self.bpe)
        self.known = bpe.Memo(kept)
        self.text_of = [c or "" for c in self.bpe.codes]
        self.byte_of = {t: b for b, t in enumerate(self.fallback)}
        self.raw_of = [c.encode("utf-8", "replace") for c in self.text_of]
        for t, b in self.byte_of.items():
            self.raw_of[t] = bytes([b])
        self.says = np.array([bool(x) for x in self.raw_of])

    def _final(self, ids: list[int], segment: str) -> bytes:
        """Ids as 4 bytes each; what is outside the vocabulary becomes its bytes."""
        out, at, other = [], 0, self.bpe.n
        for t in ids:
            if t == other:
                out += [self.fallback[x] for x in segment[at].encode("utf-8", "replace")] if self.fallback else [0]
            else:
                out.append(t)
            at += self.bpe.size[t]
        return np.array(out, "<i4").tobytes()

    def stream(self, segment: str) -> bytes:
        return self._final(self.bpe.encode(segment), segment)

    def learn(self, segments: set[str]) -> None:
        """Encodes stretches between boundaries: those within a window many at a time, longer ones as streams."""
        new = self.known.missing(segments)
        short = [x for x in new if len(x) <= self.bpe.longest]
        for lo in range(0, len(short), AT_ONCE):
            part = short[lo : lo + AT_ONCE]
            counts, ids = self.bpe.paths(part)
            ends = np.cumsum(counts)
            odd = np.unique(np.searchsorted(ends, np.flatnonzero(ids == self.bpe.n), side="right"))
            raw, cuts = ids.astype("<i4").tobytes(), [0, *(4 * ends).tolist()]
            self.known.put(part, [raw[x:y] for x, y in zip(cuts, cuts[1:])])
            for k in odd.tolist():
                self.known.now[part[k]] = self._final(ids[ends[k] - counts[k] : ends[k]].tolist(), part[k])
        for x in new:
            if len(x) > self.bpe.longest:
                self.known.put([x], [self.stream(x)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        parts = [self.cut.findall(t) if self.cut else [t] * bool(t) for t in marked]
        self.learn(set().union(*parts))
        get = self.known.now.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), "<i4") for p in parts]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids) or (ids.min() >= 0 and ids.max() < len(self.raw_of) and self.says[ids].all()):
            # All ids give bytes. A piece is whole characters, so it ends a run of single bytes in any case.
            text = b"".join(map(self.raw_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        else:
            out, held = [], bytearray()
            for t in ids.tolist():
                if (b := self.byte_of.get(t)) is not None:
                    held.append(b)
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                out.append(self._piece(t))
            text = "".join(out) + held.decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    def _piece(self, t: int) -> str:
        return self.text_of[t] if 0 <= t < len(self.text_of) else "�"


def _broadcast(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(open(path, "rb").read())


#: A worker's codec that stays for its next task, by vocabulary: one at most.
_STAYS: dict[bytes, Codec] = {}


def _codec(data: bytes, kept: int, stay: bool) -> Codec:
    if not stay or data not in _STAYS:
        _STAYS.clear()
        found = Codec(data, kept)
        if not stay:
            return found
        _STAYS[data] = found
    return _STAYS[data]


def _coding(data, run, kept: int = KEPT, stay: bool = False):
    """run(codec, batches) as a function for mapInArrow. The codec goes with the task, as workers live on beside later
    stages; with stay the worker's next task finds it, with what is known of stretches, and any other coding drops it."""

    def code(batches):
        yield from run(_codec(data.value, kept, stay), batches)

    return trimmed(code)


def encode_documents(docs: DataFrame, path: str, kept: int = KEPT) -> DataFrame:
    """Adds ids, an array of ints, in place of a column of that name."""
    cols = [c for c in docs.columns if c != "ids"]
    rows = docs.select(*quoted(cols))
    schema = T.StructType([*plain(rows).schema, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(codec, batches):
        for b in batches:
            at = 0
            for run in slices(texts_of(b), SLICE):
                ids = codec.encode(run)
                part = b.slice(at, len(run))
                at += len(run)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))], schema.names)

    return small_batches(plain(rows)).mapInArrow(_coding(_broadcast(docs, path), encode, kept), schema).toDF(*cols, "ids")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text."""

    def decode(codec, batches):
        for b in batches:
            ids = b.column("ids")
            text = [codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(_coding(_broadcast(coded, path), decode), f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, kept: int = ALONE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, 4 bytes each, little end first), round_trip (decoding gives the text back)."""

    def digest(codec, batches):
        for b in batches:
            n, sha, same = [], [], []
            for run in slices(texts_of(b), SLICE):
                for text, ids in zip(run, codec.encode(run)):
                    n.append(len(ids))
                    sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    same.append(codec.decode(ids) == text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(_coding(_broadcast(docs, path), digest, kept, stay=True), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, round_trip boolean")
