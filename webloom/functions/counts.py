"""Words of pages counted in Arrow arrays, some at a time: a task never holds the postings of more than PART words, however large it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are counted at a time; a page with more is counted whole.
PART = 1 << 19


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows whose sizes add up to `most`, or to that and a row."""
    at = np.r_[0, np.cumsum(sizes)[:-1]] // most if len(sizes) else sizes
    cuts = [*(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)] if len(sizes) else []
    return zip([0, *cuts], cuts)


def _lengths(words: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _pages(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Of each row the number of its page: rows that stand together and have the same keys are one."""
    codes = np.stack([rows.column(c).dictionary_encode("encode").indices.to_numpy() for c in keys])
    return np.r_[0, np.cumsum((codes[:, 1:] != codes[:, :-1]).any(0))]


def counted(rows: pa.RecordBatch, keys: list[str], page: np.ndarray, positions: bool = False) -> tuple[pa.Table, np.ndarray]:
    """(word, keys, frequency and perhaps positions, page by page; how many of these each page has). positions: the first one, then the distances."""
    words = rows.column("words")
    lengths, flat = _lengths(words), words.flatten()
    row, at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if flat.null_count:
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        row, at, flat = row[there], at[there], flat.drop_null()
    coded = flat.dictionary_encode()
    n = max(1, len(coded.dictionary))
    each = page[row] * n + coded.indices.to_numpy()
    order = np.argsort(each, kind="stable")
    each = each[order]
    starts = np.flatnonzero(np.diff(each, prepend=-1))
    first = row[order][starts]
    out = {"word": coded.dictionary.take(pa.array(each[starts] % n))} | {c: rows.column(c).take(pa.array(first)) for c in keys}
    out["frequency"] = pa.array(np.diff(starts, append=len(each)))
    if positions:
        at = at[order].astype(np.int32)
        steps = np.diff(at, prepend=np.int32(0))
        steps[starts] = at[starts]
        out["positions"] = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(each)].astype(np.int32)), pa.array(steps))
    return pa.table(out), np.unique(each[starts] // n, return_counts=True)[1]


def of_rows(keys: list[str]):
    """For mapInArrow: the words of each row, with positions."""

    def run(batches):
        for batch in batches:
            for start, end in runs(_lengths(batch.column("words")), PART):
                part = batch.slice(start, end - start)
                yield from counted(part, keys, np.arange(part.num_rows), True)[0].to_batches()

    return run


def of_pages(keys: list[str]):
    """For mapInArrow: the words of each page, whose rows stand together. A page's counts are held until another page comes."""

    def key(table: pa.Table) -> list:
        return [table.column(c)[0].as_py() for c in keys]

    def run(batches):
        held = None
        for batch in batches:
            for start, end in runs(_lengths(batch.column("words")), PART):
                part = batch.slice(start, end - start)
                found, sizes = counted(part, keys, _pages(part, keys))
                if not found.num_rows:
                    continue
                if held is not None and key(held) == key(found):
                    both = pa.concat_tables([held, found.slice(0, sizes[0])]).group_by(["word", *keys], use_threads=False).aggregate([("frequency", "sum")])
                    held = both.rename_columns({"frequency_sum": "frequency"}).select(found.column_names)
                    found, sizes = found.slice(sizes[0]), sizes[1:]
                    if not found.num_rows:
                        continue
                if held is not None:
                    yield from held.to_batches()
                held = found.slice(found.num_rows - sizes[-1])
                yield from found.slice(0, found.num_rows - sizes[-1]).to_batches()
        if held is not None:
            yield from held.to_batches()

    return run
