"""Fill-in-middle transformation by block rotations inside one buffer, and its inverse.

A text is cut into tokens (white space with the word after it); two hashed numbers of tokens
bound its middle. All of it happens in one bytearray: the sentinels go in where the three blocks
stand, ``<P>prefix <M>middle <S>suffix``, and neighbouring blocks are exchanged by a rotation,
which is three reversals (each block, then both). One rotation gives either form:

    psm  <P>prefix | <M>middle  x  <S>suffix     ->  <P>prefix <S>suffix <M>middle
    spm  <P>prefix <M>middle    x  <S>suffix     ->  <S>suffix <P>prefix <M>middle

``restore`` finds the sentinels in an output, turns the same blocks back and takes the sentinels
out. A text that holds a sentinel's string itself stays plain, so an output has each one once
(a sentinel begins with ``<`` and has no other, so none can arise where two blocks meet).

Rows are independent: one map over the texts, no shuffle, and a lost task is simply run again.
Memory is the buffer and, for the cuts, eight bytes a token of one text; reversals copy blocks
of bounded size.

Defined cases: null texts are empty; empty texts, and texts with a sentinel's string, are plain,
with null lengths; a text of white space is one token; a null id hashes as no characters; equal
ids get equal forms; repeated rows come out repeated; empty tables give an empty result; of
further columns none is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textnp import NOT_SPACE

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Of 100 documents so many are transformed, and of 100 of those so many begin with the suffix.
RATE, SPM_RATE = 50, 80
#: Bytes that a reversal exchanges at once, and bytes whose tokens are found at once.
_BLOCK, _SLICE = 1 << 16, 1 << 20
#: Bytes of outputs that are given back in one batch.
_TOGETHER = 1 << 24


def token_ends(data: bytes | bytearray) -> np.ndarray:
    """Where each token ends: after every word, and after white space that no word follows."""
    x = np.frombuffer(data, np.uint8)
    found = []
    for low in range(0, len(x), _SLICE):
        word = NOT_SPACE[x[low : low + _SLICE + 1]]
        if low + _SLICE >= len(x):
            word = np.append(word, False)
        found.append(low + 1 + np.flatnonzero(word[:-1] & ~word[1:]))
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.append(ends, len(x)) if len(x) and not NOT_SPACE[x[-1]] else ends


def draw(doc_id: int | str | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits, from the id alone."""
    name = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def reverse(x: np.ndarray) -> None:
    """Reverses ``x`` in place, a bounded block from each side at a time."""
    low, high = 0, len(x)
    while high - low > 1:
        n = min(_BLOCK, (high - low) // 2)
        left = x[low : low + n].copy()
        x[low : low + n] = x[high - n : high][::-1]
        x[high - n : high] = left[::-1]
        low, high = low + n, high - n


def rotate(buffer: bytearray, begin: int, cut: int, end: int) -> int:
    """Exchanges the blocks ``begin:cut`` and ``cut:end`` in place; gives the new cut."""
    x = np.frombuffer(buffer, np.uint8)
    reverse(x[begin:cut])
    reverse(x[cut:end])
    reverse(x[begin:end])
    return begin + end - cut


def transform(data: bytes, first: int, last: int, form: str) -> bytearray:
    """``data`` with its middle ``first:last`` (bytes) set last, in the given form."""
    buffer = bytearray(data)
    # from the end, so that the places before stay right
    for at, mark in ((last, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    middle, suffix = first + len(PREFIX), last + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` made ``output`` from."""
    if form == "plain":
        return bytes(output)
    buffer = bytearray(output)
    if form == "psm":
        begin, cut = buffer.index(SUFFIX), buffer.index(MIDDLE)
    else:
        begin, cut = 0, buffer.index(PREFIX)
    rotate(buffer, begin, cut, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def infill(doc_id: int | str | None, data: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(tokens, form, prefix characters, middle characters, output) of one UTF-8 text."""
    ends = token_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draw(doc_id, seed)
    if not data or h3 % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    few, many = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, last = (int(ends[i - 1]) if i else 0 for i in (few, many))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return n, form, _characters(data, 0, first), _characters(data, first, last), transform(data, first, last, form)


def _characters(data: bytes, begin: int, end: int) -> int:
    """Code points of a part of a UTF-8 text: its bytes that continue none."""
    x = np.frombuffer(data, np.uint8)[begin:end]
    return int(np.count_nonzero((x & 0xC0) != 0x80))


_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64())


def _flush(ids: pa.Array, rows: list[tuple], last: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (*_KINDS, *(kind for _, kind in last))
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*_NAMES, *(name for name, _ in last)]
    )


def _each(finish, last: list[tuple[str, pa.DataType]], seed: int, rate: int, spm_rate: int):
    """An Arrow function: the transformation of each text, its output given on through ``finish``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
            rows, begin, held = [], 0, 0
            for i, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                *facts, output = infill(doc_id.as_py(), text.as_py() or b"", seed, rate, spm_rate)
                rows.append((*facts, *finish(output, facts[1])))
                held += len(output)
                if held >= _TOGETHER:
                    yield _flush(ids.slice(begin, len(rows)), rows, last)
                    rows, begin, held = [], i + 1, 0
            if rows:
                yield _flush(ids.slice(begin, len(rows)), rows, last)

    return run


def _run(docs: DataFrame, finish, last: list[tuple[str, pa.DataType]], seed: int, rate: int, spm_rate: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint" + "".join(f", {name} string" for name, _ in last)
    return docs.select("doc_id", "text").mapInArrow(_each(finish, last, seed, rate, spm_rate), schema)


def outputs(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of ``doc_id, text``."""
    return _run(docs, lambda output, form: (output.decode(),), [("output", pa.string())], seed, rate, spm_rate)


def originals(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` rebuilt from the ``output`` and ``form`` of each row alone; nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)
            texts = [None if o is None or f is None else restore(o.encode(), f).decode() for o, f in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "output", "form").mapInArrow(run, f"doc_id {id_type}, text string")


def _sha(data: bytes | bytearray) -> str:
    return hashlib.sha256(data).hexdigest()


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Transforms and restores every text; digests of both, without moving the texts."""
    last = [("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    return _run(docs, lambda output, form: (_sha(output), _sha(restore(output, form))), last, seed, rate, spm_rate)
