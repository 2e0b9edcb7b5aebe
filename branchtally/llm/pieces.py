"""SentencePiece encoding and decoding through a table of distinct marked words.

The model writes a space as a marker and puts one before the text. If none of its pieces holds
a marker behind another character, no merge crosses the place between a word and the marker that
follows, so a text falls into marked words (markers, then characters up to the next marker) that
are segmented apart from each other, and the ids of a text are the ids of its words in order.

The distinct-chunk table is dealt by hash of the word. Map tasks gather texts into blocks of
bounded size; a block sends each part of the table the words it holds of that part, once and in
sorted order, packed. A part segments every distinct word once and answers each block in the
order of its question, so that what travels back is ids alone. A block's texts then meet its
answers, and ids are joined back by position: the texts are walked word by word. Decoding is the
library's own ``decode`` of all ids of a text.

Why packed blocks and not a row for each text and word: on invented prose nearly a fifth of all
words lie outside any dictionary that could be broadcast, and such rows took four times the disk.
Sorted words of a block take a few bytes each, its texts move compressed. No word is a hot key
(a block names it once however often it stands there), and nothing is broadcast. Blocks are named
by their content: should a task be run again with other rows in its blocks, words that were not
answered are segmented in their block, so the ids are right in any case.

A model whose pieces do cross markers, that folds characters or white space, or that has pieces
of user symbols, is not split: its texts are encoded whole (``splits``; tests cover both).

Defined cases: null texts are empty; empty texts have no ids; texts of spaces are one word of
markers; markers in the text itself count as spaces, as they do in the library; a text longer
than a block is a block, and very long words are taken whole (memory some thirty times a block);
repeated rows come out repeated; null ids pass through; empty tables give an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of the texts that are gathered into one block; a longer text is a block of its own.
BLOCK = 8_000_000
#: Bytes of all texts for one part of the table (some 300,000 words of the blocks).
PART_BYTES = 16 << 20
#: Texts, and words, that the library is given at once.
TOGETHER = 10_000

_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def processor(path: str | None):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or default_path())


def splits(path: str | None) -> bool:
    """Whether the ids of a text are the ids of its marked words in order, by the model's own facts."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path or default_path(), "rb") as stored:
        model.ParseFromString(stored.read())
    form, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
    plain = form.add_dummy_prefix and form.escape_whitespaces and not form.remove_extra_whitespaces and not form.precompiled_charsmap
    if not plain or model.trainer_spec.model_type != proto.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix:
        return False
    crossing = re.compile(f"[^{MARK}]{MARK}")
    return not any(p.type == kinds.USER_DEFINED or crossing.search(p.piece) for p in model.pieces)


def marked_words(text: str) -> list[str]:
    """The marked words of a text; together they are the text as the model sees it."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(sp, words: list[str]) -> list[list[int]]:
    """The ids of each marked word. The library puts the first marker there by itself."""
    alone = sp.piece_to_id(MARK)
    found: list[list[int]] = []
    for low in range(0, len(words), TOGETHER):
        found += sp.encode([w[1:] for w in words[low : low + TOGETHER]], num_threads=1)
    return [ids if len(w) > 1 else [alone] for w, ids in zip(words, found, strict=True)]


# ---------------------------------------------------------------- packing


def pack_words(words: list[str]) -> bytes:
    """Words with their lengths, compressed."""
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + sizes.tobytes() + "".join(words).encode())


def unpack_words(packed: bytes) -> list[str]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64).tolist()
    text = raw[4 + 4 * n :].decode()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def pack_ids(lists: list[list[int]]) -> bytes:
    """Lists of ids with their lengths, compressed."""
    sizes = np.fromiter(map(len, lists), np.uint32, len(lists))
    flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum()))
    return zstandard.compress(np.uint32(len(lists)).tobytes() + sizes.tobytes() + flat.tobytes())


def unpack_ids(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the lists, all ids in a row)."""
    raw = np.frombuffer(zstandard.decompress(packed), np.uint32)
    return raw[1 : 1 + int(raw[0])], raw[1 + int(raw[0]) :]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.Array, list[str]]]:
    """(digest of the texts, ids, texts) of blocks of whole texts."""
    ids, texts, held = [], [], 0

    def block():
        digest = xxhash.xxh3_128()
        for text in texts:
            raw = text.encode()
            digest.update(len(raw).to_bytes(8, "little"))
            digest.update(raw)
        return digest.digest(), pa.concat_arrays(ids), texts

    for batch in batches:
        column, begin = batch.column("doc_id"), 0
        for i, text in enumerate(batch.column("text").to_pylist()):
            if texts and held + len(text) > BLOCK:
                ids.append(column.slice(begin, i - begin))
                yield block()
                ids, texts, held, begin = [], [], 0, i
            texts.append(text)
            held += len(text)
        ids.append(column.slice(begin))
    if texts:
        yield block()


def coded(texts: list[str]) -> tuple[dict[str, int], list[np.ndarray]]:
    """(a number for each distinct marked word, the numbers of each text's words in order)."""
    numbers: dict[str, int] = {}
    codes = []
    for text in texts:
        words = marked_words(text)
        codes.append(np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int32, len(words)))
    return numbers, codes


def by_part(distinct: Iterable[str], parts: int) -> list[list[str]]:
    """Distinct words by part of the table, each part sorted."""
    out: list[list[str]] = [[] for _ in range(parts)]
    for word in sorted(distinct):
        out[xxhash.xxh3_64_intdigest(word.encode()) % parts].append(word)
    return out


# ---------------------------------------------------------------- Arrow functions


def _binary(*columns) -> list[pa.Array]:
    return [pa.array(c, pa.binary()) for c in columns]


def _questions(parts: int):
    """One row for each block and part: the block's words of that part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, texts in blocks(batches):
            distinct: set[str] = set()
            for text in texts:
                distinct.update(marked_words(text))
            rows = [(p, pack_words(words)) for p, words in enumerate(by_part(distinct, parts)) if words]
            if rows:
                names, packed = _binary([name] * len(rows), [w for _, w in rows])
                yield pa.RecordBatch.from_arrays([names, pa.array([p for p, _ in rows], pa.int32()), packed], names=["block", "part", "words"])

    return run


def _answers(path: str | None):
    """A part of the table: every distinct word segmented once, the blocks' words answered in order."""

    def run(part: pa.Table) -> pa.Table:
        asked = [unpack_words(w) for w in part.column("words").to_pylist()]
        distinct = list(set(itertools.chain.from_iterable(asked)))
        table = dict(zip(distinct, segment(processor(path), distinct), strict=True))
        packed = [pack_ids([table[w] for w in words]) for words in asked]
        return pa.table([part.column("block"), part.column("part"), pa.chunked_array(_binary(packed))], names=["block", "part", "ids"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: its documents as a compressed Arrow stream."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for name, ids, texts in blocks(batches):
        sink = pa.BufferOutputStream()
        docs = pa.record_batch([ids, pa.array(texts, pa.large_string())], names=["doc_id", "text"])
        with pa.ipc.new_stream(sink, docs.schema, options=options) as stream:
            stream.write_batch(docs)
        yield pa.RecordBatch.from_arrays(_binary([name], [sink.getvalue().to_pybytes()]), names=["block", "docs"])


def word_ids(sp, numbers: dict[str, int], answers: dict[int, bytes], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each numbered word's ids begin, how many they are, all ids), from a block's answers."""
    begins, sizes = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    flat, held = [np.zeros(0, np.uint32)], 0
    for p, words in enumerate(by_part(numbers, parts)):
        if not words:
            continue
        counts, ids = unpack_ids(answers[p]) if p in answers else ((), None)
        if len(counts) != len(words):  # not answered
            counts, ids = unpack_ids(pack_ids(segment(sp, words)))
        at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        sizes[at] = counts
        begins[at] = held + np.cumsum(counts, dtype=np.int64) - counts
        flat.append(ids)
        held += len(ids)
    return begins, sizes, np.concatenate(flat)


def ids_at(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids of a text's words, one word after the other."""
    n = sizes[codes]
    before = np.cumsum(n) - n
    return flat[np.arange(int(n.sum())) + np.repeat(begins[codes] - before, n)]


def _joined(path: str | None, parts: int, digest: bool, schema: pa.Schema):
    """A block's texts and its answers: ids joined back by position."""

    def run(gathered: pa.Table, answered: pa.Table) -> pa.Table:
        sp = processor(path)
        shown = [str(i) for i in range(sp.get_piece_size())]
        answers = dict(zip(answered.column("part").to_pylist(), answered.column("ids").to_pylist(), strict=True))
        out = []
        for packed in gathered.column("docs").to_pylist():
            docs = pa.ipc.open_stream(packed).read_all().combine_chunks()
            numbers, codes = coded(docs.column("text").to_pylist())
            found = word_ids(sp, numbers, answers, parts)
            rows = [ids_at(c, *found).tolist() for c in codes] if not digest else [_digest(sp, ids_at(c, *found).tolist(), shown) for c in codes]
            out.append(_result(docs.column("doc_id"), rows, digest, schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _digest(sp, ids: list[int], shown: list[str]) -> tuple[int, str, str]:
    """How many ids, and the digests of the ids and of the text that they decode to."""
    text = ",".join(map(shown.__getitem__, ids))
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(sp.decode(ids, num_threads=1).encode()).hexdigest()


def _result(doc_ids, rows: list, digest: bool, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 3 if digest else [rows]
    return pa.table([doc_ids, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)


def _whole(path: str | None, digest: bool, schema: pa.Schema):
    """Texts encoded whole, for models that are not split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        shown = [str(i) for i in range(sp.get_piece_size())]
        for batch in batches:
            found = sp.encode(batch.column("text").to_pylist(), num_threads=1)
            rows = [_digest(sp, ids, shown) for ids in found] if digest else found
            yield from _result(batch.column("doc_id"), rows, digest, schema).to_batches()

    return run


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for batch in batches:
            texts = [sp.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


# ---------------------------------------------------------------- Spark


def _run(docs: DataFrame, path: str | None, digest: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    read = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType
    results = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    results = results if digest else [("ids", "array<int>", pa.list_(pa.int32()))]
    spark_schema = f"doc_id {id_type.simpleString()}, " + ", ".join(f"{n} {s}" for n, s, _ in results)
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), *((n, a) for n, _, a in results)])
    if not splits(path):
        return read.mapInArrow(_whole(path, digest, schema), spark_schema)
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // PART_BYTES
    # dealt by count: packed words are few bytes for the work they make
    asked = read.mapInArrow(_questions(parts), "block binary, part int, words binary").repartition(parts, "part")
    answered = asked.groupBy("part").applyInArrow(_answers(path), "block binary, part int, ids binary")
    gathered = read.mapInArrow(_gathered, "block binary, docs binary")
    both = (df.repartition(parts, "block").groupBy("block") for df in (gathered, answered))
    return next(both).cogroup(next(both)).applyInArrow(_joined(path, parts, digest, schema), spark_schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the ids that the model at ``path`` gives each whole text."""
    return _run(docs, path, digest=False)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids are none."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {id_type}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every text; token counts and digests, without moving the ids."""
    return _run(docs, path, digest=True)
