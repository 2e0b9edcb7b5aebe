"""BPE encoding and decoding with content-defined reuse of chunks.

A rolling hash over the bytes cuts every text where its content says so, so equal passages give
equal chunks wherever they stand. Chunks that occur more than once in the corpus's different
texts are encoded once. A text is then put together from the shared chunks' tokens and from its own stretches; at
each join the text is encoded again from a place before the join until its pieces agree with the
chunk's own, and only then the chunk's tokens are taken over.

Why agreement is exact: the tokenizer's pieces (which merges never cross) depend only on what
follows their begin. From a common piece boundary on, two readings of the same text agree, but
for the last pieces before an end of text. So the last pieces of a chunk or of a stretch are
never trusted, and a chunk without agreement is encoded again as a whole.

Texts that hold a special token's string, and texts without shared chunks, are encoded whole.
Whole texts of common Latin characters go through a second library that reads the same
vocabulary several times as fast (the tests hold its ids against the first one's, character by
character), at joins as well; all other texts, and the shared chunks, go through the tokenizer itself.

Defined cases: null texts are empty and have no tokens; repeated rows come out repeated; empty
tables give an empty result; further columns are not read; very long texts are cut like others.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small_side, store
from .textnp import _Powers, mix

#: Bytes of the rolling window, the mask whose zero cuts (2 KB on average), the least chunk shared.
WINDOW, MASK, LEAST = 32, 2047, 96
#: Pieces at the end of a reading that are not trusted, and pieces of a chunk tried for agreement.
UNSURE, TRIES = 3, (8, 32, 128)
#: Texts that are given back in one batch, and shared chunks that one task encodes.
TOGETHER, CHUNKS_A_TASK = 256, 1_000

_SLICE = 1 << 18
#: Characters for which both libraries are known to split alike: no controls, Latin letters and marks.
COMMON = re.compile("[^\t\n\r\x20-\x7e\xa0-\u017f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or default_path())
    t.no_truncation()
    t.no_padding()
    return t


def fast_tokenizer(path: str | None) -> tuple | None:
    """The same vocabulary from the rank file beside the tokenizer, and its pattern; None without one."""
    import public_tokenizers
    import regex
    import tiktoken

    ranks = re.sub(r"\.json$", ".tiktoken", path or default_path())
    if not os.path.exists(ranks):
        return None
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return encoding, regex.compile(public_tokenizers.PATTERN)


def cuts(data: bytes) -> np.ndarray:
    """Ends of the content-defined chunks of ``data``, on character boundaries."""
    x = np.frombuffer(data, np.uint8)
    found = []
    for low in range(0, len(x), _SLICE):
        begin = max(0, low - WINDOW)
        part = x[begin : low + _SLICE]
        if len(part) <= WINDOW:
            continue
        up, down = _Powers.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * down[: len(part) + 1 - WINDOW]
        at = begin + WINDOW + np.flatnonzero((mix(rolled) & np.uint64(MASK)) == 0)
        found.append(at[at > low] if low else at)
    ends = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    ends = ends[ends < len(x)]
    ends = ends[(x[ends] & 0xC0) != 0x80]
    return np.append(ends, len(x)) if len(x) else ends


def chunks(text: str) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first character, end character, bytes, digest) of the chunks that are long enough to share."""
    data = text.encode("utf-8")
    begin = char = 0
    for end in cuts(data).tolist():
        piece = data[begin:end]
        chars = len(piece.decode("utf-8"))
        if len(piece) >= LEAST:
            yield char, char + chars, piece, xxhash.xxh3_128_digest(piece)
        begin, char = end, char + chars


def pieces(encoding) -> tuple[np.ndarray, np.ndarray]:
    """(first character, first token) of each piece of an encoding."""
    words = np.array(encoding.word_ids, dtype=np.int64)
    new = np.flatnonzero(np.diff(words, prepend=-1))
    offsets = encoding.offsets  # a new list each time it is asked for
    return np.array([offsets[i][0] for i in new], np.int32), new.astype(np.int32)


def _read_stretch(t, fast, text: str) -> tuple[np.ndarray, Callable[[int], list[int]]]:
    """(piece starts of a stretch, a function that gives the ids of the pieces before one of them)."""
    if fast is None:
        e = t.encode(text, add_special_tokens=False)
        here, tokens = pieces(e)
        return here, lambda q: e.ids[: int(tokens[np.searchsorted(here, q)])]
    starts = [m.start() for m in fast[1].finditer(text)]
    # cut behind white space, the last piece could be read otherwise than in the whole
    return np.array([q for q in starts if q == 0 or not text[q - 1].isspace()], np.int64), lambda q: fast[0].encode_ordinary(text[:q])


def assemble(t, text: str, shared: list[tuple], fast: tuple | None = None) -> list[int]:
    """The ids of ``text``, with the tokens of ``shared`` chunks taken over where they agree.

    ``shared`` holds (first character, end character, ids, piece characters, piece tokens);
    ``fast`` is the second library's encoding and its pattern, for texts of common characters.
    """
    out: list[int] = []
    done = 0  # everything before is final, and a piece begins here
    for begin, end, ids, at, first in sorted(shared, key=lambda s: s[0]):
        if begin < done or len(at) <= UNSURE:
            continue
        agreed = None
        if begin == done:
            agreed, head = 0, []
        else:
            for tried in TRIES:
                stop = begin + int(at[tried]) if tried < len(at) - UNSURE else end
                here, before = _read_stretch(t, fast, text[done:stop])
                trusted = slice(0, len(here) if stop == len(text) else max(0, len(here) - UNSURE))
                both = np.intersect1d(here[trusted] + done, at[: len(at) - UNSURE] + begin)
                if len(both):
                    agreed = int(np.searchsorted(at, both[0] - begin))
                    head = before(int(both[0]) - done)
                    break
                if stop == end:
                    break
        if agreed is None:
            continue  # no agreement: the chunk is read again with what follows
        last = len(at) - UNSURE
        out += head
        out += ids[int(first[agreed]) : int(first[last])]
        done = begin + int(at[last])
    rest = text[done:]
    return out + (fast[0].encode_ordinary(rest) if fast else t.encode(rest, add_special_tokens=False).ids)


# ---------------------------------------------------------------- Arrow functions


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, body) for text in batch.column("text").to_pylist() for _, _, body, h in chunks(text)]
        columns = list(zip(*rows, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array([b.decode() for b in columns[1]], pa.string())], names=["h", "body"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
            rows += [(k1, k2, begin, end, h) for begin, end, _, h in chunks(text)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k1", "k2", "begin", "end", "h"])


def _encode_chunks(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            out = []
            for body in batch.column("body").to_pylist():
                e = t.encode(body, add_special_tokens=False)
                out.append(pack_reading(e.ids, *pieces(e)))
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(out, pa.binary())], names=["h", "reading"])

    return run


def _encode_texts(path: str | None, digest: bool):
    """Per text its ids, or their count and the digests of ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, fast = tokenizer(path), fast_tokenizer(path)
        special = [a.content for a in t.get_added_tokens_decoder().values()]
        shown = [str(i) for i in range(t.get_vocab_size())]

        def one(text: str, plan: list | None) -> tuple[list[int], str | None]:
            """The ids of a text, and what they decode to."""
            whole = not plan or any(s in text for s in special)
            if fast and not COMMON.search(text) and not any(s in text for s in special):
                ids = fast[0].encode_ordinary(text) if whole else assemble(t, text, [_taken(s) for s in plan], fast)
                return ids, fast[0].decode(ids) if digest else None
            ids = t.encode(text, add_special_tokens=False).ids if whole else assemble(t, text, [_taken(s) for s in plan])
            return ids, t.decode(ids, skip_special_tokens=False) if digest else None

        for batch, low in ((b, low) for b in batches for low in range(0, b.num_rows, TOGETHER)):
            part = batch.slice(low, TOGETHER)  # plans hold more than their texts, so few at once
            plans = part.column("shared").to_pylist() if "shared" in batch.schema.names else [None] * part.num_rows
            done = [one(*x) for x in zip(part.column("text").to_pylist(), plans, strict=True)]
            column = part.column("doc_id")
            if not digest:
                yield pa.RecordBatch.from_arrays([column, pa.array([i for i, _ in done], pa.list_(pa.int32()))], names=["doc_id", "ids"])
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    column,
                    pa.array([len(i) for i, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(",".join([shown[x] for x in i]).encode()).hexdigest() for i, _ in done]),
                    pa.array([hashlib.sha256(back.encode()).hexdigest() for _, back in done]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def pack_reading(ids: list[int], at: np.ndarray, first: np.ndarray) -> bytes:
    """A chunk's ids and pieces, compressed: it moves once for every text that holds the chunk."""
    steps = [np.diff(x, prepend=0).astype(np.int32) for x in (at, first)]
    return zstandard.compress(np.concatenate([np.array([len(ids)], np.int32), np.array(ids, np.int32), *steps]).tobytes())


def unpack_reading(packed: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.int32)
    n = 1 + int(raw[0])
    at, first = np.cumsum(raw[n:].reshape(2, -1), axis=1, dtype=np.int32)
    return raw[1:n].tolist(), at, first


def _taken(s: dict) -> tuple:
    return s["begin"], s["end"], *unpack_reading(s["reading"])


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = t.decode_batch([i or [] for i in batch.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


# ---------------------------------------------------------------- Spark


def _chunk_places(keyed: DataFrame, copies: bool = True) -> tuple[DataFrame, DataFrame]:
    """(where each text's chunks are, digests of the chunks that occur more than once), stored.

    Without ``copies`` the rows of a key count once: else every chunk of a repeated text would be
    shared, and its reading moved, to save nothing but the encoding of one text.
    """
    places = keyed.select("k1", "k2", "text").mapInArrow(_places, "k1 bigint, k2 bigint, begin int, end int, h binary")
    places = store(places if copies else places.distinct())
    return places, cut(places.groupBy("h").count().where("count > 1").select("h"))


def _shared_tokens(read: DataFrame, shared: DataFrame, path: str | None) -> DataFrame:
    """The tokens of each shared chunk, stored."""
    # of each shared chunk one body; equal bodies are combined in the map tasks
    bodies = read.select("text").mapInArrow(_bodies, "h binary, body string")
    once = bodies.join(small_side(shared), "h", "left_semi").dropDuplicates(["h"])
    # dealt by count: a chunk is some 2 KB, but costs a thousand times what moving it does
    tasks = max(1, shared.count() // CHUNKS_A_TASK)
    return cut(once.repartition(tasks, "h").mapInArrow(_encode_chunks(path), "h binary, reading binary"))


def _run(docs: DataFrame, path: str | None, digest: bool) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    keyed = read.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    # every text is cut once; the places name its chunks by digest
    places, shared = _chunk_places(keyed, copies=False)
    tokens = _shared_tokens(read, shared, path)
    placed = places.join(small_side(shared), "h", "left_semi")
    plans = cut(
        placed.join(tokens, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end", "reading")).alias("shared"))
    )  # one text's chunks in a row
    names = plans.select("k1", "k2")
    if names.count() <= BROADCAST_ROWS:
        # texts without shared chunks are encoded where they are
        names = F.broadcast(names)
        alone = keyed.join(names, ["k1", "k2"], "left_anti").select("doc_id", "text")
        parts = keyed.join(names, ["k1", "k2"], "left_semi").join(plans, ["k1", "k2"]).select("doc_id", "text", "shared")
        run = _encode_texts(path, digest)
        return alone.mapInArrow(run, schema).unionAll(parts.mapInArrow(run, schema))
    joined = keyed.join(plans, ["k1", "k2"], "left").select("doc_id", "text", "shared")
    return joined.mapInArrow(_encode_texts(path, digest), schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the ids that the tokenizer at ``path`` gives each whole text."""
    return _run(docs, path, digest=False)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {id_type}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every text; token counts and digests, without moving the ids."""
    return _run(docs, path, digest=True)
