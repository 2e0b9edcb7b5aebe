"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their groups.

The join proper is a prefix tree. All shingles have one order, by their frequency over the whole
table as far as a fixed number of counters tells it. The sets of a block are stored in that order
in a trie whose nodes share common runs; a set meets the trie from the root, carrying the overlap
counted so far for all sets below a node at once. A subtree is pruned when the overlap plus the
shorter of the two remaining lengths cannot reach what the threshold asks, when its sizes cannot
fit, or when everything in it is already in the set's own group.

What meets in a block comes from an exact split. For sets of sizes a and b the threshold t allows
at most H = (a+b)(1-t)/(1+t) differing shingles; cut by hash into more than H parts, two such sets
agree in all but H parts. So of each set the heaviest H + 1 parts are its signatures, in an order
that says by how many and how rare shingles a part is unlikely to agree by chance: the heaviest of
the parts that two sets agree in is among those of both. A few shared shingles, even rare ones, then
bring no sets together, and the number of pairs that meet does not grow with the square of the
table. Where parts would hold too few shingles (t under 0.77) the common order is used instead: two
sets that overlap by the threshold have one of their first, rarest shingles in common, as many as
may differ, and one. Either way no pair is lost; that counters are shared by many shingles costs
time alone.
Map tasks combine equal signatures before the exchange, so a hot signature is one entry a task,
and send the rest sorted and packed. Connected signatures make clusters; a cluster above the block
size is dealt into blocks by the least hash of a set, which similar sets mostly share. In a second
round the sets of different groups that agree in a signature, and lie in different blocks, meet.

Links inside a group need not all be found: the result is the groups, exactly.

Defined cases: null and empty texts, and texts of white space, have no shingles and stay alone;
a text shorter than a shingle is one shingle; equal texts (or texts with equal sets) form a
group; null ids never represent a group unless nothing else is there; ids of any ordered type
keep it; ids that several texts share are each counted with the id; repeated rows come out
repeated; very long texts are hashed in slices and are one set in one block; empty tables give an
empty result; further columns, whatever their names, are not read by ``groups`` and pass ``keep_one``.
Hashes have 64 bits; two different shingles of one comparison are equal with probability 1e-13.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, store
from .textnp import NOT_SPACE, mix, shingles, whole, words_by_text

#: Shingles of a block that one task joins (some 100 MB while it does).
BLOCK_SHINGLES = 1_500_000
#: Sets of a split cluster that every block holds.
LEADERS = 8
#: Signatures met in a map task that one row carries.
MET_A_ROW = 100_000
#: Signatures that a map task combines at once, and bytes of texts for one part of the signatures.
COMBINE, PART_BYTES = 1_000_000, 16 << 20
#: Buckets in which shingles are counted for their common order, and rows that carry the counts.
BUCKET_BITS, CHUNKS = 22, 64
#: Where parts, one more than may differ, hold so many shingles, they are cut finer by this.
PART_SHINGLES, FINER = 5, (4, 3)
#: Bits by which texts are told from those that nobody wants (a bitmap of 16 MB).
WANTED_BITS = 27
#: Bits of a signature that are compared; sets that agree in them by chance are compared in vain, no more.
SIGNATURE_BITS = 48


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingles(words, k) if len(words) >= k else whole(words))


def set_key(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def give_back() -> None:
    """Returns freed memory to the system; workers stay for later stages, which need room of their own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over batches that gives back memory at the end of a task."""

    @functools.wraps(run)
    def until_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return until_end


# ---------------------------------------------------------------- one order of all shingles


def bucket(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def order_key(items: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Numbers that order shingles alike everywhere: rare ones first, by counts of the whole table."""
    return (levels[bucket(items)].astype(np.uint64) << np.uint64(56)) | (items >> np.uint64(8))


def _counts(k: int):
    """How many sets of a map task hold shingles of each bucket, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.uint64)
        held, size = [], 0

        def add() -> None:
            np.add(counts, np.bincount(np.concatenate(held), minlength=len(counts)).view(np.uint64), out=counts)

        for batch in batches:
            for words in words_by_text(batch.column("text"), NOT_SPACE):
                held.append(bucket(shingle_set(words, k)))
                size += len(held[-1])
                if size >= COMBINE:
                    add()
                    held, size = [], 0
        if held:
            add()
        chunks = counts.reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(map(pack_numbers, chunks), pa.binary())], names=["chunk", "counts"])

    return lean(run)


def _summed(rows: pa.Table) -> pa.Table:
    total = np.zeros((1 << BUCKET_BITS) // CHUNKS, np.uint64)
    for packed in rows.column("counts").to_pylist():
        total += unpack_numbers(packed)
    return pa.table({"chunk": rows.column("chunk")[:1], "counts": pa.array([pack_numbers(total)], pa.binary())})


def levels_of(read: DataFrame, k: int) -> np.ndarray:
    """The frequency of each bucket over all texts, on a scale of logarithms (one byte a bucket)."""
    counts = read.select("text").mapInArrow(_counts(k), "chunk int, counts binary")
    rows = counts.groupBy("chunk").applyInArrow(_summed, "chunk int, counts binary").collect()
    total = np.zeros(1 << BUCKET_BITS, np.uint64).reshape(CHUNKS, -1)
    for row in rows:
        total[row["chunk"]] = unpack_numbers(row["counts"])
    return np.minimum(4 * np.log2(1.0 + total.reshape(-1)), 255).astype(np.uint8)


# ---------------------------------------------------------------- signatures


class Sizes:
    """Classes of set sizes and, for each, the number of parts; ``num / den`` is the threshold."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds = num, den, [1]

    def _grow(self) -> None:
        # a partner's size is in the same class or the next; up to twice the size, as sets near a bound have two
        low = self.bounds[-1]
        high = low * self.den // self.num + 1
        while high * self.den // self.num + 1 <= 2 * low:
            high = high * self.den // self.num + 1
        self.bounds.append(high)

    def of(self, n: int) -> int:
        """The class of size ``n``; a partner of at most n * den / num is in it or the next."""
        while self.bounds[-1] <= n:
            self._grow()
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def last(self, cls: int) -> int:
        """The largest size of a class."""
        while len(self.bounds) <= cls + 1:
            self._grow()
        return self.bounds[cls + 1] - 1

    def differ(self, both: int) -> int:
        """The most shingles that only one of two linked sets has; ``both`` is the sum of their sizes."""
        return both * (self.den - self.num) // (self.den + self.num)

    def meets(self, n: int) -> list[tuple[int, int]]:
        """(class, most differing shingles) for each class under which a set of size ``n`` meets partners."""
        own, largest = self.of(n), n * self.den // self.num
        until = self.last(own)
        here = (own, self.differ(n + min(largest, until)))
        return [here] if largest <= until else [here, (own + 1, self.differ(n + largest))]

    def parts(self, cls: int) -> int:
        """The number of parts of a class: more than may differ, so that light ones can be left out."""
        return 1 + self.differ(2 * self.last(cls)) * FINER[0] // FINER[1]


def heaviest_parts(items: np.ndarray, sizes: Sizes, levels: np.ndarray, top: int) -> np.ndarray:
    """Hashes of the heaviest parts of the sorted set, one more than may differ, by size class.

    Two linked sets agree in all parts but those that differ. Each leaves out its lightest parts, one
    less than they agree in, so the heaviest of the parts they agree in stays in both. A shingle weighs
    more the rarer it is, and at least 1, so parts of several outweigh single ones; empty parts weigh nothing.
    """
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(items))])
    weights = np.concatenate([[0], np.cumsum(top + 1 - levels[bucket(items)].astype(np.int64))])
    out = []
    for cls, differ in sizes.meets(len(items)):
        parts = sizes.parts(cls)
        part = ((items >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending like the items
        ends = np.searchsorted(part, np.arange(parts, dtype=np.uint64), side="right")
        begins = np.concatenate([[0], ends[:-1]])
        names = mix(sums[ends] - sums[begins] + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((cls * 2 + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
        # equal names have equal places in this order, and of places that are equal all stay or none
        order = (np.minimum(weights[ends] - weights[begins], 0xFFFF).astype(np.uint64) << np.uint64(48)) | (names >> np.uint64(16))
        least = parts - differ - 1
        out.append(names[order >= np.partition(order, least)[least]])
    return np.concatenate(out)


def first_shingles(items: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set in the common order, as many as a partner cannot miss them all.

    Sets that overlap by the threshold share at least ``num / den`` of the shingles of each; if
    they had none of their first shingles in common, more would be missing than that allows.
    """
    n = len(items)
    wanted = n - -(-n * num // den) + 1
    return items[np.argsort(order_key(items, levels), kind="stable")[:wanted]]


class Signatures:
    """What sets are brought together by, for a threshold of ``num / den``.

    The heaviest parts of a set; for thresholds under 0.77, where too few parts would hold two
    shingles, its first shingles in the common order. ``by_parts`` says that parts would hold five
    shingles or more even if they were not cut finer and none were left out.
    """

    def __init__(self, num: int, den: int, levels: np.ndarray):
        self.num, self.den, self.levels, self.top = num, den, levels, int(levels.max(initial=0))
        self.sizes, self.by_parts = Sizes(num, den), num + den >= 2 * PART_SHINGLES * (den - num)

    def of(self, items: np.ndarray) -> np.ndarray:
        if 10 * (self.den - self.num) <= 3 * self.num:
            return heaviest_parts(items, self.sizes, self.levels, self.top)
        # under the set's own size class and the next, so that sets of other sizes do not meet
        first = first_shingles(items, self.levels, self.num, self.den)
        return np.concatenate([mix(first + np.uint64((cls + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))) for cls, _ in self.sizes.meets(len(items))])


def _keys(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, least = [], [], []
            for words in words_by_text(batch.column("text"), NOT_SPACE):
                items = shingle_set(words, k)
                keys.append(set_key(items))
                sizes.append(len(items))
                least.append(int(items[:1].view(np.int64)[0]) if len(items) else 0)
            columns = [batch.column("doc_id"), batch.column("th"), *(pa.array(c, pa.int64()) for c in (keys, sizes, least))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "key", "n", "least_item"])

    return lean(run)


def pack_numbers(x: np.ndarray) -> bytes:
    """64-bit numbers compressed byte plane by byte plane; planes of zeros cost nothing."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def _meetings(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures once, their least key; places of the pairs that share a signature, the least key there)."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1])])
    run = np.cumsum(new) - 1
    first = key[new]
    several = (np.bincount(run) > 1)[run]
    return sig[new], first, order[several], first[run[several]]


def _packed(sig: np.ndarray, number: np.ndarray, keys: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows (part, signatures, sets, names of the sets) of sorted signatures; sets are numbered."""
    part = ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending like the signatures
    ends = np.searchsorted(part, np.arange(parts, dtype=np.uint64), side="right")
    begin = 0
    for p, end in enumerate(ends.tolist()):
        if end > begin:
            used, local = np.unique(number[begin:end], return_inverse=True)
            steps = np.diff(sig[begin:end] >> np.uint64(64 - SIGNATURE_BITS), prepend=np.uint64(0))
            yield p, pack_numbers(steps), pack_numbers(local.astype(np.uint64)), keys[used].tobytes()
        begin = end


_BLOCK_ROW = "part int, sigs binary, sets binary, names binary, met boolean"


def _signature_rows(k: int, num: int, den: int, parts: int, levels):
    """By part of the signatures, packed: each signature of a map task with one of its sets.

    Signatures that several sets of the task share come out as ``met`` rows besides, which hold
    (signature, key, first key), so that a part gets a signature once a task, however many sets
    hold it.
    """

    def flush(sigs: list, numbers: list, keys: list) -> pa.RecordBatch:
        sig, number, named = np.concatenate(sigs), np.concatenate(numbers), np.array(keys, np.int64)
        once, first, at, least = _meetings(sig, number)
        rows = [(*row, False) for row in _packed(once, first, named, parts)]
        # which part carries what met here does not matter, so a set's hash deals it
        for low in range(0, len(at), MET_A_ROW):
            here = slice(low, low + MET_A_ROW)
            sets = np.concatenate([number[at[here]], least[here]]).astype(np.uint64)
            rows.append(((keys[0] + low // MET_A_ROW) % parts, pack_numbers(sig[at[here]] >> np.uint64(64 - SIGNATURE_BITS)), pack_numbers(sets), named.tobytes(), True))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "sigs", "sets", "names", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kind = set(), Signatures(num, den, levels.value)
        sigs, numbers, keys, held = [], [], [], 0
        for batch in batches:
            for words in words_by_text(batch.column("text"), NOT_SPACE):
                items = shingle_set(words, k)
                key = set_key(items)
                if not len(items) or key in seen:
                    continue
                seen.add(key)
                names = kind.of(items)
                sigs.append(names)
                numbers.append(np.full(len(names), len(keys), np.int64))
                keys.append(key)
                held += len(names)
                if held >= COMBINE:
                    yield flush(sigs, numbers, keys)
                    sigs, numbers, keys, held, seen = [], [], [], 0, set()
        if held:
            yield flush(sigs, numbers, keys)

    return lean(run)


def _met_in_part(rows: pa.Table) -> pa.Table:
    """(sig, key, first key) of the signatures that sets of several tasks hold, and of those met in one task."""
    met = [m or False for m in rows.column("met").to_pylist()]
    columns = [rows.column(c).to_pylist() for c in ("sigs", "sets", "names")]
    sigs, keys, out = [], [], []
    for packed, sets, names, there in zip(*columns, met, strict=True):
        named, number, own = np.frombuffer(names, np.int64), unpack_numbers(sets).astype(np.int64), unpack_numbers(packed)
        if there:
            out.append((own.view(np.int64), *np.split(named[number], 2)))
        else:
            sigs.append(np.cumsum(own, dtype=np.uint64))
            keys.append(named[number])
    if sigs:
        # a set that two tasks hold meets itself there
        pairs = np.unique(np.stack([np.concatenate(sigs).view(np.int64), np.concatenate(keys)]), axis=1)
        sig, key = pairs[0].view(np.uint64), pairs[1]
        _, _, at, first = _meetings(sig, key)
        out.append((sig[at].view(np.int64), key[at], first))
    found = pa.table({name: np.concatenate(c) for name, c in zip(("sig", "key", "first"), zip(*out, strict=True), strict=True)})
    del columns, sigs, keys, out
    give_back()
    return found


# ---------------------------------------------------------------- the trie


class _Node:
    __slots__ = ("run", "children", "ends", "shortest", "longest", "group")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends = run, {}, []
        self.shortest, self.longest, self.group = 1 << 60, 0, -2  # -2: nothing below, -1: several groups


class Trie:
    """Ordered sets of ranks with their groups; ``join`` links a set and then stores it."""

    def __init__(self, num: int, den: int, vocabulary: int, count: int):
        self.num, self.den = num, den
        self.root = _Node(np.zeros(0, np.int64))
        self.sizes = [0] * count
        self.parent = list(range(count))
        self.inside = np.zeros(vocabulary, bool)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def _group(self, node: _Node) -> int:
        """The one group of all sets below ``node``, or -1; kept where it is known."""
        if node.group >= 0:
            return self.find(node.group)
        found = {self.find(e) for e in node.ends}
        for child in node.children.values():
            found.add(self.find(child.group) if child.group >= 0 else -1)
            if len(found) > 1 or -1 in found:
                return -1
        node.group = found.pop() if found else -1
        return node.group

    def search(self, me: int, items: np.ndarray) -> None:
        """Links set ``me`` to the stored sets of other groups and joins these groups."""
        n, num, den = len(items), self.num, self.den
        least, most = -(-n * num // den), n * den // num
        self.inside[items] = True
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if node.longest < least or node.shortest > most or self._group(node) == self.find(me):
                continue
            if len(node.run):
                overlap += int(np.count_nonzero(self.inside[node.run]))
                depth += len(node.run)
                left = n - int(np.searchsorted(items, node.run[-1], side="right"))
            else:
                left = n
            needed = -(-(n + max(node.shortest, least)) * num // (num + den))
            if overlap + min(left, node.longest - depth) < needed:
                continue
            for other in node.ends:
                if den * overlap >= num * (n + self.sizes[other] - overlap) and self.find(other) != self.find(me):
                    self.union(me, other)
            likely = [c for t, c in node.children.items() if self.inside[t]]
            stack += [(c, depth, overlap) for t, c in node.children.items() if not self.inside[t]]
            stack += [(c, depth, overlap) for c in likely]
        self.inside[items] = False

    def insert(self, me: int, items: np.ndarray) -> None:
        self.sizes[me] = len(items)
        node, at = self.root, 0
        self._count(node, me, len(items))
        while at < len(items):
            child = node.children.get(int(items[at]))
            if child is None:
                child = node.children[int(items[at])] = _Node(items[at:])
                self._count(child, me, len(items))
                child.ends.append(me)
                return
            rest = items[at : at + len(child.run)]
            differ = np.flatnonzero(child.run[: len(rest)] != rest)
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(child.run):  # the common part becomes a node of its own
                upper = _Node(child.run[:same])
                upper.shortest, upper.longest, upper.group = child.shortest, child.longest, child.group
                child.run = child.run[same:]
                upper.children[int(child.run[0])] = child
                node.children[int(upper.run[0])] = upper
                child = upper
            self._count(child, me, len(items))
            node, at = child, at + same
        node.ends.append(me)

    def _count(self, node: _Node, me: int, size: int) -> None:
        node.shortest, node.longest = min(node.shortest, size), max(node.longest, size)
        if node.group == -2:
            node.group = me
        elif node.group >= 0 and self.find(node.group) != self.find(me):
            node.group = -1


def trie_groups(keys: list[int], sets: list[np.ndarray], known: list[int], stored: list[bool], asking: list[bool], num: int, den: int, levels: np.ndarray) -> list[tuple[int, int]]:
    """(key, key of its group's first set) of a block: each asking set meets the stored ones.

    ``known`` names the group that a set is already in. Sets are in the common order, frequent
    shingles first, so that common runs are shared near the root.
    """
    if len(keys) < 2:
        return []
    vocabulary, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.argsort(order_key(vocabulary, levels), kind="stable")[::-1]] = np.arange(len(vocabulary))
    ranked = np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])
    ranked = [np.sort(r) for r in ranked]
    trie = Trie(num, den, len(vocabulary), len(keys))
    first: dict[int, int] = {}
    for i, group in enumerate(known):
        trie.union(i, first.setdefault(group, i))
    for i in sorted(range(len(keys)), key=lambda i: not stored[i]):  # those that only ask come last
        if asking[i]:
            trie.search(i, ranked[i])
        if stored[i]:
            trie.insert(i, ranked[i])
    return [(keys[i], keys[trie.find(i)]) for i in range(len(keys)) if trie.find(i) != i]


def _block_links(num: int, den: int, levels):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("role", "descending"), ("key", "ascending")])
        keys = block.column("key").to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in block.column("items").to_pylist()]
        role = block.column("role").to_pylist()
        # role 2: stored and asking; 1: only stored; 0: only asking
        links = trie_groups(keys, sets, block.column("known").to_pylist(), [r > 0 for r in role], [r != 1 for r in role], num, den, levels.value)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(words, k).tobytes() for words in words_by_text(batch.column("text"), NOT_SPACE)]
            yield pa.RecordBatch.from_arrays([batch.column("places"), pa.array(sets, pa.binary())], names=["places", "items"])

    return lean(run)


# ---------------------------------------------------------------- Spark


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all ends of the edges ``a, b``; the root is the same in a component.

    Each round sends every node to its smallest neighbour and contracts the edges; the rounds'
    maps are followed in turn. Minima are combined before the exchange; lineage is cut. Nodes
    are hashes, so their order along a path is random and a path shrinks by a share each round.
    """
    live = store(edges.select("a", "b").where("a <> b").distinct())
    maps = []
    while not live.isEmpty():
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        maps.append(nearest)
        side = small_side(nearest)
        left = live.join(side.withColumnRenamed("to", "ra"), "a")
        moved = left.join(side.select(F.col("a").alias("b"), F.col("to").alias("rb")), "b")
        live = store(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in maps[1:]:
        after = small_side(step.select(F.col("a").alias("root"), F.col("to").alias("next")))
        found = found.join(after, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return store(found)


def _first_round(members: DataFrame) -> DataFrame:
    """``root, key, block, own`` rows: small clusters whole, large ones in blocks of bounded size.

    A large cluster is dealt by the least hash of a set, which similar sets mostly share, so that
    most links lie within a block. Where one such cell is still too large it is dealt by key, and
    each of its blocks holds the same few leaders.
    """
    clusters = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("cells"))
    in_cells = members.join(small_side(store(clusters)), "root").withColumn("cell", F.pmod(F.xxhash64("least_item"), F.col("cells")))
    in_cells = store(in_cells.select("root", "key", "n", "cell"))
    sized = in_cells.groupBy("root", "cell").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts"))
    placed = in_cells.join(small_side(store(sized)), ["root", "cell"]).withColumn("part", own)
    block = lambda part: (F.col("cell") * (1 << 24) + part).alias("block")
    # a thin slice by hash holds the leaders, so they are found without gathering a cell
    lead_order = Window.partitionBy("root", "cell").orderBy(F.xxhash64("key", F.lit(11)), "key")
    slice_of = F.pmod(F.xxhash64("key", F.lit(11)), F.greatest(F.col("parts") * 64, F.lit(1)))
    leaders = (
        placed.where((F.col("parts") > 1) & (slice_of < LEADERS))
        .withColumn("nth", F.row_number().over(lead_order))
        .where(F.col("nth") <= LEADERS)
        .select("root", "key", "cell", F.col("part").alias("home"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
        .where("part <> home")
    )
    here = placed.select("root", "key", block(F.col("part")), F.lit(True).alias("own"))
    return store(here.unionAll(leaders.select("root", "key", block(F.col("part")), F.lit(False))))


_PLACE = "struct<root:bigint,block:bigint,key:bigint,known:bigint,role:int>"


def _links(placed: DataFrame, chosen: Callable[[DataFrame], DataFrame], k: int, num: int, den: int, levels) -> DataFrame:
    """The groups that the blocks' tries find, as edges; ``placed`` has root, block, key, known, role.

    Where a set is needed goes to its text, and the set is made there: sets, several times the
    size of the compressed texts, move once, to their blocks.
    """
    places = store(placed.groupBy("key").agg(F.collect_list(F.struct("root", "block", "key", "known", "role")).alias("places")))
    made = chosen(places).mapInArrow(_sets(k), f"places array<{_PLACE}>, items binary")
    rows = made.select(F.explode("places").alias("at"), "items").select("at.*", "items")
    return store(rows.groupBy("root", "block").applyInArrow(_block_links(num, den, levels), "a bigint, b bigint"))


def wanted_bits(wanted: DataFrame) -> np.ndarray:
    """A bitmap of the first bits of the text hashes ``w_th``."""
    at = F.shiftrightunsigned("w_th", 64 - WANTED_BITS) + 1
    rows = wanted.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    size = len(rows[0]["bits"]) if rows else 1
    out = np.zeros(max(1 << WANTED_BITS >> 3, size), np.uint8)
    for row in rows:
        out[(row["bucket"] - 1) * size : row["bucket"] * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _among(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("th").to_numpy().view(np.uint64) >> np.uint64(64 - WANTED_BITS)
            there = bits.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(there.astype(bool)))

    return lean(run)


def texts_among(read: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``read`` whose text hash ``th`` may be one of ``w_th``: all of those, and few others."""
    bits = read.sparkSession.sparkContext.broadcast(wanted_bits(wanted))
    return read.mapInArrow(_among(bits), read.schema)


def _telling(held: DataFrame) -> DataFrame:
    """``sig``: of the signatures that the same several sets hold, one; ``held`` has sig, key once."""
    holders = [F.count("*").alias("c"), F.min("key").alias("least"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(17))).alias("y")]
    return held.groupBy("sig").agg(*holders).where("c > 1").groupBy("c", "least", "x", "y").agg(F.min("sig").alias("sig")).select("sig")


def _second_round(first: DataFrame, groups: DataFrame, met: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame | None:
    """Sets of split clusters meet what they could link to in other blocks and groups.

    Sets that link agree in a signature. So only signatures that several groups hold matter, and
    of these groups all but the largest ask: each of their sets asks the blocks where another group
    holds the signature, and such a block stores its sets that have a signature of this kind.
    """
    blocks = first.groupBy("root").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    split = store(blocks.where("low <> high").select("root"))
    if split.isEmpty():
        return None
    # leaders have met every set of their cell's blocks, so only own blocks count from here on
    home = first.where("own").join(small_side(split), "root").join(groups, first["key"] == groups["node"], "left").select(
        first["root"], first["key"], "block", F.coalesce(groups["root"], first["key"]).alias("known")
    )
    home = store(home.join(members.select("key", "n"), "key"))
    known = small_side(store(home.select("key", "known")))
    # long texts share many signatures; those that the same sets hold ask for the same, so one is enough
    met_here = store(met.select("sig", "key").join(known, "key", "left_semi").distinct())
    held = store(met_here.join(small_side(store(_telling(met_here))), "sig", "left_semi").join(known, "key"))
    several = held.groupBy("sig").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high")
    several = store(several.select("sig"))
    if several.isEmpty():
        return None
    sizes = store(home.groupBy("known").agg(F.count("*").alias("size")))
    spanning = held.join(small_side(several), "sig", "left_semi").join(small_side(sizes), "known")
    spanning = store(spanning.join(home.select("key", "root", "block", "n"), "key").distinct())

    largest = spanning.groupBy("sig").agg(F.max(F.struct("size", "known"))["known"].alias("main"))
    places = spanning.groupBy("sig", "block").agg(
        F.min("known").alias("low"), F.max("known").alias("high"), F.min("n").alias("shortest"), F.max("n").alias("longest")
    )
    asker = spanning.join(small_side(store(largest)), "sig").where("known <> main").select("sig", "root", "key", "known", "n", F.col("block").alias("mine"))
    other = (F.col("block") != F.col("mine")) & ((F.col("low") != F.col("known")) | (F.col("high") != F.col("known")))
    # and some set there is of a size that could link
    other &= (F.col("shortest") * num <= F.col("n") * den) & (F.col("n") * num <= F.col("longest") * den)
    asking = asker.join(small_side(store(places)), "sig").where(other).select("root", "block", "key", "known").distinct()
    asking = store(asking.join(members.select("key", "n"), "key"))
    # askers of a block in pieces of bounded size; a piece meets the block at once
    count = small_side(store(asking.groupBy("root", "block").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("pieces"))))
    piece = F.pmod(F.xxhash64("key", F.lit(13)), F.col("pieces"))
    asks = asking.join(count, ["root", "block"]).select("root", "block", piece.alias("piece"), "key", "known", F.lit(0).alias("role"))
    stored = spanning.select("root", "block", "key", "known").distinct().join(count, ["root", "block"]).select(
        "root", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), "key", "known", F.lit(1).alias("role")
    )
    return asks.unionAll(stored).select("root", F.xxhash64("block", "piece").alias("block"), "key", "known", "role")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _grouped(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, th, key, n`` of each row: hashes of text and set, size; ``key, least, root`` of each set)."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_hash(F.col("text")).alias("th"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = store(read.mapInArrow(_keys(k), f"doc_id {id_type}, th bigint, key bigint, n bigint, least_item bigint"))

    # parts by count: packed signatures are few bytes for the work they make
    levels = read.sparkSession.sparkContext.broadcast(levels_of(read, k))
    parts = 1 + (read.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    dealt = read.select("text").mapInArrow(_signature_rows(k, num, den, parts, levels), _BLOCK_ROW).repartition(parts, "part")
    met = store(dealt.groupBy("part").applyInArrow(_met_in_part, "sig bigint, key bigint, first bigint"))
    clusters = components(met.select(F.col("key").alias("a"), F.col("first").alias("b")))

    found = clusters.join(keyed, clusters["node"] == keyed["key"])
    by_text = found.groupBy("key", "doc_id", "th").agg(
        F.first("root").alias("root"), F.first("n").alias("n"), F.first("least_item").alias("least_item"), F.count("*").alias("copies")
    )
    members = store(
        by_text.groupBy("key").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("least_item").alias("least_item"), F.min(F.struct("doc_id", "th", "copies")).alias("rep"))
    )
    reps = store(members.select("key", F.col("rep.doc_id").alias("w_id"), F.col("rep.th").alias("w_th"), (F.col("rep.copies") > 1).alias("again")))

    def chosen(places: DataFrame) -> DataFrame:
        """``text, places`` of one document for each key of ``places``."""
        wanted = store(places.join(reps, "key"))
        side = small_side(wanted)
        # if they are too many for a broadcast, only texts that are wanted are shuffled to them
        texts = texts_among(read, wanted) if side is wanted else read
        there = texts.join(side, (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("key", "again", "text", "places")
        if reps.where("again").isEmpty():
            return there.select("text", "places")
        # rows that repeat both id and text stand for one set
        one = there.where("again").groupBy("key").agg(F.first("text").alias("text"), F.first("places").alias("places"))
        return there.where("not again").select("text", "places").unionAll(one.select("text", "places"))

    first = _first_round(members)
    links = _links(first.select("root", "block", "key", F.col("key").alias("known"), F.lit(2).alias("role")), chosen, k, num, den, levels)
    linked = components(links)
    again = _second_round(first, linked, met, members, num, den)
    if again is not None:
        linked = components(links.unionAll(_links(again, chosen, k, num, den, levels)))

    # smallest document of each set, then of each group of sets
    least = keyed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    by_set = least.join(linked, least["key"] == linked["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    return keyed, store(by_set)


def groups(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document of ``doc_id, text``."""
    keyed, by_set = _grouped(docs, k, num, den)
    by_group = store(by_set.groupBy("root").agg(F.min("least").alias("component")))
    named = store(by_set.join(small_side(by_group), "root").select("key", "component"))
    return keyed.join(small_side(named), "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without all but one document of each group; documents without words stay.

    What is decided on is a document, its id and its text: the one with the group's smallest id
    stays (of several texts with that id the one with the smallest hash, without any id as well),
    and of rows equal in both one. A document that merely shares the id of a copy stays.
    """
    keyed, by_set = _grouped(docs.select("doc_id", "text"), k, num, den)
    worded = keyed.where("n > 0")
    placed = store(worded.join(small_side(by_set.select("key", "root")), "key").select("doc_id", "th", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th"))
    several = store(placed.groupBy("root").agg(F.count("*").alias("c"), first.alias("kept")).where("c > 1"))
    named = placed.join(small_side(several), "root")
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th"))
    gone = small_side(store(named.where(~is_kept).select("doc_id", "th").distinct()))
    again = store(named.where(is_kept).groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"))

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["doc_id"].eqNullSafe(right["doc_id"]) & (text_hash(left["text"]) == right["th"])

    left = docs.join(gone, same(docs, gone), "left_anti")
    if again.isEmpty():
        return left
    repeated = small_side(again)
    once = left.join(repeated, same(left, repeated), "left_anti")
    return once.unionAll(left.join(repeated, same(left, repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
