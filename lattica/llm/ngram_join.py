"""N-gram Jaccard join by prefix trees: which documents share 80 of 100 word 5-grams, and the components of these links.

1. Every text becomes its set of 64-bit shingle hashes; equal sets are one class, named by a 64-bit digest of the set.
2. Shingles are dealt by value (packed in blocks, one row for each task and range) and counted: the document frequency over
   classes gives the global order, rarest first. A shingle that ``FREQUENT`` classes of one task hold is last in that order: its
   postings go straight to their classes, so that a line of all documents isn't gathered anywhere. A class whose shared
   shingles are fewer than 80 % of its set can't link and goes.
3. The survivors' prefixes (set size less needed overlap plus one) are joined to blocks: classes that share no prefix shingle,
   directly or through others, never link.
4. A block is stored in a prefix tree over the globally ordered sets, read from the frequent end, where most is shared; classes are
   traversed against it, sharing the overlap of common paths and pruning subtrees by what their remaining lengths could still
   add. Found links join classes at once. A block too large for a task is first traversed, chunk by chunk, against a tree of some
   of its own members (hubs); only classes outside the largest component that gives are then traversed against trees of the
   whole block's chunks. No link between different components is lost.

Null or empty texts have an empty set and link with nothing; a null id takes part but is never the smallest. Repeated rows are
copies of each other. Only doc_id and text are read. Within a range of values shingles are told apart by ``_BITS`` bits, so by
these and the logarithm of the number of ranges in all. Sizes: a task holds the shingles of one value range (about
``SHINGLES_PER_TASK``) or two chunks of ``CHUNK`` classes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph_cc import components

NGRAM = 5
NUM, DEN = 4, 5  # the least similarity, 0.8
CHUNK = 256
HUBS = 12
SHINGLES_PER_TASK = 1_500_000
FREQUENT = 64
_SLICE = 1_000_000
_FLUSH = 1_500_000
_BITS = 48
_KEY_BYTES = _BITS // 8
#: Document frequency that stands for "frequent": the last place in the order, ties by value.
_MOST = 2**31 - 1


# ---- shingles ---------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of a byte (A-Z as a-z), whether it is a blank, and the multipliers of the places in an n-gram."""
    rng = np.random.default_rng(5)
    value = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return value, blank, rng.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, _SLICE + 4096), base, np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): every document's distinct shingle hashes in ascending order, and how many each document has."""
    value, blank, place = _tables()
    n_docs = len(offsets) - 1
    counts = np.zeros(n_docs, np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), counts
    inside = ~blank[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value[raw] * _powers(_BASE, len(raw)), out=total[1:])
    words = _mix((total[ends] - total[starts]) * _powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    per_doc = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    if len(words) >= NGRAM:
        m = len(words) - NGRAM + 1
        grams = np.zeros(m, np.uint64)
        for k in range(NGRAM):
            grams += words[k : k + m] * place[k]
        grams = _mix(grams)
        whole = doc[:m] == doc[NGRAM - 1 :]
    else:
        grams, whole = np.zeros(0, np.uint64), np.zeros(0, bool)
    out = []
    for d in range(n_docs):
        n = per_doc[d]
        if n >= NGRAM:
            got = np.unique(grams[first[d] : first[d] + n - NGRAM + 1])
        elif n:
            seq = words[first[d] : first[d] + n] * place[8 : 8 + n]
            got = _mix(np.array([seq.sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        else:
            continue
        counts[d] = len(got)
        out.append(got)
    assert len(grams) == len(whole)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def digests(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every non-empty document's set (in order), 0 for an empty one."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        begin = (np.cumsum(counts) - counts)[full]
        out[full] = _mix(np.add.reduceat(_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), begin) + counts[full].astype(np.uint64))
    return out


def _doc_slices(batch, column: int):
    """(first row, last row, hashes, counts) for slices of a batch of bounded bytes."""
    raw, offsets = common.text_bytes(batch.column(column))
    for i, j in common.row_slices(np.diff(offsets), _SLICE):
        yield i, j, *shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def document_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_shingles, cls): a row for each row of ``docs``; ``cls`` is null for an empty set."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("text"))
    names = rows.columns[:-1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for i, j, hashes, counts in _doc_slices(batch, len(names)):
                n[i:j], cls[i:j] = counts, digests(hashes, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(cls.view(np.int64), mask=n == 0)], [*names, "n_shingles", "cls"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, n_shingles long, cls long")


# ---- frequencies ------------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray, n_bytes: int) -> bytes:
    """Little-endian bytes, plane by plane: sorted values then compress well on their way through the shuffle."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def _unplanes(data: bytes, n_bytes: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(n_bytes, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n_bytes] = planes.T
    return out.view(np.uint64).ravel()


#: kind 0: postings to be counted in their range; 1: counted postings, for their classes' range; 2: frequent keys of a range.
_BLOCK = "part int, kind int, classes binary, sizes binary, keys binary, idx binary, freq binary"


def _blocks(kind: int, part: np.ndarray, classes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, idx: np.ndarray, freq: np.ndarray | None):
    """Rows of ``_BLOCK``, one for each part: its keys ascending, with the classes they belong to (by place in ``classes``)."""
    import pyarrow as pa

    order = np.lexsort((keys, part))
    part, keys, idx = part[order], keys[order], idx[order]
    freq = freq[order] if freq is not None else None
    bounds = np.flatnonzero(np.diff(part, prepend=-1))
    for s, e in zip(bounds, np.append(bounds[1:], len(part)), strict=True):
        used, local = np.unique(idx[s:e], return_inverse=True)
        row = (classes[used].tobytes(), _planes(sizes[used], 4), _planes(keys[s:e], _KEY_BYTES if freq is None else 8), _planes(local, 3), _planes(freq[s:e], 4) if freq is not None else b"")
        yield pa.RecordBatch.from_arrays([pa.array([int(part[s])], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], _BLOCK_NAMES)


_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


def _read_blocks(rows: list[tuple], key_bytes: int):
    """(cls, size, keys, freq) of all postings in (classes, sizes, keys, idx, freq) rows; None without any."""
    cls, size, keys, freq = [], [], [], []
    for c, s, k, i, f in rows:
        at = _unplanes(i, 3).astype(np.int64)
        cls.append(np.frombuffer(c, np.uint64)[at])
        size.append(_unplanes(s, 4)[at].astype(np.uint32))
        keys.append(_unplanes(k, key_bytes))
        if f:
            freq.append(_unplanes(f, 4).astype(np.uint32))
    if not cls:
        return None
    return tuple(np.concatenate(x) if x else None for x in (cls, size, keys, freq))


def _runs(keys: np.ndarray) -> np.ndarray:
    """How often each of the sorted keys is there, key by key."""
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    return np.diff(np.append(np.flatnonzero(new), len(keys)))[np.cumsum(new) - 1] if len(keys) else np.zeros(0, np.int64)


def shared_sets(docs: DataFrame, parts: int, *, text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(cls, n, tokens, dfs): the classes that share enough shingles with others, the shared ones in the global order (dfs, tokens)."""

    def deal(batches):
        import pyarrow as pa

        seen: set[int] = set()
        held: list[tuple] = []
        used = 0

        def flush():
            hashes = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            cls = np.concatenate([h[2] for h in held])
            idx = np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(hashes, kind="stable")
            common_here = np.empty(len(hashes), bool)
            common_here[order] = _runs(hashes[order]) >= frequent
            part = (hashes % np.uint64(parts)).astype(np.int64)
            keys = (hashes // np.uint64(parts)) & np.uint64(2**_BITS - 1)
            rare = ~common_here
            yield from _blocks(0, part[rare], cls, counts, keys[rare], idx[rare], None)
            if common_here.any():
                part, keys, idx = part[common_here], keys[common_here], idx[common_here]
                yield from _blocks(1, (cls[idx] % np.uint64(parts)).astype(np.int64), cls, counts, keys * np.uint64(parts) + part.astype(np.uint64), idx, np.full(len(idx), _MOST))
                for p in np.unique(part).tolist():
                    blank = pa.array([b""], pa.binary())
                    mine = pa.array([_planes(np.unique(keys[part == p]), _KEY_BYTES)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([2], pa.int32()), blank, blank, mine, blank, blank], _BLOCK_NAMES)

        for batch in batches:
            for _, _, hashes, counts in _doc_slices(batch, 0):
                cls = digests(hashes, counts)
                fresh = np.zeros(len(cls), bool)
                for i, c in enumerate(cls.tolist()):  # copies within a task are dealt once
                    if counts[i] and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                if fresh.any():
                    held.append((hashes[np.repeat(fresh, counts)], counts[fresh], cls[fresh]))
                    used += len(held[-1][0])
                if used > _FLUSH:
                    yield from flush()
                    held, used = [], 0
        if held:
            yield from flush()

    def count(batches):
        """Frequencies of a range's keys; what is counted already passes through."""
        import pyarrow.compute as pc

        number, rows, common_keys = 0, [], []
        for batch in batches:
            done = batch.filter(pc.equal(batch.column(1), 1))
            if done.num_rows:
                yield done
            for part, kind, *row in zip(*(c.to_pylist() for c in batch.filter(pc.not_equal(batch.column(1), 1)).columns), strict=True):
                number = part
                if kind == 0:
                    rows.append(row)
                else:
                    common_keys.append(_unplanes(row[2], _KEY_BYTES))
        got = _read_blocks(rows, _KEY_BYTES)
        if got is None:
            return
        cls, size, keys, _ = got
        often = np.isin(keys, np.unique(np.concatenate(common_keys))) if common_keys else np.zeros(len(keys), bool)
        order = np.argsort(keys, kind="stable")
        order = order[(_runs(keys[order]) > 1) | often[order]]
        order = order[np.lexsort((cls[order], keys[order]))]
        cls, size, keys, often = cls[order], size[order], keys[order], often[order]
        once = np.append(True, (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1]))[: len(keys)]
        cls, size, keys, often = cls[once], size[once], keys[once], often[once]
        df = np.where(often, _MOST, np.minimum(_runs(keys), _MOST - 1))
        two = df > 1
        cls, size, keys, df = cls[two], size[two], keys[two], df[two]
        if len(keys):
            names, first, idx = np.unique(cls, return_index=True, return_inverse=True)
            yield from _blocks(1, (cls % np.uint64(parts)).astype(np.int64), names, size[first].astype(np.int64), keys * np.uint64(parts) + np.uint64(number), idx, df)

    def gather(batches):
        import pyarrow as pa

        got = _read_blocks([row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)], 8)
        if got is None:
            return
        cls, size, token, df = got
        order = np.lexsort((token, df, cls))
        cls, size, token, df = cls[order], size[order], token[order], df[order]
        once = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))  # frequent ones come from each task that met the class
        cls, size, token, df = cls[once], size[once], token[once], df[once].astype(np.int32)
        begin = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        end = np.append(begin[1:], len(cls))
        keep = DEN * (end - begin) >= NUM * size[begin].astype(np.int64)
        for lo in range(0, len(begin), 2000):
            rows = [(int(b), int(e)) for b, e, k in zip(begin[lo : lo + 2000], end[lo : lo + 2000], keep[lo : lo + 2000], strict=True) if k]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([cls[b] for b, _ in rows], np.uint64).view(np.int64)), pa.array([int(size[b]) for b, _ in rows], pa.int32()),
                     pa.array([token[b:e].view(np.int64) for b, e in rows], pa.list_(pa.int64())), pa.array([df[b:e] for b, e in rows], pa.list_(pa.int32()))],
                    ["cls", "n", "tokens", "dfs"],
                )

    dealt = docs.select(F.col(text_col).alias("text")).mapInArrow(deal, _BLOCK)
    counted = dealt.repartitionById(parts, F.col("part")).mapInArrow(count, _BLOCK)
    return counted.repartitionById(parts, F.col("part")).mapInArrow(gather, "cls long, n int, tokens array<bigint>, dfs array<int>")


# ---- prefix tree ------------------------------------------------------------------------------------------------------


class _Node:
    __slots__ = ("run", "kids", "rows", "least", "most", "last")

    def __init__(self, run: np.ndarray):
        self.run = run  # the tokens from the parent to here
        self.kids: dict[int, _Node] = {}
        self.rows: list[int] = []  # sets that end here
        self.least = self.most = 0  # sizes (whole sets) of the sets below
        self.last = int(run[-1]) if len(run) else -1


class PrefixTree:
    """Ordered integer sets in a tree with one node for a run of tokens. ``sizes`` may exceed a set's stored tokens (those no other has)."""

    def __init__(self) -> None:
        self.root = _Node(np.zeros(0, np.int64))

    def add(self, row: int, tokens: np.ndarray, size: int) -> None:
        node, at = self.root, 0
        self._note(node, size)
        while at < len(tokens):
            kid = node.kids.get(int(tokens[at]))
            if kid is None:
                kid = node.kids[int(tokens[at])] = _Node(tokens[at:])
                self._note(kid, size)
                kid.rows.append(row)
                return
            n = min(len(kid.run), len(tokens) - at)
            differs = np.flatnonzero(kid.run[:n] != tokens[at : at + n])
            same = int(differs[0]) if len(differs) else n
            if same < len(kid.run):  # split the run
                upper = _Node(kid.run[:same])
                upper.least, upper.most = kid.least, kid.most
                kid.run = kid.run[same:]
                upper.kids[int(kid.run[0])] = kid
                node.kids[int(tokens[at])] = upper
                kid = upper
            self._note(kid, size)
            node, at = kid, at + same
        node.rows.append(row)

    @staticmethod
    def _note(node: _Node, size: int) -> None:
        node.least = min(node.least, size) if node.most else size
        node.most = max(node.most, size)

    def linked(self, tokens: np.ndarray, size: int, width: int, skip):
        """Rows whose sets have the similarity with ``tokens``; ``skip(row)`` rows are passed by without being compared."""
        there = np.zeros(width, bool)
        there[tokens] = True
        todo = [(kid, 0) for kid in self.root.kids.values()]
        while todo:
            node, overlap = todo.pop()
            # The sizes alone: 80 % of the larger must be there in the smaller.
            if NUM * size > DEN * node.most or NUM * node.least > DEN * size:
                continue
            if not node.kids and all(skip(r) for r in node.rows):
                continue
            overlap += int(np.count_nonzero(there[node.run]))
            rest = len(tokens) - int(np.searchsorted(tokens, node.last, side="right"))
            # The overlap needed with the smallest set below, against what can still be added.
            if 9 * (overlap + rest) < 4 * (size + node.least):
                continue
            for r in node.rows:
                yield r, overlap
            todo.extend((kid, overlap) for kid in node.kids.values())


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def tree_links(cls: list[int], sizes: list[int], tokens: list[np.ndarray], dfs: list[np.ndarray], stored: list[bool], probing: list[bool], group: list[int]) -> list[tuple[int, int]]:
    """Links that join components: probing sets against stored ones, by a prefix tree. ``group``: components known so far."""
    # Numbers in the global order (frequency, then value), from its frequent end: paths are shared there.
    everything, first = np.unique(np.concatenate(tokens), return_index=True) if tokens else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    frequency = np.concatenate(dfs)[first] if tokens else np.zeros(0, np.int64)
    rank = np.empty(len(everything), np.int64)
    rank[np.lexsort((everything, frequency))[::-1]] = np.arange(len(everything))
    local = [np.sort(rank[np.searchsorted(everything, t)]) for t in tokens]
    parent = list(range(len(cls)))
    known: dict[int, int] = {}
    for i, g in enumerate(group):
        parent[_find(parent, i)] = _find(parent, known.setdefault(g, i))
    tree, links, width = PrefixTree(), [], len(everything)

    def probe(i: int) -> None:
        home = _find(parent, i)
        for r, overlap in list(tree.linked(local[i], sizes[i], width, lambda r: _find(parent, r) == home)):
            if 9 * overlap >= 4 * (sizes[i] + sizes[r]) and _find(parent, r) != _find(parent, i):
                parent[_find(parent, r)] = _find(parent, i)
                links.append((cls[i], cls[r]))

    for i in range(len(cls)):
        if stored[i] and not probing[i]:
            tree.add(i, local[i], sizes[i])
    for i in range(len(cls)):
        if stored[i] and probing[i]:
            probe(i)
            tree.add(i, local[i], sizes[i])
    for i in range(len(cls)):
        if probing[i] and not stored[i]:
            probe(i)
    return links


def _tree_group(table):
    """The links of a task: those of one pair of chunks, or of several small blocks one by one."""
    import pyarrow as pa

    block = table.column("block").to_numpy()
    order = np.lexsort((table.column("cls").to_numpy(), block))
    table, block = table.take(pa.array(order)), block[order]
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    links = []
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(block)], strict=True):
        part = table.slice(s, e - s)
        lists = [[np.array(t, np.int64) for t in part.column(c).to_pylist()] for c in ("tokens", "dfs")]
        links += tree_links(part.column("cls").to_pylist(), part.column("n").to_pylist(), *lists, *(part.column(c).to_pylist() for c in ("stored", "probing", "grp")))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


# ---- join -------------------------------------------------------------------------------------------------------------


def class_links(sets: DataFrame, *, chunk: int = CHUNK, hubs: int = HUBS) -> DataFrame:
    """Links (a, b) between classes of ``sets`` (cls, n, tokens, dfs) that give the same components as all links do."""
    need = F.ceil(F.col("n") * F.lit(NUM) / F.lit(DEN)).cast("int")
    prefix = F.col("n") - need + 1 - (F.col("n") - F.size("tokens"))
    posting = sets.select("cls", F.explode(F.slice("tokens", F.lit(1), prefix)).alias("token"))
    heads = posting.groupBy("token").agg(F.min("cls").alias("head"), F.count("*").alias("df")).where("df > 1").drop("df")
    block = written_components(posting.join(heads, "token").where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b")))
    # Sizes are joined to names alone; the token lists travel once to their block's row and once to their task.
    size = block.groupBy("root").agg(F.count("*").alias("size"))
    placed = block.join(size, "root").select(F.col("node").alias("cls"), F.col("root").alias("block"), "size")
    sized = common.written(sets.hint("merge").join(placed, "cls"), "members")
    common.free(block)
    names = ["cls", "n", "tokens", "dfs", "stored", "probing", "grp", "block", "task", "i", "j"]
    mine = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), n).cast("int")
    grouped = lambda df: df.groupBy("task", "i", "j").applyInArrow(_tree_group, "a long, b long")

    few = sized.where(F.col("size") <= chunk)
    tasks = max(1, few.count() // chunk)  # small blocks share tasks of about a chunk
    small = few.withColumns({"stored": F.lit(True), "probing": F.lit(True), "grp": F.col("cls"), "task": F.pmod(F.xxhash64("block", F.lit(5)), F.lit(tasks)), "i": F.lit(-1), "j": F.lit(-1)})
    found = grouped(small.select(names))

    large = sized.where(F.col("size") > chunk).withColumn("task", F.col("block"))
    if large.isEmpty():
        return found
    # Hubs: about ``hubs`` members of each block, by a hash of their names, stored for each chunk of the others.
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    pick = F.pmod(F.xxhash64("cls"), F.greatest(F.lit(1), F.floor(F.col("size") / hubs)).cast("long")) == 0
    hub = large.where(pick).withColumns({"stored": F.lit(True), "probing": F.lit(False), "grp": F.col("cls"), "j": F.lit(-1)}).withColumn("i", F.explode(F.sequence(F.lit(0), chunks - 1)))
    others = large.where(~pick).withColumns({"stored": F.lit(False), "probing": F.lit(True), "grp": F.col("cls"), "j": F.lit(-1), "i": mine(chunks, 1)})
    hub_links = common.written(grouped(hub.select(names).unionByName(others.select(names))), "hub-links")
    near = components(hub_links)
    labelled = large.select("cls", "block", "size").join(near.select(F.col("node").alias("cls"), F.col("root").alias("grp")), "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    labelled = common.written(labelled, "labelled")
    per_group = labelled.groupBy("block", "size", "grp").agg(F.count("*").alias("k"))
    main = per_group.groupBy("block", "size").agg(F.max_by("grp", F.struct("k", "grp")).alias("main"), (F.sum("k") - F.max("k")).alias("others")).where("others > 0")
    todo = labelled.join(main.drop("size"), "block").join(large.select("cls", "n", "tokens", "dfs", "task"), "cls")
    probe_chunks = F.ceil(F.col("others") / chunk).cast("int")
    stored = todo.withColumns({"stored": F.lit(True), "probing": F.lit(False), "j": mine(chunks, 1)}).withColumn("i", F.explode(F.sequence(F.lit(0), probe_chunks - 1)))
    probing = todo.where("grp <> main").withColumns({"stored": F.lit(False), "probing": F.lit(True), "i": mine(probe_chunks, 2)}).withColumn("j", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return found.unionByName(hub_links).unionByName(grouped(stored.select(names).unionByName(probing.select(names))))


def written_components(edges: DataFrame) -> DataFrame:
    return common.written(components(edges), "components")


def class_roots(docs: DataFrame, sets: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(cls, root) of the classes that link with others; ``sets`` are the documents' own (written)."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(common.n_parts(docs.sparkSession), -(-total // SHINGLES_PER_TASK))
    shared = common.written(shared_sets(docs, parts, text_col=text_col), "shared-sets")
    found = written_components(class_links(shared))
    common.free(shared)
    return found.select(F.col("node").alias("cls"), "root")


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each row of ``docs``."""
    common.ship(docs.sparkSession)
    sets = common.written(document_sets(docs, id_col=id_col, text_col=text_col), "document-sets")
    root = class_roots(docs, sets, text_col=text_col)
    classes = sets.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = common.written(rooted.join(least, "root").select("cls", "component_id"), "class-components")
    return sets.join(of_class, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each component (that of the smallest id), with all its columns of any names.

    Rows are told apart by all their columns (a 128-bit hash), not by their ids: of rows that repeat an id with different texts
    each stays or goes by its own text's component, and of near copies with one id, or without an id, one stays. Among equal ids the
    row of the least hash stays, a null id comes last; of rows equal in every column one stays. Null and empty texts and texts
    without a word link with nothing: all their rows stay. An empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    k1, k2 = common.unused(docs, "_k1", "_k2")
    facts = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    keyed = docs.withColumns({k1: F.xxhash64(*facts, F.lit(1)), k2: F.xxhash64(*facts, F.lit(2))})
    sets = common.written(document_sets(keyed.select("doc_id", "text", F.col(k1).alias("k1"), F.col(k2).alias("k2")), keep=("k1", "k2")), "document-sets")
    linked = sets.where("cls IS NOT NULL")
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")
    classes = linked.groupBy("cls").agg(F.min(name).alias("first"))
    rooted = classes.join(class_roots(docs, sets), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    of_class = common.written(rooted.join(least, "root").select("cls", F.col("stays.k1").alias("s1"), F.col("stays.k2").alias("s2")), "class-components")
    rows = linked.join(of_class, "cls")
    gone = rows.where("k1 <> s1 OR k2 <> s2").select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    repeated = common.written(rows.where("k1 = s1 AND k2 = s2").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    # The list of those that go grows with the table: never broadcast, at any size.
    kept = keyed.join(gone.hint("merge"), [k1, k2], "left_anti")
    if not repeated.isEmpty():
        kept = kept.join(repeated.hint("merge"), [k1, k2], "left_anti").unionByName(kept.join(repeated.hint("merge"), [k1, k2], "left_semi").dropDuplicates([k1, k2]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(common.table(spark, sf_dir, "documents"))
