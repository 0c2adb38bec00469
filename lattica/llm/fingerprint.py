"""Document fingerprints by improbable features.

A text's UTF-8 bytes are read through windows of 8 bytes, of 16 as well where it has 64 bytes or more, and of 64 as well where it
has 512 or more. A window's Shannon entropy, kept up byte by byte, says how likely it is to be met by chance: the nearer it is to what ordinary text has, the more common; the rank of a window is its distance from
there, and windows of little entropy (runs, padding) are left out. A window with the best rank among its neighbours is a
feature. Features go, in order, into a chain of Bloom filters of 2048 bits, five bits each, at most 160 features to a filter;
each width has a chain of its own, and a filter comes after a byte that tells its width. The likeness of two fingerprints
is that of their chains of the largest width both have, so that texts of any two sizes are comparable. It compares each filter
of the shorter chain with its best match in the other: the bits in common beyond those expected by chance, over the most there
could be, averaged.

A text of under 8 bytes has one feature, itself; an empty (or null) one has none and an empty fingerprint. Two empty
fingerprints have likeness 1, an empty and another one 0; equal texts have equal fingerprints and likeness 1.

Documents are ordered by doc_id, nulls first, then by a hash of their text, so that repeated ids have a defined order. Extra
columns are not read. One document alone is its own next document. An empty table gives no rows. Ranges of that order are dealt
to tasks; only the first row of each range goes to two tasks.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 64
LEAST_WIDTH = 8
#: Widths, widest first, and the bytes a text has at least for each.
WIDTHS = ((WINDOW, 512), (16, 64), (LEAST_WIDTH, 0))
BITS = 2048
PER_FILTER = 160
PROBES = 5
BYTES_PER_TASK = 32_000_000
BYTES_PER_RUN = 32_000
MOST_RANGES = 20_000
_SCALE = 1 << 20
#: Entropy of ordinary text in a window, and what a window needs to count, as shares of the most there can be.
_TYPICAL, _LEAST = 0.68, 0.33


@lru_cache(maxsize=1)
def _gain() -> np.ndarray:
    """What one more occurrence adds to the sum of c*log2(c), scaled to integers, by the count before."""
    c = np.arange(WINDOW + 2, dtype=np.float64)
    f = np.zeros(WINDOW + 2)
    f[1:] = c[1:] * np.log2(c[1:])
    return np.rint(np.diff(f) * _SCALE).astype(np.int64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(23).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _equal_near(raw: np.ndarray, ends: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: for each of the first ``ends[width]`` bytes, how many of the width - 1 bytes after and before it equal it.

    A wider window goes on from the counts of the narrower one, over no more bytes than that.
    """
    ahead, behind = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)
    out, done = {}, 1
    for width in sorted(ends):
        end = ends[width]
        for lag in range(done, min(width, end)):
            same = (raw[lag:end] == raw[: end - lag]).view(np.uint8)
            behind[lag:end] += same
            ahead[: end - lag] += same
        out[width], done = (ahead[:end].copy(), behind[:end].copy()), width
    return out


def _entropies(raw: np.ndarray, width: int, starts: np.ndarray | None = None, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Scaled entropy sums (sum of c*log2(c)) of all windows of ``raw``, texts of at least one window that begin at ``starts``.

    Windows that reach into the next text have no meaning.
    """
    n = len(raw)
    starts = np.zeros(1, np.int64) if starts is None else starts
    ahead, behind = _equal_near(raw, {width: n})[width] if near is None else near
    gain = _gain()
    first = np.sort(raw[starts[:, None] + np.arange(width)], axis=1)
    place = np.broadcast_to(np.arange(width), first.shape)
    begins = np.zeros(first.shape, np.int64)
    begins[:, 1:] = np.where(first[:, 1:] != first[:, :-1], place[:, 1:], 0)
    start = gain[place - np.maximum.accumulate(begins, axis=1)].sum(axis=1)
    sums = np.zeros(n - width + 1, np.int64)
    np.cumsum(gain[behind[width:]] - gain[ahead[: n - width]], out=sums[1:])
    return sums + np.repeat(start - sums[starts], np.diff(starts, append=n))[: len(sums)]


def _ranks(sums: np.ndarray, width: int) -> np.ndarray:
    """Rarity of the windows, lower is rarer; windows that don't count get the largest value."""
    entropy = 1 - sums / (_SCALE * width * np.log2(width))
    rank = (65_000 - np.abs(entropy - _TYPICAL) * 65_000).astype(np.int32)
    rank[entropy < _LEAST] = 1 << 30
    return rank


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _selected(raw: np.ndarray, width: int, starts: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where the features of a width start, in texts of at least that many bytes that begin at ``starts``."""
    reach = width // 2  # a feature has the best rank within this many windows on either side, which is short of the next text's
    rank = _ranks(_entropies(raw, width, starts, near), width).astype(np.int64)
    across = (starts[1:, None] - np.arange(1, width)).ravel()
    rank[across] = 1 << 30
    # Of equal ranks the leftmost is best; texts without any window that counts have one feature, their first window.
    key = rank * (len(raw) + 1) + np.arange(len(rank))
    padded = np.full(len(key) + 2 * reach, np.iinfo(np.int64).max)
    padded[reach : reach + len(key)] = key
    at = np.flatnonzero((key == _window_min(padded, 2 * reach + 1)) & (rank < 1 << 30))
    found = np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(starts))
    return np.sort(np.concatenate([at, starts[found == 0]]))


def _hashes(total: np.ndarray, size: int, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    h = (total[at + width] - total[at]) * _powers(_INVERSE, size)[at] + np.asarray(width).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _filters(h: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, width and filter) of the chains of a width: ``h`` are the features of the texts ``owner`` (ascending), in order."""
    counts = np.bincount(owner)
    chain = -(-counts // PER_FILTER)
    nth = np.arange(len(h)) - (np.cumsum(counts) - counts)[owner]
    bits = np.zeros((chain.sum(), BITS), bool)
    at = (h[:, None] >> (np.arange(PROBES, dtype=np.uint64) * np.uint64(11))) & np.uint64(BITS - 1)
    bits[np.repeat((np.cumsum(chain) - chain)[owner] + nth // PER_FILTER, PROBES), at.ravel().astype(np.int64)] = True
    return np.repeat(np.arange(len(chain)), chain), np.concatenate([np.full((len(bits), 1), width, np.uint8), np.packbits(bits, axis=1)], axis=1)


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """The chains of Bloom filters of each text, widest first: (filters, 1 + 256) bytes, the first of each its width.

    The texts are read as one run of bytes, largest first, so that those with a width stand together.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    raw = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    starts = np.cumsum(lengths) - lengths
    size = 1 << max(12, (len(raw) + 1).bit_length())
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_values()[raw] * _powers(_BASE, size)[: len(raw)], out=total[1:])
    last = np.cumsum(lengths)
    held = {width: int((lengths >= max(width, least)).sum()) for width, least in WIDTHS}
    ends = {width: int(last[k - 1]) for width, k in held.items() if k}
    near = _equal_near(raw, ends)
    owners, rows = [], []
    for width, end in ends.items():
        own = starts[: held[width]]
        at = _selected(raw[:end], width, own, near[width])
        found = _filters(_hashes(total, size, at, width), np.searchsorted(own, at, "right") - 1, width)
        owners.append(found[0])
        rows.append(found[1])
    # A text under the least width is one feature.
    short = np.flatnonzero((lengths > 0) & (lengths < LEAST_WIDTH))
    if len(short):
        found = _filters(_hashes(total, size, starts[short], lengths[short]), np.arange(len(short)), LEAST_WIDTH)
        owners.append(short[found[0]])
        rows.append(found[1])
    out = [np.zeros((0, 1 + BITS // 8), np.uint8)] * len(texts)
    if rows:
        owner, chains = np.concatenate(owners), np.concatenate(rows)
        by_text = np.argsort(owner, kind="stable")
        for i, chain in zip(order, np.split(chains[by_text], np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]), strict=True):
            out[i] = chain
    return out


def digest(data: bytes) -> np.ndarray:
    return digests([data])[0]


def digests_by_run(texts: list[bytes]) -> list[np.ndarray]:
    """``digests`` of any number of texts, in runs of about ``BYTES_PER_RUN`` (a longer text stands alone)."""
    return [d for a, b in common.row_slices(np.array([len(t) for t in texts]), BYTES_PER_RUN) for d in digests(texts[a:b])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two fingerprints at the largest width both have, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    width = min(a[0, 0], b[0, 0])
    a, b = a[a[:, 0] == width, 1:], b[b[:, 0] == width, 1:]
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    nx, ny = x.sum(1)[:, None], y.sum(1)[None, :]
    most = np.minimum(nx, ny)
    chance = nx * ny / BITS + 0.1 * (most - nx * ny / BITS)  # a tenth above the expected overlap still counts as none
    score = np.clip((x @ y.T - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float(score.max(1).mean())


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 1 + BITS // 8)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of ``text``'s code points replaced by the first as many of ``following`` (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_task: int = BYTES_PER_TASK) -> tuple[DataFrame, int]:
    """Rows (doc_id, h, text, part, ghost) by ranges of (doc_id, hash of the text). The first row of a range comes a second time, as
    the ghost that ends the range before (that of the whole table ends the last one).

    There are at most about ``MOST_RANGES`` ranges (a task streams through its sorted rows, so that a longer range needs no more
    memory); an id of very many rows, or the null id, is split by hash. The driver reads one quantile and one first row a range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    n, known, chars = docs.agg(F.count("*"), F.count(id_col), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    wanted = max(1, min(max(common.n_parts(spark), -(-chars // per_task)), n, MOST_RANGES))
    quantiles = [i / wanted for i in range(1, wanted)]
    found = (docs.select(F.percentile_approx(F.col(id_col).cast("long"), quantiles, 100_000)).first()[0] or []) if quantiles else []
    # A quantile met twice is an id of more than a range's rows: it gets a range of its own, cut by hash as often as it was met.
    times = {c: found.count(c) for c in set(found)}
    cuts = sorted({c + d for c, k in times.items() for d in ((0, 1) if k > 1 and c < 2**63 - 1 else (0,))})
    slices = [-(-(n - known) * wanted // max(1, n)) or 1, 1, *[times.get(c, 1) for c in cuts]]  # null ids, ids below the first cut, then cut by cut
    first = [sum(slices[:i]) for i in range(len(slices))]
    held = F.lit(cuts or [0]).cast("array<bigint>")
    steps = [1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))]
    reach = lambda at, step: (at + step <= len(cuts)) & (F.element_at(held, F.least(at + step, F.lit(max(1, len(cuts))))) <= F.col("doc_id"))
    at = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(reach(at, step), at + step).otherwise(at)) + 2)
    share = F.col("h") / F.lit(2.0**64) + 0.5
    of = lambda values: F.element_at(F.lit(values).cast("array<int>"), F.col("_at"))
    placed = rows.withColumn("_at", at).withColumn("part", of(first) + F.least(F.floor(share * of(slices)), of(slices) - 1).cast("int")).drop("_at")
    parts = sum(slices)
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.col("h").alias("h"))).alias("k")
    firsts = sorted(placed.groupBy("part").agg(least).collect(), key=lambda r: r.part)
    ends = [(r.k.known, r.k.id if r.k.known else 0, r.k.h, firsts[i - 1].part) for i, r in enumerate(firsts)]
    # As many rows as ranges, which are bounded: small enough to broadcast whatever the table's size.
    before = F.broadcast(spark.createDataFrame(ends, "known boolean, first_id long, first_h long, before int"))
    met = (F.col("doc_id").isNotNull() == F.col("known")) & (F.coalesce(F.col("doc_id"), F.lit(0)) == F.col("first_id")) & (F.col("h") == F.col("first_h"))
    # One row a range: of several with the first id and hash, only the first by text.
    ghosts = rows.join(before, met).groupBy("before").agg(F.min_by(F.struct("doc_id", "h", "text"), F.col("text")).alias("r")).select("r.*", F.col("before").alias("part"), F.lit(True).alias("ghost"))
    return placed.withColumn("ghost", F.lit(False)).unionByName(ghosts), parts


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and likenesses to that and to the next document."""
    common.ship(docs.sparkSession)
    rows, parts = ranges(docs, id_col=id_col, text_col=text_col)

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None
        for batch in batches:
            ids, texts, ghosts = (batch.column(k).to_pylist() for k in range(3))
            rows = list(zip(ids, texts, ghosts, digests_by_run([t.encode() for t in texts]), strict=True))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1] if rows else None
            pairs = [(own, following) for own, following in zip(rows, rows[1:]) if not own[2]]
            changed = [edited(own[1], following[1]) for own, following in pairs]
            out = []
            for (own, following), text, chain in zip(pairs, changed, digests_by_run([t.encode() for t in changed]), strict=True):
                i, before, _, mine = own
                sha = hashlib.sha256(text.encode()).hexdigest()
                out.append((i, len(before), sha, encode(mine), encode(chain), likeness(mine, chain), likeness(mine, following[3])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("ghost", F.col("doc_id").asc_nulls_first(), "h", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "ghost").mapInArrow(run, schema)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(common.table(spark, sf_dir, "documents"))
