"""Mixture-controlled packing: deficit round-robin over source queues fills fixed windows of tokens.

Documents are tokenised whole and end with an end id. A hash deals them to shards; a shard holds a queue for each source. The
queues are served in rounds. In each round a source's deficit grows by its target share of the round's ``quantum`` tokens for
each queue, and what the deficit covers is served, a document after the other, cut where the deficit or the window ends. What is
left of a deficit goes on to the next round, over windows; and to the next shard as well: every shard packs all it holds, so what
the shards before it leave over is known from token counts alone, and each shard starts with that. A queue that is empty drops
out and its share of a round goes to the others.

Every document is packed, so by default the target shares are the sources' shares of all tokens; ``weights`` gives others.
Windows hold 4096 tokens; what a shard has beyond whole windows goes into windows of descending powers of two, which need no
padding. Offsets in a window are gapless from 0.

Null text counts as empty (the end id alone); null sources are one source; repeated rows are documents of their own; an empty
table gives no rows. Only doc_id, text and source are read. A shard has about ``TOKENS_PER_SHARD`` tokens.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
QUANTUM = 1024
END = 2
TOKENS_PER_SHARD = 2_000_000
TOKENIZER = "word_bpe_49k.json"
#: Words a worker remembers; at the end of that it starts anew.
_CACHE_WORDS = 400_000

_TOKENIZERS: dict[str, tuple] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoder(path: str):
    """(tokenizer, whether an id ends a word, cache of a word's 16-bit ids). Kept for the worker's life."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        vocabulary = tok.get_vocab()
        if len(vocabulary) > 65536:
            raise ValueError("ids over 16 bits")
        ends = np.zeros(65536, bool)
        ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        _TOKENIZERS[path] = (tok, ends, {"": b""})
    return _TOKENIZERS[path]


#: Bytes of Latin-1 letters, ASCII digits and the blanks between words.
_LETTERS = bytes(i for i in range(256) if chr(i).isalpha() or chr(i) in "0123456789 \n")


def _plain(text: str) -> str:
    """A text of the same ids with fewer distinct words between its blanks: lower case, commas and full stops on their own.

    Only where that can't matter: no special token, nothing beyond Latin-1 (no composition, no case that depends on context), and
    no comma or stop beside another sign, with which the splitter would take it together.
    """
    if "<|" in text:
        return text.replace("\n", " ")
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ")
    text = text.lower().replace("\n", " ")
    signs = raw.translate(None, _LETTERS)
    if signs and not signs.translate(None, b".,") and not (".." in text or ".," in text or ",." in text or ",," in text):
        return text.replace(".", " . ").replace(",", " , ")
    return text


def _learn(words: set[str], tok, ends: np.ndarray, cache: dict[str, bytes]) -> None:
    """Encode the words into the cache. A word of letters alone is one piece for the splitter: such words are encoded together, with
    blanks between, and cut apart behind the ids that end a word."""
    letters = [w for w in words if w.isalpha()]
    rest = [w for w in words if not w.isalpha()]
    for k in range(0, len(letters), 2000):
        part = letters[k : k + 2000]
        ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u2")
        stops = ((np.flatnonzero(ends[ids]) + 1) * 2).tolist()
        if len(stops) != len(part):  # a letter that the splitter takes for something else: each on its own
            rest += part
            continue
        raw = ids.tobytes()
        cache.update(zip(part, [raw[i:j] for i, j in zip([0, *stops], stops, strict=False)], strict=True))
    for k in range(0, len(rest), 2000):
        part = rest[k : k + 2000]
        for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
            cache[w] = np.array(e.ids, "<u2").tobytes()


def _holes(ids: list[bytes | None]):
    """Places of words that aren't known yet."""
    at, n = -1, ids.count(None)
    for _ in range(n):
        at = ids.index(None, at + 1)
        yield at


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """16-bit ids of every whole text (without the end id), as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The tokenizer's normaliser and splitter never look across a blank, so words between blanks are encoded once and remembered.
    """
    tok, ends, cache = _encoder(path)
    out = []
    for lo in range(0, len(texts), 500):
        split = [_plain(t).split(" ") for t in texts[lo : lo + 500]]
        if len(cache) > _CACHE_WORDS:
            cache.clear()
            cache[""] = b""
        known = [list(map(cache.get, words)) for words in split]
        holes = [(k, i) for k, ids in enumerate(known) for i in _holes(ids)]
        if holes:
            _learn({split[k][i] for k, i in holes}, tok, ends, cache)
            for k, i in holes:
                known[k][i] = cache[split[k][i]]
        out += map(b"".join, known)
    return out


def tokenize(docs: DataFrame, *, path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, source, ord, n, ids): ids as 16-bit bytes with the end id; ``ord`` is a hash for shards and queues."""
    spark = docs.sparkSession
    common.ship(spark)
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("doc_id", "source", "text").alias("ord"), "text")

    def run(batches):
        import pyarrow as pa

        tail = np.array([end], "<u2").tobytes()
        for batch in batches:
            texts = batch.column(3)
            for lo, hi in common.row_slices(np.diff(common.text_bytes(texts)[1]), 8_000_000):
                ids = [x + tail for x in encode_texts([t or "" for t in texts[lo:hi].to_pylist()], path)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "ord", "n", "ids"])

    return rows.mapInArrow(run, "doc_id long, source string, ord long, n long, ids binary")


def windows_of(tokens: int, window: int = WINDOW) -> list[int]:
    """The window lengths of a shard: whole ones, then the rest by descending powers of two."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


class SourceQueues:
    """Deficit round-robin over the queues of one shard."""

    def __init__(self, shares: np.ndarray, deficits: np.ndarray, quantum: int = QUANTUM):
        self.shares, self.deficits, self.quantum = shares, deficits.copy(), quantum
        self.queues: list[list] = [[] for _ in shares]
        self.at = [0] * len(shares)

    def put(self, source: int, doc) -> None:
        self.queues[source].append(doc)

    def pack(self, total: int, window: int = WINDOW):
        """Pieces (doc, start, length, window number, offset) in the order they are served."""
        sizes = windows_of(total, window)
        number = offset = 0
        begun = [0] * len(self.queues)
        active = [s for s, q in enumerate(self.queues) if q]
        while active:
            # A round: shares of the queues that are left, scaled so that a round is ``quantum`` tokens a queue.
            share = np.maximum(self.shares[active], 1e-12)
            gain = share / share.sum() * self.quantum * len(active)
            # No queue can be served for some rounds where all are in debt: as many rounds at once.
            short = (1 - self.deficits[active] - gain) / gain
            self.deficits[active] += gain * (1 + max(0, int(np.floor(short.min()))))
            left = []
            for s in active:
                queue = self.queues[s]
                due = int(self.deficits[s])
                while due > 0 and self.at[s] < len(queue):
                    doc = queue[self.at[s]]
                    n = min(due, doc.n - begun[s], sizes[number] - offset)
                    yield doc, begun[s], n, number, offset
                    begun[s] += n
                    offset += n
                    due -= n
                    self.deficits[s] -= n
                    if offset == sizes[number]:
                        number, offset = number + 1, 0
                    if begun[s] == doc.n:
                        begun[s], queue[self.at[s]] = 0, None
                        self.at[s] += 1
                if self.at[s] < len(queue):
                    left.append(s)
            active = left


class _Doc:
    __slots__ = ("doc_id", "n", "ids")

    def __init__(self, doc_id, n, ids):
        self.doc_id, self.n, self.ids = doc_id, n, ids


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack_documents(docs: DataFrame, *, weights: dict[str | None, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM, path: str | None = None) -> DataFrame:
    """One row for each piece of a document: where it stands in it, its length, its place in a sequence, and its ids' CRC-32."""
    spark = docs.sparkSession
    held = common.written(tokenize(docs, path=path), "tokens")
    total = held.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // TOKENS_PER_SHARD), min(common.n_parts(spark), total // 100_000))
    shard = F.pmod(F.xxhash64("ord", F.lit(17)), F.lit(shards)).cast("int")
    dealt = held.withColumn("shard", shard)

    # Tokens by shard and source; a source's target share; what the shards before leave over.
    counts = common.written(dealt.groupBy("shard", "source").agg(F.sum("n").alias("tokens")), "shard-tokens")
    by_source = counts.groupBy("source").agg(F.sum("tokens").alias("all"))
    if weights is None:
        share = F.col("all") / F.lit(float(max(1, total)))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k if k is not None else "\0", float(v))])
        share = F.coalesce(given[F.coalesce("source", F.lit("\0"))], F.lit(0.0)) / float(sum(weights.values()))
    shares = by_source.select(F.col("source").alias("_source"), share.alias("share"))
    of_shard = counts.groupBy("shard").agg(F.sum("tokens").alias("shard_tokens"))
    n_windows = F.floor(F.col("shard_tokens") / window) + F.bit_count(F.col("shard_tokens") % window)
    placed = common.sum_before(of_shard.withColumn("windows", n_windows.cast("long")), "shard", "windows", "first_window")
    owed = counts.join(of_shard, "shard").join(shares, F.col("source").eqNullSafe(F.col("_source")))
    # A source's deficit before a shard: its share of all tokens before, less its own tokens before.
    tokens_before = common.sum_before(of_shard, "shard", "shard_tokens", "all_before").select("shard", "all_before")
    own_before = common.sum_before(owed, "shard", "tokens", "own_before", by=("source",))
    headers = own_before.join(tokens_before, "shard").join(placed.select("shard", "first_window"), "shard").select(
        "shard", "source", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("deficit"), "share", F.col("tokens").alias("n"), "first_window"
    )
    blank = lambda t: F.lit(None).cast(t)
    head = headers.select("shard", F.lit(0).alias("kind"), "source", blank("long").alias("doc_id"), "n", blank("binary").alias("ids"), blank("long").alias("ord"), "deficit", "share", "first_window")
    body = dealt.select("shard", F.lit(1).alias("kind"), "source", "doc_id", "n", "ids", "ord", blank("double").alias("deficit"), blank("double").alias("share"), blank("long").alias("first_window"))

    def run(batches):
        import pyarrow as pa

        names = [c.strip().split()[0] for c in _PIECE.split(",")]
        types = [pa.int64()] * 7 + [pa.string()]
        head, queues, order, current, out = [], None, {}, None, []

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
            out.clear()
            return made

        def pack():
            by_source = {s: name for name, s in order.items()}
            source_of = {id(d): s for s, q in enumerate(queues.queues) for d in q}
            for doc, start, n, number, offset in queues.pack(sum(h[4] for h in head), window):
                ids = np.frombuffer(doc.ids, "<u2", n, start * 2).astype("<u4")
                out.append((doc.doc_id, start, n, zlib.crc32(ids.tobytes()), doc.n, head[0][3] + number, offset, by_source[source_of[id(doc)]]))
                if len(out) >= 5000:
                    yield flush()

        for batch in batches:
            for shard, kind, source, doc_id, n, ids, deficit, share, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != current:
                    if queues is not None:
                        yield from pack()
                    head, queues, order, current = [], None, {}, shard
                if kind == 0:
                    order[source] = len(head)
                    head.append((source, deficit, share, first, n))
                    continue
                if queues is None:
                    queues = SourceQueues(np.array([h[2] for h in head]), np.array([h[1] for h in head]), quantum)
                queues.put(order[source], _Doc(doc_id, n, ids))
        if queues is not None:
            yield from pack()
        if out:
            yield flush()

    every = head.unionByName(body).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "source", "ord", "doc_id")
    return every.select("shard", "kind", "source", "doc_id", "n", "ids", "deficit", "share", "first_window").mapInArrow(run, _PIECE)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
