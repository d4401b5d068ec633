"""Hierarchical Pitman-Yor model of words after words, with a spelling model as base, used for perplexity.

Words are customers of the restaurant of the word before them (the end token stands before the first).
The CONTEXTS most frequent words have a restaurant each; all rarer words with the same last two bytes share
one.  The tables of these restaurants are customers of one that all share, the words' own; its tables order
words from a spelling model, whose restaurants are contexts of up to two bytes before a byte.  A context's
parent is the context without its oldest byte, shared with all that differ in that byte alone; the root's base
is uniform over bytes.  Every word has probability, seen or not: one that training lacks has what the word
restaurant leaves to new tables, times its own spelling's.

Seating is sampled by Gibbs: a restaurant's customers of one dish leave together and are seated again at a
number of tables drawn from its posterior (a new table has weight (theta + d T) P, a table of n customers
n - d; generalised Stirling numbers count the seatings of t tables).  Of dishes of more than EXACT customers the
first so many are seated like that, and their tables grow by the power d of customers; where the limit for
endlessly many, which is negative binomial, is reached by then, it is drawn from.  Within a round, restaurants see others' totals as the round before left them.  Probabilities are
averaged over the draws of the last round.

Tokens are dealt once, packed, to buckets by word; frequent words are spread over buckets by context too, so no
bucket holds a hot word.  A bucket's tokens are written sorted by word and context.  Rounds read that table:
each seats its words' dishes in all context restaurants, rare words also in the words' restaurant.  What restaurants
tell each other has a size bound whatever the corpus: tables by context (2**17 numbers), tables by frequent
word (2**16) and customers of the spelling model by three bytes (at most 2**24, about 10**5 in text).  The last
round's draws are taken twice by the same random numbers, the second time to score the bucket's tokens; documents'
scores are sums over buckets.

Words are named by 64-bit hashes; two of 10^7 words share one with a chance of about 3 in 10^6.

Defined cases: null and empty texts are the end token alone; a null doc_id counts as an empty text
for the split; repeated rows are scored (and counted) each; very long texts are scored whole; words of one count
are ranked by their bytes; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, row_groups, saved, shared_dir, table, text_lengths
from tidewatch.llm.shingle_sets import mix

#: The end token: no word holds white space.
END = b"\n"
#: Words with a context restaurant of their own; their ranks are their names.
CONTEXTS = 1 << 16
#: Rarer words' contexts are their last two bytes.
ENDINGS = 1 << 16
#: Draws of the rounds: the last one's are averaged.
ROUNDS = (2, 10)
#: Customers of a dish whose tables are drawn from their exact posterior.
EXACT = 1024
_BANDS = (1, 2, 3, 4, 6, 9, 16, 32, 64, 128, 256, 512, 1024)
THETA = 1.0
#: Bits of the context key at each depth of the spelling model.
DEPTH_BITS = (0, 8, 16)
#: Tokens and documents of a block, and tokens that a task should hold.
GROUP_BYTES = 8_000_000
BLOCK_TOKENS, BLOCK_DOCS, TASK_TOKENS = 1_500_000, 1 << 15, 3_000_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


# --- seating ---------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of up to EXACT customers and tables."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[1, 1] = 0
    t = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        s[n + 1, 1 : n + 1] = s[n, 1 : n + 1] + np.log(n - d * t[:n])
        s[n + 1, 1 : n + 2] = np.logaddexp(s[n + 1, 1 : n + 2], s[n, : n + 1])
    return s


def seat(c: np.ndarray, others: np.ndarray, d: float, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables for dishes of c >= 1 customers, when their restaurants have others tables of other dishes
    and the parent gives them probability p: drawn from their posterior, for more than EXACT customers nearly."""
    out = np.ones(len(c), np.int64)
    # bands of customers share a width; nobody sits at more tables than there are customers, as the numbers say
    for low, high in zip(_BANDS, _BANDS[1:]):
        band = np.flatnonzero((c > low) & (c <= high))
        for lo in range(0, len(band), max(1, (1 << 21) // high)):  # bounded memory
            at = band[lo : lo + max(1, (1 << 21) // high)]
            log = np.log(THETA + d * (others[at, None] + np.arange(high)))
            log += np.log(np.maximum(p[at, None], 1e-300))
            log = np.cumsum(log, axis=1) + _stirling(d)[c[at], 1 : high + 1]
            weight = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (weight < rng.random(len(at))[:, None] * weight[:, -1:]).sum(axis=1)
    large = np.flatnonzero(c > EXACT)
    if len(large):
        t = seat(np.full(len(large), EXACT), others[large], d, p[large], rng)
        low, r = np.minimum(p[large], 0.999), THETA / d + others[large] + 1
        limit, mean, grown = 1 + rng.negative_binomial(r, 1 - low), 1 + r * low / (1 - low), t * (c[large] / EXACT) ** d
        out[large] = np.minimum(np.where(mean < EXACT / 2, limit, np.minimum(grown, mean)), c[large]).astype(np.int64)
    return out


# --- spelling ---------------------------------------------------------------------------------


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words and the space behind each: context << 8 | byte, and the word's number."""
    x = np.frombuffer(b"".join(b"  " + w + b" " for w in words), np.uint8).astype(np.int64)
    n = np.array([len(w) for w in words], np.int64) + 1
    word = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(word)) + 2 * (word + 1)
    return (x[at - 1] | x[at - 2] << 8) << 8 | x[at], word


@dataclass
class Spelling:
    """For each depth: sorted keys (context << 8 | byte) with probabilities, and contexts with weights of the parent."""

    root: np.ndarray
    keys: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]

    def prob(self, keys: np.ndarray) -> np.ndarray:
        byte, context = keys & 255, keys >> 8
        p = self.root[byte]
        for depth in range(1, len(self.keys) + 1):
            u = context & ((1 << DEPTH_BITS[depth]) - 1)
            for own, value, asked in ((self.contexts, self.backoffs, u), (self.keys, self.probs, u << 8 | byte)):
                have = own[depth - 1]
                i = np.minimum(np.searchsorted(have, asked), len(have) - 1)
                hit = have[i] == asked
                got = value[depth - 1][i]
                p = np.where(hit, got if own is self.keys else got * p, p)
        return p

    def log_words(self, keys: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithms of the words' probabilities."""
        return np.bincount(word, weights=np.log(self.prob(keys)))


UNIFORM = Spelling(np.full(256, 1 / 256), [], [], [], [])


def seat_spelling(keys: np.ndarray, c: np.ndarray, last: Spelling, rng: np.random.Generator, depth: int) -> Spelling:
    """One sweep over the contexts, deepest first; last gives the parents' probabilities."""
    levels = []
    for k in range(depth, -1, -1):
        order = np.argsort(keys)
        keys, c = keys[order], c[order]
        u = keys >> 8
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(u)]))
        parent = (u & ((1 << DEPTH_BITS[k - 1]) - 1 if k else 0)) << 8 | keys & 255
        d = round(discount((c == 1).sum(), (c == 2).sum()), 4)
        if k:
            cut = Spelling(last.root, *(x[: k - 1] for x in (last.keys, last.probs, last.contexts, last.backoffs)))
            p = cut.prob(parent)
        else:
            p = np.full(len(keys), 1 / 256)
        guess = np.ones(len(c), np.int64)  # tables of the others: each dish has one at least
        t = seat(c, np.bincount(group)[group] - guess, d, p, rng)
        t = seat(c, np.bincount(group, weights=t)[group] - t, d, p, rng)
        total = np.bincount(group, weights=c)
        levels.append((keys, c, t, u[first], group, (THETA + d * np.bincount(group, weights=t)) / (THETA + total), d, total, parent))
        if k:
            keys, inverse = np.unique(parent, return_inverse=True)
            c = np.bincount(inverse, weights=t).astype(np.int64)
    out = Spelling(np.full(256, 1 / 256), [], [], [], [])
    for keys, c, t, contexts, group, back, d, total, parent in levels[::-1]:
        base = out.prob(parent) if len(out.keys) or levels[-1][0] is not keys else out.root[keys & 255]
        p = (c - d * t) / (THETA + total[group]) + back[group] * base
        if levels[-1][0] is keys:
            root = out.root * back[0]
            root[keys & 255] = p
            out.root = root
        else:
            out.keys.append(keys)
            out.probs.append(p)
            out.contexts.append(contexts)
            out.backoffs.append(back)
    return out


class Table:
    """The spelling model's probabilities, dense by context: what workers look up."""

    def __init__(self, model: Spelling):
        pairs = model.contexts[1] if len(model.contexts) > 1 else np.empty(0, np.int64)
        contexts = np.r_[np.arange(256), pairs]  # a context that never occurred has its parent's row
        keys = contexts[:, None] << 8 | np.arange(256)
        unseen = Spelling(model.root, model.keys[:1], model.probs[:1], model.contexts[:1], model.backoffs[:1])
        logs = np.vstack([np.log(unseen.prob(keys[:256])), np.log(model.prob(keys[256:]))])
        self.logs = logs.astype(np.float32)
        self.row = np.tile(np.arange(256, dtype=np.int32), 256)
        self.row[pairs] = np.arange(256, len(contexts), dtype=np.int32)

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms of the words' probabilities."""
        if not words:
            return np.empty(0)
        keys, word = spell(words)
        return np.bincount(word, weights=self.logs[self.row[keys >> 8], keys & 255].astype(float), minlength=len(words))


# --- tokens -----------------------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-cased words (the end token is the last), the texts' tokens as numbers of these, and where each text starts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.values.dictionary_encode()
    names, index, at = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
    if b"" in names:  # space at an end
        word = index != names.index(b"")
        at = np.r_[0, np.cumsum(word)][at]
        index = index[word]
    return [*names, END], np.insert(index, at[1:], len(names)), at + np.arange(len(at))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _groups(b: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    texts, ids = b.column(1).fill_null(""), b.column(0)
    for lo, hi in row_groups(text_lengths(texts), GROUP_BYTES):
        yield ids.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo)


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: all words of training documents (and the end token) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for ids, texts in _groups(b):
                names, index, at = tokens(texts)
                train = np.repeat([not held_out(d) for d in ids], np.diff(at))
                for w, c in zip(names, np.bincount(index[train], minlength=len(names)).tolist()):
                    if c:
                        found[w] = found.get(w, 0) + c
                if len(found) > 300_000:
                    yield flush()
                    found = {}
        yield flush()

    return _texts(docs).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words, most frequent first (the end token among them), with their counts; tokens and distinct words of all training texts."""

    words: list[bytes]
    c: np.ndarray
    n: int
    v: int

    def contexts(self, names: list[bytes], rank: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """By word: its name (rank or hash) and the restaurant of words after it."""
        ranks = np.array([rank.get(x, -1) for x in names], np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64).view(np.int64) | np.int64(CONTEXTS)  # no rank
        ending = np.array([int.from_bytes(x[-2:]) for x in names], np.int64)
        return np.where(ranks >= 0, ranks, hashes), np.where(ranks >= 0, ranks, CONTEXTS + ending)


def vocabulary(docs: DataFrame) -> Vocabulary:
    counts = saved(count_words(docs))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    rows = counts.orderBy(F.desc("c"), "word").limit(CONTEXTS).collect()
    discard(counts)
    return Vocabulary([bytes(r["word"]) for r in rows], np.array([r["c"] for r in rows], np.int64), n, v)


_DEALT = "bucket long, names binary, spelt binary, runs binary, ctx binary, doc binary, block long, ids binary"


def deal(docs: DataFrame, vocab: Vocabulary, buckets: int) -> DataFrame:
    """A row for each block and bucket: words' names and spellings, and in their order runs of contexts and documents;
    and a row for each block: its documents' ids, tokens and halves of the split."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    columns = [x.split()[0] for x in _DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, vocab_ = TaskContext.get().partitionId(), 0, held.value
        rank = {w: i for i, w in enumerate(vocab_.words)}
        parts: list[tuple] = []
        ids: list = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, ids, size, seq
            block = part << 32 | seq
            name, ctx, doc = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
            spelt = {w: x for p in parts for w, x in zip(p[4].tolist(), p[0]) if w >= CONTEXTS or w < 0}
            distinct, word = np.unique(name, return_inverse=True)
            # a rare word's tokens share a bucket, a frequent one's are spread by context
            frequent = (name >= 0) & (name < CONTEXTS)
            mixed = mix(np.where(frequent, name << 17 | ctx, name).view(np.uint64))
            bucket = (mixed % np.uint64(buckets)).astype(np.int64)
            order = np.argsort((bucket * len(distinct) + word) << 17 | ctx, kind="stable")
            bucket, word, ctx, doc = bucket[order], word[order], ctx[order], doc[order]
            out: list[list] = [[] for _ in columns]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
                w = word[lo:hi]
                at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                names = distinct[w[at]]
                c = ctx[lo:hi]
                texts = b" ".join(spelt.get(x, b"") for x in names.tolist())
                row = (int(bucket[lo]), names.tobytes(), texts, np.diff(np.r_[at, hi - lo]).astype(np.int32).tobytes(), (c & 0xFFFF).astype(np.uint16).tobytes() + (c >> 16).astype(np.uint8).tobytes(), doc[lo:hi].astype(np.uint16).tobytes(), block, None)
                for k, x in zip(out, row, strict=True):
                    k.append(x)
            info = np.array(ids, np.int64)
            for k, x in zip(out, (seq % buckets, None, None, None, None, None, block, info.tobytes()), strict=True):
                k.append(x)
            types = [pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], columns)
            parts, ids, size, seq = [], [], 0, seq + 1

        for b in batches:
            for own, texts in _groups(b):
                if ids and (size > BLOCK_TOKENS or len(ids) + len(own) > BLOCK_DOCS):
                    yield from flush()
                names, index, at = tokens(texts)
                name, context = vocab_.contexts(names, rank)
                before = np.r_[len(names) - 1, index[:-1]]  # the end token stands before the first
                n, halves = np.diff(at), np.array([held_out(d) for d in own], np.int64)
                parts.append((names, name[index], context[before], np.repeat(2 * np.arange(len(ids), len(ids) + len(own)) + halves, n), name))
                ids.extend((d or 0, d is None, h, k) for d, h, k in zip(own, halves.tolist(), n.tolist()))
                size += len(index)
        if ids:
            yield from flush()

    return _texts(docs).mapInArrow(run, _DEALT)


_CHUNK = "chunk long, names binary, spelt binary, pairs binary, ctx binary, c binary, n binary, doc binary, number binary, block binary, ids binary"


def gather(dealt: DataFrame, partitions: int) -> DataFrame:
    """A bucket's tokens of all blocks, sorted by word and context, with training counts of pairs; and rows about documents."""
    columns = [x.split()[0] for x in _CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        trains: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r["bucket"], []).append(r)
        for bucket in sorted(held):
            name, ctx, doc, block, spelt = [], [], [], [], {}
            for r in sorted(held.pop(bucket), key=lambda r: r["block"]):
                if r["ids"] is not None:
                    yield _batch(columns, (r["block"], *[None] * 9, r["ids"]))
                    continue
                names, runs = np.frombuffer(r["names"], np.int64), np.frombuffer(r["runs"], np.int32)
                spelt.update(zip(names.tolist(), r["spelt"].split(b" ")))
                name.append(np.repeat(names, runs))
                n = len(r["doc"]) // 2
                ctx.append(np.frombuffer(r["ctx"], np.uint16, n).astype(np.int64) | np.frombuffer(r["ctx"], np.uint8, n, 2 * n).astype(np.int64) << 16)
                doc.append(np.frombuffer(r["doc"], np.uint16))
                block.append(np.full(n, r["block"]))
            if not name:
                continue
            name, ctx, doc, block = map(np.concatenate, (name, ctx, doc, block))
            distinct, word = np.unique(name, return_inverse=True)
            order = np.argsort(word << 17 | ctx, kind="stable")  # keeps the order of blocks and documents
            pair = (word << 17 | ctx)[order]
            doc, block = doc[order], block[order]
            at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            n = np.diff(np.r_[at, len(pair)])
            per = np.bincount(pair[at] >> 17, minlength=len(distinct))
            c = np.add.reduceat(1 - (doc & 1).astype(np.int32), at).astype(np.int32)
            blocks, number = np.unique(block, return_inverse=True)
            own_ctx = (pair[at] & (1 << 17) - 1).astype(np.int32)
            blobs = (distinct, per.astype(np.int32), own_ctx, c, n.astype(np.int32), doc, number.astype(np.min_scalar_type(len(blocks))), blocks)
            names, *others = (x.tobytes() for x in blobs)
            yield _batch(columns, (bucket, names, b" ".join(spelt[x] for x in distinct.tolist()), *others, None))

    return dealt.repartition(partitions, "bucket").mapInArrow(run, _CHUNK)


def _batch(columns: list[str], row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], columns)


# --- rounds -----------------------------------------------------------------------------------


@dataclass
class Totals:
    """What restaurants see of each other: bounded, sent to all tasks."""

    tables: np.ndarray  #: by context: tables of its restaurant
    customers: np.ndarray  #: by context: its customers
    frequent: np.ndarray  #: by rank: the word's predictive probability in the words' restaurant
    k: float  #: customers of the words' restaurant
    t: float  #: its tables
    d_pair: float
    d_word: float
    spelling: Table
    seed: tuple[int, ...]


@dataclass
class Chunk:
    """A bucket's words, and their pairs with contexts by word."""

    bucket: int
    names: np.ndarray
    words: list[bytes]
    word: np.ndarray  #: by pair
    ctx: np.ndarray
    c: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, r: dict) -> Chunk:
        ints = lambda k: np.frombuffer(r[k], np.int32).astype(np.int64)
        names, per = np.frombuffer(r["names"], np.int64), ints("pairs")
        return cls(r["chunk"], names, r["spelt"].split(b" "), np.repeat(np.arange(len(names)), per), ints("ctx"), ints("c"), ints("n"))

    @property
    def rare(self) -> np.ndarray:
        return (self.names < 0) | (self.names >= CONTEXTS)

    def drawn(self, totals: Totals | None, draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tables by pair, by word (customers of the words' restaurant) and of rare words there, averaged over draws,
        and the rare words' log probabilities of spelling.  Without totals, all is one table."""
        tables, lg = (self.c > 0).astype(float), np.zeros(len(self.names))
        customers = np.bincount(self.word, weights=tables, minlength=len(self.names))
        own = (customers > 0).astype(float)
        if totals is None:
            return tables, customers, own, lg
        rare = np.flatnonzero(self.rare)
        lg[rare] = totals.spelling.log_words([self.words[i] for i in rare.tolist()])
        new = (THETA + totals.d_word * totals.t) / (THETA + totals.k)
        rng = np.random.default_rng([*totals.seed, self.bucket])
        several, seated = np.flatnonzero(self.c > 1), rare[customers[rare] > 0]
        once = customers - np.bincount(self.word[several], minlength=len(self.names))
        p = np.zeros(len(self.names))
        frequent = np.flatnonzero(~self.rare)
        p[frequent] = totals.frequent[self.names[frequent]]
        t, k, own = np.ones(len(several), np.int64), customers.astype(np.int64), own.astype(np.int64)
        sums = np.zeros(len(several)), np.zeros(len(k)), np.zeros(len(k))
        for _ in range(draws):
            p[rare] = (k[rare] - totals.d_word * own[rare]) / (THETA + totals.k) + new * np.exp(lg[rare])
            others = np.maximum(totals.tables[self.ctx[several]] - t, 0)
            t = seat(self.c[several], others, totals.d_pair, p[self.word[several]], rng)
            k = (once + np.bincount(self.word[several], weights=t, minlength=len(k))).astype(np.int64)
            own[seated] = seat(k[seated], np.maximum(totals.t - own[seated], 0), totals.d_word, np.exp(lg[seated]), rng)
            for total, x in zip(sums, (t, k, own), strict=True):
                total += x / draws
        tables[several] = sums[0]
        return tables, sums[1], sums[2], lg


_SUMS = "kind string, slice int, blob binary"
_SLICES = 16


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    if pdf["kind"].iloc[0] == "spelling":
        both = np.concatenate([np.frombuffer(x, np.float64).reshape(2, -1) for x in pdf["blob"]], axis=1)
        keys, at = np.unique(both[0], return_inverse=True)
        out = np.vstack([keys, np.bincount(at, weights=both[1])])
    else:
        out = np.sum(np.sort([np.frombuffer(x, np.float64) for x in pdf["blob"]], axis=0), axis=0)  # the same in any order
    return pd.DataFrame({"kind": pdf["kind"].iloc[:1], "slice": pdf["slice"].iloc[:1], "blob": [out.tobytes()]})


def seat_round(chunks: DataFrame, totals: Totals | None, draws: int) -> dict[str, np.ndarray]:
    """Sums over all buckets of what draws give (bounded: see Totals): tables, customers, k by rank, spelling
    (keys and tables of rare words) and scalars (customers and tables of rare words, counts of pairs and of
    rare words with one and two customers)."""
    held = chunks.sparkSession.sparkContext.broadcast(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = CONTEXTS + ENDINGS
        tables, customers, by_rank, scalars = np.zeros(shape), np.zeros(shape), np.zeros(CONTEXTS), np.zeros(6)
        keys, weights = np.empty(0, np.int64), np.empty(0)
        for b in batches:
            for r in b.to_pylist():
                x = Chunk.of(r)
                t, k, own, _ = x.drawn(held.value, draws)
                rare = x.rare
                tables += np.bincount(x.ctx, weights=t, minlength=shape)
                customers += np.bincount(x.ctx, weights=x.c, minlength=shape)
                by_rank += np.bincount(x.names[~rare], weights=k[~rare], minlength=CONTEXTS)
                scalars += (k[rare].sum(), own[rare].sum(), (x.c == 1).sum(), (x.c == 2).sum(), (np.rint(k[rare]) == 1).sum(), (np.rint(k[rare]) == 2).sum())
                some = np.flatnonzero(rare & (own > 0))
                if len(some):
                    more, word = spell([x.words[i] for i in some.tolist()])
                    keys, at = np.unique(np.r_[keys, more], return_inverse=True)
                    weights = np.bincount(at, weights=np.r_[weights, own[some][word]])
        rows = [("scalars", 0, scalars.tobytes())]
        for kind, v in (("tables", tables), ("customers", customers), ("rank", by_rank)):
            rows += [(kind, i, part.tobytes()) for i, part in enumerate(np.split(v, _SLICES))]
        rows += [("spelling", i, np.vstack([keys[keys % _SLICES == i], weights[keys % _SLICES == i]]).tobytes()) for i in range(_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], ["kind", "slice", "blob"])

    data = chunks.where("names is not null").select("chunk", "names", "spelt", "pairs", "ctx", "c", "n")
    found = data.mapInArrow(run, _SUMS).groupBy("kind", "slice").applyInPandas(_summed, _SUMS).collect()
    out: dict[str, np.ndarray] = {}
    for kind in ("tables", "customers", "rank", "scalars", "spelling"):
        parts = [np.frombuffer(r["blob"], np.float64) for r in sorted(found, key=lambda r: r["slice"]) if r["kind"] == kind]
        if kind == "spelling":
            out[kind] = np.concatenate([np.empty((2, 0)), *(p.reshape(2, -1) for p in parts)], axis=1)
        else:
            out[kind] = np.concatenate(parts) if parts else np.zeros({"rank": CONTEXTS, "scalars": 6}.get(kind, CONTEXTS + ENDINGS))
    return out


def discount(one: float, two: float) -> float:
    """From how many dishes were ordered once and twice."""
    return float(np.clip(one / max(1, one + 2 * two), 0.1, 0.9))


def shared_restaurants(sums: dict[str, np.ndarray], vocab: Vocabulary, last: Totals | None, model: Spelling, seed: tuple[int, ...], draws: int) -> tuple[Totals, Spelling]:
    """Seats frequent words in the words' restaurant, and the spelling model's contexts, after a round."""
    rng = np.random.default_rng([*seed, 1])
    scalars, k = sums["scalars"], sums["rank"][: len(vocab.words)]
    d_pair = last.d_pair if last else discount(scalars[2], scalars[3])
    d_word = last.d_word if last else discount(scalars[4] + (k == 1).sum(), scalars[5] + (k == 2).sum())
    lg = last.spelling.log_words(vocab.words) if last else np.full(len(k), np.log(1 / 256))
    total, whole = float(k.sum() + scalars[0]), np.maximum(np.rint(k), 1).astype(np.int64)
    t = np.ones(len(k))
    if len(k) and last:
        one, t = np.ones(len(k), np.int64), np.zeros(len(k))
        for _ in range(draws):
            one = seat(whole, np.maximum(last.t - one, 0), d_word, np.exp(lg), rng)
            t += one / draws
    tables = float(t.sum() + scalars[1])
    own, word = spell(vocab.words) if vocab.words else (np.empty(0, np.int64), np.empty(0, np.int64))
    keys, at = np.unique(np.r_[sums["spelling"][0].astype(np.int64), own], return_inverse=True)
    n = np.maximum(1, np.rint(np.bincount(at, weights=np.r_[sums["spelling"][1], t[word]]))).astype(np.int64)
    if len(keys):
        model = seat_spelling(keys, n, model, rng, 2)
    spelling = Table(model)
    lg = spelling.log_words(vocab.words)
    p = (k - d_word * t + (THETA + d_word * tables) * np.exp(lg)) / (THETA + total)
    frequent = np.zeros(CONTEXTS)
    frequent[: len(p)] = p
    return Totals(sums["tables"], sums["customers"], frequent, total, tables, d_pair, d_word, spelling, seed), model


@dataclass
class WordModel:
    vocab: Vocabulary
    chunks: DataFrame  #: see gather()
    before: Totals  #: what the last round's draws saw
    totals: Totals  #: what they gave
    draws: int
    partitions: int

    def words(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk: by word the logarithm of its probability in the words' restaurant; by pair what its own customers give, and what is left to new tables."""
        tables, k, own, _ = chunk.drawn(self.before, self.draws)
        now, rare = self.totals, chunk.rare
        p = np.zeros(len(chunk.names))
        p[~rare] = np.log(now.frequent[chunk.names[~rare]])
        lg = now.spelling.log_words([chunk.words[i] for i in np.flatnonzero(rare).tolist()])
        new, had = THETA + now.d_word * now.t, k[rare] - now.d_word * own[rare]
        # the probability of a long word's spelling may be too small for a number
        p[rare] = np.where(had > 0, np.log(np.maximum(had, 1e-9) + new * np.exp(lg)), np.log(new) + lg) - np.log(THETA + now.k)
        below = THETA + now.customers[chunk.ctx]
        return p, (chunk.c - now.d_pair * tables) / below, (THETA + now.d_pair * now.tables[chunk.ctx]) / below


def _spread(spark: SparkSession, partitions: int):
    """Has scans of small tables cut into as many tasks; gives back the former setting."""
    key = "spark.sql.files.minPartitionNum"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(partitions))
    return lambda: spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def train(docs: DataFrame, rounds: tuple[int, ...] = ROUNDS, seed: int = 7, vocab: Vocabulary | None = None) -> WordModel:
    spark = docs.sparkSession
    vocab = vocab or vocabulary(docs)
    chars = docs.agg(F.coalesce(F.sum(F.length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // 6 // TASK_TOKENS))
    chunks = gather(deal(docs, vocab, 4 * partitions), partitions)
    path = shared_dir(spark)
    chunks.write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(chunks.schema).parquet(path)
    undo = _spread(spark, partitions)
    try:
        totals, model = shared_restaurants(seat_round(chunks, None, 0), vocab, None, UNIFORM, (seed, 0), 1)
        before = totals
        for k, draws in enumerate(rounds, 1):
            before = totals
            totals, model = shared_restaurants(seat_round(chunks, before, draws), vocab, before, model, (seed, k), draws)
    finally:
        undo()
    return WordModel(vocab, chunks, before, totals, rounds[-1], partitions)


def score(model: WordModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document that the model was given."""
    spark = model.chunks.sparkSession
    vocab, n_tokens = model.vocab, model.vocab.n
    small = WordModel(Vocabulary([], np.empty(0), vocab.n, vocab.v), None, model.before, model.totals, model.draws, model.partitions)
    held, ranked = spark.sparkContext.broadcast(small), spark.sparkContext.broadcast(vocab.c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c_of = held.value, ranked.value
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["ids"] is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), pa.array([r["ids"]], pa.binary()), pa.array([None], pa.binary())], ["block", "ids", "sums"])
                    continue
                x = Chunk.of(r)
                p, own, left = m.words(x)
                total = np.bincount(x.word, weights=x.c, minlength=len(x.names))
                frequent = ~x.rare
                total[frequent] = c_of[x.names[frequent]]
                base = np.log10((total + 0.1) / (n_tokens + 0.1 * (m.vocab.v + 1)))
                log = np.where(own > 0, np.log(np.maximum(own, 1e-300) + left * np.exp(p[x.word])), np.log(left) + p[x.word])
                values = np.stack([log / np.log(10), base[x.word], (total[x.word] > 0).astype(float)])
                blocks = np.frombuffer(r["block"], np.int64)
                doc = np.frombuffer(r["doc"], np.uint16) >> 1
                number = np.frombuffer(r["number"], np.min_scalar_type(len(blocks)))
                pair = np.repeat(np.arange(len(x.n)), x.n)
                for i, block in enumerate(blocks.tolist()):
                    at = number == i
                    into = sums.setdefault(block, np.zeros((3, BLOCK_DOCS)))
                    for row, v in zip(into, values, strict=True):
                        row += np.bincount(doc[at], weights=v[pair[at]], minlength=BLOCK_DOCS)
        for block, v in sums.items():
            some = np.flatnonzero(v[1])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([None], pa.binary()), pa.array([some.astype(np.uint16).tobytes() + v[:, some].tobytes()], pa.binary())], ["block", "ids", "sums"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                blocks.setdefault(r["block"], []).append(r)
        while blocks:
            _, rows = blocks.popitem()
            info = np.frombuffer(next(r["ids"] for r in rows if r["ids"] is not None), np.int64).reshape(-1, 4)
            out = np.zeros((3, BLOCK_DOCS))
            for r in sorted((r["sums"] for r in rows if r["sums"] is not None)):
                some = np.frombuffer(r, np.uint16, len(r) // 26)
                out[:, some] += np.frombuffer(r, np.float64, 3 * len(some), 2 * len(some)).reshape(3, -1) if len(r) % 8 == 0 else np.frombuffer(r[2 * len(some) :], np.float64).reshape(3, -1)
            lp, base, known = out[:, : len(info)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(info[:, 0], mask=info[:, 1] > 0), pa.array(info[:, 2] > 0), pa.array(info[:, 3]), pa.array(known.astype(np.int64)), pa.array(np.full(len(info), n_tokens)), pa.array(base), pa.array(lp)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    undo = _spread(spark, model.partitions)
    try:
        part = model.chunks.mapInArrow(run, "block long, ids binary, sums binary").repartition("block")
        return saved(part.mapInArrow(whole, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    finally:
        undo()


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, n_docs, perplexity per token by the model and by the base."""
    by = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.count(F.lit(1)).alias("n_docs"), by("score").alias("perplexity"), by("base_score").alias("base_perplexity"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(table(spark, sf_dir, "documents"))
    out = score(model)
    discard(model.chunks)
    return out
