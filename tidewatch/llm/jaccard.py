"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word 5-grams.  shingle_sets.signatures() gives its
signatures; sets that link share some.

Signatures shared by more than HOT sets (a passage that many documents hold, or a large group of
copies) are not paired up.  As a linked pair shares several signatures, it is found by the others unless as
many of a set's are hot: the set is saturated.  Saturated sets meet by their elements, but for those that more
than HOT of them have.  That leaves pairs of sets of which three quarters are such common elements: copies, as a
rule.  They are compared with the leader of each of their hot signatures (the set with most shared
signatures: the original in a group of copies), and then meet by keys of their differences from that leader
(shingle_sets.difference_keys()): sets that link with it are one component already, and of others only those
whose differences are alike meet.

Each set has a sketch of 512 bits: the parity of its elements in 512 cells.  Two sketches differ in at
most as many bits as the sets do in elements, so a pair whose sketches (or sizes) differ by too much is
dropped; no linked pair is.  Pairs that pass meet finer sketches, of at least four cells an element, and
then the sets, so few sets are moved but those of links.

Candidates are checked in rounds, so that a group of copies costs no pair of each two.  First each set meets
the best of the leaders with most signatures in common.  Links give components, and then only candidates of
different components are checked.  All checks are exact.

Sets, not documents, are nodes: exact copies share one.  Nodes are 64-bit hashes of sets.

Defined cases: null texts and texts without words have empty sets and no links; with fewer than five
words the whole sequence is the one element; very long texts are taken whole; repeated rows give repeated
rows; a null doc_id is never a component's name unless all its documents lack one; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, row_groups, saved, small_batches, table, text_lengths
from tidewatch.llm.shingle_sets import Shingles, difference_keys, fine_sketch, linked, may_link, mix, node_of, signatures, sketch
from tidewatch.operators.graph import connected

HOT = 24
LEADERS = 4
#: Signatures that a worker holds before it passes them on, and those that a task should sort.
FLUSH = 600_000
TASK_SIGNATURES = 1_200_000
#: Columns of a set's sketch.
SKETCH = [f"k{i}" for i in range(8)]


def near(a: str, b: str) -> Column:
    """May the sets of columns a and b (structs of n and the sketch) link, by their sizes and sketches."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in SKETCH), F.lit(0))
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (7 * bits <= na + nb)


def usual(n: Column) -> Column:
    """Signatures that sets of n elements share with a linked set; sets that can promise fewer are weak."""
    return F.floor(n / 24) + 1


_DOC = 14  # columns: doc_id, whether it is null, node, set size, least shared, sketch, text key
_SIGNED = ["bucket", "sigs", "nodes", "docs", "fine"]
SIGNED = "bucket long, sigs binary, nodes binary, docs binary, fine array<binary>"


class Packer:
    """Signatures with their nodes, dealt to buckets and packed: four bytes of a signature (its bucket is told
    by the row), eight of a node.  Signatures that agree so far by chance only add candidates, some three a bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.sigs, self.nodes, self.held = buckets, [], [], 0

    def add(self, sigs: np.ndarray, node: int) -> None:
        self.sigs.append(sigs)
        self.nodes.append((node, len(sigs)))
        self.held += len(sigs)

    def flush(self) -> pa.RecordBatch:
        s = np.concatenate(self.sigs)
        node = np.repeat(np.array([x for x, _ in self.nodes], np.int64), [c for _, c in self.nodes])
        self.sigs, self.nodes, self.held = [], [], 0
        b = ((s & np.uint64(0xFFFFFF)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        b, node, s = b[order], node[order], np.ascontiguousarray((s[order] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :4])
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        ends = np.r_[at[1:], len(b)]
        return pa.RecordBatch.from_arrays([pa.array(b[at]), pa.array([s[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()), pa.array([node[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.list_(pa.binary()))], _SIGNED)


def sign(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket and packed arrays: signatures with their nodes, or rows about documents with their fine sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, packer = Shingles(), set(), Packer(buckets)
        for batch in batches:
            for lo, hi in row_groups(pc_lengths(batch.column(1))):
                info, fine = [], []
                for d, t in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()):
                    s = shingle(t)
                    node, least = node_of(s), 0
                    if len(s):
                        least = -1
                        if node not in seen:
                            seen.add(node)
                            sig, least = signatures(s)
                            packer.add(sig, node)
                    fine.append(fine_sketch(s) if least > 0 else None)
                    info.append((d or 0, d is None, node, len(s), least, *sketch(s).tolist(), text_key(t)))
                yield pa.RecordBatch.from_arrays([pa.array([info[0][2] % buckets], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([np.array(info, np.int64).tobytes()], pa.binary()), pa.array([fine], pa.list_(pa.binary()))], _SIGNED)
                if packer.held > FLUSH:
                    yield packer.flush()
        if packer.held:
            yield packer.flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def text_key(text: str | None) -> int:
    """Spark's xxhash64 of the text, null as an empty one."""
    x = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)
    return x - 2**64 if x >= 2**63 else x


def pc_lengths(texts: pa.Array) -> list[int]:
    return text_lengths(texts.fill_null(""))


def _by_group(s: np.ndarray, n: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures (sorted, the last bit a side) renamed by hashes of their groups of nodes and sides, each group once."""
    at = np.flatnonzero(np.r_[True, s[1:] >> 1 != s[:-1] >> 1])
    with np.errstate(over="ignore"):
        member = mix(mix(n.view(np.uint64)) + (s & 1).astype(np.uint64))
        group = mix(np.add.reduceat(member, at)) & ~np.uint64(1)
    stay = np.zeros(len(at), bool)
    stay[np.unique(group, return_index=True)[1]] = True
    size = np.diff(np.r_[at, len(s)])
    stay = np.repeat(stay, size)
    return (np.repeat(group.view(np.int64), size) | s & 1)[stay], n[stay], shared[stay]


_MET = "sig long, node long, shared int, doc_id long, n_shingles long, least int, " + ", ".join(f"{k} long" for k in SKETCH) + ", text_key long, fine binary"


def meet(signed: DataFrame, partitions: int, sides: bool = False) -> DataFrame:
    """Rows (sig, node, shared) for signatures that several nodes have; rows (node, doc_id, n_shingles, least) for documents.

    A partition sorts its share of the signatures; a signature's nodes are counted once each.  With sides, the
    signature's last bit is one, and only signatures that several nodes have from both sides stay; they are named
    by their nodes and sides, so that those of one and the same group, which give the same pairs, become one.
    """
    cut = 1 if sides else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes = [], []
        names = [x.split()[0] for x in _MET.split(", ")]
        for b in batches:
            for bucket, s, n, d, fine in zip(*(b.column(k) for k in range(5)), strict=True):
                if d.is_valid:
                    x = np.frombuffer(d.as_buffer(), np.int64).reshape(-1, _DOC)
                    void = pa.nulls(len(x), pa.int64())
                    yield pa.RecordBatch.from_arrays([void, pa.array(x[:, 2]), void.cast(pa.int32()), pa.array(x[:, 0], mask=x[:, 1] > 0), pa.array(x[:, 3]), pa.array(x[:, 4].astype(np.int32)), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(5, _DOC)), pa.array(fine.as_py(), pa.binary())], names)
                else:
                    wide = np.zeros((len(n.as_buffer()) // 8, 8), np.uint8)
                    wide[:, :4] = np.frombuffer(s.as_buffer(), np.uint8).reshape(-1, 4)
                    # the bucket tells signatures of other buckets apart
                    sigs.append(wide.view(np.int64).ravel() | (bucket.as_py() & 0x7FFFFF) << 32)
                    nodes.append(np.frombuffer(n.as_buffer(), np.int64))
        if not sigs:
            return
        s, n = np.concatenate(sigs), np.concatenate(nodes)
        sigs = nodes = None
        order = np.argsort(s, kind="stable")
        s = s[order]
        keep = np.zeros(len(s), bool)
        same = s[1:] >> cut == s[:-1] >> cut
        keep[1:] |= same
        keep[:-1] |= same
        s, n = s[keep], n[order[keep]]
        order = keep = same = None
        order = np.lexsort((n, s))
        s, n = s[order], n[order]
        if len(s):
            first = np.r_[True, (s[1:] != s[:-1]) | (n[1:] != n[:-1])]
            s, n = s[first], n[first]
            at = np.flatnonzero(np.r_[True, s[1:] >> cut != s[:-1] >> cut])
            count = np.diff(np.r_[at, len(s)])
            several = np.minimum.reduceat(n, at) < np.maximum.reduceat(n, at)
            if sides:
                several &= np.minimum.reduceat(s & 1, at) < np.maximum.reduceat(s & 1, at)
            shared, several = np.repeat(count, count), np.repeat(several, count)
            s, n, shared = s[several], n[several], shared[several].astype(np.int32)
            if sides and len(s):
                s, n, shared = _by_group(s, n, shared)
        for lo in range(0, len(s), 100_000):
            m = len(s[lo : lo + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(s[lo : lo + m]), pa.array(n[lo : lo + m]), pa.array(shared[lo : lo + m]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.int64())] * 9, pa.nulls(m, pa.binary())], names)

    return signed.repartition(partitions, "bucket").mapInArrow(run, _MET)


#: Bits of the largest Bloom filter of ids (32 MB).
BLOOM_BITS = 1 << 28
_SLICE = 1 << 16


def _bloom(ids: pa.Array, bits: int) -> np.ndarray:
    """Three positions of each id, a row each; null counts as 0."""
    x = ids.fill_null(0).to_numpy().view(np.uint64)[:, None] * np.uint64(2) + np.array([1, 2, 3], np.uint64) * np.uint64(7919)
    return (mix(x) % np.uint64(bits)).astype(np.int64)


def bloom_filter(ids: DataFrame, n: int) -> np.ndarray:
    """Packed bits of the ids (column doc_id): sixteen an id, up to BLOOM_BITS; merged slice by slice."""
    bits = min(BLOOM_BITS, max(_SLICE, 1 << (16 * n).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(_bloom(b.column(0), bits))
            for k in np.unique(at // _SLICE).tolist():
                own = found.setdefault(k, np.zeros(_SLICE, bool))
                own[at[at // _SLICE == k] % _SLICE] = True
        for k, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["slice", "bits"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in pdf["bits"]]))
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "bits": [merged.tobytes()]})

    out = np.zeros((bits // _SLICE, _SLICE // 8), np.uint8)
    parts = ids.select("doc_id").mapInArrow(part, "slice int, bits binary").groupBy("slice").applyInPandas(whole, "slice int, bits binary")
    for r in parts.toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def sets_of(docs: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """node, set (packed) for the wanted nodes, from the texts.

    One document stands for each.  The ids go to the scan as a Bloom filter of bounded size, which only
    saves work: the join behind it decides.
    """
    spark = docs.sparkSession
    ids = saved(known.join(wanted.distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    held = spark.sparkContext.broadcast(bloom_filter(ids, ids.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shingle = held.value, Shingles()
        for b in batches:
            at = _bloom(b.column(0), len(bits) * 8)
            ok = pa.array(((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1))
            texts, own = b.column(1).filter(ok), b.column(0).filter(ok)
            for lo, hi in row_groups(pc_lengths(texts)):
                sets = [shingle(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.slice(lo, hi - lo), pa.array(map(node_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "node", "set"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, node long, set binary")
    chosen = made.join(ids, (made["node"] == ids["node"]) & made["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    return saved(chosen.select("node", "set").groupBy("node").agg(F.first("set").alias("set")))


def sketched(pairs: DataFrame, fine: DataFrame) -> DataFrame:
    """The pairs a, b whose fine sketches (node, n, fine) allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_link(x, y, n) for x, y, n in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (fine.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("fine").alias(f"f{k}")) for k in "ab")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.select("a", "b", "fa", "fb", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(run, "a long, b long")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _pairs_of_sets(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
        yield i, j, np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(x, y) for _, _, x, y in _pairs_of_sets(b)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def elements(sets: DataFrame, buckets: int) -> DataFrame:
    """The sets' elements in place of signatures, packed as sign() does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            for node, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(np.frombuffer(s.as_buffer(), np.uint64), node)
                if packer.held > FLUSH:
                    yield packer.flush()
        if packer.held:
            yield packer.flush()

    return sets.select("node", "set").mapInArrow(run, SIGNED)


def by_differences(members: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """For sets a and hubs b: keys of differences packed as sign() does, and links with hubs as rows about documents: node a, doc_id b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            links = []
            for i, j, x, y in _pairs_of_sets(batch):
                inside, own = difference_keys(x, y, j)
                if inside:
                    links.append((j, 0, i, *[0] * (_DOC - 3)))
                if len(own):
                    packer.add(own, i)
                if packer.held > FLUSH:
                    yield packer.flush()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([links[0][2] % buckets], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([np.array(links, np.int64).tobytes()], pa.binary()), pa.array([[None] * len(links)], pa.list_(pa.binary()))], _SIGNED)
        if packer.held:
            yield packer.flush()

    return _with_sets(members, sets).mapInArrow(run, SIGNED)


def _sides(rows: DataFrame, key: str, by: str = "node") -> DataFrame:
    """Pairs of rows (key, node, label, spare, look) that share the key, a before b, of different labels, and near by their sketches."""
    side = lambda k: rows.select(key, *[F.col(c).alias(f"{c}_{k}") for c in {"node", "label", "spare", "look", by}])
    return side("a").join(side("b"), key).where((F.col(f"{by}_a") < F.col(f"{by}_b")) & (F.col("label_a") != F.col("label_b")) & near("look_a", "look_b"))


def members(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (see text_key()), n_shingles, component_id, label (of the component; null without words) for every document."""
    with small_batches(docs.sparkSession):
        return _members(docs)


def _members(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    # Words, and so signatures, are told from the texts' length: a sixth of it, three signatures for five words.
    chars = docs.agg(F.coalesce(F.sum(F.length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // 10 // TASK_SIGNATURES))
    met = saved(meet(sign(docs, 8 * partitions), partitions))
    known = met.where("sig is null").select("node", "doc_id", "text_key", "n_shingles", "least", *SKETCH, "fine")
    shared = met.where("sig is not null").select("sig", "node", "shared")

    # How often a node shares a signature, how many of its signatures are hot, and what it looks like.
    look = F.struct(F.col("n_shingles").alias("n"), *SKETCH)
    least = known.where("least > 0").groupBy("node").agg(F.min(F.struct("least", look.alias("look"))).alias("m")).select("node", "m.least", "m.look")
    nodes = shared.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("shared") > HOT).alias("hot"))
    n = F.col("look.n")
    # Saturated: a partner may share hot signatures alone.  Where a weak set has a hot signature, all sets with that count as such.
    flags = {"spare": F.col("least") - F.col("hot"), "weak": F.col("least") < usual(n), "saturated": F.col("hot") >= usual(F.floor(n * 3 / 4))}
    nodes = saved(nodes.join(least, "node").withColumns(flags).drop("least", "hot"))

    fine = known.where("fine is not null").join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("fine").alias("fine"))
    fine = saved(fine)

    # Round one: the leader of a signature is its node with most shared signatures.
    rich = shared.join(nodes.select("node", "degree"), "node")
    lead = saved(rich.groupBy("sig").agg(F.max(F.struct("degree", "node"))["node"].alias("leader")))
    met_leaders = shared.join(lead, "sig").where(F.col("node") != F.col("leader")).groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("node").orderBy(F.desc("n"), "leader")
    looks = nodes.select("node", "look", "spare")
    fit = met_leaders.join(looks, "node").join(looks.select(F.col("node").alias("leader"), F.col("look").alias("look2")), "leader").where(near("look", "look2"))
    fit = saved(fit.withColumn("k", F.row_number().over(best)).where(F.col("k") <= LEADERS).select("node", "leader", "k"))
    able = sketched(fit.select(F.col("node").alias("a"), F.col("leader").alias("b")), fine)
    # of those that their sketches allow the best one: nearly always a link
    able = able.join(fit, (F.col("a") == F.col("node")) & (F.col("b") == F.col("leader"))).groupBy("node").agg(F.min_by("leader", "k").alias("leader"))
    first = saved(able.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    sets = sets_of(docs, _nodes(first), known)
    links = saved(checked(first, sets))
    discard(sets)
    part = connected(links)

    def placed(rows: DataFrame, key: str, part: DataFrame) -> DataFrame:
        """rows with their nodes' labels, of keys that nodes of several components have."""
        out = rows.join(part, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = out.groupBy(key).agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select(key)
        return out.join(several, key, "left_semi")

    # Hot signatures: saturated nodes meet by their differences from the signature's leader.
    warm = placed(shared.where(F.col("shared") > HOT), "sig", part).join(nodes.select("node", "weak", "saturated"), "node").join(lead, "sig")
    any_weak = warm.where("weak").select("sig").distinct().withColumn("touched", F.lit(True))
    warm = saved(warm.join(any_weak, "sig", "left").where("saturated or touched").select("node", "leader").distinct())
    alike = None
    if warm.limit(1).count():
        sets = sets_of(docs, warm.select("node").union(warm.select("leader")), known)
        # Elements that few saturated sets have, and how many of a set's are common ones; two may be lost as equal in their first bits.
        found = saved(meet(elements(sets.join(warm.select("node"), "node", "left_semi"), partitions), partitions).select("sig", "node", "shared"))
        common = found.where(F.col("shared") > HOT).groupBy("node").agg(F.count(F.lit(1)).alias("common"))
        bound = common.join(looks, "node").where(4 * (F.col("common") + 2) >= 3 * F.col("look.n")).select("node")
        bound = bound.union(looks.where("look.n <= 2").select("node")).distinct()
        members = warm.join(bound, "node", "left_semi").where(F.col("node") != F.col("leader"))
        members = members.select(F.col("node").alias("a"), F.col("leader").alias("b"))
        keyed = saved(meet(by_differences(members, sets, partitions), partitions, sides=True).select("sig", "node", "doc_id").distinct())
        discard(sets)
        links = links.union(keyed.where("sig is null").select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
        part = connected(links)
        again = keyed.where("sig is not null").select(F.shiftright("sig", 1).alias("sig"), F.col("sig").bitwiseAND(1).alias("side"), "node")
        alike = _sides(placed(found.where(F.col("shared") <= HOT), "sig", part).join(looks, "node"), "sig").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        copies = _sides(placed(again, "sig", part).join(looks, "node"), "sig", "side").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        alike = alike.union(copies)

    # Other signatures: candidates of different components.
    cold = _sides(placed(shared.where(F.col("shared") <= HOT), "sig", part).join(looks, "node"), "sig")
    pairs = cold.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.least(F.min("spare_a"), F.min("spare_b")).alias("need"))
    pairs = pairs.where("n >= need").select("a", "b")
    pairs = pairs if alike is None else pairs.union(alike).distinct()
    second = saved(sketched(pairs.join(first, ["a", "b"], "left_anti"), fine))
    if second.limit(1).count():
        sets = sets_of(docs, _nodes(second), known)
        more = saved(checked(second, sets))
        discard(sets)
        part = connected(links.union(more))

    # Components are named by their least document.
    named = known.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n"))
    named = named.join(part, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tops = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(tops, "label").select("node", "n", "component_id", "label")
    out = known.select("node", "doc_id", "text_key", "n_shingles").join(named.where("n > 0").select("node", "component_id", "label"), "node", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return members(docs).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one, with the least doc_id and then text key.

    Rows without words are all kept, as they are linked with nothing.  Rows are told apart by doc_id and text, so
    different texts under one doc_id, or under none, are judged each; of rows equal in both one is kept.
    """
    found = saved(members(docs))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = found.where("label is not null").groupBy("label").agg(F.min(rank).alias("best"))
    judged = found.where("label is not null").join(best, "label").withColumn("stays", rank == F.col("best"))
    keys = saved(judged.groupBy(F.col("doc_id").alias("id"), "text_key", "stays").agg(F.count(F.lit(1)).alias("times")).where("not stays or times > 1"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key"))
    kept = rows.join(keys, same, "left_anti")
    repeated = keys.where("stays")
    if repeated.limit(1).count():
        one = rows.join(repeated, same, "left_semi").groupBy("own_id", "key").agg(F.min("row").alias("row"))
        kept = kept.select("row").unionByName(one.select("row"))
    return kept.select("row.*")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
grams as (
  select rid, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from d where len(w) >= 5
  union all select rid, array_to_string(w, ' ') from d where len(w) between 1 and 4),
sets as (select distinct rid, g from grams),
sizes as (select rid, count(*) as n from sets group by rid),
pairs as (select x.rid as a, y.rid as b, count(*) as n from sets x join sets y on x.g = y.g and x.rid <> y.rid group by 1, 2),
links as (select a, b from pairs join sizes sa on sa.rid = a join sizes sb on sb.rid = b where 100 * pairs.n >= 75 * (sa.n + sb.n - pairs.n)),
reach as (select rid, rid as other from d union select r.rid, l.b from reach r join links l on r.other = l.a),
top as (select r.rid, min(e.doc_id) as component_id from reach r join d e on e.rid = r.other group by r.rid)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from d join top using (rid) left join sizes using (rid)
"""
