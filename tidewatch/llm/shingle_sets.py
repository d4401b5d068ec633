"""Sets of word shingles: sketches, PartEnum signatures, and keys of differences from a common set.

Two sets link when 4 |A & B| >= 3 |A | B|; they then differ in at most K = (|A| + |B|) / 7 elements.

signatures() is PartEnum.  Sets are banded by size (powers of two).  A band's domain is cut by a hash into
partitions, about 3/8 of the band's top; taken in twos, these are PartEnum's groups with two second-level
partitions each, and its enumerated subsets are those of one partition (two less the one that may differ).
Each differing element spoils at most one partition.  In the fixed order of partitions, of the first K + 1 + h
that either of two sets fills, at least h + 1 agree if at most K differ; so a set signs its first K + 1 + h
filled partitions, and linked sets share at least h + 1 signatures.  A set within reach of the next band signs
for that band as well.  Should a set fill too few partitions for this to hold, it signs again under another
hash.  (Subsets of two of three partitions were tried: 1.6 times the signatures, and more of them common.)

difference_keys() serves sets that are compared with a common set, the hub.  Differences from the hub have
the same distance as the sets themselves.  With a elements added and m missing, and w = 6 a + 8 m, a set
links with a hub of n elements if w <= 2 n, and two sets x, y link only if their differences share
(w_x + w_y - 2 n) / 14 elements.  So prefixes of the differences, added elements first, must meet; sets that
both link with the hub need no key.  Prefix lengths depend on the partner's w, which is banded.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from tidewatch.llm.common import lower_words

WORDS = 5

#: The bit of a key of differences that isn't compared.
SIDE = np.uint64(1 << 24)

_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 5-gram hashes of texts; word hashes are remembered, up to a number."""

    def __init__(self, words: int = WORDS, limit: int = 200_000):
        self.words, self.limit, self.memo = words, limit, {}

    def __call__(self, text: str | None) -> np.ndarray:
        w = lower_words(text)
        if not w:
            return np.empty(0, np.uint64)
        if len(w) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        for x in set(w).difference(memo):
            memo[x] = xxhash.xxh64_intdigest(x)
        h = np.array(list(map(memo.__getitem__, w)), np.uint64)
        n = len(h) - self.words + 1
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.words):
                out = (out ^ (out >> np.uint64(29))) * _M + h[k : k + n]
        return np.unique(mix(out))


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - 2**63


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 4 * both >= 3 * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> np.ndarray:
    """Eight 64-bit numbers: the parities of the set's elements in 512 cells."""
    odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_sketch(s: np.ndarray) -> bytes:
    """Parities in a power of two of cells, four or more an element; an element's cell is its hash's low bits."""
    cells = max(512, 1 << (4 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(a: bytes, b: bytes, total: int) -> bool:
    """May two sets with so many elements together link, by their fine sketches; the larger one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return 7 * int(np.bitwise_count(x ^ y).sum()) <= total


def _signed(s: np.ndarray, level: int, reach: int, own: int) -> tuple[list[np.ndarray], int]:
    """Signatures of a set of size own for a band, when its partners have at most reach elements, and how many
    a partner must share."""
    top = 1 << level
    n = -(-3 * top // 8) + 4
    k = (own + reach) // 7
    spare = own // 20 + 1
    out = []
    for seed in range(5):
        with np.errstate(over="ignore"):
            mixed = mix(s + np.uint64((seed + 1) * 0xD1B54A32D192ED03 % 2**64))
            q = (mixed >> np.uint64(33)).astype(np.int64)
            if seed < 4:
                q %= n
            order = np.argsort(q, kind="stable")
            q = q[order]
            at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            part = np.add.reduceat(mixed[order], at)
            use = k + 1 + spare
            tag = np.uint64((level * 8 + seed + 1) * 0xA24BAED4963EE407 % 2**64)
            out.append(mix(mix(part[:use]) ^ (q[at[:use]].astype(np.uint64) * _M) ^ tag))
        if len(at) > k:
            return out, min(spare + 1, len(at) - k) if not seed else 1
    return out, 1


def signatures(s: np.ndarray) -> tuple[np.ndarray, int]:
    """All distinct signatures of a nonempty set, and how many a linked set shares at least."""
    n = len(s)
    level = (n - 1).bit_length()
    out, least = _signed(s, level, min(1 << level, 4 * n // 3), n)
    if 4 * n // 3 > 1 << level:
        more, other = _signed(s, level + 1, 4 * n // 3, n)
        out, least = out + more, min(least, other)
    return np.unique(np.concatenate(out)), least


@lru_cache(maxsize=1000)
def difference_bands(hub_size: int) -> tuple[int, ...]:
    """Edges of the bands of w, by tenths up to 2 n, where sets link with the hub, and by twentieths beyond."""
    two = 2 * hub_size
    inner = {int(two / 1.1**k) for k in range(1, 31)}
    outer, x = [], two + 1
    while x < 100 * (two + 16):
        outer.append(x)
        x = max(x + 1, x * 21 // 20)
    return tuple(sorted({0} | {v for v in inner if v <= two})) + (*outer, 2**62)


def difference_keys(s: np.ndarray, hub: np.ndarray, hub_node: int) -> tuple[bool, np.ndarray]:
    """Does the set link with the hub, and the keys of which it shares one with each linked set of which not both do.

    A key's bit SIDE tells the set of the lower band from that of the higher one; sets meet from different sides.
    """
    added, missing = np.setdiff1d(s, hub, assume_unique=True), np.setdiff1d(hub, s, assume_unique=True)
    w, two, d = 6 * len(added) + 8 * len(missing), 2 * len(hub), len(added) + len(missing)
    order = np.r_[added, missing]
    edges = difference_bands(len(hub))
    own = int(np.searchsorted(edges, w, side="right")) - 1
    out = []
    for band in range(len(edges) - 1):
        low, high = edges[band], edges[band + 1] - 1
        least = max(1, -(-(w + low - two) // 14))
        if least > d:
            break
        if (w <= two and high <= two) or 6 * least > high:
            continue
        pair = (min(own, band) << 16 | max(own, band)) + 1
        with np.errstate(over="ignore"):
            keys = mix(mix(order[: d - least + 1] ^ np.uint64(hub_node % 2**64)) + np.uint64(pair) * _M) & ~SIDE
        out += [keys] * (own <= band) + [keys | SIDE] * (own >= band)
    return w <= two, np.concatenate(out) if out else np.empty(0, np.uint64)
