"""Byte-level BPE of the tokenizers library, applied to distinct chunks.

Texts are cut before single spaces, where the library's pattern always cuts too, and the chunks of a
group of texts are made a dictionary by Arrow, whose first entries are the chunks that the worker
remembers.  The others are cut by the pattern, their pieces are made a dictionary in the same way, the
library's BPE model encodes the pieces that the worker doesn't remember, and ids are gathered from
pieces to chunks to texts.  Equality with the library's encode_batch() is tested.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tidewatch.llm.common import ANY_SPACE, chunks

#: The pattern of byte-level pre-tokenizers (public_tokenizers.PATTERN), with white space spelt out as the libraries have it.
SPACES = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_ODD = f" (?:[{ANY_SPACE}]|$)"

#: Bytes of texts that are encoded at a time: each time, what is remembered is put in a dictionary anew.
GROUP_BYTES = 8_000_000
#: Bytes of the longest names that are remembered for long: texts without spaces are one chunk.
LONGEST = 1024


def byte_chars() -> dict[int, str]:
    """What byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def _starts(strings: pa.Array) -> np.ndarray:
    """Where each of the strings begins in their characters one after another, with their end."""
    return np.concatenate([[0], np.cumsum(pc.utf8_length(strings).to_numpy())])


class Memo:
    """Ids of distinct names, remembered up to a number of names and of bytes; the most used quarter outlives that, without long names.

    encode gives ids, and how many there are of each name, of names (strings, none null).
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit = encode, limit
        self.names = pa.array([], pa.string())
        self.start, self.flat, self.used = np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def _forget(self) -> None:
        size = pc.binary_length(self.names).to_numpy().astype(np.int64)
        best = np.argsort(-self.used, kind="stable")
        best = best[size[best] <= LONGEST][: self.limit // 4]
        stay = np.sort(best[np.cumsum(size[best]) <= 8 * self.limit])
        n = np.diff(self.start)
        keep = np.zeros(len(n), bool)
        keep[stay] = True
        self.flat = self.flat[np.repeat(keep, n)]
        self.start = np.r_[0, np.cumsum(n[stay])]
        self.used = self.used[stay] // 2
        self.names = self.names.take(pa.array(stay))

    def codes(self, *parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All names, those remembered first, and the places among them of the parts' values, one part after another."""
        if len(self.names) > self.limit or self.names.nbytes > 32 * self.limit:  # a name has no more ids than bytes, but for a space
            self._forget()
        coded = pa.chunked_array([self.names, *parts]).dictionary_encode().chunks  # without empty ones
        return coded[-1].dictionary, np.concatenate([c.indices.to_numpy() for c in coded]).astype(np.int64)[len(self.names) :]

    def slots(self, names: pa.Array, index: np.ndarray) -> np.ndarray:
        """Slots of names[index]; of the names that codes() gave, those in index alone are learnt."""
        held, uses = len(self.names), np.bincount(index, minlength=len(names))
        new = held + np.flatnonzero(uses[held:])
        if not len(new):
            self.used += uses[:held]
            return index
        fresh = names.take(pa.array(new))
        ids, n = self.encode(fresh)
        self.names = pa.concat_arrays([self.names, fresh])
        self.flat = np.concatenate([self.flat, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        self.used = np.concatenate([self.used + uses[:held], uses[new]])
        place = np.arange(len(names))
        place[new] = np.arange(held, held + len(new))
        return place[index]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slots one after another, and where each slot's begin, with their end."""
        begin, n = self.start[slots], np.diff(self.start)[slots]
        at = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(begin - at[:-1], n) + np.arange(at[-1])], at


class Pieces(Memo):
    """Ids of pieces by the library's model."""

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__(self._tokenize, limit)
        self.model = Tokenizer.from_file(path).model
        self.chars = np.array([ord(c) for _, c in sorted(byte_chars().items())], "<u2")

    def _tokenize(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, at, data = names.buffers()
        at = np.frombuffer(at, np.int32)[names.offset : names.offset + len(names) + 1].tolist()
        plain = self.chars[np.frombuffer(data, np.uint8)[at[0] : at[-1]]].tobytes().decode("utf-16-le")
        tokenize, ids, ends = self.model.tokenize, array("i"), array("q", [0])
        for i, j in zip(at[:-1], at[1:], strict=True):
            ids.extend([t.id for t in tokenize(plain[i - at[0] : j - at[0]])])
            ends.append(len(ids))
        return np.frombuffer(ids, np.int32), np.diff(np.frombuffer(ends, np.int64))


class ChunkTable(Memo):
    """Ids of texts by way of their chunks.

    A name that starts with a space stands for the rest, any other for itself with a space before it.
    """

    def __init__(self, path: str, limit: int = 500_000):
        super().__init__(self._cut, limit)
        self.pieces = Pieces(path)

    def _cut(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As codes() has the texts' first chunks first, names that start with a space come before all others."""
        k = pc.sum(pc.starts_with(names, " ")).as_py()
        found, ends = [], [0]
        for x in names[:k].to_pylist():
            found += PIECES.findall(x[1:])
            ends.append(len(found))
        bare, spaced = len(found), names[k:]
        if len(spaced):
            found += PIECES.findall(" " + " ".join(spaced.to_pylist()))  # no white space is behind these spaces
        if not found:
            return np.empty(0, np.int32), np.zeros(k, np.int64)
        pieces = pa.array(found)
        ids, at = self.pieces.gather(self.pieces.slots(*self.pieces.codes(pieces)))
        last = np.searchsorted(_starts(pieces[bare:]), _starts(spaced)[1:] + np.arange(1, len(spaced) + 1))
        return ids, np.diff(at[np.concatenate([ends, bare + last])])

    def _slots_of(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all chunks of lists of chunks, none empty, and the lists' offsets."""
        at = lists.offsets.to_numpy()
        firsts = pc.binary_join_element_wise("", lists.values.take(pa.array(at[:-1])), " ")  # no space stands before these
        names, index = self.codes(firsts, lists.values)
        own, index = index[: len(firsts)], index[len(firsts) :]
        index[at[:-1]] = own
        return self.slots(names, index), at

    def _lists(self, texts: pa.Array) -> list[tuple[np.ndarray, pa.ListArray]]:
        """Places in texts, and lists of chunks of the texts there."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out = []
        for places in (np.flatnonzero(~odd), np.flatnonzero(odd)):
            if len(places):
                some = texts.take(pa.array(places))
                out.append((places, pa.array([chunks(t) for t in some.to_pylist()], pa.list_(pa.string())) if odd[places[0]] else pc.split_pattern(some, " ")))
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text (strings, none null)."""
        out = np.zeros(len(texts), np.int64)
        for places, lists in self._lists(texts):
            slots, at = self._slots_of(lists)
            out[places] = np.add.reduceat(np.diff(self.start)[slots], at[:-1])
        return out

    def ids(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text (strings, none null), as a list array of int32."""
        parts, order = [pa.array([], pa.list_(pa.int32()))], [np.empty(0, np.int64)]
        for places, lists in self._lists(texts):
            slots, at = self._slots_of(lists)
            values, ends = self.gather(slots)
            parts.append(pa.ListArray.from_arrays(pa.array(ends[at].astype(np.int32)), pa.array(values)))
            order.append(places)
        place = np.argsort(np.concatenate(order))
        out = pa.concat_arrays(parts)
        return out if (np.diff(place) == 1).all() else out.take(pa.array(place))


@lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    """The worker's table of chunks' ids; tasks share it."""
    return ChunkTable(path)
