"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces, vectorised over many texts.

Byte-level BPE never merges across a single blank (or line feed) that stands between two
characters that aren't white space: the pre-tokeniser always starts a new word there, as it does between a letter and a mark. So texts are cut
there, and each piece's ids are looked up in a table; only pieces not seen before go through the library, many in one call. Where it isn't certain
that a neighbour is no white space (its bytes begin as those of some white space do), the text isn't cut, which only makes a longer piece.

The table is keyed by a 64-bit hash, and every hit is compared byte by byte, so the ids are those of the library. It starts anew when it would
outgrow its bytes, and texts are looked at in slices of bounded size, a long text in several, so memory doesn't depend on the corpus.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import quiet_threads, trim
from tessera.llm.hashing import VALUES, mix, powers

#: First bytes of UTF-8 white space beyond ASCII.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_PLAIN = np.arange(256) > 0x20
_NEXT = _PLAIN & ~_LEADS
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True

TEXTS = 512  # texts encoded together
SLICE = 1 << 20  # bytes looked at together
TABLE_BYTES = 96 << 20  # of the table of a worker

_made: dict = {}


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of the texts data[offs[i]:offs[i + 1]]."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[~edge[at]]
    at = at[~edge[at + 1]]
    at = at[_NEXT[data[at + 1]]]
    before = data[at - 1]
    ok = _PLAIN[before]
    wide = np.flatnonzero(before >= 0x80)
    w = at[wide]
    ok[wide] = (data[w - 2] != 0xC2) & ~((data[np.maximum(w - 3, 0)] >= 0xE1) & (data[np.maximum(w - 3, 0)] <= 0xE3))
    start = edge[:-1].copy()
    start[at[ok]] = True
    # a word's final mark: letters never join it
    at = np.flatnonzero(_MARK[data])
    at = at[~edge[at]]
    before, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    at = at[_LETTER[before] | ((lead == 0xC3) & (before != 0x97) & (before != 0xB7))]  # ASCII, or Latin-1 but for the signs of multiplication and division
    after = np.minimum(at + 1, n - 1)
    start[at[edge[at + 1] | ~_PLAIN[data[after]]]] = True
    return np.flatnonzero(start)


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + lens[i] - 1, one run after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


class _Store:
    """An array that grows in place."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> int:
        """Where x begins."""
        if self.n + len(x) > len(self.data):
            self.data.resize(max(self.n + len(x), len(self.data) * 3 // 2), refcheck=False)
        a = self.n
        self.data[a: a + len(x)] = x
        self.n += len(x)
        return a


class PieceEncoder:
    """``most_bytes`` bounds the table of cached pieces; a full table starts anew."""

    def __init__(self, path: str, most_bytes: int = TABLE_BYTES):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = True  # such strings in a document are ordinary text
        n = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(n, np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(token)  # byte-level alphabet: a character for each byte
        self.most_bytes = most_bytes
        self._clear()

    def _clear(self) -> None:
        self.slots = 1 << 14
        self.key, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.hash = _Store(np.uint64)
        self.first_id, self.n_ids, self.first_byte, self.n_bytes = (_Store(np.int32) for _ in range(4))
        self.ids, self.bytes = _Store(self.dtype), _Store(np.uint8)

    def _stores(self) -> list[_Store]:
        return [self.hash, self.first_id, self.n_ids, self.first_byte, self.n_bytes, self.ids, self.bytes]

    def table_bytes(self, more: int = 0, piece_bytes: int = 0) -> int:
        """Bytes of the table, or a bound of them with ``more`` pieces of ``piece_bytes`` together (a piece has no more ids than bytes)."""
        if not more:
            return self.slots * 12 + sum(x.data.nbytes for x in self._stores())
        slots = self.slots
        while 2 * (self.hash.n + more) > slots:
            slots *= 2
        adds = [more] * 5 + [piece_bytes] * 2
        return slots * 12 + sum(max(x.data.nbytes, max(x.n + n, len(x.data) * 3 // 2 if x.n + n > len(x.data) else 0) * x.data.itemsize) for x, n in zip(self._stores(), adds))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            k = self.key[slot]
            hit = k == h[left]
            out[left[hit]] = self.entry[slot[hit]]
            more = ~hit & (k != 0)
            left, slot = left[more], (slot[more] + 1) & (self.slots - 1)
        return out

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.key[slot] == 0)
            self.key[slot[free]] = h[free]
            own = free[self.key[slot[free]] == h[free]]
            self.entry[slot[own]] = entry[own]
            lost = np.ones(len(h), bool)
            lost[own] = False
            h, entry, slot = h[lost], entry[lost], (slot[lost] + 1) & (self.slots - 1)

    def _encode(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has. ``joined``: may be encoded as one string with others."""
        count, parts = np.zeros(len(starts), np.int64), []
        j = np.flatnonzero(joined)
        if len(j):
            text = data[spread(starts[j], lens[j])].tobytes().decode("utf-8", "surrogatepass")
            flat = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.lengths[flat]), np.cumsum(lens[j]), side="left") + 1
            count[j] = np.diff(ends, prepend=0)
            parts.append(flat)
        own = np.flatnonzero(~joined)
        if len(own):
            texts = [data[a: a + n].tobytes().decode("utf-8", "surrogatepass") for a, n in zip(starts[own].tolist(), lens[own].tolist())]
            got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            count[own] = list(map(len, got))
            parts += [np.array(x, np.int64) for x in got]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        place = np.zeros(len(starts), np.int64)  # where each piece's ids are in ``flat``
        order = np.concatenate([j, own])
        place[order] = np.cumsum(count[order]) - count[order]
        return flat[spread(place, count)].astype(self.dtype), count

    def _ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at ``starts`` and fill ``data``, one after the other, and how many each has."""
        lens = np.diff(np.append(starts, len(data)))
        within = np.arange(len(data)) - np.repeat(starts, lens)
        value = VALUES[data] * powers(int(lens.max()))[within]
        h = mix(np.add.reduceat(value, starts) + lens.astype(np.uint64)) | np.uint64(1)  # 0 marks a free slot
        del value
        e = self._find(h)
        new = np.flatnonzero(e < 0)
        if len(new):
            names, first = np.unique(h[new], return_index=True)
            if self.table_bytes(len(names), int(lens[new[first]].sum())) > self.most_bytes and self.hash.n:
                self._clear()
                new = np.arange(len(h))
                names, first = np.unique(h, return_index=True)
            at = new[first]
            s, n = starts[at], lens[at]
            # a piece that starts with white space and ends without may stand between others
            end = s + n
            last = data[end - 1]
            sure = _PLAIN[last] & (n > 1)
            wide = np.flatnonzero(last >= 0x80)
            w = end[wide]
            sure[wide] &= (data[w - 2] != 0xC2) & ~((data[np.maximum(w - 3, 0)] >= 0xE1) & (data[np.maximum(w - 3, 0)] <= 0xE3))
            lead = ((data[s] == 0x20) | (data[s] == 0x0A)) & _NEXT[data[np.minimum(s + 1, len(data) - 1)]]
            ids, count = self._encode(data, s, n, sure & lead)
            a = self.ids.add(ids)
            b = self.bytes.add(data[spread(s, n)])
            base = self.hash.add(names)
            self.first_id.add(a + np.cumsum(count) - count)
            self.n_ids.add(count)
            self.first_byte.add(b + np.cumsum(n) - n)
            self.n_bytes.add(n)
            if 2 * self.hash.n > self.slots:
                while 2 * self.hash.n > self.slots:
                    self.slots *= 2
                self.key = self.entry = None  # gone before the larger ones come
                self.key, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
                self._insert(self.hash.data[: self.hash.n].copy(), np.arange(self.hash.n, dtype=np.int32))
            else:
                self._insert(names, np.arange(base, base + len(names), dtype=np.int32))
            e[new] = self._find(h[new]) if len(new) < len(h) else self._find(h)
        count = self.n_ids.data[e].astype(np.int64)
        ids = self.ids.data[spread(self.first_id.data[e].astype(np.int64), count)]
        ok = self.n_bytes.data[e] == lens
        within += np.repeat(self.first_byte.data[e].astype(np.int64), lens)
        if not (ok.all() and (self.bytes.data.take(within, mode="clip") == data).all()):  # two pieces with one hash: these go through the library
            ids, count = self._encode(data, starts, lens, np.zeros(len(starts), bool))
        return ids, count

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each text's begin and end."""
        if len(data) == 0:
            return np.zeros(0, self.dtype), np.zeros(len(offs), np.int64)
        found, ends, a, n, done = [], [np.zeros(1, np.int64)], 0, len(offs) - 1, 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + SLICE, side="right")) - 1)
            part, own = data[offs[a]: offs[b]], offs[a: b + 1] - offs[a]
            starts = cuts(part, own) if len(part) else np.zeros(0, np.int64)
            counts, x = [np.zeros(1, np.int64)], 0
            while x < len(starts):  # one slice, or several of a long text
                y = max(x + 1, int(np.searchsorted(starts, starts[x] + SLICE, side="right")))
                stop = starts[y] if y < len(starts) else len(part)
                ids, count = self._ids(part[starts[x]: stop], starts[x:y] - starts[x])
                found.append(ids)
                counts.append(count)
                x = y
            total = np.cumsum(np.concatenate(counts))
            ends.append(done + total[np.searchsorted(starts, own[1:])])
            done += int(total[-1])
            a = b
        return np.concatenate(found) if found else np.zeros(0, self.dtype), np.concatenate(ends)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ids, at = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    if path not in _made:
        _made[path] = PieceEncoder(path)
    return _made[path]


def release() -> None:
    """Forget the encoders of this worker; stages that don't tokenise call it, as workers are used again."""
    if _made:
        _made.clear()
        trim()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
