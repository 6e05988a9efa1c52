"""Fast encoding of Arrow text columns with a public tokenizer.

A text is cut where the tokenizer's own pre-tokenization cuts in any case; the
pieces are hashed in bulk and only those not met before go to the tokenizers
library: pieces that are one pre-token straight to its model, all others
through the whole tokenizer.  A text that holds one of the tokenizer's added
tokens goes through the library whole.  The ids are the library's for the whole
text, but for pieces that share a 64-bit hash: among n different pieces of a
task two do with probability n**2 / 2**65, below 2**-22 for the most pieces kept.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from brindle.llm import textbytes as tb

#: Most pieces and ids kept; beyond them the memory of pieces starts anew.
MOST_PIECES, MOST_IDS, SLOTS = 2_500_000, 12_000_000, 1 << 22
#: Pieces that go to the library together; each is several objects until its ids are kept.
LEARNT = 1 << 13
#: Bytes of text looked at together, some fifty times as many in arrays; a longer text is looked at alone.
BLOCK = 512 << 10
LETTER, DIGIT, OTHER, BLANK, UNKNOWN = range(5)


def _classes() -> np.ndarray:
    c = np.full(256, UNKNOWN, np.uint8)
    c[0x21:0x7F] = OTHER
    c[0x30:0x3A] = DIGIT
    c[0x41:0x5B] = c[0x61:0x7B] = LETTER
    c[[0x20, 0x0A]] = BLANK
    return c


def _byte_characters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: visible Latin-1 characters for themselves, others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in kept)}


_CLASS, _STAND_IN = _classes(), _byte_characters()


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Each byte's class; of characters beyond ASCII the letters U+00C0 to U+00FF are known."""
    c = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    c[lead] = c[lead + 1] = LETTER
    return c


def _cuts(data: np.ndarray, off: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where in both patterns a pre-token starts: at a change between known letters, digits and other visible characters, but for a letter after an apostrophe."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        a, b = c[:-1], c[1:]
        cut[1:-1] = (a != b) & (a < BLANK) & (b < BLANK) & ~((data[:-1] == 0x27) & (b == LETTER))
    cut[off[:-1][off[1:] > off[:-1]]] = True
    cut[-1] = False
    return cut


def _before(odd: np.ndarray) -> np.ndarray:
    """How many bytes before each place are odd; a column's row has fewer than 2**31 bytes."""
    total = np.zeros(len(odd) + 1, np.int32)
    np.cumsum(odd, out=total[1:])
    return total


def byte_level_pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, each text's first piece, and which pieces are one pre-token, for byte-level vocabularies.

    There a blank between known visible characters starts a pre-token, and a lone line feed is one.
    """
    c = byte_classes(data)
    cut = _cuts(data, off, c)
    at = np.flatnonzero(c[1:-1] == BLANK) + 1 if len(c) > 2 else np.zeros(0, np.int64)
    at = at[(c[at - 1] < BLANK) & (c[at + 1] < BLANK)]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    at = at[~edge[at] & ~edge[at + 1]]
    cut[at] = True
    feeds = at[data[at] == 0x0A]
    cut[feeds + 1] = True
    s = np.flatnonzero(cut)
    e = np.append(s[1:], len(data)) if len(s) else s
    odd = c >= BLANK
    odd[1:] |= (data[:-1] == 0x27) & (c[1:] == LETTER)
    total = _before(odd)
    lead = (data[s] == 0x20) if len(s) else np.zeros(0, bool)
    return s, e, np.searchsorted(s, off), (total[e] - total[s] == lead) & (e - s > lead)


def spaced_pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for vocabularies that drop white space and take digits one by one."""
    c = byte_classes(data)
    cut = _cuts(data, off, c)
    seen = tb.SPACED[data]
    if len(data) > 1:
        cut[1:-1] |= seen[1:] != seen[:-1]
    s = np.flatnonzero(cut)
    e = np.append(s[1:], len(data)) if len(s) else s
    keep = seen[s]
    s, e = s[keep], e[keep]
    odd = c >= BLANK
    odd[1:] |= ((data[:-1] == 0x27) & (c[1:] == LETTER)) | ((c[1:] == DIGIT) & (c[:-1] == DIGIT))
    total = _before(odd)
    return s, e, np.searchsorted(s, off), (total[e] == total[np.minimum(s + 1, e)]) & (c[s] < BLANK)


def _with_room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy twice as long, or more, in which n values have room; what isn't written takes no memory."""
    if n <= len(x):
        return x
    out = np.zeros(len(x) << (-(-n // len(x)) - 1).bit_length(), x.dtype)
    out[: len(x)] = x
    return out


@functools.lru_cache(1)
def _loaded(path: str):
    """A worker's last tokenizer: loaded anew for each task, it leaves a little more behind every time."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """ids of texts; pieces: one of the two functions above, as fits the tokenizer."""

    def __init__(self, path: str, pieces):
        self.tokenizer = _loaded(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.pieces = self.tokenizer.model, pieces
        self.lower = pieces is spaced_pieces
        self.kind = np.uint16 if max(self.tokenizer.get_vocab(True).values(), default=0) < 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.start, self.n = np.zeros(1 << 16, np.uint32), 0  # a piece's ids end where those of the next start
        self.flat, self.used = np.zeros(1 << 20, self.kind), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the hashes, -1 for those not met."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot[left]]
            same = key == h[left]
            out[left[same]] = slot[left[same]]
            left = left[~same & (key != 0)]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        return out

    def _learn(self, h: np.ndarray, raw: list[bytes], simple: list[bool]) -> None:
        found: list = [None] * len(raw)
        tokenize = self.model.tokenize
        for k in [k for k, x in enumerate(simple) if x]:
            x = raw[k].decode().lower().encode() if self.lower else raw[k]
            found[k] = [t.id for t in tokenize(x.decode("latin-1").translate(_STAND_IN))]
        rest = [k for k, x in enumerate(simple) if not x]
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([raw[k].decode() for k in rest], add_special_tokens=False), strict=True):
            found[k] = x.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), self.kind, int(sizes.sum()))
        self.flat, self.start = _with_room(self.flat, self.used + len(ids)), _with_room(self.start, self.n + len(h) + 1)
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.n + 1 : self.n + len(h) + 1] = self.used + np.cumsum(sizes)
        entry = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n, self.used = self.n + len(h), self.used + len(ids)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            free = free[np.argsort(slot[free], kind="stable")]
            won = free[np.concatenate([[True], slot[free][1:] != slot[free][:-1]])[: len(free)]]
            self.keys[slot[won]], self.entry[slot[won]] = h[won], entry[won]
            lost = np.ones(len(h), bool)
            lost[won] = False
            left = left[lost[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and each text's offset."""
        data, off = tb.text_bytes(column)
        ids, at = self._by_blocks(data, off)
        whole = self._with_added(data, off)
        if not len(whole):
            return ids, at
        raw = [data[off[k] : off[k + 1]].tobytes().decode() for k in whole.tolist()]
        sizes, parts, last = np.diff(at), [], 0
        for k, found in zip(whole.tolist(), self.tokenizer.encode_batch_fast(raw, add_special_tokens=False), strict=True):
            parts += [ids[last : at[k]], np.array(found.ids, np.uint32)]
            sizes[k], last = len(found.ids), at[k + 1]
        return np.concatenate([*parts, ids[last:]]), np.concatenate([[0], np.cumsum(sizes)])

    def _with_added(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold an added token."""
        raw, out = data.tobytes(), set()
        for token in self.added:
            where = raw.find(token)
            while where >= 0:
                text = int(np.searchsorted(off, where, "right")) - 1
                if where + len(token) <= off[text + 1]:
                    out.add(text)
                    where = raw.find(token, int(off[text + 1]))  # one is enough
                else:
                    where = raw.find(token, where + 1)
        return np.array(sorted(out), np.int64)

    def _by_blocks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and offsets of texts without added tokens, a block of whole texts at a time."""
        parts, at, row = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        while row < len(off) - 1:
            to = max(row + 1, int(np.searchsorted(off, off[row] + BLOCK, "right")) - 1)
            ids, ends = self._plain(data[off[row] : off[to]], off[row : to + 1] - off[row])
            parts.append(ids)
            at.append(at[-1][-1] + ends[1:])
            row = to
        return np.concatenate(parts), np.concatenate(at)

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the texts of a block."""
        s, e, first, simple = self.pieces(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        h = tb.run_hashes(data, s, e) | np.uint64(1)
        while (missing := (at := self._find(h)) < 0).any():
            where = np.flatnonzero(missing)
            where = where[np.argsort(h[where], kind="stable")]
            where = where[np.concatenate([[True], h[where][1:] != h[where][:-1]])]
            if self.n and (self.n + len(where) > MOST_PIECES or self.used > MOST_IDS):
                self._clear()
                continue
            raw = data.tobytes()
            for k in range(0, len(where), LEARNT):
                new = where[k : k + LEARNT]
                self._learn(h[new], [raw[a:b] for a, b in zip(s[new].tolist(), e[new].tolist(), strict=True)], simple[new].tolist())
        entry = self.entry[at]
        start = self.start[entry].astype(np.int64)
        sizes = self.start[entry + 1] - start
        ids = self.flat[tb.ranges(start, sizes)].astype(np.uint32)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[first]


@functools.lru_cache(1)
def shared_encoder(path: str, pieces) -> Encoder:
    """The encoder of a worker's last tokenizer: pieces that a task met needn't be encoded again by the next."""
    return Encoder(path, pieces)
