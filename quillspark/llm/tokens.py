"""Token ids of whole texts with a public tokenizer, computed once per distinct word piece.

The tokenizer's rule cuts a text at white space and between runs of letters, digits and other signs; no id
depends on what lies beyond such a cut. So a batch is cut at places where both neighbours are ASCII and of
different kinds, each distinct piece is encoded once, and the ids of a text are those of its pieces in order.
Pieces seen before are kept in a table of bounded size in the worker. A hash finds a piece, and its bytes are
compared; where two pieces have one hash, the tokenizer encodes the texts of the batch whole.
"""

from __future__ import annotations

import re

import numpy as np

from quillspark.llm.kernels import SPACE, lower_ascii, same_bytes, spread, word_hash

#: Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 other ASCII, 4 beyond ASCII.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[0x30:0x3A] = 2
KIND[0x80:] = 4
#: Distinct pieces that a worker keeps, and bytes of them; beyond these the table starts again.
MAX_PIECES, MAX_BYTES = 1_000_000, 32 << 20
_encoders: dict[str, PieceEncoder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        #: Whether an id ends a word. False throughout for vocabularies without word ends.
        self.last = np.fromiter(((self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)), bool, size)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)).encode() or b"(?!)", re.IGNORECASE)
        probe = "abracadabra"
        #: Whether lower-case ASCII letters reach the model as they are.
        self.direct = [x.id for x in self.tokenizer.model.tokenize(probe)] == self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted; the others stand in order of arrival
        self.first = np.zeros(0, np.int64)  # of a piece's ids in self.ids
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.at, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a piece's bytes in self.blob
        self.blob = np.zeros(0, np.uint8)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if self.direct and all(x.isascii() and x.isalpha() for x in pieces):
            found = [[y.id for y in self.tokenizer.model.tokenize(x)] for x in pieces]
            self.keep(keys, pieces, np.fromiter(map(len, found), np.int64, len(found)), None, np.fromiter((i for x in found for i in x), np.uint32))
            return
        if self.direct and any(simple := [x.isascii() and x.isalpha() for x in pieces]):
            simple = np.array(simple)
            for part in (simple, ~simple):
                self.learn(keys[part], [pieces[i] for i in np.flatnonzero(part)])
            return
        plain = np.fromiter((x.isalpha() and "İ" not in x for x in pieces), bool, len(pieces))
        count, ids = np.zeros(len(pieces), np.int64), []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        if plain.any():
            n, found = self.together([pieces[i] for i in np.flatnonzero(plain)])
            count[plain] = n
            ids.append(found)
        if not plain.all():
            found = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[i] for i in np.flatnonzero(~plain)], add_special_tokens=False)]
            count[~plain] = [len(x) for x in found]
            ids.append(np.fromiter((i for x in found for i in x), np.uint32))
        self.keep(keys, pieces, count, order, np.concatenate(ids))

    def keep(self, keys: np.ndarray, pieces: list[str], count: np.ndarray, order: np.ndarray | None, ids: np.ndarray) -> None:
        """Add pieces to the table; order: in which the ids of the pieces stand."""
        first = np.zeros(len(count), np.int64)
        order = np.arange(len(count)) if order is None else order
        first[order] = len(self.ids) + np.cumsum(count[order]) - count[order]
        self.ids = np.concatenate([self.ids, ids])
        data = [x.encode() for x in pieces]
        ends = len(self.blob) + np.cumsum([len(x) for x in data])
        starts = ends - np.array([len(x) for x in data])
        self.blob = np.concatenate([self.blob, np.frombuffer(b"".join(data), np.uint8)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, np.arange(len(self.first), len(self.first) + len(keys)))
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])
        self.at, self.end = np.concatenate([self.at, starts]), np.concatenate([self.end, ends])

    def together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are one word each: encoded as lines of many words and cut where a word ends."""
        lines = [" ".join(pieces[i : i + 256]) for i in range(0, len(pieces), 256)]
        ids = np.concatenate([np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids])
        if len(ends) == len(pieces) and ends[-1] == len(ids) - 1:
            return np.diff(ends, prepend=-1), ids
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([len(x) for x in found]), np.fromiter((i for x in found for i in x), np.uint32)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids before each text."""
        if not self.special.search(memoryview(np.ascontiguousarray(raw))):
            return self.encode_pieces(raw, offsets)
        parts = []  # a text that spells out a special token goes to the tokenizer as it is
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if self.special.search(data := raw[a:b].tobytes()):
                parts.append(np.asarray(self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(self.encode_pieces(raw[a:b], np.array([0, b - a]))[0])
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def encode_pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = pieces_of(raw, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        low = lower_ascii(raw)
        keys = word_hash(low, starts, ends)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        known = self.known(distinct)
        if len(distinct) > MAX_PIECES or not known.all():
            if len(self.keys) + int((~known).sum()) > MAX_PIECES or len(self.blob) > MAX_BYTES:
                self.clear()
                known[:] = False
            new = where[~known]
            data = low.tobytes()
            self.learn(distinct[~known], [data[s:e].decode("utf-8", "replace") for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        at = self.slot[np.searchsorted(self.keys, distinct)][back]
        n = ends - starts
        if not ((self.end[at] - self.at[at] == n).all() and same_bytes(low, starts, self.blob, self.at[at], n).all()):
            return self.encode_texts(raw, offsets)  # two pieces of one hash
        count = self.count[at]
        ids = self.ids[spread(self.first[at], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(starts, offsets)]

    def known(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == keys[found]
        return found

    def encode_texts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, each text by the tokenizer itself."""
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        parts = [np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def pieces_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece; an apostrophe stays with what follows it."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[raw]
    left, right = kind[:-1], kind[1:]
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = (left != right) & ((left == 0) | (right == 0) | ((left < 4) & (right < 4) & (raw[:-1] != 0x27)))
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    keep = kind[edges[:-1]] != 0
    return edges[:-1][keep], edges[1:][keep]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
