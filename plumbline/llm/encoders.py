"""Token ids and counts from the public tokenizer files, with a bounded cache of encoded segments.

A text is cut before a space, tab or line end that follows a visible byte. No merge of either vocabulary crosses such a
cut (checked for piece vocabularies when they are loaded), so the ids of a text are those of its segments in a row. Each
segment is encoded once by the library and then looked up by a 64-bit digest. Texts in which the cut would not
be safe (other white space, special strings) go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from plumbline.llm.textbytes import SPACE, range_digests

#: Rows of the cache; when it is full it starts anew.
CACHE_ROWS = 700_000
_SLOTS = 1 << 21
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,;:!?)"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ODD = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8b\xa8-\xaf]|\xe2\x81[\x9f\xa0]|\xe2\x96\x81|\xe3\x80\x80|\xef\xbb\xbf|<[|s/u0]")
_LEAD = np.zeros(256, bool)
_LEAD[[*range(9), *range(14, 32), 127, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF, ord("<")]] = True


def odd_places(data: np.ndarray) -> list[int]:
    """Places of special strings and of white space other than the ASCII kinds."""
    at = np.flatnonzero(_LEAD[data])
    return [int(i) for i in at if _ODD.match(data[i : i + 3].tobytes())]


class SegmentCache:
    """hash -> ids (ragged) for segments seen before: an open-addressing table in numpy arrays."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], ids: bool):
        self.encode, self.ids = encode, ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.rows = np.zeros(_SLOTS, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.begins = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if it isn't there."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), h & np.uint64(_SLOTS - 1)
        while len(left):
            got = self.keys[slot]
            hit = got == h[left]
            out[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (got != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & np.uint64(_SLOTS - 1)
        return out

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        left, slot = np.arange(len(h)), h & np.uint64(_SLOTS - 1)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            won = free & (self.keys[slot] == h[left])
            self.rows[slot[won]] = rows[left[won]]
            left, slot = left[~won], (slot[~won] + np.uint64(1)) & np.uint64(_SLOTS - 1)

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Row of the cache for each segment; encodes those not there."""
        h = np.maximum(h, np.uint64(1))
        if len(self.lengths) > CACHE_ROWS:
            self.clear()
        found = self._find(h)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            keys, first, back = np.unique(h[lost], return_index=True, return_inverse=True)
            raw, first = data.tobytes(), lost[first]
            got = self.encode([raw[s:e].decode("utf-8") for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            lengths = np.fromiter(map(len, got), np.int32, len(got))
            base = len(self.lengths)
            self._put(keys, np.arange(base, base + len(keys), dtype=np.int32))
            if self.ids:
                ends = np.cumsum(lengths, dtype=np.int64)
                self.begins = np.concatenate([self.begins, len(self.flat) + ends - lengths])
                self.flat = np.concatenate([self.flat, np.fromiter((i for x in got for i in x), np.uint32, int(ends[-1]))])
            self.lengths = np.concatenate([self.lengths, lengths])
            found[lost] = base + back
        return found

    def gather(self, rows: np.ndarray) -> np.ndarray:
        lengths = self.lengths[rows].astype(np.int64)
        ends = np.cumsum(lengths)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[rows] - ends + lengths, lengths)
        return self.flat[index]


def cuts(data: np.ndarray, at: np.ndarray, closing: bool) -> np.ndarray:
    """Starts of segments: starts of non-empty texts, white space after a visible byte, and with ``closing`` a
    closing mark after an ASCII letter."""
    space = SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    if closing and len(data):
        cut[1:] |= _CLOSING[data[1:]] & _LETTER[data[:-1]]
    cut[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids or counts of the texts of a slice. ``path``: a tokenizer file, ``.json`` or ``.model``."""

    def __init__(self, path: str, ids: bool):
        self.ids = ids
        self.piece = path.endswith(".model")
        self.segmented = True
        if self.piece:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
            self.segmented = not any(re.search("[^▁]▁", p) for p in pieces)
            self.lone = [self.library.piece_to_id("▁")]
            probes = ["a  b", "x \n y", "  lead", "tail ", "tail  ", "Ab ab", "x\n "]
            self.segmented &= all(self._whole([p]) == [[i for s in self._parts(p) for i in self._piece([s])[0]]] for p in probes)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            vocabulary = self.library.get_vocab()
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for piece, i in vocabulary.items() if piece[:1] == "\u0120"]] = True
        self.cache = SegmentCache(self._piece if self.piece else self._spaced, ids)
        self.first = SegmentCache(self._whole, ids) if self.piece else self.cache

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Segments of a piece text, with the space that the library puts before the first."""
        return re.findall(" +[^ ]*|[^ ]+", " " + text)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        if self.piece:
            return self.library.encode(texts, num_threads=1)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, texts: list[str], group: int = 50) -> list[list[int]]:
        """Ids of segments; those that hold one space, at their start, are encoded many to a call and parted again at the
        ids that begin with a space."""
        out: list[list[int]] = [[]] * len(texts)
        plain = [i for i, t in enumerate(texts) if t[:1] == " " and len(t) > 1 and t.count(" ") == 1 and not t[1:2].isspace() and not ({"\n", "\t", "\r", "\v", "\f"} & set(t))]
        alone = sorted(set(range(len(texts))) - set(plain))
        groups = [plain[k : k + group] for k in range(0, len(plain), group)]
        for own, got in zip(groups, self.library.encode_batch_fast(["".join([texts[i] for i in own]) for own in groups], add_special_tokens=False), strict=True):
            ids = got.ids
            at = np.flatnonzero(self.opens[ids]).tolist()
            if len(at) != len(own) or at[0]:
                alone += own
                continue
            for i, s, e in zip(own, at, [*at[1:], len(ids)], strict=True):
                out[i] = ids[s:e]
        for i, ids in zip(alone, self._whole([texts[i] for i in alone]), strict=True):
            out[i] = ids
        return out

    def _piece(self, texts: list[str]) -> list[list[int]]:
        """Ids of segments that begin with a space: the library itself adds one, so one is taken away. A space that ends a text is a segment of its own."""
        return [self.lone if t == " " else ids for t, ids in zip(texts, self.library.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1), strict=True)]

    def __call__(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray] | np.ndarray:
        """One array of ids for each text, or the counts."""
        texts = len(at) - 1
        raw = data.tobytes()
        odd = np.zeros(texts, bool)
        if len(found := odd_places(data)):
            odd[np.searchsorted(at, found, "right") - 1] = True
        if not self.segmented:
            odd[:] = True
        counts, ids = np.zeros(texts, np.int64), [np.zeros(0, np.uint32)] * texts
        whole = np.flatnonzero(odd & (at[:-1] < at[1:]))
        if len(whole):
            for t, got in zip(whole.tolist(), self._whole([raw[at[t] : at[t + 1]].decode("utf-8") for t in whole]), strict=True):
                counts[t] = len(got)
                if self.ids:
                    ids[t] = np.array(got, np.uint32)
        start = cuts(data, at, not self.piece)
        if self.piece:  # only a plain space begins a piece; other white space stays inside
            heads = np.isin(start, at[:-1])
            start = start[heads | (data[start] == 32)]
        end = np.concatenate([start[1:], [len(data)]]) if len(start) else start
        text = np.searchsorted(at, start, "right") - 1
        use = ~odd[text]
        start, end, text = start[use], end[use], text[use]
        if not len(start):
            return ids if self.ids else counts
        h = range_digests(data, start, end)
        head = start == at[text]
        lengths = np.zeros(len(start), np.int64)
        rows = np.zeros(len(start), np.int64)
        if self.piece:
            for part, cache in ((head, self.first), (~head, self.cache)):
                if part.any():
                    rows[part] = cache.lookup(data, start[part], end[part], h[part])
                    lengths[part] = cache.lengths[rows[part]]
        else:
            rows = self.cache.lookup(data, start, end, h)
            lengths = self.cache.lengths[rows].astype(np.int64)
        np.add.at(counts, text, lengths) if len(text) < 64 else counts.__iadd__(np.bincount(text, lengths, texts).astype(np.int64))
        if self.ids:
            flat = self.cache.gather(rows)
            begin = np.concatenate([[0], np.cumsum(np.bincount(text, lengths, texts).astype(np.int64))])
            for t in np.flatnonzero(~odd).tolist():
                ids[t] = flat[begin[t] : begin[t + 1]]
            return ids
        return counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ids: bool) -> Encoder:
    """One for each Python worker, with its cache."""
    if (path, ids) not in _encoders:
        _encoders[path, ids] = Encoder(path, ids)
    return _encoders[path, ids]
