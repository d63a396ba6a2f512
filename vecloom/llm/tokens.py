"""Token ids of whole texts through the tokenizers library, encoding each distinct word once per worker.

A text is cut where its pre-tokenizer is certain to cut it, whatever stands on
either side: before an ASCII white-space byte that follows a visible character,
and between an ASCII letter and certain ASCII punctuation.  The ids of a text
are those of its pieces in turn.  Distinct pieces are encoded by the library,
all new ones of a batch in one call, and kept in arrays of bounded size; texts
are put together by gathering.  The tokenizer files are a parameter.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import textnum

#: Pieces kept by a worker (about 40 bytes each); beyond that it forgets those that the present texts lack.
KEPT_PIECES = 500_000
#: Pieces that one call encodes, as the library takes some hundred bytes a token while it works.
CALL_PIECES = 10_000
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[ord(c) for c in '.,;:!?*$%&#|)]}"']] = True
_loaded: dict[tuple[str, bool], "PieceEncoder"] = {}


def encoder(path: str, plain: bool = False) -> "PieceEncoder":
    """This worker's encoder for a tokenizer file."""
    if (path, plain) not in _loaded:
        _loaded[path, plain] = PieceEncoder(path, plain)
    return _loaded[path, plain]


def tokenizer_path(name: str) -> str:
    """Where a file of the installed public tokenizers is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where pieces start: at each text, and where every pre-tokenizer in use cuts; never inside one of ``whole``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    cut = np.zeros(n, dtype=bool)
    here, last = data[1:], data[:-1]
    visible = (last > 0x20) & (last < 0x7F)
    if n > 2:  # two-byte characters, but for U+0080 to U+00BF, two of which are white space
        visible[1:] |= (last[1:] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
    cut[1:] = (textnum.SPACE[here] & visible) | (PUNCTUATION[here] & LETTER[last])
    raw = data.tobytes() if whole else b""
    for special in whole:
        at = raw.find(special)
        while at >= 0:
            cut[at + 1 : at + len(special)] = False
            at = raw.find(special, at + 1)
    texts = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut[texts] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes as the library does; if ``plain``, as it does when the text of a special token is text like any other."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = self.alone = Tokenizer.from_file(path)
        if plain:
            self.alone = Tokenizer.from_file(path)  # for pieces that hold a special token's text
            self.alone.encode_special_tokens = True
        specials = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.whole = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.mark, self.mark_text = max(specials), specials[max(specials)]
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # of each kept piece in self.ids, and the end
        self.ids = np.zeros(0, np.uint32)

    def keep(self, slots: np.ndarray) -> None:
        """Forget all pieces but some (those of the present texts, which are the most frequent ones)."""
        place = self.place[slots]
        begin, count = self.first[place], self.first[place + 1] - self.first[place]
        self.known, self.place, self.first = self.known[slots], np.arange(len(slots)), np.concatenate([[0], np.cumsum(count)])
        self.ids = self.ids[np.repeat(begin - self.first[:-1], count) + np.arange(self.first[-1])]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and their number for each piece.

        Pieces are joined by a special token, which the library cuts out before
        anything else; a piece that holds its text is encoded alone.
        """
        odd = [i for i, p in enumerate(pieces) if any(t.decode() in p for t in self.whole)]
        joined = self.mark_text.join("" if i in alone else p for alone in [set(odd)] for i, p in enumerate(pieces))
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        bounds = np.concatenate([[-1], marks, [len(ids)]])
        if len(bounds) != len(pieces) + 1:
            raise ValueError("the joined pieces came apart")
        counts = np.diff(bounds) - 1
        ids = np.delete(ids, marks)
        if odd:
            ends = np.cumsum(counts)
            parts, at = [], 0
            for i in odd:
                alone = np.array(self.alone.encode(pieces[i], add_special_tokens=False).ids, dtype=np.uint32)
                parts += [ids[at : ends[i]], alone]
                at, counts[i] = ends[i], len(alone)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, counts

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a column's texts, and the n + 1 offsets of each text's."""
        data, offsets = textnum.buffers(column)
        starts = piece_starts(data, offsets, self.whole)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        distinct, sample, codes = np.unique(textnum.spans_hash(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            if len(self.known) and len(self.known) + len(new) > KEPT_PIECES:
                self.keep(at[self.known[at] == distinct])
            raw = data.tobytes()
            parts = []
            for k in range(0, len(new), CALL_PIECES):
                own = sample[new[k : k + CALL_PIECES]]
                parts.append(self.encode_pieces([raw[s:e].decode("utf-8") for s, e in zip(starts[own].tolist(), ends[own].tolist())]))
            where = np.searchsorted(self.known, distinct[new])
            self.place = np.insert(self.place, where, np.arange(len(new)) + len(self.known))
            self.known = np.insert(self.known, where, distinct[new])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([c for _, c in parts]))])
            self.ids = np.concatenate([self.ids, *(i for i, _ in parts)])
            at = np.searchsorted(self.known, distinct)
        slot = self.place[at][codes]
        begin, count = self.first[slot], self.first[slot + 1] - self.first[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        out = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, offsets)]
