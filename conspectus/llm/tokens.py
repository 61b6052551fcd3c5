"""Token ids of a public byte-pair vocabulary over whole Arrow columns.

The vocabulary lower-cases, drops white space and never merges across it or
between letters and marks. A text is therefore cut into chunks at ASCII white
space. A chunk of Latin letters with at most a tail of marks is a word and a run
of marks; the merges of all distinct words of a slice are carried out together in
numpy. Every other chunk goes through the tokenizers library, once for each
distinct one. Tests hold the ids against the library's ids of whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from . import text as T

#: Longer words go through the library.
MERGE_BYTES = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def byte_alphabet() -> list[str]:
    """The printable stand-ins of bytes 0-255 in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ragged pieces one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end, signs = model["vocab"], model["end_of_word_suffix"], byte_alphabet()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + end] for s in signs], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made[order]

    def merged(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their bytes, and how many each word has."""
        ends = np.cumsum(sizes)
        ids = self.inner[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_words, none = [], [], len(self.keys)
        while len(ids):
            key = ids[:-1] << 16 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.append(np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], none), none)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            first = np.flatnonzero((rank == best) & (best < none))
            if len(first):  # the leftmost of each word
                first = first[np.concatenate([[True], word[first[1:]] != word[first[:-1]]])]
                ids[first] = self.made[at[first]]
            over = best == none
            keep = ~over
            keep[first + 1] = False
            done_ids.append(ids[over])
            done_words.append(word[over])
            ids, word = ids[keep], word[keep]
        ids, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_words))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as unsigned 32-bit numbers, with text bounds; null counts as empty."""
        raw, bounds = T.flat(texts)
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        inside = ~_SPACE[raw]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:n]
        chunk = np.cumsum(opens) - 1  # of each byte; also runs on over white space
        starts = np.flatnonzero(opens)
        # Latin letters of two bytes: C3, then 80-BF but for the signs 97 and B7
        second = np.append(raw[1:], 0)
        wide = (raw == 0xC3) & (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        wide[-1] = False
        after = np.zeros(n, bool)
        after[1:] = wide[:-1]
        letter, tail = _LETTER[raw] | wide | after, _TAIL[raw] & inside
        lower = T._LOWER[raw]
        lower[after & (raw <= 0x9E)] += 0x20
        back = np.zeros(n, bool)  # a letter behind a mark
        back[1:] = letter[1:] & tail[:-1] & ~opens[1:]
        odd = np.zeros(len(starts), bool)
        odd[chunk[(inside & ~letter & ~tail) | back]] = True
        split = opens.copy()
        split[1:] |= tail[1:] & letter[:-1] & ~odd[chunk[1:]] & inside[:-1]
        heads = np.flatnonzero(split)
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | split[1:]
        sizes = np.flatnonzero(stops) + 1 - heads
        hard = odd[chunk[heads]] | (sizes > MERGE_BYTES)
        lower[odd[chunk] & inside] = raw[odd[chunk] & inside]
        sums = np.zeros(n + 1, T.U)
        np.cumsum((lower.astype(T.U) + T.U(1)) * T._power(T._BASE, n), out=sums[1:])
        key = T.mix((sums[heads + sizes] - sums[heads]) * T._power(T._INVERSE, n)[heads] + sizes.astype(T.U), 5)
        key = key << T.U(1) | hard.astype(T.U)
        _, where, which = np.unique(key, return_index=True, return_inverse=True)
        easy = ~hard[where]
        counts = np.zeros(len(where), np.int64)
        ids, counts[easy] = self.merged(lower[gather(heads[where[easy]], sizes[where[easy]])], sizes[where[easy]])
        begin = np.zeros(len(where), np.int64)
        begin[easy] = np.cumsum(counts[easy]) - counts[easy]
        if not easy.all():
            rest = np.flatnonzero(~easy)
            words = [raw[h : h + s].tobytes().decode() for h, s in zip(heads[where[rest]], sizes[where[rest]], strict=True)]
            found = [np.asarray(x.ids, np.int64) for x in self.library.encode_batch(words, add_special_tokens=False)]
            counts[rest] = [len(x) for x in found]
            begin[rest] = len(ids) + np.cumsum(counts[rest]) - counts[rest]
            ids = np.concatenate([ids, *found])
        out = ids[gather(begin[which], counts[which])].astype("<u4")
        total = np.concatenate([[0], np.cumsum(counts[which])])
        return out, total[np.searchsorted(heads, bounds)]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker process and vocabulary: a path, or the name of a public tokenizer's file."""
    if vocabulary not in _encoders:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _encoders[vocabulary] = Encoder(path)
    return _encoders[vocabulary]
