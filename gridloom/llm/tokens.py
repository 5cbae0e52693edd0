"""Token ids of whole columns with the tokenizers library, and a file format for them.

``encode_column`` gives exactly what ``Tokenizer.encode`` gives for each text.
Byte-level BPE with the usual pattern never joins a character other than white
space to a space that follows, so a text cut before such spaces has the ids of
its pieces in a row.  Pieces repeat: each distinct one is encoded once and kept
in an Arrow column of ``_MOST`` entries, which is emptied when full (a bound on
memory, not on results).  Texts with white space before a space, or with one of
the vocabulary's added tokens (``<|endoftext|>``, say), are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MOST = 1_500_000
#: Bytes of text that are encoded together.
SLICE = 12 << 20
_CHUNK = 20_000


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        size = self.tokenizer.get_vocab_size()
        # ids whose text begins with a space: where a joined string's pieces begin
        self.opens = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token[0] == "Ġ"
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.large_string())
        self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.dtype)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array) -> None:
        """Encode pieces, each of which stands behind a space, and keep them."""
        begins, lengths, pools, used = [self.begin], [self.length], [self.pool], len(self.pool)
        for a in range(0, len(pieces), _CHUNK):
            names = pieces.slice(a, _CHUNK).to_pylist()
            ids = self.whole([" " + " ".join(names)])[0]
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(names) and first[0] == 0:
                length = np.diff(np.append(first, len(ids)))
            else:  # a piece that holds the marker's own character, say
                parts = self.whole([" " + p for p in names])
                length = np.array([len(p) for p in parts])
                ids = np.concatenate(parts)
            begins.append((used + np.cumsum(length) - length).astype(np.int32))
            lengths.append(length.astype(np.int32))
            pools.append(ids.astype(self.dtype))
            used += len(ids)
        self.begin, self.length, self.pool = map(np.concatenate, (begins, lengths, pools))
        self.keys = pa.concat_arrays([self.keys, pieces])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number for each text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(column, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b\x1c-\x1f] ").to_numpy(zero_copy_only=False)
        odd |= pc.equal(column, "").to_numpy(zero_copy_only=False)
        for token in self.added:
            odd |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(column, " ")
        count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten()
        starts = np.cumsum(count) - count
        # the first piece of a text stands behind no space: those are encoded by themselves
        coded = flat.dictionary_encode()
        names = coded.dictionary
        if len(self.keys) + len(names) > _MOST and len(self.keys) + pc.index_in(names, value_set=self.keys).null_count > _MOST:
            self.clear()
        found = pc.index_in(names, value_set=self.keys)
        known = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).copy()
        if found.null_count:
            new = names.filter(pc.is_null(found))
            known[known < 0] = np.arange(len(self.keys), len(self.keys) + len(new))
            self._learn(new)
        piece = known[coded.indices.to_numpy(zero_copy_only=False)]
        heads = self.whole(flat.take(pa.array(starts)).to_pylist())
        del parts, flat, coded, names
        length, begin = self.length[piece], self.begin[piece]

        texts = column.filter(pa.array(odd)).to_pylist()
        alone = dict(zip(np.flatnonzero(odd).tolist(), self.whole(texts), strict=True)) if texts else {}
        extra, base = [], len(self.pool)
        for d in range(len(column)):
            a = int(starts[d])
            own = alone.get(d, heads[d])
            if d in alone:
                length[a : a + int(count[d])] = 0
            begin[a], length[a] = base, len(own)
            base += len(own)
            extra.append(own)
        pool = np.concatenate([self.pool, *(x.astype(self.dtype) for x in extra)])
        total = np.cumsum(length, dtype=np.int64)
        size = int(total[-1])
        kind = np.int32 if max(size, len(pool)) < 2**31 else np.int64
        at = np.repeat((begin - (total - length)).astype(kind), length)
        at += np.arange(size, dtype=kind)
        return pool[at].astype(np.uint32), np.add.reduceat(length.astype(np.int64), starts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that its cache serves all tasks there."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more after each document."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1
