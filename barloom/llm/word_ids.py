"""Ids of whole texts by a word-level tokenizer file, a batch of texts at a time in Arrow and NumPy.

The tokenizer drops white space, so the runs between ASCII white space are encoded alone: a batch is split and dictionary-encoded in Arrow, its
distinct runs are looked up once, and all ids are gathered from one values buffer by index. Runs of Latin-1 letters with closing punctuation
split into these two by the tokenizer's own pattern; their lower-cased letters go to the same merges without the normaliser, and are kept in a
cache bounded by bytes. All other runs, and texts that could hold special tokens, go to the whole tokenizer.

Null texts count as empty; texts of any length are cut at white space into blocks, so that memory stays bounded by one text and one block.
"""
from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 40_000_000  # in each of two generations
ENTRY_BYTES = 150  # of an entry besides its run and ids
LONG_RUN = 64  # longer runs are not kept
BLOCK_BYTES = 4_000_000  # text encoded together
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which begins contractions
LETTERS_THEN_PUNCTUATION = "^(?P<stem>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<end>[" + re.escape(PUNCTUATION) + "]*)$"


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _sums(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class WordEncoder:
    """Encodes texts; ``dtype`` is that of its ids, little-endian unsigned 16-bit where all fit, else 32-bit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.dtype = "<u2" if self.whole.get_vocab_size() <= 65536 else "<u4"
        self.closes = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def _whole(self, runs: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.whole.encode_batch_fast(runs, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of lower-cased letters: all new runs in one call, cut after each token that closes a word."""
        ids = np.array(self.letters.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        cut = np.flatnonzero(self.closes[ids]) + 1
        if len(cut) != len(stems):
            raise ValueError("this tokenizer doesn't mark word ends")
        raw, ends = ids.tobytes(), (cut * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _known(self, runs: list[str], learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs one after the other, and how many each has; ``learn`` gives those of new ones."""
        young, found = self.young, list(map(self.young.get, runs))
        new = [i for i, x in enumerate(found) if x is None]
        ask = []
        for i in new:
            found[i] = kept = self.old.get(runs[i])
            if kept is None:
                ask.append(i)
        for i, x in zip(ask, learn([runs[i] for i in ask]) if ask else ()):
            found[i] = x
        if self.size > CACHE_BYTES:
            self.old, self.young, self.size = young, {}, 0
            young = self.young
        for i in new:
            if len(runs[i]) < LONG_RUN:
                young[runs[i]] = found[i]
                self.size += ENTRY_BYTES + len(runs[i]) + len(found[i])
        values = np.frombuffer(b"".join(found), self.dtype)
        return values, np.fromiter(map(len, found), np.int64, len(found)) // values.itemsize

    def _distinct(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct runs one after the other, and how many each has."""
        cut = pc.extract_regex(runs, LETTERS_THEN_PUNCTUATION)
        plain = cut.is_valid()
        stems, ends = pc.utf8_lower(pc.struct_field(cut, "stem")).dictionary_encode(), pc.struct_field(cut, "end").dictionary_encode()
        stem_ids, stem_n = self._known(stems.dictionary.to_pylist(), self._stems)
        end_ids, end_n = self._known(ends.dictionary.to_pylist(), self._whole)
        other_ids, other_n = self._known(runs.filter(pc.invert(plain)).to_pylist(), self._whole)
        plain = plain.to_numpy(zero_copy_only=False)
        start, count = np.zeros((len(runs), 2), np.int64), np.zeros((len(runs), 2), np.int64)
        at = 0
        for column, numbers, counts in ((0, stems.indices, stem_n), (1, ends.indices, end_n)):
            i = numbers.drop_null().to_numpy()
            start[plain, column], count[plain, column] = at + _sums(counts)[i], counts[i]
            at += int(counts.sum())
        start[~plain, 0], count[~plain, 0] = at + _sums(other_n)[:-1], other_n
        return np.concatenate([stem_ids, end_ids, other_ids])[spread(start.ravel(), count.ravel())], count.sum(1)

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():
            return self._with_special(texts, special.to_numpy(zero_copy_only=False))
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, n = self._distinct(words.dictionary)
        which = words.indices.to_numpy()
        counts = n[which]
        return ids[spread(_sums(n)[which], counts)], np.diff(_sums(counts)[lists.offsets.to_numpy() - lists.offsets[0].as_py()])

    def _with_special(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_block``, where some texts could hold special tokens."""
        raw = self._whole(texts.filter(pa.array(special)).to_pylist())
        odd = np.frombuffer(b"".join(raw), self.dtype)
        odd_n = np.array([len(x) for x in raw]) // odd.itemsize
        ids, n = self._block(texts.filter(pa.array(~special)))
        start, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        start[~special], count[~special] = _sums(n)[:-1], n
        start[special], count[special] = len(ids) + _sums(odd_n)[:-1], odd_n
        return np.concatenate([ids, odd])[spread(start, count)], count

    def _pieces(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of texts; a text longer than a block comes alone."""
        sizes = pc.binary_length(texts).to_numpy()
        lo = 0
        while lo < len(texts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:lo + 65536]), BLOCK_BYTES)))
            block = texts.slice(lo, hi - lo)
            if sizes[lo] <= BLOCK_BYTES or pc.match_substring(block, "<|")[0].as_py():
                yield self._block(block)
            else:
                text, ids, at = block[0].as_py(), [], 0
                while at < len(text):
                    space = re.compile(r"[ \t\n\r\f\v]").search(text, at + BLOCK_BYTES // 4)
                    end = space.end() if space else len(text)
                    ids.append(self._block(pa.array([text[at:end]]))[0])
                    at = end
                yield np.concatenate(ids), np.array([sum(map(len, ids))])
            lo = hi

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and the n + 1 offsets of the texts."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        blocks = list(self._pieces(texts))
        if not blocks:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        n = np.concatenate([b[1] for b in blocks])
        offsets = _sums(n + 1)
        out = np.full(offsets[-1], end, self.dtype)
        out[spread(offsets[:-1], n)] = np.concatenate([b[0] for b in blocks])
        return out, offsets

    def raw(self, texts: list[str], end: int) -> list[bytes]:
        """Little-endian ids of each text, closed by the end id."""
        ids, offsets = self.encode(pa.array(texts, pa.string()), end)
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)
