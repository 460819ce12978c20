"""SentencePiece (BPE) encoding and decoding by a table of the last token of every prefix.

In a merge-type vocabulary each prefix of a text has one encoding, so one last token. Walking through the text, the automaton gives the pieces
that end at a place, and the piece that may follow the last token of the prefix before it (a pair that encodes to itself) is the entry. The ids
come out backwards from the end of the table. Every pair is tested once, by merging its two pieces by score.

The table is local to a stretch that begins with a space or line end, since no piece goes across these two; equal stretches are looked up in a
bounded cache. Characters without a piece become UTF-8 byte ids. Null text counts as empty; the empty text gives the end id alone. Any number of
repeated rows, very long texts and empty tables are plain cases; extra columns of the input are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import C, sha256_text

SPACE = "▁"
CACHE_WORDS = 300_000  # entries in each of two generations
SLICE = 256


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.eos = model.eos_id()
        self.pieces, self.scores, self.bytes, self.byte_id, self.text = {}, {}, {}, {}, [""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.text[i] = chr(value)
                if value > 127:
                    self.bytes[i] = value
            elif model.is_unknown(i):
                self.text[i], self.unknown = " ⁇ ", i
            elif not model.is_control(i) and not model.is_unused(i):
                self.pieces[piece], self.scores[piece] = i, model.get_score(i)
                self.text[i] = piece.replace(SPACE, " ")
        across = re.compile(f"[^{SPACE}]{SPACE}|\n.|.\n", re.S)
        if any(across.search(p) for p in self.pieces):
            raise ValueError("a piece of this model goes across a space or line end")
        self.piece = {i: p for p, i in self.pieces.items()}
        order = sorted((p for p in self.pieces if len(p) > 1), key=lambda p: -self.scores[p])
        self.rank = {self.pieces[p]: r for r, p in enumerate(order)}  # the sooner a merge happens, the lower; characters have none
        several = Counter(self.scores[p] for p in order)
        self.tied = {self.pieces[p] for p in order if several[self.scores[p]] > 1}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.size = n
        self.follows: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.strings = [str(i) for i in range(n)]
        self.high = frozenset(self.bytes)
        self.spaced = frozenset(i for p, i in self.pieces.items() if p[0] == SPACE)

    def merged(self, text: str) -> list[str]:
        """A short text merged pair by pair: highest score first, then leftmost."""
        parts = list(text)
        while best := max(((self.scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores), default=None):
            i = -best[1]
            self.last_merge = parts[i], parts[i + 1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def half(self, i: int) -> tuple[int, int] | None:
        """The two ids whose merge makes id ``i``; None for a character."""
        if i not in self.halves:
            self.halves[i] = tuple(self.pieces[x] for x in self.last_merge) if i in self.rank and self.merged(self.piece[i]) else None
        return self.halves[i]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two pieces side by side encode to themselves.

        Takes back the merges that made them, latest first. If at some point the pieces that meet at the border could have merged sooner than
        what was taken back last, the pair can't stand. Equal ranks happen from left to right. Pieces with tied scores are merged in full.
        """
        if left in self.tied or right in self.tied:
            return self.merged(self.piece[left] + self.piece[right]) == [self.piece[left], self.piece[right]]
        piece, pieces, rank = self.piece, self.pieces, self.rank
        a, b, limit = left, right, len(rank)
        while True:
            joined = pieces.get(piece[a] + piece[b])
            if joined is not None and rank[joined] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, limit = self.half(a)[1], ra
            else:
                b, limit = self.half(b)[0], rb + 1

    def stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch through the table of last tokens: an id for each prefix; 0 after a character without a piece, and at the start."""
        n, size, follows = len(text), self.size, self.follows
        last = [0] * (n + 1)
        for end, (i, width) in self.automaton.iter(text):
            end += 1
            if last[end]:
                continue
            before = last[end - width]
            if before:
                pair = before * size + i
                ok = follows.get(pair)
                if ok is None:
                    if len(follows) >= 1_000_000:
                        follows.clear()
                    ok = follows[pair] = self.may_follow(before, i)
                if not ok:
                    continue
            last[end] = i
        out, at, piece = [], n, self.piece
        while at:
            i = last[at]
            if i:
                out.append(i)
                at -= len(piece[i])
            else:
                at -= 1
                out.extend(self.byte_id.get(b, self.unknown) for b in reversed(text[at].encode("utf-8", "surrogatepass")))
        out.reverse()
        return tuple(out)

    def _missing(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = self.stretch(word)
        if len(word) < 64:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids with the end id."""
        if not text:
            return [self.eos]
        get, miss, parts = self.young.get, self._missing, []
        for n, line in enumerate((SPACE + text.replace(" ", SPACE)).split("\n")):
            if n:
                parts.append((self.byte_id[10],))
            words = line.split(SPACE)
            if "" in words[1:]:  # runs of spaces belong to the stretch that follows them
                words = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line)
                for word in words:
                    parts.append(get(word) or miss(word))
                get = self.young.get
                continue
            if words[0]:
                parts.append(get(words[0]) or miss(words[0]))
            for word in words[1:]:
                word = SPACE + word
                ids = get(word)
                if ids is None:
                    ids = miss(word)
                    get = self.young.get
                parts.append(ids)
        out = list(chain.from_iterable(parts))
        out.append(self.eos)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, runs of byte ids read as UTF-8 (bytes that aren't: U+FFFD each), the space put before the text taken off."""
        table = self.text
        if self.high.isdisjoint(ids):
            out = "".join(map(table.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in self.bytes:
                    run.append(self.bytes[i])
                    continue
                if run:
                    parts.append(_utf8(bytes(run)))
                    run = bytearray()
                parts.append(table[i])
            parts.append(_utf8(bytes(run)))
            out = "".join(parts)
        first = next((i for i in ids if table[i]), None)
        return out[1:] if first in self.spaced else out


def _utf8(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (4, 3, 2, 1):
            try:
                out.append(raw[i:i + n].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        i += min(n, len(raw) - i)
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One per Python worker and model file."""
    return PieceCodec(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; ``path`` is a model file that each worker can open."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((c.encode(t or "") for t in batch.column(1).to_pylist()), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(C(id_col).alias("doc_id"), C(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((c.decode(i or []) for i in batch.column(1).to_pylist()), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every text in one go and keeps digests only."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                ids_sha.append(sha256_text(" ".join(map(c.strings.__getitem__, ids))))
                text_sha.append(sha256_text(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(C(id_col).alias("doc_id"), C(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
