"""SentencePiece and token files against the libraries themselves."""
import random
import zlib

import numpy as np
import pytest

from barloom.llm import sentencepiece_bpe as spm, token_files
from barloom.llm.queries import vocabulary

ALPHABET = " " * 4 + "\n\t▁abcdeéñ日𠮷the<s>0x.,!\"()\x00\xa0ﬁ'sT|\x1cÉ"


def texts(n, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return made + [" " * k for k in range(1, 40)] + ["", "<|endoftext|> a<|startoftext|>", "don't we'll", "▁▁", "the " * 30000, "a" * 5000]


def test_codec_is_the_library(spark):
    import sentencepiece
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), spm.codec(vocabulary("piece_bpe_32k.model"))
    for t in texts(4000, 1):
        ids = lib.encode(t, add_eos=True)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == lib.decode(ids)
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice((rng.randint(0, 31999), rng.randint(0, 262))) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == lib.decode(ids)


def test_pair_test_is_the_merge(spark):
    codec, rng = spm.codec(vocabulary("piece_bpe_32k.model")), random.Random(3)
    ids = sorted(codec.piece)
    for _ in range(20000):
        a, b = rng.choice(ids[:3000]), rng.choice(ids[:3000])
        assert codec.may_follow(a, b) == (codec.merged(codec.piece[a] + codec.piece[b]) == [codec.piece[a], codec.piece[b]])


def test_sentencepiece_frames(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 5), (2, "", 5)], "doc_id long, text string, ids int")
    enc = spm.encode_texts(df, vocabulary("piece_bpe_32k.model"))
    assert sorted((str(r.doc_id), len(r.ids)) for r in enc.collect()) == [("1", 3), ("1", 3), ("2", 1), ("None", 1)]
    assert sorted(r.text for r in spm.decode_ids(enc, vocabulary("piece_bpe_32k.model")).collect()) == ["", "", "a b", "a b"]
    assert spm.round_trips(df.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_word_encoder_is_the_library():
    e = token_files.encoder(vocabulary("word_bpe_49k.json"))
    t = texts(4000, 4)
    for text, raw in zip(t, e.raw(t, 2)):
        assert np.frombuffer(raw, e.dtype).tolist() == [*e.whole.encode(text, add_special_tokens=False).ids, 2]


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = [(i * 7 % 101 - 20, t) for i, t in enumerate(texts(100, 5))] + [(None, "null id"), (3, None), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = f"file://{tmp_path}/t"
    parts = token_files.write_tokens(df, folder, vocabulary("word_bpe_49k.json"), 2)
    got = token_files.read_tokens(spark, folder, parts, with_ids=True).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    key = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert key == sorted(key)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    want = sorted((str(i), [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert len(list(tmp_path.glob("t/*.tmp"))) == 0


def test_token_files_empty(spark, tmp_path):
    parts = token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), vocabulary("word_bpe_49k.json"), 2)
    assert parts == [] and token_files.read_tokens(spark, str(tmp_path / "e"), parts).count() == 0


@pytest.mark.parametrize("bad", [[35, 8765, 192], [0, 13961], [1, 28705]])
def test_decode_keeps_odd_starts(bad):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    assert spm.codec(vocabulary("piece_bpe_32k.model")).decode(bad) == lib.decode(bad)
