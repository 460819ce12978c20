"""The pipeline's stages, each on its own input."""
import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import mixing
from barloom.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, frames = docs.columns, docs, {}
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, kept, SF).persist()
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        frames[name] = kept, out
        kept = out
    before, after = frames["quality classifier"]
    poor = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    assert not poor & {r.doc_id for r in after.collect()} and after.count() > 0.7 * (before.count() - len(poor))
    before, after = frames["exact dedup"]
    lower = lambda t: (t or "").encode().lower()
    best = {}
    for r in before.collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(best.values())
    before, after = frames["MinHash near-dedup"]
    sets = {}
    for r in before.collect():
        words = (r.text or "").lower().split() if (r.text or "").isascii() else lower(r.text).split()
        sets[r.doc_id] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    def top(i):  # noqa: E306
        while root[i] != i:
            i = root[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert {i for i in sets if top(i) == i} == {r.doc_id for r in after.collect()}
    before, after = frames["mixing sources to target weights"]
    words = {}
    for r in after.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixing.plan_mix(before).collect() if r.taken}
    before, after = frames["SentencePiece encoding and decoding"]
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = sorted((r.doc_id, hashlib.sha256(" ".join(map(str, lib.encode(r.text, add_eos=True))).encode()).hexdigest()) for r in before.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in after.collect()) == want


def test_clashing_columns(spark):
    """Columns named like those that the operators make inside pass through every stage but the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = ["_gone", "_id", "_of", "n", "rep", "root", "digest", "set", "h", "bucket", "keep_id", "slot", "pos", "position", "size", "target", "taken", "kept", "group_size", "___________"]
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(odd)])
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, wide, SF)
        assert out.columns == wide.columns, name
        assert {r[c] for r in out.collect() for c in odd[:3]} <= {0, 1, 2}, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() == 60


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and 4 <= len(corpus_pipeline.STAGES) <= 5
