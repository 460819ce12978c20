"""Registered queries opN_ of this subpackage and their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.llm import centroids, exact_dedup, importance, language_id, mixing, near_dedup, packing, quality, sentencepiece_bpe, substring_dedup, token_files, url_filters, vector_search
from barloom.llm.common import C, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_sentencepiece")
def _(s, sf): return sentencepiece_bpe.round_trips(table(s, sf, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op2_quality")
def _(s, sf):
    docs = table(s, sf, "documents")
    return quality.score(docs, quality.fit(docs, quality.graded(table(s, sf, "labels"))))


@query("op3_language_id")
def _(s, sf): return language_id.identify(table(s, sf, "documents"))


@query("op4_mixing", mixing.SQL)
def _(s, sf):
    at = lambda n: F.round(F.get("positions", F.lit(n)), 6)
    return mixing.plan_mix(table(s, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", at(0).alias("position"), at(1).alias("position_2"))


@query("op5_exact_dedup", exact_dedup.SQL)
def _(s, sf): return exact_dedup.exact_groups(table(s, sf, "documents"))


@query("op6_near_dedup", near_dedup.SQL)
def _(s, sf): return near_dedup.near_groups(table(s, sf, "documents"), percent=85)


@query("op7_token_files")
def _(s, sf):
    folder = token_files.token_folder(s)
    return token_files.read_tokens(s, folder, token_files.write_tokens(table(s, sf, "documents"), folder, vocabulary("word_bpe_49k.json"), 2))


@query("op8_substring_dedup", substring_dedup.SQL)
def _(s, sf): return substring_dedup.remove_repeats(table(s, sf, "documents")).withColumn("text", F.sha2(C("text").cast("binary"), 256)).withColumnRenamed("text", "kept_sha256")


@query("op9_url_filters", url_filters.SQL)
def _(s, sf): return url_filters.filter_urls(url_filters.dated_captures(table(s, sf, "pages")), url_filters.derived_list(table(s, sf, "pages")))


@query("op10_vector_search", vector_search.SQL)
def _(s, sf): return vector_search.top_k(table(s, sf, "embeddings"), C("vec_id") % 50 == 0, 5)


@query("op11_centroid_clusters", centroids.SQL)
def _(s, sf): return centroids.cluster(table(s, sf, "embeddings"))


@query("op12_packing")
def _(s, sf): return packing.pack(table(s, sf, "documents"), vocabulary("word_bpe_49k.json"), 1)


@query("op13_importance_resampling")
def _(s, sf): return importance.resample(table(s, sf, "documents"), table(s, sf, "benchmark"))
