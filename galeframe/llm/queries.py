"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galeframe.llm import alignment, ann, bpe, decontaminate, html, importance, jaccard, langid, media, packing, repair, suffix_dedup, toxicity
from galeframe.llm.ranks import vocabulary
from galeframe.llm.support import ready, table
from galeframe.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return plan

    return register


@query("op1_html")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


@query("op2_suffixes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op4_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op5_repair_ids")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "ids")
    repair.write_ids(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return repair.read_ids(spark, path, digest=True)


@query("op6_media")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored(table(spark, sf_dir, "documents")))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


@query("op9_jaccard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op11_importance", importance.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    return alignment.digests(table(spark, sf_dir, "documents"), *files)


@query("op13_decontamination", decontaminate.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
