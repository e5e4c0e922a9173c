"""Stages on tables with nulls, copies and clashing columns; all queries on given tables."""

import corpus_pipeline
import pytest

from galeframe.llm.queries import QUERIES
from tests.llm.conftest import frame

DATA = "/root/testdata/sf0.001"


def test_stages(spark, docs, none, texts):
    sizes = []
    for table, rows in ((docs, len(texts)), (none, 0)):
        here = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, here, DATA)
            if name != "packing":
                assert out.columns == docs.columns
            kept = out.toPandas()
            sizes.append((name, len(kept)))
            here = frame(spark, [(None if r.doc_id != r.doc_id else int(r.doc_id), r.text, r.lang) for r in kept.itertuples()]) if name != "packing" else here
        assert sizes[-len(corpus_pipeline.STAGES)][1] <= rows
    found = dict(sizes[:5])
    assert found["toxicity"] == len(texts)  # none holds what the labels of the tables know
    assert found["language"] == len(texts) - 4  # null, empty, blank, and no letters
    assert found["repeated_strings"] == found["near_copies"] < found["language"]
    assert all(n == 0 for _, n in sizes[5:])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_the_tables(spark, name):
    table, key = {"op1_html": ("pages", "page_id"), "op4_neighbours": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    source = spark.read.parquet(f"{DATA}/{table}.parquet")
    got = QUERIES[name](spark, DATA)
    if name == "op4_neighbours":
        assert got.count() == 20 * source.where("vec_id % 20 = 0").count()
    else:
        assert got.select(key).distinct().count() == source.select(key).distinct().count()
