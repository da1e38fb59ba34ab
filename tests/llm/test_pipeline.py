"""The pipeline against a brute-force version of its stages."""

import re
import zlib

import numpy as np

import corpus_pipeline
from tessera.llm import decontamination, packing, quality_rules
from tessera.llm.common import Scratch, table
from pyspark.sql import functions as F

from tests.llm.test_text_operators import linked

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    scratch = Scratch(spark, "test")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(scratch.write(stage(spark, frames[-1], SMALL)))
        assert frames[-1].columns == docs.columns
    rows = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    d = quality_rules.ledger(docs).select("doc_id", "quality_ledger.failed_bits").collect()
    assert set(rows[1]) == {r.doc_id for r in d if not r.failed_bits}
    assert set(rows[2]) == {i for i, (_, c) in linked(list(rows[1].items())).items() if i == c}
    items = tuple((r.item_id, decontamination.normal(r.text)) for r in table(spark, SMALL, "benchmark").collect())
    assert set(rows[3]) == {i for i, t in rows[2].items() if not decontamination.matches(decontamination.normal(t), items)} < set(rows[2])
    assert set(rows[4]) == set(rows[3]) and not any(re.search(r"[a-z0-9]@mail[0-9]", t) for t in rows[4].values())
    t = packing._tokenizer(packing.vocabulary_path())
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in rows[4].items()}
    got = {}
    for r in corpus_pipeline.run(spark, SMALL).orderBy("doc_id", "start").collect():
        assert zlib.crc32(r.ids) == r.ids_crc32
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want


def test_stages_on_odd_rows(spark):
    """Nulls, empties, long words, repeated rows, columns of names that the operators use, and an empty table, stage by stage."""
    prose = " ".join(f"word{i}" for i in range(60))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(1, prose), (1, prose), (2, prose + " more"), (3, None), (4, ""), (None, prose), (None, None), (5, "x" * 100_000), (6, f"{prose} {item}"), (7, "mail a@b.cc to " + prose.replace("word", "term"))]
    clash = ("sig", "component_id", "failed_bits", "quality_ledger", "pii_base", "pii_id", "__row", "item_id", "centre", "spans", "part")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.char_length("text").cast("bigint").alias("n_chars"), *[F.lit(c).alias(c) for c in clash]).repartition(2)
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=lambda i: (i is not None, i))
    got = {name: stage[name](spark, docs, SMALL) for name in ("quality_rules", "near_duplicates", "decontamination", "personal_data")}
    for d in got.values():
        assert d.columns == docs.columns and d.select(*clash).distinct().collect() == docs.select(*clash).distinct().collect()
    assert ids(got["quality_rules"]) == [None, 1, 1, 2, 6, 7]
    assert ids(got["near_duplicates"]) == [None, None, 1, 1, 3, 4, 5, 6, 7]
    assert ids(got["decontamination"]) == [None, None, 1, 1, 2, 3, 4, 5, 7]
    red = {r.doc_id: r for r in got["personal_data"].collect() if r.doc_id in (3, 4, 7)}
    assert red[3].text is None and red[4].text == "" and red[7].text.startswith("mail <EMAIL> to term0") and red[7].n_chars == len(red[7].text) and got["personal_data"].count() == len(rows)
    pieces = stage["packing"](spark, docs, SMALL).collect()
    assert sum(r.start == 0 for r in pieces) == len(rows) and {r.doc_tokens for r in pieces if r.doc_id in (3, 4)} == {1}
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), SMALL).count() == 0, name
