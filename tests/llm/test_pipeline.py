"""The whole pipeline against a plain one: SQL for quality and mix, loops for duplicates, the tokenizer itself for pieces."""

import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from lakeward.llm import packing, queries
from test_brute_force import classes, fingerprint

SF = "/root/testdata/sf0.001"


def plain_stages():
    """Ids after each filter, copies per id, and the pieces of one copy of each id."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    texts = {i: t or "" for i, t in con.execute("select doc_id, text from documents").fetchall()}
    good = sorted(i for (i,) in con.execute(f"select doc_id from ({queries.OP3_SQL}) where kept").fetchall())
    first = {}
    for i in good:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    one = sorted(first.values())
    found = classes([fingerprint(texts[i]) for i in one])
    near = [i for k, i in enumerate(one) if found[k] == k]
    rest = con.execute("select * from documents").df()
    con.execute("drop view documents")
    rest = rest[rest.doc_id.isin(near)]
    con.register("documents", pd.DataFrame(rest))
    copies = {i: taken // size for i, size, taken in con.execute(f"select doc_id, size, taken from ({queries.OP1_SQL})").fetchall()}
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(packing.public_tokenizer_path()), {}
    for i in near:
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids + [0]
        pieces[i] = [(k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    return good, one, near, copies, pieces


def test_every_stage_keeps_exactly_what_plain_code_keeps(spark):
    good, one, near, copies, pieces = plain_stages()
    assert len(near) < len(one) < len(good) < 200 and max(copies.values()) == 2 and min(copies.values()) == 0
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    original = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    wanted = [Counter(good), Counter(one), Counter(near), Counter({i: n for i, n in copies.items() if n})]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert docs.columns == columns and Counter(r.doc_id for r in rows) == want, name
        assert all(r == original[r.doc_id] for r in rows), name  # texts as they were
        docs = spark.createDataFrame(rows, docs.schema)
    got = corpus_pipeline.run(spark, SF).collect()
    expected = Counter({(i, *p): n for i, n in copies.items() if n for p in pieces[i]})
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


def test_a_stage_that_loses_a_clean_document_would_fail(spark):
    _, one, near, _, _ = plain_stages()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(*one))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == set(near) and kept - {near[0]} != set(near)
