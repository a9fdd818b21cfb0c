"""Each stage of the pipeline on odd rows, an empty table and columns whose names clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ledgerloom.llm import licenses, near_duplicates

SCHEMA = (
    "doc_id long, text string, lang string, source string, text_key long, __doc long, __key string, __found long, __bins long, "
    "__p double, __i long, row string, rate double, words string, shard int, `odd.name` long"
)
REST = (1, 2, "k", 3, 4, 0.5, 5, "r", 0.1, "w", 6, 7)
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog that lay there all day long"),
    (1, "The cat sat on the mat and looked at the dog that lay there all day long"),
    (2, "the CAT sat on the mat and looked at the dog that lay there all day long"),
    (None, "the cat sat on the mat and looked at the dog that lay there all day long"),
    (None, "a word or two about how the other animals live in the house near here"),
    (None, "a word or two about how the other animals live in the house near here"),
    (None, "A word or two about how the other animals live in the house near here"),
    (3, None), (None, None), (4, ""), (4, ""), (5, "  \n"), (6, "lang " * 40_000 + "end"), (7, "1234 #### 99"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", *REST) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name, stage", pipeline.STAGES, ids=[n for n, _ in pipeline.STAGES])
def test_stage_on_odd_rows(spark, sf_dir, name, stage):
    docs = frame(spark, TEXTS)
    found = stage(spark, docs, sf_dir)
    rows = found.collect()
    if name != pipeline.STAGES[-1][0]:
        assert found.columns == docs.columns
        assert all(tuple(r)[2:] == ("en", "a", *REST) for r in rows)
    assert {(r.doc_id, r.text) for r in rows if "text" in found.columns} <= set(TEXTS)
    empty = stage(spark, frame(spark, []), sf_dir)
    assert empty.columns == found.columns and empty.collect() == []


def test_one_of_each_group_stays(spark):
    rows = near_duplicates.keep_first(frame(spark, TEXTS)).collect()
    kept = [(str(r.doc_id), (r.text or "")[:9].lower()) for r in rows]
    expected = [(1, "the cat s"), (None, "a word or"), (3, ""), (None, ""), (4, ""), (5, "  \n"), (6, "lang lang"), (7, "1234 ####")]
    assert sorted(kept) == sorted((str(i), text) for i, text in expected)


def test_a_text_of_many_pieces(spark, monkeypatch):
    texts = [("abc Dé f " * 700 + f"x{i} " * 30 + "tail words of all").encode() for i in range(3)]
    whole = near_duplicates.shingle_sets(texts, 4)
    marks = near_duplicates._signed_sets([whole[0]])
    monkeypatch.setattr(near_duplicates, "PIECE", 100)
    monkeypatch.setattr(near_duplicates, "SLICE", 10)
    monkeypatch.setattr(near_duplicates, "PERMUTED", 1024)
    assert all((a == b).all() for a, b in zip(near_duplicates.shingle_sets(texts, 4), whole))
    assert (near_duplicates._signed_sets([whole[0]]) == marks).all()


NOTICES = {
    "licensed under the Apache License, Version 2.0": "apache-2.0",
    "licensed under the license version 2 0": "",
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC-BY-NC 4.0": "cc-by,cc-by-nc",
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
    "dedicated to the public domain under CC0 1.0 Universal": "cc0",
    "This work is licensed under the GNU General Public License version 3": "gpl",
    "licensed under the GNU Lesser General Public License version 3": "gpl,lgpl",
    "Released under the MIT license.": "mit",
    "subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "Copyright 2020. All rights reserved.": "reserved",
    "This is free and unencumbered software released into the public domain": "unlicense",
}


def test_labels_of_notices(spark):
    docs = spark.createDataFrame([(i, f"some words before {n} and after") for i, n in enumerate(NOTICES)], "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert [found[i] for i in range(len(NOTICES))] == list(NOTICES.values())
