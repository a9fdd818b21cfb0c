"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import spellings
from ledgerloom.llm.common import stored

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")


def corpus_words(rows, thinned, least):
    count = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % thinned == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def forms(words):
    near = defaultdict(list)
    at_length = defaultdict(list)
    for w in words:
        at_length[len(w)].append(w)
    for a in words:
        for b in at_length[len(a)] + at_length[len(a) + 1]:
            if (len(a) < len(b) or a < b) and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    found = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        found[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return found


def compare(spark, rows, thinned=199, least=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spellings.spelling_forms(docs, thinned=thinned, least=least).collect()
    assert len(found) == len({r.word for r in found})
    expected = forms(corpus_words(rows, thinned, least))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == expected
    return expected


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = compare(spark, rows)
    assert any(f for f, *_ in expected.values())


def test_chains_ends_and_letters(spark):
    counts = {
        "naïveté": 4, "naïvetéé": 30, "xnaïvetéé": 200, "xnaïvetéÿ": 1100,  # a chain of forms
        "abcdef": 1, "bcdefgh": 1, "abcdefg": 30, "abcdefgh": 5, "habcdefg": 5, "abcxdefg": 5, "aacdefg": 30,
        "aaaaaa": 2, "aaaaaaa": 2, "aaaaaaaa": 11, "short": 9, "l×÷ngest": 3,
    }
    rows = [(i, " ".join([w] * n) + "_" + w.replace("a", "A")) for i, (w, n) in enumerate(counts.items())]
    rows += [(None, "Éclairs, ÉCLAIRS; éclairs 12 éclairs\u0301 x"), (None, None), (77, ""), (77, "a" * 40_000)]
    rows += [(5, "copycopy copycopi")] * 3
    expected = compare(spark, rows, least=1)
    assert expected["naïveté"][:2] == ("naïvetéé", "xnaïvetéÿ")
    compare(spark, rows, thinned=2, least=1)


@pytest.mark.parametrize("text", [[], [None, "", "one two"]])
def test_no_words(spark, text):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(text)], "doc_id long, text string, n long")
    assert spellings.spelling_forms(docs).collect() == []


def test_no_side_that_grows_with_the_words_passes_the_driver(spark, monkeypatch):
    ran = []

    def watched(df, name):
        df.collect()
        ran.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(spellings, "stored", watched)
    docs = spark.createDataFrame([(0, "spelling " * 40 + "speling " * 6 + "spelin " * 1)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10g")  # as if Spark took each side for a small one
    try:
        found = spellings.spelling_forms(docs, least=1)
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.word, r.root) for r in rows) == [("spelin", "spelling"), ("speling", "spelling"), ("spelling", "spelling")]
    joins = [p for p in [*ran, found._jdf.queryExecution().executedPlan().toString()] if "Join" in p]
    assert len(joins) >= 4 and all("SortMergeJoin" in p and "Broadcast" not in p for p in joins)
