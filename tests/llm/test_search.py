"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in own)
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    found = {}
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c in own:
            m = 25 + 75 * sum(c.values()) * n_docs // max(total, 1)
            score = 0
            for t, r in asked.items():
                if c[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += r * weight * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        found[item] = [(rank + 1, None if nul else i, -s) for rank, (s, nul, i) in enumerate(sorted(scored)[:k])]
    return found


@pytest.mark.parametrize("slices, block, at_once", [(2048, 16, 512), (37, 3, 7)])
def test_ranking(spark, monkeypatch, slices, block, at_once):
    for name, value in (("SLICE", slices), ("BLOCK", block), ("QUERIES", at_once)):
        monkeypatch.setattr(search, name, value)
    draw = random.Random(3)
    vocabulary = [f"{c}{i}" for i in range(40) for c in ("wort", "é", "x")]
    topics = [draw.sample(vocabulary, 12) for _ in range(9)]

    def text(n):
        topic = draw.choice(topics)
        return " ".join(draw.choice(topic if draw.random() < 0.8 else vocabulary) for _ in range(n))

    docs = [(i, text(draw.randint(0, 60))) for i in range(400)]
    docs += [(i, "the wort1 É1 é1") for i in range(1000, 1040)]  # ties
    docs += [(None, "wort1 wort2 zebra"), (None, None), (2000, ""), (2001, "WORT1_wort2\u2003wort3")] + [(7, "x1 x2 wort1")] * 3
    items = [(j, text(draw.randint(1, 15))) for j in range(25)]
    items += [(100, "É1 é1 wort1 wort1"), (101, None), (102, ""), (103, "nowhere"), (104, "Zebra"), (100, "É1 é1 wort1 wort1")]
    frame = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, item_id string, score long")
    rows = search.search(frame.repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=10).collect()
    expected = {k: v for k, v in ranking(docs, items, 10).items() if v}
    found = {}
    for r in sorted(rows, key=lambda r: (r.item_id, r.rank)):
        found.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    assert found == expected


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("aBc dé-f " * 500 + "x" * 3000 + " tail").encode()
    whole = [t for part in search.terms_in(text) for t in part]
    monkeypatch.setattr(search, "PIECE", 50)
    parts = list(search.terms_in(text))
    assert len(parts) > 10 and [t for part in parts for t in part] == whole == [t.encode() for t in terms(text.decode())]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(docs, items).collect() == []
    assert search.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


def test_blocks_are_skipped(spark, sf_dir, monkeypatch):
    """Far fewer documents are judged than hold a term; the bounds do the work."""
    judged = []
    documents = search.Blocks.documents
    monkeypatch.setattr(search.Blocks, "documents", lambda self, chosen: judged.append(len(chosen)) or documents(self, chosen))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    queries = search.Queries.of(texts)
    rows = search.term_counts(docs, queries).toPandas()
    counts = spark.createDataFrame(rows, "doc_id long, n long, terms array<int>, tfs array<long>")
    searcher = search.Searcher(queries, search.Corpus.of(counts, len(queries.vocabulary)), 10)
    import numpy as np

    searcher.add(
        rows.doc_id.tolist(), rows.n.to_numpy(), rows.terms.map(len).to_numpy(), np.concatenate(rows.terms).astype(np.int64),
        np.concatenate(rows.tfs).astype(np.int64),
    )
    holding = sum(int(np.isin(own, t).any()) for t in queries.terms for own in rows.terms)
    assert 0 < sum(judged) * search.BLOCK < holding
