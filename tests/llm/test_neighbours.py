"""Votes of nearest labelled documents."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import neighbours, queries


def test_held_out_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = queries.op13_neighbours(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_votes_equal_brute_force(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    draw = np.random.default_rng(5)
    texts = [bytes(draw.choice(list(b"abc de,#"), draw.integers(1, 300)).astype(np.uint8)) for _ in range(60)]
    counts = neighbours.profiles(texts)
    axes = np.linalg.qr(draw.standard_normal((neighbours.WIDTH, neighbours.LATENT)))[0].astype(np.float32)
    space = neighbours.Voters(np.ones(neighbours.WIDTH, np.float32), axes, np.zeros((0, neighbours.LATENT), np.float32), np.zeros(0))
    labels = draw.integers(0, 2, 40).astype(float)
    voters = neighbours.Voters(space.idf, axes, space.latent(counts[:40]), labels)
    found = voters.votes(counts[40:], k=5)
    for own, score in zip(space.latent(counts[40:]), found):
        cosine = voters.vectors @ own
        near = np.argsort(-cosine, kind="stable")[:5]
        weight = np.maximum(cosine[near], 0)
        expected = (weight * labels[near]).sum() / weight.sum() if weight.sum() else labels.mean()
        assert abs(expected - score) < 1e-4


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("Ab cd ef12 ## gh gh " * 300).encode()
    whole = neighbours.profiles([b"x", text])
    monkeypatch.setattr(neighbours, "PIECE", 64)
    parts = neighbours.profiles([b"x", text])
    assert (whole[0] == parts[0]).all() and len(neighbours.pieces(text)) > 50 and b"".join(neighbours.pieces(text)) == text
    assert abs(whole[1].sum() - parts[1].sum()) < 0.1 * whole[1].sum()
    assert (whole[1, -24:] == parts[1, -24:]).all()


def test_empty_texts_get_the_mean_and_the_sample_is_bounded(spark):
    rows = [(i, f"good words here {i}" if i % 4 else "### $$$ %%% &&&", None) for i in range(200)] + [(900, "", 1), (901, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labelled = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(3, None), (None, 1), (5, 7)], "doc_id long, label int")
    held_out = F.col("doc_id") % 10 == 0
    voters = neighbours.fit_voters(docs.where(~held_out), labelled, sample=50)
    assert len(voters.labels) == 50
    found = {r.doc_id: r for r in neighbours.score_quality(docs, labelled, held_out).collect()}
    mean = sum(i % 4 > 0 for i in range(200) if i % 10) / 180
    assert abs(found[900].score - mean) < 1e-9 and abs(found[901].score - mean) < 1e-9
    assert all(found[i].predicted == (i % 4 > 0) for i in range(0, 200, 10))
