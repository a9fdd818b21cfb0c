"""The training-data operators against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from comparing import duck
from pyspark.sql import functions as F

from ledgerloom.llm import (
    decontamination, languages, licenses, mixing, near_duplicates, neighbours, quality, queries, scoring, sharding, substrings,
    tokens,
)
from ledgerloom.llm.common import is_held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, label string, kept boolean"
ODD = [
    (1, None, "en", "a", 1, "x", True), (2, "", "en", "a", 1, "x", True), (3, " \n\t ", None, None, None, None, None),
    (4, "The cat sat on the mat and looked at the dog that lay there", "en", "a", 1, "x", True),
    (4, "The cat sat on the mat and looked at the dog that lay there", "en", "a", 1, "x", True),
    (5, "The cat sat on the mat and looked at the dog that lay there", "en", "b", 1, "x", True),
    (6, "Licensed under CC BY-NC 4.0. All rights reserved. All rights reserved.", "en", "b", 1, "x", True),
    (7, "wort " * 5000 + "x" * 20000 + " été naïve \U0001f600", "de", "b", 1, "x", True),
    (None, "le chat est sur la table et le chien dort dehors", "fr", "c", 1, "x", True),
    (None, None, "fr", "c", 1, "x", True), (8, "### $$$ %%% 123", "fr", "c", 1, "x", True), (9, "\x00a b\x0bc", "fr", "c", 1, "x", True),
]


def model_bytes():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path(queries.TOKENIZER), "rb") as file:
        return file.read()


def operators(spark):
    items = spark.createDataFrame([(1, "cat sat on the mat"), (2, None), (3, "")], "item_id long, text string")
    labelled = spark.createDataFrame([(4, "good"), (6, "low"), (None, "low"), (99, "good")], "doc_id long, domain string")
    return {
        "mixing": lambda d: mixing.mix_rates(d, labelled, {"good": 0.5, "low": 0.5}),
        "licenses": licenses.scan_licenses,
        "decontamination": lambda d: decontamination.decontaminate(d, items),
        "substrings": lambda d: substrings.digest(substrings.remove_repeats(d, keep="none")),
        "sharding": sharding.assign_shards,
        "near_duplicates": near_duplicates.near_duplicates,
        "tokens": lambda d: tokens.count_tokens(d, model_bytes()),
        "quality": quality.judge_quality,
        "languages": lambda d: languages.predict_languages(d, is_held_out(5, 0)),
        "scoring": lambda d: scoring.score_texts(d, is_held_out(7, 2)),
        "neighbours": lambda d: neighbours.score_quality(
            d, labelled.select("doc_id", (F.col("domain") == "good").cast("int").alias("label")), is_held_out(4, 2)
        ),
    }


NAMES = [
    "mixing", "licenses", "decontamination", "substrings", "sharding", "near_duplicates", "tokens", "quality",
    "languages", "scoring", "neighbours",
]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_keep_a_row_each(spark, name):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = operators(spark)[name](docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(o[0]) for o in ODD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], SCHEMA)).collect() == []


def words_in(seed, alphabet="abcdefgé "):
    draw = random.Random(seed)
    return lambda n: " ".join("".join(draw.choice(alphabet) for _ in range(draw.randint(2, 9))) for _ in range(n)), draw


@pytest.mark.parametrize("crowd", [256, 2])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeated_substrings(spark, monkeypatch, crowd, keep):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    blob, draw = words_in(5)
    long, short = blob(120), blob(70)
    texts = [blob(draw.randint(5, 60)) + long[: draw.randint(300, len(long))] + blob(draw.randint(5, 60)) for _ in range(15)]
    texts += [blob(30) + short + blob(30) for _ in range(8)] + ["ab " * 400, "ab " * 300, None, "", long, long, blob(200) * 2]
    found = defaultdict(list)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        for p in range(len(raw) - 399):
            found[raw[p : p + 400]].append((i, p))
    expected = {}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 399):
            places = found[raw[p : p + 400]]
            if len(places) > 1 if keep == "none" else min(places) < (i, p):
                gone[p : p + 400] = b"\1" * 400
        expected[i] = bytes(b for b, g in zip(raw, gone) if not g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substrings.remove_repeats(docs, keep=keep).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == expected


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_near_duplicates(spark):
    blob, draw = words_in(7, "abcdefghij ")
    texts = []
    shared = blob(60)
    for _ in range(12):
        base = blob(80).split()
        for _ in range(draw.randint(1, 40)):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = blob(1)
            texts.append(" ".join(copy))
    texts += [shared + " " + blob(draw.randint(4, 20)) for _ in range(60)] + [None, "", "one", "One", "one two"]
    sets = [shingles(t, 4) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_duplicates.near_duplicates(docs, k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3).integers(1, 2**62, 900).astype(np.uint64)
    one, two = draw[:600], draw[150:900]  # 450 of 900
    marks = near_duplicates.super_minhash(np.concatenate([one, two]), np.repeat([0, 1], [600, 750]), 2)
    assert abs((marks[0] == marks[1]).mean() - 0.5) < 0.15


def test_chunked_counts_equal_whole_counts():
    counter = tokens.ChunkedCounter(model_bytes(), chunk=200, overlap=8)
    assert counter.proven
    draw = random.Random(1)
    for _ in range(60):
        n = draw.randint(150, 1500)
        text = "".join(draw.choice(["a", "b", " ", "  ", "\n", "the", "é", "ing ", "\U0001f600", "<s>", "▁", "x" * 90]) for _ in range(n))
        assert counter.count([text]) == [len(counter.model.encode(text))]


def test_language_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 150")
    rows = docs.select("doc_id", "text").collect()

    def split(text):
        return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split() + [None]

    words, pairs = Counter(), Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            own = split(r.text)
            words.update(own)
            pairs.update(zip([0] + own[:-1], own))
    total, types = sum(words.values()), len(words)
    result = scoring.score_texts(docs, is_held_out(7, 2), block_bytes=50_000, shard_bytes=60_000).collect()
    by_id = {r.doc_id: r for r in result}
    assert len(by_id) == len(rows)
    for r in rows:
        own, base, score = split(r.text), 0.0, 0.0
        for before, word in zip([0] + own[:-1], own):
            p = (words[word] + 1) / (total + types + 1)
            context = words[None] if before == 0 else words[before]
            base += math.log10(p)
            score += math.log10(0.6 * min(1, pairs[before, word] / context) + 0.4 * p if context else p)
        found = by_id[r.doc_id]
        assert (found.n_tokens, found.n_known, found.train_tokens) == (len(own), sum(words[w] > 0 for w in own), total)
        assert found.base_score == pytest.approx(base)
        assert found.score == pytest.approx(score, rel=2e-3)


def test_quality_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 300")
    found = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    for r in docs.collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r.text) if w]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = Counter(grams)
        hit = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        own = found[r.doc_id]
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words, own.base_failed) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(hit), failed,
        )
        assert not (failed and own.kept)


def test_quality_of_a_group_with_many_outliers(spark):
    blob, draw = words_in(13, "abcdefghij")
    rows = []
    for i in range(400):
        junk = i % 5 < 2 and i < 200  # two fifths of the first group, none of the second
        words = blob(draw.randint(120, 200)).split()
        share = draw.uniform(0.3, 0.6) if junk else 0.0
        rows.append((i, " ".join(w + "#" * (draw.random() < share) for w in words), "en", "a" if i < 200 else "b", junk))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    found = {r.doc_id: r for r in quality.judge_quality(docs.drop("junk")).collect()}
    assert not any(r.base_failed for r in found.values())
    assert sorted(i for i, r in found.items() if r.kept) == [i for i, *_, junk in rows if not junk]


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries.op9_languages(spark, sf_dir).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n, low, high = found.select(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang"), F.min("score"), F.max("score")
    ).first()
    assert n > 100 and right > 0.98 and 0 <= low <= high <= 1


def test_mixing_meets_reachable_targets(spark, sf_dir):
    rows = queries.op1_mixing(spark, sf_dir).collect()
    total = sum(r.n_tokens for r in rows)
    for domain, share in queries.TARGETS.items():
        expected = sum(r.n_tokens * r.rate * r[f"p_{domain}"] for r in rows)
        assert expected == pytest.approx(share * total, rel=0.05, abs=0.002 * total)
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and 0 <= r.rate <= 4 for r in rows)


def test_priors_count_all_labelled_documents(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} text") for i in range(3000)] + [(0, "again")], "doc_id long, text string")
    names = [(i, "good" if i % 10 else "low") for i in range(2000)] + [(i, "low") for i in range(9000, 9500)]
    labelled = spark.createDataFrame([*names, (1, "good"), (None, "low")], "doc_id long, domain string")
    whole, few = mixing.fit_domains(docs, labelled), mixing.fit_domains(docs, labelled, most=40)
    assert whole.domains == few.domains == ["good", "low"]
    # 1800 good and one of them twice; 200 low and document 0 in two rows; the rest has no document
    assert whole.priors == few.priors == [pytest.approx(math.log(1802)), pytest.approx(math.log(202))]
    assert whole.weights != few.weights


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.assign_shards(docs).collect()
    for r in rows:
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 40), jump(key, 41))
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 16
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_short_benchmark_items(spark):
    docs = spark.createDataFrame([(1, "a b the red fox c"), (2, "the red"), (3, "red fox THE red fox")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "The red-fox"), (8, "fox")], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.decontaminate(docs, items).collect()}
    assert found == {1: (6, 3, 2), 2: (2, 0, 0), 3: (5, 4, 2)}


def test_shared_passages_too_short_to_remove(spark):
    blob, _ = words_in(11)
    shared = blob(20)[:150]
    docs = spark.createDataFrame([(i, blob(90) + shared + blob(90)) for i in range(12)], "doc_id long, text string")
    assert all(r.spans == [] for r in substrings.remove_repeats(docs, keep="none").collect())


def test_blocks_ask_only_the_shards_that_hold_their_ngrams(spark):
    blob, _ = words_in(17)
    texts = [blob(30) for _ in range(20)] + ["", None]
    block = scoring.Block([(t or "").encode() for t in texts], 50_000)
    asked = [(level, shard) for level, shard, *_ in block.requests(np.zeros(len(texts), bool))]
    assert len(asked) == len(set(asked)) <= sum(len(keys) for keys, _ in block.levels)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many, few = (
        {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in
         scoring.score_texts(docs, is_held_out(7, 2), block_bytes=1500, shard_bytes=size).collect()}
        for size in (20, 1 << 20)
    )
    assert many.keys() == few.keys() == set(range(len(texts)))
    for i, row in many.items():
        assert row[:2] == few[i][:2] and row[2:] == pytest.approx(few[i][2:])


def test_sharding_matches_sql(spark, sf_dir):
    con = duck(sf_dir)
    rows = queries.op5_sharding(spark, sf_dir).select("doc_id", "size", "law", "shard", "slot", "grown_shard").collect()
    assert sorted(tuple(r) for r in rows) == sorted(con.execute(queries.SHARDING_SQL).fetchall())
