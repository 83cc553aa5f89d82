import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.llm import packing, splitting, tokens

TEXT = st.text(alphabet="ab1_ \n.,é漢\u00a0", max_size=400)


def plain_tokens(text):
    """The definition, character by character."""
    out, run = [], None
    for i, c in enumerate(text):
        word = c.isascii() and (c.isalnum() or c == "_")
        if word:
            run = i if run is None else run
        else:
            if run is not None:
                out.append((run, i))
                run = None
            if not c.isspace():
                out.append((i, i + 1))
    return out + ([(run, len(text))] if run is not None else [])


@given(TEXT)
def test_tokens(text):
    a, b = tokens.offsets(text)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == plain_tokens(text) and tokens.count(text) == len(a)


@settings(max_examples=200)
@given(TEXT, st.integers(2, 30), st.integers(0, 10))
def test_pieces(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    out = splitting.pieces(text, limit, overlap)
    spans = plain_tokens(text)
    at = {a: i for i, (a, _) in enumerate(spans)}
    end = {b: i for i, (_, b) in enumerate(spans)}
    covered, last = 0, 0
    for start, stop, n, kept in out:
        i, j = at[start], end[stop] + 1
        assert j - i == n <= limit and kept <= overlap and i == last - kept and j > last
        assert n == tokens.count(text[start:stop])
        covered, last = j, j
    assert covered == len(spans)


def test_natural_boundaries():
    text = "one two three.\n\nfour five six seven eight"
    assert [text[a:b] for a, b, _, _ in splitting.pieces(text, 6, 0)] == ["one two three.", "four five six seven eight"]
    long = "x" * 5 + "é" * 50
    assert [n for _, _, n, _ in splitting.pieces(long, 20, 4)] == [20, 20, 19]


def test_tables(spark):
    big = "word " * 3000
    df = spark.createDataFrame([(1, big), (1, big), (2, None), (3, ""), (None, big), (4, "few words"), (5, "漢" * 1025)], "doc_id bigint, text string").withColumn("piece", F.lit("x"))
    out = splitting.split(df)
    assert {(r.doc_id, r.piece) for r in out.collect() if r.doc_id != 5} == {(k, i) for k in (1, None) for i in range(4)} or out.where("doc_id = 1").count() == 2 * out.where("doc_id is null").count()
    assert sorted((r.doc_id for r in splitting.oversized(df).collect()), key=str) == [1, 5, None]
    assert splitting.split(df.where("false")).count() == 0
    assert splitting.split(df, keep_small=True).where("doc_id = 4").count() == 1
    with pytest.raises(ValueError, match="overlap"):
        splitting.split(df, limit=10, overlap=10)


def test_bins_hold_every_constraint():
    r = random.Random(5)
    bins, used = packing.Bins(100, 6, 4000), {}
    for s in sorted((r.randrange(0, 60) for _ in range(400)), reverse=True):
        used.setdefault(bins.put(s), []).append(s)
    for sizes in used.values():
        assert sum(sizes) <= 100 and len(sizes) <= 6 and sum(s * s for s in sizes) <= 4000


def test_pack(spark):
    r = random.Random(7)
    rows = [(i, "w " * r.randrange(1, 900)) for i in range(300)] + [(1000, "w " * 5000), (1001, None), (1002, ""), (1003, "w"), (1003, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit(1)).withColumn("container", F.lit("c"))
    out = packing.pack(df).toPandas()
    boxes = out.groupby("container").n_tokens.sum()
    assert boxes.max() <= 2048 and out.groupby("container").size().max() <= 128
    assert out.n_tokens.sum() == sum(tokens.count(t) for _, t in rows)
    assert (out.groupby("doc_id").piece.max() > 0).sum() == 1 and len(out[out.doc_id == 1003]) == 2
    assert boxes.sum() / 2048 / len(boxes) > 0.95
    assert packing.pack(df.where("false")).count() == 0


def fits(bins, sizes):
    where = [bins.put(n) for n in sizes]
    for b in set(where):
        held = [n for n, w in zip(sizes, where, strict=True) if w == b]
        assert sum(held) <= bins.capacity and len(held) <= bins.places and (len(held) == 1 or sum(n * n for n in held) <= bins.attention)
    return where


def test_every_constraint_binds():
    import random

    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 60) for _ in range(3000)), reverse=True)
    wide = fits(packing.Bins(100, 128, 10_000), sizes)
    assert sum(sizes) >= 0.99 * 100 * (max(wide) + 1 - 1)
    few = fits(packing.Bins(100, 2, 10_000), sizes)
    tight = fits(packing.Bins(100, 128, 2500), sizes)
    assert max(few) > max(wide) and max(tight) > max(wide)


def test_best_fit_looks_at_every_container():
    """Against a scan of all containers, with many of one residual and little attention left in the first ones."""
    import random

    rng = random.Random(4)
    sizes = [50] * 150 + [rng.randrange(1, 12) for _ in range(600)]
    bins = packing.Bins(60, 9, 2600)
    for n in sizes:
        cost = min(n * n, 2600)
        able = [(64 * ((t - n) / 60) ** 2 + bins._norm(b), b) for b, (t, p, a) in enumerate(bins.left) if t >= n and p > 0 and a >= cost]
        want = min(able)[0] if able else None
        count = len(bins.left)
        norm = {b: 64 * ((bins.left[b][0] - n) / 60) ** 2 + bins._norm(b) for b in range(count)}
        got = bins.put(n)
        assert (got == count) == (want is None) and (want is None or abs(norm[got] - want) < 1e-12)


def test_fill_of_the_test_documents(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.01"):
        df = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
        row = df.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.max("n").alias("most"), (F.sum("n") / F.count("*") / 2048).alias("fill")).collect()[0]
        assert row.most <= 2048 and row.fill >= 0.99
