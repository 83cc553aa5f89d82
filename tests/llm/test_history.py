import random

import pytest

from basalt.llm import history

DAY = 86_400_000
DDL = "id string, group_id string, content string, created_at bigint, emb array<float>, emb_model string"
NOUNS = "spring ribbon basket lantern saddle tower mortar freight socket pepper anchor bottle candle drawer engine fabric garden hammer island jacket kernel ladder magnet needle orchard packet quartz radar saddle tanker umbrella valley wagon zephyr barrel copper dagger ember feather glacier helmet iris jersey kettle lagoon".split()
WAYS = (
    "cache lifetime of {n} inside {s}: {k} minutes",
    "the {n} is kept in a cache for {k} minutes by {s}",
    "hidden {n} files: only read by {s} with {m} set, {k} at most",
    "{s} ignores hidden {n} files unless {m} is set, {k} at most",
    "deploy {s} to {p} only after the {n} migration number {k}",
    "{s} in {p} requires the {n} migration number {k} to be finished",
)
PLACES = ("staging", "production", "replica", "sandbox")


def pad():
    rng = random.Random(5)
    return [
        (f"pad{i}", "other", WAYS[i % 6].format(n=rng.choice(NOUNS), m=rng.choice(NOUNS), p=rng.choice(PLACES), s=f"hatch_{rng.choice(NOUNS)}.run{i}", k=i + 400), 0, None, None)
        for i in range(600)
    ]


PAD = pad()


def run(spark, rows, batches=3):
    df = spark.createDataFrame(PAD + rows, DDL)
    return {(r.id, r.earlier_id) for r in history.rejects(df, batches).collect() if not r.id.startswith("pad")}


def fact(i, text, day=0, group="g", emb=None):
    return (i, group, text, day * DAY, emb, "m" if emb else None)


A = "cache lifetime of spring inside squad_ferry.get_pocket_1: 87 minutes"
CASES = (
    (A, True),
    ("the spring is kept in a cache for 87 minutes by squad_ferry.get_pocket_1", True),
    ("cache  lifettime of spring inside `Squad_ferry.get_pocket_1`: 87 minutes", True),
    ("cache lifetime of sprnig inside squad_ferry.get_pocket_1: 87 minutes", True),
    (A.replace("spring", "ribbon"), False),
    (A.replace("87", "88"), False),
    (A.replace("pocket_1", "pocket_2"), False),
    ("It is no longer true that " + A, False),
    (A + " in quarantine", False),
    ("the spring is not kept in a cache for 87 minutes by squad_ferry.get_pocket_1", False),
)


def test_says_again(spark):
    """The cases side by side, each in a group of its own."""
    rows = [x for k, (later, _) in enumerate(CASES) for x in (fact(f"a{k}", A, 1, f"g{k}"), fact(f"b{k}", later, 3, f"g{k}"))]
    got = run(spark, rows)
    assert got == {(f"b{k}", f"a{k}") for k, (_, same) in enumerate(CASES) if same}


def test_vectors_decide_what_the_words_leave_open(spark):
    near, far = [1.0, 0.3], [0.2, 1.0]
    remark = "Fyi " + A
    rows = [fact("a", A, 1, "g", [1.0, 0.2]), fact("b", remark, 2, "g", near), fact("c", A, 1, "h", [1.0, 0.2]), fact("d", remark, 2, "h", far), fact("e", A, 1, "i"), fact("f", remark, 2, "i")]
    assert run(spark, rows) == {("b", "a")}


def test_unrelated_facts_stay(spark):
    rows = [
        fact("a", "Deploys happen on Friday afternoon"), fact("b", "The office kitchen prefers green tea", 1), fact("c", "x.f accepts empty lists"),
        fact("d", "x.f rejects huge payloads", 1), fact("e", "x.f is thread safe", 2), fact("f", "deploys happen on friday afternoon", 3),
    ]
    assert run(spark, rows) == {("f", "a")}


def test_earliest_groups_nulls_ties(spark):
    rows = [
        fact("z", A, 0), fact("y", A, 0), fact("b", A, 1), fact("c", A, 4), fact("c", A, 4), fact("o", A, 2, "elsewhere"), fact("n", None, 2), fact("e", "  ", 2),
        ("t", "g", A, None, None, None), ("u", None, A, DAY, None, None), (None, "g", A, DAY, None, None),
    ]
    assert run(spark, rows) == {("z", "y"), ("b", "y"), ("c", "y")}


@pytest.mark.parametrize("batches", [1, 4])
def test_chain_is_settled_in_order(spark, batches):
    """b repeats a; c is two letters from a and one from the rejected b, so it stays; d repeats c."""
    a, b, c = "cabinet", "cabinett", "ccabinett"
    rows = [fact(i, f"alpha beta gamma {w} delta_1.run", d) for i, w, d in (("a", a, 0), ("b", b, 1), ("c", c, 2), ("d", c, 3))]
    assert run(spark, rows, batches) == {("b", "a"), ("d", "c")}


def test_another_session_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    feats = history.featurise(spark.createDataFrame([*PAD, fact("a", A), fact("b", A, 9)], DDL)).cache()
    assert history.HistoryIndex(spark, path).accept(feats.where(f"at < {DAY * 9}")).where("id not like 'pad%'").count() == 0
    again = history.HistoryIndex(spark, path)
    assert again.done() == [0]
    late = feats.where(f"at >= {DAY * 9}")
    assert [tuple(r) for r in again.accept(late, 7).collect()] == [("b", "a")]
    # written again, a batch takes its own place: it does not meet itself and leaves no double rows
    fresh = history.featurise(spark.createDataFrame([fact("n", A.replace("87", "12"), 9)], DDL))
    for _ in range(2):
        assert again.accept(fresh, 8).count() == 0
    assert again._read("postings", history.POSTING, [8]).select("cid").distinct().count() == 1
    assert again.done() == [0, 7, 8]


def test_rows_read_do_not_grow_with_the_history(spark, tmp_path):
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index")
    day = [fact(f"f{d}_{i}", f"module_{d}.call{i} needs " + " ".join(NOUNS[(i + k * d) % 40] for k in range(1, 5)), d) for d in range(1, 5) for i in range(1500)]
    feats = history.featurise(spark.createDataFrame(day, DDL)).cache()
    for d in range(1, 5):
        index.accept(feats.where(f"at = {d * DAY}"))
    mine = index._read("postings", history.POSTING, [0]).where("first.id = 'f1_3'").select("token")
    read = []
    for upto in (1, 4):
        held = index._held("postings", history.POSTING, list(range(upto)), "token", mine)
        assert held.count() >= mine.count() > 0
        df = held.select("token", "cid")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        read.append(sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())))
    whole = index._read("postings", history.POSTING, list(range(4))).count()
    # at most a page of each file for each token, a small part of the history
    assert read[1] < whole / 2, (read, whole)


def test_empty_and_shuffled_words(spark, monkeypatch):
    empty = spark.createDataFrame([], DDL)
    assert history.rejects(empty).count() == 0
    monkeypatch.setattr(history, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(history, "PROBES", 0)
    rows = [fact("a", A), fact("b", "the spring is kept in a cache for 87 minutes by squad_ferry.get_pocket_1", 1), fact("c", A.replace("spring", "ribbon"), 2)]
    assert run(spark, rows) == {("b", "a")}


def test_hot_copies(spark):
    rows = [fact(f"h{i:04d}", A, i % 3) for i in range(3000)]
    got = run(spark, rows)
    assert len(got) == 2999 and {e for _, e in got} == {"h0000"}
