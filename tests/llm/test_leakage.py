import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import leakage

R = random.Random(11)
NOUNS = [a + b for a in "am bor cel dru fen gal hum jor kel lum mar nes ost pir".split() for b in "ber dan fix gon hap kit lor mus nad pex rov sil".split()]
ASK = "Answer the question about the repository below. Use only what the excerpt says. "


def sentence(r):
    a = lambda: r.choice(NOUNS)
    return f"Suppose the {a()} {a()} closes while {r.randrange(100)} {a()} readers of {a()} stay open although {a()} was sealed by {a()}_{a()} before the {a()} {a()} moved {r.randrange(100)} rows to {a()}."


ITEMS = [(i, (ASK if i % 2 else "") + sentence(R) + " " + sentence(R), f"Only the {R.choice(NOUNS)} keeps {R.choice(NOUNS)} open, as {R.randrange(100)} locks are held by {R.choice(NOUNS)} and the {R.choice(NOUNS)} that asked first.") for i in range(24)]
NOISE = ["the fact about it was marked invalid on day four and replaced by one about something else entirely"] * 6


def docs(spark, extra):
    r = random.Random(5)
    rows = [(1000 + i, " ".join([*NOISE, sentence(r), *NOISE])) for i in range(60)]
    return spark.createDataFrame(rows + extra, "doc_id bigint, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit("x"))


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string, answer string")


def changed(text, r, every=6):
    w = text.split()
    for k in range(3, len(w) - 3, every):
        w[k] = r.choice(["really", "then", "also"])
    return " ".join(w)


def test_leaks(spark):
    body = lambda i: ITEMS[i][1].removeprefix(ASK)
    mid = " ".join(NOISE[:2])
    w = body(3).split()
    extra = [
        (1, mid + " " + body(2) + " " + mid),
        (2, mid + " " + body(4).upper().replace(" ", "  ") + " " + mid),
        (3, mid + " " + " ".join(w[:14]) + "\n\n" + NOISE[0] + "\n\n" + " ".join(w[14:30]) + " " + mid),
        (4, mid + " " + changed(body(6), R) + " " + mid),
        (5, mid + " " + ITEMS[7][2].replace("locks", "lo\u200bcks") + " " + mid),
        (6, mid + " " + ASK + mid),
        (7, mid + " " + " ".join(w[:6]) + " " + mid),
        (8, None), (9, ""), (10, " ".join(x for x in w if x.strip(".").lower() in NOUNS)),
        (1, mid + " " + body(2) + " " + mid),
    ]
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs(spark, extra), items(spark)).collect()}
    assert got == {(1, 2), (2, 4), (3, 3), (4, 6), (5, 7)}


def test_short_passage_interrupted_once(spark):
    mid, pad = " ".join(NOISE[:2]), " ".join(NOISE * 6).split()
    gaps, extra = (0, 15, 40, 150, 400), []
    for n, gap in enumerate(gaps):
        for i in range(12):
            w = ITEMS[i][1].removeprefix(ASK).split()[3:18]
            extra.append((100 * n + i, " ".join([mid, *w[:8], *(pad * 3)[:gap], *w[8:], mid])))
    half = ITEMS[13][1].removeprefix(ASK).split()[3:11]
    extra.append((900, " ".join([mid, *half, *pad[:40], *half, mid])))
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs(spark, extra), items(spark)).collect()}
    # one of the passages is mostly words that other items share, so it is none in one piece either
    whole = {i for d, i in got if d < 100}
    assert len(whole) >= 11
    assert got == {(100 * n + i, i) for n in range(len(gaps)) for i in whole}


def test_empty_sides(spark):
    none = items(spark).where("false")
    assert leakage.leaks(docs(spark, []), none).count() == 0
    assert leakage.leaks(docs(spark, []).where("false"), items(spark)).count() == 0


def test_singular_vectors_against_numpy(spark):
    r = np.random.default_rng(2)
    n = 30
    topics = [r.choice(n, 6, replace=False) for _ in range(4)]
    texts = [[int(r.choice(topics[k % 4])) for _ in range(leakage.SPAN * 2)] for k in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key bigint, w array<int>")
    idf = r.uniform(0.5, 1, n).astype(np.float32)
    a = np.zeros((400, n))
    for i, t in enumerate(texts):
        for j, x in enumerate(t):
            a[2 * i + j // leakage.SPAN, x] += idf[x]
    got = leakage.singular_vectors(df, idf, rank=4, over=20)
    want = np.linalg.svd(a, full_matrices=False)[2][:4].T
    assert np.linalg.svd(want.T @ got, compute_uv=False).min() > 0.98


def test_words():
    assert leakage.words("Al­pha <b>beta</b> ham-\nmer x\\_y &lt;p&gt; dеlta") == ["alpha", "beta", "hammer", "x_y", "delta"]


@pytest.mark.parametrize(("a", "b", "n"), [([1, 2, 3], [1, 3], 2), ([], [1], 0), ([1, 1, 2], [2, 1, 1], 2)])
def test_common(a, b, n):
    assert leakage.common(a, b) == n


def test_words_of_other_scripts():
    assert leakage.words("Café naïve Größe") == ["cafe", "naive", "große"]
    assert leakage.words("漢字 abc") == ["漢", "字", "abc"]
    assert leakage.words("стол и дом") == ["стол", "и", "дом"]
    # a look-alike word in Latin text, and a Russian one of the same letters in Russian text
    assert leakage.words("please сору the file now") == ["please", "copy", "the", "file", "now"]
    assert leakage.words("мы просили сору дома") == ["мы", "просили", "сору", "дома"]


def test_long_instruction_is_an_opening():
    ask = " ".join(f"{NOUNS[k]} should be {NOUNS[k + 1]}" for k in range(60)) + ". "
    side = leakage.Items([(i, ask + sentence(R) + " " + sentence(R), None) for i in range(10)])
    assert len(side.sequences) == 10 and all(w[:3] != leakage.words(ask)[:3] and len(w) < 80 for _, w in side.sequences)


def test_items_in_parts_and_scripts(spark, monkeypatch):
    body = lambda i: ITEMS[i][1].removeprefix(ASK)
    r = random.Random(3)
    chinese = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(60))
    russian = " ".join("".join(r.choice("бвгджзиклмнпрстуфц") for _ in range(6)) for _ in range(40))
    more = spark.createDataFrame([*ITEMS, (90, chinese, None), (91, russian, None), (92, None, None)], "item_id bigint, text string, answer string")
    mid = " ".join(NOISE[:2])
    df = docs(spark, [(1, f"{mid} {body(2)} {mid}"), (2, f"{mid} {chinese[10:40]} {mid}"), (3, f"{mid} {' '.join(russian.split()[5:30])} {mid}")])
    whole = {(x.doc_id, x.item_id) for x in leakage.leaks(df, more).collect()}
    assert whole == {(1, 2), (2, 90), (3, 91)}
    monkeypatch.setattr(leakage, "MOST_ITEM_WORDS", 400)
    assert {(x.doc_id, x.item_id) for x in leakage.leaks(df, more).collect()} == whole
