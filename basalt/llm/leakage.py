"""Evaluation texts leaking into training text.

Method. Latent semantic retrieval. Every text becomes the numbers of its words in the vocabulary of the
evaluation items (-1 for any other word), written once. Passages of ``SPAN`` words of all documents
give the TF-IDF matrix A; a distributed randomised SVD sketches Y = A'(A R) in one pass of partial sums,
and the Nystroem form of A'A turns Y into the leading right singular vectors. Overlapping windows of
documents are projected by differences of running sums and compared with the projected item passages by
cosine. A window of a passage that is interrupted holds too few of its words for that, so a document
that holds an item's own three-word run is a candidate as well: fifteen words less three that changed,
cut once, leave twelve in at most five runs, one of which has three words. Candidates go to a chain of
common words in order (longest common subsequence with bounded gaps and one interruption of any
length), weighted so that a skeleton of frequent words does not count.

Shared instructions are found, not listed: an opening of any length that several items share is taken out.

Words are runs of letters, digits and underscores of any script, without accents; a Chinese, Japanese or Korean
character is a word. Letters that look Latin are read as Latin within a word that has Latin letters, and in
words of nothing but such letters where the text is mostly Latin.

Bounds. The evaluation items are the small side (a benchmark does not grow with the corpus): their
words, passages and the sketch (words x ``rank``) are on the driver and broadcast. A benchmark of more than
``MOST_ITEM_WORDS`` words is taken in parts, by a hash of the item, each a search of its own. Nothing of the
documents is collected but the sums over all of them.

Defined results: NULL or blank documents and items match nothing; an item that is shorter than
``LEAST`` words cannot leak; repeated documents come out under each of their ids; repeated rows once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.session import stage

SPAN, STEP = 16, 8
RANK, OVER = 56, 8
COSINE = 0.65
COMMON = 0.35
DENSE, OWN = 0.75, 0.7
LEAST = 12
SLICE = 1 << 15
RARE = 4
PART = 0.45
OWN_WORDS, LEAST_WEIGHT = 4, 1.5
SHARED = 3
MOST_ITEM_WORDS = 200_000

WORD = re.compile(r"[a-z0-9_]+")
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
# Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans(
    "аеорсхуіјѕԁԛАВЕКМНОРСТХІοανΑΒΕΗΙΚΜΝΟΡΤΧ",
    "aeopcxyijsdqABEKMHOPCTXIoavABEHIKMNOPTX",
)
OTHER = re.compile("[\u0370-\u052f]")
LATIN = re.compile("[a-z]")
ACCENT = re.compile("[\u0300-\u036f]+")
LETTERS = re.compile(r"[^\W\x00-\x7f]")
#: a character of a script without blanks, or a run of word characters
ANY_WORD = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\\W\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
BROKEN = re.compile(r"(\w)-\s*\n\s*(\w)")
TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]{0,9}(?:\s[^<>]{0,200})?/?>")


def words(text: str) -> list[str]:
    """The words of a text, with what reformatting adds taken away."""
    foreign = not text.isascii()
    if foreign:
        text = HIDDEN.sub("", text)
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "-" in text:
        text = BROKEN.sub(r"\1\2", text)
    if "\\" in text:
        text = text.replace("\\_", "_").replace("\\n", " ").replace("\\t", " ").replace("\\r", " ")
    text = text.lower()
    if not foreign:
        return WORD.findall(text)
    # letters are parted from their accents
    text = ACCENT.sub("", unicodedata.normalize("NFKD", text))
    if not LETTERS.search(text):
        return WORD.findall(text)
    out = ANY_WORD.findall(text)
    if OTHER.search(text):
        latin = 2 * sum(1 for w in out if LATIN.search(w)) > len(out)
        for k, w in enumerate(out):
            if OTHER.search(w):
                plain = w.translate(ALIKE).lower()
                if LATIN.search(w) or latin and plain.isascii():
                    out[k] = plain
    return out


class Items:
    """The evaluation side: vocabulary, sequences of word numbers, passages."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        texts: dict[int, list[list[str]]] = {}
        for i, t, a in rows:
            texts.setdefault(i, [])
            for x in (t, a):
                w = words(x or "")
                if w and w not in texts[i]:
                    texts[i].append(w)
        # an opening is an instruction as far as at least three items, and one of fifty, share it
        least = max(3, len(texts) / 50)
        openings = [(i, w) for i, ws in texts.items() for w in ws]
        shared = [0] * len(openings)
        alive, k = range(len(openings)), 0
        while alive:
            by: dict[tuple, list[int]] = {}
            for x in alive:
                w = openings[x][1]
                if len(w) > k:
                    # what has come so far is the same for all of a group, so its first member names it
                    by.setdefault((shared_by[x] if k else -1, w[k]), []).append(x)
            shared_by = {x: g[0] for g in by.values() for x in g}
            k += 1
            alive = [x for g in by.values() if len({openings[x][0] for x in g}) >= least for x in g]
            for x in alive:
                shared[x] = k
        self.sequences: list[tuple[int, list[str]]] = []
        for (i, w), cut in zip(openings, shared, strict=True):
            w = w[cut:] if cut >= 10 else w
            if len(w) >= LEAST:
                self.sequences.append((i, w))
        self.vocabulary = {w: k for k, w in enumerate(sorted({x for _, w in self.sequences for x in w}))}
        # items share skeletons: a place whose three-word runs all stand in few items is the item's own
        owners: dict[tuple, set[int]] = {}
        for i, w in self.sequences:
            for k in range(len(w) - 2):
                owners.setdefault(tuple(w[k : k + 3]), set()).add(i)
        self.own: list[np.ndarray] = []
        for _, w in self.sequences:
            own = np.ones(len(w), bool)
            for k in range(len(w) - 2):
                if len(owners[tuple(w[k : k + 3])]) >= SHARED:
                    own[k : k + 3] = False
            self.own.append(own)
        used = Counter(x for _, w in self.sequences for x in set(w))
        n = len(self.sequences)
        # what a word tells of an item: little, if many items use it
        self.telling = np.array([np.log((1 + n) / (1 + used[w])) / np.log(1 + n) for w in self.vocabulary], np.float32)
        told = {x for (_, w), own in zip(self.sequences, self.own, strict=True) for x, o in zip(w, own, strict=True) if o}
        self.rare = np.array([w in told for w in self.vocabulary], bool)
        self.coded = [(i, np.array([self.vocabulary[x] for x in w], np.int32)) for i, w in self.sequences]
        runs = [
            (t, self.coded[t][1][k : k + 3])
            for t, (_, w) in enumerate(self.sequences)
            for k in range(len(w) - 2)
            if len(owners[tuple(w[k : k + 3])]) < SHARED
        ]
        code = run_codes(np.array([g for _, g in runs], np.int64).reshape(-1, 3), len(self.vocabulary))
        order = np.argsort(code, kind="stable")
        # the items' own three-word runs, sorted, and the sequence of each
        self.runs = code[order], np.array([t for t, _ in runs], np.int32)[order]

    def passages(self) -> list[tuple[int, int, int]]:
        """(sequence, from, to): windows of ``SPAN`` words, half overlapping."""
        out = []
        for s, (_, c) in enumerate(self.coded):
            n = len(c)
            # the last window ends with the text, so that each has SPAN words if the text has
            starts = sorted({*range(0, max(1, n - SPAN + 1), STEP), max(0, n - SPAN)})
            out += [(s, a, min(n, a + SPAN)) for a in starts]
        return out


def run_codes(three: np.ndarray, n: int) -> np.ndarray:
    """One number for each row of three word numbers below ``n``; ``MOST_ITEM_WORDS`` cubed fits 64 bits."""
    return (three[:, 0] * n + three[:, 1]) * n + three[:, 2]


def own_runs(w: np.ndarray, off: np.ndarray, runs: tuple[np.ndarray, np.ndarray], n: int) -> Iterator[tuple[int, int, int]]:
    """(text, sequence, place in the text): where the texts of a batch hold a sequence's own run."""
    code, owner = runs
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    known = w >= 0
    at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:] & (text[:-2] == text[2:]))
    got = run_codes(w[at[:, None] + np.arange(3)].astype(np.int64), n)
    a, z = np.searchsorted(code, got, "left"), np.searchsorted(code, got, "right")
    for k in np.flatnonzero(z > a).tolist():
        d = int(text[at[k]])
        for t in owner[a[k] : z[k]].tolist():
            yield d, t, int(at[k] - off[d])


def coded_documents(docs: DataFrame, vocabulary: dict[str, int], key: str, text: str) -> DataFrame:
    """``key, w``: word numbers of every text that is not blank."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            ks, flat, off = [], [], [0]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(t)
                if len(w) >= LEAST:
                    ks.append(k)
                    flat.append(np.fromiter((v.get(x, -1) for x in w), np.int32, len(w)))
                    off.append(off[-1] + len(w))
            val = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), val)], names=["key", "w"])

    slim = docs.where(F.col(text).isNotNull() & (F.length(text) >= 2 * LEAST)).select(F.col(key).cast("bigint"), F.col(text))
    return slim.mapInArrow(run, "key bigint, w array<int>")


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = b.column(1)
    off = np.asarray(col.offsets).astype(np.int64)
    return np.asarray(col.flatten(), np.int32), off - off[0]


def document_frequency(coded: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """In how many documents each word number stands, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(n, np.int64), 0
        for b in batches:
            w, off = _batch(b)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            keep = w >= 0
            both = np.unique(doc[keep].astype(np.int64) * n + w[keep])
            total += np.bincount(both % n, minlength=n)
            docs += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(n), -1), pa.int32()), pa.array(np.append(total, docs), pa.int64())], names=["word", "n"])

    rows = coded.mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, count = np.asarray(rows["word"]), np.asarray(rows["n"])
    out = np.zeros(n, np.int64)
    out[word[word >= 0]] = count[word >= 0]
    return out, int(count[word < 0].sum())


def singular_vectors(coded: DataFrame, idf: np.ndarray, rank: int = RANK, over: int = OVER, seed: int = 11) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix of all passages of all documents."""
    n = len(idf)
    r = min(n, rank + over)
    probe = np.random.default_rng(seed).standard_normal((n, r)).astype(np.float32)
    weighted = np.vstack([probe * idf[:, None], np.zeros((1, r), np.float32)]).astype(np.float32)
    shared = coded.sparkSession.sparkContext.broadcast((weighted, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w_idf = shared.value
        y = np.zeros((n, r), np.float64)
        for b in batches:
            w, off = _batch(b)
            # a passage is SPAN words of one document, one after the other
            place = np.arange(len(w)) - np.repeat(off[:-1], np.diff(off))
            passage = np.cumsum(place % SPAN == 0) - 1
            tells = (w >= 0) & (w_idf[np.maximum(w, 0)] > 0)
            w, passage = w[tells], passage[tells]
            # in slices that stay in the processor's cache
            for at in range(0, len(w), SLICE):
                ws, ps = w[at : at + SLICE], passage[at : at + SLICE]
                first = np.flatnonzero(np.append(True, ps[1:] != ps[:-1]))
                ar = np.add.reduceat(m[ws], first, axis=0)
                order = np.argsort(ws, kind="stable")
                sorted_ = ws[order]
                starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
                sums = np.add.reduceat(ar[np.cumsum(np.append(False, ps[1:] != ps[:-1]))[order]], starts, axis=0)
                y[sorted_[starts]] += sums * w_idf[sorted_[starts]][:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, n * r + 1, r), pa.int32()), pa.array(y.ravel()))], names=["word", "y"])

    def add(t: pa.Table) -> pa.Table:
        word = np.asarray(t["word"])
        y = np.asarray(t["y"].combine_chunks().flatten()).reshape(-1, r)
        ids, at = np.unique(word, return_inverse=True)
        total = np.zeros((len(ids), r))
        np.add.at(total, at, y)
        return pa.table({"word": pa.array(ids, pa.int32()), "y": pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, r), pa.int32()), pa.array(total.ravel()))})

    parts = coded.mapInArrow(run, "word int, y array<double>").withColumn("block", F.floor(F.col("word") / 256)).groupBy("block")
    rows = parts.applyInArrow(lambda t: add(t.select(["word", "y"])), "word int, y array<double>").toArrow()
    y = np.zeros((n, r))
    if rows.num_rows:
        y[np.asarray(rows["word"])] = np.asarray(rows["y"].combine_chunks().flatten()).reshape(-1, r)
    # Nystroem: A'A ~ Y (R'Y)^-1 Y'
    core = probe.astype(np.float64).T @ y
    core = (core + core.T) / 2
    val, vec = np.linalg.eigh(core)
    good = val > 1e-9 * max(val.max(), 1e-30) if len(val) else np.zeros(0, bool)
    if not good.any():
        return np.zeros((n, 1), np.float32)
    u, _, _ = np.linalg.svd((y @ vec[:, good]) / np.sqrt(val[good]), full_matrices=False)
    return u[:, :rank].astype(np.float32)


def chain(doc: list[int], spots: list[int], item: list[int], places: dict[int, list[tuple[int, int]]], telling: list[float]) -> tuple[int, int, float, float, int]:
    """The best chain of the item's own words that document and item have in order.

    ``spots``: the places of the item's own words in the document, rising; ``places``: for each own word
    its positions in the item, with their rank among its own words.
    Neighbours in a chain lie within ``GAP`` words of the document more than of the item, but for one
    interruption, however long. Returns the common words in order over the chain's spans,
    of all words; the number of own words in the chain, their weight, the weight of all own words in the
    item's span; and that span's length.
    """
    pairs = [(p, q, r, telling[doc[p]]) for p in spots for q, r in places[doc[p]]]
    n = len(pairs)
    # no chain weighs more than all its words
    if n < OWN_WORDS or sum(telling[doc[p]] for p in spots) < LEAST_WEIGHT:
        return 0, 0, 0.0, 1.0, 0
    plain, cut = [0.0] * n, [-1.0] * n  # without and with the interruption
    back: list[tuple[tuple[int, int] | None, tuple[int, int] | None]] = [(None, None)] * n
    # by rank, five places up: what lies before, the best of those without an interruption, the place in the item
    ranks = 6 + max(r for _, _, r, _ in pairs)
    near: list[list[int]] = [[] for _ in range(ranks)]
    ended = [-1] * ranks
    spot = [0] * ranks
    for _, q, r, _ in pairs:
        spot[r + 5] = q
    before = 0
    for k, (p, q, r, w) in enumerate(pairs):
        while pairs[before][0] < p:
            rb = pairs[before][2] + 5
            near[rb].append(before)
            if ended[rb] < 0 or plain[before] > plain[ended[rb]]:
                ended[rb] = before
            before += 1
        b0, b1, f0, f1 = w, -1.0, None, None
        for dr in (1, 2, 3, 4, 5):
            js = near[r + 5 - dr]
            if not js:
                continue
            over = q - spot[r + 5 - dr]
            if over > 2 * GAP:
                break
            gain = w - 0.25 * (dr - 1)
            reach = p - GAP - over
            for j in reversed(js):
                if pairs[j][0] < reach:
                    break
                if plain[j] + gain > b0:
                    b0, f0 = plain[j] + gain, (j, 0)
                if cut[j] >= 0 and cut[j] + gain > b1:
                    b1, f1 = cut[j] + gain, (j, 1)
            if dr <= 2:
                j = ended[r + 5 - dr]
                if plain[j] + gain - 0.4 > b1:
                    b1, f1 = plain[j] + gain - 0.4, (j, 0)
        plain[k], cut[k] = b0, b1
        back[k] = f0, f1
    k, c = plain.index(max(plain)), 0
    if max(cut) > plain[k]:
        k, c = cut.index(max(cut)), 1
    p1, q1, r1, _ = pairs[k]
    hits, total = 0, 0.0
    cuts = []
    while True:
        p, q, r, w = pairs[k]
        hits += 1
        total += w
        step = back[k][c]
        if step is None:
            break
        if step[1] != c:  # the interruption: the document is read up to it and after it
            cuts.append((pairs[step[0]][0], p))
        k, c = step
    if hits < OWN_WORDS:
        return 0, 0, 0.0, 1.0, 0
    a, z = max(0, q - 3), min(len(item), q1 + 4)
    lo, hi = max(0, p - 4), p1 + 5
    text = doc[lo:hi] if not cuts else doc[lo : cuts[0][0] + 4] + doc[max(cuts[0][1] - 3, cuts[0][0] + 4) : hi]
    whole = sum(telling[x] for x, at in places.items() for i, _ in at if q <= i <= q1)
    return common(text, item[a:z]), hits, total, whole, q1 + 1 - q


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine word's worth of ``b`` at a time."""
    where: dict[int, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


# AROUND: how far evidence is first read together; what has no passage there is read as a whole text
GAP, AROUND = 9, 120


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", cosine: float = COSINE) -> DataFrame:
    """``doc_id, item_id, words``: documents with a passage of an item, and how many words of it."""
    known = items.where(F.col(item).isNotNull()).select(item, "text", "answer").distinct()
    # blanks part words, and a text has a word at least for every few characters that have none
    sizes = known.agg(F.sum(F.length(F.concat_ws(" ", "text", "answer")) / 5)).collect()[0][0] or 0
    parts = max(1, -(-int(sizes) // MOST_ITEM_WORDS))
    out = None
    for n in range(parts):
        got = _leaks(docs, known.where(F.pmod(F.xxhash64(item), F.lit(parts)) == n), key, text, item, cosine)
        out = got if out is None else out.unionByName(got)
    return out


def _leaks(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, cosine: float) -> DataFrame:
    spark = docs.sparkSession
    side = Items([(r[0], r[1], r[2]) for r in items.orderBy(item).collect()])
    n = len(side.vocabulary)
    out_ddl = f"{key} bigint, {item} bigint, words int"
    if not n:
        return spark.createDataFrame([], out_ddl)
    coded = stage(coded_documents(docs, side.vocabulary, key, text), "words")
    df, total = document_frequency(coded, n)
    # words in more than a third of all documents tell nothing about a passage
    idf = np.where(df > COMMON * max(total, 1), 0.0, np.log((1 + total) / (1 + df)))
    idf = (idf / max(idf.max(), 1e-9)).astype(np.float32)
    basis = singular_vectors(coded, idf)
    latent = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)
    passages = side.passages()
    rows, mass, own = [], [], []
    for s, a, b in passages:
        c = side.coded[s][1][a:b]
        rows.append(latent[c].sum(axis=0))
        own.append(int(side.own[s][a:b].sum()))
        mass.append(float(idf[c].sum()))
    p = np.array(rows, np.float32)
    norm = np.linalg.norm(p, axis=1)
    use = norm > 1e-6
    p = (p[use] / norm[use][:, None]).astype(np.float32)
    seq = np.array([x[0] for x in passages], np.int32)[use]
    needs = np.array(own)[use]
    # a window that holds a passage holds most of its weight, so lighter windows are not projected
    least_mass = 0.5 * float(np.min(np.array(mass)[use])) if use.any() else 0.0
    shared = spark.sparkContext.broadcast((latent, idf, p, seq, needs, side.coded, least_mass, side.own, side.rare, side.telling.tolist(), side.runs))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, w_idf, pas, owner, needs, seqs, least, owned, is_rare, telling, runs = shared.value
        weight = np.append(w_idf, 0).astype(np.float32)
        where: dict[int, dict[int, list[tuple[int, int]]]] = {}
        items_as_lists = [c.tolist() for _, c in seqs]
        mine = np.zeros((len(seqs), len(w_idf) + 1), bool)
        for t, ((_, c), o) in enumerate(zip(seqs, owned, strict=True)):
            mine[t, c[o]] = True
        for b in batches:
            w, off = _batch(b)
            keys = b.column(0).to_pylist()
            found: dict[tuple[int, int], int] = {}
            if len(w):
                for d, t, place in own_runs(w, off, runs, len(w_idf)):
                    found[d, t] = found.get((d, t), 0) | 1 << place // STEP
                run = np.concatenate([[0], np.cumsum(weight[w], dtype=np.float64)])
                rares = np.concatenate([[0], np.cumsum(np.append(is_rare, False)[w])])
                sizes = np.diff(off)
                count = np.maximum(1, -(-(sizes - SPAN) // STEP) + 1)
                doc = np.repeat(np.arange(len(sizes)), count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = off[doc] + nth * STEP
                stop = np.minimum(start + SPAN, off[doc + 1])
                # a candidate needs RARE different words of one item, so a window with fewer is none
                heavy = np.flatnonzero((run[stop] - run[start] >= least) & (rares[stop] - rares[start] >= RARE))
                block = max(64, min(4096, (1 << 24) // max(1, len(pas))))
                for at in range(0, len(heavy), block):
                    h = heavy[at : at + block]
                    # the words of the windows, side by side; a window cut off by its text's end is filled with none
                    grid = start[h][:, None] + np.arange(SPAN)
                    wid = np.where(grid < stop[h][:, None], w[np.minimum(grid, len(w) - 1)], -1)
                    x = lat[wid].sum(axis=1)
                    length = np.linalg.norm(x, axis=1)
                    x /= np.where(length > 1e-9, length, 1)[:, None]
                    near = x @ pas.T
                    r, c = np.nonzero(near >= cosine)
                    # the passage's own words that the window holds, for all candidates at once
                    held = mine[owner[c][:, None], wid[r]].sum(axis=1)
                    ok = held >= np.maximum(RARE, PART * needs[c])
                    r, s = r[ok], owner[c[ok]]
                    for d, t, i in set(zip(doc[h[r]].tolist(), s.tolist(), nth[h[r]].tolist(), strict=True)):
                        found[d, t] = found.get((d, t), 0) | 1 << i
            out_k, out_i, out_n = [], [], []
            for (d, s), bits in found.items():
                if s not in where:
                    m: dict[int, list[tuple[int, int]]] = {}
                    rank = 0
                    for q, x in enumerate(seqs[s][1].tolist()):
                        if owned[s][q]:
                            m.setdefault(x, []).append((q, rank))
                            rank += 1
                    where[s] = m
                item_words = items_as_lists[s]
                hits = [i for i in range(bits.bit_length()) if bits >> i & 1]
                size = int(off[d + 1] - off[d])
                parts, a = [], 0
                while a < len(hits):
                    z = a
                    while z + 1 < len(hits) and (hits[z + 1] - hits[z]) * STEP <= AROUND + SPAN:
                        z += 1
                    parts.append((max(0, hits[a] * STEP - AROUND - SPAN), min(size, hits[z] * STEP + 2 * SPAN + AROUND)))
                    a = z + 1
                if parts[0] != (0, size):
                    parts.append((0, size))
                for lo, hi in parts:
                    part = w[off[d] + lo : off[d] + hi]
                    got = chain(part.tolist(), np.flatnonzero(mine[s][part]).tolist(), item_words, where[s], telling)
                    if leaked(*got):
                        out_k.append(keys[d])
                        out_i.append(seqs[s][0])
                        out_n.append(got[0])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_k, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_n, pa.int32())], names=[key, item, "words"])

    return coded.mapInArrow(look, out_ddl).groupBy(key, item).agg(F.max("words").alias("words"))


def leaked(count: int, own: int, total: float, whole: float, span: int) -> bool:
    """The answer check: enough words, dense in the item's span, and the item's own words among them."""
    return count >= LEAST and span >= 8 and count >= DENSE * span and own >= OWN_WORDS and total >= max(LEAST_WEIGHT, OWN * whole)
