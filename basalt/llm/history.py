"""Deduplicating new batches of facts against all history.

Method. An incremental inverted index of rare-token prefixes, partitioned by token. A fact is split into
symbols, numbers, whether it is taken back, and words. Words that only carry the wording are set apart
by statistics of the corpus (``wording``): those in more than a twentieth of all texts, those that keep
to the edges of a text, and those that come with the same companions (a word of a phrase drags the rest of
the phrase along, a name stands beside any word). All other words, unknown ones too, are content.
Two facts say the same if symbols and numbers agree, the content words agree but for misspellings, and
neither takes back what the other says. Content words have a fixed order, rarest first (by the frequency
they had when the index first met them), so two facts of which at most ``MISSES`` words differ share one
of their first ``MISSES + 1`` words. A batch probes the postings with its own prefixes, filters by
length, verifies the overlap of the contents (vectors decide where the words leave it open) and
appends the postings of what it accepts.

History is not read again. Every batch is a folder of postings sorted by token; a probe hands the ranges of its tokens
to the scan, and the page index of the files leaves out every page that holds none of them. Vectors
are fetched the same way, by class, for undecided pairs only. A batch of more than ``PROBES`` tokens (a
bulk load) joins with the postings instead. The word statistics are additive: a batch merges its own
counts with those of the batch before, and never sees a later one.

An index lives in its folder. Another session opens it by the path and goes on; a batch's folder counts
only when it is listed as done, so a batch that failed or is written again leaves no double rows.

Facts are compared with accepted ones only, in the order of (time, id), within a batch as well: what
repeats a rejected fact alone is accepted. So the cutting into batches changes nothing but the
statistics a fact is judged by. Copies (one bag of words) are one class and meet in a map-side
combined aggregation, never in a join, so a third of all rows being copies costs one posting.

Defined results: NULL or blank content, NULL group, id or time makes no case and no posting;
repeated rows of one id count once; equal times go by id; NULL, all-zero or foreign vectors decide
nothing. An empty batch leaves the index as it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions import vectors
from basalt.session import fresh_path, stage

MISSES = 2
#: the cosines from which a pair that the words leave open is taken for the same: two misspellings, a word more
CLOSE, NEAR = 0.95, 0.9
#: a word is wording if it is in this share of all texts (and in 50), if this share of its places is at an
#: edge (of 8), or if it has two companions in this share of its texts, three times as often as elsewhere, in texts
#: about at least 6 things (a fact that is told in many variants is one thing)
COMMON, EDGE, FIXED, LIFT = 0.05, 0.95, 0.2, 3
#: how many words apart companions may be
REACH = 5
#: a word known from fewer texts than this may be a rare way to say it
RARE = 20
#: most tokens that a probe hands to the scan, most words that are broadcast; beyond, joins take their place
PROBES, BROADCAST_WORDS = 4096, 200_000
DAY = 86_400_000

TOKEN = re.compile(r"(?P<symbol>[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Za-z0-9]+(?:_+[A-Za-z0-9]+)+)|(?P<word>[^\W\d_]+)|(?P<number>\d+(?:[.,]\d+)*)")
# A lexicon of English, French, German and Spanish: how a statement is taken back, and words of negation.
RETRACTED = re.compile(
    r"(?i)\brevert(ed)?\b|no longer (true|valid|the case|holds|applies)|wrong assumption|\bnot (the case|true|valid|so)\b|\b(is|was) (false|wrong|untrue)\b|"
    r"\bfalse:|\bretract|\bwithdrawn\b|does not hold|doesn't hold|\bincorrect\b|n'est plus (vrai|valable|valide)|plus valable|\bfaux\b|nicht mehr|stimmt nicht|ya no es"
)
NEGATIONS = frozenset("not no never none nor neither cannot without t ne pas jamais aucun nicht kein keine nie nunca ningun ninguna".split())

FEATURES = "id string, group_id string, at bigint, sym string, nums array<string>, taken_back boolean, seq array<string>, form bigint, emb array<float>, emb_model string"
CLASS = "cid bigint, group_id string, first struct<at: bigint, id: string>, named boolean, names array<string>, rare array<boolean>, others array<string>"
POSTING = CLASS + ", token bigint"
VECTOR = "cid bigint, emb array<float>, emb_model string"
WORDS = "word string, df bigint, edge bigint, born int, df0 bigint, wording boolean"
PAIRS = "word string, other string, n bigint, seen bigint"


def features(content: str) -> tuple[str, list[str], bool, list[str]]:
    """Symbols, numbers, taken back, and the words in their order ('' stands for a symbol or number)."""
    symbols, nums, seq = set(), set(), []
    for m in TOKEN.finditer(content):
        w = m.group(0)
        if m.lastgroup == "word":
            seq.append(w.lower())
        else:
            (symbols if m.lastgroup == "symbol" else nums).add(w.lower())
            seq.append("")
    return " ".join(sorted(symbols)), sorted(nums), bool(RETRACTED.search(content)), seq


def featurise(facts: DataFrame) -> DataFrame:
    """One row per fact that can make a case; repeated ids once. ``form`` is a hash of its bag of words."""
    slim = facts.where(F.col("content").isNotNull() & F.col("group_id").isNotNull() & F.col("created_at").isNotNull() & F.col("id").isNotNull()).select(
        "id", "group_id", "created_at", "content", F.col("emb").cast("array<float>").alias("emb"), F.col("emb_model").cast("string").alias("emb_model")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rows = [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                if t.strip():
                    keep.append(i)
                    rows.append(features(t))
            t = b.take(pa.array(keep, pa.int64()))
            sym, nums, back, seq = zip(*rows, strict=True) if rows else ((),) * 4
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    t.column(0).cast(pa.string()), t.column(1).cast(pa.string()), t.column(2).cast(pa.int64()),
                    pa.array(sym, pa.string()), pa.array(nums, strings), pa.array(back, pa.bool_()), pa.array(seq, strings), t.column(4), t.column(5),
                ],
                names=["id", "group_id", "at", "sym", "nums", "taken_back", "seq", "emb", "emb_model"],
            )

    found = slim.mapInArrow(run, FEATURES.replace(" form bigint,", "")).dropDuplicates(["id"])
    return found.withColumn("form", F.xxhash64("sym", "nums", "taken_back", F.array_sort(F.array_distinct("seq")))).select(*(x.split()[0] for x in FEATURES.split(", ")))


def counted(feats: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``word, df, edge`` and ``word, other, n, seen``: in how many texts (each bag of words once) a word stands, in
    how many at an edge only, and in how many with another within ``REACH``; ``seen`` has a bit for each of 64
    classes of what these texts are about. Partial counts
    leave a task. The third is the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()  # '' stands for the texts themselves
        edge: Counter = Counter()
        pairs: Counter = Counter()
        bits: dict[tuple[str, str], int] = {}

        def out() -> pa.RecordBatch:
            w = list(df)
            rows = [(x, "", df[x], edge[x], 0) for x in w] + [(*p, n, 0, bits[p] - (bits[p] >> 63 << 64)) for p, n in pairs.items()]
            a, b, n, e, m = zip(*rows, strict=True) if rows else ((),) * 5
            i = pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, i), pa.array(e, i), pa.array(m, i)], names=["word", "other", "n", "edge", "seen"])

        for b in batches:
            for seq, about in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, inner, near = len(seq), set(), set()
                for i, w in enumerate(seq):
                    if w:
                        if 2 <= i < n - 2:
                            inner.add(w)
                        near.update((w, x) for x in seq[max(0, i - REACH) : i + REACH + 1] if x and x != w)
                words = {w for w in seq if w}
                df.update(words)
                df[""] += 1
                edge.update(words - inner)
                pairs.update(near)
                for x in near:
                    bits[x] = bits.get(x, 0) | 1 << about
            if len(pairs) > 500_000:
                yield out()
                df.clear(), edge.clear(), pairs.clear(), bits.clear()
        yield out()

    about = F.pmod(F.when(F.col("sym") == "", F.xxhash64("form")).otherwise(F.xxhash64("sym")), F.lit(64))
    distinct = feats.groupBy("form").agg(F.first("seq").alias("seq"), F.first(about).alias("about")).select("seq", "about")
    rows = distinct.mapInArrow(run, "word string, other string, n bigint, edge bigint, seen bigint").groupBy("word", "other").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"), F.bit_or("seen").alias("seen"))
    rows = stage(rows, "counts")
    texts = rows.where("word = '' and other = ''").agg(F.sum("n")).collect()[0][0] or 0
    return rows.where("other = '' and word <> ''").select("word", F.col("n").alias("df"), "edge"), rows.where("other <> ''").select("word", "other", "n", "seen"), texts


def wording(words: DataFrame, pairs: DataFrame, total: int) -> DataFrame:
    """Adds ``wording`` to ``words``."""
    often = pairs.where(F.bit_count("seen") >= 6).join(words.select("word", "df"), "word").where(F.col("n") >= FIXED * F.col("df"))
    base = words.select(F.col("word").alias("other"), F.col("df").alias("df_other"))
    tied = often.join(base, "other").where(F.col("n") * total >= LIFT * F.col("df") * F.col("df_other")).groupBy("word").agg((F.count("*") >= 2).alias("tied"))
    flag = ((F.col("df") >= 50) & (F.col("df") > COMMON * total)) | ((F.col("df") >= 8) & (F.col("edge") >= EDGE * F.col("df"))) | F.coalesce("tied", F.lit(False))
    flagged = stage(words.join(tied, "word", "left").withColumn("wording", flag).drop("tied"), "flagged")
    # a rare word one letter from a usual word of the wording is that word misspelt
    usual = flagged.where(F.col("wording") & (F.col("df") >= RARE) & (F.length("word") >= 4)).select(F.explode(_shorter(F.col("word"))).alias("form"))
    seldom = flagged.where(~F.col("wording") & (F.col("df") < 5) & (F.length("word") >= 4)).select("word", F.explode(_shorter(F.col("word"))).alias("form"))
    slips = seldom.join(usual.distinct(), "form", "left_semi").select("word").distinct().withColumn("slip", F.lit(True))
    return flagged.join(slips, "word", "left").withColumn("wording", F.col("wording") | F.coalesce("slip", F.lit(False))).drop("slip")


def _shorter(w):
    """A word and its forms with one letter left out: words one letter apart share one."""
    return F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))


def split_words(feats: DataFrame, words: DataFrame, batch: int) -> DataFrame:
    """Adds ``names`` (content words in the fixed order, rarest first), ``rare`` (whether each is known from
    few texts) and ``others``. A word that the statistics do not hold is new, so it comes first.
    A text of nothing but wording is taken as content."""
    spark = feats.sparkSession
    known = words.where("df >= 2 or wording")
    if known.count() <= BROADCAST_WORDS:
        shared = spark.sparkContext.broadcast({r["word"]: (-r["born"], r["df0"], r["df"], r["wording"]) for r in known.toLocalIterator()})
        strings = T.ArrayType(T.StringType())
        schema = T.StructType([*feats.schema.fields, T.StructField("names", strings), T.StructField("rare", T.ArrayType(T.BooleanType())), T.StructField("others", strings)])
        at = feats.columns.index("seq")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, new = shared.value, (-batch, 1, 1, False)
            for b in batches:
                names, rare, others = [], [], []
                for seq in b.column(at).to_pylist():
                    ws = {w for w in seq if w}
                    content = [w for w in ws if not v.get(w, new)[3]] or ws
                    content = sorted(content, key=lambda w: (*v.get(w, new)[:2], w))
                    names.append(content)
                    rare.append([v.get(w, new)[2] < RARE for w in content])
                    others.append(sorted(ws.difference(content)))
                s = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, s), pa.array(rare, pa.list_(pa.bool_())), pa.array(others, s)], names=[*b.schema.names, "names", "rare", "others"])

        return feats.mapInArrow(run, schema)
    # salted, as a common word may be in a third of all facts
    salt = 16
    tokens = feats.select("cid", F.explode_outer(F.array_distinct("seq")).alias("word"), F.pmod("cid", F.lit(salt)).alias("salt"))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    order = F.struct(-F.coalesce("born", F.lit(batch)), F.coalesce("df0", F.lit(1)), "word", (F.coalesce("df", F.lit(1)) < RARE).alias("rare"), F.coalesce("wording", F.lit(False)).alias("wording"))
    marked = tokens.join(spread, ["word", "salt"], "left").groupBy("cid").agg(F.array_sort(F.collect_list(F.when(F.col("word") != "", order))).alias("w"))
    content = F.filter("w", lambda x: ~x["wording"])
    chosen = F.when(F.size(content) > 0, content).otherwise(F.col("w"))
    marked = marked.select(
        "cid", chosen["word"].alias("names"), chosen["rare"].alias("rare"), F.array_except(F.array_sort(F.col("w.word")), chosen["word"]).alias("others")
    )
    return feats.join(marked, "cid")


def _postings(classes: DataFrame) -> DataFrame:
    """One row per probe token: what must agree exactly, with one of the rarest content words. The single
    word of a class that has no other may be misspelt, so its forms with one letter left out are tokens."""
    keys = F.when(F.size("names") > 1, F.slice("names", 1, MISSES + 1)).when(F.size("names") == 1, _shorter(F.col("names")[0])).otherwise(F.array(F.lit("")))
    out = classes.withColumn("key", F.explode(keys)).withColumn("token", F.xxhash64("group_id", "exact", "key"))
    return out.select("cid", "group_id", "first", "named", "names", "rare", "others", "token")


def _near(a: str, b: str) -> bool:
    """One insertion, deletion, change or swap apart."""
    if a == b or abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


SURE = -1.0


def agree(names: list[str], rare: list[bool], others: list[str], names2: list[str], rare2: list[bool], others2: list[str], named: bool) -> float | None:
    """Whether two facts of the same symbols and numbers say the same: ``SURE``, or the cosine that their
    vectors must have, or None."""
    a, b = set(names) - set(names2), set(names2) - set(names)
    # a content word may be wording by the statistics of another batch
    a, b = a - set(others2), b - set(others)
    left, right = set(others) - set(others2) - set(names2), set(others2) - set(others) - set(names)
    if not a and not b:
        if (left or right) and left | right <= NEGATIONS:
            return None
        # other words about the same named thing, or about nothing named
        return SURE if named or not left and not right else CLOSE
    if len(a) > MISSES or len(b) > MISSES:
        return None
    if all(any(_near(w, x) for x in b | right) for w in a) and all(any(_near(w, x) for x in a | left) for w in b):
        return SURE if max(len(a), len(b)) == 1 and (named or not left or not right or len(names) > MISSES) else CLOSE
    unknown = dict(zip([*names, *names2], [*rare, *rare2], strict=True))
    if a and b or (a | b) & NEGATIONS:
        return None
    # one side has words more: a remark or a rare way to say it, if few texts use them, or another wording
    return NEAR if all(unknown[w] for w in a | b) else CLOSE if len(a | b) == 1 and left and right else None


class HistoryIndex:
    """The postings of all accepted facts, in a folder that every executor reaches. A path that holds an
    index already is opened and gone on with."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or fresh_path(spark, "history")).rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self) -> dict[int, int]:
        """The batches that were written whole, with their numbers of texts; a mark's name holds both."""
        path, fs = self._fs()
        at = path(f"{self.path}/done")
        marks = [s.getPath().getName().split("-") for s in fs.listStatus(at)] if fs.exists(at) else []
        return {int(b): int(n) for b, n in sorted(marks)}

    def done(self) -> list[int]:
        """Numbers of the batches that were written whole."""
        return list(self._done())

    def _read(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/{name}/{b:08d}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: int, order: str) -> None:
        # small pages: a probe reads the pages that hold its tokens
        df.sortWithinPartitions(order).write.mode("overwrite").option("parquet.page.row.count.limit", 512).parquet(f"{self.path}/{name}/{batch:08d}")

    def _held(self, name: str, schema: str, batches: list[int], key: str, asked: DataFrame) -> DataFrame:
        """Rows of the history whose ``key`` is among ``asked``."""
        kept = self._read(name, schema, batches)
        wanted = asked.select(key).distinct()
        few = [r[0] for r in wanted.limit(PROBES + 1).collect()]
        if len(few) <= PROBES:
            return kept.where(_within(F.col(key), few)).where(F.col(key).isin(few))
        return kept.join(wanted, key, "left_semi")

    def _learn(self, feats: DataFrame, before: list[int], batch: int) -> tuple[DataFrame, int]:
        """Merges the batch's counts with those of the batch before; the words with their flags, and the batch's texts."""
        words, pairs, mine = counted(feats)
        last = before[-1:]
        old = self._read("words", WORDS, last)
        merged = old.select("word", "df", "edge", "born", "df0").unionByName(words.withColumn("born", F.lit(batch)).withColumn("df0", F.col("df")))
        merged = merged.groupBy("word").agg(F.sum("df").alias("df"), F.sum("edge").alias("edge"), F.min(F.struct("born", "df0")).alias("b")).select("word", "df", "edge", "b.born", "b.df0")
        both = self._read("pairs", PAIRS, last).unionByName(pairs).groupBy("word", "other").agg(F.sum("n").alias("n"), F.bit_or("seen").alias("seen"))
        both.write.mode("overwrite").parquet(f"{self.path}/pairs/{batch:08d}")
        texts = sum(n for b, n in self._done().items() if b in before) + mine
        wording(merged, self._read("pairs", PAIRS, [batch]), texts).select(*(x.split()[0] for x in WORDS.split(", "))).write.mode("overwrite").parquet(f"{self.path}/words/{batch:08d}")
        return self._read("words", WORDS, [batch]), mine

    def accept(self, feats: DataFrame, batch: int | None = None, stored: bool = False) -> DataFrame:
        """Checks a batch (rows of ``featurise``) against the history and itself; returns ``id, earlier_id`` of
        the facts to reject and appends the postings of the classes it accepts. ``batch`` numbers rise;
        a number that is given again takes the place of that batch, which must be the last. ``stored``: the
        rows are read from a table, so they need not be written before they are read several times."""
        before = [b for b in self.done() if batch is None or b < batch]
        batch = (before[-1] + 1 if before else 0) if batch is None else batch
        feats = feats if stored else stage(feats, "batch")
        if feats.isEmpty():
            return self.spark.createDataFrame([], "id string, earlier_id string")
        words, texts = self._learn(feats, before, batch)
        order = F.struct("at", "id")
        exact = F.concat_ws("\u0001", "sym", F.concat_ws(" ", "nums"), F.col("taken_back").cast("string"))
        cid = F.xxhash64("group_id", "form")
        # a class is settled before its words are split, so a copy is not split again
        classes = feats.groupBy("group_id", "form").agg(
            F.min(order).alias("first"), F.min_by(F.struct("sym", "nums", "taken_back", "seq"), order).alias("x"),
        ).select("group_id", "form", "first", "x.*").withColumn("exact", exact).withColumn("cid", cid).withColumn("named", F.col("sym") != "")
        classes = stage(split_words(classes, words, batch).drop("seq", "nums", "taken_back", "sym", "form"), "classes")
        mine = _postings(classes)
        known = self._held("postings", POSTING, before, "token", mine) if before else None
        p, h = mine.alias("p"), (mine if known is None else mine.withColumn("old", F.lit(False)).unionByName(known.withColumn("old", F.lit(True)))).alias("h")
        old = F.lit(False) if known is None else F.col("h.old")
        length = F.abs(F.size("p.names") - F.size("h.names")) <= MISSES
        pairs = p.join(h, (F.col("p.token") == F.col("h.token")) & (F.col("p.group_id") == F.col("h.group_id")) & (F.col("h.first") < F.col("p.first")) & length).select(
            F.col("p.cid").alias("cid"), F.col("h.cid").alias("other"), F.col("h.first").alias("seen"), old.alias("old"), F.col("p.named").alias("named"),
            *(F.col(f"{s}.{c}").alias(f"{c}{s}") for s in "ph" for c in ("names", "rare", "others")),
        )

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep, needs = [], []
                for i, seven in enumerate(zip(*(b.column(j).to_pylist() for j in range(5, 11)), b.column(4).to_pylist(), strict=True)):
                    least = agree(*seven)
                    if least is not None:
                        keep.append(i)
                        needs.append(least)
                t = b.select(["cid", "other", "seen", "old"]).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(needs, pa.float64())], names=[*t.schema.names, "needs"])

        near = stage(pairs.mapInArrow(verify, "cid bigint, other bigint, seen struct<at: bigint, id: string>, old boolean, needs double").distinct(), "near")
        open_ = near.where(F.col("needs") > SURE)
        agreed = near.where(F.col("needs") <= SURE)
        if not open_.isEmpty():
            # only undecided pairs ask for their vectors, so these are never in the postings
            mine_v = self._vectors(feats, classes.join(open_.select("cid").unionByName(open_.select(F.col("other").alias("cid"))).distinct(), "cid", "left_semi"))
            all_v = mine_v.unionByName(self._held("vectors", VECTOR, before, "cid", open_.where("old").select(F.col("other").alias("cid")))) if before else mine_v
            left = mine_v.select("cid", F.col("emb").alias("e1"), F.col("emb_model").alias("m1"))
            right = all_v.select(F.col("cid").alias("other"), F.col("emb").alias("e2"), F.col("emb_model").alias("m2"))
            close = open_.join(left, "cid").join(right, "other").where((F.col("m1") == F.col("m2")) & (vectors.cosine(F.col("e1"), F.col("e2")) >= F.col("needs")))
            agreed = stage(agreed.unionByName(close.select(*agreed.columns)), "agreed")
        found = self._settled(agreed)
        # every fact of a class but an accepted class's first repeats something
        best = classes.select("cid", "group_id", "first").join(found, "cid", "left").select("cid", F.coalesce("seen", "first").alias("seen"))
        out = feats.select("id", "at", cid.alias("cid")).join(best, "cid").where(F.struct("at", "id") > F.col("seen")).select("id", F.col("seen.id").alias("earlier_id"))
        out = stage(out, "rejects")
        fresh = stage(classes.join(found, "cid", "left_anti"), "fresh")
        self._write(_postings(fresh), "postings", batch, "token")
        self._write(self._vectors(feats, fresh), "vectors", batch, "cid")
        path, fs = self._fs()
        fs.delete(path(f"{self.path}/done/{batch:08d}-{self._done().get(batch, 0)}"), False)
        fs.create(path(f"{self.path}/done/{batch:08d}-{texts}"), True).close()
        return out

    @staticmethod
    def _vectors(feats: DataFrame, classes: DataFrame) -> DataFrame:
        """``cid, emb, emb_model``: the vectors of the classes' first facts."""
        return classes.select("cid", F.col("first.id").alias("id")).join(feats.where("emb is not null").select("id", "emb", "emb_model"), "id").select("cid", "emb", "emb_model")

    def _settled(self, edges: DataFrame) -> DataFrame:
        """``cid, seen``: the classes to reject, with the first accepted fact each repeats. A class is rejected
        if it meets an accepted one before it, in the order of time; history is accepted."""
        edges = edges.select("cid", "other", "seen", "old")
        gone = edges.where("old").select("cid").distinct()
        rest = edges.where("not old").join(gone, "cid", "left_anti")
        rejected = gone
        while not rest.isEmpty():
            # what has no open class before it is accepted; what meets such a class is rejected
            open_ = rest.select("cid").distinct()
            now = rest.join(rejected.select(F.col("cid").alias("other")), "other", "left_anti")
            sure = now.join(open_.select(F.col("cid").alias("other")), "other", "left_anti").select("cid").distinct()
            more = stage(sure, "rejected")
            if more.isEmpty():
                break
            rejected = rejected.unionByName(more)
            left = now.join(more, "cid", "left_anti")
            # edges that lead to rejected classes alone are dropped: their class is accepted
            rest = stage(left.join(more.select(F.col("cid").alias("other")), "other", "left_anti"), "open")
        # a class is paired with the earliest accepted one (history, where the same class may stand as well, is accepted)
        ok = edges.where("not old").join(rejected, "cid", "left_semi").join(rejected.select(F.col("cid").alias("other")), "other", "left_anti")
        ok = ok.select("cid", "seen").unionByName(edges.where("old").select("cid", "seen"))
        return stage(ok.groupBy("cid").agg(F.min("seen").alias("seen")), "found")


def _within(x: Column, values: list[int], most: int = 256) -> Column:
    """Whether ``x`` lies in one of at most ``most`` ranges around the values, cut at the widest gaps: a
    balanced tree of comparisons, which a scan can hold against the page index."""
    v = sorted(values)
    if not v:
        return F.lit(False)
    cuts = sorted(sorted(range(1, len(v)), key=lambda i: v[i - 1] - v[i])[: most - 1])
    terms = [x.between(v[a], v[z - 1]) for a, z in zip([0, *cuts], [*cuts, len(v)], strict=True)]
    while len(terms) > 1:
        terms = [terms[i] | terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def day_batches(feats: DataFrame, batches: int) -> list[tuple[int, int]]:
    """Ranges of UTC days [from, to) that hold about equally many facts."""
    days = feats.groupBy(F.floor(F.col("at") / DAY).cast("bigint").alias("day")).count().orderBy("day").collect()
    if not days:
        return []
    total, cuts, run = sum(r["count"] for r in days), [], 0
    for r in days:
        if not cuts or run >= total / batches:
            cuts.append(r["day"])
            run = 0
        run += r["count"]
    ends = [*cuts[1:], days[-1]["day"] + 1]
    return [(a * DAY, b * DAY) for a, b in zip(cuts, ends, strict=True)]


def rejects(facts: DataFrame, batches: int = 3, path: str | None = None) -> DataFrame:
    """Loads a table through an index, oldest days first: ``id, earlier_id``. Days are taken together in so
    many batches of whole days, each judged by the statistics up to its own end."""
    spark = facts.sparkSession
    feats = stage(featurise(facts), "features")
    index = HistoryIndex(spark, path)
    out = None
    for low, high in day_batches(feats, batches):
        got = index.accept(feats.where((F.col("at") >= low) & (F.col("at") < high)), stored=True)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "id string, earlier_id string")
