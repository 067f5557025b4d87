"""Long exact spans shared between texts: FM-index per shard, fed by a sampling of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.llm.fmindex import FMIndex
from contactloom.runtime import Scratch, hot_limit, join_unique

#: Multipliers of the rolling hashes (odd), and fingerprints that one shard's index is meant to hold.
BASES, SHARD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), 3000
#: Documents of a class that are paired in one place.
BLOCK = 1000
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get(base, ((),))[0]) <= n:
        steps = np.full((2, max(1 << 18, 2 * n)), base, np.uint64)
        steps[1] = pow(base, -1, 1 << 64)
        steps[:, 0] = 1
        _powers[base] = tuple(np.multiply.accumulate(steps, axis=1))
    return _powers[base]


def gram_hashes(codes: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each run of k symbols, the same wherever the run stands."""
    up, down = _power_tables(len(codes), base)
    n = len(codes)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[:n], dtype=np.uint64)))
    h = (sums[k:] - sums[:-k]) * up[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places whose hashes are least in some window of w places, such that every window holds a
    chosen place with its least hash. Of equal hashes closer than w only as many are kept as that needs."""
    m = len(h)
    if m < w:
        return np.empty(0, np.int64)
    padded = np.concatenate((h, np.full(-m % w, np.uint64(2**64 - 1)))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - w + 1], ahead[w - 1 : m])
    values = np.unique(least)
    places = np.nonzero(np.isin(h, values))[0] if len(values) < 64 else np.nonzero(values[np.searchsorted(values, h).clip(max=len(values) - 1)] == h)[0]
    if len(places) == len(values):
        return places
    keep = []
    by = places[np.argsort(h[places], kind="stable")]
    cuts = np.nonzero(h[by][1:] != h[by][:-1])[0] + 1
    for same in np.split(by, cuts):
        i, last = 0, len(same) - 1
        while True:
            keep.append(same[i])
            if i == last:
                break
            i = max(i + 1, int(np.searchsorted(same, same[i] + w, "right")) - 1)
    return np.sort(np.array(keep, np.int64))


def _fingerprints(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, doc, pos = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = code_points(text)
                if len(codes) < k + w - 1:
                    continue
                h = gram_hashes(codes, k)
                at = winnow(h, w)
                f.append(h[at].view(np.int64))
                doc.append(np.full(len(at), d, np.int64))
                pos.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (f, doc, pos)], names=["f", "doc", "pos"])

    return run


def _segments(length: int, k: int):
    """Texts cut to what lies around shared fingerprints: (shard, doc, start, segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                by: dict[int, list[int]] = {}
                for x in wanted:
                    by.setdefault(x["shard"], []).append(x["pos"])
                for shard, places in by.items():
                    start = end = -1
                    for p in [*sorted(places), None]:
                        lo = None if p is None else max(0, p - (length - k))
                        if lo is None or lo > end:
                            if end > start:
                                rows.append((shard, doc, start, text[start:end]))
                            if lo is None:
                                break
                            start = lo
                        end = min(len(text), p + length)
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "doc", "start", "segment"])

    return run


def _windows(length: int, k: int):
    """(h1, h2, doc, start): two hashes of each run of length symbols around the wanted fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codes = code_points(text)
                last = len(codes) - length
                at = np.unique(np.array(wanted)[:, None] + np.arange(k - length, 1)[None, :])
                at = at[(at >= 0) & (at <= last)]
                h = [gram_hashes(codes, length, b)[at].view(np.int64) for b in BASES] if len(at) else [at, at]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*h, np.full(len(at), doc), at)], names=["h1", "h2", "doc", "start"])

    return run


def _stretches(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of length symbols as stretches (doc, start, end), those that touch being one."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
    last = np.append(new[1:], True)[: len(new)]
    return doc[new], start[new], start[last] + length


def _index(shard: pa.Table, length: int) -> tuple[FMIndex, np.ndarray, np.ndarray]:
    texts = [code_points(s) for s in shard["segment"].to_pylist()]
    alphabet = np.unique(np.concatenate(texts))
    docs = shard["doc"].to_numpy()
    return FMIndex([np.searchsorted(alphabet, t) + 1 for t in texts], docs, length), docs, shard["start"].to_numpy()


def shared_stretches(shard: pa.Table, length: int) -> pa.Table:
    """(doc, start, end): the stretches of the shard's segments in which every run of length symbols
    stands in another document's segment too. All segments are streamed backwards through the index;
    where the matching statistic reaches length, a run begins."""
    index, docs, starts = _index(shard, length)
    places, _ = index.matches()
    segment = np.searchsorted(index.starts, places, "right") - 1
    doc, start, end = _stretches(docs[segment], starts[segment] + places - index.starts[segment], length)
    return pa.table({"doc": doc, "start": start, "end": end})


def shared_pairs(shard: pa.Table, length: int) -> pa.Table:
    """(doc_1, doc_2): documents whose segments have a run of length symbols in common. A place whose
    matching statistic reaches length names a class of documents, all those that its range in the
    index has; equal classes are one before any pair is made."""
    index, _, _ = _index(shard, length)
    _, ranges = index.matches()
    first = np.unique(ranges)
    last = index.classes(length)[1][first]
    of = np.repeat(np.arange(len(first)), last - first)
    within = np.arange(len(of)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
    doc = index.owner[first[of] + within]
    order = np.lexsort((doc, of))
    of, doc = of[order], doc[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])
    of, doc = of[new], doc[new]
    classes = {tuple(c.tolist()) for c in np.split(doc, np.nonzero(np.diff(of))[0] + 1)} if len(doc) else set()
    pairs = {(x, y) for c in classes for i, x in enumerate(c) for y in c[i + 1 :]}
    a, b = zip(*sorted(pairs)) if pairs else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_1", "doc_2"])


class SharedSpans:
    """Runs of at least length code points that two documents have in common.

    Every text is read whole. Fingerprints of length/2 symbols are sampled so that any run of length
    symbols holds one that its other copies have sampled too; a text's parts without a fingerprint
    met in another document cannot hold a shared run and go no further. Fingerprints met in several
    documents send what surrounds them (as far as a run over them may reach) to a shard named by the
    least document that has them, so overlapping surroundings meet in one shard and are merged; those
    of a document that leads more than a shard holds are spread by fingerprint. The segments of a shard
    form one FM-index, and each is streamed through it (FMIndex.matches), which tells where a run of
    length symbols begins that another document has. So a text's shared stretches come out once,
    whatever the number of its copies, and no pair of documents is made for them.

    A fingerprint of more places than a shard holds (a notice in a large share of all texts) goes to no
    index. Each run around its places is told by two hashes of 64 bits, which are grouped with partial
    sums: a run of several documents is one class, its members staying where they are.

    Null texts and ids, and texts shorter than length, share nothing. Runs within one document don't
    count; repeated rows of a document are one document."""

    def __init__(
        self, documents: DataFrame, length: int = 400, doc: str = "doc_id", text: str = "text", id_limit: int = 2_000_000, shard: int = SHARD,
    ):
        spark = documents.sparkSession
        self.scratch = scratch = Scratch(spark, "spans")
        self.length, self.k = length, length // 2
        self.documents, self.doc, self.text, self.id_limit = documents, doc, text, id_limit
        self.texts = documents.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).dropna()
        w = length - self.k + 1
        prints = scratch.write(
            self.texts.filter(F.length("text") >= length).mapInArrow(_fingerprints(self.k, w), "f long, doc long, pos int")
        )
        groups = prints.groupBy("f").agg(F.min("doc").alias("leader"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n"))
        groups = scratch.write(groups.filter("leader < most").drop("most"))
        limit = hot_limit(prints.count())
        hot = groups.filter(F.col("n") > limit).select("f")
        shared = scratch.write(join_unique(prints, groups, ["f"], hot=hot))
        scratch.drop(prints, groups)
        few, self.many = shared.filter(F.col("n") <= shard), shared.filter(F.col("n") > shard)
        n = few.count()
        shards = max(1, n // shard, min(spark.sparkContext.defaultParallelism, n // 500))
        # a shard is little to shuffle and much to compute, so they are not joined to tasks by their bytes
        self.tasks = min(shards, max(2 * spark.sparkContext.defaultParallelism, shards // 32))
        large = scratch.write(few.groupBy("leader").agg(F.count(F.lit(1)).alias("places")).filter(F.col("places") > shard).select("leader"))
        # leaders of more than a shard's places are at most one in so many places
        spread = few.join(large.withColumn("large", F.lit(True)), "leader", "left")
        number = F.pmod(F.when(F.col("large"), F.xxhash64("f")).otherwise(F.xxhash64("leader")), F.lit(shards))
        wanted = spread.select("doc", F.struct(number.alias("shard"), "pos").alias("w"))
        self.wanted = scratch.write(wanted.groupBy("doc").agg(F.collect_set("w").alias("wanted")))  # a text's own places

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """(doc, text, wanted) of the documents in wanted; a repeated document's texts are taken as one row
        each."""
        ids = wanted.select("doc")
        texts = self.texts
        if ids.count() <= self.id_limit:
            texts = texts.join(F.broadcast(ids), "doc", "left_semi")
        return texts.join(wanted, "doc").select("doc", "text", "wanted")

    def _by_shard(self, kernel, schema: str) -> DataFrame:
        length, cut = self.length, _segments(self.length, self.k)
        segments = self._texts(self.wanted).mapInArrow(cut, "shard long, doc long, start long, segment string")
        segments = segments.repartition(self.tasks, "shard")
        return self.scratch.write(segments.groupBy("shard").applyInArrow(lambda t: kernel(t, length), schema))

    def _classes(self) -> tuple[DataFrame, DataFrame] | None:
        """Runs (h1, h2, doc, start) around the places of fingerprints too frequent for an index, and those
        (h1, h2) that several documents have; None if there are no such places."""
        if self.many.isEmpty():
            return None
        wanted = self.scratch.write(self.many.groupBy("doc").agg(F.collect_set("pos").alias("wanted")))
        windows = self._texts(wanted).mapInArrow(_windows(self.length, self.k), "h1 long, h2 long, doc long, start long")
        windows = self.scratch.write(windows.distinct())
        classes = windows.groupBy("h1", "h2").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n"))
        return windows, self.scratch.write(classes.filter("a < b").select("h1", "h2", "n"))

    def _members(self, windows: DataFrame, classes: DataFrame) -> DataFrame:
        hot = classes.filter(F.col("n") > hot_limit(windows.count())).select("h1", "h2")
        return join_unique(windows, classes.select("h1", "h2"), ["h1", "h2"], hot=hot)

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), smaller id first, once for each pair that shares a run. The rows are as
        many as such pairs; classes of the same documents are one before their documents are paired, in
        blocks."""
        out = self._by_shard(shared_pairs, "doc_1 long, doc_2 long").distinct()
        if found := self._classes():
            member = self.scratch.write(self._members(*found).select("h1", "h2", "doc").distinct())
            seeds = [F.sum(F.xxhash64("doc", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
            sets = member.groupBy("h1", "h2").agg(*seeds, F.count(F.lit(1)).alias("n"))
            one = sets.groupBy("s1", "s2", "n").agg(F.min(F.struct("h1", "h2")).alias("h")).select("h.*", F.ceil(F.col("n") / BLOCK).alias("blocks"))
            one = self.scratch.write(one)
            hot = one.filter(F.col("blocks") > 1).select("h1", "h2") if one.count() <= 512 else None
            placed = join_unique(member, one, ["h1", "h2"], hot=hot).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
            each = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
            key = ["h1", "h2", "i", "j"]
            a = placed.select("h1", "h2", F.col("doc").alias("x"), F.col("own").alias("i"), F.explode(each).alias("j"))
            b = placed.select("h1", "h2", F.col("doc").alias("y"), F.explode(each).alias("i"), F.col("own").alias("j"))
            out = out.unionByName(a.join(b, key).filter("x < y").select(F.col("x").alias("doc_1"), F.col("y").alias("doc_2"))).distinct()
        return out.select(F.col("doc_1").alias("doc_id_a"), F.col("doc_2").alias("doc_id_b"))

    def spans(self) -> DataFrame:
        """(doc_id, start, end): the stretches of a document that stand in other documents too, in
        code points, first inclusive, last exclusive, touching ones merged."""
        each = self._by_shard(shared_stretches, "doc long, start long, end long")
        if found := self._classes():
            more = self._members(*found).select("doc", "start", (F.col("start") + self.length).alias("end"))
            each = each.unionByName(more)
        w = W.partitionBy("doc").orderBy("start", "end")  # of one text's stretches
        reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
        marked = each.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
        return (
            marked.withColumn("k", F.sum("new").over(w))
            .groupBy(F.col("doc").alias("doc_id"), "k")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .drop("k")
        )

    def coverage(self) -> DataFrame:
        """(doc_id, n_spans, shared_chars, share) for every document; a document that shares nothing
        has zeros, an empty or null text a share of 0."""
        per = self.spans().groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars")
        )
        sizes = self.documents.select(F.col(self.doc).alias("doc_id"), F.coalesce(F.length(self.text), F.lit(0)).alias("n"))
        zero = F.lit(0).cast("long")
        out = sizes.join(per, "doc_id", "left").withColumns(
            {"n_spans": F.coalesce("n_spans", zero), "shared_chars": F.coalesce("shared_chars", zero)}
        )
        return out.select("doc_id", "n_spans", "shared_chars", F.when(F.col("n") > 0, F.col("shared_chars") / F.col("n")).otherwise(0.0).alias("share"))
