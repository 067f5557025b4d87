"""Held-out texts found in a corpus by a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.runtime import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """The longest runs of ASCII letters and digits, lower-cased; lower() is not used on the text, as
    it turns some other characters into ASCII letters."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(c, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))


#: Successive words by which a passage is looked up at most.
RUN = 4


class PositionalIndex:
    """Postings (term, doc, pos) of every document for the terms that the queries use, written once;
    with ahead also the words that follow, as many as ahead, whatever they are.

    items: the query texts, a bounded set whose distinct terms number vocabulary_limit at most; only
    then is the table of terms broadcast, else it is joined by a shuffle. Every row and the whole of
    every text is indexed. Null texts have no postings."""

    def __init__(
        self, documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text",
        vocabulary_limit: int = 100_000, ahead: int = 0,
    ):
        self.texts = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).dropna()
        self.ahead = [f"t{k}" for k in range(1, ahead + 1)]
        self.scratch = Scratch(documents.sparkSession, "index")
        self.limit = vocabulary_limit
        self.item_words = self.scratch.write(
            items.select(F.col(item).alias("item"), F.posexplode(words(text)).alias("at", "term")).filter("item is not null")
        )
        terms = self.item_words.select("term").distinct()
        ids = terms.select("term", F.xxhash64("term").alias("t"))
        n, codes = ids.agg(F.count(F.lit(1)), F.count_distinct("t")).first()
        if n != codes:
            raise ValueError("two terms of the queries have one hash")
        ids = self.scratch.write(ids)
        ids = F.broadcast(ids) if n <= vocabulary_limit else ids
        if not ahead:
            spread = documents.select(F.col(doc).alias("doc"), F.posexplode(words(text)).alias("pos", "term"))
            self.postings = self.scratch.write(spread.join(ids, "term").select("t", "doc", "pos").filter("doc is not null"))
        else:
            each = self.texts.select("doc", coded(words("text")).alias("w"))
            rows = F.transform("w", lambda t, i: F.struct(t.alias("t"), *[F.get("w", i + k).alias(f"t{k}") for k in range(1, ahead + 1)]))
            spread = each.select("doc", F.posexplode(rows).alias("pos", "r")).select("doc", "pos", "r.*")
            self.postings = self.scratch.write(spread.join(ids.select("t"), "t", "left_semi"))
        self.item_words = self.scratch.write(self.item_words.join(ids, "term").select("item", "at", "t"))

    def anchors(self, length: Column) -> DataFrame:
        """(t, item, at): of each run of length words of an item, the term rarest in the corpus; length
        may depend on words, an item's number of words. Items are few and short, so an item is one row."""
        frequency = self.item_words.select("t").distinct().join(
            self.postings.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t", "left"
        )
        rated = self.item_words.join(frequency, "t").select("item", F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "t").alias("w"))
        whole = rated.groupBy("item").agg(F.array_sort(F.collect_list("w")).alias("w")).withColumn("words", F.size("w"))
        ranked = F.transform("w", lambda x: F.struct(x["n"], x["t"], x["at"]))
        whole = whole.withColumns({"w": ranked, "length": length}).filter("length <= words")
        runs = F.transform(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1), lambda i: F.array_min(F.slice(F.col("w"), i, F.col("length"))))
        picked = whole.select("item", F.explode(F.array_distinct(runs)).alias("r")).filter("r.n > 0")
        return picked.select("r.t", "item", "r.at").distinct()

    def offsets(self, length: Column) -> DataFrame:
        """(doc, item, shift): where the rarest terms put an item in a document, shift being the
        position in the document less that in the item."""
        anchors = self.scratch.write(self.anchors(length))
        found = self.postings.join(anchors, "t").select("doc", "item", (F.col("pos") - F.col("at")).alias("shift"))
        return self.scratch.write(found.distinct())

    def pieces(self, share: float) -> DataFrame:
        """(item, words, d, at, run, key): each item cut into d + 1 pieces, d being the words of it that may
        be edited; run successive words of a piece from at on, hashed in key. Of the ways to cut an item,
        shifted by what its length leaves over, that whose pieces have the rarest terms is taken."""
        frequency = self.postings.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        rated = self.item_words.join(frequency, "t", "left").groupBy("item").agg(
            F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "t"))).alias("w")
        )
        n = F.size("w")
        cut = rated.select("item", "w", n.alias("words"), (n - F.ceil(n * F.lit(share)).cast("int")).alias("d"))
        cut = cut.withColumn("length", F.floor(F.col("words") / (F.col("d") + 1)).cast("int"))
        starts = lambda o: F.transform(F.sequence(F.lit(0), F.col("d")), lambda k: o + k * F.col("length"))
        rarest = lambda at: F.array_min(F.transform(F.slice("w", at + 1, F.col("length")), lambda x: x["n"]))
        cost = lambda o: F.aggregate(F.transform(starts(o), rarest), F.lit(0).cast("long"), lambda a, x: a + x)
        shifts = F.sequence(F.lit(0), F.col("words") - (F.col("d") + 1) * F.col("length"))
        cut = cut.withColumn("o", F.array_min(F.transform(shifts, lambda o: F.struct(cost(o).alias("cost"), o.alias("o"))))["o"])
        run = F.least(F.col("length"), F.lit(min(RUN, len(self.ahead) + 1)))
        terms = F.transform(F.slice("w", F.col("at") + 1, F.col("run")), lambda x: x["t"])
        out = cut.withColumn("at", F.explode(starts(F.col("o")))).withColumn("run", run)
        return self.scratch.write(out.withColumn("key", F.xxhash64(terms)).select("item", "words", "d", "at", "run", "key"))

    def hits(self, offsets: DataFrame) -> DataFrame:
        """(doc, item, shift, at): every word of an item met at its place, along the offsets. The
        posting lists of the item's terms, moved by their place in the item, are intersected."""
        expected = offsets.join(self.item_words, "item").select(
            "doc", "item", "shift", "at", "t", (F.col("shift") + F.col("at")).alias("pos")
        )
        docs = self.scratch.write(offsets.select("doc").distinct())
        near = self.postings.join(docs, "doc", "left_semi")
        return expected.join(near, ["doc", "pos", "t"]).select("doc", "item", "shift", "at")


def phrase_matches(index: PositionalIndex, length: int = 12) -> DataFrame:
    """(doc_id, item_id, longest): documents that hold at least length consecutive words of an item
    as consecutive words, and the longest such run. An item of fewer words has no match; an empty
    corpus or query set gives an empty result; repeated documents each have their rows."""
    w = W.partitionBy("doc", "item", "shift").orderBy("at")
    runs = (
        index.hits(index.offsets(F.lit(length)))
        .distinct()
        .withColumn("run", F.col("at") - F.row_number().over(w))
        .groupBy("doc", "item", "shift", "run")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= length)
    )
    return runs.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("n").alias("longest"))


def coded(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def proximity_matches(index: PositionalIndex, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, edits, words): documents with a passage that becomes the item by few edits of
    words (one inserted, removed or changed), and the fewest such edits. As many are allowed as leave
    share of the item's words; index must have been made with ahead.

    Of words words d may be edited, so of d + 1 pieces of an item one at least stands unedited in any
    such passage, and none is missed. The posting lists of a piece's terms are intersected in the scan of
    the postings, which have the words that follow; only places where a whole run is met go on. The
    passages there are then compared with the item. An item without words has no match; one of which no
    word may be edited must stand as it is."""
    pieces = index.pieces(share)
    lengths = sorted(r.run for r in pieces.select("run").distinct().collect())  # RUN values at most
    few = pieces.count() <= index.limit
    terms = ["t", *index.ahead]
    keys = F.array(*[F.struct(F.lit(n).alias("run"), F.xxhash64(F.array(*terms[:n])).alias("key")) for n in lengths])
    runs = index.postings.select("doc", "pos", F.explode(keys).alias("k")).select("doc", "pos", "k.*") if lengths else index.postings.select(
        "doc", "pos", F.lit(0).alias("run"), F.lit(0).cast("long").alias("key")
    )
    met = runs.join(F.broadcast(pieces) if few else pieces, ["run", "key"])
    # places of an item that lie within one length of it are looked at together
    block = F.floor((F.col("pos") - F.col("at")) / F.col("words")).cast("int")
    places = index.scratch.write(met.select("doc", F.struct("item", "words", "d", block.alias("b")).alias("c")).distinct())
    wanted = index.scratch.write(places.groupBy("doc").agg(F.collect_set("c").alias("wanted")))  # a text's own places
    texts = index.texts.join(wanted, "doc").select("doc", coded(words("text")).alias("w"), "wanted")

    def passage(c: Column) -> Column:
        lo = F.greatest(c["b"] * c["words"] - c["d"], F.lit(0))
        return F.struct(c["item"].alias("item"), F.slice("w", lo + 1, (c["b"] + 2) * c["words"] + c["d"] - lo).alias("passage"))

    cut = texts.select("doc", F.explode(F.transform("wanted", passage)).alias("p")).select("doc", "p.*")
    whole = index.item_words.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("w"))
    whole = index.scratch.write(whole.select("item", F.transform("w", lambda x: x["t"]).alias("terms")))
    whole = F.broadcast(whole) if few else whole
    held = cut.join(whole, "item").select("doc", "item", "passage", "terms")
    kinds = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    edits = held.mapInArrow(_least_edits, f"doc {kinds['doc']}, item {kinds['item']}, words int, edits int")
    allowed = F.col("words") - F.ceil(F.col("words") * F.lit(share)).cast("int")
    least = edits.filter(F.col("edits") <= allowed).groupBy("doc", "item").agg(F.min("edits").alias("edits"), F.first("words").alias("words"))
    return least.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "edits", "words")


def least_edits(passages: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For each row of passages the fewest edits that make some part of it the item."""
    at = np.arange(passages.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(passages), len(at)), np.int32)
    for i, word in enumerate(item, 1):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (passages != word), out=new[:, 1:])
        new[:, 0] = i
        row = np.minimum.accumulate(new - at, axis=1) + at
    return row.min(axis=1)


def _least_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passages, terms, items = (batch.column(c).to_pylist() for c in ("passage", "terms", "item"))
        by: dict = {}
        for n, (p, item) in enumerate(zip(passages, items)):
            by.setdefault((item, len(p)), []).append(n)
        edits = np.zeros(len(items), np.int32)
        for (_, size), rows in by.items():
            block = np.array([passages[n] for n in rows], np.int64).reshape(len(rows), size)
            edits[rows] = least_edits(block, np.array(terms[rows[0]], np.int64))
        size = pa.array([len(t) for t in terms], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("item"), size, pa.array(edits)], names=["doc", "item", "words", "edits"])
