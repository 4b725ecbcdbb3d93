"""Ranked lexical search by bag deduplication.

1. The items' distinct terms are the vocabulary.  A document becomes its bag, the tf vector over that vocabulary, and its
   length; all other words only count for the length.  Document frequencies and the corpus's N and L are sums over the bags.
2. A score depends on the bag and on m (the document's length in hundredths of the mean), so documents with equal bag and equal m
   are one class.  Spark's window hashes bag and m together to bring a class's documents to one place, compares them byte by byte
   (both are part of the partition's key) and keeps the k smallest ids; more can't be among any item's k best.  Spark applies that
   limit before the shuffle too, so a class that holds a third of all rows sends k rows a task.
3. Each class is scored once against all items: in a block of classes the weights of a term are a row, and an item's scores are the
   sum of its terms' rows.  Its documents follow by ascending id while they can still enter an item's k best.
4. Every task returns its k best for each item; these meet by item.

Items whose postings or words exceed ``ITEM_ROWS`` or ``ITEM_BYTES`` (checked before anything is collected) aren't broadcast:
bags and items then meet in joins on the term, with the same classes and the same scores.

Scores are 64-bit integers; a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) in doubles.

Defined cases: a null text, or one without terms, has no bag, isn't counted in N and is never found; a very long text is a chunk
of its own; rows with a null document id count in N, L and df and are found with a null id, after all other ids of equal
score; rows that repeat an id are documents of their own and are ranked side by side; an item without terms, or with a null
text, finds nothing; items with the same id are one item with the terms of all its rows; an empty table on either side gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .textops import LOWER, Chunk, Words, chunks, ragged, range_hash, same_bytes, words

K = 10
#: Item postings, and bytes of distinct item terms, that are broadcast at most.
ITEM_ROWS, ITEM_BYTES = 1 << 20, 16 << 20
#: Classes scored together, and 64-bit weights held for them.
CLASSES, WEIGHTS = 512, 1 << 22

#: The ASCII bytes that separate terms: all but digits and letters.
APART = np.zeros(256, bool)
APART[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms(c: Chunk) -> tuple[np.ndarray, Words]:
    """The chunk's bytes with A-Z lower-cased, and its terms."""
    low = LOWER[c.data]
    return low, words(c, np.where(APART[low], np.uint8(32), low))


class Vocabulary:
    """Numbers of the terms of a bounded list: found by hash, confirmed by bytes."""

    def __init__(self, of: list[str]):
        raw = [t.encode() for t in of]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(size)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = range_hash(self.data, end - size, end)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.number, self.start, self.end = hashes[order], order, (end - size)[order], end[order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of the term in each byte range, or -1."""
        out = np.full(len(start), -1, np.int64)
        h = range_hash(data, start, end)
        at = np.searchsorted(self.hash, h)
        both = np.concatenate((data, self.data))
        go = np.arange(len(h))
        while len(go := go[at[go] < len(self.hash)]) and len(go := go[self.hash[at[go]] == h[go]]):
            place = at[go]
            same = same_bytes(both, start[go], end[go], len(data) + self.start[place], len(data) + self.end[place])
            out[go[same]] = self.number[place[same]]
            go = go[~same]
            at[go] += 1  # another term of the same hash
        return out


def item_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """item and term: each item's terms, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                low, w = terms(c)
                found = pa.array([low[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n).take(pa.array(w.row)), found], names=["item", "term"])

    return items.select(F.col(id).cast("long").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(run, "item long, term string").distinct()


def bags(docs: DataFrame, vocabulary: Vocabulary, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms of the text) and bag (numbers and tf of its vocabulary terms, by number) of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                low, w = terms(c)
                number = vocabulary.find(low, w.start, w.end)
                known = number >= 0
                key, tf = np.unique(w.row[known] << 32 | number[known], return_counts=True)
                edge = np.searchsorted(key >> 32, np.arange(c.n + 1)).astype(np.int32)
                bag = np.stack((key & 0xFFFFFFFF, tf), axis=1).astype("<i4").ravel()
                n = np.diff(w.first)
                lists = pa.Array.from_buffers(pa.binary(), c.n, [None, pa.py_buffer(edge * np.int32(8)), pa.py_buffer(bag)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(n), lists], names=["doc_id", "n", "bag"]).filter(pa.array(n > 0))

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, bag binary")


def weight(n: Column, df: Column) -> Column:
    """Inverse document frequency in thousandths, rounded down."""
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def _document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """In how many bags each number of the vocabulary is, summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            for c in chunks(batch.column(0), 8 << 20):
                count += np.bincount(np.frombuffer(c.data.tobytes(), "<i4")[::2], minlength=size)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["number", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("bag").mapInArrow(run, "number long, df long").groupBy("number").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["number"]] = r["df"]
    return out


def classes(found: DataFrame, m: Column, k: int, *bag: str) -> DataFrame:
    """The rows with the k smallest ids (nulls last) of each class, with m and their place in it (from 1)."""
    w = Window.partitionBy("m", *bag).orderBy(F.col("doc_id").asc_nulls_last())
    return found.withColumn("m", m).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


class _Best:
    """The k best rows of each of n items so far: highest score, then smallest id (a null is the largest)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least = np.ones(n, np.int64)  # scores below can't enter

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, place = order[place < self.k], place[place < self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        self.item = item = np.sort(item[np.arange(len(item)) - np.searchsorted(item, item) < self.k])
        full = place == self.k - 1
        self.least[item[full]] = self.score[full]


def _score_classes(rows: DataFrame, items: list[int], of: np.ndarray, number: np.ndarray, weights: np.ndarray, k: int) -> DataFrame:
    """item, doc_id and score: each task's k best, from rows of a class in order of place; items[of] has the terms in number."""
    used, column = np.unique(number, return_inverse=True)
    order = np.argsort(of, kind="stable")
    column = column[order]
    begin = np.flatnonzero(np.append(True, np.diff(of[order]) != 0)) if len(of) else np.zeros(0, np.int64)
    who = of[order][begin]
    weights = weights[used]
    step = max(1, min(CLASSES, WEIGHTS // max(1, len(number))))

    def scores(c: Chunk, m: np.ndarray) -> np.ndarray:
        """A row for each item with terms, a column for each bag."""
        pairs = np.frombuffer(c.data.tobytes(), "<i4").astype(np.int64).reshape(-1, 2)
        bag = np.repeat(np.arange(c.n), np.diff(c.off) // 8)
        place = np.searchsorted(used, pairs[:, 0])
        tf = pairs[:, 1]
        table = np.zeros((len(used), c.n), np.int64)
        table[place, bag] = weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[bag]))
        return np.add.reduceat(table[column], begin, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(items), k)
        last = None  # the scores of the class that the batch before ended with
        for batch in batches:
            if not batch.num_rows or not len(who):
                continue
            doc, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(False)
            m, place = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            head = np.flatnonzero(place == 1)
            reps = batch.column(1).take(pa.array(head))
            of_head = np.cumsum(place == 1) - 1
            if last is not None and place[0] > 1:
                enter(best, last, np.zeros(int((of_head < 0).sum()), np.int64), doc[of_head < 0], null[of_head < 0])
            for lo in range(0, len(head), step):
                bags = reps.slice(lo, step)
                for c in chunks(bags, 64 << 20):
                    a = lo + c.lo
                    got = scores(c, m[head[a : a + c.n]])
                    rows = np.flatnonzero((of_head >= a) & (of_head < a + c.n))
                    enter(best, got, of_head[rows] - a, doc[rows], null[rows])
                    last = got[:, -1:]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()).take(pa.array(best.item)), pa.array(best.doc, mask=best.null), pa.array(best.score)], names=["item_id", "doc_id", "score"])

    def enter(best: _Best, got: np.ndarray, column: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Documents with the scores of their class, where they may be among the best."""
        row, col = np.nonzero(got[:, column] >= best.least[who][:, None])
        if len(row):
            best.add(who[row], got[row, column[col]], doc[col], null[col])

    return rows.select("doc_id", "bag", "m", "place").mapInArrow(run, "item_id long, doc_id long, score long")


def _best_of(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The rows of each item_id that come first by score, then by the given order, with their rank."""
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), *order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _by_classes(docs: DataFrame, postings: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """item_id, doc_id and score of the documents that may be among an item's k best; the postings are of bounded size."""
    pairs = postings.collect()
    vocabulary, items = sorted({r["term"] for r in pairs}), sorted({r["item"] for r in pairs}, key=lambda i: (i is None, i))
    places, numbers = {t: i for i, t in enumerate(vocabulary)}, {x: i for i, x in enumerate(items)}
    of = np.array([numbers[r["item"]] for r in pairs], np.int64)
    number = np.array([places[r["term"]] for r in pairs], np.int64)
    found = written(bags(docs, Vocabulary(vocabulary), id, text), "bags")
    total = found.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    df = _document_frequencies(found, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * total["n"] + 2) / (2 * df + 1))).astype(np.int64)
    kept = classes(found, _length_class(F.lit(total["n"]), F.lit(total["l"])), k, "bag")
    return _score_classes(kept, items, of, number, weights, k)


def _length_class(n: Column, l: Column) -> Column:
    return F.expr("10L") + F.call_function("div", F.lit(90).cast("long") * F.col("n") * n, F.greatest(l, F.lit(1)))


def _counted(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, n and the terms of the text with their tf, of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                low, w = terms(c)
                n = np.diff(w.first)
                word = pa.array([low[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)], pa.string()).dictionary_encode()
                key, tf = np.unique(w.row << 32 | word.indices.to_numpy(), return_counts=True)
                off = pa.array(np.searchsorted(key >> 32, np.arange(c.n + 1)).astype(np.int32))
                pairs = pa.StructArray.from_arrays([word.dictionary.take(pa.array(key & 0xFFFFFFFF)), pa.array(tf)], names=["term", "tf"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(n), pa.ListArray.from_arrays(off, pairs)], names=["doc_id", "n", "terms"]).filter(pa.array(n > 0))

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<struct<term: string, tf: long>>")


def _by_joins(docs: DataFrame, postings: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """The same for items of any number: documents, bags and items meet by term, and classes by their bag."""
    # Written once, so a row keeps its number.
    rows = written(_counted(docs, id, text).withColumn("row", F.monotonically_increasing_id()), "counted")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    vocabulary = written(postings.select("term").distinct(), "vocabulary")
    known = written(rows.select("row", F.explode("terms").alias("t")).select("row", "t.term", "t.tf").join(vocabulary, "term"), "known")
    weights = known.groupBy("term").agg(weight(F.lit(total["n"]), F.count(F.lit(1))).alias("weight"))
    found = rows.select("row", "doc_id", "n").join(known.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("bag")), "row")
    kept = classes(found, _length_class(F.lit(total["n"]), F.lit(total["l"])), k, "bag")
    kept = kept.withColumn("class", F.first("row").over(Window.partitionBy("m", "bag").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    kept = written(kept, "classes")
    heads = kept.where("place = 1").select("class", "m", F.col("doc_id").alias("head"), F.explode("bag").alias("t")).select("class", "m", "head", "t.term", "t.tf")
    gain = F.col("weight") * F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)")
    met = heads.join(weights, "term").select("class", "head", "term", gain.alias("gain")).join(postings.withColumnRenamed("item", "item_id"), "term")
    scores = met.groupBy("item_id", "class", "head").agg(F.sum("gain").alias("score")).where("score > 0")
    best = _best_of(scores, k, F.col("head").asc_nulls_last()).select("item_id", "class", "score")
    return best.join(kept.select("class", "doc_id"), "class").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents of those with a score above 0."""
    postings = written(item_terms(items, item_id, item_text), "items")
    size = postings.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("term")).alias("bytes")).first()
    by = _by_classes if size["rows"] <= ITEM_ROWS and (size["bytes"] or 0) <= ITEM_BYTES else _by_joins
    best = _best_of(by(docs, postings, k, id, text), k, F.col("doc_id").asc_nulls_last())
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
