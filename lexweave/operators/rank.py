"""Retrieval: postings, BM25, TF-IDF, dense similarity, rank fusion, blending.

All questions are scored at once. The questions' terms go to the items in blocks of at most ``ASKED`` rows, so that no term,
however frequent, is a key of a shuffle: items' asked terms are shuffled once by the item, and counted, weighed and summed
there. Where only the k best are asked for, no more of a question leave a task, and there are only as many tasks as run at once: the
pairs that share a term, nearly all of them in the end, are never written. Scores are rounded before they are ranked and ties go to the smaller id, so results do not depend
on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.config import DEFAULT, Settings
from lexweave.functions.text import TERM


#: Rows of questions' terms that are sent to all tasks at once; rows of best items that a task holds; scores that it works out at once, of at least so many items, as a matrix product of few rows is slow.
ASKED, HELD, CELLS, LEAST_ITEMS = 1_000_000, 4_000_000, 1_000_000, 64
#: Share of all pairs from which a term's part of them is a matrix product.
DENSE, DENSE_TERMS = 0.008, 512
#: From so many first items of a task, and as many as that times k at most, the kth best is known before any is held.
FIRST, FIRST_K = 2000, 40


def top_k(scored: DataFrame, k: int, item: str = "item_id", by: str = "score") -> DataFrame:
    """The k best rows of each question, as ``rn`` from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), item)
    return scored.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= k)


def _split(texts: pa.Array) -> pa.ListArray:
    """The words of each text, as ``functions.text.terms`` has them."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=TERM.replace("[", "[^").replace("{2,}", "+"))
    flat = lists.flatten()
    return _filtered(lists, flat, pc.greater_equal(pc.utf8_length(flat), 2))


def _filtered(lists: pa.ListArray, flat: pa.Array, kept: pa.Array) -> pa.ListArray:
    """Lists of those of their values, or of what stands for them in ``flat``, that are kept."""
    first = lists.offsets.to_numpy()
    sums = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[first - first[0]]
    return pa.ListArray.from_arrays(pa.array(sums.astype(np.int32)), flat.filter(kept))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _rows_of(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _counts(items: DataFrame) -> DataFrame:
    """term, total (its occurrences), df (the items that have it), in one pass; the items that have any word stand as the term ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            lists = _split(b.column(0))
            enc, n = lists.flatten().dictionary_encode(), int((np.diff(lists.offsets.to_numpy()) > 0).sum())
            place, v = enc.indices.to_numpy(), max(1, len(enc.dictionary))
            df = np.bincount(np.unique(_rows_of(lists) * v + place) % v, minlength=len(enc.dictionary))
            columns = [pa.concat_arrays([enc.dictionary, pa.array([""])]), pa.array(np.append(np.bincount(place, minlength=len(enc.dictionary)), 0).astype(np.int64)), pa.array(np.append(df, n).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "total", "df"])

    return items.select("text").mapInArrow(run, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def term_counts(items: DataFrame) -> DataFrame:
    """term, total (its occurrences), df (the items that have it)."""
    return _counts(items).where("term <> ''")


def _blocks(asked: DataFrame, most: int) -> list[DataFrame]:
    """The questions' terms in parts of about ``most`` rows, whole questions each."""
    n = max(1, -(-asked.count() // most))
    return [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _at_once(df: DataFrame) -> int:
    """Tasks that run at once; each holds the best items of every question of a block, so that more of them would only write more."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def question_terms(queries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            lists = _split(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(_rows_of(lists))), lists.flatten()], ["query_id", "term"])

    own = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "text").mapInArrow(run, f"query_id {own}, term string").groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def bm25(items: DataFrame, queries: DataFrame, s: Settings = DEFAULT, most: int = ASKED, k: int | None = None) -> DataFrame:
    """query_id, item_id, score of each pair that shares a term; repeated question terms count as often as they come.

    The inverse document frequency of a term in over half of the items is epsilon times the mean over all terms.
    Null and wordless texts are no items; a question without terms finds nothing. With ``k`` only each task's k best items of a
    question come out, the k best of all among them.
    """
    asked, spark = question_terms(queries), queries.sparkSession
    context, own, kind = spark.sparkContext, queries.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    most = min(most, HELD // k * 16) if k else most
    block = asked.limit(most + 1).toArrow()  # mostly all of them: a block, for which the questions are read once
    whole = block.num_rows <= most
    wanted = spark.createDataFrame(pa.table({"own": pc.unique(block["term"]).cast(pa.string())}), "own string") if whole else asked.select(F.col("term").alias("own")).distinct()
    # a row for each asked term and each other count of items, of broadcast size, worked out once
    counts = _counts(items).join(F.broadcast(wanted), F.col("term") == F.col("own"), "left").groupBy(F.when(F.col("term") == "", "").otherwise(F.col("own")).alias("term"), "df").agg(F.count("*").alias("times"), F.sum("total").alias("total")).toArrow()
    words = _Words(counts, s)
    known = context.broadcast(words.terms)
    held = items.select("item_id", "text").mapInArrow(_indexed(known), f"item_id {kind}, length int, t array<int>")
    held = (held.repartition(_at_once(held), "item_id") if k else held.repartition("item_id")).sortWithinPartitions("item_id", "length")
    out = []
    for rows in [block] if whole else (part.toArrow() for part in _blocks(asked, most)):
        known = context.broadcast(_Asked(rows, words))  # at most a block
        out.append(held.mapInArrow(_bm25_scores(known, s, k), f"query_id {own}, item_id {kind}, score double"))
    return _union(out)


class _Words:
    """The asked terms that items have: their inverse document frequency and share of the items; the items' mean length."""

    def __init__(self, counts: pa.Table, s: Settings):
        counts = counts.combine_chunks()
        df, times = counts["df"].to_numpy(), counts["times"].to_numpy()
        whole = pc.fill_null(pc.equal(counts["term"], ""), False).to_numpy().astype(bool)
        n = int(df[whole].sum())
        df, times = df[~whole], times[~whole]
        raw = np.log(n - df + 0.5) - np.log(df + 0.5)
        idf = np.where(raw < 0, s.bm25_epsilon * (raw @ times) / max(1, times.sum()), raw)
        rest = counts.filter(pa.array(~whole))
        named = rest["term"].is_valid().to_numpy().astype(bool)
        self.terms = rest["term"].filter(pa.array(named)).combine_chunks()
        if isinstance(self.terms, pa.ChunkedArray):
            self.terms = pa.concat_arrays(self.terms.chunks) if self.terms.num_chunks else pa.array([], pa.string())
        self.idf, self.share, self.mean_length = idf[named], df[named] / max(1, n), pc.sum(rest["total"]).as_py() / n if n else 1.0


class _Asked:
    """A block of questions: their ids and the weight of each term in each, by the terms' numbers."""

    def __init__(self, rows: pa.Table, words: _Words):
        place = pc.index_in(rows["term"], value_set=words.terms)
        place = place.combine_chunks() if isinstance(place, pa.ChunkedArray) else place
        rows = rows.append_column("place", place).filter(place.is_valid()).combine_chunks()
        queries = _encoded(rows["query_id"])
        self.queries, self.query, self.term = queries.dictionary, queries.indices.to_numpy(), rows["place"].to_numpy()
        self.weight, self.n_terms, self.mean_length = rows["qf"].to_numpy() * words.idf[self.term], len(words.terms), words.mean_length
        share = words.share * np.bincount(self.term, minlength=self.n_terms) / max(1, len(self.queries))
        often = np.argsort(-share, kind="stable")[:DENSE_TERMS]
        self.dense = often[share[often] >= DENSE]


def _encoded(column: pa.ChunkedArray) -> pa.DictionaryArray:
    out = column.dictionary_encode(null_encoding="encode")
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def _indexed(known) -> Callable:
    """item_id, length, and the numbers of an item's known terms, repeated ones as often as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            words = _split(b.column(1))
            found = pc.index_in(words.flatten(), value_set=known.value)
            t = _filtered(words, found.cast(pa.int32()), found.is_valid())
            rows = pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(words.offsets.to_numpy()).astype(np.int32)), t], ["item_id", "length", "t"])
            yield rows.filter(pa.array(np.diff(t.offsets.to_numpy()) > 0))

    return run


class _Best:
    """The k best of what is added for each question, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.most = k, np.full(n, -np.inf), 2 * n * k + (1 << 17)
        self.top, self.seen = np.zeros((n, 0)), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[pa.Array] = []
        self.n = self.size = 0

    def add(self, ids: pa.Array, q: np.ndarray, i: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((q.astype(np.int32), (i + self.n).astype(np.int32), scores))
        self.ids.append(ids)
        self.n += len(ids)
        self.size += len(q)
        if self.size > self.most:
            self.rows()

    def first(self, sums: np.ndarray) -> None:
        """Raises what is least by all scores of some items, a row for each: 0 where nothing is shared, else above."""
        if self.seen >= min(FIRST, FIRST_K * self.k):
            return
        self.seen += len(sums)
        self.top = np.concatenate([self.top, sums.T], axis=1)
        if self.top.shape[1] >= self.k:
            self.top = np.partition(self.top, -self.k, axis=1)[:, -self.k :]
            self.least = np.maximum(self.least, self.top[:, 0])
        if self.seen >= min(FIRST, FIRST_K * self.k):
            self.top = self.top[:, :0]

    def _near(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Those that are not below the kth best score of their question."""
        if not len(q) or np.abs(score).max() >= 1 << 18:
            return np.ones(len(q), bool)
        key = (q.astype(np.int64) << 40) - np.rint(score * 1e6).astype(np.int64)  # scores have six decimals
        own = np.sort(key)
        start = np.searchsorted(own, (np.arange(len(self.least) + 1, dtype=np.int64) << 40) - (1 << 39))
        last = start[:-1] + self.k - 1
        limit = np.where(last < start[1:], own[np.minimum(last, len(own) - 1)], np.iinfo(np.int64).max)
        return key <= limit[q]

    def rows(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Question's number, item, score; the rest is forgotten."""
        if not self.parts:
            return np.zeros(0, np.int32), None, np.zeros(0)
        q, i, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        near = self._near(q, score)
        q, i, score = q[near], i[near], score[near]
        own, place = np.unique(i, return_inverse=True)
        ids = pa.chunked_array(self.ids).take(pa.array(own)).combine_chunks()
        order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy()[place], -score, q))
        q, place, score = q[order], place[order], score[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(q)))
        nth = np.arange(len(q)) - np.repeat(start, n)
        last = nth == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        kept = nth < self.k
        q, place, score = q[kept], place[kept], score[kept]
        used, place = np.unique(place, return_inverse=True)
        self.ids, self.n = [ids.take(pa.array(used))], len(used)
        self.parts, self.size = [(q, place.astype(np.int32), score)], len(q)
        return q, self.ids[0].take(pa.array(place)), score


def _cells(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a table that hold; for a few among many this takes far less time than ``nonzero``."""
    return np.divmod(np.flatnonzero(where), where.shape[1])


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) / 1e6


def _found(queries: pa.Array, q: np.ndarray, items: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([queries.take(pa.array(q)), items, pa.array(scores)], ["query_id", "item_id", "score"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold all rows of an item, which come in order of it, and where each item begins."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
        codes = _encoded(rows["item_id"]).indices.to_numpy()
        start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        rest = rows.slice(start[-1]).to_batches()[0]
        if len(start) > 1:
            yield rows.slice(0, start[-1]).to_batches()[0], start[:-1]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _bm25_scores(known, s: Settings, k: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: _Asked = known.value
        n, v = len(a.queries), a.n_terms
        if not n:
            return
        best = _Best(n, k) if k else None
        column = np.full(v, -1)
        column[a.dense] = np.arange(len(a.dense))
        c, rare = column[a.term], column[a.term] < 0
        matrix = np.zeros((n, len(a.dense)))
        matrix[a.query[~rare], c[~rare]] = a.weight[~rare]
        has = np.zeros((n, len(a.dense)))
        has[a.query[~rare], c[~rare]] = 1
        # the questions of each rare term
        order = np.argsort(a.term[rare], kind="stable")
        whose, weight, first = a.query[rare][order], a.weight[rare][order], np.concatenate([[0], np.cumsum(np.bincount(a.term[rare], minlength=v))])
        positive = bool((a.weight > 0).all())  # then a pair shares a term if its sum is above 0

        def summed(item: np.ndarray, term: np.ndarray, value: np.ndarray, m: int, matrix: np.ndarray, weight: np.ndarray) -> np.ndarray:
            """The sums of all questions' weights times values: a row for each of the m items."""
            own = column[term] >= 0
            there = np.bincount(item[own] * len(a.dense) + column[term[own]], weights=value[own], minlength=m * len(a.dense)).astype(np.float64, copy=False).reshape(m, -1) if len(a.dense) else np.zeros((m, 0))
            item, term, value = item[~own], term[~own], value[~own]
            times = first[term + 1] - first[term]
            at = np.repeat(first[term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(term) else np.zeros(0, np.int64)
            sums = np.bincount(np.repeat(item * n, times) + whose[at], weights=np.repeat(value, times) * weight[at], minlength=m * n).astype(np.float64, copy=False).reshape(m, n)
            if len(a.dense):
                sums += there @ matrix.T
            return sums

        for rows, start in _whole(batches):
            step = max(LEAST_ITEMS, CELLS // n)
            for j in range(0, len(start), step):
                low, high = start[j], start[j + step] if j + step < len(start) else rows.num_rows
                b, item_of = rows.slice(low, high - low), np.repeat(np.arange(len(start[j : j + step])), np.diff(np.append(start[j : j + step], high)))
                m, length = int(item_of[-1]) + 1, b.column(1).to_numpy()
                group = np.cumsum(np.concatenate([[False], (item_of[1:] != item_of[:-1]) | (length[1:] != length[:-1])]))  # repeated rows of an item are one
                key, tf = np.unique(np.repeat(group, np.diff(b.column(2).offsets.to_numpy())) * v + b.column(2).flatten().to_numpy(), return_counts=True)
                group_first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                g, term = key // v, key % v
                value = tf * (s.bm25_k1 + 1) / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * length[group_first][g] / a.mean_length))
                item = item_of[group_first][g]
                sums = summed(item, term, value, m, matrix, weight)
                if best is not None and positive:
                    best.first(sums)
                    shared = sums >= np.maximum(best.least - 2e-6, np.nextafter(0, 1))
                else:
                    shared = sums > 0 if positive else summed(item, term, np.ones(len(term)), m, has, np.ones(len(weight))) > 0
                    if best is not None:
                        shared &= sums >= best.least - 2e-6
                i, q = _cells(shared)
                ids, scores = b.column(0).take(pa.array(start[j : j + step] - low)), _rounded(sums[i, q])
                if best is None:
                    yield _found(a.queries, q, ids.take(pa.array(i)), scores)
                else:
                    best.add(ids, q, i, scores)
        if best is not None:
            q, ids, scores = best.rows()
            if len(q):
                yield _found(a.queries, q, ids, scores)

    return run


class Vocabulary:
    """The most frequent terms of the items and their inverse document frequency, worked out once."""

    def __init__(self, items: DataFrame, s: Settings = DEFAULT):
        n = items.where("text is not null").count()
        rows = term_counts(items).orderBy(F.desc("total"), "term").limit(s.tfidf_terms).select("term", "df").collect()  # at most tfidf_terms rows
        self.terms, self.idf = pa.array([r["term"] for r in rows], pa.string()), np.asarray([np.log((1 + n) / (1 + r["df"])) + 1 for r in rows])

    def questions(self, asked: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """asked: rows of ``question_terms``. The ids of the questions that have a term, and of each such term question, place and weight."""
        place = pc.index_in(asked["term"], value_set=self.terms)
        rows = asked.append_column("place", place).filter(place.is_valid()).combine_chunks()
        queries, place = _encoded(rows["query_id"]), rows["place"].to_numpy()
        q, w = queries.indices.to_numpy(), rows["qf"].to_numpy() * self.idf[place]
        norm = np.sqrt(np.bincount(q, weights=w * w, minlength=len(queries.dictionary)))
        return queries.dictionary, q, place, w / norm[q]


def tfidf(items: DataFrame, queries: DataFrame, s: Settings = DEFAULT, k: int | None = None, block: int = 4096, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Cosine of TF-IDF vectors over the most frequent terms; pairs without a common one are left out.

    The questions' vectors go to the items in blocks of about ``block``; there a matrix product scores a batch at a time. With ``k`` only
    each task's k best items of a question leave it.
    """
    known = vocabulary or Vocabulary(items, s)
    context, kind = queries.sparkSession.sparkContext, items.schema["item_id"].dataType.simpleString()
    own, out, asked = queries.schema["query_id"].dataType.simpleString(), [], question_terms(queries)
    own_items = items.select("item_id", "text").coalesce(_at_once(items)) if k else items.select("item_id", "text")
    for part in _blocks(asked, block * 32):
        cells = context.broadcast((known.terms, known.idf, *known.questions(part.toArrow())))  # about 32 a question; their matrix has a row for each
        out.append(own_items.mapInArrow(_cosines(cells, k), f"query_id {own}, item_id {kind}, score double"))
    return _union(out)


def _item_vectors(texts: pa.Array, words: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of texts, a row each."""
    lists = _split(texts)
    found = pc.index_in(lists.flatten(), value_set=words)
    there = found.is_valid().to_numpy(zero_copy_only=False)
    counts = np.bincount(_rows_of(lists)[there] * len(idf) + found.drop_null().to_numpy(), minlength=len(texts) * len(idf)).reshape(len(texts), len(idf))
    return _unit(counts * idf)


def _cosines(known, k: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, idf, queries, q, place, w = known.value
        if not len(queries):
            return
        matrix = np.zeros((len(queries), len(idf)))
        matrix[q, place] = w
        best = _Best(len(queries), k) if k else None
        for b in _sliced(batches, max(1, CELLS // len(queries))):
            scores = _item_vectors(b.column(1), words, idf) @ matrix.T
            i, q = _cells(scores >= np.maximum(best.least - 2e-6, 5e-7) if best is not None else scores >= 5e-7)
            found = _rounded(scores[i, q])
            if best is None:
                yield _found(queries, q, b.column(0).take(pa.array(i)), found)
            else:
                best.add(b.column(0), q, i, found)
        if best is not None:
            q, ids, scores = best.rows()
            if len(q):
                yield _found(queries, q, ids, scores)

    return run


def with_cosines(pairs: DataFrame, items: DataFrame, queries: DataFrame, s: Settings = DEFAULT, vocabulary: Vocabulary | None = None) -> DataFrame:
    """pairs (query_id, item_id, rrf) with the ``cosine`` of each, 0 without a common term. Only those pairs are worked out, where the item's text is."""
    known = vocabulary or Vocabulary(items, s)
    context, kind = queries.sparkSession.sparkContext, items.schema["item_id"].dataType.simpleString()
    own = queries.schema["query_id"].dataType.simpleString()
    cells = context.broadcast((known.terms, known.idf, *known.questions(question_terms(queries).toArrow())))  # about 32 a question

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, idf, *_ = cells.value
        for b in _sliced(batches):
            m = _item_vectors(b.column(1), words, idf)
            row, place = np.nonzero(m)
            first = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(m)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(first, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(first, pa.array(m[row, place]))], ["item_id", "i", "w"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, idf, ids, q, place, w = cells.value
        order = np.argsort(q, kind="stable")
        first, place, w = np.concatenate([[0], np.cumsum(np.bincount(q, minlength=len(ids)))]), place[order], w[order]
        for b in _sliced(batches):
            asked, number = np.unique(pc.fill_null(pc.index_in(b.column(0), value_set=ids), -1).to_numpy(), return_inverse=True)
            matrix = np.zeros((len(asked), len(idf)))
            for j, x in enumerate(asked):
                if x >= 0:
                    matrix[j, place[first[x] : first[x + 1]]] = w[first[x] : first[x + 1]]
            i, v = b.column(3), b.column(4).flatten().to_numpy()
            n = np.diff(i.offsets.to_numpy()) if i.null_count == 0 else pc.fill_null(pc.list_value_length(i), 0).to_numpy()
            row = np.repeat(np.arange(b.num_rows), n)
            cosine = np.bincount(row, weights=v * matrix[number[row], i.flatten().to_numpy()], minlength=b.num_rows).astype(np.float64, copy=False) if len(idf) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(_rounded(cosine))], ["query_id", "item_id", "rrf", "cosine"])

    own_vectors = items.select("item_id", "text").mapInArrow(vectors, f"item_id {kind}, i array<int>, w array<double>")
    return pairs.join(own_vectors, "item_id", "left").select("query_id", "item_id", "rrf", "i", "w").mapInArrow(products, f"query_id {own}, item_id {kind}, rrf double, cosine double")


def dense(items: DataFrame, queries: DataFrame, k: int, decimals: int = 5, block: int = 4096) -> DataFrame:
    """query_id, item_id, score, rn: the k items of greatest cosine for each question.

    items: item_id, vector; queries: query_id, vector. The questions are taken in blocks of at most ``block``; each block
    goes over the items once, a matrix product by Arrow batch, and only each batch's k best leave it. Null and zero vectors
    score 0 against everything and are left out.
    """
    n = max(1, -(-queries.count() // block))
    context = queries.sparkSession.sparkContext
    parts = []
    for b in range(n):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).where("vector is not null").select("query_id", "vector").collect()  # at most about a block
        matrix = np.asarray([r["vector"] for r in own], np.float64)
        known = context.broadcast(([r["query_id"] for r in own], _unit(matrix) if len(own) else matrix))
        parts.append(items.where("vector is not null").select("item_id", "vector").mapInArrow(_best(known, k, decimals), "query_id long, item_id long, score double"))
    return top_k(_union(parts), k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def _best(known, k: int, decimals: int) -> Callable:
    schema = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = known.value
        for b in batches:
            if not b.num_rows or not ids:
                continue
            vectors = b.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            items = b.column(0).to_numpy(zero_copy_only=False)
            scores = np.round(matrix @ _unit(flat.reshape(len(items), -1)).T, decimals)
            keep = min(k, len(items))
            order = np.lexsort((np.broadcast_to(items, scores.shape), -scores), axis=1)[:, :keep]
            rows = np.repeat(np.arange(len(ids)), keep)
            cols = order.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids)[rows]), pa.array(items[cols]), pa.array(scores[rows, cols])], schema=schema)

    return run


def fuse(channels: dict[str, DataFrame], s: Settings = DEFAULT) -> DataFrame:
    """Reciprocal rank fusion of ranked channels (query_id, item_id, rn): query_id, item_id, score."""
    ranked = None
    for df in channels.values():
        own = df.select("query_id", "item_id", "rn")
        ranked = own if ranked is None else ranked.unionByName(own)
    # shuffled by a hash of its own: Spark 4.1 takes a union of reused exchanges for partitioned, even where their partitions were coalesced apart
    return ranked.repartition(F.xxhash64("query_id")).groupBy("query_id", "item_id").agg(F.round(F.sum(1.0 / (s.rrf_k + F.col("rn"))), 8).alias("score"))


def minmax(column: str, by: str = "query_id") -> Column:
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return (F.col(column) - low) / (high - low + 1e-9)


def blend(pool: DataFrame, first: str, second: str, alpha: float) -> DataFrame:
    """Adds ``score``: (1 - alpha) of the first and alpha of the second score, each spread to 0..1 within its question."""
    a = min(1.0, max(0.0, alpha))
    return pool.withColumn("score", F.round((1 - a) * minmax(first) + a * minmax(second), 6))


def rerank(pool: DataFrame, scorer: Callable[[DataFrame], DataFrame], s: Settings = DEFAULT) -> DataFrame:
    """The head of ``ce_top_n`` rows by ``rn`` is scored again and blended; the tail keeps its order. Off at 0."""
    if not s.ce_top_n:
        return pool
    head = scorer(pool.where(F.col("rn") <= s.ce_top_n))  # adds ce
    head = head.withColumn("score", F.round((1 - s.ce_beta) * F.col("score") + s.ce_beta * minmax("ce") + 1e-9, 6)).drop("ce")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    head = head.withColumn("rn", F.row_number().over(w).cast("long"))
    return head.unionByName(pool.where(F.col("rn") > s.ce_top_n))


def ensemble(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of several models' scores, each spread to 0..1 within its question, as ``ce``."""
    return scored.withColumn("ce", sum(minmax(c) for c in columns) / len(columns))


def specificity(text: Column, weight: float, score: Column) -> Column:
    """A prior for longer texts, mixed in by weight."""
    prior = 1 / (1 + F.exp(-(F.length(text) - 300) / 150.0))
    return (1 - weight) * score + weight * prior
