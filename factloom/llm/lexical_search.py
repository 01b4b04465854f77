"""Ranked lexical search by inverted treaps.

1. The terms of all items are the vocabulary. Each whole document becomes its number of terms and the
   counts of the vocabulary's terms in it; this table is written, and numbers of documents, terms and
   documents by term are summed over it.
2. Documents are dealt to cells of about ``CELL_POSTINGS`` postings and items to blocks of about
   ``ITEM_BLOCK``; each cell meets each block once, by a cogroup. In a cell, each term has a treap over
   its postings: search order by doc_id, heap order by impact.
3. The treaps of an item's terms are walked together. A step holds intervals of documents and, for
   each term, the topmost node inside, whose impact is the largest of the interval. An interval whose
   summed maxima cannot reach the k-th best score goes; the others split at the document of their
   greatest impact (in the middle where that would leave a sliver), best bounds first. Intervals of at
   most ``LEAF`` documents are scored.
4. About the square root of all cells are searched first; the k-th best scores found there are the bars
   of the other cells, so the rows to merge grow with that root, not with the number of cells.

A vocabulary of at most ``BROADCAST_TERMS`` terms is sent to the tasks that read texts; a larger one is
joined to the terms of the documents instead.

Cases: null and empty texts, or texts without terms, are in no result and count in no statistic; an
item without text or terms gives no row; rows of items with one item_id are one item with the terms of
all; repeated rows of documents are ranked one by one; a null doc_id comes last among equal scores;
empty tables give an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.llm.common import forget, map_texts, saved

#: Vocabulary sent to tasks (about 100 bytes a term); a larger one is joined.
BROADCAST_TERMS = 1 << 20
#: Postings of a cell: some 40 MB with its treaps.
CELL_POSTINGS = 1 << 20
#: Items of a block.
ITEM_BLOCK = 1024
#: Documents of an interval that is scored, and intervals taken in a step.
LEAF, STEP = 64, 64

# letters and digits and all bytes beyond ASCII stay, A-Z are lower-cased, the rest parts terms
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _counts(words: list[bytes]) -> dict[bytes, int]:
    found: dict[bytes, int] = {}
    for w in words:
        found[w] = found.get(w, 0) + 1
    return found


def _texts_as_terms(df: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """``keep``, n (all terms), terms (strings, each once) and tfs."""

    def make():
        def work(texts):
            ns, terms, tfs = [], [], []
            for t in texts:
                words = terms_of(t)
                found = _counts(words)
                ns.append(len(words))
                terms.append([w.decode("utf-8", "replace") for w in found])
                tfs.append(list(found.values()))
            return ns, terms, tfs

        return work

    return map_texts(df, keep, text, [("n", T.LongType()), ("terms", T.ArrayType(T.StringType())), ("tfs", T.ArrayType(T.LongType()))], make)


def document_terms(docs: DataFrame, vocabulary: DataFrame, id_col: str, text: str, most: int) -> DataFrame:
    """A written table (doc_id, n, terms, tfs) of all documents: number of all terms, and ids and counts
    of those of the vocabulary (term, term_id)."""
    named = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text"))
    if vocabulary.count() > most:
        whole = saved(_texts_as_terms(named, ("doc_id",), "text").withColumn("row", F.monotonically_increasing_id()), "terms")
        posts = whole.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
        # a document's terms are its own, so each group here is one document
        lists = posts.join(vocabulary, "term").groupBy("row").agg(F.collect_list(F.struct("term_id", "tf")).alias("p"))
        empty = F.array().cast("array<long>")
        part = lambda c: F.coalesce(F.transform("p", lambda x: x[c]), empty)
        out = saved(whole.select("row", "doc_id", "n").join(lists, "row", "left").select("doc_id", "n", part("term_id").alias("terms"), part("tf").alias("tfs")), "postings")
        forget(whole)
        return out
    ids = {r.term.encode("utf-8", "surrogatepass"): r.term_id for r in vocabulary.collect()}
    held = docs.sparkSession.sparkContext.broadcast(ids)

    def make():
        known = held.value

        def work(texts):
            ns, terms, tfs = [], [], []
            for t in texts:
                words = terms_of(t)
                found = _counts([known[w] for w in words if w in known])
                ns.append(len(words))
                terms.append(list(found))
                tfs.append(list(found.values()))
            return ns, terms, tfs

        return work

    return saved(map_texts(named, ("doc_id",), "text", [("n", T.LongType()), ("terms", T.ArrayType(T.LongType())), ("tfs", T.ArrayType(T.LongType()))], make), "postings")


class Treaps:
    """The treaps of a cell: one for each term, over postings sorted by term and document.

    Node ``i`` is posting ``i``; -1 is no node and has impact 0. Equal impacts are put in a random but
    fixed heap order, so that runs of them do not make a path."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int) -> None:
        order = np.lexsort((doc, term))
        self.documents = documents
        self.terms, start = np.unique(term[order], return_index=True)
        ends = np.r_[start[1:], len(order)]
        self.doc = np.r_[doc[order], 0].astype(np.int64)
        self.impact = np.r_[impact[order], 0].astype(np.int64)
        self.left = np.full(len(order) + 1, -1, np.int64)
        self.right = np.full(len(order) + 1, -1, np.int64)
        self.root = np.empty(len(start), np.int64)
        chance = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 30, len(order), dtype=np.int64)
        heap = (self.impact[:-1] << 30) | chance
        for t, (low, high) in enumerate(zip(start.tolist(), ends.tolist(), strict=True)):
            self.root[t] = self._grow(heap[low:high].tolist(), low)
        # place of each posting by term and document
        self.key = np.repeat(np.arange(len(start), dtype=np.int64), ends - start) * documents + self.doc[:-1]

    def _grow(self, heap: list[int], low: int) -> int:
        """Links the nodes from ``low`` on; returns their root. One pass, with the right spine as a stack."""
        left, right, spine = [-1] * len(heap), [-1] * len(heap), []
        for i, h in enumerate(heap):
            last = -1
            while spine and heap[spine[-1]] < h:
                last = spine.pop()
            if last >= 0:
                left[i] = low + last
            if spine:
                right[spine[-1]] = low + i
            spine.append(i)
        self.left[low : low + len(heap)] = left
        self.right[low : low + len(heap)] = right
        return low + spine[0]

    def topmost(self, nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Under each node, the topmost one with a document in [a, b)."""
        while True:
            doc, there = self.doc[nodes], nodes >= 0
            before, behind = there & (doc < a[:, None]), there & (doc >= b[:, None])
            if not (before.any() or behind.any()):
                return nodes
            nodes = np.where(before, self.right[nodes], np.where(behind, self.left[nodes], nodes))

    def scores(self, terms: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Scores of all documents in disjoint intervals, 0 elsewhere."""
        base = terms * self.documents
        low = np.searchsorted(self.key, (a[:, None] + base).ravel())
        size = np.searchsorted(self.key, (b[:, None] + base).ravel()) - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        weight = np.repeat(np.tile(weights, len(a)), size)
        # sums stay far below 2**53, so doubles hold them exactly
        return np.bincount(self.doc[at], self.impact[at] * weight, self.documents).astype(np.int64)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, bar: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` documents with a score of at least ``bar`` (1 or more): documents and scores,
        best first, equal scores by document."""
        place = np.searchsorted(self.terms, terms)
        place[place == len(self.terms)] = 0
        here = self.terms[place] == terms
        terms, weights = place[here], weights[here]
        best_doc, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return best_doc, best
        a, b, nodes = np.array([0]), np.array([self.documents]), self.root[terms][None, :]
        bound = self.impact[nodes] @ weights
        while True:
            live = bound >= bar
            a, b, nodes, bound = a[live], b[live], nodes[live], bound[live]
            if not len(a):
                return best_doc, best
            order = np.argsort(-bound, kind="stable")
            now, rest = order[:STEP], order[STEP:]
            ta, tb, tn = a[now], b[now], nodes[now]
            a, b, nodes, bound = a[rest], b[rest], nodes[rest], bound[rest]
            leaf = tb - ta <= LEAF
            one, two = ta[leaf], tb[leaf]
            ta, tb, tn = ta[~leaf], tb[~leaf], tn[~leaf]
            if len(ta):
                share = self.impact[tn] * weights
                at = self.doc[tn[np.arange(len(ta)), share.argmax(axis=1)]]
                sliver = np.minimum(at - ta, tb - at) * 8 < tb - ta
                at = np.where(sliver, (ta + tb) // 2, at)
                one, two = np.r_[one, at], np.r_[two, at + 1]
                ca, cb = np.r_[ta, at + 1], np.r_[at, tb]
                cn = self.topmost(np.r_[tn, tn], ca, cb)
                a, b, nodes, bound = np.r_[a, ca], np.r_[b, cb], np.r_[nodes, cn], np.r_[bound, self.impact[cn] @ weights]
            found = self.scores(terms, weights, one, two)
            new = np.flatnonzero(found >= bar)
            best_doc, best = np.r_[best_doc, new], np.r_[best, found[new]]
            order = np.lexsort((best_doc, -best))[:k]
            best_doc, best = best_doc[order], best[order]
            if len(best) == k:
                bar = max(bar, int(best[-1]))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and the row of each."""
    rows = column.combine_chunks()
    rows = rows if isinstance(rows, pa.Array) else pa.concat_arrays(rows.chunks)
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    return rows.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _search_cells(postings: DataFrame, items: DataFrame, cells: int, first: int, until: int, blocks: int, k: int, documents: int, terms: int) -> DataFrame:
    """Best ``k`` of each item in each cell from ``first`` up to ``until``: item_id, doc_id, score."""
    every = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
    left = postings.withColumn("cell", F.pmod(F.monotonically_increasing_id(), F.lit(cells)).cast("int")).where((F.col("cell") >= first) & (F.col("cell") < until))
    left = left.where(F.size("terms") > 0).withColumn("block", every(0, blocks))
    right = items.withColumn("cell", every(first, until))

    def run(posts: pa.Table, asked: pa.Table) -> pa.Table:
        out_item, out_doc, out_score = [], [], []
        if posts.num_rows and asked.num_rows:
            # documents in order of id, a null last
            posts = posts.take(pc.sort_indices(posts, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
            term, doc = _lists(posts["terms"])
            tf = _lists(posts["tfs"])[0]
            m = np.array([50 + 50 * n * documents // terms for n in posts["n"].to_pylist()], np.int64)
            treaps = Treaps(term, doc, 10**9 * tf // (1000 * tf + 20 * m[doc]), posts.num_rows)
            ids = posts["doc_id"].to_pylist()
            for item, found, weights, bar in zip(*(asked[c].to_pylist() for c in ("item_id", "terms", "weights", "bar")), strict=True):
                docs, scores = treaps.top(np.array(found, np.int64), np.array(weights, np.int64), k, bar)
                out_item += [item] * len(docs)
                out_doc += [ids[d] for d in docs.tolist()]
                out_score += scores.tolist()
        kinds = asked.schema.field("item_id").type, posts.schema.field("doc_id").type
        return pa.table({"item_id": pa.array(out_item, kinds[0]), "doc_id": pa.array(out_doc, kinds[1]), "score": pa.array(out_score, pa.int64())})

    schema = T.StructType([items.schema["item_id"], postings.schema["doc_id"], T.StructField("score", T.LongType())])
    left, right = left.select("cell", "block", "doc_id", "n", "terms", "tfs"), right.select("cell", "block", "item_id", "terms", "weights", "bar")
    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_terms: int = BROADCAST_TERMS, cell_postings: int = CELL_POSTINGS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: item_id, rank from 1, doc_id, score.

    Integer BM25: the score sums w * ((10**9 * tf) div (1000 * tf + 20 * m)) over the item's terms, with
    w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and m = 50 + (50 * n * N) div L."""
    asked = items.select(items[item_id].alias("item_id"), items[item_text].alias("text"))
    words = saved(_texts_as_terms(asked, ("item_id",), "text").select("item_id", F.explode("terms").alias("term")).distinct(), "item-terms")
    vocabulary = saved(words.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    postings = document_terms(docs, vocabulary, id_col, text, broadcast_terms)
    total = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    often = postings.select(F.explode("terms").alias("term_id")).groupBy("term_id").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * total.documents + 2) / (2 * F.col("df") + 1)).cast("double"))).cast("long")
    known = words.join(vocabulary, "term").join(often.select("term_id", weight.alias("weight")), "term_id").where("weight > 0")
    # an item's terms are those of its text
    lists = known.groupBy("item_id").agg(F.collect_list(F.struct("term_id", "weight")).alias("l"))
    blocks = max(1, -(-lists.count() // item_block))
    lists = saved(lists.select("item_id", F.transform("l", lambda x: x["term_id"]).alias("terms"), F.transform("l", lambda x: x["weight"]).alias("weights"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")), "items")
    cells = max(1, -(-total.postings // cell_postings))
    leading = math.isqrt(cells)

    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    search = lambda with_bars, first, until: _search_cells(postings, with_bars, cells, first, until, blocks, k, total.documents, max(1, total.terms))
    hits = search(lists.withColumn("bar", F.lit(1).cast("long")), 0, leading)
    if leading < cells:
        early = saved(best(hits), "hits")
        bars = early.where(F.col("rank") == k).select(F.col("item_id").alias("__item"), F.col("score").alias("bar"))
        raised = lists.join(bars, F.col("item_id").eqNullSafe(F.col("__item")), "left").drop("__item").withColumn("bar", F.coalesce("bar", F.lit(1).cast("long")))
        hits = early.drop("rank").unionByName(search(raised, leading, cells))
    return best(hits).select("item_id", "rank", "doc_id", "score")
