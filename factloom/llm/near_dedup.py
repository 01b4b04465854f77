"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each whole text becomes the set of its word shingles and a MinHash signature. A coordinate of the
   signature packs ``ROWS`` minima, so that texts which only share a common passage or common words
   seldom agree on one. Equal sets form a class; one row of a class goes on.
2. Classes are posted under each (coordinate, value). Values of one class alone are dropped. Of the
   rest each class keeps its shortest lists: two classes that agree on ``MATCHES`` coordinates share
   one of the first ``COORDINATES - MATCHES + 1`` (prefix); the longest lists are skipped, and what
   collides there is counted when a pair has come up.
3. Each list is merged by its head, its first class: (class, head) pairs come up, their collisions
   are counted over all coordinates, pairs with ``MATCHES`` or more are candidates, and a candidate
   is confirmed on the full shingle sets, made from the two whole texts. Only texts of candidates
   are fetched.
4. Lists whose classes are in one component by now are settled, as are lists of two. The others form
   a neighbourhood around the component that has most of the list. Classes outside that component
   meet all classes of the neighbourhood, in blocks of bounded size: collisions are counted over the
   inverted lists of the block, without texts; the classes of pairs with ``MATCHES`` or more come again
   with their texts, are confirmed on full sets (products of incidence, not pair by pair), and only
   links that join two components leave a task. So each pair of a kept list is confirmed, or is in one
   component anyway, or falls short of ``MATCHES``; no list, candidate or partner is capped.

At a similarity of exactly 0.8, two texts agree on a coordinate with chance 0.512; the chance that
they agree on fewer than 9 of 48 is 7.5e-7, and it falls steeply above 0.8.

The work of step 4 is the number of classes outside the main component times the number of classes of
the neighbourhood. It is spread over blocks, but grows with the square of a group of texts of which
many are not quite alike. Packed coordinates and the prefix keep such groups from forming by chance.

Cases: null and empty texts, or texts without words, have an empty set and link with nothing; a text
with fewer words than a shingle is one shingle; repeated rows fall into one class; a null id takes
part but is never the smallest id (a component of null ids only has a null id); an empty table gives
an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import forget, map_texts, saved, slices
from factloom.llm.components import connected_components

COORDINATES, ROWS, MATCHES = 48, 3, 9
#: Classes and shingles in a block of a neighbourhood (about).
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Classes whose texts are fetched by broadcasting their ids and hashes (about 80 bytes each); more are
#: fetched by a shuffle of the texts.
BROADCAST_CLASSES = 1 << 20

PASS = 2 << 20

_U = np.uint64
_WORD, _STEP, _MIX1, _MIX2 = _U(0x100000001B3), _U(0x9E3779B97F4A7C15), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_random = np.random.Generator(np.random.PCG64(20240229))
_A = _random.integers(0, 1 << 32, COORDINATES * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, COORDINATES * ROWS, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _MIX1
    x = (x ^ (x >> _U(33))) * _MIX2
    return x ^ (x >> _U(33))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text, many texts in one pass: up to ``PASS``
    letters together, since a letter takes some fifty bytes on its way."""
    half, letters = len(texts) // 2, 0
    for t in texts:
        letters += len(t or "")
        if letters > PASS and half:
            return shingle_sets(texts[:half], words) + shingle_sets(texts[half:], words)
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    flat = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[False, ~_BLANK[flat], False]))
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    owner = np.repeat(np.arange(len(start)), size)
    where = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    powers = np.cumprod(np.full(int(size.max()) + 1, _WORD))
    key = np.add.reduceat((flat[where + start[owner]].astype(np.uint64) + _U(7)) * powers[where], np.cumsum(size) - size)
    key = _mix(key ^ (size.astype(np.uint64) << _U(40)))
    # words of a text lie together: first word and number of words of each text
    begin = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    counts = np.diff(begin)
    rolled = key.copy()
    for k in range(1, words):
        rolled[:-k] = rolled[:-k] * _STEP + key[k:]
    rolled = _mix(rolled + _U(words))
    out = []
    for first, n in zip(begin[:-1].tolist(), counts.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(rolled[first : first + n - words + 1]))
        elif n:
            one = _U(n)
            with np.errstate(over="ignore"):
                for x in key[first : first + n]:
                    one = one * _STEP + x
            out.append(_mix(np.array([one ^ _STEP], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of coordinate values for each set; the coordinate's number is mixed into its value."""
    out = np.zeros((len(sets), COORDINATES), np.int64)
    sizes = np.array([len(s) for s in sets])
    busy = np.flatnonzero(sizes)
    low = 0
    ends = np.cumsum(sizes[busy])
    while low < len(busy):
        # parts of about 64 Ki shingles stay in the cache
        base = ends[low] - sizes[busy[low]]
        high = max(low + 1, int(np.searchsorted(ends, base + (1 << 16), side="right")))
        x = np.concatenate([sets[i] for i in busy[low:high]])
        x = (x ^ (x >> _U(32))).astype(np.uint32)
        at = np.r_[0, ends[low : high - 1] - base].astype(np.int64)
        for c in range(COORDINATES):
            value = np.full(high - low, c + 1, np.uint64)
            for r in range(c * ROWS, (c + 1) * ROWS):
                value = _mix(value * _STEP + np.minimum.reduceat(x * _A[r] + _B[r], at).astype(np.uint64))
            out[busy[low:high], c] = value.view(np.int64)
        low = high
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, keep: tuple[str, ...], text: str, words: int) -> DataFrame:
    """``keep``, n_shingles, key (hash of the set) and signature. A narrow map."""

    def make():
        def work(texts):
            sets = shingle_sets(texts, words)
            table = signatures(sets)
            lists = pa.ListArray.from_arrays(np.arange(0, table.size + 1, COORDINATES, dtype=np.int32), table.ravel())
            return [len(s) for s in sets], [set_key(s) for s in sets], lists

        return work

    return map_texts(docs, keep, text, [("n_shingles", T.LongType()), ("key", T.BinaryType()), ("signature", T.ArrayType(T.LongType()))], make, 2 * PASS)


def prefix_postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Rows (value, node): the posting lists that a class keeps, shortest first."""
    posts = classes.select("node", F.explode("signature").alias("value"))
    lists = posts.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    shared = posts.join(lists, "value")
    # a class has COORDINATES rows at most, so each group here is small
    kept = (
        shared.groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("length", "value"))).alias("lists"))
        # values of one class alone come first in the order and count among the prefix
        .where(F.size("lists") >= matches)
        .select("node", F.explode(F.slice("lists", F.lit(1), F.size("lists") - F.lit(matches - 1))).alias("list"))
    )
    return kept.select(F.col("list.value").alias("value"), "node")


def candidates(pairs: DataFrame, classes: DataFrame, percent: int, matches: int) -> DataFrame:
    """(a, b, collisions): pairs with ``matches`` equal coordinates and sizes that allow the similarity.

    A value holds its coordinate's number, so equal coordinates are the common values."""
    sides = classes.select("node", "n", "signature")
    rows = pairs.join(sides.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), "a")
    rows = rows.join(sides.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb")), "b")
    rows = rows.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return rows.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("collisions")).where(F.col("collisions") >= matches)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity. ``texts``: node and whole text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, 2 * PASS, also=3):
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                # a text is made into its set once in a slice
                known = dict(zip(a, part.column(2).to_pylist(), strict=True)) | dict(zip(b, part.column(3).to_pylist(), strict=True))
                sets = dict(zip(known, shingle_sets(list(known.values()), words), strict=True))
                hit = []
                for x, y in zip(a, b, strict=True):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    hit.append(100 * common >= percent * (len(sets[x]) + len(sets[y]) - common))
                yield part.filter(pa.array(hit, pa.bool_())).select([0, 1])

    rows = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, component) after further links; nodes without a link have no row."""
    if labels is None:
        return saved(connected_components(links), "labels")
    # links join components, so only components are joined again
    joined = labelled(labelled(links, labels, "a", "ca"), labels, "b", "cb")
    roots = saved(connected_components(joined, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("root")), "roots")
    moved = labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = roots.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("root").alias("component"))
    new = saved(moved.unionByName(fresh), "labels")
    forget(labels, roots)
    return new


def labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of a node column; a node without a label is its own."""
    return rows.join(labels.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal coordinates of each row of ``left`` with each of ``right``, counted over the inverted lists of
    the two: only values that both sides hold are looked at."""
    counts = np.zeros((len(left), len(right)), np.int16)
    values = np.concatenate([left.ravel(), right.ravel()])
    rows = np.concatenate([np.repeat(np.arange(len(left)), left.shape[1]), len(left) + np.repeat(np.arange(len(right)), right.shape[1])])
    order = np.lexsort((rows, values))
    values, rows = values[order], rows[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    ends = np.r_[starts[1:], len(values)]
    both = (rows[starts] < len(left)) & (rows[ends - 1] >= len(left))
    for low, high in zip(starts[both].tolist(), ends[both].tolist(), strict=True):
        cut = low + int(np.searchsorted(rows[low:high], len(left)))
        counts[rows[low:cut, None], rows[cut:high] - len(left)] += 1
    return counts


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Size of the intersection of each set of ``left`` with each of ``right``: products of the incidence of
    the shingles that both sides hold, some at a time."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int64)
    places = []
    for sets in (left, right):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        here = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[here], kind="stable")
        places.append((owner[here][order], at[here][order], len(sets)))
    for low in range(0, len(shared), columns):
        sides = []
        for owner, at, n in places:
            i, j = np.searchsorted(at, low), np.searchsorted(at, low + columns)
            side = np.zeros((n, min(columns, len(shared) - low)), np.float32)
            side[owner[i:j], at[i:j] - low] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _sides(rows: pa.Table) -> tuple[pa.Table, int, np.ndarray, np.ndarray]:
    """Rows of a block in order of side and node, how many are of side 0, sizes and signatures."""
    rows = rows.sort_by([("side", "ascending"), ("node", "ascending")]).combine_chunks()
    table = rows["signature"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return rows, int((rows["side"].to_numpy() == 0).sum()), rows["n"].to_numpy(), table


def block_candidates(rows: pa.Table, percent: int, matches: int) -> np.ndarray:
    """Pairs (of side 0, of side 1) of a block in two components with ``matches`` collisions and sizes that
    allow the similarity, as a table of truth values."""
    rows, left, n, table = _sides(rows)
    label = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
    a, b = n[:left, None], n[None, left:]
    return (label[:left, None] != label[None, left:]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (collisions(table[:left], table[left:]) >= matches)


def block_links(rows: pa.Table, words: int, percent: int, matches: int) -> list[tuple[int, int]]:
    """Links of the rows of side 0 with those of side 1 that join two components; ``rows`` have their texts."""
    pairs = block_candidates(rows, percent, matches)
    if not pairs.any():
        return []
    rows, left, _, _ = _sides(rows)
    nodes, label = rows["node"].to_pylist(), np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
    sets = shingle_sets(rows["text"].to_pylist(), words)
    one, two = np.flatnonzero(pairs.any(axis=1)), np.flatnonzero(pairs.any(axis=0))
    common = common_counts([sets[i] for i in one], [sets[left + j] for j in two])
    n = np.array([len(s) for s in sets])
    union = n[one][:, None] + n[left + two][None, :] - common
    out = []
    for i, j in zip(*np.nonzero(pairs[np.ix_(one, two)] & (100 * common >= percent * union)), strict=True):
        x, y = int(one[i]), left + int(two[j])
        if label[x] != label[y]:
            label[label == label[y]] = label[x]
            out.append((nodes[x], nodes[y]))
    return out


def neighbourhood_links(postings: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int, matches: int) -> DataFrame:
    """Links (a, b) between the components of lists that hold several.

    Blocks are met twice: first with signatures only, which tells the rows that collide with another
    component ``matches`` times, then those rows alone with their texts."""
    rows = saved(labelled(postings, labels, "node", "component"), "members")
    counts = rows.groupBy("value", "component").agg(F.count("*").alias("n"))
    # the one pair of a list of two was its head's
    main = counts.groupBy("value").agg(F.max_by("component", F.struct("n", "component")).alias("hood"), F.count("*").alias("parts"), F.sum("n").alias("length"))
    main = saved(main.where("parts > 1 AND length > 2").select("value", "hood"), "mixed")
    mixed = rows.join(main, "value").select("hood", "node", "component").distinct().join(classes.select("node", "n", "signature"), "node")
    whole = saved(mixed, "mixed-members")
    outside = F.col("component") != F.col("hood")
    parts = lambda count, shingles: F.ceil(F.greatest(F.lit(1), count / BLOCK, shingles / BLOCK_SHINGLES)).cast("long")
    sizes = whole.groupBy("hood").agg(
        parts(F.count("*"), F.sum("n")).alias("blocks"), parts(F.count_if(outside), F.sum(F.when(outside, F.col("n")).otherwise(0))).alias("outer_blocks")
    )
    sizes = saved(sizes, "sizes")
    mixed = whole.join(sizes, "hood")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spread = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    by = ("hood", "outer", "block")
    columns = ("hood", "node", "component", "n", "signature")
    left = mixed.where(outside).select(*columns, F.lit(0).alias("side"), spread("outer_blocks", 13).alias("outer"), every("blocks").alias("block"))
    right = mixed.select(*columns, F.lit(1).alias("side"), every("outer_blocks").alias("outer"), spread("blocks", 7).alias("block"))

    def colliding(rows: pa.Table) -> pa.Table:
        pairs = block_candidates(rows, percent, matches)
        rows = _sides(rows)[0]
        return rows.filter(pa.array(np.r_[pairs.any(axis=1), pairs.any(axis=0)])).select([*by, "node", "component", "n", "signature", "side"])

    kinds = "hood long, outer long, block long, node long, component long, n long, signature array<long>, side int"
    met = saved(left.unionByName(right).groupBy(*by).applyInArrow(colliding, kinds), "colliding")

    def run(rows: pa.Table) -> pa.Table:
        found = block_links(rows, words, percent, matches)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    links = saved(met.join(texts, "node").groupBy(*by).applyInArrow(run, "a long, b long"), "links")
    forget(rows, main, whole, sizes, met)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (smallest id of its component) and
    kept (it has that id). Linked: 100 * common shingles >= percent * all shingles of the two."""
    body = docs.select(docs[id_col].alias("__id"), docs[text].cast("string").alias("__text")).withColumn("hash", F.xxhash64("__text"))
    sketched = saved(sketch(body, ("__id", "hash"), "__text", words), "sketch")
    first = F.min(F.struct(F.col("__id").isNull(), "__id", "hash"))
    grouped = sketched.where("n_shingles > 0").groupBy("key").agg(F.min("__id").alias("first_id"), first.alias("source"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = saved(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    postings = saved(prefix_postings(classes, matches), "postings")
    heads = saved(postings.groupBy("value").agg(F.min("node").alias("head")), "heads")
    pairs = postings.join(heads, "value").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    found = saved(candidates(pairs, classes, percent, matches), "candidates")
    # whole texts of the classes that collide with others, one row a class
    wanted = saved(classes.join(postings.select("node").distinct(), "node").select("node", F.col("source.__id").alias("want_id"), F.col("source.hash").alias("want_hash")), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted
    rows = body.join(few, (F.col("hash") == F.col("want_hash")) & F.col("__id").eqNullSafe(F.col("want_id")))
    # repeated rows give a class's text more than once
    texts = saved(rows.groupBy("node").agg(F.first("__text").alias("text")), "texts")
    forget(heads, wanted)

    # the best head of each class first; what it joins need not be confirmed again
    best = found.groupBy("a").agg(F.max_by("b", F.struct("collisions", -F.col("b"))).alias("b"))
    links = saved(confirmed(best, texts, words, percent), "links")
    labels = extended(None, links)
    rest = labelled(labelled(found.join(best, ["a", "b"], "left_anti"), labels, "a", "ca"), labels, "b", "cb").where("ca <> cb")
    more = saved(confirmed(rest, texts, words, percent), "links")
    labels = extended(labels, more)
    across = neighbourhood_links(postings, labels, classes, texts, words, percent, matches)
    labels = extended(labels, across)
    forget(postings, found, texts, links, more, across)

    named = saved(labelled(classes.select("key", "node", "first_id"), labels, "node", "component"), "named")
    first = saved(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "first")
    named = named.join(first, "component").select("key", "component_id")
    forget(classes, labels)
    out = sketched.select("__id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("__id")).otherwise(F.col("component_id")).cast(body.schema["__id"].dataType)
    return out.select(F.col("__id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))
