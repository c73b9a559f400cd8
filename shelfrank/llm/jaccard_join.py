"""Operator 2: near-copies by a size-aware heavy-light join on word shingles.

Two documents link when their sets of 5-word shingles have a Jaccard similarity
of 0.75 or more. A set of size n that links shares a shingle among its first
n - ceil(0.75 n) + 1 in any fixed global order; rare shingles come first in it.

* Small sets list every 2-subset of one more of these shingles and join on the
  subsets: a link shares three shingles at least, and one more in the prefix
  makes two of them meet.
* Large sets are found by scanning the inverted lists of single shingles. Small
  sets that are large enough to link with a large one are put in these lists
  too.

The boundary is the size up to which listing subsets costs less than scanning.
Equal sets are one class. A list isn't turned into all its pairs: first its
members are held against one of them, the links make components, and only
members of different components go on, the last time all of them.

A pair that shares a key is first held against the two sets' parity bits, one
for each hash bucket: buckets of odd difference are shingles that only one of
the two has, so too many of them rule the link out. Texts are read for the rest;
bits of fixed number that stand for the ids asked for keep nearly all other texts
out of the shuffles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import maybe_among, mix64, python_ready, written
from shelfrank.llm.components import components

WORDS = 5
#: Frequent shingles whose order is kept, at most (a broadcast of 8 bytes each).
FREQUENT = 1 << 18
#: A shingle counts as frequent where it occurs so often in a run of shingles of one task.
LOCAL_COUNT, LOCAL_RUN = 3, 1 << 19
#: Sets that a task remembers, to count copies once (20 MB).
MOST_SEEN = 1 << 17
#: Lists of at least so many known members are spread over several tasks.
LONG_LIST, SPREAD = 4096, 16
#: Rounds of comparing with one member of a list before all are compared.
PIVOT_ROUNDS = 2
#: Largest boundary that is tried.
MOST_SMALL = 64

_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit shingles of a text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six white space characters
    if not words:
        return np.empty(0, np.uint64)
    c = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    if len(c) < WORDS:
        h = np.full(1, len(c), np.uint64)
        for v in c:
            h = mix64(h * _MUL + v)
        return h
    k = len(c) - WORDS + 1
    h = c[:k].copy()
    for j in range(1, WORDS):
        h = h * _MUL + c[j : j + k]
    return distinct(mix64(h))[0]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of a non-empty array, and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x)))


def parities(s: np.ndarray) -> bytes:
    """A bit for each hash bucket, set where the bucket holds an odd number of the
    set's shingles. The buckets are the next power of two from the set's size on."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_linked(n_a: int, p_a: bytes, n_b: int, p_b: bytes) -> bool:
    """False if the parities rule a link out: two sets that link differ in a seventh
    of their shingles at most, and each bucket of odd difference takes one of these."""
    if len(p_a) > len(p_b):
        p_a, p_b = p_b, p_a
    a, b, bits = int.from_bytes(p_a, "little"), int.from_bytes(p_b, "little"), 8 * len(p_b)
    while bits > 8 * len(p_a):  # half the buckets: each is the sum of two
        bits //= 2
        b = (b >> bits) ^ (b & ((1 << bits) - 1))
    return 7 * (a ^ b).bit_count() <= n_a + n_b


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import xxhash

    h = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def needed(n: int) -> int:
    """Least overlap of a set of ``n`` with any set that it links with."""
    return (3 * n + 3) // 4


def linked(overlap: int, n_a: int, n_b: int) -> bool:
    return 100 * overlap >= 75 * (n_a + n_b - overlap)


def in_order(s: np.ndarray, frequent: np.ndarray, place: np.ndarray, by_place: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``take`` of a set in the global order: shingles that aren't frequent
    by hash, then frequent ones by count (``by_place``); and the place among the frequent, or -1."""
    at = np.searchsorted(frequent, s) if len(frequent) else np.zeros(len(s), np.int64)
    at[at == len(frequent)] = 0
    known = frequent[at] == s if len(frequent) else np.zeros(len(s), bool)
    rare = s[~known]
    if len(rare) >= take:
        return rare[:take], np.full(take, -1)
    places = np.sort(place[at[known]])[: take - len(rare)]
    return np.concatenate([rare, by_place[places]]), np.concatenate([np.full(len(rare), -1), places])


def _signed(a) -> pa.Array:
    return pa.array(np.asarray(a, np.uint64).view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: id, set size, set id and parities. Kind 1: shingles frequent in a run and their counts."""
    seen, run, size = set(), [], 0

    def counted():
        u, c = distinct(np.concatenate(run))
        u, c = u[c >= LOCAL_COUNT], c[c >= LOCAL_COUNT]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int32()), _signed(u), pa.array(c.astype(np.int64)), pa.nulls(len(u), pa.binary())], names=names)

    names = ["kind", "k", "n", "h1", "h2", "odd"]
    for b in batches:
        out = []
        for text in b.column(1):
            s = shingle_set(text.as_py())
            i = set_id(s)
            out.append((len(s), *i, parities(s) if len(s) else None))
            if len(s) and i[0] not in seen:  # copies in a task count once
                if len(seen) > MOST_SEEN:
                    seen.clear()
                seen.add(i[0])
                run.append(s)
                size += len(s)
                if size >= LOCAL_RUN:
                    yield counted()
                    run, size = [], 0
        n, h1, h2, odd = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(out), np.int32)), b.column(0), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(odd, pa.binary())], names=names)
    if run:
        yield counted()


def _frequent(profile: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted by value), their places in order of count, the counts."""
    counts = written(profile.where("kind = 1").groupBy("h1").agg(F.sum("h2").alias("c")), "jaccard-frequent")
    step = F.floor(F.log2("c") * 16).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect(), key=lambda r: -r["s"]):
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["low"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows = counts.where(F.col("c") >= least).toPandas()  # at most FREQUENT rows
    token, c = rows["h1"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)
    order = np.argsort(token)
    token, c = token[order], c[order]
    place = np.empty(len(token), np.int64)
    place[np.lexsort((token, c))] = np.arange(len(token))
    return token, place, c


def boundary(sizes: dict[int, int], counts: np.ndarray, total: int) -> int:
    """Sets below it list 2-subsets. Listing costs a key for each subset; scanning
    costs a key and the members met in its list, their mean taken over all shingles."""
    met = float((counts.astype(float) ** 2).sum()) / max(1, total)
    best = 0
    for n in range(1, MOST_SMALL):
        p = n - needed(n) + 1
        if sizes.get(n, 0) and p * (p + 1) / 2 > p * (1 + met):
            break
        best = n
    return best + 1


@functools.cache
def _twos(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both places of every 2-subset of ``n`` (at most ``MOST_SMALL``)."""
    return np.triu_indices(n, 1)


def _postings(small: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each set: subsets of small ones, single shingles of large ones."""
    frequent, place, counts = shared.value
    count_at, by_place = np.empty(len(counts), np.int64), np.empty(len(frequent), np.uint64)
    count_at[place], by_place[place] = counts, frequent
    seen = set()
    for b in batches:
        keys, salts, ids, ns, poss = [], [], [], [], []

        def put(k, salt, doc, n, pos):
            keys.append(k)
            salts.append(salt)
            ids.append(np.full(len(k), doc, np.int64))
            ns.append(np.full(len(k), n, np.int32))
            poss.append(pos)

        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = shingle_set(text.as_py())
            n = len(s)
            if doc is None or not n or (i := set_id(s)) in seen:
                continue
            if len(seen) > MOST_SEEN:
                seen.clear()
            seen.add(i)
            p = n - needed(n) + 1
            first, where = in_order(s, frequent, place, by_place, min(n, p + 1))
            if n < small and len(first) > 1:
                one, two = _twos(len(first))
                k = mix64(mix64(first[one]) * _MUL + first[two])
                put(k, np.zeros(len(k), np.int32), doc, n, np.zeros(len(k), np.int32))
            if 4 * n >= 3 * small:
                k, w = first[:p], where[:p]
                often = np.zeros(len(k), bool)
                often[w >= 0] = count_at[w[w >= 0]] >= LONG_LIST
                put(k, np.where(often, 1 + doc % SPREAD, 0).astype(np.int32), doc, n, np.arange(len(k), dtype=np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), *(pa.array(np.concatenate(x)) for x in (salts, ids, ns, poss))], names=["key", "salt", "k", "n", "pos"])


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key occurs again, and all rows of long lists."""
    last = None  # the last row so far, and whether it was given out
    given = True
    for b in batches:
        if not b.num_rows:
            continue
        key, salt = b.column(0).to_numpy(), b.column(1).to_numpy()
        same = key[1:] == key[:-1]
        keep = salt > 0
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and last.column(0)[0].as_py() == key[0]:
            keep[0] = True
            if not given:
                yield last
        yield b.filter(pa.array(keep))
        last, given = b.slice(b.num_rows - 1), bool(keep[-1])


def _compare_parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [may_be_linked(*x) for x in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {}
    for b in batches:
        out = []
        for a, c, ta, tc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            text = ta.as_py()
            if a not in held or held[a][0] != text:
                held = {a: (text, shingle_set(text))}
            x, y = held[a][1], shingle_set(tc.as_py())
            if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                out.append((a, c))
        cols = list(zip(*out, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["a", "b"])


def _may_link(prefix_a: str, prefix_b: str):
    """Sizes are near enough, and the overlap can be reached if this key is the first shared one."""
    n_a, n_b, p_a, p_b = (F.col(f"{prefix_a}n"), F.col(f"{prefix_b}n"), F.col(f"{prefix_a}pos"), F.col(f"{prefix_b}pos"))
    return (4 * n_a >= 3 * n_b) & (4 * n_b >= 3 * n_a) & (7 * F.least(n_a - p_a, n_b - p_b) >= 3 * (n_a + n_b))


class _Links:
    """Components of the verified links so far (``comps``; none before the first ``add``)."""

    def __init__(self, docs: DataFrame, odds: DataFrame, edges: DataFrame):
        self.docs, self.odds, self.edges, self.comps = docs, odds, edges, None

    def add(self, pairs: DataFrame) -> None:
        p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        sets = [self.odds.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"o_{x}")) for x in "ab"]
        near = python_ready(p.join(sets[0], "a").join(sets[1], "b").select("a", "b", "n_a", "o_a", "n_b", "o_b"))
        p = written(near.mapInArrow(_compare_parities, "a long, b long").distinct(), "jaccard-near")  # ids may repeat
        ids = written(p.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "jaccard-ids")
        texts = written(self.docs.where(maybe_among(F.col("k"), ids)).join(ids, "k", "left_semi"), "jaccard-texts")  # of these pairs only
        both = p.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
        found = written(python_ready(both.select("a", "b", "ta", "tb")).mapInArrow(_verify, "a long, b long"), "jaccard-edges")
        self.comps = components(self.edges.unionByName(found))
        self.edges = self.comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))


def _open_rows(lists: DataFrame, comps: DataFrame | None, order: Column | None = None) -> DataFrame:
    """Members of lists that hold several components, with their component, and
    with the member of the list that is first by ``order``, if given (``v_``)."""
    if comps is None:
        rows = lists.withColumn("comp", F.col("k"))
    else:
        rows = lists.join(comps, lists["k"] == comps["node"], "left").select("key", "k", "n", "pos", F.coalesce("comp", "k").alias("comp"))
    pivot = [] if order is None else [F.min(F.struct(order.alias("o"), "k", "n", "pos", "comp")).alias("v")]
    open_keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *pivot).where("lo < hi")
    open_keys = open_keys.select("key", *[F.col(f"v.{c}").alias(f"v_{c}") for c in ("k", "n", "pos", "comp") if pivot])
    return written(rows.join(open_keys, "key"), "jaccard-open")


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("comp") != F.col("v_comp")) & _may_link("", "v_")).select(F.col("k").alias("a"), F.col("v_k").alias("b"))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """What is left: members of a list that are in different components still."""
    other = rows.select("key", *[F.col(c).alias(f"o_{c}") for c in ("k", "n", "pos", "comp")])
    return rows.join(other, "key").where((F.col("comp") < F.col("o_comp")) & _may_link("", "o_")).select(F.col("k").alias("a"), F.col("o_k").alias("b"))


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, class_id, component_id`` for every row.

    ``class_id``: the smallest id of those with an equal set. Null, empty and
    white texts have no shingles and link with nothing. Rows that share an id are
    one node with the links of all its texts; rows with a null id get a null
    component. An empty table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    slim = python_ready(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")))
    profile = written(slim.mapInArrow(_profile, "kind int, k long, n int, h1 long, h2 long, odd binary"), "jaccard-profile")
    rows = profile.where("kind = 0")
    classes = rows.where("n > 0 and k is not null").groupBy("h1", "h2").agg(F.min("k").alias("rep"))
    member = written(rows.join(classes, ["h1", "h2"], "left").select("k", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("k")).alias("rep")), "jaccard-members")

    token, place, counts = _frequent(profile)
    sizes = {r["n"]: r["c"] for r in rows.where((F.col("n") > 0) & (F.col("n") < MOST_SMALL)).groupBy("n").agg(F.count("*").alias("c")).collect()}
    total = rows.agg(F.sum("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast((token, place, counts))
    postings = slim.mapInArrow(functools.partial(_postings, boundary(sizes, counts, total), shared), "key long, salt int, k long, n int, pos int")
    dealt = postings.repartition("key", "salt").sortWithinPartitions("key")
    lists = written(dealt.mapInArrow(_shared_keys, "key long, salt int, k long, n int, pos int").select("key", "k", "n", "pos"), "jaccard-lists")

    # from here on only sets that share a key with another one
    nodes = member.where("n > 0 and k is not null").select("k", "rep").distinct()
    lists = written(lists.join(nodes, "k").select("key", F.col("rep").alias("k"), "n", "pos").distinct(), "jaccard-class-lists")
    wanted = written(lists.select("k").distinct(), "jaccard-wanted")
    odds = written(rows.where("n > 0").select("k", "n", "odd").join(wanted, "k", "left_semi"), "jaccard-odds")
    same_id = nodes.groupBy("k").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    links = _Links(slim, odds, same_id)
    for r in range(PIVOT_ROUNDS):
        lists = _open_rows(lists.select("key", "k", "n", "pos"), links.comps, F.col("k") if r == 0 else F.xxhash64("key", "k", F.lit(r)))  # a closed list stays closed
        links.add(_pivot_pairs(lists))
    links.add(_all_pairs(_open_rows(lists.select("key", "k", "n", "pos"), links.comps)))
    comps = links.comps
    out = member.join(comps, member["rep"] == comps["node"], "left")
    return out.select(F.col("k").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, with their columns.

    Of rows that share an id one stays; rows with a null id all stay, as no link
    names them."""
    found = jaccard_components(docs, key=key, text=text)
    found = written(found.select(F.col(key).alias("j_key"), (F.col(key) == F.col("component_id")).alias("j_first")), "jaccard-kept")
    # one row an id; ``n`` is over 1 where several rows share it
    first = found.where("j_first").groupBy("j_key").agg(F.count("*").alias("n"))
    # an id with one row only, the first of its component, isn't asked about: its row stays where it is
    asked = found.where("j_key is not null").groupBy(F.col("j_key").alias("k")).agg(F.every("j_first").alias("first"), F.count("*").alias("n"))
    asked = written(asked.where("not first or n > 1").select(F.col("k").cast("long").alias("k")), "jaccard-asked")
    maybe = maybe_among(docs[key].cast("long"), asked)
    some = docs.where(docs[key].isNotNull() & maybe)
    once = some.join(first.where("n = 1"), some[key] == F.col("j_key"), "left_semi")
    shared = some.join(first.where("n > 1"), some[key] == F.col("j_key"), "left_semi").dropDuplicates([key])
    return docs.where(docs[key].isNotNull() & ~maybe).unionByName(once).unionByName(shared).unionByName(docs.where(docs[key].isNull()))
