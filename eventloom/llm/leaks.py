"""Held-out items inside a training corpus.

The corpus is read in shards of bounded size. A word that is an item's but for a slip of the keys gets that
word's number, and each shard becomes an FM-index over word numbers; every short phrase of every item is
searched backwards in it, occurrences are located through sampled suffix positions, and occurrences of an
item that lie along one diagonal of a document are aligned exactly, word by word. Overlapping stretches
merge into removal spans.

No stretch that accepted() takes is lost by the search while its words keep their order: of L words (18 or more) at most
0.22 L differ, which cuts the rest into at most 0.22 L + 1 runs, and runs of 0.78 L words in all hold at
least 0.78 L - 2 (0.22 L + 1) = 0.34 L - 2, so 4 or more, whole phrases of three. REACH only limits how far beyond its
outermost phrase a stretch's ends are followed; what lies further out could not have been needed to accept it.

Only the items are sent to every task, in blocks of bounded size, each searched in a pass of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.fmindex import FMIndex
from eventloom.llm.words import close, words

STRETCH = 18
SEED = 3
SHARD_WORDS = 400_000
BAND = 8
REACH = 45
SEEDS_NEEDED = 4
HIT, TOLD = 0.78, 0.7
#: Items are searched in blocks of about so many words, and a worker remembers so many words' numbers.
BLOCK_WORDS = 200_000
CACHE_WORDS = 1_000_000


def _less(w: str, k: int) -> set[str]:
    """The word with up to k letters left out."""
    out = {w}
    for _ in range(k):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


def _slips(w: str) -> int:
    """How many slips of the keys a word may hold; see words.close."""
    return 0 if len(w) < 4 or w.isdigit() else 2 if len(w) >= 9 else 1


class Items:
    """The held-out items: their words, which of them are telling, and all their phrases of SEED words.

    common: the words that are not telling, where they were counted over more items than these.
    """

    def __init__(self, rows: list[tuple[int, str | None]], seed: int = SEED, common: set[str] | None = None):
        self.ids = [r[0] for r in rows]
        self.words = [words(r[1]) for r in rows]
        spread = Counter(w for ws in self.words for w in set(ws))
        if common is None:
            few = few_items(len(rows))
            common = {w for w, n in spread.items() if n > few}
        #: names and figures: digits, and words that few items have
        self.telling = [np.array([w.isdigit() or w not in common for w in ws], bool) for ws in self.words]
        self.number = {w: i + 2 for i, w in enumerate(sorted(spread))}
        self.code = [np.array([self.number[w] for w in ws], np.int64) for ws in self.words]
        self.lacking: dict[str, list[str]] = {}
        for w in self.number:
            for x in _less(w, _slips(w)) if _slips(w) else ():
                self.lacking.setdefault(x, []).append(w)
        self.cache: dict[str, tuple[int, ...]] = {}
        seeds, item, place = [], [], []
        for k, code in enumerate(self.code):
            for j in range(len(code) - seed + 1):
                seeds.append(code[j : j + seed]), item.append(k), place.append(j)
        seeds = np.array(seeds, np.int64).reshape(-1, seed)
        self.seeds, inverse = np.unique(seeds, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        order = np.argsort(inverse, kind="stable")
        self.item, self.place = np.array(item, np.int64)[order], np.array(place, np.int64)[order]
        self.starts = np.searchsorted(inverse[order], np.arange(len(self.seeds) + 1))

    def codes(self, w: str) -> tuple[int, ...]:
        """Numbers of the item words that a word is, first the one it is searched as: itself, or the first of those it is but for a slip; (1,) for none."""
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            near: set[str] = set()
            if k := _slips(w):
                for x in _less(w, k):
                    near.update(v for v in self.lacking.get(x, ()) if v != w and close(v, w))
            mine = self.number.get(w)
            got = self.cache[w] = (*([mine] if mine else []), *sorted(self.number[v] for v in near)) or (1,)
        return got


def few_items(n: int) -> int:
    """A word is telling in at most so many of n items."""
    return max(2, n // 50)


def align(same: np.ndarray, telling: np.ndarray, low: int | None = None, high: int | None = None) -> tuple[int, int, int, int, int, int, int]:
    """Best local alignment: item range, document range, matched words, telling words in range and matched.

    same[i, j]: whether document word j is item word i, or it but for a slip. A telling word that differs
    costs more than a common one, so a passage of the same build with other names and figures falls apart
    into short pieces. low and high bound the diagonals (document place less item place) that are looked at.
    """
    n, m = same.shape
    low, high = -n if low is None else low, m if high is None else high
    score, start = [0.0] * (m + 1), [(0, 0, 0)] * (m + 1)
    best, best_at = 0.0, None
    told_at = telling.tolist()
    for i in range(1, n + 1):
        row = same[i - 1].tolist()
        miss, skip = (-3.0, -2.0) if told_at[i - 1] else (-1.0, -0.8)
        new, new_start = [0.0] * (m + 1), [(0, 0, 0)] * (m + 1)
        left, left_o = 0.0, (0, 0, 0)
        for j in range(max(1, i + low), min(m, i + high) + 1):
            was = score[j - 1]
            if row[j - 1]:
                o = start[j - 1] if was > 0.0 else (i - 1, j - 1, 0)
                s, o = was + 1.0, (o[0], o[1], o[2] + 1)
            else:
                s, o = was + miss, start[j - 1]
            if score[j] + skip > s:
                s, o = score[j] + skip, start[j]
            if left - 0.7 > s:
                s, o = left - 0.7, left_o
            if s > 0.0:
                new[j], new_start[j] = s, o
                if s > best:
                    best, best_at = s, (o[0], i, o[1], j, o[2])
                left, left_o = s, o
            else:
                left = 0.0
        score, start = new, new_start
    if best_at is None:
        return 0, 0, 0, 0, 0, 0, 0
    i0, i1, j0, j1, hit = best_at
    at = np.flatnonzero(telling[i0:i1]) + i0
    free, found = np.ones(j1 - j0, bool), 0
    for i in at.tolist():
        j = np.flatnonzero(same[i, j0:j1] & free)
        if len(j):
            free[j[0]] = False
            found += 1
    return i0, i1, j0, j1, hit, len(at), found


def accepted(i0: int, i1: int, hit: int, told: int, found: int, stretch: int = STRETCH) -> bool:
    """A stretch of the item's words, most of them there, telling ones included."""
    return i1 - i0 >= stretch and hit >= HIT * (i1 - i0) and found >= TOLD * told


def may_hold(met: np.ndarray, telling: np.ndarray, stretch: int) -> bool:
    """Whether any stretch of the item could be accepted if all of its words that were met anywhere in the band stood in order.

    A bound: what accepted() takes always passes.
    """
    n = len(met)
    if n < stretch or met.sum() < HIT * stretch:
        return False
    if n > 2000:
        return True
    a, b = np.zeros(n + 1), np.zeros(n + 1)
    np.cumsum(met - HIT, out=a[1:])
    np.cumsum(telling * (met - TOLD), out=b[1:])
    m = n - stretch + 1
    # ends in rows, beginnings in columns; at and below the diagonal they are a stretch apart
    ok = a[stretch:, None] >= a[None, :m] - 1e-9
    ok &= b[stretch:, None] >= b[None, :m] - 1e-9
    return bool(np.tril(ok).any())


def search_shard(items: Items, docs: list[list[str]], stretch: int = STRETCH) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, first and last word in the document, first and last word in the item) of every leak in a shard."""
    known = items.cache.get
    all_codes = [[known(w) or items.codes(w) for w in ws] for ws in docs]
    flat = np.array([c[0] for cs in all_codes for c in (*cs, (1,))], np.int64)
    size = np.array([len(cs) + 1 for cs in all_codes])
    begin = np.cumsum(size) - size
    # words that are several item words but for a slip, and those others
    several = [(begin[k] + j, c) for k, cs in enumerate(all_codes) for j, c in enumerate(cs) if len(c) > 1]
    several_at = np.array([x for x, _ in several], np.int64)
    # of a run of words that no item has, one is enough to keep its neighbours apart
    keep = np.flatnonzero((flat != 1) | (np.r_[0, flat[:-1]] != 1))
    doc_of = np.repeat(np.arange(len(docs)), size)[keep]
    place = (np.arange(len(flat)) - np.repeat(begin, size))[keep]
    code = flat[keep]
    index = FMIndex(np.r_[code, 0])
    lo, hi = index.search(items.seeds)
    size = hi - lo
    if not size.any():
        return []
    row = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    at = index.locate(row)
    seed = np.repeat(np.arange(len(size)), size)
    # a phrase that several items have answers for each of them
    fan = items.starts[seed + 1] - items.starts[seed]
    use = np.repeat(items.starts[seed] - np.r_[0, np.cumsum(fan)[:-1]], fan) + np.arange(fan.sum())
    at = np.repeat(at, fan)
    d, p = doc_of[at], place[at]
    it, ip = items.item[use], items.place[use]
    diag = p - ip
    order = np.lexsort((p, diag, it, d))
    d, p, it, ip, diag = d[order], p[order], it[order], ip[order], diag[order]
    k = SEEDS_NEEDED - 1
    if len(d) <= k:
        return []
    near = np.flatnonzero((d[k:] == d[:-k]) & (it[k:] == it[:-k]) & (diag[k:] - diag[:-k] <= BAND))
    inside = np.bincount(near, minlength=len(d) + 1) - np.bincount(near + k + 1, minlength=len(d) + 1)
    hit = np.flatnonzero(np.cumsum(inside[: len(d)]) > 0)
    if not len(hit):
        return []
    d, it, p, ip, diag = d[hit], it[hit], p[hit], ip[hit], diag[hit]
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (diag[1:] - diag[:-1] > BAND)])
    out: list[tuple] = []
    there = np.zeros(len(items.number) + 2, bool)
    ends = np.r_[cut[1:], len(d)]
    spans = zip(d[cut].tolist(), it[cut].tolist(), *(f.reduceat(x, cut).tolist() for f, x in ((np.minimum, p), (np.maximum, p), (np.minimum, ip), (np.maximum, ip))), diag[cut].tolist(), diag[ends - 1].tolist())
    for doc, item, p0, p1, i0, i1, low, high in spans:
        iw, b = items.code[item], int(begin[doc])
        first, last = max(0, p0 - REACH), min(len(all_codes[doc]), p1 + REACH)
        i_first, i_last = max(0, i0 - REACH), min(len(iw), i1 + REACH)
        near, want, tell = flat[b + first : b + last], iw[i_first:i_last], items.telling[item][i_first:i_last]
        more = [several[k] for k in range(*np.searchsorted(several_at, (b + first, b + last)).tolist())]
        others = [other for _, c in more for other in c[1:]]
        # first whether the words are there at all, then whether they are in the band
        there[near], there[others] = True, True
        met = there[want]
        there[near], there[others] = False, False
        if not may_hold(met, tell, stretch):
            continue
        same = want[:, None] == near[None, :]
        for at, c in more:
            for other in c[1:]:
                same[:, at - b - first] |= want == other
        shift = i_first - first
        same = np.tril(np.triu(same, low - 2 * BAND + shift), high + 2 * BAND + shift)
        if may_hold(same.any(1), tell, stretch):
            out += [(doc, item, first + a, first + b, i_first + x, i_first + y) for a, b, x, y in stretches(same, tell, low - 2 * BAND + i_first - first, high + 2 * BAND + i_first - first, stretch)]
    return list(set(out))


def stretches(same: np.ndarray, telling: np.ndarray, low: int, high: int, stretch: int) -> list[tuple[int, int, int, int]]:
    """(document range, item range) of the accepted alignments; the parts before and after one are searched again."""
    todo, out = [(0, same.shape[1])], []
    while todo:
        a, b = todo.pop()
        if b - a < stretch // 2 or not may_hold(same[:, a:b].any(1), telling, stretch):
            continue
        i0, i1, j0, j1, hit, told, found = align(same[:, a:b], telling, low - a, high - a)
        if i1 - i0 < stretch // 2:
            continue
        if accepted(i0, i1, hit, told, found, stretch):
            out.append((a + j0, a + j1, i0, i1))
        todo += [(a, a + j0), (a + j1, b)]
    return out


def leaked_passages(
    documents: DataFrame, held_out: DataFrame, *, doc_id: Column, text: Column, item_id: Column, item_text: Column, stretch: int = STRETCH, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, item_first, item_last): every stretch of an item in a document.

    Word numbers count the document's plain words from 0, the last one exclusive. A stretch is at least
    ``stretch`` item words, word for word or lightly altered. Null or blank texts leak nothing; an item
    shorter than a stretch can't leak; a document or item row that comes twice gives its rows once;
    empty tables give no rows. Whole texts are read; documents are never gathered anywhere.
    """
    rows = held_out.select(item_id.cast("long").alias("item_id"), item_text.alias("text")).dropna().distinct()
    n, n_words = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    blocks = math.ceil(n_words / block_words)
    if blocks > 1:
        # words of more than one in fifty items are at most fifty times as many as an item has
        common = {r[0] for r in rows.mapInArrow(_words_of, "w string").groupBy("w").count().where(F.col("count") > few_items(n)).select("w").collect()}
        parts = [Items([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()], common=common) for k in range(blocks)]
    else:
        parts = [Items([tuple(r) for r in rows.orderBy("item_id").collect()])]
    texts = documents.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).dropna()
    out = None
    for items in parts:
        one = _search(texts, items, stretch, shard_words)
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([w for t in b.column(1).to_pylist() for w in set(words(t))], pa.string())], names=["w"])


def _search(texts: DataFrame, items: Items, stretch: int, shard_words: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "first_word", "last_word", "item_first", "item_last")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its = shared.value
        ids: list[int] = []
        docs: list[list[str]] = []
        held = 0

        def flush():
            got = search_shard(its, docs, stretch)
            cols = [[ids[g[0]] for g in got], [its.ids[g[1]] for g in got], *[[g[i] for g in got] for i in range(2, 6)]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                if len(ws) >= stretch // 2:
                    ids.append(i), docs.append(ws)
                    held += len(ws)
                if held >= shard_words:
                    yield flush()
                    ids, docs, held = [], [], 0
        if docs:
            yield flush()

    return texts.mapInArrow(run, "doc_id long, item_id long, first_word long, last_word long, item_first long, item_last long")


def removal_spans(passages: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, n_items): overlapping stretches of a document merged."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("first_word", "last_word")
    reach = F.max("last_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = passages.withColumn("new", F.when(reach.isNull() | (F.col("first_word") > reach), 1).otherwise(0))
    runs = starts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.countDistinct("item_id").alias("n_items")).drop("run")
