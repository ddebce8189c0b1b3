"""Documents that hold passages of held-out items (problem 8).

The items' word triples form a BM25 inverted index, with the largest weight of
each block of a posting list kept beside it. Every passage of every document is
a query. A document's triples are looked up in the index's sorted codes at once;
passages whose triples can't reach the threshold together end there. For the
others block-max WAND walks the posting lists and skips items whose upper bound
stays below the threshold, so that all items above it are found and few others
are scored. Each item found is verified: the matching words are chained to
stretches in the order of both texts, small edits within a stretch are bridged,
and the best two stretches must hold `SHARE` of the item's words. Where an item
tells question and answer apart, `overlaps` gives the share of each.

The index is broadcast in blocks of at most `ITEMS_PER_BLOCK` items; more items
mean more passes over the documents, never a larger broadcast, and each block is
dropped before the next is sent. A worker builds the index of a block once.

Defined results: null and empty texts and items hold nothing. Items of one or
two words are indexed by these words and must stand as they are. Repeated rows
give one row. Markup, marks, letter case and line ends don't count.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.strings import edits
from ledgerloom.tables import checkpoint, spread, table

#: The share of an item's words that must stand in the document.
SHARE = 0.4
#: Stretches that may be added up.
STRETCHES = 2
GRAM = 3
#: Words of a passage and between the beginnings of two.
PASSAGE, STRIDE = 120, 60
#: Words that an edit may add, drop or change between two matches of a stretch.
GAP = 7
#: Words that a stretch must have, or all of a shorter item.
STRETCH = 5
#: Entries of a posting list whose largest weight is kept, a power of two.
SHIFT = 4
BLOCK = 1 << SHIFT
#: Behind the last item of a posting list.
END = 1 << 60
FIRST = itemgetter(0)
ITEMS_PER_BLOCK = 20_000

WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"<[^<>]{1,80}>|&[a-z]{2,6};|[​‌‍­]")
HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>*#|]*(?=[^\W\d_])")
ANSWER = re.compile(r"(?:^|[\s.?!])(?:answer|a|correct answer|solution)\s*:", re.I)


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case, without markup, and joined where a line end parts them."""
    if not text:
        return []
    if "\n" in text:
        text = HYPHEN.sub("", text)
    if "<" in text or "&" in text or not text.isascii():
        text = unicodedata.normalize("NFKD", MARKUP.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    return WORD.findall(text.lower())


def grams(words: list[str]) -> list[str]:
    """The word triples; of a text of one or two words these alone."""
    size = min(GRAM, len(words))
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


def question_words(text: str | None) -> int | None:
    """How many of an item's words belong to its question; None where it doesn't tell question and answer apart."""
    m = ANSWER.search(text or "")
    count = len(words_of(text[: m.start() + 1])) if m else 0
    return count if m and 0 < count < len(words_of(text)) else None


class Index:
    """BM25 postings of the items' word triples with block maxima.

    Where the items are a block of more, `total`, `mean` and `holders` are the number of all items,
    their mean length, and how many of them hold a triple (one item if it isn't named).
    """

    def __init__(self, items: list[tuple[int, str]], total: int | None = None, mean: float | None = None, holders: dict[str, int] | None = None):
        self.words = [words_of(t) for _, t in items]
        self.questions = [question_words(t) for _, t in items]
        self.ids = [i for i, _ in items]
        places: dict[str, dict[int, list[int]]] = defaultdict(dict)
        for n, words in enumerate(self.words):
            for at, gram in enumerate(grams(words)):
                places[gram].setdefault(n, []).append(at)
        total = len(items) if total is None else total
        self.mean = sum(map(len, self.words)) / max(1, total) if mean is None else mean
        self.rare = math.log(1 + (total - 0.5) / 1.5)
        plain: list[list[float]] = [[] for _ in items]
        idfs = {}
        for gram, where in places.items():
            held = len(where) if holders is None else holders.get(gram, 1)
            idfs[gram] = math.log(1 + (total - held + 0.5) / (held + 0.5))
            for n, at in where.items():
                plain[n].append(self.bm25(idfs[gram], len(at), len(self.words[n])))
        least = [self.threshold(n, weights) for n, weights in enumerate(plain)]
        #: Per gram the items, their weights, and per block the largest weight and the last item, each with an end mark; and the largest weight of all.
        self.postings: list[tuple[list[int], list[float], list[float], list[int], float]] = []
        self.number: dict[str, int] = {}
        for gram, where in places.items():
            docs = sorted(where)
            weights = [self.bm25(idfs[gram], len(where[n]), len(self.words[n])) / least[n] for n in docs]
            tops = [max(weights[k : k + BLOCK]) for k in range(0, len(docs), BLOCK)]
            ends = [docs[min(k + BLOCK, len(docs)) - 1] for k in range(0, len(docs), BLOCK)]
            self.number[gram] = len(self.postings)
            self.postings.append(([*docs, END], [*weights, 0.0], [*tops, 0.0], [*ends, END], max(tops)))
        self.tops = np.array([p[4] for p in self.postings] or [0.0])
        # The postings once more, flat, to bound passages at once.
        self.first = np.concatenate([[0], np.cumsum([len(p[0]) - 1 for p in self.postings])]).astype(np.int64)
        self.flat_items = np.array([n for p in self.postings for n in p[0][:-1]], np.int64)
        self.flat_weights = np.array([w for p in self.postings for w in p[1][:-1]])
        self.code_grams()

    def code_grams(self) -> None:
        """Words, pairs and triples of the items as sorted integer codes, for looking up whole documents."""
        self.word_ids = {w: k for k, w in enumerate(sorted({w for words in self.words for w in words}), 1)}
        self.base = len(self.word_ids) + 1
        coded = [np.array([self.word_ids[w] for w in words], np.int64) for words in self.words]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[c[:-1] * self.base + c[1:] for c in coded]]))
        self.item_pairs = [np.searchsorted(self.pairs, c[:-1] * self.base + c[1:]).tolist() for c in coded]
        #: Per word and per pair the number of the gram of an item that is no longer, else -1.
        self.word_gram, self.pair_gram = np.full(self.base, -1, np.int64), np.full(len(self.pairs), -1, np.int64)
        triples = {}
        for n, words in enumerate(self.words):
            own = self.item_pairs[n]
            if len(words) == 1:
                self.word_gram[coded[n][0]] = self.number[words[0]]
            elif len(words) == 2:
                self.pair_gram[own[0]] = self.number[" ".join(words)]
            for k, gram in enumerate(grams(words) if len(words) >= GRAM else ()):
                triples[own[k] * self.base + int(coded[n][k + 2])] = self.number[gram]
        self.triples = np.array(sorted(triples), np.int64)
        self.triple_gram = np.array([triples[c] for c in self.triples.tolist()], np.int64)
        self.has_words, self.has_pairs = bool((self.word_gram >= 0).any()), bool((self.pair_gram >= 0).any())

    def bm25(self, idf: float, tf: int, length: int, k1: float = 1.2, b: float = 0.3) -> float:
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.mean))

    def threshold(self, n: int, weights: list[float]) -> float:
        """What an unedited stretch of a fifth of the item's words would score, or the half of a passage if that is less, cut to a third for edits.

        A stretch of half a passage or more has that many words in one passage at least, wherever the passages begin.
        Two fifths of the item's own `weights` bound it too, so that items of few words and items that share all their triples with others stay within reach.
        """
        least = min(len(self.words[n]) * SHARE / STRETCHES, PASSAGE / 2)
        needed = max(min(2.0, len(weights)), (least - GRAM + 1) / 3)
        return 0.9 * min(needed * self.bm25(self.rare, 1, len(self.words[n])), SHARE * sum(weights)) if weights else 1.0

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, gram) of the document's grams that are in the index, and the number of each of its pairs or -1."""
        known = self.word_ids.get
        ids = np.array([known(w, 0) for w in words], np.int64)
        codes = ids[:-1] * self.base + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, codes), max(0, len(self.pairs) - 1))
        pairs = np.where((self.pairs[at] == codes) & (ids[:-1] > 0) & (ids[1:] > 0), at, -1) if len(self.pairs) else np.full(len(codes), -1)
        places, found = [], []
        if len(self.triples) and len(pairs) > 1:
            here = np.flatnonzero((pairs[:-1] >= 0) & (pairs[1:] >= 0))
            codes = pairs[here] * self.base + ids[here + 2]
            at = np.minimum(np.searchsorted(self.triples, codes), len(self.triples) - 1)
            good = self.triples[at] == codes
            places.append(here[good])
            found.append(self.triple_gram[at[good]])
        if self.has_pairs and len(pairs):
            own = np.where(pairs >= 0, self.pair_gram[np.maximum(pairs, 0)], -1)
            places.append(np.flatnonzero(own >= 0))
            found.append(own[own >= 0])
        if self.has_words:
            own = self.word_gram[ids]
            places.append(np.flatnonzero(own >= 0))
            found.append(own[own >= 0])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), pairs
        place, gram = np.concatenate(places), np.concatenate(found)
        order = np.argsort(place, kind="stable")
        return place[order], gram[order], pairs

    def candidates(self, length: int, place: np.ndarray, gram: np.ndarray) -> set[int]:
        """All items whose score for any passage is at least 1."""
        if not len(place):
            return set()
        sums = np.concatenate([[0.0], np.cumsum(self.tops[gram])])
        starts = np.arange(0, max(1, length - STRIDE), STRIDE)
        first, last = np.searchsorted(place, starts), np.searchsorted(place, starts + PASSAGE - GRAM + 1)
        found: set[int] = set()
        seen: set[tuple[int, int]] = set()
        for k in np.flatnonzero(sums[last] - sums[first] >= 1).tolist():
            bounds = (int(first[k]), int(last[k]))
            if bounds not in seen:
                seen.add(bounds)
                own = np.unique(gram[bounds[0] : bounds[1]])
                if self.most(own) >= 1:
                    found |= self.search(own.tolist())
        return found

    def most(self, own: np.ndarray) -> float:
        """A bound of the score of any item for the grams, from the flat postings; passages below the threshold needn't be walked."""
        begin, size = self.first[own], self.first[own + 1] - self.first[own]
        at = np.arange(size.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return float(np.bincount(self.flat_items[at], self.flat_weights[at]).max()) + 1e-9

    def search(self, query: list[int]) -> set[int]:
        """All items whose score for the query's grams is at least 1, by block-max WAND."""
        lists = [self.postings[g] for g in set(query)]
        if sum(p[4] for p in lists) < 1:
            return set()
        found = set()
        # Each cursor: the item it stands at, its place, and the list's items, weights, block maxima, block ends and maximum.
        cursors = [[p[0][0], 0, *p] for p in lists]
        cursors.sort(key=FIRST)
        while cursors:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[6]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            item, behind = cursors[pivot][0], pivot + 1
            while behind < len(cursors) and cursors[behind][0] == item:
                behind += 1
            # The blocks that hold the pivot item bound it, and with it all items up to the first block's end.
            past = cursors[behind][0] if behind < len(cursors) else END
            tight = score = 0.0
            front = cursors[:behind]
            for c in front:
                at, docs = c[1], c[2]
                if c[0] < item:
                    at = c[1] = bisect_left(docs, item, at)
                    if docs[at] == END:
                        continue
                tight += c[4][at >> SHIFT]
                if docs[at] == item:
                    score += c[3][at]
                end = c[5][at >> SHIFT]
                if end < past:
                    past = end + 1
            if tight >= 1:
                past = item + 1
                if score >= 1:
                    found.add(item)
                for c in front:
                    at = c[1]
                    if c[2][at] == item:
                        at = c[1] = at + 1
                    c[0] = c[2][at]
            else:
                for c in front:
                    at = c[1] = bisect_left(c[2], past, c[1])
                    c[0] = c[2][at]
            cursors.sort(key=FIRST)
            while cursors and cursors[-1][0] == END:
                cursors.pop()
        return found

    def reach(self, n: int, where: dict[int, list[int]]) -> int:
        """The most words of item `n` that stretches can cover: those of pairs that stand in the document, and gaps between them that an edit may leave."""
        if len(self.words[n]) < 2:
            return len(self.words[n])
        covered, last = 0, -GAP - 3
        for i, pair in enumerate(self.item_pairs[n]):
            if pair in where:
                covered += i - last if i - last <= GAP + 2 else 2
                last = i
        return covered

    def stretches(self, n: int, words: list[str], where: dict[int, list[int]]) -> list[tuple[int, tuple[int, int], tuple[int, int]]]:
        """The stretches of item `n` in the document: words covered, first and last place, each in the document and in the item."""
        item = self.words[n]
        if len(item) == 1:
            return [(1, (j, 0), (j, 0)) for j, w in enumerate(words) if w == item[0]]
        anchors = []
        for i, pair in enumerate(self.item_pairs[n]):
            for j in where.get(pair, ()):
                anchors.append((j, i))
        anchors.sort()
        # Chains of word pairs: each anchor takes the best chain that ends shortly before it.
        best: list[tuple[int, int, int]] = []  # words covered, first anchor, anchor before
        for k, (j, i) in enumerate(anchors):
            top = (2, k, -1)
            for p in range(k - 1, -1, -1):
                pj, pi = anchors[p]
                if j - pj > GAP + 2:
                    break
                dj, di = j - pj, i - pi
                if dj <= 0 or di <= 0 or di > GAP + 2 or abs(di - dj) > 4:
                    continue
                if best[p][0] + di <= top[0]:
                    continue  # not even all words between them would make this the better chain
                gain = 1 if di == 1 and dj == 1 else min(2, di) + bridged(item[pi + 2 : i], words[pj + 2 : j])
                if best[p][0] + gain > top[0]:
                    top = (best[p][0] + gain, best[p][1], p)
            best.append(top)
        chains: dict[int, tuple[int, int]] = {}
        for k, (covered, first, _) in enumerate(best):
            if covered > chains.get(first, (0, 0))[0]:
                chains[first] = (covered, k)
        return [(covered, anchors[f], anchors[last]) for f, (covered, last) in chains.items() if covered >= min(STRETCH, len(item))]

    def parts(self, n: int, runs: list[tuple[int, tuple[int, int], tuple[int, int]]]) -> tuple[float | None, float | None]:
        """The shares of an item's question and of its answer that stretches cover, None where it doesn't tell them apart."""
        asked = self.questions[n]
        if asked is None:
            return None, None
        covered = np.zeros(len(self.words[n]), bool)
        for _, (_, begin), (_, end) in runs:
            covered[begin : end + 2] = True
        return float(covered[:asked].mean()), float(covered[asked:].mean())


def best_two(runs: list[tuple[int, tuple[int, int], tuple[int, int]]]) -> int:
    """The most words of one stretch, or of two that follow each other in both texts.

    A stretch is its words covered, its first and its last place, each in the
    document and in the item. Going through the document, the stretches that have
    ended are kept as a staircase: later ends in the item with more words only.
    """
    top = max((r[0] for r in runs), default=0)
    ended = sorted(runs, key=lambda r: r[2][0])
    places: list[int] = []
    most: list[int] = []
    k = 0
    for covered, (j, i), _ in sorted(runs, key=lambda r: r[1][0]):
        while k < len(ended) and ended[k][2][0] < j:
            words, _, (_, end) = ended[k]
            k += 1
            at = bisect_left(places, end + 1)
            if at and most[at - 1] >= words:
                continue
            low = bisect_left(places, end)
            high = low
            while high < len(most) and most[high] <= words:
                high += 1
            places[low:high], most[low:high] = [end], [words]
        at = bisect_left(places, i)
        if at:
            top = max(top, most[at - 1] + covered)
    return top


def bridged(left: list[str], right: list[str]) -> int:
    """Words of a short gap that differ by an edit or two only."""
    count, start = 0, 0
    for a in left:
        for k in range(start, len(right)):
            b = right[k]
            if a == b or len(a) > 3 and abs(len(a) - len(b)) <= 2 and edits(a, b) <= (1 if len(a) < 7 else 2):
                count, start = count + 1, k + 1
                break
    return count


def overlaps(text: str | None, index: Index, share: float = SHARE) -> list[tuple[int, float, float | None, float | None]]:
    """(item, share of its words, share of its question, share of its answer) of each item that a text holds."""
    words = words_of(text)
    if not words:
        return []
    place, gram, pairs = index.look_up(words)
    found = index.candidates(len(words), place, gram)
    if not found:
        return []
    where: dict[int, list[int]] = defaultdict(list)
    for j in np.flatnonzero(pairs >= 0).tolist():
        where[int(pairs[j])].append(j)
    out = []
    for n in sorted(found):
        if index.reach(n, where) < share * len(index.words[n]):
            continue
        runs = index.stretches(n, words, where)
        whole = best_two(runs) / len(index.words[n])
        if whole >= share:
            out.append((index.ids[n], whole, *index.parts(n, runs)))
    return out


def leaks_of(text: str | None, index: Index, share: float = SHARE) -> list[int]:
    """The ids of the items that a text holds."""
    return [o[0] for o in overlaps(text, index, share)]


#: The index that a worker has built last, by the name of its block.
_BUILT: dict[str, Index] = {}


def built(name: str, parts) -> Index:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(*parts.value)
    return _BUILT[name]


def item_grams(items: DataFrame) -> DataFrame:
    """Per item (block, text): block, its number of words and its different triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(grams(w))) for w in words], pa.list_(pa.string()))], names=["block", "n", "grams"])

    return items.select("block", "text").mapInArrow(run, "block bigint, n bigint, grams array<string>")


def leak_shares(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """Each document (doc_id, text) and item (item_id, text) that it holds: doc_id, item_id, share, question_share, answer_share."""
    spark = documents.sparkSession
    usable = items.select("item_id", "text").filter(F.col("text").isNotNull())
    blocks = max(1, math.ceil(usable.count() / ITEMS_PER_BLOCK))
    placed = usable.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    total = mean = grouped = None
    if blocks > 1:
        # Weights and thresholds are those of one index over all items.
        taken = checkpoint(item_grams(placed))
        total, mean = taken.agg(F.count(F.lit(1)), F.avg("n")).first()
        each = taken.select("block", F.explode("grams").alias("gram"))
        grouped = checkpoint(each.groupBy("gram").agg(F.count(F.lit(1)).alias("held"), F.collect_set("block").alias("blocks")).filter("held > 1"))
    documents = spread(documents.select("doc_id", "text"))
    out = None
    for block in range(blocks):
        rows = [(r.item_id, r.text) for r in placed.filter(F.col("block") == block).collect()]
        holders = None if grouped is None else {r.gram: r.held for r in grouped.filter(F.array_contains("blocks", F.lit(block).cast("bigint"))).select("gram", "held").collect()}
        shared, name = spark.sparkContext.broadcast((rows, total, mean, holders)), str(uuid.uuid4())

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = built(name, shared)
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                found = [(n, *o) for n, t in enumerate(texts) for o in overlaps(t, index, share)]
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([keys.take(at), pa.array([f[1] for f in found], pa.int64()), *[pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4)]], names=["doc_id", "item_id", "share", "question_share", "answer_share"])

        part = documents.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id bigint, share double, question_share double, answer_share double")
        if blocks > 1:
            # Written out, so that the block's items needn't stay.
            part = checkpoint(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id and item_id of each document (doc_id, text) and item (item_id, text) that it holds."""
    return leak_shares(documents, items, share).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and item_id of each leak."""
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "heldout_items", "item_id", "text"))


def p8_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks with the share of the item's words that the document holds, and of its question and answer where it tells them apart."""
    return leak_shares(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "heldout_items", "item_id", "text"))


def p8_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each held-out item with the number of documents that hold it."""
    held = p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    items = table(spark, folder, "heldout_items", "item_id", "item_set").distinct()
    return items.join(held, "item_id", "left").select("item_id", "item_set", F.coalesce("n_documents", F.lit(0).cast("bigint")).alias("n_documents"))
