"""Evaluation texts in training text: an FM-index per shard of the corpus, searched backwards.

Every document goes whole into one shard; a shard's word sequence is indexed (fm_index) and written
to the shared folder, so the index is built once and searched several times. Items are cut into
short phrases; their occurrences are found by backward search and located by sampled suffix
positions. The occurrences of an item in a document are chained in the item's order and the words
they cover counted. Stretches of an item that many different texts use in many surroundings, apart
from the item's other words, are procedural formulas: the words they cover don't count. A place in a
document belongs to the item that covers most of it; as a document lies whole in one shard, that is
settled where it is found.

A short phrase that is common in the corpus and stands at many places of the items makes a pair of
every two of them. So the hits aren't worked out at once: documents and items are first compared by
the different phrases they share, and an item's words within reach of those are counted. Where they
can't be enough, no order of hits could make a case, and the pair is dropped; all others, however
common their phrases, get all their hits. That goes by stretches of documents of bounded size.

Defined results
- null or empty texts contain nothing; documents without id are searched one by one and come out
  under a null id, once an item
- equal documents each have their rows; repeated rows of one doc_id come out once an item (where
  they differ, with the places of the one that holds more words)
- items without enough words can't be found; items that repeat another's text are both reported
- an empty corpus or an empty item table gives an empty result
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.fm_index import FMIndex
from tessella.llm.words import Folder
from tessella.session import cut

#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 250_000
#: Items are searched in blocks of at most so many words, so what is sent out stays bounded.
BLOCK_WORDS = 2_000_000
#: Pairs of phrases that are held at once, if a single document makes no more.
PAIRS = 1_000_000


@dataclass(frozen=True)
class LeakLimits:
    words: int = 20  # an item's words that a document must contain, in order
    slack: int = 4  # of these, altered words at a passage's ends and next to others aren't seen
    seed: int = 3  # words of the phrases that are searched for
    formula: int = 8  # words of the phrases by which formulas are told
    common: float = 0.02  # share of all documents that makes a phrase a formula
    common_least: int = 5  # and the least number of documents
    around: int = 2  # words before or after a formula that tell its surroundings
    bridge: int = 3  # altered words between two phrases that still count

    @property
    def least(self) -> int:
        return self.words - self.slack

    @property
    def hits(self) -> int:
        """Phrases that can cover so many words at least."""
        return -(-(self.least + self.bridge) // (self.seed + self.bridge))


@dataclass
class Phrases:
    """The words of a block of items as numbers, at most BLOCK_WORDS of them: a few bytes a word."""

    items: np.ndarray
    vocabulary: list[str]
    flat: np.ndarray
    #: item k has the words flat[begin[k] : begin[k + 1]]
    begin: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[tuple[int, str]]) -> Phrases:
        folder, ids, flat, begin = Folder(), {}, [], [0]
        for _, text in rows:
            flat.extend(ids.setdefault(w, len(ids)) for w in folder.words(text))
            begin.append(len(flat))
        return cls(np.array([r[0] for r in rows], np.int64), list(ids), np.array(flat, np.int32), np.array(begin, np.int64))

    def words(self, k: int, first: int, end: int) -> tuple[str, ...]:
        return tuple(self.vocabulary[w] for w in self.flat[self.begin[k] + first : self.begin[k] + end])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of every phrase of so many words that lies within an item."""
        many = np.maximum(np.diff(self.begin) - width + 1, 0)
        item = np.repeat(np.arange(len(many)), many)
        return item, np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)

    def distinct(self, item: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The different phrases among those that begin at the places, as rows of word numbers, and
        for each place the number of its phrase."""
        start = self.begin[item] + place
        code = np.zeros(len(start), np.int64)
        for k in range(width):
            _, first, code = np.unique(code * len(self.vocabulary) + self.flat[start + k], return_index=True, return_inverse=True)
        return self.flat[start[first][:, None] + np.arange(width)] if len(start) else np.zeros((0, width), np.int32), code


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_ids, index): one row per shard, the FM-index as bytes. Lazy; write it before searching."""
    kind = documents.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("index", T.BinaryType())])
    out_schema = pa.schema([("doc_ids", pa.list_(pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string())), ("index", pa.binary())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, ids, held, n = Folder(), [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = folder.words(t.as_py())
                if held and n + len(words) > SHARD_WORDS:
                    yield pa.RecordBatch.from_pydict({"doc_ids": [ids], "index": [FMIndex.build(held).to_bytes()]}, schema=out_schema)
                    ids, held, n = [], [], 0
                if words:
                    ids.append(d)
                    held.append(words)
                    n += len(words)
        if held:
            yield pa.RecordBatch.from_pydict({"doc_ids": [ids], "index": [FMIndex.build(held).to_bytes()]}, schema=out_schema)

    source = documents.select(F.col(doc_id), F.col(text)).filter(F.col(text).isNotNull())
    # texts of one source lie together in the files: spread them, so shards are of like size
    return source.repartition(F.xxhash64(doc_id), F.length(text)).mapInArrow(shards, schema)


def shard_ids(fm: FMIndex, vocabulary: Sequence[str]) -> np.ndarray:
    """A shard's number of each word, -1 for a word that it lacks."""
    return np.array([fm.vocabulary.get(w, -1) for w in vocabulary], np.int64)


def phrase_counts(index: DataFrame, vocabulary: Sequence[str], phrases: np.ndarray) -> DataFrame:
    """(phrase, n): occurrences of each phrase (a row of numbers of words), 0 left out."""
    held = index.sparkSession.sparkContext.broadcast((vocabulary, phrases))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, rows = held.value
        total = np.zeros(len(rows), np.int64)
        for pdf in batches:
            for data in pdf["index"]:
                fm = FMIndex.from_bytes(data)
                lo, hi = fm.search(shard_ids(fm, words)[rows] if len(rows) else np.zeros((0, 1), np.int64))
                total += hi - lo
        k = np.flatnonzero(total)
        yield pd.DataFrame({"phrase": k, "n": total[k]})

    return index.select("index").mapInPandas(count, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n"))


def common_stretches(phrases: Phrases, n: np.ndarray, least: float, limits: LeakLimits) -> list[tuple[int, int, int]]:
    """(item, first, end): words [first, end) of an item of which each phrase occurs more than `least`
    times, while the item's phrase next to them occurs at most half as often. Where it goes on as
    often, or the whole item is so common, the words are a passage and no formula. n: occurrences of
    the phrase at each of the items' windows."""
    out, item = [], phrases.windows(limits.formula)[0]
    edges = np.searchsorted(item, np.arange(len(phrases.items) + 1))
    for k in range(len(phrases.items)):
        of = n[edges[k] : edges[k + 1]].tolist()
        a = 0
        while a < len(of):
            if of[a] <= least:
                a += 1
                continue
            b = a
            while b < len(of) and of[b] > least:
                b += 1
            sides = ([(of[a - 1], of[a])] if a else []) + ([(of[b], of[b - 1])] if b < len(of) else [])
            if sides and all(2 * outside <= inside for outside, inside in sides):
                out.append((k, a, b - 1 + limits.formula))
            a = b
    return out


def uses(index: DataFrame, stretches: list[tuple[str, ...]], limits: LeakLimits) -> DataFrame:
    """(stretch, n): how many different texts use a stretch of words (its number in the list), where
    the words before it, or after it, differ: one surrounding counts for at most the share `common`
    of the texts, so copies, reissues and one document's repetitions make no formula. Any phrase of a
    stretch is a use of it."""
    width = limits.formula
    at: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for k, w in enumerate(stretches):
        for i in range(len(w) - width + 1):
            at.setdefault(w[i : i + width], []).append((k, i))
    ids: dict[str, int] = {}
    rows = np.array([[ids.setdefault(w, len(ids)) for w in p] for p in at], np.int64).reshape(-1, width)
    many = np.array([len(x) for x in at.values()], np.int64)
    which, inside = np.array([x for p in at.values() for x in p], np.int64).reshape(-1, 2).T
    length = np.array([len(w) for w in stretches], np.int64)
    # as large as the items' common stretches
    held = index.sparkSession.sparkContext.broadcast((list(ids), rows, many, which, inside, length))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, rows, many, which, inside, length = held.value
        begin = np.cumsum(many) - many
        for pdf in batches:
            out = []
            for data in pdf["index"]:
                fm = FMIndex.from_bytes(data)
                row, position = fm.locate(*fm.search(shard_ids(fm, vocabulary)[rows]))
                one = spread(begin[row], many[row])
                place = np.repeat(position, many[row])
                doc = np.searchsorted(fm.first, place, side="right") - 1
                met = np.unique(np.stack([which[one], doc, place - inside[one]]), axis=1)
                for k, d, first in met.T.tolist():
                    start, stop, end = int(fm.first[d]), int(fm.first[d + 1]) - 1, first + int(length[k])
                    out.append((k, int(fm.digests[d]), fm.words(max(start, first - limits.around), max(start, first)), fm.words(min(stop, end), min(stop, end + limits.around))))
            yield pd.DataFrame(out, columns=["stretch", "same", "before", "after"])

    found = cut(index.select("index").mapInPandas(find, "stretch long, same long, before string, after string"))
    texts = found.groupBy("stretch").agg(F.count_distinct("same").alias("texts"))
    side = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("words")) for c in ("before", "after")]))
    each = found.select("stretch", "same", side.alias("_s")).distinct().groupBy("stretch", "_s").agg(F.count("*").alias("n")).join(texts, "stretch")
    most = F.greatest(F.lit(1), F.floor(F.col("texts") * limits.common))
    sides = each.groupBy("stretch", "_s.side").agg(F.least(F.sum(F.least("n", most)), F.first("texts")).alias("n"))
    return sides.groupBy("stretch").agg(F.max("n").alias("n"))


def chain(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """The longest series of (item place, document place) that rises in both, whatever lies between."""
    order = np.lexsort((-item, doc))
    it, dc = item[order].tolist(), doc[order].tolist()
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(it)
    for k, x in enumerate(it):
        j = bisect_left(tails, x)
        if j == len(tails):
            tails.append(x)
            at.append(k)
        else:
            tails[j], at[j] = x, k
        back[k] = at[j - 1] if j else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append((it[k], dc[k]))
        k = back[k]
    return out[::-1]


def covered(pairs: list[tuple[int, int]], limits: LeakLimits) -> list[tuple[int, int, bool]]:
    """The (item place, document place, equal) words that a chain of phrases covers, altered words
    between two phrases that keep step included."""
    out: dict[int, int] = {}
    equal = {i + k for i, _ in pairs for k in range(limits.seed)}
    last: tuple[int, int] | None = None
    for i, d in pairs:
        if last is not None:
            gap = i - last[0] - limits.seed
            if 0 < gap <= limits.bridge and abs((d - last[1]) - (i - last[0])) <= 1:
                for k in range(gap):
                    out.setdefault(last[0] + limits.seed + k, last[1] + limits.seed + k)
        for k in range(limits.seed):
            out.setdefault(i + k, d + k)
        last = (i, d)
    return [(i, d, i in equal) for i, d in sorted(out.items())]


def spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... (many[k] of them) for each k, one after the other."""
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches [a, b) of the sizes that sum up to `most` or are a single one."""
    upto, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, most + (upto[a - 1] if a else 0), side="right")))
        yield a, b
        a = b


class Search:
    """What finding a block's items in a shard needs, worked out once a task."""

    def __init__(self, phrases: Phrases, formulas: Sequence[tuple[int, int, int]], limits: LeakLimits) -> None:
        self.p, self.limits = phrases, limits
        self.mask = np.zeros(len(phrases.flat), bool)
        for k, a, b in formulas:
            self.mask[phrases.begin[k] + a : phrases.begin[k] + b] = True
        # items and places sorted by phrase, the phrases, and where each one's places begin; a phrase
        # at a place that lies wholly in a formula is not looked at
        item, place = phrases.windows(limits.seed)
        at = phrases.begin[item] + place
        masked = np.concatenate([[0], np.cumsum(self.mask)])
        live = masked[at + limits.seed] - masked[at] < limits.seed
        item, place = item[live], place[live]
        self.seeds, code = phrases.distinct(item, place, limits.seed)
        order = np.argsort(code, kind="stable")
        self.item, self.place, self.first = item[order], place[order], np.searchsorted(code[order], np.arange(len(self.seeds) + 1))

    def hits(self, fm: FMIndex) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, item, item place, document place) sorted by document, item and place, of every
        document and item whose phrases can cover enough words; whole documents at a time."""
        ids = shard_ids(fm, self.p.vocabulary)
        if not len(self.seeds) or not len(ids):
            return
        row, position = fm.locate(*fm.search(ids[self.seeds]))
        if not len(row):
            return
        doc = np.searchsorted(fm.first, position, side="right") - 1
        order = np.lexsort((position, row, doc))
        row, doc, at = row[order], doc[order], (position - fm.first[doc])[order]
        # the different phrases of each document, and where each one's places in it begin
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
        begin, times = new, np.diff(np.append(new, len(row)))
        row, doc = row[new], doc[new]
        many = np.diff(self.first)[row]
        edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        n_items = len(self.p.items)
        for a, b in runs(np.maximum(np.add.reduceat(many, edges[:-1]), n_items), PAIRS):
            pair, which, one = self._reaching(row, many, np.repeat(np.arange(b - a), np.diff(edges[a : b + 1])), int(edges[a]), b - a)
            of_doc = np.bincount(pair // n_items, weights=times[one], minlength=b - a)
            for c, d in runs(of_doc, PAIRS):
                some = slice(*np.searchsorted(pair, [c * n_items, d * n_items]))
                n = times[one[some]]
                item, place, where = (np.repeat(x[some], n) for x in (pair % n_items, self.place[which], doc[one]))
                found = at[spread(begin[one[some]], n)]
                order = np.lexsort((-place, found, item, where))
                yield where[order], item[order], place[order], found[order]

    def _reaching(self, row: np.ndarray, many: np.ndarray, of: np.ndarray, first: int, n_docs: int) -> tuple[np.ndarray, ...]:
        """(document and item as one number, place among the phrases' places, phrase of the document)
        of the pairs that can cover enough words, sorted; for the documents' phrases from `first` on,
        of: the document of each."""
        limits, n_items = self.limits, len(self.p.items)
        row, many = row[first : first + len(of)], many[first : first + len(of)]
        which = spread(self.first[row], many)
        pair, one = np.repeat(of, many) * n_items + self.item[which], np.repeat(np.arange(first, first + len(of)), many)
        live = np.bincount(pair, minlength=n_docs * n_items)[pair] >= limits.hits
        pair, which, one = pair[live], which[live], one[live]
        order = np.lexsort((self.place[which], pair))
        pair, which, one = pair[order], which[order], one[order]
        # each place covers its phrase, and the words up to it if a bridge from the one before can
        step = np.diff(self.place[which], prepend=0)
        joined = np.append(False, pair[1:] == pair[:-1])[: len(pair)] & (step <= limits.seed + limits.bridge)
        reached = np.bincount(pair, weights=np.where(joined, step, limits.seed), minlength=n_docs * n_items)
        live = reached[pair] >= limits.least
        return pair[live], which[live], one[live]

    def words(self, item: int, places: np.ndarray, at: np.ndarray) -> list[tuple[int, int, bool]]:
        """The item's words in order that the document holds and that are no formula's."""
        mask = self.mask[self.p.begin[item] : self.p.begin[item + 1]]
        return [x for x in covered(chain(places, at), self.limits) if not mask[x[0]]]

    def found(self, fm: FMIndex) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Per document the items that can reach enough words: (item, item places, document places)."""
        for doc, item, place, at in self.hits(fm):
            starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))) if len(doc) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(doc))
            last, group = -1, []
            for a, b in zip(starts.tolist(), ends.tolist()):
                if doc[a] != last:
                    if group:
                        yield last, group
                    last, group = int(doc[a]), []
                group.append((int(item[a]), place[a:b], at[a:b]))
            if group:
                yield last, group


def settle_hits(group: list[tuple[int, np.ndarray, np.ndarray]], search: Search) -> list[tuple[int, list[int]]]:
    """What settle gives, straight from a document's hits: (item, its places in the document)."""
    limits, taken, out = search.limits, set(), []
    words = [search.words(*g) for g in group]
    left = {g for g in range(len(group)) if len(words[g]) >= limits.least}
    while left:
        best, most = None, (-1, 0, 0)
        for g in sorted(left):
            free = [(d, e) for _, d, e in words[g] if d not in taken]
            if len(free) < limits.least:
                left.discard(g)
                continue
            score = (sum(e for _, e in free), len(free), -int(search.p.items[group[g][0]]))
            if score > most:
                best, most = g, score
        if best is None:
            break
        free = sorted(d for _, d, _ in words[best] if d not in taken)
        # an item with the very same hits is the same text under another number
        same = [g for g in left if g == best or (np.array_equal(group[g][1], group[best][1]) and np.array_equal(group[g][2], group[best][2]))]
        same = [g for g in same if words[g] == words[best]]
        out += [(int(search.p.items[group[g][0]]), free) for g in same]
        taken.update(free)
        left -= set(same)
    return out


def settle(pdf: pd.DataFrame, limits: LeakLimits) -> pd.DataFrame:
    """Of one document's items the ones that hold at least so many of its words for themselves: the
    item with most words takes its places, then the next of what is left."""
    rows = {i: list(zip(a, b, e)) for i, a, b, e in zip(pdf["item_id"], pdf["item_at"], pdf["doc_at"], pdf["equal"])}
    doc_id, taken, out = pdf["doc_id"].iloc[0], set(), []
    while rows:
        free = {i: [int(d) for _, d, _ in w if d not in taken] for i, w in rows.items()}
        # of items alike the one that the words equal, not the one they are altered from
        sure = {i: sum(bool(e) for _, d, e in w if d not in taken) for i, w in rows.items()}
        best = max((i for i in rows if len(free[i]) >= limits.least), key=lambda i: (sure[i], len(free[i]), -i), default=None)
        if best is None:
            break
        # an item of the very same words at the same places is the same text under another number
        same = [i for i in rows if i != best and rows[i] == rows[best]]
        out += [(doc_id, i, len(free[best]), sorted(free[best])) for i in [best, *same]]
        taken.update(free[best])
        for i in [best, *same]:
            del rows[i]
    return pd.DataFrame(out, columns=["doc_id", "item_id", "words", "doc_at"])


PLACES = T.ArrayType(T.IntegerType())


def found_in_shards(index: DataFrame, blocks: list[tuple[Phrases, list[tuple[int, int, int]]]], limits: LeakLimits, id_type: T.DataType) -> DataFrame:
    """(doc_id, item_id, words, doc_at). With one block of items a document is settled in its shard;
    with several its candidates of all blocks meet under the number of shard and document."""
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("doc_at", PLACES)])
    if len(blocks) == 1:
        held = index.sparkSession.sparkContext.broadcast(blocks[0])

        def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            search = Search(*held.value, limits)
            for pdf in batches:
                rows = [(ids[d], i, len(at), at) for ids, data in zip(pdf["doc_ids"], pdf["index"]) for d, group in search.found(FMIndex.from_bytes(data)) for i, at in settle_hits(group, search)]
                yield pd.DataFrame(rows, columns=out.names)

        return index.select("doc_ids", "index").mapInPandas(settled, out)
    kind = T.StructType([T.StructField("_doc", T.StringType()), T.StructField("doc_id", id_type), T.StructField("item_id", T.LongType()), T.StructField("item_at", PLACES), T.StructField("doc_at", PLACES), T.StructField("equal", T.ArrayType(T.BooleanType()))])

    def candidates(block: tuple) -> DataFrame:
        held = index.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            search = Search(*held.value, limits)
            for pdf in batches:
                rows = []
                for shard, ids, data in zip(pdf["shard"], pdf["doc_ids"], pdf["index"]):
                    for d, group in search.found(FMIndex.from_bytes(data)):
                        for item, places, at in group:
                            words = search.words(item, places, at)
                            if len(words) >= limits.least:
                                rows.append((f"{shard} {d}", ids[d], int(search.p.items[item]), *map(list, zip(*words))))
                yield pd.DataFrame(rows, columns=kind.names)

        return index.mapInPandas(find, kind)

    every = candidates(blocks[0])
    for block in blocks[1:]:
        every = every.unionByName(candidates(block))
    return every.groupBy("_doc").applyInPandas(lambda pdf: settle(pdf, limits), out)


def leaked(documents: DataFrame, items: DataFrame, limits: LeakLimits | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, words, doc_at): every document and the items of which it holds a passage;
    doc_at: the places of the words in the document."""
    limits = limits or LeakLimits()
    index = cut(build_index(documents).withColumn("shard", F.monotonically_increasing_id()))
    id_type = documents.schema["doc_id"].dataType
    n_docs = index.select(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).alias("n")).first().n
    blocks: list[tuple[Phrases, list[tuple[int, int, int]]]] = []
    block: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        phrases = Phrases.of(block)
        least = max(limits.common_least, limits.common * n_docs)
        rows, code = phrases.distinct(*phrases.windows(limits.formula), limits.formula)
        n = np.zeros(len(rows) + 1, np.int64)
        # at most as many rows as the block has phrases; what is left out can't bar a stretch
        for r in phrase_counts(index, phrases.vocabulary, rows).filter(F.col("n") > least / 2).collect():
            n[r.phrase] = r.n
        found = common_stretches(phrases, n[code], least, limits)
        words = [phrases.words(k, a, b) for k, a, b in found]
        distinct = sorted(set(words))
        often = {distinct[r.stretch] for r in uses(index, distinct, limits).filter(F.col("n") > least).collect()} if distinct else set()
        blocks.append((phrases, [x for x, w in zip(found, words) if w in often]))

    for r in items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").dropDuplicates().orderBy("item_id").toLocalIterator():
        words = len(r.text) // 2 + 1  # at most so many words
        if block and size + words > block_words:
            flush()
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += words
    if block:
        flush()
    if not blocks:
        return documents.sparkSession.createDataFrame([], T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("doc_at", PLACES)]))
    once = found_in_shards(index, blocks, limits, id_type).groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "doc_at")).alias("_w"))
    return once.select("doc_id", "item_id", "_w.words", "_w.doc_at")


def removal_spans(documents: DataFrame, found: DataFrame, bridge: int = 12) -> DataFrame:
    """(doc_id, start, end): the characters of each document to take out, the passages of all items
    merged; words of the document between two found ones are taken along up to bridge of them."""
    places = found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_at")))).alias("doc_at"))
    id_type = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder()
        for pdf in batches:
            out = []
            for d, text, at in zip(pdf["doc_id"], pdf["text"], pdf["doc_at"]):
                chars = folder.spans(text)
                at = [int(x) for x in at]
                first = last = at[0]
                for x in at[1:]:
                    if x - last > bridge + 1:
                        out.append((d, chars[first][0], chars[last][1]))
                        first = x
                    last = x
                out.append((d, chars[first][0], chars[last][1]))
            yield pd.DataFrame(out, columns=["doc_id", "start", "end"])

    return documents.select("doc_id", "text").join(places, "doc_id").mapInPandas(spans, schema)
