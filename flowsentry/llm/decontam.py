"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each row holds one block of documents with, for every
term of the block, the ascending word positions at which it occurs (positions of neighbouring
documents are kept apart by a gap).  It is stored once in the shared folder.  Test phrases are
looked up in every block by intersecting offset-adjusted position lists, starting from the
term that is rarest in the whole corpus, so most phrases are settled by one or two short
lists.  ``slop`` 0 finds exact phrases; with a larger slop each word may stand that many words
off its place (proximity matches).

Only terms of the test set are indexed while their number stays below ``max_terms`` (no other
posting can take part in a match); beyond it every term is.  The test set is searched in
groups of bounded size, each broadcast on its own, and the groups' spans are united per
document.

Defined cases: null and empty texts have no words and no hits; items without words match
nothing; repeated items count once per item id; repeated documents are judged each; an item
shorter than the window is one window; empty tables give no rows or no hits; items with a
null id are left out unless ``unnamed``, then they are searched and stand together as one null
at the end of a document's items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, WordHasher, Workspace, free_worker_cache, slices, utf8

_by_name = lambda item: (item is None, item or "")

BLOCK_BYTES = 1 << 22
PIECE_BYTES = 1 << 19  # of a block's text that are split into words at once
GAP = 64  # empty positions between documents; windows plus slop must be shorter


def _index_blocks(docs: DataFrame, id_col: str, text_col: str, terms) -> DataFrame:
    """One row per block of documents: ids, word counts, first positions, postings by term."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def build(batches):
        free_worker_cache()
        hasher, seq = WordHasher(ALNUM_WORDS), 0
        wanted = terms.value if terms is not None else None
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, BLOCK_BYTES):
                words, done = np.zeros(j - i, np.int64), 0
                terms_of, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, z in slices(offsets[i:j + 1] - offsets[i], PIECE_BYTES):
                    part = offsets[i + a:i + z + 1]
                    h, _, _, row = hasher.words(data[part[0]:part[-1]], part - part[0])
                    h = h.view(np.int64)
                    words[a:z] = np.bincount(row, minlength=z - a)
                    pos = np.arange(done, done + len(h)) + (row + a) * GAP
                    done += len(h)
                    if wanted is not None:
                        at = np.searchsorted(wanted, h)
                        keep = wanted[np.minimum(at, len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
                        h, pos = h[keep], pos[keep]
                    terms_of.append(h)
                    places.append(pos)
                first = np.concatenate([[0], np.cumsum(words + GAP)])[:-1]
                h, pos = np.concatenate(terms_of), np.concatenate(places)
                order = np.argsort(h, kind="stable")
                h, pos = h[order], pos[order]
                edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                one = lambda a, t: pa.ListArray.from_arrays(
                    pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a, t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{TaskContext.get().partitionId()}-{seq}"]),
                     one(batch.column(0).slice(i, j - i), None), one(words.astype(np.int32), pa.int32()),
                     one(first.astype(np.int64), pa.int64()), one(h[edge], pa.int64()),
                     one(np.append(edge, len(h)).astype(np.int32), pa.int32()), one(pos.astype(np.int32), pa.int32())],
                    names=["block", "ids", "words", "first", "terms", "edges", "positions"])
                seq += 1
        free_worker_cache()

    return rows.mapInArrow(build, f"block string, ids array<{kind}>, words array<int>, first array<long>, "
                                  "terms array<long>, edges array<int>, positions array<int>")


def _lists(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def term_counts(index: DataFrame) -> DataFrame:
    """Corpus frequency of every indexed term: (term, n)."""
    def count(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                for t, n in zip(_lists(batch, "terms", i).tolist(), np.diff(_lists(batch, "edges", i)).tolist()):
                    total[t] = total.get(t, 0) + n
                if len(total) > 500_000:
                    yield pa.RecordBatch.from_pydict({"term": list(total), "n": list(total.values())})
                    total = {}
        if total:
            yield pa.RecordBatch.from_pydict({"term": list(total), "n": list(total.values())})

    return index.select("terms", "edges").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def phrases_of(texts: list[tuple[object, str | None]], window: int) -> list[tuple[tuple[int, ...], list]]:
    """Distinct windows of hashed words with the ids of the items that hold them."""
    hasher, found = WordHasher(ALNUM_WORDS), {}
    for item, text in texts:
        data, offsets = utf8(pa.array([text], pa.string()))
        h = hasher.words(data, offsets)[0].view(np.int64).tolist()
        for i in range(max(1, len(h) - window + 1) if h else 0):
            ids = found.setdefault(tuple(h[i:i + window]), [])
            if item not in ids[-1:]:
                ids.append(item)
    return list(found.items())


def _occurrences(terms, edges, positions, phrase, rank, slop):
    """Start positions of one phrase in a block, intersecting from its rarest term."""
    order = sorted(range(len(phrase)), key=lambda k: (rank.get(phrase[k], 0), k))
    start = None
    for k in order:
        at = np.searchsorted(terms, phrase[k])
        if at == len(terms) or terms[at] != phrase[k]:
            return None
        own = positions[edges[at]:edges[at + 1]].astype(np.int64) - k
        if start is None:
            start = own
        else:
            lo = np.searchsorted(own, start - slop)
            near = own[np.minimum(lo, len(own) - 1)]
            start = start[(lo < len(own)) & (near <= start + slop)]
        if len(start) == 0:
            return None
    return start


def search(spark: SparkSession, index: DataFrame, phrases, rank: dict[int, int], slop: int = 0) -> DataFrame:
    """One row per document: block, row, id, n_words, items found, hit spans [first, last)."""
    kind = dict(index.dtypes)["ids"][len("array<"):-1]
    shared = spark.sparkContext.broadcast((phrases, rank))

    def run(batches):
        phrases, rank = shared.value
        for batch in batches:
            for b in range(batch.num_rows):
                ids, words, first = batch.column("ids")[b].values, _lists(batch, "words", b), _lists(batch, "first", b)
                terms, edges, positions = (_lists(batch, x, b) for x in ("terms", "edges", "positions"))
                items: dict[int, set] = {}
                lefts, rights = [], []
                for phrase, owners in phrases:
                    start = _occurrences(terms, edges, positions, phrase, rank, slop)
                    if start is None:
                        continue
                    lefts.append(start)
                    rights.append(start + len(phrase))
                    for r in set((np.searchsorted(first, start + slop, "right") - 1).tolist()):
                        items.setdefault(max(r, 0), set()).update(owners)
                spans: dict[int, list] = {}
                if lefts:
                    a, z = np.concatenate(lefts), np.concatenate(rights)
                    order = np.argsort(a, kind="stable")
                    a, z = a[order], np.maximum.accumulate(z[order])
                    new = np.concatenate([[True], a[1:] > z[:-1]])
                    at = np.flatnonzero(new)
                    z = z[np.append(at[1:], len(a)) - 1]
                    for x, y in zip(a[at], z):
                        r = max(int(np.searchsorted(first, x + slop, "right") - 1), 0)
                        lo, hi = max(int(x - first[r]), 0), min(int(y - first[r]), int(words[r]))
                        spans.setdefault(r, []).append({"first": lo, "last": hi})
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("block")[b].as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), ids,
                     pa.array(words, pa.int64()),
                     pa.array([sorted(items.get(r, ()), key=_by_name) for r in range(n)], pa.list_(pa.string())),
                     pa.array([spans.get(r, []) for r in range(n)],
                              pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                    names=["block", "row", "id", "n_words", "items", "spans"])

    return index.mapInArrow(run, f"block string, row int, id {kind}, n_words long, items array<string>, "
                                 "spans array<struct<first:long,last:long>>")


def _united(found: DataFrame) -> DataFrame:
    """Unite the items and spans that several groups of the test set found in a document."""
    rows = found.groupBy("block", "row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))
    merged = F.expr("""aggregate(all, cast(array() as array<struct<first:long,last:long>>), (acc, s) ->
        if(size(acc) > 0 and s.first <= element_at(acc, -1).last,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first,
                  'last', greatest(element_at(acc, -1).last, s.last)))),
           concat(acc, array(s))))""")
    return rows.select("block", "row", "id", "n_words", "items", merged.alias("spans"))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, *, id_col: str, text_col: str,
                  item_id: str, item_text: str, window: int = 10, slop: int = 0, max_terms: int = 2_000_000,
                  group_bytes: int = 64 << 20, unnamed: bool = False) -> DataFrame:
    """One row per document: id, n_words, items (found item ids as strings, sorted), spans.

    ``group_bytes`` bounds the test text that is broadcast at once; ``max_terms`` bounds the
    broadcast list of indexed terms (8 bytes each); ``unnamed`` searches items of a null id too.
    """
    if window + 2 * slop >= GAP:
        raise ValueError(f"window + 2 * slop must be below {GAP}")
    ws = Workspace(spark, "decontam")
    tests = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")) \
        .filter(F.col("text").isNotNull() & (F.lit(unnamed) | F.col("item").isNotNull())).dropDuplicates()
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    part = F.pmod(F.xxhash64(F.coalesce("item", "text")), F.lit(groups))

    def group(g):
        return phrases_of(sorted(((r["item"], r["text"]) for r in tests.filter(part == g).collect()),
                                 key=lambda r: (_by_name(r[0]), r[1])), window)

    known, terms = group(0) if groups == 1 else None, None
    if groups == 1:
        wanted = np.unique(np.array([h for p, _ in known for h in p], np.int64))
        if len(wanted) <= max_terms:
            terms = spark.sparkContext.broadcast(wanted)
    index = ws.save(_index_blocks(docs, id_col, text_col, terms), "index")
    counts = term_counts(index)
    if terms is None:
        counts = ws.save(counts, "counts")
    parts = []
    for g in range(groups):
        phrases = known if known is not None else group(g)
        need = spark.createDataFrame([(h,) for h in {h for p, _ in phrases for h in p}], "term long")
        ranks = {r["term"]: r["n"] for r in counts.join(need, "term").collect()}
        found = search(spark, index, phrases, ranks, slop)
        parts.append(found)
    if groups == 1:
        return parts[0].drop("block", "row")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _united(every).drop("block", "row")
