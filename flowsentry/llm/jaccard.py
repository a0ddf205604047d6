"""Exact n-gram Jaccard join by set-relation skipping, and the groups it links.

Documents are sets of distinct word shingles; two link when their Jaccard similarity reaches
``percent`` / 100.  The result is every document's set size and the smallest id reachable by
links.  Pairs inside a group are never listed:

1. Equal sets form classes (a class is one set from here on).
2. *Set relations.*  Classes that agree in many of 16 minimum hashes with one of a few classes
   of a common minimum are compared with it exactly; those that link form a star around it, and
   each member keeps |x \\ centre|.  Then the components of a common further minimum are compared
   with the largest of them, a few members of each.  Nothing is decided by the minimum hashes:
   they only propose.
3. *Inverted index with skipping.*  Each class posts its prefix (its rarest n - ceil(t n) + 1
   shingles; two sets that link share one).  Postings are folded to one entry per (shingle,
   star) with the range of sizes and the best position.  A list whose entries all belong to
   one component is skipped whole; the rest of a list is cut into blocks by size, only blocks
   of compatible sizes meet, and entries whose positions leave too few shingles are skipped.
   Before any exact comparison parity tables (four bits a shingle) bound the overlap from above.
4. Stars that still meet are compared by their centres.  The answers of the members follow from
   the centres' answer: |x & y| <= |a & b| + |x \\ a| + |y \\ b|.  Only members whose bound
   reaches the threshold are compared themselves, a few at first and then more, until the two
   stars are linked or no such member is left.  So no link between components is missed.

The order of shingles (heavy ones last) affects speed only.  Every table between steps is
written to the shared folder and removed once no later step reads it; joins on hot keys are sort-merge joins that Spark can split.

Defined cases: a document without words has an empty set and is linked with nothing; with
fewer than ``n`` words its whole sequence is one shingle; null texts are empty; rows with a
null id are returned with their set size and a null component; rows that share an id but not
their text are sets of their own; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_WORDS, WordHasher, Workspace, free_worker_cache, mix, slices, spent_shuffles, utf8

BLOCK_BYTES = 1 << 20
SKETCH = 16          # minimum hashes per set
BANDS = 4            # of them propose a centre, as many more propose links of components
CENTRES = 3          # classes of a common minimum that the others are compared with
AGREE = 9            # so many of all must agree with the centre's
MARKS = 8            # low bits of each minimum hash that are kept to count agreements
CELLS = 1024         # least bits of the parity table of a set: four a shingle, a power of two
MOST_CELLS = 1 << 20  # and most; the bound of larger sets is weaker, they are compared exactly
HEAVY = 1 << 16      # most frequent shingles that go last in the order
_ODD = [int(x) | 1 for x in mix(np.arange(1, SKETCH + 1).astype(np.uint64))]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: WordHasher, n: int):
    """(shingles, offsets): the distinct shingles of each row in ascending order."""
    rows = len(offsets) - 1
    h, _, _, row = words.words(data, offsets)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    order = np.arange(len(h)) - first[row] if len(h) else np.zeros(0, np.int64)
    short = np.minimum(count, n)
    start = np.flatnonzero(order <= (count - short)[row]) if len(h) else np.zeros(0, np.int64)
    x = mix(short[row[start]].astype(np.uint64))
    for j in range(n):
        live = short[row[start]] > j
        x[live] = mix((x[live] ^ h[start[live] + j]) * np.uint64(0x9FB21C651E98DF25))
    at = row[start]
    order = np.lexsort((x, at))
    x, at = x[order], at[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (at[1:] != at[:-1])
    x, at = x[new], at[new]
    return x, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rows))])


def _fingerprints(x: np.ndarray, edges: np.ndarray):
    """Two 64-bit sums that identify a set."""
    sums = np.zeros(len(x) + 1, np.uint64)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
        np.cumsum(mix(x ^ np.uint64(salt)), out=sums[1:])
        out.append(mix(sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
    return out


def _parities(x: np.ndarray, edges: np.ndarray):
    """(words, offsets): for each set a table of bits, is the number of its shingles in the cell odd?

    Each shingle that two sets do not share changes one bit at most, so the bits in which two
    sets differ are a lower bound of |x \\ y| + |y \\ x|.  A table of twice the size folds onto
    the smaller one by the exclusive or of its halves.
    """
    size = np.diff(edges)
    cells = np.int64(1) << np.ceil(np.log2(np.clip(4 * size, CELLS, MOST_CELLS))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(cells)])
    cell = (mix(x ^ np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(40)).astype(np.int64)
    out = [np.zeros(0, np.int64)]
    for i, j in slices(ends, MOST_CELLS):
        a, b = edges[i], edges[j]
        row = np.repeat(np.arange(i, j), size[i:j])
        at = ends[row] - ends[i] + (cell[a:b] & (cells[row] - 1))
        odd = (np.bincount(at, minlength=ends[j] - ends[i]) & 1).astype(np.uint8)
        out.append(np.packbits(odd, bitorder="little").view(np.int64))
    return np.concatenate(out), (ends // 64).astype(np.int32)


def _blocks(batch: pa.RecordBatch, words: WordHasher, n: int):
    data, offsets = utf8(batch.column(1))
    for i, j in slices(offsets, BLOCK_BYTES):
        x, edges = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], words, n)
        yield i, j, x, edges


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def reaches(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    """overlap / (a + b - overlap) >= percent / 100, in whole numbers."""
    return (100 + percent) * overlap >= percent * (a + b)


def agreement(x: str, y: str) -> Column:
    """Number of equal minimum hashes, by their kept bits."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, e: s + e)


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without nearly all whose ``key`` is not in ``wanted``; a bit table of 2^24 bits, so its broadcast is bounded."""
    bit = F.pmod(F.xxhash64(key), F.lit(1 << 24))
    cell = F.floor(bit / 64).cast("int")
    table = wanted.groupBy(cell.alias("cell")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("cell_bits"))
    return rows.join(F.broadcast(table), (cell == F.col("cell"))
                     & (F.call_function("shiftrightunsigned", F.col("cell_bits"), (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)).select(*rows.columns)


class Join:
    """The steps of one join; ``ws`` holds the tables between them."""

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int):
        self.spark, self.n, self.percent = spark, n, percent
        self.ws = Workspace(spark, "jaccard")
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        self.kind = dict(self.docs.dtypes)["id"]
        self.round, self.names = 0, {}

    # ------------------------------------------------------------ passes over the texts

    def signatures(self) -> DataFrame:
        """One row per document (id, n, fa, fb, mins, marks, bits), and rows of frequent shingles (tok, n)."""
        n, names = self.n, ["id", "n", "fa", "fb", "mins", "marks", "bits", "tok"]

        def run(batches):
            free_worker_cache()
            words, seen = WordHasher(SPACE_WORDS), {}
            for batch in batches:
                for i, j, x, edges in _blocks(batch, words, n):
                    size = np.diff(edges)
                    fa, fb = _fingerprints(x, edges)
                    some = np.flatnonzero(size > 0)
                    mins = np.zeros((j - i, SKETCH), np.uint64)
                    if len(some):
                        for k, odd in enumerate(_ODD):
                            mins[some, k] = np.minimum.reduceat(mix(x * np.uint64(odd)), edges[some])
                    tok, times = np.unique(x, return_counts=True)
                    for t, m in zip(tok[times > 1].tolist(), times[times > 1].tolist()):
                        seen[t] = seen.get(t, 0) + m
                    if len(seen) > 400_000:  # keep the frequent half; the counts are hints
                        seen = dict(sorted(seen.items(), key=lambda kv: -kv[1])[:200_000])
                    kept = pa.array(mins[:, :2 * BANDS].view(np.int64).ravel())
                    marks = pa.array((mins & np.uint64((1 << MARKS) - 1)).astype(np.uint8).view(np.int8).ravel())
                    bits, ends = _parities(x, edges)
                    rows = np.arange(j - i + 1, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(fa), pa.array(fb),
                         pa.ListArray.from_arrays(pa.array(rows * 2 * BANDS), kept), pa.ListArray.from_arrays(pa.array(rows * SKETCH), marks),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(bits)), pa.nulls(j - i, pa.int64())], names=names)
            top = sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:8192]
            if top:
                m = len(top)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, id_type), pa.array([c for _, c in top], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int8())), pa.nulls(m, pa.list_(pa.int64())),
                     pa.array(np.array([t for t, _ in top], np.uint64).view(np.int64))], names=names)

        from pyspark.sql.pandas.types import to_arrow_type
        id_type = to_arrow_type(self.docs.schema["id"].dataType)
        return self.docs.mapInArrow(run, f"id {self.kind}, n long, fa long, fb long, mins array<long>, marks array<byte>, bits array<long>, tok long")

    def prefixes(self, heavy) -> DataFrame:
        """(id, n, fa, fb, prefix): each document's prefix, rarest shingle first."""
        n, percent = self.n, self.percent

        def run(batches):
            free_worker_cache()
            words = WordHasher(SPACE_WORDS)
            known, rank = heavy.value
            for batch in batches:
                for i, j, x, edges in _blocks(batch, words, n):
                    size = np.diff(edges)
                    row = np.repeat(np.arange(j - i), size)
                    weight = np.zeros(len(x), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        weight = np.where(known[at] == x, rank[at], 0)
                    order = np.lexsort((x, weight, row))
                    place = np.arange(len(x)) - np.repeat(edges[:-1], size)
                    keep = place < np.repeat(np.where(size > 0, prefix_length(size, percent), 0), size)
                    fa, fb = _fingerprints(x, edges)
                    take = x[order][keep].view(np.int64)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=j - i))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(fa), pa.array(fb),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(take))], names=["id", "n", "fa", "fb", "prefix"])

        return self.docs.mapInArrow(run, f"id {self.kind}, n long, fa long, fb long, prefix array<long>")

    def sets_of(self, classes: DataFrame) -> DataFrame:
        """(cid, set) of the given classes, computed anew from their first documents' texts.

        A bit table of the wanted ids first drops nearly all other texts.
        """
        n = self.n
        near = among(self.docs, classes.select(F.col("rep").alias("id")), "id")

        def run(batches):
            free_worker_cache()
            words = WordHasher(SPACE_WORDS)
            for batch in batches:
                for i, j, x, edges in _blocks(batch, words, n):
                    fa, fb = _fingerprints(x, edges)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), pa.array(fa), pa.array(fb),
                         pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x.view(np.int64)))],
                        names=["id", "fa", "fb", "set"])

        found = near.mapInArrow(run, f"id {self.kind}, fa long, fb long, set array<long>")
        return found.join(classes.select("cid", F.col("rep").alias("id"), "fa", "fb"), ["id", "fa", "fb"]).select("cid", "set")

    # ------------------------------------------------------------ steps

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.round += 1
        self.names[self.round] = f"{name}-{self.round}"
        with spent_shuffles(self.spark):
            return self.ws.save(df, self.names[self.round])

    def spent(self, first: int, last: int) -> None:
        """Remove the tables saved as number ``first`` to ``last``, which no later step reads."""
        self.ws.drop(*[self.names.pop(i) for i in range(first, last + 1) if i in self.names])

    def compare(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b, na, nb, overlap) of pairs of classes (a, b).

        The overlap is exact wherever the parity tables leave it possible that the two link;
        elsewhere it is the upper bound that the tables give, which is too small for a link.
        Only the classes that occur in pairs are shuffled with their tables.
        """
        before = self.round
        pairs = self.save(pairs, "pairs")
        ids = self.save(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "ids")
        # no semi-join: Spark would put it before the bit table and shuffle all classes
        classes = self.save(among(classes.select("cid", "n", "rep", "fa", "fb", "bits"), ids, "cid").join(ids, "cid"), "sides")
        side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits_" + x))
        half = lambda c: F.zip_with(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2 + 1).cast("int"), (F.size(c) / 2).cast("int")),
                                    lambda x, y: x.bitwiseXOR(y))
        fold = lambda c, other: F.when(F.size(c) == 2 * F.size(other), half(c)).otherwise(F.col(c))
        bits = F.aggregate(F.zip_with(fold("bits_a", "bits_b"), fold("bits_b", "bits_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                           F.lit(0), lambda t, x: t + x)  # null where one table is four times the other or more
        differ = F.greatest(F.abs(F.col("na") - F.col("nb")), bits.cast("long"))
        bounded = self.save(pairs.join(side("a"), "a").join(side("b"), "b").select(
            "a", "b", "na", "nb", F.floor((F.col("na") + F.col("nb") - differ) / 2).cast("long").alias("overlap")), "bounded")
        open_ = self.linked(bounded).select("a", "b")
        wanted = open_.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "rep", "fa", "fb"), "cid")
        sets = self.sets_of(wanted)
        sets = self.save(sets.dropDuplicates(["cid"]) if self.repeats else sets, "sets")
        one = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
        two = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
        exact = open_.join(one, "b").join(two, "a").select(
            "a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"),
            F.size(F.array_intersect("sa", "sb")).cast("long").alias("overlap"))
        rest = bounded.filter(~reaches(F.col("overlap"), F.col("na"), F.col("nb"), self.percent))
        compared = self.save(exact.unionByName(rest), "compared")
        self.spent(before + 1, self.round - 1)
        return compared

    def linked(self, compared: DataFrame) -> DataFrame:
        return compared.filter(reaches(F.col("overlap"), F.col("na"), F.col("nb"), self.percent))

    def components(self, links: DataFrame) -> DataFrame:
        """(node, comp) of every node of ``links`` (a, b): the smallest node it reaches.

        Each round maps every node to the smallest of itself and its neighbours and keeps the
        edges between the images, so the graph shrinks at least by half.
        """
        edges = self.save(links.select("a", "b").filter("a <> b").distinct(), "edges")
        labels = None
        while True:
            both = edges.union(edges.select("b", "a"))
            step = self.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "step")
            if labels is None:
                labels = step.select("node", F.col("to").alias("comp"))
            else:
                labels = self.save(labels.join(step.select(F.col("node").alias("comp"), "to"), "comp", "left")
                                   .select("node", F.coalesce("to", "comp").alias("comp")), "labels")
            one = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
            two = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
            edges = self.save(edges.join(one, "a").join(two, "b").filter("ta <> tb")
                              .select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "edges")
            if edges.isEmpty():
                return labels

    def classes(self, documents: DataFrame) -> DataFrame:
        """(cid, n, fa, fb, rep, mins, marks, bits): distinct sets, each with its smallest id."""
        return self.save(documents.filter("n > 0 and id is not null").groupBy("n", "fa", "fb")
                         .agg(F.min("id").alias("rep"), F.first(F.struct("mins", "marks", "bits")).alias("s"))
                         .select("n", "fa", "fb", "rep", "s.*")
                         .withColumn("cid", F.monotonically_increasing_id()), "classes")

    def stars(self, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stars (cid, star, off = |x without centre|) and their links (a centre, b member)."""
        band = classes.select("cid", "n", "marks", F.posexplode(F.slice("mins", 1, BANDS)).alias("k", "m"))
        # a few centres, by hash: a large family rarely has all its members near one of them
        picks = [F.min(F.struct(F.xxhash64("cid", F.lit(i)).alias("h"), "cid")).alias(f"p{i}") for i in range(CENTRES)]
        heads = band.groupBy("k", "m").agg(F.count("*").alias("c"), *picks).filter("c > 1") \
            .select("k", "m", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.cid") for i in range(CENTRES)]))).alias("a"))
        pairs = band.join(heads, ["k", "m"]).filter("cid <> a").select("a", F.col("cid").alias("b"), "n", "marks")
        centre = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma"))
        near = pairs.dropDuplicates(["a", "b"]).join(centre, "a") \
            .filter((100 * F.least("n", "na") >= self.percent * F.greatest("n", "na")) & (agreement("marks", "ma") >= AGREE)).select("a", "b")
        met = self.linked(self.compare(near, classes))
        member = met.groupBy(F.col("b").alias("cid")).agg(F.min(F.struct((F.col("nb") - F.col("overlap")).alias("off"), "a")).alias("s")) \
            .select("cid", F.col("s.a").alias("star"), F.col("s.off").alias("off"))
        return member, met.select("a", "b")

    def attach(self, classes: DataFrame, comps: DataFrame) -> DataFrame:
        """``comps`` after comparing components of a common minimum with the largest one there.

        Of each component four members, picked by hash, stand for it; so a list of c components
        gives 4 (c - 1) pairs at most, whatever the sizes.  Those whose sizes or minimum hashes
        differ too much are not compared.  Rounds with other picks follow as long as one joins a
        hundredth of the components that share lists.
        """
        band = classes.select("cid", "n", "marks", F.posexplode(F.slice("mins", BANDS + 1, BANDS)).alias("k", "m")).join(comps, "cid")
        mixed = band.groupBy("k", "m").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("k", "m")
        band = self.save(band.join(mixed, ["k", "m"]).select("k", "m", "cid", "n", "marks"), "band")
        left, turn = None, 0
        while True:
            salts = [F.xxhash64("k", F.lit(4 * turn + i)) for i in range(4)]
            part = band.join(comps, "cid").groupBy("k", "m", "comp").agg(
                F.count("*").alias("c"), *[F.min(F.struct(F.col("cid").bitwiseXOR(x).alias("h"), "cid", "n", "marks")).alias(f"p{i}") for i, x in enumerate(salts)])
            part = self.save(part.select("k", "m", "comp", "c", F.array(*[F.col(f"p{i}").dropFields("h") for i in range(4)]).alias("some")), "parts")
            big = part.groupBy("k", "m").agg(F.max(F.struct("c", "comp", "some")).alias("big"), F.count("*").alias("parts")).filter("parts > 1")
            met = self.save(part.join(big, ["k", "m"]), "met")
            waiting = met.agg(F.count_distinct("comp")).first()[0]
            if not waiting or (left is not None and 100 * waiting > 99 * left):
                return comps
            pairs = met.filter("comp <> big.comp") \
                .select(F.explode(F.arrays_zip(F.col("big.some").alias("x"), F.col("some").alias("y"))).alias("p")) \
                .filter((100 * F.least("p.x.n", "p.y.n") >= self.percent * F.greatest("p.x.n", "p.y.n")) & (agreement("p.x.marks", "p.y.marks") >= AGREE)) \
                .select(F.least("p.x.cid", "p.y.cid").alias("a"), F.greatest("p.x.cid", "p.y.cid").alias("b")).distinct()
            comps = self.unite(comps, self.linked(self.compare(pairs, classes)).select("a", "b"))
            left, turn = waiting, turn + 1

    def lists(self, classes: DataFrame, info: DataFrame, heavy) -> DataFrame:
        """Pairs of stars (a < b) of different components that meet in some posting list."""
        prefix = self.prefixes(heavy).join(classes.select("cid", F.col("rep").alias("id"), "fa", "fb", "n"), ["id", "fa", "fb", "n"])
        posting = prefix.select("cid", F.posexplode("prefix").alias("pos", "tok"))
        around = Window.partitionBy("tok").orderBy("cid")
        shared = posting.withColumns({"before": F.lag("cid").over(around), "after": F.lead("cid").over(around)}) \
            .filter("before <> cid or after <> cid").select("tok", "cid", "pos")  # most lists hold one class
        shared = self.save(shared, "shared")  # so the shuffles of all postings are gone before the next
        entry = self.save(shared.join(info.select("cid", "n", "star", "comp"), "cid").groupBy("tok", "star", "comp").agg(
            F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest")), "entries")
        mixed = entry.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("tok")
        entry = entry.join(mixed, "tok")
        # blocks by size: two sets that link differ by one block at most
        base = float(np.log(100 / self.percent))
        block = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.lit(base)).cast("int")
        one = entry.select("tok", F.explode(F.sequence(block("low"), block("high"))).alias("block"),
                           *[F.col(c).alias("a_" + c) for c in ("star", "comp", "low", "high", "rest")])
        two = entry.select("tok", F.explode(F.sequence(block("low") - 1, block("high") + 1)).alias("block"),
                           *[F.col(c).alias("b_" + c) for c in ("star", "comp", "low", "high", "rest")])
        p = self.percent
        fits = (F.col("a_star") < F.col("b_star")) & (F.col("a_comp") != F.col("b_comp")) \
            & (100 * F.col("a_high") >= p * F.col("b_low")) & (100 * F.col("b_high") >= p * F.col("a_low")) \
            & reaches(F.least("a_rest", "b_rest"), F.col("a_low"), F.col("b_low"), p)
        return one.join(two, ["tok", "block"]).filter(fits).select(F.col("a_star").alias("a"), F.col("b_star").alias("b")).distinct()

    def members(self, met: DataFrame, info: DataFrame, comps: DataFrame, classes: DataFrame):
        """Links between members of stars whose centres do not link, until none can be missed."""
        p = self.percent
        ranked = self.save(info.withColumn("at", F.row_number().over(Window.partitionBy("star").orderBy(F.desc("off"), "cid"))), "ranked")
        extent = ranked.groupBy("star").agg(F.max("off").alias("off"), F.min("n").alias("low"), F.max("at").alias("many"),
                                                F.max(F.col("cid") != F.col("star")).alias("others"))
        side = lambda x: extent.select(F.col("star").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("off", "low", "many", "others")])
        open_ = met.join(side("a"), "a").join(side("b"), "b").filter(F.col("a_others") | F.col("b_others")) \
            .filter(reaches(F.col("overlap") + F.col("a_off") + F.col("b_off"), F.col("a_low"), F.col("b_low"), p)) \
            .select("a", "b", "overlap", F.greatest("a_many", "b_many").alias("many"))
        open_ = self.save(open_, "open")
        low, high = 0, 4
        while True:
            to = lambda x: comps.select(F.col("cid").alias(x), F.col("comp").alias("c" + x))
            open_ = self.save(open_.filter(F.col("many") > low).join(to("a"), "a").join(to("b"), "b")
                              .filter("ca <> cb").drop("ca", "cb"), "open")
            if open_.isEmpty():
                return comps
            of = lambda x: ranked.filter(F.col("at") <= high).select(
                F.col("star").alias(x), F.col("cid").alias("m" + x), F.col("n").alias("n" + x), F.col("off").alias("o" + x), F.col("at").alias("at" + x))
            pairs = open_.join(of("a"), "a").join(of("b"), "b").filter((F.col("ata") > low) | (F.col("atb") > low)) \
                .filter("ma <> mb") \
                .filter(100 * F.least("na", "nb") >= p * F.greatest("na", "nb")) \
                .filter(reaches(F.col("overlap") + F.col("oa") + F.col("ob"), F.col("na"), F.col("nb"), p)) \
                .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
            found = self.linked(self.compare(pairs, classes))
            comps = self.unite(comps, found.select("a", "b"))
            low, high = high, high * 8

    def unite(self, comps: DataFrame, links: DataFrame) -> DataFrame:
        """``comps`` (cid, comp) after adding links between classes."""
        to = lambda x: comps.select(F.col("cid").alias(x), F.col("comp").alias("c" + x))
        edges = links.join(to("a"), "a").join(to("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b")
        before = self.round
        labels = self.components(edges).withColumnRenamed("comp", "to")
        comps = self.save(comps.join(labels, comps["comp"] == labels["node"], "left")
                          .select("cid", F.coalesce("to", "comp").alias("comp")), "comps")
        self.spent(before + 1, self.round - 1)
        return comps

    def run(self) -> DataFrame:
        rows = self.save(self.signatures(), "signatures")
        documents = rows.filter("tok is null")
        top = rows.filter("tok is not null").groupBy("tok").agg(F.sum("n").alias("c")) \
            .orderBy(F.desc("c"), "tok").limit(HEAVY).collect()
        tok = np.array([r["tok"] for r in top], np.int64).view(np.uint64)
        rank = np.arange(len(tok), 0, -1)
        order = np.argsort(tok)
        heavy = self.spark.sparkContext.broadcast((tok[order], rank[order]))
        classes = self.classes(documents)
        documents = self.save(documents.select("id", "n", "fa", "fb"), "documents")
        self.spent(1, 1)
        ids = documents.filter("n > 0 and id is not null").agg(F.count("id"), F.count_distinct("id")).first()
        self.repeats = ids[0] != ids[1]
        member, links = self.stars(classes)
        before = self.round
        labels = self.components(links)
        comps = self.save(classes.select("cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
                          .select("cid", F.coalesce("comp", "cid").alias("comp")), "comps")
        self.spent(before + 1, self.round - 1)
        comps = self.attach(classes, comps)
        info = self.save(classes.select("cid", "n").join(member, "cid", "left").join(comps, "cid").select(
            "cid", "n", F.coalesce("star", "cid").alias("star"), F.coalesce("off", F.lit(0)).cast("long").alias("off"), "comp"), "info")
        before = self.round
        met = self.compare(self.lists(classes, info, heavy), classes)
        self.spent(before + 1, self.round - 1)
        comps = self.unite(comps, self.linked(met).select("a", "b"))
        comps = self.members(met, info, comps, classes)
        smallest = classes.join(comps, "cid").groupBy("comp").agg(F.min("rep").alias("component"))
        named = classes.join(comps, "cid").join(smallest, "comp").select("n", "fa", "fb", "component")
        linked = documents.filter("n > 0 and id is not null").select("id", "n", "fa", "fb").join(named, ["n", "fa", "fb"]) \
            .select("id", "n", "component")
        alone = documents.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
        out = self.save(linked.unionByName(alone), "result")
        self.spent(1, self.round - 1)
        return out


def groups(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, *, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n (set size), component (smallest id reachable by links)."""
    return Join(spark, docs, id_col, text_col, n, percent).run()
