"""Jaccard groups, decontamination, sharding, token files, SentencePiece, search, pipeline."""

import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as E
import corpus_pipeline
from flowsentry.llm import ann, decontam, jaccard, sharding, tokenbin, viterbi
from flowsentry.llm.common import ALNUM_WORDS, SEGMENT, WordHasher, utf8
from flowsentry.llm.queries import QUERIES, vocabulary
from oracle_check import check

SF = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op4_ngram_jaccard", "op8_decontaminate", "op9_chat_round_trip"])
def test_queries_match_sql(spark, name):
    assert check(spark, "/root/testdata/sf0.001", [name], verbose=False)[name][0] == "OK"


# ---------------------------------------------------------------- word hashes


def test_word_hashes_tell_words_apart():
    """Words of all lengths, across segment edges, and long words that collide modulo 2^64."""
    rng = random.Random(5)
    hasher = WordHasher(ALNUM_WORDS)
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    words = ["".join(rng.choice("aBcé7") for _ in range(rng.choice([1, 2, 7, 63, 64, 65, 300]))) for _ in range(20_000)]
    words += [thue, thue.translate({97: 98, 98: 97}), thue.upper()]
    words += rng.choices(words, k=20_000)
    data, offsets = utf8(pa.array([" ".join(words[i::7]) for i in range(7)]))
    h, start, end, row = hasher.words(data, offsets)
    assert len(data) > 20 * SEGMENT and ((start // SEGMENT) != ((end - 1) // SEGMENT)).sum() > 5
    flat = [w.translate(LOWER) for i in range(7) for w in words[i::7]]
    assert [data[a:b].tobytes().decode().translate(LOWER) for a, b in zip(start, end)] == flat
    known = {}
    assert all(known.setdefault(w, x) == x for w, x in zip(flat, h.tolist()))
    assert len(set(known.values())) == len(known)


def test_long_words_do_not_collide(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, thue), (2, other), (3, thue.upper())], "doc_id long, text string")
    got = {r.id: r.component for r in jaccard.groups(spark, docs, "doc_id", "text", n=4, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([("x", other)], "item_id string, text string")
    found = decontam.contamination(spark, docs, items, id_col="doc_id", text_col="text", item_id="item_id", item_text="text")
    assert {r.id: r["items"] for r in found.collect()} == {1: [], 2: ["x"], 3: []}


# ---------------------------------------------------------------- Jaccard


def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    group = {i: i for i in ids}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and root(a) != root(b):
                o = len(sets[a] & sets[b])
                if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                    group[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, words, copies, changes):
    base = [rng.choice(words) for _ in range(rng.randint(20, 60))]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
        if rng.random() < 0.3:
            base = w  # copies of copies: chains whose ends do not link
    return out


@pytest.mark.parametrize("n,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_groups_match_brute_force(spark, n, percent, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "É", "x\x00y"]
    texts = [t for _ in range(12) for t in family(rng, words, rng.randint(1, 25), 4)]
    texts += ["", None, " \t\n", "one", "ONE", "one two", "one two three", "a b c d", "A b\tc\nd", "b c d a"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component long").repartition(5)
    got = {r.id: (r.n, r.component) for r in jaccard.groups(spark, docs, "doc_id", "text", n=n, percent=percent).collect()}
    assert got == brute_groups(rows, n, percent)


def test_groups_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "x y z u v w"), (None, "a b c d e f"), (9, long), (7, long), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.n, r.component) for r in jaccard.groups(spark, docs, "doc_id", "text").collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (3, 2, 3), (None, 2, None), (9, 59_996, 7), (7, 59_996, 7), (5, 0, 5)], key=str)
    assert jaccard.groups(spark, docs.limit(0), "doc_id", "text").count() == 0


def test_parity_bound_never_undercuts():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(40)]
    words, ends = jaccard._parities(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    tables = [words[a:b] for a, b in zip(ends[:-1], ends[1:])]
    assert {len(t) for t in tables} == {16, 32, 64}
    for i in range(40):
        for j in range(40):
            x, y = sorted((tables[i], tables[j]), key=len)
            while len(y) > len(x):
                y = y[:len(y) // 2] ^ y[len(y) // 2:]
            differ = sum(bin(int(w) & (2 ** 64 - 1)).count("1") for w in x ^ y)
            assert len(np.intersect1d(sets[i], sets[j])) <= (len(sets[i]) + len(sets[j]) - differ) / 2


def test_groups_of_sizes_around_a_table_step(spark):
    """Sets of 240 to 290 shingles: their parity tables have 1,024 or 2,048 bits."""
    words = [f"w{i}" for i in range(294)]
    rows = [(i, " ".join(words[:243 + 10 * i])) for i in range(6)] + [(10, " ".join(words[50:])), (11, " ".join(words[:294 - 20]))]
    rows += [(20 + i, " ".join(f"v{i}-{j}" for j in range(200 + 30 * i))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n, r.component) for r in jaccard.groups(spark, docs, "doc_id", "text", n=4, percent=85).collect()}
    assert got == brute_groups(rows, 4, 85)


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items, window, slop=0):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    doc, hit, found = re.findall(word, (text or "").translate(LOWER)), set(), set()
    for item, body in items:
        w = re.findall(word, (body or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            g = w[i:i + window]
            for s in range(len(doc) - len(g) + 1):
                if doc[s:s + len(g)] == g:
                    found.add(str(item))
                    hit |= set(range(s, s + len(g)))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("group_bytes,max_terms", [(64 << 20, 2_000_000), (60, 2_000_000), (64 << 20, 3)])
def test_contamination_matches_brute_force(spark, group_bytes, max_terms):
    rng = random.Random(5)
    words = ["a", "B", "é", "c1", "x"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(k))
    items = [(i, text(rng.randint(1, 9))) for i in range(12)] + [(12, None), (13, "?!"), (0, "zz top"), (None, "a")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (7, "a a a"), (None, "zz TOP")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(spark, d, b, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window=4,
                                 group_bytes=group_bytes, max_terms=max_terms).collect()
    mine = sorted((str(r.id), r.n_words, sum(s.last - s.first for s in r.spans), list(r["items"])) for r in got)
    known = [(i, t) for i, t in items if i is not None]
    assert mine == sorted((str(i), *brute_hits(t, known, 4)) for i, t in docs)


@pytest.mark.parametrize("group_bytes", [64 << 20, 8])
def test_items_without_an_id_are_searched(spark, tmp_path, group_bytes):
    docs = [(0, "x alpha beta y"), (1, "gamma delta"), (2, "alpha beta, gamma delta eta"), (3, "eta alpha")]
    items = [(None, "alpha beta"), (None, "gamma delta"), (5, "delta eta")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(spark, d, b, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window=2,
                                 group_bytes=group_bytes, unnamed=True).collect()
    assert {r.id: list(r["items"]) for r in got} == {0: [None], 1: [None], 2: ["5", None], 3: []}
    assert {r.id: sum(s.last - s.first for s in r.spans) for r in got} == {i: brute_hits(t, items, 2)[1] for i, t in docs}
    sf = str(tmp_path)
    d.write.parquet(f"{sf}/documents.parquet")
    b.write.parquet(f"{sf}/benchmark.parquet")
    hit = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in QUERIES["op8_decontaminate"](spark, sf).collect()}
    assert hit == {0: (2, 1, True), 1: (2, 1, True), 2: (5, 2, True), 3: (0, 0, False)}
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, d, sf).collect()] == [3]


def test_proximity_and_empty(spark):
    d = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x y z beta gamma"), (3, "gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    run = lambda d, b, **k: decontam.contamination(spark, d, b, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", **k)
    assert {r.id for r in run(d, b, slop=1).collect() if r["items"]} == {1}
    assert {r.id for r in run(d, b).collect() if r["items"]} == set()
    assert {len(r["items"]) for r in run(d, b.limit(0)).collect()} == {0}
    assert run(d.limit(0), b).count() == 0


# ---------------------------------------------------------------- sharding


def test_shards_are_balanced_contiguous_and_whole(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op6_byte_shards"](spark, sf).toPandas()
    text = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    got["text"] = text[got.doc_id].values
    assert sorted(got.doc_id) == sorted(text.index)
    assert (got["size"] == got.text.map(lambda t: len(t.encode()) + 8)).all()
    assert (got.text_crc32 == got.text.map(lambda t: zlib.crc32(t.encode()))).all()
    bytes_of = got.groupby("shard")["size"].sum()
    assert len(bytes_of) == 24 and bytes_of.max() / bytes_of.min() < 1.05
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert (got.groupby("text").shard.nunique() == 1).all()


@pytest.mark.parametrize("copies", [1, 2, 4, 150])
def test_shards_equal_a_brute_force_cut(spark, copies):
    """Small groups stay whole, a boundary moves at most 5 % of a shard, larger groups are cut at a row."""
    rng = random.Random(copies)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(20, 200))) for _ in range(2400 // copies)]
    docs = spark.createDataFrame([(i * copies + c, t) for i, t in enumerate(texts) for c in range(copies)], "doc_id long, text string")
    ws = sharding.Workspace(spark, "test-shards")
    placed, total = sharding.positions(ws, docs, "doc_id", "text")
    rows = placed.orderBy("start").toPandas()
    edges = [*rows.start, total]
    whole = [a for a, (x, y) in zip(edges, zip([None, *rows.grp], [*rows.grp, None])) if x != y]
    nearest = lambda at, t: min(at, key=lambda e: (abs(e - t), e))
    cuts = []
    for j in range(1, 24):
        t = -(-total * j // 24)
        edge = nearest(whole, t)
        cuts.append(edge if abs(edge - t) <= 0.05 * total / 24 else nearest(edges, t))
    assert sharding.cut_points(placed, total, 24, 0.05) == cuts
    got = sharding.assign(spark, docs, "doc_id", "text").join(docs.withColumnRenamed("doc_id", "id"), "id").toPandas()
    if 1 < copies < 5:
        assert (got.groupby("text").shard.nunique() == 1).mean() > 0.99
    bytes_of = got.groupby("shard")["size"].sum()
    assert len(bytes_of) == 24 and bytes_of.max() - bytes_of.min() <= 0.2 * total / 24 + 2 * rows["size"].max()


def test_shards_edge_cases(spark):
    rows = [(i, "same text") for i in range(400)] + [(None, None), (500, ""), (501, "é" * 50_000), (1, "same text")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int")
    got = sharding.assign(spark, docs, "doc_id", "text", shards=4).toPandas()
    assert len(got) == len(rows) and got["size"].min() == 8
    assert {r.crc for r in got.itertuples() if r.size == 8} == {0}
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    hot = sharding.assign(spark, docs.filter("text = 'same text'"), "doc_id", "text", shards=4).toPandas()
    assert hot.groupby("shard")["size"].sum().max() <= 1.1 * hot["size"].sum() / 4  # a hot group is cut
    assert sharding.assign(spark, docs.limit(0), "doc_id", "text").count() == 0


# ---------------------------------------------------------------- token files


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 64, 65, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4") if n % 2 else rng.integers(0, 50_000, n).astype("<u4")
        assert (tokenbin.from_planes(tokenbin.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_random_access(kind):
    class Sink(io.BytesIO):
        def close(self):
            pass

    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 5, 1, 300, 0, 64, 128, 2)]
    sink = Sink()
    writer = tokenbin.Writer(sink, kind, block_ids=64)
    writer.add(pa.array([1, 2, 3, None]), [d.tobytes() for d in docs[:4]])
    writer.add(pa.array([5, 6, 7, 8]), [d.tobytes() for d in docs[4:]])
    writer.close()
    reader = tokenbin.Reader(sink, len(sink.getvalue()))
    every = np.concatenate(docs)
    for first, count in ((0, len(every)), (63, 2), (64, 64), (100, 0), (499, 1)):
        assert (reader.ids(first, count) == every[first:first + count]).all()
    back = defaultdict(list)
    for row, ids, _ in reader.documents():
        back[row].append(ids)
    assert all((np.concatenate(back[i]) == d).all() for i, d in enumerate(docs))
    assert reader.doc_ids.to_pylist() == [1, 2, 3, None, 5, 6, 7, 8]


ODD = [" ", "  ", "\n", "\n\n", " \n", "\t", "\x1c", "\x85", "\xa0", "a", "B", "é", "’", "'s", "12", "!!", ".", ",", "▁", "▁▁", "日本",
       "𝔘", "​", "<|endoftext|>", "<s>", "the", "ing", "　", " " * 20, "aaaaaaaa", "======", "\r\n", "thing.", "\nThe", "½", "²"]


def odd_texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_the_library(spark):
    from tokenizers import Tokenizer
    path = vocabulary("byte_bpe_50k.json")
    lib, mine = Tokenizer.from_file(path), tokenbin.Encoder(path)
    lib.encode_special_tokens = True
    for t in odd_texts(3000):
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_hold_added_tokens(spark):
    from tokenizers import Tokenizer
    path = vocabulary("byte_bpe_50k.json")
    lib, mine = Tokenizer.from_file(path), tokenbin.Encoder(path, added=True)
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|>\n b", "plain <|endoftext |> text"]
    for t in texts + odd_texts(3000, 7):
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tokenbin.round_trip(spark, docs, "doc_id", "text", path).collect(), key=lambda r: r.doc_id)
    ids = [np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4") for t in texts]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(i), zlib.crc32(i.tobytes())) for i in ids]
    assert [r.start for r in got] == np.cumsum([0] + [len(i) for i in ids[:-1]]).tolist()


def test_token_files_hold_the_corpus(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = QUERIES["op5_token_planes"](spark, SF).toPandas().sort_values("doc_id")
    text, at = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text, 0
    assert got.doc_id.tolist() == sorted(text.index)
    for r in got.itertuples():
        ids = np.array(lib.encode(text[r.doc_id], add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_edge_cases(spark):
    docs = spark.createDataFrame([(2, None, 1), (1, "", 1), (2, "a", 1), (None, "b", 1), (3, "word " * 50_000, 1)], "doc_id long, text string, start int")
    got = tokenbin.round_trip(spark, docs, "doc_id", "text", vocabulary("byte_bpe_50k.json"), kind="bit").toPandas()
    assert sorted(got.n_tokens.tolist())[:4] == [1, 1, 2, 2] and len(got) == 5
    assert sorted(got.start + got.n_tokens)[-1] == got.n_tokens.sum()
    assert tokenbin.round_trip(spark, docs.limit(0), "doc_id", "text", vocabulary("byte_bpe_50k.json")).count() == 0


# ---------------------------------------------------------------- SentencePiece


def test_bpe_model_equals_the_library():
    import sentencepiece
    path = vocabulary("piece_bpe_32k.model")
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=path), viterbi.Coder(viterbi.PieceModel.load(path))
    for t in odd_texts(3000) + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:200]:
        ids = mine.encode(t)
        assert ids.tolist() == lib.encode(t), repr(t)
        assert mine.decode(ids) == lib.decode(ids.tolist()) == t.replace("▁", " ")


def test_window_stays_bounded():
    model = viterbi.PieceModel.load(vocabulary("piece_bpe_32k.model"))
    lattice = viterbi.Lattice(model)
    text = "▁inthethatandtion" * 3000
    pieces = [p for i in range(0, len(text), 997) for p in lattice.feed(text[i:i + 997])] + lattice.finish()
    assert "".join(pieces) == text and lattice.widest <= 8 * model.longest


def test_unigram_model_is_viterbi():
    rng = random.Random(1)
    for _ in range(40):
        vocab = {c: -rng.uniform(3, 6) for c in "abc"} | {"".join(rng.choices("abc", k=rng.randint(2, 4))): -rng.uniform(1, 9) for _ in range(12)}
        model = viterbi.PieceModel([("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in vocab.items()], "unigram", False)
        text = "".join(rng.choices("abcd", k=rng.randint(1, 60)))
        best = [0.0] + [-1e18] * len(text)
        for i in range(1, len(text) + 1):
            for n in range(1, 5):
                s = vocab.get(text[i - n:i] if n <= i else None, model.unknown_score if n == 1 else None)
                if s is not None and n <= i:
                    best[i] = max(best[i], best[i - n] + s)
        lattice = viterbi.Lattice(model)
        pieces = [p for c in text for p in lattice.feed(c)] + lattice.finish()
        assert "".join(pieces) == text
        assert sum(vocab.get(p, model.unknown_score) for p in pieces) == pytest.approx(best[-1])


def test_piece_queries(spark):
    got = QUERIES["op7_piece_viterbi"](spark, SF)
    assert got.count() == 1000 and got.filter("not round_trip").count() == 0
    path = vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, None, [1]), (2, "", [1]), (None, "a b", [1]), (3, "x" * 200_000, [1])], "doc_id long, text string, ids array<int>")
    rows = viterbi.with_ids(docs, "text", path, only=("doc_id",))
    assert {r.doc_id: r.text for r in viterbi.decoded(rows, "ids", path).collect()} == {1: "", 2: "", None: "a b", 3: "x" * 200_000}
    assert viterbi.with_ids(docs.limit(0), "text", path, only=("doc_id",)).count() == 0


# ---------------------------------------------------------------- search


@pytest.mark.parametrize("sf, options", [("sf0.01", None), ("sf0.1", None), ("sf0.1", {"part_rows": 100})])
def test_search_recall(spark, sf, options):
    """The registered search (no options), and one of smaller parts."""
    sf = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = QUERIES["op1_learned_partitions"](spark, sf).toPandas() if options is None else \
        ann.nearest(spark, rows, rows.filter("vec_id % 20 = 0"), id_col="vec_id", vector_col="embedding", **options).toPandas()
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    x = np.stack(e.embedding).astype(float)
    hit = total = 0
    for i, part in got.groupby("query_id"):
        at = int(np.flatnonzero(e.vec_id == i)[0])
        s = x @ x[at]
        s[at] = -np.inf
        order = np.lexsort((e.vec_id, -s))[:20]
        hit += len(set(part.vec_id) & set(e.vec_id.values[order]))
        total += 20
        assert part.score.tolist() == pytest.approx([float(s[np.flatnonzero(e.vec_id == v)[0]]) for v in part.vec_id], abs=1e-12)
        assert part.sort_values("rank")["rank"].tolist() == list(range(1, len(part) + 1))
    print(sf, options, hit / total, got.parts.mean(), got.parts.max())
    assert hit / total >= 0.9 and got.query_id.nunique() == (e.vec_id % 20 == 0).sum()
    assert got.parts.max() <= (8 if options is None else 20)


def test_search_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [2.0, 0.0]), (101, None), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [inf, 1.0]),
                                                     (105, [None, 1.0]), (106, [1.0]), (None, [1.0, 1.0]), (100, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(spark, df, df.filter("vec_id in (0, 5, 101)"), id_col="vec_id", vector_col="embedding", k=20).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 5, 101)}
    assert by[0] == [100, *range(1, 20)] and by[5] == [100, 0, 1, 2, 3, 4, *range(6, 20)] and by[101] == []
    few = df.filter("vec_id in (1, 2, 100)")
    assert len(ann.nearest(spark, few, few.filter("vec_id = 1"), id_col="vec_id", vector_col="embedding").collect()) == 2
    assert ann.nearest(spark, df.limit(0), df.limit(0), id_col="vec_id", vector_col="embedding").count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "ngram_jaccard":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            want = brute_groups(rows, 5, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name == "decontamination":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect() if not brute_hits(r.text, bench, 10)[2]}
        if name == "sentencepiece":
            text = {r.doc_id: r.text for r in docs.collect()}
            assert {r.doc_id: list(r.ids) for r in out.collect()} == {i: lib.encode(t) for i, t in text.items()}
        docs = out


def test_pipeline_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, x int, rows int, fits int, ids int, row_digest int"
    rows = [(1, "The and of text.", "en", "s", 3, "", 1, 1, 1, 1, 1), (1, "The and of text.", "en", "s", 3, "", 1, 1, 1, 1, 1), (None, None, None, None, None, None, None, None, None, None, None),
            (2, "", "en", "s", 3, "", 1, 1, 1, 1, 1), (None, "Another text of the and.", None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            if name == "sentencepiece":
                assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == table.count()
            else:
                assert out.columns == docs.columns and out.count() <= table.count()
    assert "pipeline" in E.queries()
