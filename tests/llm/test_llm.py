"""Training-data operators against brute force, round trips and edge cases."""

import gzip
import hashlib
import io
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkledger.llm import ivfpq, line_dedup, mixing, mtree, pieces, simhash_dedup, substring_dedup, token_counts, toxicity, util, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, v=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(v)}" for _ in range(n))


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


PASSAGE = prose(1, 60)
TEXTS = [prose(2, 80) + " " + PASSAGE + "\n" + prose(3, 30), PASSAGE + " " + prose(4, 50), "a b " * 40 + prose(5, 50), "x " * 36, "x " * 35, "y " * 34, "", None, " \n\t ", prose(6, 200), prose(6, 200), "z q " * 700, "Ä é 日本 🎉\x0b" * 3, prose(7, 9000)]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 2}, {"index_words": 50}])
def test_substring_dedup(spark, options):
    count = Counter()
    words = [(t or "").encode().split() for t in TEXTS]
    for w in words:
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = {}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs(spark, TEXTS), **options).collect()}
    assert got == want
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0


def test_substring_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, PASSAGE)] * 3 + [(None, PASSAGE), (None, prose(9, 40))], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(-1, 40, 0), (-1, 60, 60), (1, 60, 60), (1, 60, 60), (1, 60, 60)]


def brute_fingerprint(text, gram=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    runs = [b" ".join(w)] if len(w) < gram else [b" ".join(w[i : i + gram]) for i in range(len(w) - gram + 1)]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_components(spark):
    base = prose(11, 300)
    texts = TEXTS + [base, base.upper(), base + " tail"] + [" ".join(base.split()[:-k]) for k in (1, 2, 3)]
    fps = [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.simhash_components(docs(spark, texts)).collect()}
    assert got == {i: (f"{f:016x}", root[i]) for i, f in enumerate(fps)}


def test_links_of_crowded_buckets(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    values = {base} | {base ^ 1 << a ^ 1 << b for a in range(0, 40, 3) for b in range(1, 60, 7)} | {r.getrandbits(64) for _ in range(50)}
    signed = [simhash_dedup._signed(v) for v in values]
    edges = simhash_dedup.similar_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"))
    comp = {r.node: r.component for r in util.components(edges).collect()}
    group = {v: comp.get(v, v) for v in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert group[a] == group[b]


def test_covering_masks_cover():
    masks = simhash_dedup.covering_masks(2)
    assert len(masks) == 7
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a in range(64) for b in range(a))


def test_near_dedup_keeps_one(spark):
    base = prose(12, 400).split()
    near = list(base)
    near[200] = "other"
    texts = [" ".join(base), " ".join(near), " ".join(base), prose(13, 100), None, "", prose(14, 5)]
    df = docs(spark, texts).union(docs(spark, texts[3:4]).withColumn("doc_id", F.lit(3).cast("long")))
    got = simhash_dedup.near_dedup(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 3, 4, 6]


def test_near_dedup_against_brute_force(spark):
    r = random.Random(5)
    bases = [prose(100 + i, r.randrange(60, 600)) for i in range(12)] + [prose(130, 900)]
    texts = []
    for b in bases:
        for _ in range(5 if b is not bases[-1] else 60):
            w = b.split()
            for _ in range(r.randrange(len(w) // 40 + 1)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts.append(bases[0] + " " + " ".join(bases[1].split()[:400]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for j, b in enumerate(sets):
        for i in range(j):
            common = len(sets[i] & b)
            if common >= 0.8 * (len(sets[i]) + len(b) - common):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    got = sorted(x.doc_id for x in simhash_dedup.near_dedup(docs(spark, texts)).collect())
    assert got == sorted(set(root))


def test_line_dedup(spark):
    texts = [f"menu\nunique {i}\n\nmenu" for i in range(8)] + ["menu\nother", None, ""]
    df = docs(spark, texts, ["a"] * 8 + ["b", "a", None])
    args = (F.col("source"), F.split("text", "\\n"))
    got = {r.row.doc_id: (r.lines, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df, *args, ratio=0.5).collect()}
    assert got[0] == (["unique 0", ""], 3, 2) and got[8] == (["menu", "other"], 2, 0) and got[9] == ([], 0, 0) and got[10] == ([""], 0, 0)
    salted = {r.row.doc_id: (r.lines, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df, *args, ratio=0.5, limit=0, salts=3).collect()}
    assert salted == got
    copies = docs(spark, ["same\ntext"] * 6)
    assert {tuple(r.lines) for r in line_dedup.line_dedup(copies, *args).collect()} == {()}
    assert {tuple(r.lines) for r in line_dedup.line_dedup(copies, *args, spare_copies=True).collect()} == {("same", "text")}


def test_token_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    lengths = [0, 5, 0, 3000, 1, 0, 70]
    tokens = np.concatenate([np.append(rng.integers(0, 999, n), 50256) for n in lengths] + [rng.integers(0, 999, 4)]).astype("<u2")
    tokens.tofile(tmp_path / "t.bin")
    (tmp_path / "empty.bin").touch()
    files = spark.createDataFrame([(7, f"{tmp_path}/t.bin", tokens.nbytes), (8, f"{tmp_path}/empty.bin", 0)], "file long, path string, bytes long")
    for block in (2, 64, 1 << 20):
        got = token_counts.token_counts(files, block_bytes=block).orderBy("file", "ordinal").collect()
        assert [(r.file, r.ordinal, r.n_tokens) for r in got] == [(7, i, n) for i, n in enumerate([*lengths, 4])]


def test_op4_query(spark, tmp_path):
    """Every document's count, not their sum: null, empty, blank, repeated, long texts and null ids."""
    enc = token_counts.encoder(token_counts.TOKENIZER)
    texts = [*TEXTS, "long words here " * 30000, " ", "x"]
    df = docs(spark, texts).union(docs(spark, texts).where("doc_id in (0, 3)")).union(docs(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = token_counts.op4_token_counts(spark, str(tmp_path))
    count = next(c for c in got.columns if c.startswith("n_tok"))
    want = [(i, len(enc.encode_ordinary(t or ""))) for i, t in [*enumerate(texts), (0, texts[0]), (3, texts[3])]] + [(None, len(enc.encode_ordinary("no id")))]
    assert sorted(((r.doc_id, r[count]) for r in got.collect()), key=str) == sorted(want, key=str)
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert token_counts.op4_token_counts(spark, str(tmp_path / "none")).count() == 0


def vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim))


def test_exact_top_k(spark):
    x = np.floor(vectors(600, 9, 4) * 20)
    x[300:400] = x[299]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    got = mtree.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=100, query_rows=3).collect()
    for q in range(0, 600, 50):
        s = x @ x[q]
        best = sorted((-int(s[i]), i) for i in range(600) if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == best
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0, 1.0])], "vec_id long, x array<double>")
    assert [tuple(r) for r in mtree.top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 2)]


def exact_scores(rows, scale=1024):
    """The integer inner products of op5's contract."""
    whole = {i: [math.floor(scale * v) for v in x] for i, x in rows}
    return {q: sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole.items() if i != q and len(x) == len(y)))[:10] for q, x in whole.items() if q % 100 == 0}


def test_op5_query_of_large_and_odd_vectors(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, [r.choice([2.0**19, 2.0**43, 1.5, -3.25, 0.0, 1e200, -1e150]) * r.random() for _ in range(5)]) for i in range(240)]
    rows += [(i, [2.0**19 + r.random(), r.random(), 1.0]) for i in range(300, 420)] + [(500, [1.0]), (501, [2.0]), (600, [3.0, 4.0, 5.0, 6.0])]
    odd = [(700, None), (701, [float("nan")]), (702, [None]), (None, [1.0]), (703, [float("inf")]), (704, []), (800, [0.0])]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = mtree.op5_exact_top_k(spark, str(tmp_path)).collect()
    want = exact_scores([*rows, (800, [0.0])])
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    for q, best in want.items():
        assert [(x.vec_id, x.score) for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == [(i, clamp(-s)) for s, i in best], q
    assert {x.query_id for x in got} == {q for q, best in want.items() if best}


def test_m_tree_skips_entries():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 32)) * 300
    x = np.floor(centre[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 12)
    tree = mtree.MTree(np.arange(4000), x)
    q = np.arange(0, 4000, 100)
    got = tree.search(q, x[q], 10)
    assert tree.computed < 0.6 * len(q) * len(x)
    s = (x @ x[q].T).astype(int)
    for j, rows in enumerate(got):
        assert [(-a, b) for a, b in rows] == sorted((-int(s[i, j]), i) for i in range(4000) if i != q[j])[:10]


def test_op6_query_of_large_few_and_odd_vectors(spark, tmp_path):
    rows = [(0, [1e200, 1.0]), (1, [-1e200, 2.0]), (2, [1e200, 1.0]), (100, [3.0, 1e-200]), (7, [1e-200, 0.0]), (200, [1.0]), (300, [1e308] * 3), (301, [-1e308] * 3), (301, [-1e308] * 3)]
    odd = [(400, None), (401, [float("nan"), 1.0]), (402, [None, 1.0]), (None, [1.0, 1.0]), (500, [0.0, 0.0])]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for x in ivfpq.op6_nearest_neighbours(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert [i for i, _ in got[0]] == [2, 7, 100, 1] and [i for i, _ in got[100]] == [7, 0, 1, 2] and got[300] == [(301, np.inf)] * 2 and 200 not in got
    assert got[0][0][1] == 0 and got[0][3][1] == 2e200 and got[100][0][1] == 3.0


def test_op6_query_recall(spark):
    import duckdb

    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.01/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got, hit, n = ivfpq.op6_nearest_neighbours(spark, "/root/testdata/sf0.01").collect(), 0, 0
    for q in range(len(ids)):
        if ids[q] % 100 == 0:
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            best = sorted((d[i], int(ids[i])) for i in range(len(ids)) if i != q)[:10]
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[q])
            assert len(mine) == 10 and all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in mine)
            hit, n = hit + len({i for _, i in best} & {v for _, v, _ in mine}), n + 10
    assert hit >= 0.9 * n


def test_unusable_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0]), (2, None), (3, [nan]), (4, [float("inf")]), (5, [None])], "i int, x array<double>")
    assert [r.i for r in df.where(mtree.usable(F.col("x"))).collect()] == [1]


def test_nearest_neighbours_recall(spark):
    x = vectors(1500, 16, 5)
    x[:500] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    got = ivfpq.nearest_neighbours(df, df.where("vec_id % 100 = 0"), block_rows=200, lists=16, probes=12).collect()
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for _, i in sorted((d[i], i) for i in range(1500) if i != q)[:10]]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in mine)
        hit += len(set(best) & {r.vec_id for r in mine})
    assert hit >= 0.9 * 150
    assert ivfpq.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_warc_round_trip_and_dedup(spark):
    rows = [(1, "u", "a"), (2, None, "a"), (2, "v", "a"), (3, "w x\n", None), (5, "w", ""), (None, "z", "b"), (7, "q", "é" * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_warc(warc.write_warc(df, util.scratch(spark, "warc"))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to or 0) for r in got) == [(0, "response", 1, 0), (1, "revisit", 1, 2), (2, "response", 1, 0), (2, "revisit", 1, 2), (3, "revisit", 0, 5), (5, "response", 0, 0), (7, "response", 100000, 0)]
    assert {r.payload_digest for r in got if r.page_id == 1} == {warc.digest(b"a")}
    plain = warc.read_warc(warc.write_warc(df, util.scratch(spark, "warc"), least=2)).where("record_type = 'revisit'")
    assert plain.count() == 0
    assert warc.read_warc(warc.write_warc(df.limit(0), util.scratch(spark, "warc"))).count() == 0


def test_warc_reader_rejects():
    good = warc.record("response", "1", "u", b"body")
    assert [p for _, _, p in warc.records(io.BytesIO(good * 2))] == [b"body"] * 2
    plain = gzip.decompress(good)
    for bad in (gzip.compress(plain.replace(b"body", b"bodY")), gzip.compress(plain + b"x"), good[:-9], b"no gzip"):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))


def test_pieces_match_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["", "  a  b ", "\n\n x", "a" * 500 + "b" * 300, " ", "日本語 🎉 ok", "\tfoo\r\nbar", "internationalization" * 30, " " * 40 + "x", "Élégant über señor", prose(3, 400)]
    encoder = pieces.Encoder(pieces.piece_table())
    for t, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == sp.encode(t)
        assert pieces.piece_table().decode(ids.tolist()) == t


def unigram_file(tmp_path):
    """A Unigram model with the pieces of the file at hand and natural scores."""
    import math

    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for k, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -math.log(3 + k) * (1 + 0.001 * (k * 7919 % 100))
    (tmp_path / "unigram.model").write_bytes(m.SerializeToString())
    return str(tmp_path / "unigram.model")


ODD = ["", "  a  b ", "\n\n x", "a" * 70, "日本語 🎉 ok", "\tfoo\r\nbar", "internationalization" * 3, "Élégant über señor", None, "the the the", "x\u2581y"]


@pytest.mark.parametrize("unigram", [False, True])
def test_relational_lattice(spark, tmp_path, unigram):
    model = unigram_file(tmp_path) if unigram else pieces.MODEL
    df = docs(spark, [*ODD, prose(3, 60), prose(3, 60)])
    want = {r.doc_id: r.ids for r in pieces.encode(df, model).collect()}
    got = pieces.encode_relational(df, model)
    assert got.columns == [*df.columns, "ids"] and {r.doc_id: r.ids for r in got.collect()} == want
    assert pieces.encode_relational(df.limit(0), model).count() == 0


def test_unigram_fold_is_viterbi(tmp_path):
    """Against Viterbi over whole texts; and the library's ids wherever its single precision adds as exactly."""
    import sentencepiece

    path = unigram_file(tmp_path)
    table, sp = pieces.PieceTable(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in ODD if t] + [prose(i, 30) for i in range(40)]
    same = 0
    for t, ids in zip(texts, pieces.Encoder(table).encode(texts)):
        s = pieces.MARK + t.replace(" ", pieces.MARK)
        for dtype in (np.float64, np.float32):
            best, back = [dtype(0)] + [dtype(-np.inf)] * len(s), [0] * (len(s) + 1)
            for a in range(len(s)):
                for k in range(1, min(table.longest, len(s) - a) + 1):
                    i = table.of.get(s[a : a + k])
                    if i is not None or k == 1:
                        c = dtype(best[a] + dtype(table.worst if i is None else table.scores[i]))
                        if c > best[a + k]:
                            best[a + k], back[a + k] = c, k
            at, out = len(s), []
            while at:
                out.append(s[at - back[at] : at])
                at -= back[at]
            want = [i for w in out[::-1] for i in table._ids(w)]
            assert want == (ids.tolist() if dtype is np.float64 else sp.encode(t))
        same += ids.tolist() == sp.encode(t)
    assert same >= 0.9 * len(texts)


def test_op8_query_matches_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = [(r.doc_id, sp.encode(r.text or ""), pieces.MARK not in (r.text or "")) for r in table.collect()]
    want = spark.createDataFrame(want, "doc_id long, ids array<int>, same boolean").select("doc_id", F.size("ids").cast("long"), F.xxhash64("ids"), "same")
    got = pieces.op8_pieces(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_encode_edges(spark, tmp_path):
    clash = docs(spark, ["a b", "a b", "w" * 40000, "word " * 30000]).withColumns({"__text": F.lit(1), "_text": F.lit(2), "round_trip": F.lit(3)})
    got = pieces.encode(clash, check=True).orderBy("doc_id").collect()
    assert [r.round_trip for r in got] == [True] * 4 and got[0].ids == got[1].ids and got[0]._text == 2
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert pieces.op8_pieces(spark, str(tmp_path)).count() == 0


def test_encode_keeps_columns(spark):
    df = docs(spark, ["hello world", None, ""]).withColumn("ids", F.lit("clash"))
    got = pieces.decode(pieces.encode(df)).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == ["hello world", "", ""] and got[0].source == "s" and len(got[1].ids) == 0
    assert [r.round_trip for r in pieces.encode(df, check=True).orderBy("doc_id").collect()] == [True, True, True]


def test_mix(spark):
    r = random.Random(5)
    texts = [prose(i, r.randrange(1, 40)) for i in range(400)] + ["", None]
    sources = [r.choice(["a", "a", "a", "b", "c", "d", None]) for _ in texts]
    df = docs(spark, texts, sources)
    rows = mixing.mix(df).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    by = {}
    for x in rows:
        assert x.taken <= 2 * x.size
        t = by.setdefault(sources[x.doc_id], [x.target, 0, x.source_size])
        t[1] += x.taken
    assert all(abs(t - k) <= 20 for t, k, _ in by.values())
    assert abs(sum(t for t, *_ in by.values()) - 1.5 * sum(s for *_, s in by.values())) < 1e-6
    few = {r.doc_id: r.taken for r in mixing.mix(df, buckets=1).collect()}
    assert few == {r.doc_id: r.taken for r in rows}
    mixed = Counter(r.doc_id for r in mixing.mix_documents(df).collect())
    assert mixed == Counter({r.doc_id: r.taken // r.size for r in rows if r.taken})
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_ranks_by_the_quotient(spark):
    r = random.Random(11)
    lengths = [r.choice([1, 3, 9, 40, 200]) for _ in range(3000)]
    df = docs(spark, ["w " * n for n in lengths], [r.choice("ab") for _ in lengths])
    rows = {x.doc_id: x for x in mixing.mix(df, weights=(1,), share=0.6).collect()}
    drawn = {x.doc_id: x.u for x in df.select("doc_id", mixing.draw(F.col("doc_id")).alias("u")).collect()}
    times = {i: x.taken // x.size for i, x in rows.items()}
    mean = {n: sum(times[i] for i in times if lengths[i] == n) / lengths.count(n) for n in sorted(set(lengths))}
    # longer documents are expected more often; one order of the random numbers alone would give classes one threshold
    assert list(mean.values()) == sorted(mean.values()) and mean[200] > 2 * mean[1]
    plain = [(drawn[i], t, lengths[i]) for i, t in times.items() if rows[i].source_size == rows[0].source_size]
    taken, left = [u for u, t, _ in plain if t == 1], [u for u, t, _ in plain if t == 0]
    assert taken and left and max(taken) > min(left)
    for n in set(lengths):
        taken, left = [u for u, t, k in plain if t == 1 and k == n], [u for u, t, k in plain if t == 0 and k == n]
        assert not taken or not left or max(taken) < min(left)
    for source in {x.source_size for x in rows.values()}:
        own = [x for x in rows.values() if x.source_size == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 100


def test_mix_edges(spark):
    df = docs(spark, ["a b", "a b", None, "", "c " * 50000], [None, None, "z", "z", "y"]).withColumns({"times": F.lit("x"), "q": F.lit(1), "SIZE": F.lit(2), "row": F.lit(3)})
    df = df.union(df.where("doc_id = 1")).union(df.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    assert mixing.mix(df).count() == 7
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and {x.q for x in out.collect()} <= {1} and not {2, 3} & {x.doc_id for x in out.collect()}
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_toxicity_learns_words_and_stems(spark):
    r = random.Random(8)
    rows = []
    for i in range(900):
        t = [f"w{r.choice('abcdefgh')}{r.choice('abcdefgh')}{r.choice('klmn')}" + r.choice(["in", "on"]) for _ in range(60)]
        bad = i % 9 == 0
        if bad:
            for _ in range(3):
                t.insert(r.randrange(60), r.choice(["dolt", "vexling" + r.choice("abcdefg"), "vexling" + r.choice("hijkl")]))
        rows.append((" ".join(t) + ".", int(bad)))
    model = toxicity.fit(rows[:600])
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in rows[600:]) >= 295
    assert model.score(None) == model.score("") < 0.5
    assert toxicity.fit([]).score("x") == 0.5 and toxicity.fit([("a", 0)]).score("a") < 0.5
    out = toxicity.toxicity(docs(spark, ["you dolt.", None]).withColumn("score", F.lit("clash")), model)
    assert out.columns[-1] == "score" and out.count() == 2


def test_grammar_marks_context():
    machine = toxicity.grammar({"T": 6.0, "y": 0.5, "n": -8.0, "r": -4.0})
    assert machine.best("NoI") == (-8.0, ["N", "o", "In"])
    assert machine.best("NooooI") == (0.0, ["N", "o", "o", "o", "o", "I"])
    assert machine.best("RYNI") == (-11.5, ["R", "Y", "N", "Iynr"])
    # words to come: someone addressed, a verb of saying
    assert machine.best("IoY") == (0.5, ["Iy", "o", "Y"]) and machine.best("IoR") == (-4.0, ["Ir", "o", "R"]) and machine.best("Io") == (0.0, ["I", "o"])
    assert machine.best("YoK") == (6.0, ["Y", "o", "T"]) and machine.best("KoY") == (6.0, ["T", "o", "Y"]) and machine.best("K") == (0.0, ["o"])
    assert machine.best("YNK") == (-2.0, ["Y", "N", "Tn"]) and machine.best("") == (0.0, [])


def labelled(seed, n):
    """Texts in which insults and threats are toxic unless they are negated or reported."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{r.choice('abcdefgh')}{r.choice('abcdefgh')}{r.choice('klmn')}" + r.choice(["in", "on"]) for _ in range(40)]
        kind = i % 10
        bad = r.choice(["dolt", "oaf", "twit"])
        at = r.randrange(30)
        w[at:at] = [[], [bad], [bad], ["not", "a", bad], ["he", "said", bad], [bad, "she", "wrote"], ["i", "will", "kill", "you"], ["you", "will", "see"], ["i", "see", "you"], ["will", "i"]][kind]
        out.append((" ".join(w) + ".", int(kind in (1, 2, 6))))
    return out


def test_grammar_changes_held_out_figures():
    model = toxicity.fit(labelled(1, 1200))
    rest = labelled(2, 600)

    def right(m):
        return sum((m.score(t) >= 0.5) == bool(y) for t, y in rest) / len(rest)

    assert right(model) > 0.95
    assert right(toxicity.Model(model.exact, model.stems, model.base, model.weights | dict.fromkeys("Tynr", 0.0))) < 0.75
    assert right(toxicity.Model(model.exact, model.stems, model.base, model.weights | {"T": 0.0})) < right(model) - 0.05


def test_op10_query(spark, tmp_path):
    import zlib

    rows = labelled(3, 900)
    texts = [t for t, _ in rows] + ["you dolt.", "you are not a dolt.", "he said: dolt", "dolt, he wrote", "I will kill you!", "will you not kill", "they kill time. no one dies", None, "", " ", "you dolt.", "fine words " * 30000 + ". you oaf"]
    docs(spark, texts).union(spark.createDataFrame([(None, "you dolt.", "en", "s", 1), (900, "you dolt.", "en", "s", 1)], DOC)).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, y) for i, (_, y) in enumerate(rows)] + [(None, 1, 1), (5, 1, None), (10**9, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 2
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    model = toxicity.fit([(t, y) for i, (t, y) in enumerate(rows) if not fold(i)])
    for r in got:
        text = "you dolt." if r.doc_id is None else texts[r.doc_id]
        assert r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert abs(r.score - model.score(text)) < 0.05
    by = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id >= 900}
    assert [by[900 + k] for k in range(12)] == [1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1]
    rest = [(r.predicted, rows[r.doc_id][1]) for r in got if r.held_out and r.doc_id < 900]
    assert len(rest) > 100 and sum(a == b for a, b in rest) > 0.95 * len(rest)
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    clash = docs(spark, ["you dolt."]).withColumns({"__text": F.lit(1), "_text": F.lit(2), "score": F.lit("x")})
    assert toxicity.toxicity(empty, model).count() == 0 and toxicity.toxicity(clash, model).select("__text", "_text").first() == (1, 2)
    assert toxicity.training_rows(empty, spark.read.parquet(str(tmp_path / "labels.parquet"))) == []
    some = toxicity.training_rows(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")), most=20_000)
    assert 50 < len(some) < 100 and sum(len(t) for t, _ in some) <= 20_000


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in util.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 160)}
    assert util.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    texts = [prose(i, 120) for i in range(30)] + [prose(0, 120), None, ""]
    df = docs(spark, texts, ["a", "b", None] * 11)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = df
    for name, stage in c.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == df.columns, name
    out = c.run(spark, str(tmp_path))
    assert out.where("not round_trip").count() == 0
    assert {r.doc_id for r in out.collect()} <= set(range(30))


def test_pipeline_against_brute_force(spark, tmp_path):
    import duckdb
    import sentencepiece

    import corpus_pipeline as c

    r = random.Random(21)
    rows = []
    for i, (t, y) in enumerate(labelled(5, 700)):
        t = t.replace(" w", "\nw", 2) if i % 3 else t
        if i % 4 == 0:
            t = "menu home\n" + t + "\nall rights"
        rows.append((i, t, "en", r.choice(["a", "b", "c", None]), len(t), y))
    extra = [rows[k][1] for k in (3, 3, 9)] + [rows[13][1] + " tail", "menu home\nall rights", "menu home\nall rights", None, "", " \n", "ends\u2581here so it is", prose(9, 3000), prose(9, 3000) + " x"]
    rows += [(700 + k, t, "de", "b", len(t or ""), None) for k, t in enumerate(extra)] + [(0, *rows[0][1:5], None), (None, "no id at all here", "en", "z", 17, None)]
    spark.createDataFrame([x[:5] for x in rows], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(x[0], 1, x[5]) for x in rows if x[5] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    import zlib

    model = toxicity.fit([(x[1], x[5]) for x in rows[:700] if zlib.crc32(str(x[0]).encode()) % 5])
    now = [x[:5] for x in rows if model.score(x[1]) < 0.5]
    assert 0 < len(now) < len(rows) - 100

    def bad_lines(docs_of):
        """Per source the lines on over a tenth of its documents, from five documents and three copies on."""
        pages, lines = Counter(), Counter()
        for source, t in docs_of:
            pages[source] += 1
            lines.update((source, x) for x in {*(t.split("\n") if t is not None else [])} if x)
        return {(s, x) for (s, x), n in lines.items() if n >= 3 and pages[s] >= 5 and n > 0.1 * pages[s]}

    bad, once = bad_lines([(x[3], x[1]) for x in now]), bad_lines({(x[3], x[1]) for x in now})
    out = []
    for i, t, lang, s, n in now:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (s, x) not in bad]
        if any(lines) and not any(kept):
            kept = [x for x in lines if (s, x) not in once]
        out.append((i, t, lang, s, n) if kept == lines else (i, "\n".join(kept), lang, s, len("\n".join(kept))))
    assert out != now
    # near-duplicates: null and blank texts are one group; the smallest id stays
    by_id = sorted(out, key=lambda x: (x[0] is None, x[0] or 0))
    kept = [by_id[k] for k in near_brute([x[1] or "" for x in by_id])]
    assert len(kept) < len(out) - 4
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", kept)
    times = {i: taken // size for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.OP9_SQL}) WHERE taken > 0").fetchall()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = []
    for i, t, _, s, _ in kept:
        ids = sp.encode(t or "")
        want += [(i, s, len(ids), ids, pieces.MARK not in (t or ""))] * times.get(i, 0)
    got = [tuple(x) for x in c.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as c

    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0


def near_brute(texts, gram=5):
    """The smallest index of each component of Jaccard similarity 0.8 or more."""
    sets = [{tuple(w[i : i + gram]) for i in range(max(1, len(w) - gram + 1))} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for j, b in enumerate(sets):
        for i in range(j):
            common = len(sets[i] & b)
            if common >= 0.8 * (len(sets[i]) + len(b) - common):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return sorted(set(root))


def test_near_dedup_of_contiguous_changes(spark):
    texts = []
    for i in range(60):
        w = prose(300 + i, 200 + 10 * i).split()
        n = len(w)
        new = prose(400 + i, n).split()
        other = {0: w + new[: int(0.22 * n)], 1: w[: int(0.82 * n)], 2: w[: n // 3] + new[: int(0.09 * n)] + w[n // 3 + int(0.09 * n) :]}[i % 3]
        texts += [" ".join(w), " ".join(other)]
    want = near_brute(texts)
    assert len(want) <= 62
    assert sorted(x.doc_id for x in simhash_dedup.near_dedup(docs(spark, texts)).collect()) == want


def test_near_dedup_of_crowded_buckets(spark, monkeypatch):
    # one bucket for each block, so that all texts crowd in it
    monkeypatch.setattr(simhash_dedup, "covering_masks", lambda radius, seed=1: [0])
    texts = []
    for i in range(60):
        w = prose(500 + i, 120).split()
        texts += [" ".join(w), " ".join(w[:60] + ["other"] + w[61:])]
    order = random.Random(9)
    order.shuffle(texts)
    assert sorted(x.doc_id for x in simhash_dedup.near_dedup(docs(spark, texts)).collect()) == near_brute(texts)


def test_near_dedup_of_short_texts(spark):
    # sets of four and five shingles, of which fingerprints say little
    texts = [t for i in range(1000) for w in [prose(1000 + i, 9, 10**6).split()] for t in (" ".join(w[:8]), " ".join(w))]
    assert sorted(x.doc_id for x in simhash_dedup.near_dedup(docs(spark, texts)).collect()) == list(range(0, 2000, 2))


def test_bounds_as_columns(spark):
    r = random.Random(8)
    pairs = []
    for _ in range(500):
        na = r.randrange(0, 60)
        nb = r.randrange(na, 90)
        pairs.append((na << 32 | r.randrange(simhash_dedup._prefix(na, 0.8)), nb << 32 | r.randrange(simhash_dedup._prefix(nb, 0.8))))
    df = spark.createDataFrame(pairs, "low long, high long")
    got = {(x.low, x.high): x.ok for x in df.select("low", "high", simhash_dedup._possible(F.col("low"), F.col("high"), 0.8).alias("ok")).collect()}
    for low, high in pairs:
        assert got[low, high] == bool(simhash_dedup._can(low >> 32, low & 0xFFFFFFFF, high >> 32, high & 0xFFFFFFFF, 0.8))


def test_prefix_bounds_lose_no_pair():
    r, rng = random.Random(4), np.random.default_rng(4)
    for _ in range(3000):
        n = r.randrange(1, 80)
        a = rng.permutation(100)[:n]
        b = np.unique(np.concatenate((a[r.randrange(n // 5 + 1) :], 100 + np.arange(r.randrange(n // 5 + 1)))))
        b = rng.permutation(200)[np.unique(b)] if r.random() < 0.1 else b
        a, b = np.sort(a), np.sort(b)
        common = np.intersect1d(a, b)
        if len(common) < 0.8 * (len(a) + len(b) - len(common)):
            continue
        ka, kb = (simhash_dedup._prefix(len(x), 0.8) for x in (a, b))
        assert len(np.intersect1d(a[:ka], b[:kb])) > 0
        assert all(simhash_dedup._can(len(a), np.searchsorted(a, x), len(b), np.searchsorted(b, x), 0.8) for x in common)
        column = simhash_dedup.pa.chunked_array([[simhash_dedup.parity(x.astype(np.uint64)) for x in (a, b)]])
        assert simhash_dedup._Apart(column)(np.array([0]), np.array([1]))[0] <= len(a) + len(b) - 2 * len(common)


def test_near_dedup_without_the_tables(spark, monkeypatch):
    # nothing is tied by fingerprints, buckets are compared in blocks of 16, frequent ones dealt over salts
    monkeypatch.setattr(simhash_dedup, "_covered", lambda texts, radius, blocks: util.cut(texts.select(F.col("rid").alias("a"), F.col("rid").alias("b")).limit(0)))
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(simhash_dedup, "DEALT", 8)
    r = random.Random(6)
    base = prose(77, 200).split()
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(200)] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(w))
    assert sorted(x.doc_id for x in simhash_dedup.near_dedup(docs(spark, texts)).collect()) == near_brute(texts)


def test_near_dedup_with_little_held(spark, monkeypatch):
    # tasks hold one group at a time, groups come in many batches, and a head's partners are dealt over tasks
    monkeypatch.setattr(simhash_dedup, "HELD", 1)
    monkeypatch.setattr(simhash_dedup, "GROUP", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        base, texts = prose(78, 100).split(), []
        for i in range(40):
            w = prose(700 + i % 7, 100).split() if i % 2 else list(base)
            w[(7 * i) % 100] = f"n{i}"
            texts.append(" ".join(w))
        assert sorted(x.doc_id for x in simhash_dedup.near_dedup(docs(spark, texts)).collect()) == near_brute(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_are_whole_and_streamed(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "HELD", 100)
    r = random.Random(12)
    keys = sorted((r.randrange(9), r.randrange(2), 0) for _ in range(300))
    pa = simhash_dedup.pa
    rows = pa.table({"bucket": [k[0] for k in keys], "x": [k[1] for k in keys], "y": [k[2] for k in keys], "rid": list(range(300))})
    for size in (1, 7, 300):
        got = list(simhash_dedup._whole_groups(rows.to_batches(max_chunksize=size)))
        assert [x for t in got for x in t.column("rid").to_pylist()] == list(range(300))
        seen = [{(x["bucket"], x["x"]) for x in t.to_pylist()} for t in got]
        assert sum(map(len, seen)) == len(set().union(*seen)) == 18
        assert size == 300 or len(got) > 9


def test_near_dedup_of_texts_with_one_name(spark, monkeypatch):
    # the first hash says next to nothing: different texts of one length have one name
    monkeypatch.setattr(simhash_dedup, "_names", lambda text: [F.length(text).cast("long").alias("rid"), F.xxhash64(text, F.lit(1)).alias("check")])
    texts = [f"one {i} two {i} three {i} four {i}" for i in range(10, 60)]
    texts += texts[:5] + [prose(81, 90), prose(81, 90) + " end", None, ""]
    assert sorted(x.doc_id for x in simhash_dedup.near_dedup(docs(spark, texts)).collect()) == near_brute([t or "" for t in texts])


def test_line_dedup_of_pages_of_boilerplate(spark):
    texts = ["licence\nterms"] * 10 + [f"licence\nterms\nunique {i}" for i in range(30)] + ["own\n\ntext"] * 6 + [None, "\n"]
    for limit in (10, 0):
        out = line_dedup.line_dedup(docs(spark, texts), F.col("source"), F.split("text", "\\n"), spare_copies=True, limit=limit)
        got = {r.row.doc_id: (r.lines, r.n_dropped) for r in out.collect()}
        want = [([], 2)] * 10 + [([f"unique {i}"], 2) for i in range(30)] + [(["own", "", "text"], 0)] * 6 + [([], 0), (["", ""], 0)]
        assert got == dict(enumerate(want))


def test_all_queries_on_empty_tables(spark, tmp_path):
    from sparkledger import llm

    for t in ("documents", "embeddings", "pages", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert {n: q(spark, str(tmp_path)).count() for n, q in llm.QUERIES.items()} == dict.fromkeys(llm.QUERIES, 0)
