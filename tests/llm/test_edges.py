"""Texts made to collide under weak hashes, and columns of any name and type."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import docs, labelled, prose

from sparkledger.llm import line_dedup, pieces, substring_dedup, toxicity


def thue_morse(n, a="a", b="b", flip=False):
    return [(a, b)[(bin(i).count("1") + flip) % 2] for i in range(n)]


def brute(texts):
    words = [t.encode().split() for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = {}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return want


@pytest.mark.parametrize("options", [{}, {"shard_rows": 1}])
def test_substring_dedup_of_colliding_words_and_windows(spark, options):
    around = prose(1, 40).split()
    texts = []
    for size in (1024, 4096, 16384):
        for flip in (False, True):
            texts.append(" ".join([*around[:20], "".join(thue_morse(size, flip=flip)), *around[20:]]).replace("w", f"v{size}"))
    # windows whose words are those of another in another order, with equal sums of words and of words by place
    head, tail = prose(2, 20).split(), prose(3, 20).split()
    for order in ("a b b a", "b a a b", "a b b a b a a b", "b a a b a b b a"):
        texts.append(" ".join([*head, *order.split(), *tail]))
    for flip in (False, True):
        texts.append(" ".join(thue_morse(512, "x", "y", flip)))
    texts.append(" ".join([*around[:20], *around[20:]]))
    texts.append("\t".join([*around[:20], *around[20:]]) + "\n  end")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs(spark, texts), **options).collect()}
    assert got == brute(texts)
    assert [got[i][1] for i in range(6)] == [0] * 6


def odd(df):
    """df with columns of names and types that text cannot carry plainly."""
    more = {"a.b": F.lit(1), "x`y": F.lit("q"), "row": F.lit(2.5), "score": F.lit("own"), "id": F.lit(1), "rid": F.lit(2), "lines": F.array(F.lit("z")), "host": F.lit(None).cast("string"), "source.text": F.lit(0), "sp ace;{}": F.lit(True)}
    more["st"] = F.struct(F.lit(1).alias("a-b"), F.lit("t").alias("c.d"), F.struct(F.lit(2).alias("e`f")).alias("in"))
    more["m"] = F.create_map(F.lit("k.k"), F.struct(F.lit(3).alias("v v")))
    return df.withColumns({**more, "when": F.lit("2024-01-01 00:00:00").cast("timestamp"), "big": F.lit("1.5").cast("decimal(20,3)")})


def test_operators_carry_any_column(spark):
    df = odd(docs(spark, ["hello world\nsecond", "", None]))
    model = toxicity.fit([("bad badly", 1), ("good", 0)] * 5)
    got = toxicity.toxicity(df, model)
    before = {r.doc_id: r.asDict(True) for r in df.collect()}
    assert sorted(got.columns) == sorted(df.columns)
    assert {r.doc_id: r.asDict(True) | {"score": "own"} for r in got.collect()} == before
    kept = pieces.encode(df, check=True)
    assert kept.schema["st"].dataType == df.schema["st"].dataType and kept.where("round_trip").count() == 3
    assert pieces.decode(kept).where("decoded = coalesce(text, '')").count() == 3
    assert pieces.encode_relational(df).schema["m"].dataType == df.schema["m"].dataType
    assert line_dedup.line_dedup(df, F.col("source"), F.split("text", "\\n")).select("row.*").columns == df.columns


def test_pipeline_carries_any_column(spark, tmp_path):
    import corpus_pipeline as c

    rows = labelled(7, 60)
    df = odd(docs(spark, [t for t, _ in rows] + [None, "", prose(1, 30)]))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = df
    for name, stage in c.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.schema.simpleString() == df.schema.simpleString(), name
        assert now.where("score = 'own' and `a.b` = 1 and `x``y` = 'q' and st.`a-b` = 1").count() == now.count(), name
