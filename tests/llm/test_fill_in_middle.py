"""Fill-in-middle against a plain Python form, on short and long texts, and the automaton against runs byte by byte."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkledger.llm import fill_in_middle as M

R = random.Random(8)
TEXTS = ["", None, "a", "ab", "ä🎉", "no marks <P no <S no >", "has <M> one", "<<P>", "<P", "x<S>", "tail <", "日本語 " * 900, "é" * 70000, "w " * 40000 + "<S", "w " * 40000 + "<S>", "\n\n a\nb \n", " \t "] + ["".join(R.choice("ab<>PSM é\n日") for _ in range(R.randrange(200))) for _ in range(300)]


def brute(i, text, marks=("<P>", "<S>", "<M>")):
    t = text or ""
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted(v % (n + 1) for v in h[:2])
    if not t or any(m in t for m in marks) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"
    return i, n, "psm", a, b - a, f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"


@pytest.mark.parametrize("chunk_bytes", [M.CHUNK_BYTES, 3, 4000])
def test_against_plain_python(spark, chunk_bytes):
    texts = TEXTS if chunk_bytes > 3 else TEXTS[:11] + TEXTS[15:60]
    rows = list(enumerate(texts)) + [(None, "null id here"), (5, texts[5]), (5, texts[5]), (5, "another of this id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "key": F.lit(0), "h1": F.lit(0), "a.b": F.lit(1)})
    out = M.fill_in_middle(df, chunk_bytes=chunk_bytes).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    got = sorted((tuple(r)[:6] for r in out), key=str)
    want = sorted((brute(i, t) for i, t in rows), key=str)
    assert got == want
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in rows)


def test_own_marks_and_rates(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    df = spark.createDataFrame([(i, f"text {i} of some length <P>") for i in range(400)], "doc_id long, text string")
    out = M.fill_in_middle(df, marks, plain=50, spm=100).withColumn("back", M.restore(F.col("output"), F.col("form"), marks)).collect()
    forms = [r.form for r in out]
    assert 150 < forms.count("plain") < 250 and forms.count("spm") == 400 - forms.count("plain")
    assert all(r.back == f"text {r.doc_id} of some length <P>" for r in out)
    for bad in (("<a", "a>", "<a>"), ("aa", "b", "c"), ("x", "x", "y"), ("", "a", "b"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            M.check_marks(bad)


def starts(text, unit):
    """The bytes at which units begin."""
    data = text.encode()
    if unit == "char":
        return [i for i, c in enumerate(data) if not 0x80 <= c < 0xC0]
    blank = [c in M._BLANK if unit == "word" else c == 10 for c in data]
    return [i for i in range(len(data)) if (not blank[i] if unit == "word" else True) and (i == 0 or blank[i - 1])]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_scan_from_every_state(unit):
    auto = M.Automaton(unit=unit)
    texts = [(t or "")[:3000] for t in TEXTS]
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    buf = np.frombuffer(b"".join(data), np.uint8)
    scan = auto.scan(buf, ends - [len(d) for d in data], ends)
    to, count = scan.whole()
    for k, d in enumerate(data):
        for s in range(auto.states):
            state, units = s, 0
            for c in d:
                units += auto.emit[state, auto.classes[c]]
                state = auto.step[state, auto.classes[c]]
            assert (to[k, s], count[k, s]) == (state, units)
        at = starts(texts[k], unit)
        assert count[k, auto.start] == len(at) and auto.final[to[k, auto.start]] == any(m in texts[k] for m in M.MARKS)
        if at:
            which = np.arange(len(at))
            assert scan.find(np.full(len(at), k), np.full(len(at), auto.start), which).tolist() == at


@pytest.mark.parametrize("unit", ["word", "line"])
def test_units_cut_alike_at_any_chunk_size(spark, unit):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    whole = sorted(map(tuple, M.fill_in_middle(df, unit=unit, chunk_bytes=1 << 30).collect()))
    assert sorted(map(tuple, M.fill_in_middle(df, unit=unit, chunk_bytes=5000).collect())) == whole
    for i, n, form, p, m, out in whole:
        at = starts(TEXTS[i] or "", unit)
        assert n == len(at)
        if form == "psm" and 0 < p < n:
            assert len(out.split("<S>")[0].encode()) - 3 == at[p]


def test_op12_query_and_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = M.op12_fill_in_middle(spark, str(tmp_path))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*b[:5], sha(b[5]), sha(t or "")) for b, t in ((brute(i, t), t) for i, t in rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({M.OP12_SQL})").fetchall(), key=str) == sorted(want, key=str)
