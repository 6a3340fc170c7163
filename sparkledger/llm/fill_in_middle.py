"""Fill-in-middle transformation with a parallel automaton scan.

A text is cut into units (characters, words or lines) and looked through for the marks by one finite automaton over bytes. Nothing has to
know what came before: every stretch of LANE bytes is run from each state at once and emits its transition
function and, for each start state, the number of units that begin in it. Functions compose associatively, so a prefix scan by doubling gives
each stretch its entry state and the units before it, and the byte at which a unit begins is found by a search over these counts and a second
run of one stretch.

Texts of up to `chunk_bytes` are scanned where they are, many at a time. A longer one is exploded into chunks that are dealt over all tasks;
their functions and counts, a few numbers for each chunk, meet by document in the order of the chunks, which gives each its entry state; then
only the chunks that hold a cut are read again, to select the byte of the cut. Assembling, digests and the way back are expressions
of Spark on whole texts.

A cut after c of n units lies at byte 0 if c is 0, at the end of the text if c is n, else where unit number c (from 0) begins.

Defined results: a null text is an empty one; empty texts, texts without units and texts that hold a mark stay plain; a null doc_id hashes as an
empty string; repeated rows have equal results; an empty table gives an empty result; columns other than doc_id and text are ignored, whatever their
names. Marks must differ and no beginning of one may be the end of one, so that the way back is unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import cut, parts, read, small

MARKS, SEED, PLAIN, SPM = ("<P>", "<S>", "<M>"), "1:", 90, 20
#: Bytes of a stretch, of a chunk of a long text, of the texts that are scanned at a time, and of the chunks of a task.
LANE, CHUNK_BYTES, AT_ONCE, TASK_BYTES = 64, 1 << 16, 1 << 22, 1 << 23
_BLANK = (9, 10, 11, 12, 13, 32)


class Automaton:
    """A deterministic automaton over bytes: the product of a unit counter and a search for marks; the state `found` of the search is final.

    step and emit are tables by state and class of byte; the last class is padding, which changes nothing.
    """

    def __init__(self, marks: tuple[str, ...] = MARKS, unit: str = "char"):
        names = [m.encode() for m in marks]
        heads = sorted({m[:i] for m in names for i in range(len(m))}, key=lambda p: (len(p), p))
        letters = sorted({c for m in names for c in m})
        symbols = [bytes([c]) for c in letters]
        # bytes that no mark holds are told apart by what they mean to units only
        kinds = {"char": lambda c: 0x80 <= c < 0xC0, "word": lambda c: c in _BLANK, "line": lambda c: c == 10}
        if unit not in kinds:
            raise ValueError(f"unit must be one of {sorted(kinds)}")
        special = kinds[unit]
        self.classes = np.array([letters.index(c) if c in letters else len(letters) + special(c) for c in range(256)], np.intp)
        meant = [special(c) for c in letters] + [False, True]
        self.pad = len(meant)

        def search(state: int, k: int) -> int:
            if state == len(heads) or k >= len(letters):
                return state if state == len(heads) else 0
            seen = heads[state] + symbols[k]
            if any(seen.endswith(m) for m in names):
                return len(heads)
            return next(i for n in range(len(seen), -1, -1) for i, h in enumerate(heads) if h == seen[len(seen) - n :])

        counters = {"char": 1, "word": 2, "line": 2}[unit]
        searches = len(heads) + 1
        self.states = counters * searches
        self.start, self.first_found = 0, searches - 1
        self.step = np.zeros((self.states, self.pad + 1), np.intp)
        self.emit = np.zeros((self.states, self.pad + 1), np.int64)
        for u in range(counters):
            for q in range(searches):
                s = u * searches + q
                self.step[s, self.pad] = s
                for k, is_special in enumerate(meant):
                    begins = not is_special if unit == "char" else (u == 0 and not is_special) if unit == "word" else u == 0
                    after = 0 if unit == "char" else int(not is_special)
                    self.emit[s, k] = begins
                    self.step[s, k] = after * searches + search(q, k)
        self.final = np.arange(self.states) % searches == searches - 1

    def scan(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> "Scan":
        return Scan(self, buf, starts, ends)


class Scan:
    """The stretches of some texts that stand in buf; `to` and `count` by stretch and start state are those from the text's beginning to the stretch's end."""

    def __init__(self, auto: Automaton, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.auto, self.buf, self.starts, self.ends = auto, buf, starts, ends
        lanes = -(-(ends - starts) // LANE)
        self.upto = np.cumsum(lanes)
        self.base = self.upto - lanes
        self.text = np.repeat(np.arange(len(starts)), lanes)
        self.place = np.arange(len(self.text)) - self.base[self.text]
        self.at = starts[self.text] + self.place * LANE
        self.classes = self._classes(np.arange(len(self.text)))
        n = len(self.text)
        self.to = np.broadcast_to(np.arange(auto.states), (n, auto.states)).copy()
        self.count = np.zeros((n, auto.states), np.int64)
        step, emit, width = auto.step.ravel(), auto.emit.ravel(), auto.pad + 1
        for row in self.classes:
            k = self.to * width + row[:, None]
            self.count += emit[k]
            self.to = step[k]
        shift = 1
        while n and shift <= int(self.place.max()):  # composition of ever longer runs of stretches
            late = np.flatnonzero(self.place >= shift)
            before, units = self.to[late - shift], self.count[late - shift]
            count = units + np.take_along_axis(self.count[late], before, 1)
            self.to[late] = np.take_along_axis(self.to[late], before, 1)
            self.count[late] = count
            shift *= 2

    def _classes(self, lanes: np.ndarray) -> np.ndarray:
        """Classes of the bytes of stretches, byte by stretch."""
        at = self.at[lanes][None] + np.arange(LANE)[:, None]
        out = self.auto.classes[self.buf[np.minimum(at, max(len(self.buf) - 1, 0))]] if len(self.buf) else np.zeros(at.shape, np.intp)
        out[at >= self.ends[self.text[lanes]][None]] = self.auto.pad
        return out

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text its transition function and its units, by start state."""
        n = len(self.starts)
        to = np.broadcast_to(np.arange(self.auto.states), (n, self.auto.states)).copy()
        count = np.zeros((n, self.auto.states), np.int64)
        some = self.upto > self.base
        to[some], count[some] = self.to[self.upto[some] - 1], self.count[self.upto[some] - 1]
        return to, count

    def find(self, text: np.ndarray, state: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The byte, counted from its text's beginning, at which unit number k begins if the text is entered in a state; the text must have it."""
        # the first stretch of the text whose units reach beyond k
        lo, hi = self.base[text].copy(), self.upto[text] - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            enough = self.count[mid, state] > k
            hi, lo = np.where(open_ & enough, mid, hi), np.where(open_ & ~enough, mid + 1, lo)
        later = self.place[lo] > 0
        entry = np.where(later, self.to[lo - 1, state], state)
        left = k - np.where(later, self.count[lo - 1, state], 0)
        out = np.full(len(text), -1, np.int64)
        step, emit = self.auto.step, self.auto.emit
        for j, row in enumerate(self._classes(lo)):
            now = emit[entry, row]
            hit = (left == 0) & (now > 0) & (out < 0)
            out[hit] = self.at[lo[hit]] + j - self.starts[text[hit]]
            left, entry = left - now, step[entry, row]
        return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column without nulls, and the offsets of its values in them."""
    wide = column.cast(pa.large_binary())
    _, at, data = wide.buffers()
    at = np.frombuffer(at, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8)[int(at[0]) : int(at[-1])] if at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def _groups(at: np.ndarray):
    """Rows that are scanned at a time: AT_ONCE bytes or a single row."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + AT_ONCE, side="right")) - 1)
        yield i, j
        i = j


def _cut_places(marks: tuple[str, ...], unit: str):
    """Of whole texts: units, whether a mark was found, and the bytes of both cuts."""

    def run(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        auto = Automaton(marks, unit)
        buf, at = _flat(texts)
        size = len(texts)
        n, found = np.zeros(size, np.int64), np.zeros(size, bool)
        places = np.zeros((2, size), np.int64)
        draws = [h.to_numpy(zero_copy_only=False) for h in (h1, h2)]
        for i, j in _groups(at):
            scan = auto.scan(buf[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i])
            to, count = scan.whole()
            n[i:j], found[i:j] = count[:, auto.start], auto.final[to[:, auto.start]]
            cuts = np.sort(np.stack([h[i:j] % (n[i:j] + 1) for h in draws]), axis=0)
            for place, c in zip(places, cuts):
                place[i:j] = np.where(c == 0, 0, at[i + 1 : j + 1] - at[i:j])
                inner = np.flatnonzero((c > 0) & (c < n[i:j]))
                if len(inner):
                    place[i + inner] = scan.find(inner, np.full(len(inner), auto.start), c[inner])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(found), pa.array(places[0]), pa.array(places[1])], ["n", "found", "first", "second"])

    return F.arrow_udf(run, "struct<n:long,found:boolean,first:long,second:long>")


def _summaries(marks: tuple[str, ...], unit: str):
    """Of each chunk: transition function and units by start state."""

    def run(batches):
        auto = Automaton(marks, unit)
        for b in batches:
            buf, at = _flat(b.column(3))
            to, count = [], []
            for i, j in _groups(at):
                t, c = auto.scan(buf[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i]).whole()
                to += t.tolist()
                count += c.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(to, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int64()))], ["key", "key2", "chunk", "to", "units"])

    return run


def _resolve(marks: tuple[str, ...], unit: str):
    """Chunks in order of (key, key2, chunk): entry state and units before each, its units, and whether a mark ends in or before it. One document's state is held."""

    def run(batches):
        auto = Automaton(marks, unit)
        doc, state, before = None, 0, 0
        for b in batches:
            out = ([], [], [], [])
            for key, key2, to, units in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if (key, key2) != doc:
                    doc, state, before = (key, key2), auto.start, 0
                for part, x in zip(out, (state, before, units[state], bool(auto.final[to[state]]))):
                    part.append(x)
                before, state = before + units[state], to[state]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, t) for x, t in zip(out, kinds))], ["key", "key2", "chunk", "entry", "before", "units", "found"])

    return run


def _select(marks: tuple[str, ...], unit: str):
    """The byte of a chunk at which a unit begins: key, key2, which cut, byte of the text."""

    def run(batches):
        auto = Automaton(marks, unit)
        for b in batches:
            buf, at = _flat(b.column(6))
            out = np.zeros(b.num_rows, np.int64)
            entry, k = (b.column(i).to_numpy().astype(np.int64) for i in (4, 5))
            for i, j in _groups(at):
                out[i:j] = auto.scan(buf[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i]).find(np.arange(j - i), entry[i:j], k[i:j])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out + b.column(3).to_numpy())], ["key", "key2", "which", "byte"])

    return run


def _giant_places(giant: DataFrame, marks: tuple[str, ...], unit: str, chunk_bytes: int) -> DataFrame:
    """giant: key, key2, text (binary), h1, h2. For each document key: n, found, first and second, by chunks dealt over all tasks."""
    many = F.ceil(F.octet_length("text") / chunk_bytes)
    begin = F.col("chunk") * chunk_bytes
    piece = F.substring(F.col("text"), begin + 1, F.lit(chunk_bytes))
    chunks = giant.select("key", "key2", "text", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("chunk")).select("key", "key2", "chunk", piece.alias("bytes"))
    total = giant.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    seen = chunks.repartition(parts(-(-total // TASK_BYTES)), "key", "key2", "chunk").mapInArrow(_summaries(marks, unit), "key long, key2 long, chunk long, to array<int>, units array<long>")
    # repeated rows have one key and equal chunks
    seen = seen.dropDuplicates(["key", "key2", "chunk"]).repartition("key", "key2").sortWithinPartitions("key", "key2", "chunk")
    known = cut(seen.mapInArrow(_resolve(marks, unit), "key long, key2 long, chunk long, entry int, before long, units long, found boolean"))
    whole = known.groupBy("key", "key2").agg(F.sum("units").alias("n"), F.bool_or("found").alias("found"))
    drawn = giant.select("key", "key2", "h1", "h2", F.octet_length("text").cast("long").alias("size")).dropDuplicates(["key", "key2"])
    c1, c2 = (F.pmod(F.col(h), F.col("n") + 1) for h in ("h1", "h2"))
    whole = cut(whole.join(drawn, ["key", "key2"]).select("key", "key2", "n", "found", "size", F.least(c1, c2).alias("c1"), F.greatest(c1, c2).alias("c2")))
    asked = whole.select("key", "key2", "n", F.posexplode(F.array("c1", "c2")).alias("which", "c")).where("c > 0 and c < n")
    at = cut(known.join(asked, ["key", "key2"]).where("before <= c and c < before + units").select("key", "key2", "which", "chunk", "entry", (F.col("c") - F.col("before")).alias("k")))
    again = giant.select("key", "key2", "text").join(small(at), ["key", "key2"]).select("key", "key2", "which", begin.alias("begin"), "entry", "k", piece.alias("bytes"))
    found = again.mapInArrow(_select(marks, unit), "key long, key2 long, which int, byte long").groupBy("key", "key2").agg(F.max(F.when(F.col("which") == 0, F.col("byte"))).alias("b1"), F.max(F.when(F.col("which") == 1, F.col("byte"))).alias("b2"))
    place = lambda c, b: F.when(F.col(c) == 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.col(b), F.col("size")))
    return whole.join(found, ["key", "key2"], "left").select("key", "key2", F.struct("n", "found", place("c1", "b1").alias("first"), place("c2", "b2").alias("second")).alias("at"))


def check_marks(marks: tuple[str, ...]) -> None:
    """Raises unless there are three marks of which none overlaps another or itself."""
    if len(marks) != 3 or not all(marks):
        raise ValueError("three marks are needed: for the prefix, the suffix and the middle")
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if (i != j and a in b) or any(a[:n] == b[-n:] for n in range(1, min(len(a), len(b)) + (i != j))):
                raise ValueError(f"marks overlap: {a} and {b}")


def restore(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text that an output of a form was made of; the form is plain, psm or spm."""
    pre, suf, mid = (F.lit(m) for m in marks)
    rest = lambda s, n: F.substring(s, n, F.length(output) + 1)

    def halves(s, mark, size):
        head = F.substring_index(s, mark, 1)
        return head, rest(s, F.length(head) + size + 1)

    p_psm, after = halves(rest(output, F.lit(len(marks[0]) + 1)), marks[1], len(marks[1]))
    s_psm, m_psm = halves(after, marks[2], len(marks[2]))
    s_spm, after = halves(rest(output, F.lit(len(marks[1]) + 1)), marks[0], len(marks[0]))
    p_spm, m_spm = halves(after, marks[2], len(marks[2]))
    return F.when(form == "plain", output).when(form == "psm", F.concat(p_psm, m_psm, s_psm)).otherwise(F.concat(p_spm, m_spm, s_spm))


def fill_in_middle(docs: DataFrame, marks: tuple[str, ...] = MARKS, unit: str = "char", plain: int = PLAIN, spm: int = SPM, seed: str = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units (null if plain) and output for every row of docs (doc_id, text).

    Cuts and forms are drawn from the sha256 of the seed and the id; `plain` of 100 texts may be transformed, `spm` of 100 of these begin with the suffix.
    """
    check_marks(marks)
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).select("*", *draws)
    long_ = F.octet_length("text") > chunk_bytes
    short = rows.where(~long_).withColumn("at", _cut_places(marks, unit)("text", "h1", "h2"))
    giant = rows.where(long_).withColumns({"key": F.xxhash64("doc_id", "text"), "key2": F.xxhash64("text", "doc_id", F.lit(1))})
    places = cut(_giant_places(giant, marks, unit, chunk_bytes))
    both = short.unionByName(giant.join(small(places), ["key", "key2"]).drop("key", "key2"))
    n, first, second = (F.col(f"at.{c}") for c in ("n", "first", "second"))
    form = F.when((n == 0) | F.col("at.found") | (F.col("h3") % 100 >= plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    bytes_ = lambda begin, size: F.substring(F.col("text"), (begin + 1).cast("int"), size.cast("int")).cast("string")
    size = F.octet_length("text").cast("long")
    prefix, middle, suffix = bytes_(F.lit(0), first), bytes_(first, second - first), bytes_(second, size - second)
    pre, suf, mid = (F.lit(m) for m in marks)
    made = F.when(form == "plain", F.col("text").cast("string")).when(form == "psm", F.concat(pre, prefix, suf, suffix, mid, middle)).otherwise(F.concat(suf, suffix, pre, prefix, mid, middle))
    c1, c2 = (F.pmod(F.col(h), n + 1) for h in ("h1", "h2"))
    units = lambda c: F.when(form != "plain", c)
    return both.select("doc_id", n.alias("n"), form.alias("form"), units(F.least(c1, c2)).alias("prefix_units"), units(F.greatest(c1, c2) - F.least(c1, c2)).alias("middle_units"), made.alias("output"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and restored from its output."""
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
cuts AS (
  SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, substr(t, 1, least(c1, c2)) AS pre, substr(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS mid, substr(t, greatest(c1, c2) + 1) AS suf FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(c1, c2) - least(c1, c2) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
