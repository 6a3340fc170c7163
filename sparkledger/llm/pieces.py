"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into words at places no piece of the model spans (before a run of word markers, around
line ends). Every substring of a distinct word, of at most the longest piece's length, is formed (explode), looked up in the
piece table (an equi-join), and the edges found are grouped by word as a lattice, (start, length) -> piece.
A fold over the lattice then picks the segmentation. For Unigram models it is Viterbi, in double precision. BPE models
store merge ranks as scores, for which Viterbi gives other pieces than the model's own encoder; for
them the fold applies, again and again, the best edge that spans two neighbouring pieces.

The same lattice stands here twice. `encode_relational` is the relational form: rows of substrings, a join to
the piece table, groups by word, and a fold with Spark's higher-order `aggregate`. `encode` takes the distinct
words of a stretch of text at a time, inside Arrow batches, with the same explode, join and fold over arrays; it is what `op8_pieces` and the
pipeline run, for the relational form does not meet the check tool's limits (README, with figures). Both give the same ids.

BPE ids equal the reference encoder's. Unigram ids are those of exact sums; the reference encoder adds in single precision
over a whole text, so that its near-ties may come out otherwise.

Defined results: null is encoded as an empty text; an empty text has no pieces; characters
outside the vocabulary become byte pieces, or the unknown piece if the model has none; any text
without a null character or the word marker in it decodes to itself if all pieces are known or bytes; repeated rows are encoded alike; words of any
length are encoded whole; an empty table gives an empty result; other columns are carried along, whatever their names,
a column named ids is replaced.
"""

from __future__ import annotations

import heapq
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField

from .util import beside, columns, cut, mix, powers, read, released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, STRETCH, KNOWN, LONG, CELLS, SLOTS = "▁", 1 << 20, 200_000, 128, 1 << 20, 18
UNKNOWN_PENALTY, ROWS = 10.0, 256
_LOADED: dict[str, PieceTable] = {}


def _text_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row of code points."""
    n = codes.shape[1]
    acc = np.zeros((len(codes), n + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x2545F4914F6CDD1D)) * powers(n), axis=1, dtype=np.uint64, out=acc[:, 1:])
    return acc


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


class PieceTable:
    """The pieces of a model file and the folds over their lattices."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self._set([p.piece for p in model.pieces], np.array([p.score for p in model.pieces], np.float64), [p.type for p in model.pieces], model.trainer_spec.model_type == 2)
        n = model.normalizer_spec
        if n.precompiled_charsmap:
            raise ValueError("models with a normalisation map are not supported")
        self.prefix, self.squeeze = n.add_dummy_prefix, n.remove_extra_whitespaces

    def _set(self, pieces: list[str], scores: np.ndarray, types: list[int], bpe: bool) -> None:
        self.pieces, self.bpe = pieces, bpe
        self.unk = next((i for i, t in enumerate(types) if t == 2), 0)
        usual = [i for i, t in enumerate(types) if t in (1, 4)]
        self.bytes = [i for i, t in enumerate(types) if t == 6]
        self.longest = max(len(pieces[i]) for i in usual)
        self.scores = np.append(scores, -np.inf)  # index -1: no piece
        self.worst = float(scores[usual].min()) - UNKNOWN_PENALTY
        hashes, ids = [], []
        by_len: dict[int, list[int]] = {}
        for i in usual:
            by_len.setdefault(len(pieces[i]), []).append(i)
        for n, own in by_len.items():
            acc = _text_hash(_codes([pieces[i] for i in own]))
            hashes.append(mix(acc[:, n] + np.uint64(n)))
            ids += own
        hashes, ids = np.concatenate(hashes), np.array(ids, np.int32)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        # where the hashes of each leading SLOTS bits begin, and the most that share them
        self.first = np.searchsorted(self.hashes, np.arange(1 << SLOTS, dtype=np.uint64) << np.uint64(64 - SLOTS))
        self.depth = int(np.bincount((self.hashes >> np.uint64(64 - SLOTS)).astype(np.int64)).max())
        self.hashes, self.ids = np.append(self.hashes, np.zeros(self.depth, np.uint64)), np.append(self.ids, np.full(self.depth, -1, np.int32))
        self.of = {pieces[i]: i for i in usual}
        many = [p for p in (pieces[i] for i in usual) if len(p) > 1]
        ends = "".join(c for c in "\n\r\t" if not any(c in p for p in many))
        inner = any(MARK in p.lstrip(MARK) for p in many)
        plain = f"[^{re.escape(ends)}]+" if ends else "(?s:.+)"
        self.cut = re.compile(plain + (f"|[{re.escape(ends)}]" if ends else "") if inner else f"{MARK}*[^{MARK}{re.escape(ends)}]+|{MARK}+" + (f"|[{re.escape(ends)}]" if ends else ""))
        self.raw = [b"" if t in (2, 3) else bytes([int(p[3:5], 16)]) if t == 6 else p.replace(MARK, " ").encode() for p, t in zip(pieces, types)]
        self.raw[self.unk] = " ⁇ ".encode()

    def words(self, text: str) -> list[str]:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return self.cut.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def lattice(self, codes: np.ndarray) -> np.ndarray:
        """Piece ids by (word, start, length - 1), -1 where a substring is no piece."""
        n, size = codes.shape
        acc, most = _text_hash(codes), min(self.longest, size)
        out = np.full((n, size, most), -1, np.int32)
        inverse = powers(size, True)
        for k in range(1, most + 1):
            h = mix((acc[:, k:] - acc[:, :-k]) * inverse[: size - k + 1] + np.uint64(k))
            at = self.first[(h >> np.uint64(64 - SLOTS)).astype(np.int64)]
            for _ in range(self.depth):
                hit = self.hashes[at] == h
                out[:, : size - k + 1, k - 1][hit] = self.ids[at[hit]]
                at += 1
        return out

    def fold_merges(self, edges: np.ndarray) -> np.ndarray:
        """For each word the marks of piece starts, by best merges first."""
        n, size, most = edges.shape
        bounds = np.tile(np.arange(size + 3), (n, 1))
        bounds[:, size:] = size
        rows = np.arange(n)
        live = rows
        starts = np.ones((n, size), bool)
        width = size
        while width > 1 and live.size:
            b = bounds[live]
            left, span = b[:, : width - 1], b[:, 2 : width + 1] - b[:, : width - 1]
            ok = (b[:, 1:width] < size) & (span <= most)
            ids = edges[live[:, None], np.minimum(left, size - 1), np.where(ok, span, 1) - 1]
            score = np.where(ok, self.scores[ids], -np.inf)
            at = score.argmax(1)
            some = score[np.arange(len(live)), at] > -np.inf
            live, at, b = live[some], at[some], b[some]
            starts[live, b[np.arange(len(live)), at + 1]] = False
            shift = np.arange(b.shape[1] - 1)[None] > at[:, None]
            bounds[live, :-1] = np.where(shift, b[:, 1:], b[:, :-1])
            width -= 1
        return starts

    def fold_best(self, edges: np.ndarray) -> np.ndarray:
        """For each word the marks of piece starts, by Viterbi."""
        n, size, most = edges.shape
        best = np.full((n, size + 1), -np.inf)
        back = np.zeros((n, size + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, size + 1):
            for k in range(min(most, end), 0, -1):
                ids = edges[:, end - k, k - 1]
                s = np.where((ids < 0) & (k == 1), self.worst, self.scores[ids]) + best[:, end - k]
                better = s > best[:, end]
                best[better, end], back[better, end] = s[better], k
        starts = np.zeros((n, size), bool)
        at = np.full(n, size)
        live = np.arange(n)
        while live.size:
            at[live] -= back[live, at[live]]
            starts[live, at[live]] = True
            live = live[at[live] > 0]
        return starts

    def _long(self, word: str) -> list[tuple[int, int]]:
        """Spans of one long word by merges, with a heap."""
        n = len(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        end, alive, heap = list(range(1, n + 1)), [True] * n, []

        def offer(a):
            b = right[a]
            if a >= 0 and b < n and (i := self.of.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, end[a], end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, m, e = heapq.heappop(heap)
            b = right[a] if alive[a] else n
            if not alive[a] or b >= n or end[a] != m or end[b] != e:
                continue
            alive[b], end[a], right[a] = False, e, right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return [(a, end[a]) for a in range(n) if alive[a]]

    def _ids(self, text: str) -> list[int]:
        """Ids of one piece of text."""
        i = self.of.get(text)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unk]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each of some distinct words."""
        out: list = [None] * len(words)
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w), []).append(i)
        for size, own in by_len.items():
            if size > LONG and self.bpe:
                for i in own:
                    out[i] = np.array([x for a, e in self._long(words[i]) for x in self._ids(words[i][a:e])], np.int32)
                continue
            step = max(1, CELLS // (size * min(size, self.longest)))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                edges = self.lattice(_codes([words[i] for i in part]))
                starts = self.fold_merges(edges) if self.bpe else self.fold_best(edges)
                r, s = np.nonzero(starts)
                last = np.append(r[1:] != r[:-1], True)
                e = np.where(last, size, np.append(s[1:], size))
                ids = edges[r, s, np.minimum(e - s, edges.shape[2]) - 1]
                begins = np.searchsorted(r, np.arange(len(part) + 1))
                odd = np.zeros(len(part), bool)
                odd[r[ids < 0]] = True
                for j, i in enumerate(part):
                    a, b = begins[j], begins[j + 1]
                    if odd[j]:
                        out[i] = np.array([x for p in range(a, b) for x in ([int(ids[p])] if ids[p] >= 0 else self._ids(words[i][s[p] : e[p]]))], np.int32)
                    else:
                        out[i] = ids[a:b]
        return out

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace")


class Encoder:
    """Encodes texts of one worker; the words seen lately are kept, up to a bound."""

    def __init__(self, table: PieceTable):
        self.table = table
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.flat, self.sizes = [], []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KNOWN:
            self._forget()
        known, before = self.known, len(self.known)
        number, size = known.setdefault, known.__len__
        of_text = [np.array([number(w, size()) for w in self.table.words(t)], np.int64) for t in texts]
        fresh = list(islice(known, before, None))
        if fresh:
            got = self.table.encode_words(fresh)
            self.flat.append(np.concatenate(got))
            self.sizes.append(np.array([len(x) for x in got], np.int64))
        if not self.flat:
            return [np.zeros(0, np.int32) for _ in texts]
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        flat, sizes = self.flat[0], self.sizes[0]
        begins = np.cumsum(sizes) - sizes
        out = []
        for row in of_text:
            n = sizes[row]
            at = np.cumsum(n) - n
            out.append(flat[np.repeat(begins[row] - at, n) + np.arange(int(n.sum()))])
        return out


def piece_table(path: str = MODEL) -> PieceTable:
    if path not in _LOADED:
        _LOADED[path] = PieceTable(path)
    return _LOADED[path]


_IDS = StructField("ids", ArrayType(IntegerType()))


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """The rows of docs with ids, an array of the piece ids of `text`; check: also with round_trip, whether they decode to it."""
    added = [_IDS, *[StructField("round_trip", BooleanType())] * check]
    names = [c for c in docs.columns if c not in [f.name for f in added]]

    def run(batches):
        encoder = Encoder(piece_table(model))
        for b in batches:
            texts = b.column(b.num_columns - 1)
            at = 0
            while at < b.num_rows:
                held, some = 0, []
                while at + len(some) < b.num_rows and held < STRETCH:
                    some.append(texts[at + len(some)].as_py() or "")
                    held += len(some[-1])
                got = encoder.encode(some)
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*got, np.zeros(0, np.int32)]), pa.int32()))
                same = [pa.array([encoder.table.decode(x.tolist()) == t for x, t in zip(got, some)], pa.bool_())] if check else []
                yield [*(c.slice(at, len(some)) for c in b.columns[:-1]), ids, *same]
                at += len(some)

    return beside(docs, names, [F.col("text").cast("string")], released(run), added)


def _split(text, table: PieceTable):
    """The words of a text as a column."""
    if table.squeeze:
        text = F.trim(F.regexp_replace(text, " +", " "))
    marked = F.concat(F.lit(MARK if table.prefix else ""), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(text != "", F.regexp_extract_all(marked, F.lit(table.cut.pattern), 0)).otherwise(F.array().cast("array<string>"))


def lattices(words: DataFrame, table: PieceTable) -> DataFrame:
    """words: word, distinct. Rows (word, edges): edges (start, size, id, score) of all pieces in it, and of single characters that are none (id -1).

    The piece table, whose size is that of the model, is broadcast; words distributed by word stay where they are.
    """
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p, i, float(table.scores[i])) for p, i in table.of.items()], "piece string, id int, score double")
    n = F.length("word")
    spans = F.transform(F.sequence(F.lit(1), n), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(table.longest), n - s + 1)), lambda k: F.struct(s.alias("start"), k.alias("size"), F.col("word").substr(s, k).alias("piece"))))
    rows = words.where("word <> ''").select("word", F.explode(F.flatten(spans)).alias("e")).select("word", "e.start", "e.size", "e.piece")
    met = rows.join(F.broadcast(pieces), "piece", "left").where("id is not null or size = 1")
    edge = F.struct("start", "size", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(table.worst)).alias("score"))
    return met.groupBy("word").agg(F.collect_list(edge).alias("edges"))


def _viterbi(n, edges):
    """Ends of the pieces of the heaviest path, in falling order, by a fold over the places of a word; ties to the longer last piece."""
    none = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def place(best, end):
        into = F.filter(edges, lambda e: e["start"] + e["size"] - 1 == end)
        ways = F.transform(into, lambda e: F.struct((F.get(best, e["start"] - 1)["score"] + e["score"]).alias("score"), (1 - e["start"]).alias("back")))
        top = F.array_max(ways)
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (-top["back"]).alias("back"))))

    best = F.aggregate(F.sequence(F.lit(1), n), none, place)
    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda ends, _: F.when(F.element_at(ends, -1) == 0, ends).otherwise(F.concat(ends, F.array(F.get(best, F.element_at(ends, -1))["back"]))))


def _merges(n, edges):
    """Ends of the pieces in falling order, by a fold that takes the best merge of two neighbours as often as there is one, leftmost first."""
    score = F.map_from_entries(F.transform(F.filter(edges, lambda e: (e["id"] >= 0) & (e["size"] > 1)), lambda e: F.struct(e["start"] * 64 + e["size"], e["score"])))

    def merge(ends, _):
        # ends are start places from 0 to n here
        ways = F.transform(F.sequence(F.lit(1), F.size(ends) - 2), lambda i: F.struct(F.try_element_at(score, (F.get(ends, i - 1) + 1) * 64 + F.get(ends, i + 1) - F.get(ends, i - 1)).alias("score"), (-i).alias("at")))
        top = F.array_max(F.filter(ways, lambda w: w["score"].isNotNull()))
        return F.when((F.size(ends) < 3) | top.isNull(), ends).otherwise(F.filter(ends, lambda x, i: i != -top["at"]))

    return F.reverse(F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), merge))


def segment(lattice: DataFrame, table: PieceTable) -> DataFrame:
    """word and ids of each lattice."""
    n, edges = F.length("word"), F.col("edges")
    ends = F.reverse((_merges if table.bpe else _viterbi)(n, edges))
    cuts = lattice.select("word", "edges", F.filter(ends, lambda x, i: i > 0).alias("ends"), ends.alias("starts"))
    of = F.map_from_entries(F.transform(F.filter("edges", lambda e: e["id"] >= 0), lambda e: F.struct(e["start"] * 64 + e["size"], e["id"])))
    if table.bytes:
        odd = lambda x: F.transform(F.sequence(F.lit(1), F.octet_length(x)), lambda k: F.lit(table.bytes[0]) + F.conv(F.hex(F.substring(F.encode(x, "UTF-8"), k, 1)), 16, 10).cast("int"))
    else:
        odd = lambda x: F.array(F.lit(table.unk))
    ids = F.transform("ends", lambda e, i: F.struct((F.get("starts", i) + 1).alias("start"), (e - F.get("starts", i)).alias("size")))
    found = F.transform(ids, lambda p: F.struct(F.try_element_at(of, p["start"] * 64 + p["size"]).alias("id"), F.col("word").substr(p["start"], p["size"]).alias("piece")))
    return cuts.select("word", F.flatten(F.transform(found, lambda p: F.when(p["id"].isNotNull(), F.array(p["id"])).otherwise(odd(p["piece"])))).alias("ids"))


def encode_relational(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of docs with ids, as `encode` has them, by rows of substrings, joins and Spark's higher-order functions."""
    table = piece_table(model)
    names = [c for c in docs.columns if c != "ids"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*columns(names)).alias("row"), text.alias("text")).withColumn("key", F.struct(F.xxhash64("text"), F.xxhash64("text", F.lit(1))))
    words = cut(rows.select("key", _split(F.col("text"), table).alias("words")).dropDuplicates(["key"]))
    table_of = cut(segment(lattices(words.select(F.explode("words").alias("word")).distinct(), table), table))
    each = words.select("key", F.posexplode("words").alias("pos", "word")).groupBy("key", "word").agg(F.collect_list("pos").alias("places"))
    met = each.join(table_of, "word").select("key", F.explode("places").alias("pos"), "ids").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    ids = met.select(F.col("key").alias("k"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    return rows.join(ids, F.col("key") == F.col("k"), "left").select("row.*", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows with `decoded`, the text of `ids`."""
    names = [c for c in rows.columns if c not in ("ids", "decoded")]

    def run(batches):
        table = piece_table(model)
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids = b.column(b.num_columns - 1)
            yield [*b.columns, pa.array([None if x.values is None else table.decode(x.values.to_pylist()) for x in ids], pa.string())]

    return beside(rows, names, [F.col("ids")], released(run), [_IDS, StructField("decoded", StringType())])


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of pieces, the hash of their ids and whether they decode to the text."""
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
