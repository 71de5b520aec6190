"""Language-model scores from a Brown class-based bigram model.

P(text) is the product over its tokens of P(class | class before) * P(word | class), the text's end being a token of its own.

Words that occur `least` times in the training texts are clustered, the `clustered` most frequent ones at most (that bounds
what is sent to all executors).  The head of them, words of at least `head_share` of all tokens, is clustered by exchange: from the
counts of all word pairs of the training texts every word gets its counts of classes before and after it, and moves to the class in
which these are likeliest, half of the words at a time; the matrix of class pairs is then counted anew.  Turns end when one
adds less than `gain` of the information that classes of neighbours have about each other, or after `turns`.  All other clustered words
then move, from the class of their shape (length, last byte, digits), to the class in which their neighbours' classes are likeliest;
only words that are rarer than `least`, or unknown, stay in their shape's class.  All counts are over all training texts.

Rare words stay out of memory: their counts are joined by word, and as each is rare, no key of that join is large.  A word w of
class c has (n(w) + a) / (N_c + a (V_c + 1)), the last share being for unknown words of c.  Class pairs are smoothed towards the
shares of the classes.  Clustered words are looked up by a 64-bit hash.

Every row is scored by itself, whatever its doc_id: rows are told apart by doc_id and a hash of the text, equal ones get one
result each.  Null texts are empty texts (one token, the end); a null doc_id counts as the text "None" for the folds; without training
texts all counts are 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import bytelevel, frames, words

END = ""  # no word is empty
SHAPES = 32
SLICE = 4 << 20


@dataclass(frozen=True)
class Setup:
    folds: int = 10  # texts whose crc32(doc_id) is 0 modulo this are held out
    classes: int = 64
    turns: int = 4
    gain: float = 0.01
    head_share: float = 1e-5
    least: int = 5  # occurrences from which a word is clustered
    clustered: int = 2_000_000
    add: float = 0.1

    @property
    def all_classes(self) -> int:
        """Clusters, the end's class, and the shapes."""
        return self.classes + 1 + SHAPES


def held_out(ids: pa.Array, folds: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(str(i).encode()) % folds == 0 for i in ids.to_pylist()), bool, len(ids))


def tokens(texts: pa.Array) -> words.Words:
    """Words with A-Z in lower case."""
    b, at = bytelevel.batch_bytes(texts)
    b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    return words.split(b, at)


def shapes(dictionary: pa.Array) -> np.ndarray:
    """Shape of each word: length, last byte, whether it has a digit."""
    if not len(dictionary):
        return np.zeros(0, np.int64)
    n = np.asarray(pc.binary_length(dictionary), np.int64)
    flat = np.frombuffer(b"".join(dictionary.to_pylist()), np.uint8)
    ends = np.cumsum(n)
    digits = np.concatenate([[0], np.cumsum((flat >= 48) & (flat <= 57))])
    some = digits[ends] > digits[ends - n]
    last = flat[ends - 1]
    sort = np.where(last >= 128, 3, np.where(np.isin(last, np.frombuffer(b"aeiouy", np.uint8)), 0, np.where((last >= 97) & (last <= 122), 1, 2)))
    return (np.digitize(n, [4, 7, 10]) * 4 + sort) * 2 + some


class Vocabulary:
    """Clustered words by number, in descending order of their counts; then the end, then the shapes of all other words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, head: int):
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order.astype(np.int32)
        self.counts = np.append(counts, ends)
        self.end, self.head = len(hashes), head

    @property
    def symbols(self) -> int:
        return self.end + 1 + SHAPES

    def place(self, dictionary: pa.Array, head: bool = False) -> np.ndarray:
        """Symbol of each distinct word; with `head`, words beyond it are symbols of their shape too."""
        if not len(dictionary):
            return np.zeros(0, np.int64)
        h = words.hashes(dictionary)
        at = np.minimum(np.searchsorted(self.sorted, h), max(len(self.sorted) - 1, 0))
        known = self.sorted[at] == h if len(self.sorted) else np.zeros(len(h), bool)
        out = np.where(known, self.number[at] if len(self.sorted) else 0, -1).astype(np.int64)
        rare = (out < 0) | (head & (out >= self.head))
        if rare.any():
            out[rare] = self.end + 1 + shapes(dictionary.filter(pa.array(rare)))
        return out

    def sequence(self, w: words.Words, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of each token, ends included, that of the token before (an end at first), and where each text's tokens begin."""
        now = np.insert(place[w.code], w.at[1:], self.end)
        at = np.concatenate([[0], np.cumsum(np.diff(w.at) + 1)])
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[at[:-1]] = self.end
        return now, before, at


def training(part: pa.RecordBatch, setup: Setup) -> pa.RecordBatch:
    return part.filter(pa.array(~held_out(part.column(0), setup.folds)))


def counted(docs: DataFrame, setup: Setup) -> DataFrame:
    """word, h (its hash), c over the training texts; the end's count under the empty word."""

    def f(batches):
        for whole in batches:
            for part in bytelevel.slices(whole, "text", SLICE):
                part = training(part, setup)
                if not len(part):
                    continue
                w = tokens(part.column(1))
                n = np.bincount(w.code, minlength=len(w.dictionary))
                own = w.dictionary.filter(pa.array(n > 0))  # the dictionary has the gaps between words, too
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([own.cast(pa.string()), pa.array([END])]), pa.array(np.append(words.hashes(own), np.uint64(0)).view(np.int64)), pa.array(np.append(n[n > 0], len(part)), pa.int64())],
                    ["word", "h", "c"],
                )

    return frames.map_arrow(docs, f, "word string, h long, c long").groupBy("word", "h").agg(F.sum("c").alias("c"))


FLAT = "bucket int, x binary, n binary"  # keys and their counts, flat arrays of 64-bit integers: the JVM moves few, large rows


def flat(bucket: list[int], x: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
    raw = lambda parts: [p.astype("<i8").tobytes() for p in parts]
    return frames.batch({"bucket": pa.int32(), "x": pa.binary(), "n": pa.binary()}, bucket=bucket, x=raw(x), n=raw(n))


def read_flat(batches):
    """(bucket, keys, counts) of each row."""
    for part in batches:
        for bucket, x, n in zip(*(part.column(i).to_pylist() for i in range(3))):
            yield bucket, np.frombuffer(x, "<i8"), np.frombuffer(n, "<i8")


class Sums:
    """Counts by key; arrays are put together whenever more than `most` keys are held."""

    def __init__(self, most: int = 4_000_000):
        self.keys, self.counts, self.held, self.most = [], [], 0, most

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(n)
        self.held += len(key)
        if self.held > self.most:
            key, n = self.take()
            self.keys, self.counts, self.held = [key], [n], len(key)

    @property
    def full(self) -> bool:
        return self.held > self.most * 3 // 4

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(self.counts), minlength=len(key)).astype(np.int64)
        self.keys, self.counts, self.held = [], [], 0
        return key, n


def dealt(key: np.ndarray, n: np.ndarray, bucket: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Keys in order, by bucket."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edge))
    cut = lambda v: [v[edge[i] : edge[i + 1]] for i in some]
    return flat(some.tolist(), cut(key[order]), cut(n[order]))


def paired(docs: DataFrame, vocabulary, setup: Setup, buckets: int) -> DataFrame:
    """How often symbol b follows a in the training texts (key a * symbols + b), words beyond the head by their shapes; each text begins after an end."""

    def f(batches):
        v, held = vocabulary.value, Sums(2_000_000)
        out = lambda key, n: dealt(key, n, (words.mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets)
        for whole in batches:
            for part in bytelevel.slices(whole, "text", SLICE):
                part = training(part, setup)
                if not len(part):
                    continue
                w = tokens(part.column(1))
                now, before, _ = v.sequence(w, v.place(w.dictionary, head=True))
                held.add(*np.unique(before * v.symbols + now, return_counts=True))
                if held.full:
                    yield out(*held.take())
        yield out(*held.take())

    def summed(batches):
        now, held = None, Sums()

        def rows():
            key, n = held.take()
            for lo in range(0, len(key), 200_000):
                yield flat([now], [key[lo : lo + 200_000]], [n[lo : lo + 200_000]])

        for bucket, x, n in read_flat(batches):
            if bucket != now:
                yield from rows()
                now = bucket
            held.add(x, n)
        yield from rows()

    return frames.map_arrow(frames.map_arrow(docs, f, FLAT).repartition("bucket").sortWithinPartitions("bucket"), summed, FLAT)


def gathered(cells: DataFrame, t: int) -> np.ndarray:
    out = np.zeros(t * t, np.int64)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # t * t rows at most
        out[r["cell"]] = r["n"]
    return out.reshape(t, t)


def cells(own: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(own)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(own[some])], ["cell", "n"])


def matrix(pairs: DataFrame, symbols: int, classes, t: int) -> np.ndarray:
    """Counts of class pairs; each task sends its own t x t sums."""

    def f(batches):
        own = np.zeros(t * t, np.int64)
        c = classes.value.astype(np.int64)
        for _, x, n in read_flat(batches):
            own += np.bincount(c[x // symbols] * t + c[x % symbols], weights=n, minlength=t * t).astype(np.int64)
        yield cells(own)

    return gathered(frames.map_arrow(pairs, f, "cell int, n long"), t)


def whole_matrix(docs: DataFrame, vocabulary, classes, setup: Setup) -> np.ndarray:
    """As matrix(), from the texts, with all words' own classes."""
    t = setup.all_classes

    def f(batches):
        own, v, c = np.zeros(t * t, np.int64), vocabulary.value, classes.value.astype(np.int64)
        for whole in batches:
            for part in bytelevel.slices(whole, "text", SLICE):
                part = training(part, setup)
                if len(part):
                    w = tokens(part.column(1))
                    now, before, _ = v.sequence(w, v.place(w.dictionary))
                    own += np.bincount(c[before] * t + c[now], minlength=t * t)
        yield cells(own)

    return gathered(frames.map_arrow(docs, f, "cell int, n long"), t)


def affinity(n: np.ndarray) -> np.ndarray:
    """Log of how much likelier each pair of classes is than by chance, up to a constant."""
    t, of = len(n), np.maximum(n.sum(1), n.sum(0)).astype(np.float64)
    return np.log((n + 0.1) / np.outer(of + 0.1 * t, of + 0.1 * t))


def information(n: np.ndarray) -> float:
    """Mutual information of a token's class and that of the one before, in nats: what exchange raises."""
    p = n / max(n.sum(), 1)
    chance = np.outer(p.sum(1), p.sum(0))
    some = p > 0
    return float((p[some] * np.log(p[some] / chance[some])).sum())


def likeliest(before: np.ndarray, after: np.ndarray, link: np.ndarray, k: int) -> np.ndarray:
    """For each word, of its counts of classes before and after it, the cluster in which these are likeliest."""
    return (after @ link[:k].T + before @ link[:, :k]).argmax(1)


def moved(contexts: DataFrame, classes: np.ndarray, first: int, last: int, buckets: int, link: np.ndarray, setup: Setup) -> np.ndarray:
    """Classes after each word (number first to last - 1) that has contexts (key word * 2 t + slot, bucket word % buckets) moved to its likeliest cluster.

    A bucket's sums are a dense matrix of its words.
    """
    t, k = setup.all_classes, setup.classes
    rows = (last - first) // buckets + 2

    def choose(batches):
        now, x = None, None

        def begin(bucket):  # the first word that belongs to a bucket
            return first + (bucket - first) % buckets

        def best():
            some = np.flatnonzero(x.any(1))
            return pa.RecordBatch.from_arrays([pa.array(begin(now) + some * buckets, pa.int32()), pa.array(likeliest(x[some, t:], x[some, :t], link, k), pa.int32())], ["word", "to"])

        for bucket, key, n in read_flat(batches):
            if bucket != now:
                if x is not None:
                    yield best()
                now, x = bucket, np.zeros((rows, 2 * t))
            row = (key // (2 * t) - begin(now)) // buckets
            x += np.bincount(row * 2 * t + key % (2 * t), weights=n, minlength=x.size).reshape(x.shape)
        if x is not None:
            yield best()

    to = frames.map_arrow(contexts.repartition("bucket").sortWithinPartitions("bucket"), choose, "word int, to int").toArrow()  # `clustered` rows at most
    after = classes.copy()
    after[to.column("word").to_numpy()] = to.column("to").to_numpy()
    return after


def exchanged(pairs: DataFrame, symbols: int, classes, head: int, setup: Setup, half: int, n: np.ndarray) -> np.ndarray:
    """Classes after one half of a turn: the head's words of that half move to where their neighbours' classes are likeliest."""
    t, buckets = setup.all_classes, head // 500 + 1

    def contexts(batches):
        c, held = classes.value.astype(np.int64), Sums()
        for _, x, m in read_flat(batches):
            a, b = x // symbols, x % symbols
            for word, slot in ((a, c[b]), (b, t + c[a])):
                mine = (word < head) & (word % 2 == half)
                held.add(word[mine] * 2 * t + slot[mine], m[mine])
            if held.full:
                key, m = held.take()
                yield dealt(key, m, key // (2 * t) % buckets, buckets)
        key, m = held.take()
        yield dealt(key, m, key // (2 * t) % buckets, buckets)

    return moved(frames.map_arrow(pairs, contexts, FLAT), classes.value, 0, head, buckets, affinity(n), setup)


def settled(docs: DataFrame, vocabulary, classes, setup: Setup, n: np.ndarray, tokens_in_all: int) -> np.ndarray:
    """Classes in which the clustered words beyond the head are where their neighbours' classes are likeliest."""
    t, v0 = setup.all_classes, vocabulary.value
    rest = v0.end - v0.head
    if rest <= 0:
        return classes.value
    buckets = min(rest, max(rest // 2_000 + 1, tokens_in_all // 50_000_000))

    def contexts(batches):
        v, c, held = vocabulary.value, classes.value.astype(np.int64), Sums()
        for whole in batches:
            for part in bytelevel.slices(whole, "text", SLICE):
                part = training(part, setup)
                if not len(part):
                    continue
                w = tokens(part.column(1))
                dense = v.place(w.dictionary)
                far = (dense >= v.head) & (dense < v.end)
                shaped = dense.copy()
                if far.any():
                    shaped[far] = v.end + 1 + shapes(w.dictionary.filter(pa.array(far)))
                of, _, _ = v.sequence(w, dense)
                now, before, _ = v.sequence(w, shaped)
                after = np.append(now[1:], v.end)  # a text's last token is its end, which isn't asked for
                mine = (of >= v.head) & (of < v.end)
                word = of[mine] * 2 * t
                for slot in (c[after[mine]], t + c[before[mine]]):
                    held.add(word + slot, np.ones(len(word), np.int64))
                if held.full:
                    key, m = held.take()
                    yield dealt(key, m, key // (2 * t) % buckets, buckets)
        key, m = held.take()
        yield dealt(key, m, key // (2 * t) % buckets, buckets)

    return moved(frames.map_arrow(docs, contexts, FLAT), classes.value, v0.head, v0.end, buckets, affinity(n), setup)


@dataclass
class Model:
    vocabulary: Vocabulary
    classes: np.ndarray  # of each symbol
    n: np.ndarray  # counts of class pairs
    tokens: int
    distinct: int
    words: np.ndarray  # distinct words of each class
    rare: DataFrame  # word, c of the words that aren't clustered
    information: list[float] = field(default_factory=list)  # of classes of neighbours in the head, before each turn and at the end


def learn(texts: DataFrame, setup: Setup) -> Model:
    spark, t, k = texts.sparkSession, setup.all_classes, setup.classes
    counts = frames.kept(counted(texts, setup), "counts")
    total = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    n_all = total["n"] or 0
    often = counts.filter((F.col("c") >= setup.least) & (F.col("word") != END))
    top = often.select("h", "c").orderBy(F.desc("c"), "h").limit(setup.clustered).toArrow()
    c, h = top.column("c").to_numpy(), top.column("h").to_numpy().view(np.uint64)
    v = Vocabulary(h, c, total["ends"] or 0, int((c >= setup.head_share * n_all).sum()))
    vocabulary = spark.sparkContext.broadcast(v)
    classes = np.concatenate([np.arange(v.end) % k, [k], k + 1 + np.arange(SHAPES)]).astype(np.uint8)
    pairs = frames.kept(paired(texts, vocabulary, setup, n_all // 5_000_000 + 8), "pairs")
    seen = []
    for turn in range(setup.turns + 1):
        for half in (0, 1):
            sent = spark.sparkContext.broadcast(classes)
            n = matrix(pairs, v.symbols, sent, t)
            if half == 0:
                seen.append(information(n))
                done = turn == setup.turns or v.head == 0 or (turn > 0 and seen[-1] - seen[-2] < setup.gain * seen[-1])
                if done:
                    break
            classes = exchanged(pairs, v.symbols, sent, v.head, setup, half, n)
        if done:
            break
    frames.drop_kept(pairs)
    classes = settled(texts, vocabulary, sent, setup, n, n_all)
    n = whole_matrix(texts, vocabulary, spark.sparkContext.broadcast(classes), setup)
    last = (int(c[-1]), int(h[-1].astype(np.int64))) if v.end == setup.clustered else (setup.least, None)  # where `clustered` cuts, or `least`
    rare = F.col("c") < last[0] if last[1] is None else (F.col("c") < last[0]) | ((F.col("c") == last[0]) & (F.col("h") > last[1]))
    tail = counts.filter(rare & (F.col("word") != END)).select("word", "c")

    def shaped(batches):
        for part in batches:
            n = np.bincount(shapes(part.column(0).cast(pa.binary())), minlength=SHAPES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES), pa.int32()), pa.array(n, pa.int64())], ["shape", "n"])

    distinct = np.bincount(classes[: v.end + 1], minlength=t).astype(np.float64)
    for r in frames.map_arrow(tail.select("word"), shaped, "shape int, n long").groupBy("shape").agg(F.sum("n").alias("n")).collect():  # SHAPES rows at most
        distinct[k + 1 + r["shape"]] += r["n"]
    return Model(v, classes, n, n_all, total["v"], distinct, tail, seen)


def score(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = frames.texts_of(docs)
    return scores(texts, learn(texts, setup), setup)


def scores(texts: DataFrame, m: Model, setup: Setup) -> DataFrame:
    """The columns of score() for rows (doc_id, text) under a model."""
    spark, t, k, v0 = texts.sparkSession, setup.all_classes, setup.classes, m.vocabulary
    n = m.n.astype(np.float64)
    size = n.sum(0)
    share = (size + setup.add) / (size.sum() + setup.add * t)
    step = np.log10((n + share[None, :]) / (n.sum(1, keepdims=True) + 1))
    room = size + setup.add * (m.words + 1)
    below = m.tokens + setup.add * (m.distinct + 1)
    emit = np.log10((v0.counts + setup.add) / room[m.classes[: v0.end + 1]])
    base = np.log10((v0.counts + setup.add) / below)
    model = spark.sparkContext.broadcast((v0, m.classes, step, emit, base))

    def scored(batches):
        import xxhash

        v, c, step, emit, base = model.value
        kind = {"doc_id": pa.int64(), "print": pa.int64(), "word": pa.string(), "shape": pa.int32(), "times": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
        for whole in batches:
            for part in bytelevel.slices(whole, "text", SLICE):
                w = tokens(part.column(1))
                place = v.place(w.dictionary)
                now, before, at = v.sequence(w, place)
                own = now <= v.end
                inside = np.where(own, now, 0)
                add = lambda x: np.add.reduceat(x, at[:-1])
                prints = np.fromiter((xxhash.xxh3_64_intdigest(x.as_py()) for x in part.column(1)), np.uint64, len(part)).view(np.int64)
                known = own & (v.counts[inside] > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(prints), pa.array([f" {i}" for i in prints], pa.string()), pa.array(np.full(len(part), -1), pa.int32()), pa.array(np.diff(at)),
                     pa.array(add(known.astype(np.int64))), pa.array(add(np.where(own, base[inside], 0.0))), pa.array(add(step[c[before], c[now]] + np.where(own, emit[inside], 0.0)))], names=list(kind))
                rare = place[w.code] > v.end
                key, times = np.unique(w.doc[rare] * len(w.dictionary) + w.code[rare], return_counts=True)
                if len(key):
                    code, doc = key % len(w.dictionary), key // len(w.dictionary)
                    none = pa.nulls(len(key), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(prints[doc]), w.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(place[code] - v.end - 1, pa.int32()), pa.array(times), none, none.cast(pa.float64()), none.cast(pa.float64())], names=list(kind))

    rows = frames.map_arrow(texts, scored, "doc_id long, print long, word string, shape int, times long, known long, base double, score double")
    with_counts = rows.join(m.rare, "word", "left")
    c, is_doc = F.coalesce("c", F.lit(0)), F.col("shape") < 0
    rooms = F.array(*[F.lit(float(x)) for x in room[k + 1 :]])
    of_room = F.element_at(rooms, F.greatest(F.col("shape"), F.lit(0)) + 1)
    log = lambda x: F.col("times") * F.log10(x)
    sums = with_counts.groupBy("doc_id", "print").agg(
        F.sum(F.when(is_doc, 1).otherwise(0)).alias("rows"),
        F.sum(F.when(is_doc, F.col("times"))).alias("n_tokens"),
        F.sum(F.when(is_doc, F.col("known")).otherwise(F.when(c > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.when(is_doc, F.col("base")).otherwise(log((c + setup.add) / below))).alias("base_score"),
        F.sum(F.when(is_doc, F.col("score")).otherwise(log((c + setup.add) / of_room))).alias("score"),
    )
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % setup.folds == 0
    each = sums.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    whole = lambda x: (F.col(x) / F.col("rows")).cast("long").alias(x)
    return each.select(
        "doc_id", F.coalesce(held, F.lit(zlib.crc32(b"None") % setup.folds == 0)).alias("held_out"), whole("n_tokens"), whole("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )
