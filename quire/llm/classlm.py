"""Language-model scores from Brown class-based bigrams.

The model of a text w1 .. wn followed by one end token is

    sum over tokens of log10( P(class | class before) * P(word | class) )

with classes from exchange clustering on the bigrams of all training
documents. The ``CLUSTERED`` most frequent words are moved between classes,
one word at a time, as long as the likelihood of the class bigrams rises. All
further words seen twice or more then join the class that fits their
neighbours in the whole corpus best (one exchange step for all words at once,
in Spark). Words seen once are one more class, whose words are told apart by
their exact counts. Transitions are smoothed with the class frequencies; the rare
class keeps room for words never seen, so a text's probabilities sum to one.

Word counts, bigrams, word contexts and class transitions come from all
training documents and are summed over shuffles; what the driver holds is
bounded by ``CLUSTERED``, ``HELD`` and ``CLASSES``. Counts and classes of the
words behind the ``HELD`` most frequent ones are a stored table, joined to the
documents by word.

Defined results: a null or empty text is one end token; ties in frequency go
to the smaller word; repeated rows are scored (and learned from) each; a null
doc_id is a training row; without training rows all counts are zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path, staged_path
from .common import column, lots, store, store_at

CLASSES, CLUSTERED = 64, 1000
HELD = 200_000                        # the most frequent words, which tasks hold in memory; all others are joined by word
LEAST_COUNT = 2                       # words seen once stay in the class of rare words: they stand for the unseen ones
SWEEPS = 6                            # passes of the exchange over the clustered words at most
PRIOR = 20.0                          # weight of the class frequencies in a transition
END = ""                              # the end token; no word is empty
LOT = 4 << 20                         # bytes of text handled at once (or one text)


def split(batch: pa.RecordBatch, name: str = "text") -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words of a batch's texts in order, numbered among the
    distinct ones, and the row of each."""
    texts = pc.fill_null(column(batch, name).cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    some = pc.greater(pc.binary_length(words), 0)          # white space at an end leaves an empty string
    return words.filter(some).dictionary_encode(), row[np.asarray(some)]


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: how often each word and the end token occur in ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for b in (x for y in batches for x in lots(y, size=LOT)):
            words, _ = split(b)
            n = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n, pa.int64())], names=["word", "c"])
            ends += b.num_rows
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def numbers(words: pa.DictionaryArray, listed: pa.Array) -> np.ndarray:
    """The place of each word in ``listed``, its length for the others."""
    found = pc.fill_null(pc.index_in(words.dictionary, value_set=listed), len(listed))
    return np.asarray(found).astype(np.int64)[np.asarray(words.indices)]


def with_ends(ids: np.ndarray, row: np.ndarray, rows: int, end: int) -> np.ndarray:
    """The numbers of all words with an end before, between and after the texts."""
    out = np.full(len(ids) + rows + 1, end, np.int64)
    out[np.arange(len(ids)) + row + 1] = ids
    return out


def _sequences(batches: Iterator[pa.RecordBatch], listed: pa.Array) -> Iterator[np.ndarray]:
    """Word numbers of the batches' documents; other words are ``len(listed)``, an end is one more."""
    for b in (x for y in batches for x in lots(y, size=LOT)):
        words, row = split(b)
        yield with_ends(numbers(words, listed), row, b.num_rows, len(listed) + 1)


def _summed(docs: DataFrame, count, schema: str = "k long, n long") -> DataFrame:
    """Sum of the sparse counts (key, n) that ``count(batches)`` yields per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in count(batches):
            for a in range(0, len(k), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[a:a + 500_000]), pa.array(n[a:a + 500_000])], names=["k", "n"])

    return (docs.select("text").mapInArrow(run, schema)
            .groupBy("k").agg(F.sum("n").alias("n")))


def _matrix(counts: DataFrame, size: int) -> np.ndarray:
    """A dense size x size matrix of bounded size from (row * size + column, n)."""
    out = np.zeros(size * size)
    rows = counts.toArrow()
    out[np.asarray(rows["k"])] = np.asarray(rows["n"])
    return out.reshape(size, size)


def _pair_counts(docs: DataFrame, listed: pa.Array, classes: np.ndarray | None, size: int) -> np.ndarray:
    """Bigram counts of word numbers (or of their classes); the last two are words not listed, and the end."""
    held = docs.sparkSession.sparkContext.broadcast((listed, classes))

    def count(batches):
        listed, classes = held.value
        total = np.zeros(size * size, np.int64)
        for ids in _sequences(batches, listed):
            x = ids if classes is None else classes[ids]
            total += np.bincount(x[:-1] * size + x[1:], minlength=size * size)
        k = np.flatnonzero(total)
        yield k, total[k]

    return _matrix(_summed(docs, count), size)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, n_words: int, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each of ``n_words`` words. ``bigrams`` has two more
    entries (all other words, the end), which are classes of their own behind
    the ``n_classes``. Words move one by one to the class that raises

        sum over class pairs of h(n) - sum over classes of h(left n) + h(right n),  h(x) = x ln x

    most, until a sweep moves none."""
    b, c = bigrams, n_classes + 2
    cls = np.concatenate([np.arange(n_words) % n_classes, [n_classes, n_classes + 1]])
    one = np.eye(c)[cls]
    after, before = b @ one, (b.T @ one)                   # [word, class]: word then class, class then word
    g = one.T @ after
    left, right = b.sum(1), b.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            a, self_n = cls[w], b[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[a] -= self_n                               # without the word itself
            into[a] -= self_n
            g[a] -= after[w]
            g[:, a] -= before[w]
            g[a, a] += self_n
            rows, cols = g.sum(1), g.sum(0)
            # the gain of putting the word into each class
            gain = (_h(g + out[None, :]) - _h(g)).sum(1) + (_h(g + into[:, None]) - _h(g)).sum(0)
            d = np.diag(g)
            gain += _h(d + out + into + self_n) - _h(d + out) - _h(d + into) + _h(d)
            gain -= _h(rows + left[w]) - _h(rows) + _h(cols + right[w]) - _h(cols)
            new = int(np.argmax(gain[:n_classes]))
            if gain[new] <= gain[a] + 1e-9:
                new = a
            g[new] += out
            g[:, new] += into
            g[new, new] += self_n
            if new != a:
                moved += 1
                cls[w] = new
                after[:, a] -= b[:, w]
                after[:, new] += b[:, w]
                before[:, a] -= b[w]
                before[:, new] += b[w]
        if not moved:
            break
    return cls[:n_words]


def _transitions(g: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """P(column | row), smoothed with the (add-one) frequencies of the columns."""
    often = (g.sum(0) + 1) / (g.sum() + len(g))
    return (g + prior * often) / (g.sum(1, keepdims=True) + prior)


def _join_classes(docs: DataFrame, listed: pa.Array, counts: np.ndarray, cls: np.ndarray,
                  trans: np.ndarray, weight: np.ndarray, n_classes: int) -> np.ndarray:
    """Classes of all listed words: those of the clustered ones, and for the
    others the class that makes their neighbours in the whole corpus likeliest."""
    spark, n, c = docs.sparkSession, len(listed), n_classes + 2
    known = len(cls)
    full = np.concatenate([cls, np.full(n - known, n_classes), [n_classes, n_classes + 1]]).astype(np.int64)
    if n == known:
        return full
    held = spark.sparkContext.broadcast((listed, full, trans, weight, counts))

    def count(batches):
        listed, full, *_ = held.value
        for ids in _sequences(batches, listed):
            new = (ids >= known) & (ids < n)
            at = np.flatnonzero(new)                       # an end stands at both sides of every sequence
            k = np.concatenate([ids[at] * 2 * c + full[ids[at + 1]], ids[at] * 2 * c + c + full[ids[at - 1]]])
            yield np.unique(k, return_counts=True)

    # one shuffle: a word's contexts meet in one partition
    context = _summed(docs, count).select(F.floor(F.col("k") / (2 * c)).alias("w"), "k", "n").repartition("w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, trans, weight, counts = held.value
        rows: dict[int, int] = {}
        parts = []
        for b in batches:
            w = np.asarray(column(b, "w")).astype(np.int64)
            for x in np.unique(w).tolist():
                rows.setdefault(x, len(rows))
            parts.append((w, np.asarray(column(b, "k")) - w * 2 * c, np.asarray(column(b, "n"))))
        if rows:
            m = np.zeros((len(rows), 2 * c), np.float64)
            for w, k, x in parts:
                m[[rows[i] for i in w.tolist()], k] += x
            words = np.array(list(rows))
            value = m[:, :c] @ trans[:n_classes].T + m[:, c:] @ trans[:, :n_classes] + counts[words][:, None] * weight
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(value.argmax(1))], names=["w", "c"])

    found = context.mapInArrow(run, "w long, c long").toArrow()                # at most HELD rows
    full[np.asarray(found["w"])] = np.asarray(found["c"])
    return full


def _join_tail(docs: DataFrame, listed: pa.Array, full: np.ndarray, trans: np.ndarray, weight: np.ndarray,
               n_classes: int, least_count: int) -> DataFrame:
    """word, cls for the words that are not listed and seen ``least_count`` times:
    the class that makes their neighbours likeliest, as for the listed ones.
    ``full`` has the classes from before any word joined, which ``trans`` was made with."""
    c = n_classes + 2
    held = docs.sparkSession.sparkContext.broadcast((listed, full, trans, weight))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, full, *_ = held.value
        for b in (x for y in batches for x in lots(y, size=LOT)):
            words, row = split(b)
            number = numbers(words, listed)
            ids = with_ends(number, row, b.num_rows, len(listed) + 1)
            other = np.flatnonzero(number == len(listed))
            at = other + row[other] + 1
            word = np.tile(np.asarray(words.indices)[other], 2)
            k = np.concatenate([full[ids[at + 1]], c + full[ids[at - 1]]])
            by = np.argsort(word, kind="stable")
            types, starts = np.unique(word[by], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [words.dictionary.take(pa.array(types)),
                 pa.ListArray.from_arrays(pa.array(np.append(starts, len(by)), pa.int32()), pa.array(k[by], pa.int32()))], names=["word", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, trans, weight = held.value

        def best(words: pa.Array, m: np.ndarray) -> pa.RecordBatch:
            n = m[:, :c].sum(1)
            value = m[:, :c] @ trans[:n_classes].T + m[:, c:] @ trans[:, :n_classes] + n[:, None] * weight
            often = n >= least_count
            return pa.RecordBatch.from_arrays([words.filter(pa.array(often)), pa.array(value.argmax(1)[often], pa.int32())], names=["word", "cls"])

        word, rest = None, None                            # the last word of a batch may go on in the next
        for b in batches:
            if not b.num_rows:
                continue
            rows = column(b, "word").cast(pa.string()).dictionary_encode()
            words, lists = rows.dictionary, column(b, "k")
            of = np.repeat(np.asarray(rows.indices).astype(np.int64), np.asarray(pc.list_value_length(lists)))
            m = np.bincount(of * 2 * c + np.asarray(lists.flatten()), minlength=len(words) * 2 * c).reshape(-1, 2 * c).astype(float)
            if word is not None and word[0].as_py() == words[0].as_py():
                m[0] += rest[0]
            elif word is not None:
                yield best(word, rest)
            if len(words) > 1:
                yield best(words[:-1], m[:-1])
            word, rest = words[-1:], m[-1:].copy()
        if word is not None:
            yield best(word, rest)

    return (docs.select("text").mapInArrow(contexts, "word string, k array<int>")
            .repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, cls int"))


def _others(words: pa.DictionaryArray, row: np.ndarray, number: np.ndarray, rows: int, n_listed: int) -> pa.ListArray:
    """Per text: the words that are not listed, how often each stands there and at which word indices."""
    first = np.searchsorted(row, np.arange(rows))
    other = np.flatnonzero(number == n_listed)
    types = max(len(words.dictionary), 1)
    key = row[other] * types + np.asarray(words.indices)[other]
    by = np.argsort(key, kind="stable")
    pairs, starts, count = np.unique(key[by], return_index=True, return_counts=True)
    places = (other - first[row[other]])[by]
    at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(by)), pa.int32()), pa.array(places, pa.int32()))
    offsets = np.searchsorted(pairs, np.arange(rows + 1) * types)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [words.dictionary.take(pa.array(pairs % types)), pa.array(count, pa.int64()), at], names=["word", "n", "at"]))


def _class_bytes(cls: np.ndarray, first: np.ndarray, needed: np.ndarray) -> pa.Array:
    """The classes of each text, its end token included, as two bytes each; null where not ``needed``."""
    cut = cls[1:].astype("<u2").tobytes()
    upto = (2 * np.append(first, len(cls) - 1)).tolist()
    return pa.array([cut[a:z] if x else None for a, z, x in zip(upto[:-1], upto[1:], needed.tolist(), strict=True)], pa.binary())


def _refilled(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, ...]:
    """Pairs of classes before and after the joined words got theirs: previous,
    own, new previous, new own, and the row of each pair."""
    texts = [x or b"" for x in column(batch, "seq").to_pylist()]
    old = np.frombuffer(b"".join(texts), "<u2").astype(np.int64)
    size = np.array([len(x) // 2 for x in texts], np.int64)
    first = np.cumsum(size) - size
    new = old.copy()
    places = column(batch, "places")
    per_row = np.asarray(pc.fill_null(pc.list_value_length(places), 0)).astype(np.int64)
    flat = places.flatten()
    at = flat.field("at")
    n = np.asarray(pc.list_value_length(at)).astype(np.int64)
    new[np.asarray(at.flatten()) + np.repeat(np.repeat(first, per_row), n)] = np.repeat(np.asarray(flat.field("cls")), n)
    starts = first[size > 0]

    def before(x: np.ndarray) -> np.ndarray:
        out = np.concatenate([[end], x[:-1]])[:len(x)].astype(np.int64)
        out[starts] = end
        return out

    return before(old), old, before(new), new, np.repeat(np.arange(len(size)), size)


def _placed(part: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``_row`` and ``places``: the classes of the words joined by word, and where they stand."""
    return (part.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.at")
            .join(vocabulary.where("cls is not null").select("word", "cls"), "word")
            .groupBy("_row").agg(F.collect_list(F.struct("cls", "at")).alias("places")))


def _tail_pairs(docs: DataFrame, listed: pa.Array, full: np.ndarray, vocabulary: DataFrame, size: int) -> np.ndarray:
    """What the classes of the words that are not listed change in the class bigrams."""
    held = docs.sparkSession.sparkContext.broadcast((listed, full))
    schema = "_row long, seq binary, rare array<struct<word: string, n: long, at: array<int>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, full = held.value
        nth = TaskContext.get().partitionId() << 40
        for b in (x for y in batches for x in lots(y, size=LOT)):
            words, row = split(b)
            number = numbers(words, listed)
            rare = _others(words, row, number, b.num_rows, len(listed))
            n = np.bincount(row, minlength=b.num_rows) + 1
            some = np.asarray(pc.list_value_length(rare)) > 0
            seq = _class_bytes(full[with_ends(number, row, b.num_rows, len(listed) + 1)], np.cumsum(n) - n, some)
            yield pa.RecordBatch.from_arrays([pa.array(nth + np.arange(b.num_rows)), seq, rare], names=["_row", "seq", "rare"])
            nth += b.num_rows

    path = staged_path(docs.sparkSession, "places")
    part = store_at(docs.select("text").mapInArrow(run, schema), path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in batches:
            a, x, new_a, new_x, _ = _refilled(b, size - 1)
            total += np.bincount(new_a * size + new_x, minlength=size * size) - np.bincount(a * size + x, minlength=size * size)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    rows = part.select("_row", "seq").join(_placed(part, vocabulary), "_row").select("seq", "places")
    found = _matrix(rows.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), size)
    delete_path(docs.sparkSession, path)                   # the sums are all that is left of it
    return found


class Model:
    """What scoring broadcasts: listed words, their classes, log probabilities.
    ``counts`` and ``classes`` end with two more entries: other words, the end.
    ``tail`` has the count of each class in words that are not listed, and their number."""

    def __init__(self, listed: pa.Array, counts: np.ndarray, ends: int, classes: np.ndarray,
                 transitions: np.ndarray, total: int, distinct: int, tail: tuple[np.ndarray, int] | None = None):
        self.listed, self.classes, self.ends = listed, classes, ends
        self.transitions = np.log10(transitions)
        self.total, self.distinct = total, distinct                            # N and V
        n = np.append(counts, [0, ends]).astype(float)
        per_class = np.bincount(classes, weights=n, minlength=len(transitions))
        self.tail = tail is not None
        in_tail, types = tail if self.tail else (np.zeros(len(transitions)), 0)
        per_class = per_class + in_tail
        self.log_class = np.log10(np.maximum(per_class, 1))
        self.other_size = (total - n.sum() - in_tail.sum()) + (distinct - len(listed) - types - (ends > 0)) + 1
        self.emission = np.log10(np.maximum(n, 1) / np.maximum(per_class[classes], 1))
        self.emission[-2] = 0.0                            # added per word: (c + 1) / other_size
        self.base_size = total + distinct + 1
        self.base = np.log10((n + 1) / self.base_size)
        self.base[-2] = 0.0                                # added per word: (c + 1) / base_size


def _most_frequent(often: DataFrame, n: int) -> pa.Table:
    """The first ``n`` rows of the ordered word, c. The histogram of the counts names the count at which
    they end, so only the words of that count are ranked and no task merges a part of all the others."""
    taken, edge = 0, 0
    # one row per distinct count: fewer than the square root of twice the tokens
    for c, k in often.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        if taken + k > n:
            edge = c
            break
        taken += k
    sure = often.where(F.col("c") > edge).toArrow()
    if not edge or taken == n:
        return sure
    return pa.concat_tables([sure, often.where(F.col("c") == edge).limit(n - taken).toArrow()])


def train(docs: DataFrame, n_classes: int = CLASSES, clustered: int = CLUSTERED, listed: int | None = None,
          least_count: int = LEAST_COUNT, held: int = HELD) -> tuple[Model, DataFrame]:
    """The model of the training ``docs``, and the stored exact counts of all their words, with
    the classes of those that the model doesn't list. All words seen ``least_count`` times have a
    class, or the ``listed`` most frequent of them; the model lists ``held`` of them at most."""
    path = staged_path(docs.sparkSession, "vocabulary")
    vocabulary = store_at(count_words(docs), path)
    r = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    often = (vocabulary.where((F.octet_length("word") > 0) & (F.col("c") >= least_count))
             .orderBy(F.desc("c"), F.col("word").cast("binary")))
    top = _most_frequent(often, held if listed is None else min(held, listed))
    words, counts = top["word"].combine_chunks().cast(pa.string()), np.asarray(top["c"]).astype(np.int64)
    ends = vocabulary.where(F.octet_length("word") == 0).select("c").first()
    ends = ends.c if ends else 0
    k = min(clustered, len(words))
    bigrams = _pair_counts(docs, words[:k], None, k + 2)
    cls = exchange(bigrams, k, n_classes)
    one = np.eye(n_classes + 2)[np.concatenate([cls, [n_classes, n_classes + 1]]).astype(int)]
    g = one.T @ bigrams @ one
    trans, weight = np.log(_transitions(g)), -np.log(g.sum(0)[:n_classes] + 1)
    before = np.concatenate([cls, np.full(len(words) - k, n_classes), [n_classes, n_classes + 1]]).astype(np.int64)
    full = _join_classes(docs, words, counts, cls, trans, weight, n_classes)
    g = _pair_counts(docs, words, full, n_classes + 2)
    tail = None
    if len(words) == held and (listed is None or listed > held):
        found = _join_tail(docs, words, before, trans, weight, n_classes, least_count)
        if listed is not None:
            found = found.join(often.limit(listed).select("word"), "word", "left_semi")
        vocabulary = store(vocabulary.join(found, "word", "left"), "classes")
        delete_path(docs.sparkSession, path)               # the stored classes have every word and count
        in_tail, types = np.zeros(n_classes + 2), 0
        for x in vocabulary.where("cls is not null").groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            in_tail[x.cls] = x.c
            types += x.n
        tail = in_tail, types
        g = g + _tail_pairs(docs, words, full, vocabulary, n_classes + 2)
    else:
        vocabulary = vocabulary.withColumn("cls", F.lit(None).cast("int"))
    return Model(words, counts, ends, full, _transitions(g), r[0], r[1], tail), vocabulary


def _refined(rows: DataFrame, held, size: int) -> DataFrame:
    """``rows`` with ``fix`` instead of ``seq`` and ``places``: what the classes of the words joined by word change in the score."""
    kept = rows.drop("seq", "places")
    schema = T.StructType([*kept.schema.fields, T.StructField("fix", T.DoubleType())])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for b in batches:
            a, x, new_a, new_x, row = _refilled(b, size - 1)
            change = m.transitions[new_a, new_x] - m.transitions[a, x]
            change -= np.where(new_x != x, m.log_class[new_x], 0.0)            # the place of a joined word: P(word | class)
            fix = np.bincount(row, weights=change, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*[column(b, n) for n in names], pa.array(fix)], names=schema.names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score and perplexity per row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    rare = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()),
                                     T.StructField("at", T.ArrayType(T.IntegerType()))]))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_row", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
                           T.StructField("base", T.DoubleType()), T.StructField("own", T.DoubleType()),
                           T.StructField("seq", T.BinaryType()), T.StructField("rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        nth, end = TaskContext.get().partitionId() << 40, len(m.classes) - 1
        for b in (x for y in batches for x in lots(y, "_text", LOT)):
            words, row = split(b, "_text")
            number = numbers(words, m.listed)
            ids = with_ends(number, row, b.num_rows, end)
            cls = m.classes[ids]
            n = np.bincount(row, minlength=b.num_rows) + 1                     # tokens, the end included
            first = np.cumsum(n) - n                                           # of each text, behind the end before it
            own = np.add.reduceat(m.transitions[cls[:-1], cls[1:]] + m.emission[ids[1:]], first)
            base = np.add.reduceat(m.base[ids[1:]], first)
            other = number == end - 1
            known = n - 1 - np.bincount(row[other], minlength=b.num_rows) + (m.ends > 0)
            rare = _others(words, row, number, b.num_rows, end - 1)
            some = (np.asarray(pc.list_value_length(rare)) > 0) & m.tail
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(nth + np.arange(b.num_rows)), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(base), pa.array(own), _class_bytes(cls, first, some), rare], names=schema.names)
            nth += b.num_rows

    part = store(rows.mapInArrow(run, schema), "scores")
    log = F.col("n") * F.log10("c")
    # one join by word for the counts and, where there are some, the classes of the words that are not listed
    words = part.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.n", *(["r.at"] if model.tail else []))
    sums = [F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum("n").alias("n2"),
            F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log2"),
            # words with a class: P(word | class) has no room for new ones
            F.sum(F.when(F.col("cls").isNotNull(), log).otherwise(F.col("n") * F.log10(F.col("c") + 1))).alias("log3"),
            F.sum(F.when(F.col("cls").isNull(), F.col("n")).otherwise(0)).alias("n3")]
    if model.tail:
        sums.append(F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("cls", "at"))).alias("places"))
    tail = words.join(vocabulary, "word", "left").withColumn("c", F.coalesce("c", F.lit(0))).groupBy("_row").agg(*sums)
    if model.tail:
        both = _refined(part.drop("rare").join(tail, "_row", "left"), held, len(model.transitions))
    else:
        both = part.drop("rare", "seq").join(tail, "_row", "left").withColumn("fix", F.lit(0.0))
    n2, log2, n3, log3 = (F.coalesce(k, F.lit(0.0) if k[0] == "l" else F.lit(0)) for k in ("n2", "log2", "n3", "log3"))
    both = both.select(
        *keep, "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + log2 - n2 * F.lit(float(np.log10(model.base_size)))).alias("base_score"),
        (F.col("own") + F.coalesce("fix", F.lit(0.0)) + log3 - n3 * F.lit(float(np.log10(model.other_size)))).alias("score"))
    return both.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
