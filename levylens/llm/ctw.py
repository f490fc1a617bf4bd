"""Context-tree weighting over bytes, learned from a whole corpus.

A text is its words in lower case (A-Z only), each followed by a blank, the last one by a line
feed, which ends the text. A byte is eight binary decisions; each decision has a tree of contexts, the
bytes before it, most recent first, down to DEPTH. Every node estimates its decision by Krichevsky
and Trofimov's rule, and its weighted probability is the even mixture of its own estimate and the
product of its children's. A byte's code length then mixes the estimates of all depths, weighted by
how well each coded what was learned.

The counts are those of DEPTH + 1 bytes (`grams`: context and next byte, packed into a long without
loss). They are counted in Spark, range-partitioned by context and weighted group by group; contexts
that reach across the border of a group are completed from one short table of their counts. Texts
are scored in two parts that together are exact: the most frequent grams and words, HEAD_GRAMS and
HEAD_WORDS at most, go to all tasks as arrays of that bound, and all others are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from levylens.llm._words import parts
from levylens.sources.sinks import staged

DEPTH, DEEPEST = 5, 6
HEAD_GRAMS, HEAD_WORDS = 1 << 20, 1 << 19
GROUP_GRAMS = 1 << 19  # rows of a group while the tree is weighted
SLICE_BYTES = 2 << 20  # text taken at a time in a task
WINDOW = 1 << 17  # bytes whose grams are in memory, and in the cache, at once
HELD_GRAMS, HELD_WORDS = 1 << 20, 1 << 19  # distinct ones a task holds before it sends them on
SMOOTH = 0.1
LONG_WORD = 48  # longer words are known by a blank and their SHA-256
_END = b"\n"
_EMPTY = -1


# -- text ------------------------------------------------------------------------------------------


def words(text: str | None) -> list[bytes]:
    """The words in lower case: bytes between blanks, tabs and line separators."""
    return (text or "").encode().lower().split()


def _short(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b" " + hashlib.sha256(word).digest()


def windows(texts: list[list[bytes]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, indexes of their texts) of all bytes of the texts, WINDOW bytes at a time.

    The most recent byte of a context is the highest of the packed number, the next byte the
    lowest. Before a text stand line feeds.
    """
    pad = _END * depth
    bodies = [b" ".join(t) + _END for t in texts]
    raw = np.frombuffer(pad + pad.join(bodies), dtype=np.uint8)
    n = np.array([len(b) for b in bodies], dtype=np.int64)
    starts = np.cumsum(np.concatenate([[0], n[:-1] + depth]))
    ends = starts + n
    for at in range(0, len(raw) - depth, WINDOW):
        stop = min(at + WINDOW, len(raw) - depth)
        out = raw[at + depth : stop + depth].astype(np.int64)
        for k in range(depth):
            out |= raw[at + depth - 1 - k : stop + depth - 1 - k].astype(np.int64) << 8 * (depth - k)
        opens = np.zeros(stop - at, dtype=np.int64)
        inside = np.searchsorted(starts, [at, stop])
        opens[starts[inside[0] : inside[1]] - at] = 1
        text = np.cumsum(opens) + inside[0] - 1
        body = np.arange(at, stop) < ends[text]
        yield out[body], text[body]


# -- counts ----------------------------------------------------------------------------------------


def _counted(depth: int):
    """(gram, word, learned, seen): occurrences in the texts to learn from and in all texts, of
    grams (word is null) and of words (gram is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # (grams in order, learned, seen)
        size = 0
        tokens: tuple[Counter, Counter] = (Counter(), Counter())  # in other texts, in learned ones

        def gram_rows(keys: np.ndarray, learned: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            return _batch(keys, [None] * len(keys), learned, seen)

        def word_rows() -> pa.RecordBatch:
            names = list(tokens[0] | tokens[1]) if tokens[0] else list(tokens[1])
            learned = [tokens[1][w] for w in names]
            seen = [n + tokens[0][w] for w, n in zip(names, learned, strict=True)]
            out = _batch([None] * len(names), names, learned, seen)
            tokens[0].clear()
            tokens[1].clear()
            return out

        for batch in batches:
            for part in parts(batch, 0, SLICE_BYTES):
                learns = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = [words(t) for t in part.column(0).to_pylist()]
                for found, text in windows(texts, depth):
                    keys, n = np.unique(found << 1 | learns[text], return_counts=True)
                    held.append((keys >> 1, n * (keys & 1), n))
                    size += len(keys)
                for text, learned in zip(texts, learns.tolist(), strict=True):
                    if max(map(len, text), default=0) > LONG_WORD:
                        text = [_short(w) for w in text]
                    text.append(_END)
                    tokens[learned].update(text)
                if size > 2 * HELD_GRAMS:
                    held[:] = [_summed(held)]
                    size = len(held[0][0])
                    if size > HELD_GRAMS:
                        yield gram_rows(*held.pop())
                        size = 0
                if len(tokens[0]) + len(tokens[1]) > HELD_WORDS:
                    yield word_rows()
        if held:
            yield gram_rows(*_summed(held))
        yield word_rows()

    return run, "gram long, word binary, learned long, seen long"


def _summed(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Runs (keys in order, numbers ...) as one with every key once and its numbers added up."""
    keys, *numbers = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(keys, kind="stable")  # merges the runs
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    if not len(first):
        return (keys, *numbers)
    return (keys[first], *(np.add.reduceat(x[order], first) for x in numbers))


def _batch(gram, word, learned, seen) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    columns = [pa.array(c, t) for c, t in zip((gram, word, learned, seen), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["gram", "word", "learned", "seen"])


def counted(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`docs` is (text, learns). Stored: the counts of every gram and word of all texts. Runs a job."""
    run, schema = _counted(depth)
    found = docs.select("text", "learns").mapInArrow(run, schema)
    sums = [F.sum(c).alias(c) for c in ("learned", "seen")]
    return staged(found.groupBy("gram", "word").agg(*sums), "counts")


# -- the weighted tree -----------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: eight steps up, then Stirling's series."""
    up = np.ones_like(x)
    for k in range(8):
        up *= x + k
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z / 521.5))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(up)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the estimator's probability for a sequence with so many zeros and ones."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    out = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi)
    return np.where(a + b > 0, out, 0.0)


class _Level:
    """The grams cut to k bytes of context, in order; `up` leads there from those of k + 1 bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, up: np.ndarray | None):
        self.keys, self.counts, self.up = keys, counts, up

    def shorter(self) -> _Level:
        keys, up = np.unique((self.keys >> 16 << 8) | (self.keys & 255), return_inverse=True)
        return _Level(keys, np.bincount(up, self.counts, len(keys)), up)


def _levels(keys: np.ndarray, counts: np.ndarray, depth: int) -> list[_Level]:
    out = [_Level(keys, counts.astype(np.float64), None)]
    for _ in range(depth):
        out.append(out[-1].shorter())
    return out[::-1]  # by depth from 0


def _nodes(level: _Level, bit: int) -> tuple[np.ndarray, ...]:
    """Decision `bit` of the level's contexts: the node of each gram, the first gram and the number
    (context, then the bits so far after a one) of each node, its zeros and ones, each gram's bit."""
    number = level.keys >> (8 - bit)
    opens = np.concatenate([[True], number[1:] != number[:-1]])
    first = np.flatnonzero(opens)
    taken = (level.keys >> (7 - bit)) & 1
    total = np.add.reduceat(level.counts, first)
    ones = np.add.reduceat(level.counts * taken, first)
    context, so_far = level.keys[first] >> 8, (level.keys[first] & 255) >> (8 - bit)
    return np.cumsum(opens) - 1, first, (context << 8) | (1 << bit) | so_far, total - ones, ones, taken


def _mixed(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - math.log(2)


def _weighted(
    keys: np.ndarray, counts: np.ndarray, depth: int, complete: dict[int, tuple] | None
) -> list[tuple] | np.ndarray:
    """One group of grams in order.

    Contexts of the first and the last gram may go on in other groups. Without `complete` their
    counts and the weights of their completed children are returned as rows (depth, number, zeros,
    ones, below); with it, per depth the same arrays for the whole corpus, the logarithm to base 10
    of every gram's probability is.
    """
    levels = _levels(keys, counts, depth)
    last = keys[[0, -1]] >> 8
    rows, out = [], np.zeros(len(keys))
    for bit in range(8):
        below = mix = back = None
        nodes: list[tuple] = []
        for k in range(depth, -1, -1):
            level = levels[k]
            node, first, number, zeros, ones, taken = _nodes(level, bit)
            is_open = np.zeros(len(first), dtype=bool)
            if k < depth:
                is_open = np.isin(number >> 8, last >> (8 * (depth - k)))
                child_first, child_weight, child_open = nodes[-1]
                parent = node[level.up[child_first]]
                weight = np.where(child_open, 0.0, child_weight)
                below = np.bincount(parent, weight, len(first))
            if k < depth and complete is not None and is_open.any():
                at = np.searchsorted(complete[k][0], number[is_open])
                zeros, ones, below = zeros.copy(), ones.copy(), below.copy()
                for mine, whole in zip((zeros, ones, below), complete[k][1:], strict=True):
                    mine[is_open] = whole[at]
            own = _log_kt(zeros, ones)
            weight = own if k == depth else _mixed(own, below)
            if complete is None and is_open.any():
                columns = (number, zeros, ones, below)
                rows += [(k, *x) for x in zip(*(c[is_open].tolist() for c in columns), strict=True)]
            nodes.append((first, weight, is_open))
            if complete is not None:
                estimate = (np.where(taken == 1, ones[node], zeros[node]) + 0.5) / (
                    zeros[node] + ones[node] + 1
                )
                if k == depth:
                    mix, back = estimate, np.arange(len(keys))
                else:
                    back = level.up[back]
                    share = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))[node]
                    mix = share[back] * estimate[back] + (1 - share[back]) * mix
        if complete is not None:
            out += np.log10(mix)
    return rows if complete is None else out


def _completed(rows: list[tuple]) -> dict[int, tuple]:
    """Per depth (numbers in order, zeros, ones, below) of the open nodes, from the sums of their
    parts (depth, number, zeros, ones, below); open children are added to their parents' `below`."""
    out: dict[int, tuple] = {}
    above = (np.zeros(0, dtype=np.int64), np.zeros(0))
    for k in sorted({r[0] for r in rows}, reverse=True):
        own = sorted(r[1:] for r in rows if r[0] == k)
        number = np.array([r[0] for r in own], dtype=np.int64)
        zeros, ones, below = (np.array([r[i] for r in own]) for i in (1, 2, 3))
        np.add.at(below, np.searchsorted(number, above[0]), above[1])
        out[k] = (number, zeros, ones, below)
        parent = (number >> 16 << 8) | (number & 255)
        above = (parent, _mixed(_log_kt(zeros, ones), below))
    return out


def model(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, seen, log10) for all grams of `counted`: the logarithm of the probability of the next
    byte in its context. Stored. Runs jobs.

    The grams are range-partitioned by context into groups of about GROUP_GRAMS, so a group holds
    whole subtrees but for the contexts of its first and last gram. Those, 255 decisions at each
    depth at most, are summed over the groups and completed on the driver: their number grows with
    the number of groups, about one in 200 of the grams.
    """
    table = counts.filter("gram is not null").select("gram", "learned", "seen")
    groups = max(1, math.ceil(table.count() / GROUP_GRAMS))
    table = table.repartitionByRange(groups, F.shiftright("gram", 8))
    table = staged(table.withColumn("group", F.spark_partition_id()), "grams")

    def arrays(group: pa.Table) -> tuple[np.ndarray, ...]:
        group = group.sort_by("gram")
        return tuple(group[c].to_numpy() for c in ("gram", "learned", "seen"))

    names = ["depth", "number", "zeros", "ones", "below"]
    types = [pa.int32(), pa.int64(), *[pa.float64()] * 3]

    def borders(group: pa.Table) -> pa.Table:
        keys, learned, _ = arrays(group)
        rows = _weighted(keys, learned, depth, None)
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "depth int, number long, zeros double, ones double, below double"
    rows = table.groupBy("group").applyInArrow(borders, schema).groupBy("depth", "number")
    rows = rows.agg(*[F.sum(c).alias(c) for c in names[2:]])
    complete = _completed([tuple(r) for r in rows.collect()])

    def probabilities(group: pa.Table) -> pa.Table:
        keys, learned, seen = arrays(group)
        found = _weighted(keys, learned, depth, complete)
        return pa.table([keys, seen, found], ["gram", "seen", "log10"])

    found = table.groupBy("group").applyInArrow(probabilities, "gram long, seen long, log10 double")
    return staged(found, "probabilities")


# -- scores ----------------------------------------------------------------------------------------


class Lookup:
    """Places of 64-bit numbers in an array, by a table with open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, dtype=np.int64)
        self.at = np.full(1 << self.bits, -1, dtype=np.int32)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            here = slot[waiting]
            free = self.keys[here] == _EMPTY
            self.keys[here[free]] = keys[waiting[free]]
            placed = self.keys[here] == keys[waiting]
            self.at[here[placed]] = waiting[placed]
            waiting = waiting[~placed]
            slot[waiting] = (slot[waiting] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 where it is absent."""
        slot = self._slot(keys)
        found, out = self.keys[slot], self.at[slot]
        waiting = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(waiting):
            slot[waiting] = (slot[waiting] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[waiting]]
            out[waiting] = self.at[slot[waiting]]
            waiting = waiting[(found != keys[waiting]) & (found != _EMPTY)]
        return out


#: A row's number, its numbers under the frequent grams and words, and its others.
_SCORES = (
    "_row long, _tokens long, _known long, _base double, _score double, _grams array<long>,"
    " _gram_n array<long>, _words array<binary>, _word_n array<long>"
)


class _Known(dict):
    """Places of words in a list; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return self.get(_short(word), -1) if len(word) > LONG_WORD else -1


def _split(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows seen most often, `most` at most, and all others: cut between two classes of `seen`,
    eight to a doubling."""
    of = F.floor(8 * F.log2(F.greatest("seen", F.lit(1)))).cast("int")
    classes = counts.groupBy(of.alias("class")).agg(F.count("*").alias("n")).collect()
    least, total = 1 << 10, 0
    for r in sorted(classes, key=lambda r: -r["class"]):
        total += r["n"]
        if total > most:
            break
        least = r["class"]
    return counts.filter(of >= least), counts.filter(of < least)


def scored(
    docs: DataFrame,
    learns: Column,
    text_col: str = "text",
    depth: int = DEPTH,
) -> DataFrame:
    """`docs` without their text, with n_tokens, n_known, train_tokens, base_score and score in
    place of any columns of these names. Runs jobs; each learns from the rows that `learns` picks.

    Tokens are `words` and one end per text, in lower case. n_known: tokens that the texts to learn
    from have; train_tokens: the number of tokens these have; base_score: the sum over tokens of
    log10((c + 0.1) / (N + 0.1 * (V + 1))) by their counts there; score: log10 of the text's
    probability under the weighted tree.

    A null text is empty, and an empty text is one end. A null in `learns` is false. Without texts
    to learn from every byte has eight even decisions. Repeated rows and rows without id are scored
    like others. `depth` is DEEPEST at most.
    """
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"a context has 0 to {DEEPEST} bytes")
    out = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), *out)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    counts = counted(docs.select(text, F.coalesce(learns, F.lit(False)).alias("learns")), depth)
    tokens = counts.filter("word is not null").select("word", "learned", "seen")
    train, distinct = tokens.agg(F.sum("learned"), F.count_if(F.col("learned") > 0)).first()
    train = train or 0
    every = math.log10(train + SMOOTH * (distinct + 1))
    head, tail = _split(model(counts, depth), HEAD_GRAMS)
    head_words, tail_words = _split(tokens, HEAD_WORDS)
    known = head.select("gram", "log10").toArrow()
    vocabulary = head_words.select("word", "learned").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        (
            known["gram"].to_numpy(),
            known["log10"].to_numpy(),
            vocabulary["word"].to_pylist(),
            vocabulary["learned"].to_numpy(),
        )
    )
    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = StructType(kept.schema.fields + StructType.fromDDL(_SCORES).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, log10, names, learned = shared.value
        places, words_at = Lookup(keys), _Known(zip(names, range(len(names)), strict=True))
        log10, learned = np.append(log10, 0.0), np.append(learned, 0)  # the last for index -1
        weight = np.where(np.arange(len(learned)) < len(names), np.log10(learned + SMOOTH), 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in parts(batch, len(rest), SLICE_BYTES):
                texts = [words(t) for t in part.column(len(rest)).to_pylist()]
                n = len(texts)
                score, rare = np.zeros(n), []
                for found, of in windows(texts, depth):
                    at = places.find(found)
                    score += np.bincount(of, log10[at], n)
                    absent = at < 0
                    rare.append((of[absent], found[absent]))
                for t in texts:
                    t.append(_END)
                size = np.array([len(t) for t in texts])
                at = map(words_at.__getitem__, itertools.chain.from_iterable(texts))
                at = np.fromiter(at, np.int64, size.sum())
                of = np.repeat(np.arange(n), size)
                base, n_known = np.bincount(of, weight[at], n), np.bincount(of, learned[at] > 0, n)
                absent = np.flatnonzero(at < 0)
                flat = [w for t in texts for w in t] if len(absent) else []
                rare_words = [Counter() for _ in texts]
                for i in absent.tolist():
                    rare_words[of[i]][_short(flat[i])] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i) for i in range(len(rest))],
                        pa.array(np.arange(row, row + n)),
                        pa.array(size),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(base),
                        pa.array(score),
                        *_lists(rare, n),
                        pa.array([list(c) for c in rare_words], pa.list_(pa.binary())),
                        pa.array([list(c.values()) for c in rare_words], pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )
                row += n

    own = docs.select(*[F.col(f"`{c}`") for c in rest], text)
    own = staged(own.mapInArrow(run, schema), "scores")

    def exploded(names: str, counts: str, name: str) -> DataFrame:
        pairs = F.arrays_zip(F.col(names).alias(name), F.col(counts).alias("n"))
        return own.filter(F.size(names) > 0).select("_row", F.explode(pairs).alias("x")).select("_row", "x.*")

    grams = exploded("_grams", "_gram_n", "gram").join(tail, "gram")
    grams = grams.groupBy("_row").agg(F.sum(F.col("n") * F.col("log10")).alias("_more"))
    others = exploded("_words", "_word_n", "word").join(tail_words, "word")
    others = others.groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.col("learned") + SMOOTH)).alias("_more_base"),
        F.sum(F.expr("if(learned > 0, n, 0)")).alias("_more_known"),
    )
    out = own.join(grams, "_row", "left").join(others, "_row", "left")
    return out.select(
        *[F.col(f"`{c}`") for c in rest],
        F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_more_known", F.lit(0))).alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more_base", F.lit(0.0)) - F.col("_tokens") * every).alias("base_score"),
        (F.col("_score") + F.coalesce("_more", F.lit(0.0))).alias("score"),
    )


def _lists(rare: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[pa.Array, pa.Array]:
    """Per text its distinct grams and their counts."""
    of, found = (np.concatenate([r[i] for r in rare]) for i in (0, 1))
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    opens = np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] != found[:-1])])[: len(of)]
    first = np.flatnonzero(opens)
    count = np.diff(np.append(first, len(of)))
    offsets = pa.array(np.searchsorted(of[first], np.arange(n + 1)), pa.int32())
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (found[first], count))
