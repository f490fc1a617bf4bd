"""Language identification by character language models with interpolated Kneser-Ney smoothing.

One model of order 4 per language is counted over all training texts. Text is reduced to runs of
letters in lower case; a letter is one of 256 symbols (the Latin ones keep their own, others are
hashed), so four symbols are a 32-bit key. The counts of four symbols are summed in Spark and all of
them make up a language's model. Lower orders count in how many different contexts they occur, also
in Spark, and each order has the discount that its own counts of one and two call for.

The models lie side by side in sorted arrays of keys with one column of log probabilities per
language. A text is scored in whole: its score for a language is the mean log probability of its
symbols, and the language with the lowest cross-entropy wins.

Calibration uses all labelled texts, each as it is and cut to shorter lengths. They are dealt to FOLDS
parts by a hash of the id; each part is scored by models of the others, so that no text is scored by
counts that it is in. The scores stay in Spark, which counts them in narrow bins. The
temperature that turns mean log probabilities into the winner's probability maximises its
likelihood, and a text is rejected when its cross-entropy lies further above its language's than
that of all but `reject_share` of the calibration texts of its length, in deviations that allow
for the text's length. That tail is carried on from quantiles with several texts beyond them, and
only texts predicted as labelled count, so that a few odd texts do not move it. Stretches in another
of the labelled languages are measured by that language, so texts in two of them stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from levylens.llm._words import parts
from levylens.sources.sinks import staged

SYMBOLS = 256
GAP, EDGE = 0, 1  # anything between letters; the start of a text
FOLDS = 4  # parts of the texts, each scored by models of the others
TEMPERATURES = 2.0 ** np.arange(-3, 11)
BIN = 0.01  # of scores' logarithms and excesses, when they are counted; of cross-entropies a tenth
REJECT_SHARE = 0.001
SIZES = 16 * 3 ** np.arange(6)  # lengths that rejection is calibrated for; between them it is interpolated
ENOUGH = 300  # with fewer calibration texts of a language and length those of all languages count
ENOUGH_WHOLE = 50
PIECE = 64  # symbols of a stretch that is in one language
BEYOND = 5  # calibration texts beyond the quantiles that the tail is carried on from
PART_CHARS = 1 << 19
PART_BYTES = 1 << 22
SCORED_BYTES = 1 << 20  # of texts that are scored at shorter lengths too
_DISCOUNT = 0.75  # where an order has no counts of one or two to tell
_DOUBLES = pa.list_(pa.float64())


def _symbol_table(known: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006
    """The symbol of every code point."""
    if not known:
        table = np.zeros(0x110000, dtype=np.uint8)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = char.lower()
                code = ord(low) if len(low) == 1 else point
                own = code - 95 if code < 128 else code - 190 if 223 <= code < 256 else 0
                table[point] = own or 70 + code * 2654435761 % (1 << 32) % (SYMBOLS - 70)
        known.append(table)
    return known[0]


def letters(column: Column) -> Column:
    """Whether the text has a letter."""
    return F.coalesce(column.rlike(r"\p{L}"), F.lit(False))


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts, three edges before each, and where each text begins; the first
    gap between letters stays, further ones go."""
    points = [np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    table, edge = _symbol_table(), np.array([EDGE, EDGE, EDGE], dtype=np.uint8)
    parts, starts, at = [], [], 0
    for p in points:
        s = table[p]
        s = s[(s != GAP) | np.concatenate([[False], s[:-1] != GAP])]
        starts.append(at)
        parts += [edge, s]
        at += 3 + len(s)
    return np.concatenate([*parts, edge[:0]]), np.array([*starts, at], dtype=np.int64)


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The key of the four symbols that end at each place from the fourth on."""
    s = symbols.astype(np.uint32)
    return (s[:-3] << 24) | (s[1:-2] << 16) | (s[2:-1] << 8) | s[3:]


def _parts(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(indices, texts) of up to PART_CHARS characters at a time. Longer texts come in pieces, each
    of which starts at an edge."""
    index, part, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), PART_CHARS):
            piece = text[at : at + PART_CHARS]
            if part and size + len(piece) > PART_CHARS:
                yield index, part
                index, part, size = [], [], 0
            index.append(i)
            part.append(piece)
            size += len(piece)
    if part:
        yield index, part


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often four symbols occur in the texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, 1, PART_BYTES)):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                found = []
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for _, part in _parts(own):
                    symbols, _ = _symbols(part)
                    keys = _keys(symbols)
                    found.append(np.unique(keys[symbols[3:] != EDGE], return_counts=True))
                keys = np.concatenate([k for k, _ in found])
                sums = np.concatenate([n for _, n in found])
                keys, where = np.unique(keys, return_inverse=True)
                sums = np.bincount(where, weights=sums, minlength=len(keys)).astype(np.int64)
                columns = [pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64))]
                names = ["lang", "gram", "n"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums)], names)

    own = docs.select("lang", "text")
    each = own.mapInArrow(run, "lang string, gram long, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def orders(grams: DataFrame) -> DataFrame:
    """(lang, level, gram, n) of all orders, of the counts of four symbols: how often these occur, and
    in how many different contexts three, two and one do."""
    out = level = grams.select("lang", F.lit(4).alias("level"), "gram", "n")
    for order in (3, 2, 1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")
        level = level.groupBy("lang", shorter).agg(F.count("*").alias("n"))
        level = level.select("lang", F.lit(order).alias("level"), "gram", "n")
        out = out.unionByName(level)
    return out


def _discount(n: np.ndarray) -> float:
    """What absolute discounting takes off each count, by the counts of one and two."""
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return once / (once + 2 * twice) if once and twice else _DISCOUNT


@dataclass
class Model:
    """Log probabilities of all languages: dense for one and two symbols, in sorted arrays of keys
    for three and four, and the weights with which a longer context falls back on a shorter one."""

    langs: list[str]
    one: np.ndarray
    two: np.ndarray
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # variance between texts, variance of one symbol
    limit: np.ndarray | None = None  # per language and length of SIZES

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Per key of four symbols the log probability of the last one, a column per language."""
        return self._of_order(4, keys)

    def _of_order(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 2:
            return self.two[keys & np.uint32(0xFFFF)]
        if order == 3:
            keys = keys & np.uint32(0xFFFFFF)
        known = self.keys[order]
        if not len(known):
            return self._of_order(order - 1, keys)
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        out = self.logs[order][at]
        missing = np.flatnonzero(known[at] != keys)
        if len(missing):
            rest, known = keys[missing], self.contexts[order]
            lower = self._of_order(order - 1, rest)
            at = np.searchsorted(known, rest >> np.uint32(8))
            at[at == len(known)] = 0
            same = known[at] == rest >> np.uint32(8)
            out[missing] = lower + np.where(same[:, None], self.weights[order][at], 0)
        return out

    def scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text the mean log probability by language, the number of symbols, and, with each
        stretch of PIECE symbols in the language that fits it best, the mean log probability and
        each language's share."""
        sums = np.zeros((len(texts), len(self.langs)))
        sizes = np.zeros(len(texts), dtype=np.int64)
        fits, shares = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for index, part in _parts(texts):
            symbols, starts = _symbols(part)
            n = np.diff(starts) - 3
            np.add.at(sizes, index, n)
            if n.any():
                logs = self.log_probabilities(_keys(symbols))
                pieces = np.maximum(n // PIECE, 1) * (n > 0)  # the last one of a text takes the rest
                owner = np.repeat(np.arange(len(n)), pieces)
                place = np.arange(len(owner)) - np.repeat(pieces.cumsum() - pieces, pieces)
                first = starts[owner] + place * PIECE
                last = np.where(place == pieces[owner] - 1, starts[owner] + n[owner], first + PIECE)
                cuts = np.stack([first, last], axis=1).ravel()
                cuts = cuts[:-1] if cuts[-1] == len(logs) else cuts
                total = np.add.reduceat(logs, cuts, axis=0, dtype=np.float64)[::2]
                owner = np.array(index)[owner]
                np.add.at(sums, owner, total)
                np.add.at(fits, owner, total.max(axis=1))
                np.add.at(shares, (owner, total.argmax(axis=1)), last - first)
        each = np.maximum(sizes, 1)
        return sums / each[:, None], sizes, fits / each, shares / each[:, None]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the best language's index, its probability, whether it is rejected."""
        means, n, fits, shares = self.scored(texts)
        best = means.argmax(axis=1)
        odds = np.exp((means - means.max(axis=1, keepdims=True)) * self.temperature)
        score = 1 / odds.sum(axis=1)
        if self.mean is None:
            return best, score, n < 1
        return best, score, (self.excess(fits, shares, n, best) > self.limits(n, best)) | (n < 1)

    def limits(self, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The excess from which texts of so many symbols are rejected."""
        at = np.interp(np.log(np.maximum(n, 1)), np.log(SIZES), np.arange(len(SIZES)))
        low = np.minimum(at.astype(int), len(SIZES) - 2)
        a, b = self.limit[best, low], self.limit[best, low + 1]
        return a + (b - a) * (at - low)

    def excess(
        self, fits: np.ndarray, shares: np.ndarray, n: np.ndarray, best: np.ndarray
    ) -> np.ndarray:
        """How far a text's cross-entropy lies above its languages', in standard deviations."""
        between, within = self.spread[best].T
        return (-fits - shares @ self.mean) / np.sqrt(between + within / np.maximum(n, 1))


def fitted(grams: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]) -> Model:
    """The models of {lang: {order: (sorted keys, counts)}} by interpolated Kneser-Ney."""
    langs = sorted(grams)
    tables = {3: [], 4: []}
    ones, twos = [], []
    for lang in langs:
        levels = {k: (x.astype(np.uint32), n.astype(np.float64)) for k, (x, n) in grams[lang].items()}
        one = np.full(SYMBOLS, 1 / SYMBOLS)
        known, n1 = levels[1]
        total = n1.sum()
        discount = _discount(n1)
        one *= discount * len(known) / total
        one[known] += (n1 - discount) / total
        ones.append(np.log(one))
        lower = {1: (np.arange(SYMBOLS, dtype=np.uint32), one)}
        weight_of = {}
        for order in (2, 3, 4):
            known, n = levels[order]
            context, where, kinds = np.unique(
                known >> np.uint32(8), return_inverse=True, return_counts=True
            )
            total = np.bincount(where, weights=n)
            discount = _discount(n)
            weight = discount * kinds / total
            shorter = known & np.uint32((1 << 8 * (order - 1)) - 1)
            before = lower[order - 1]
            p = before[1][np.searchsorted(before[0], shorter)]
            p = (n - discount) / total[where] + weight[where] * p
            lower[order] = known, p
            weight_of[order] = context, weight
        two = np.tile(one, SYMBOLS).reshape(SYMBOLS, SYMBOLS)
        two[weight_of[2][0]] *= weight_of[2][1][:, None]
        two = two.reshape(-1)
        two[lower[2][0]] = lower[2][1]
        twos.append(np.log(two))
        for order in (3, 4):
            tables[order].append((*lower[order], *weight_of[order]))

    model = Model(
        langs,
        np.stack(ones, axis=1).astype(np.float32),
        np.stack(twos, axis=1).astype(np.float32),
        {}, {}, {}, {},
    )
    for order in (3, 4):
        contexts = np.unique(np.concatenate([t[2] for t in tables[order]]))
        weights = np.zeros((len(contexts), len(langs)), dtype=np.float32)
        for i, t in enumerate(tables[order]):
            weights[np.searchsorted(contexts, t[2]), i] = np.log(t[3])
        model.contexts[order], model.weights[order] = contexts, weights
        keys = np.unique(np.concatenate([t[0] for t in tables[order]]))
        # a key that only some languages know has the others' probability by falling back
        model.keys[order] = keys[:0]
        at = np.searchsorted(contexts, keys >> np.uint32(8))
        logs = model._of_order(order, keys) + weights[at]
        for i, t in enumerate(tables[order]):
            logs[np.searchsorted(keys, t[0]), i] = np.log(t[1])
        model.keys[order], model.logs[order] = keys, logs.astype(np.float32)
    return model


def calibration(rows: DataFrame, size: int, reject_share: float) -> dict:
    """The temperature and, for so many languages, means, spreads and rejection limits by the rows of
    `_scores`; nothing without any. Runs jobs; the driver receives counts of bins. A language without
    a text that is predicted as labelled gets the middle of the others' means and spreads."""
    likelihood = [F.sum(F.col("likelihood")[k]) for k in range(len(TEMPERATURES))]
    sums = rows.select(*likelihood).first()
    if sums[0] is None:
        return {}
    out = {"temperature": float(TEMPERATURES[np.argmax(np.array(sums, dtype=float))])}
    good, log_n = rows.filter("lang is not null"), F.log("n")
    mean, spread = np.full(size, np.nan), np.full((size, 2), np.nan)
    for (i,), found in _counted(good, ["lang"], F.col("h"), BIN / 10, "n").items():
        mean[i] = _middle(*found)
    if np.isnan(mean).all():
        limit = np.full((size, len(SIZES)), math.inf)
        return out | {"mean": np.zeros(size), "spread": np.ones((size, 2)), "limit": limit}

    def of_language(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(x)) for x in values])[F.col("lang")]

    middle = np.full(size, np.nan)
    for (i,), found in _counted(good, ["lang"], log_n, BIN).items():
        middle[i] = _quantile(*found, 0.5)
    off = F.log(F.greatest((F.col("h") - of_language(mean)) ** 2, F.lit(1e-12)))
    long = good.filter(log_n >= of_language(middle) - BIN / 2)
    for (i,), found in _counted(long, ["lang"], off, BIN).items():
        spread[i, 0] = max(math.exp(_quantile(*found, 0.5)) * 2.2, 1e-3)  # median of chi2(1) is 0.455
    for (i,), found in _counted(good, ["lang"], off + log_n, BIN).items():
        spread[i, 1] = max(math.exp(_quantile(*found, 0.5)) * 2.2, 0.1)
    mean = np.where(np.isnan(mean), np.nanmedian(mean), mean)
    spread = np.where(np.isnan(spread), np.nanmedian(spread, axis=0), spread)

    expected = sum((F.col("shares")[i] * float(x) for i, x in enumerate(mean)), F.lit(0.0))
    deviation = F.sqrt(of_language(spread[:, 0]) + of_language(spread[:, 1]) / F.col("n"))
    last, step = len(SIZES) - 1, math.log(SIZES[1] / SIZES[0])
    nearest = F.round((log_n - math.log(SIZES[0])) / step).cast("int")
    nearest = F.least(F.greatest(nearest, F.lit(0)), F.lit(last)).alias("size")
    excess = ((-F.col("fits") - expected) / deviation).alias("excess")
    flat = good.select("lang", nearest, "whole", excess)
    counts = _counted(flat, ["lang", "size", "whole"], F.col("excess"), BIN)

    def tail(chosen: list[tuple[np.ndarray, np.ndarray]], least: int) -> float:
        if not chosen or sum(n.sum() for _, n in chosen) < least:
            return math.nan
        values, n = (np.concatenate(x) for x in zip(*chosen, strict=True))
        return _tail(values, reject_share, n)

    limit = np.full((size, len(SIZES)), np.nan)
    for c in range(len(SIZES)):
        every = tail([x for (_, k, _), x in counts.items() if k == c], 1)
        for i in range(size):
            own = tail([x for (lang, k, _), x in counts.items() if (lang, k) == (i, c)], ENOUGH)
            limit[i, c] = every if math.isnan(own) else own
        # short texts may differ from parts of long ones
        uncut = tail([x for (_, k, whole), x in counts.items() if k == c and whole], ENOUGH_WHOLE)
        limit[:, c] = np.fmax(limit[:, c], uncut)
    for row in limit:
        known = np.flatnonzero(~np.isnan(row))
        row[:] = np.interp(np.arange(len(row)), known, row[known])
    return out | {"mean": mean, "spread": spread, "limit": limit}


def _counted(
    rows: DataFrame, by: list[str], value: Column, width: float, weight: str = "1"
) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Per key the values, rounded to a width and in order, and the sums of their weights."""
    rounded = F.round(value / width).cast("long").alias("bin")
    found: dict[tuple, list[tuple[int, int]]] = {}
    for *key, b, n in rows.groupBy(*by, rounded).agg(F.sum(F.expr(weight))).collect():
        found.setdefault(tuple(key), []).append((b, n))
    out = {}
    for key, pairs in found.items():
        bins, n = np.array(sorted(pairs), dtype=np.int64).T
        out[key] = bins * width, n
    return out


def _quantile(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    """The quantile of values that occur so often, interpolated between two of them."""
    order = values.argsort()
    below, at = counts[order].cumsum(), share * (counts.sum() - 1)
    low, high = values[order[np.searchsorted(below, [math.floor(at), math.ceil(at)], side="right")]]
    return float(low + (high - low) * (at - math.floor(at)))


def _middle(values: np.ndarray, weights: np.ndarray) -> float:
    """The weighted median."""
    order = values.argsort()
    sums = weights[order].cumsum()
    return float(values[order[np.searchsorted(sums, sums[-1] / 2)]])


def _tail(values: np.ndarray, share: float, counts: np.ndarray | None = None) -> float:
    """What all but `share` of the values lie below, by an exponential tail through two quantiles
    with at least BEYOND values above them (fewer only if there are less than ten times as many)."""
    counts = np.ones(len(values), dtype=np.int64) if counts is None else counts
    near = min(max(BEYOND / counts.sum(), 0.02), 0.1)
    far = min(10 * near, 0.5)
    a, b = _quantile(values, counts, 1 - far), _quantile(values, counts, 1 - near)
    return float(b + (b - a) * max(math.log(near / share), 0) / math.log(far / near))


def _cuts(text: str) -> list[str]:
    """The text, and the middle of it at each shorter length of SIZES."""
    shorter = [int(s) for s in SIZES if s < len(text)]
    return [text, *(text[(len(text) - s) // 2 :][:s] for s in shorter)]


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    reject_share: float = REJECT_SHARE,
) -> Model | None:
    """The model of the labelled rows of `docs`; None without any. Runs jobs.

    The model counts all labelled texts, and all of them calibrate: they are dealt to FOLDS parts by a
    hash of the id, rows without id alike, and each part is scored by a model of the others. A text
    whose language is in none of the other parts is not scored. Repeated rows count as often as they
    occur. The driver receives the different grams of each language, for one model at a time, and
    counts of binned scores.
    """
    own = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("calibration")), F.lit(FOLDS)).alias("fold"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    ).filter(F.col("lang").isNotNull() & letters(F.col("text")))
    dealt = own.select(F.concat(F.col("fold").cast("string"), "lang").alias("lang"), "text")
    grams = counts(dealt).select(
        F.substring("lang", 1, 1).cast("int").alias("fold"),
        F.expr("substring(lang, 2)").alias("lang"),
        "gram",
        "n",
    )
    every = staged(grams, "grams")
    names = sorted(r.lang for r in every.select("lang").distinct().collect())
    if not names:
        return None

    def summed(chosen: DataFrame) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
        return _gathered(staged(chosen.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"))

    scores = None
    for fold in range(FOLDS):
        gathered = summed(every.filter(F.col("fold") != fold))
        if gathered:
            found = _scores(own.filter(F.col("fold") == fold), fitted(gathered), names)
            scores = found if scores is None else scores.unionByName(found)
    known = {} if scores is None else calibration(scores, len(names), reject_share)
    return replace(fitted(summed(every)), **known)


def _scores(texts: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """(lang, whole, n, h, fits, shares, likelihood), stored: a row for each of the (lang, text), and
    for each cut of it, that is predicted as labelled: the language's place in `names`, whether it is
    uncut, its number of symbols, and its cross-entropy, its fit and its shares of `scored`. Rows
    without lang hold the log likelihood of all of a batch at each of TEMPERATURES."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    place = np.array([names.index(x) for x in model.langs])
    schema = (
        "lang int, whole boolean, n long, h double, fits double, shares array<double>,"
        " likelihood array<double>"
    )
    types = [pa.int32(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), _DOUBLES, _DOUBLES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        index = {x: i for i, x in enumerate(model.langs)}
        for batch in (p for b in batches for p in parts(b, 1, SCORED_BYTES)):
            langs = [index.get(x) for x in batch.column(0).to_pylist()]
            pairs = zip(langs, batch.column(1).to_pylist(), strict=True)
            cuts = [(i, k == 0, cut) for i, t in pairs if i is not None for k, cut in enumerate(_cuts(t))]
            means, n, fits, shares = model.scored([cut for _, _, cut in cuts])
            use = n > 0
            if not use.any():
                continue
            own, whole = (np.array([c[k] for c in cuts])[use] for k in (0, 1))
            means, n, fits, shares = (x[use] for x in (means, n, fits, shares))
            gap, at = means - means.max(axis=1, keepdims=True), np.arange(len(n))
            likelihood = [
                float((gap[at, own] * t - np.log(np.exp(gap * t).sum(axis=1))).sum()) for t in TEMPERATURES
            ]
            good = np.flatnonzero(means.argmax(axis=1) == own)
            named = np.zeros((len(good), len(names)))
            named[:, place] = shares[good]
            h = -means[good, own[good]]
            columns = [place[own[good]], whole[good], n[good], h, fits[good], named]
            columns = [[*x.tolist(), None] for x in columns] + [[None] * len(good) + [likelihood]]
            arrays = [pa.array(x, t) for x, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "whole", "n", "h", "fits", "shares", "likelihood"])

    out = staged(texts.select("lang", "text").mapInArrow(run, schema), "scores")
    sent.destroy()
    return out


def _gathered(grams: DataFrame) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """All orders of the counts of four symbols, by language and order."""
    found = orders(grams).orderBy("lang", "level", "gram").toArrow().combine_chunks()
    if not found.num_rows:
        return {}
    langs = found["lang"].chunk(0).dictionary_encode()
    code, level = langs.indices.to_numpy(), found["level"].to_numpy()
    gram, n = found["gram"].to_numpy().astype(np.uint32), found["n"].to_numpy()
    opens = np.flatnonzero((code[1:] != code[:-1]) | (level[1:] != level[:-1])) + 1
    out: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for a, b in zip([0, *opens.tolist()], [*opens.tolist(), len(code)], strict=True):
        name = langs.dictionary[int(code[a])].as_py()
        out.setdefault(name, {})[int(level[a])] = gram[a:b], n[a:b]
    return out


def identified(
    docs: DataFrame,
    model: Model | None,
    text_col: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """`docs` with the columns lang_pred, score and rejected (replacing any of these names), the
    text in front of them.

    Only the text is looked at, all of it. lang_pred is `und` with score 0 where the text is null
    or has no letter, or there is no model; such rows are rejected, and so are texts unlike those
    of all languages. Repeated rows stay and have the same result. With `keep_text` false the text
    column is left out.
    """
    new = ("lang_pred", "score", "rejected")
    others = [c for c in docs.columns if c.lower() not in new and c != text_col]
    kept = [*others, text_col] if keep_text and text_col.lower() not in new else others
    text = F.col(f"`{text_col}`").cast("string")
    flat = docs.select(*[F.col(f"`{c}`") for c in others], text, letters(text))
    flat = flat.toDF(*[str(i) for i in range(len(others) + 2)])  # names may clash but for case
    schema = StructType(
        [
            *flat.schema.fields[: len(kept)],
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
            StructField("rejected", BooleanType()),
        ]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        place = len(others)
        for batch in (p for b in batches for p in parts(b, place, PART_BYTES)):
            good = np.array(batch.column(place + 1).to_pylist(), dtype=bool)
            good &= model is not None
            lang = np.full(len(good), "und", dtype=object)
            score, rejected = np.zeros(len(good)), np.ones(len(good), dtype=bool)
            at = np.flatnonzero(good)
            if len(at):
                texts = batch.column(place).take(pa.array(at)).to_pylist()
                best, score[at], rejected[at] = model.judged(texts)
                lang[at] = np.array(model.langs, dtype=object)[best]
            columns = [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
            columns = [*batch.columns[: len(kept)], *columns]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return flat.mapInArrow(run, schema).toDF(*kept, *new)
