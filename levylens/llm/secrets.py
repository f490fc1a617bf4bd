"""Secrets in text: fixed patterns, and a character convolutional network over all other candidates.

Base findings are assignments to a name like `password`, access keys and long hexadecimal runs.
Every other run of 12 or more letters, digits and + / _ = - . that touches no base finding is a
candidate, words among them. Each is judged by a small convolutional network in numpy over its
characters and those around it; long candidates are read in overlapping windows of which the
highest score counts.

The network is trained on a bounded sample of labelled findings. Secrets are the base findings and
random keys of several alphabets put in the place of words; harmless are the documents' own
candidates, but for those that networks trained on the other half of the examples find like keys,
and identifiers, dates, paths and versions made of their words. In half of the examples the
surroundings are blanked, so that a known name before it is not all it looks at.

Thresholds are set on the documents, all of them: every candidate of theirs, and keys planted in
the place of one in PLANTED of their long words and found by `scan` like any other, are scored and
counted by class of alphabet and length. A class gets the highest threshold that finds the share
`recall` of its planted keys; where more than `most_false` of its own candidates reach that and are
no secrets, or more than MOST_MADE of the identifiers, dates and paths planted in the same way, the
threshold is raised until they do not, and the class does not claim the recall (`claims`). How many
of the own candidates are secrets is estimated, as they score like the planted keys: findings are
not bounded in number, however many of a class are secrets or however few candidates it has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from levylens.llm._words import buffers, parts

KINDS = ("assign", "access", "hex")  # in the order in which findings at one place are listed
MODEL_KIND = "model"
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
PART_BYTES = 1 << 20
SHORTEST = 12
BEFORE, INSIDE, AFTER = 16, 32, 8
STEP = INSIDE - 8  # between the windows of a long candidate
WIDTH = BEFORE + INSIDE + AFTER
TRAINING_DOCS = 20_000  # expected number of documents that examples are taken from
EXAMPLES = 3_000  # of each label
RECALL, MOST_FALSE, MOST_MADE = 0.99, 1e-4, 0.01
PLANTED = 8  # one in so many long words is replaced by a key when thresholds are set
ENOUGH = 50  # keys that a class needs for a threshold of its own
MOST_KEYS = 0.9  # own candidates that score like so many of the keys are not taken to be harmless
TELLING = 0.1  # share of the keys above a score from which it tells how many secrets there are
LENGTHS = (12, 16, 20, 24, 32)  # where the classes of length begin
BIN = 0.05  # of a score, when scores are counted
LOWEST, HIGHEST = -40.0, 40.0
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")] = True
_DIGIT_OR_HEX = np.zeros(256, dtype=bool)
_DIGIT_OR_HEX[list(b"0123456789abcdef")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


def _symbols() -> np.ndarray:
    """0 is nothing, 1 any other byte; letters, digits and the common signs have their own."""
    table = np.ones(256, dtype=np.uint8)
    own = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.:\"' "
    table[list(own)] = np.arange(2, 2 + len(own))
    return table


SYMBOLS = _symbols()
N_SYMBOLS = int(SYMBOLS.max()) + 1


def base_findings(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, leftmost and not overlapping within each kind."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def _hits(data: bytes, names: tuple[bytes, ...]) -> list[int]:
    out = []
    for name in names:
        at = data.find(name)
        while at >= 0:
            out.append(at)
            at = data.find(name, at + 1)
    return out


def _runs(mask: np.ndarray, cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of at least `least` marked bytes; none crosses a cut."""
    if not len(mask):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.ones(len(mask), dtype=bool)
    edge[1:] = mask[1:] != mask[:-1]
    edge[cuts[cuts < len(mask)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(mask))
    good = (end - start >= least) & mask[start]
    return start[good], end[good]


def _touches(spans: list[tuple[int, int, str]], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b, _ in spans)


def scan(
    raw: np.ndarray, offsets: np.ndarray
) -> tuple[dict[int, list[tuple[int, int, str]]], list[tuple[int, int, int]]]:
    """Base findings per text, and further candidates (text, start, end), all in bytes of the text.

    Texts without a name, an access key's beginning or a long run are not looked at twice. Dots at
    the ends of a run belong to the sentence.
    """
    data = raw.tobytes()
    has = np.zeros(len(offsets), dtype=bool)
    for hits in (_hits(data.lower(), _NAMES), _hits(data, (b"AKIA",))):
        has[np.searchsorted(offsets, hits, side="right") - 1] = True
    start, end = _runs(_TOKEN[raw], offsets, SHORTEST)
    for dotted in (start, end):
        step = 1 if dotted is start else -1
        at = dotted if step > 0 else dotted - 1
        more = np.flatnonzero(raw[at] == ord("."))
        while len(more):
            dotted[more] += step
            inside = more[end[more] > start[more]]
            at = dotted[inside] if step > 0 else dotted[inside] - 1
            more = inside[raw[at] == ord(".")]
    long = end - start >= SHORTEST
    start, end = start[long], end[long]
    owner = np.searchsorted(offsets, start, side="right") - 1
    digit = np.concatenate([[0], np.cumsum(_DIGIT_OR_HEX[raw])])
    has[owner[digit[end] - digit[start] >= SHORTEST]] = True  # a hexadecimal run is part of such
    found: dict[int, list[tuple[int, int, str]]] = {}
    for i in np.flatnonzero(has[:-1]).tolist():
        spans = base_findings(data[offsets[i] : offsets[i + 1]])
        if spans:
            found[i] = spans
    others = []
    for i, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True):
        a, b = a - int(offsets[i]), b - int(offsets[i])
        if i not in found or not _touches(found[i], a, b):
            others.append((i, a, b))
    return found, others


#: Classes of alphabet, from the narrowest.
ALPHABETS = (b"0123456789", b"0123456789abcdef", b"0123456789ABCDEF", b"abcdefghijklmnopqrstuvwxyz")
N_CLASSES = (len(ALPHABETS) + 5) * len(LENGTHS)


def shape(token: bytes) -> int:
    """The class of a candidate, by alphabet and length. The alphabets are digits, hexadecimal
    digits, lower case, one capital before lower case, letters, upper case and digits, letters and
    digits, and anything else with or without a digit."""
    kind = next((k for k, known in enumerate(ALPHABETS) if not token.translate(None, known)), None)
    if kind is None:
        n = len(ALPHABETS)
        if token.isalpha():
            kind = n if token[1:].islower() else n + 1
        elif token.isalnum():
            kind = n + 2 if token.isupper() else n + 3
        else:
            kind = n + 4
    length = sum(len(token) >= x for x in LENGTHS[1:])
    return kind * len(LENGTHS) + length


def windows(text: bytes, start: int, end: int) -> list[np.ndarray]:
    """The network's input, (symbols, place): one window for each STEP bytes of a candidate, with
    the bytes before and after each."""
    out = []
    for a in range(start, max(end - (INSIDE - STEP), start + 1), STEP):
        b = min(a + INSIDE, end)
        row = np.zeros((2, WIDTH), dtype=np.uint8)
        for at, piece, place in (
            (BEFORE - min(BEFORE, a), text[max(0, a - BEFORE) : a], 1),
            (BEFORE, text[a:b], 2),
            (BEFORE + INSIDE, text[b : b + AFTER], 3),
        ):
            row[0, at : at + len(piece)] = SYMBOLS[np.frombuffer(piece, dtype=np.uint8)]
            row[1, at : at + len(piece)] = place
        out.append(row)
    return out


@dataclass
class Network:
    """Embedding of characters and places, convolution of five, maximum and mean over the
    candidate and maximum over its surroundings, one logit."""

    seed: int = 7
    size: int = 12
    filters: int = 24
    dtype: type = np.float32
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    #: Per class the lowest score of a finding, and whether it finds the wanted share of keys.
    thresholds: tuple[float, ...] = (math.inf,) * N_CLASSES
    claims: tuple[bool, ...] = (False,) * N_CLASSES

    def start(self) -> None:
        rng = np.random.default_rng(self.seed)
        e, f = self.size, self.filters
        self.weights = {
            "char": rng.normal(0, 0.3, (N_SYMBOLS, e)),
            "place": rng.normal(0, 0.3, (4, e)),
            "conv": rng.normal(0, math.sqrt(2 / (5 * e)), (5 * e, f)),
            "bias": np.zeros(f),
            "out": rng.normal(0, 0.1, 3 * f),
            "last": np.zeros(1),
        }
        self.weights = {k: v.astype(self.dtype) for k, v in self.weights.items()}
        self.weights["char"][0] = 0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        embedded = w["char"][x[:, 0]] + w["place"][x[:, 1]] * (x[:, 1] > 0)[..., None]
        padded = np.pad(embedded, ((0, 0), (2, 2), (0, 0)))
        columns = np.concatenate([padded[:, k : k + WIDTH] for k in range(5)], axis=2)
        active = np.maximum(columns @ w["conv"] + w["bias"], 0)
        inside, around = x[:, 1] == 2, (x[:, 1] == 1) | (x[:, 1] == 3)
        n = np.maximum(inside.sum(axis=1), 1)[:, None]
        own = np.where(inside[..., None], active, 0)
        out = np.where(around[..., None], active, 0)
        pooled = np.concatenate([own.max(axis=1), own.sum(axis=1) / n, out.max(axis=1)], axis=1)
        pooled = pooled.astype(self.dtype)
        return pooled @ w["out"] + w["last"][0], (columns, active, inside, own, out, n, pooled)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.filters
        logit, (columns, active, inside, own, out, n, pooled) = self._forward(x)
        error = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(self.dtype)
        to_pool = error[:, None] * w["out"]
        to_active = np.zeros_like(active)
        rows, channels = np.arange(len(x))[:, None], np.arange(f)[None, :]
        to_active[rows, own.argmax(axis=1), channels] += to_pool[:, :f]
        to_active += inside[..., None] * (to_pool[:, f : 2 * f] / n)[:, None, :]
        to_active[rows, out.argmax(axis=1), channels] += to_pool[:, 2 * f :]
        to_active *= active > 0
        flat, to_flat = columns.reshape(-1, columns.shape[2]), to_active.reshape(-1, f)
        back = (to_active @ w["conv"].T).reshape(len(x), WIDTH, 5, self.size)
        to_embedded = np.zeros((len(x), WIDTH + 4, self.size), dtype=self.dtype)
        for k in range(5):
            to_embedded[:, k : k + WIDTH] += back[:, :, k]
        to_embedded = to_embedded[:, 2:-2]
        to_char, to_place = np.zeros_like(w["char"]), np.zeros_like(w["place"])
        np.add.at(to_char, x[:, 0], to_embedded)
        np.add.at(to_place, x[:, 1], to_embedded)
        to_char[0] = to_place[0] = 0
        return {
            "char": to_char, "place": to_place, "conv": flat.T @ to_flat,
            "bias": to_flat.sum(axis=0), "out": pooled.T @ error, "last": error.sum(keepdims=True),
        }

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 4e-3) -> None:
        """Adam on batches of 128, half of them secrets."""
        self.start()
        rng = np.random.default_rng(self.seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        groups = [np.flatnonzero(y == label) for label in (0, 1)]
        for t in range(1, steps + 1):
            at = np.concatenate([rng.choice(g, 64) for g in groups])
            batch = x[at].copy()
            blank = rng.random(len(at)) < 0.5
            batch[blank] *= (batch[blank][:, 1:] == 2).astype(np.uint8)
            for k, g in self._gradients(batch, y[at]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                step = first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                self.weights[k] = (self.weights[k] - rate * step).astype(self.dtype)

    def scores(self, texts: list[tuple[bytes, int, int]]) -> np.ndarray:
        """The highest logit of the windows of each candidate (text, start, end)."""
        best = np.full(len(texts), -np.inf)
        for at in range(0, len(texts), 4096):
            rows, owner = [], []
            for k, candidate in enumerate(texts[at : at + 4096]):
                new = windows(*candidate)
                rows += new
                owner += [at + k] * len(new)
            np.maximum.at(best, owner, self.logits(np.stack(rows)))
        return best

    def set_thresholds(self, counts: dict[tuple[int, int], dict[int, int]], recall: float, most_false: float) -> None:
        """From counts of binned logits by (class, label), a key that was not found at all
        standing in the lowest bin; and the scale of a logistic curve through all of them (Platt). Classes with
        fewer than ENOUGH planted keys go by those of all classes, and claim nothing."""
        every: Counter = Counter()
        for (_, label), bins in counts.items():
            if label == 1:
                every.update(bins)
        thresholds, claims = [], []
        for kind in range(N_CLASSES):
            keys, own = counts.get((kind, 1), {}), counts.get((kind, 0), {})
            enough = sum(keys.values()) >= ENOUGH
            least = _highest(keys if enough else every, recall)
            made = counts.get((kind, 2), {})
            false = _lowest_but_secrets(own, keys if enough else every, most_false)
            strict = max(least, false, _lowest(made, MOST_MADE))
            thresholds.append(strict * BIN)
            claims.append(enough and strict == least)
        self.thresholds, self.claims = tuple(thresholds), tuple(claims)
        z, y, n = (np.array(x, dtype=float) for x in zip(
            *[(b * BIN, label, m) for (_, label), bins in counts.items() if label < 2 for b, m in bins.items()],
            strict=True,
        ))
        n /= np.where(y == 1, n[y == 1].sum(), n[y == 0].sum())
        a, c = 1.0, 0.0
        for _ in range(50):  # Newton steps for the two numbers of the curve
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -500, 500)))
            g = np.array([(n * (p - y) * z).sum() + 1e-2 * (a - 1), (n * (p - y)).sum() + 1e-2 * c])
            v = n * p * (1 - p)
            h = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]])
            a, c = np.array([a, c]) - np.linalg.solve(h + 1e-2 * np.eye(2), g)
        self.scale = float(a), float(c)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -500, 500)))


def _highest(bins: dict[int, int], share: float) -> int:
    """The highest bin at or above which this share of the counts lies."""
    below, total = 0, sum(bins.values())
    for b in sorted(bins):
        below += bins[b]
        if below > (1 - share) * total:
            return b
    return int(HIGHEST / BIN)


def _lowest(bins: dict[int, int], share: float) -> int:
    """The lowest bin such that no more than this share of the counts, and two standard deviations of
    such a count, lies at or above it."""
    above, most = 0, share * sum(bins.values())
    for b in sorted(bins, reverse=True):
        above += bins[b]
        if above > most + 2 * math.sqrt(most + 1):
            return b + 1
    return int(LOWEST / BIN)


def _lowest_but_secrets(own: dict[int, int], keys: dict[int, int], share: float) -> int:
    """The lowest bin such that no more than this share of `own` lies at or above it and is no secret.

    The secrets among them are taken to score like `keys`: there are at most as many as lie at or
    above any bin, divided by the share of the keys that do. Counts are raised by about three standard
    deviations for that (none at all are up to four), so that a few findings are not ruled out by
    chance.
    """
    if not own:
        return int(LOWEST / BIN)
    bins = sorted({*own, *keys}, reverse=True)
    above = np.array([own.get(b, 0) for b in bins]).cumsum()
    caught = np.array([keys.get(b, 0) for b in bins]).cumsum() / sum(keys.values())
    most = above + 1 + 3 * np.sqrt(above + 1)
    secrets = (most[caught >= TELLING] / caught[caught >= TELLING]).min()
    few = np.flatnonzero(above - secrets * caught <= share * above[-1])
    return bins[few[-1]] if len(few) else bins[0] + 1


_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
KEY_ALPHABETS = (
    _LOWER + _UPPER + _DIGITS, _UPPER + _DIGITS, _LOWER + _DIGITS, _DIGITS + b"ABCDEF",
    _LOWER + _UPPER + _DIGITS + b"+/", _LOWER + _UPPER + _DIGITS + b"_-", _LOWER + _UPPER,
)
LONGEST_KEY = 40


def random_key(seed: int) -> bytes:
    """12 to 40 characters of one of the alphabets; some are cut by a dot."""
    rng = np.random.default_rng(seed)
    alphabet = KEY_ALPHABETS[int(rng.integers(len(KEY_ALPHABETS)))]
    size = int(rng.integers(SHORTEST, LONGEST_KEY + 1))
    key = bytes(rng.choice(np.frombuffer(alphabet, dtype=np.uint8), size))
    if size > 20 and rng.random() < 0.1:
        at = size // 2
        key = key[:at] + b"." + key[at + 1 :]
    return key


def harmless(seed: int, word: bytes) -> bytes:
    """An identifier, date, path, version or number such as stand in ordinary text, with a word."""
    rng = np.random.default_rng(seed)
    n = lambda k: b"%0*d" % (k, int(rng.integers(10**k)))
    day = b"20%s%02d%02d" % (n(2), int(rng.integers(1, 13)), int(rng.integers(1, 29)))
    half, rest = word[: len(word) // 2], word[len(word) // 2 :]
    made = (
        word + b"_" + half + b"_" + n(2), half.upper() + b"_" + day + b"_" + n(6) + b"-" + rest,
        day[:4] + b"-" + half[:3].upper() + b"-" + n(6) + b"-" + rest[:2].upper(), day + b"T" + n(6) + b"Z",
        b"/" + half + b"/" + day[:4] + b"/" + day[4:6] + b"/" + rest + b"-" + n(2), half + b"-" + rest + b"-" + n(2) + b"." + n(1) + b"." + n(1),
        half.upper() + b"/" + rest.upper() + b"/" + word.upper(), half.capitalize() + rest.capitalize() + n(2), n(12), n(16),
        half + b"." + rest + b"." + half[:3], b"www." + word + b".org/" + rest, day[:4] + b"-" + day[4:6] + b"-" + day[6:] + b"T" + n(2) + b"-" + n(2),
        word + b"-" + half + b"-" + rest, half.upper() + rest.upper() + b"-" + n(4), word.capitalize() + b"/" + rest,
        b"+" + n(2) + b"-" + n(3) + b"-" + n(7), word + n(4), b"v" + n(1) + b"." + n(2) + b"." + n(3) + b"-" + half,
    )
    return made[int(rng.integers(len(made)))]


def _hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=7).digest(), "big")


def _planted(text: bytes, start: int, end: int, token: bytes) -> tuple[bytes, int, int]:
    """A token put in the place of a span, with what stands around it."""
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    return before + token + after, len(before), len(before) + len(token)


def _found_by_scan(text: bytes, start: int, end: int) -> tuple[int, int] | None:
    """The candidate of a short text that covers the span, if `scan` finds one."""
    raw = np.frombuffer(text, dtype=np.uint8)
    _, others = scan(raw, np.array([0, len(raw)]))
    return next(((a, b) for _, a, b in others if a <= start and end <= b), None)


def _examples(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(label, order, window) of the labelled findings of (text): of every base finding, label 1, and
    of some candidates as they are, label 0, with a random key, label 1, and with an identifier in
    their place, label 2."""
    raw, offsets = buffers(batch.column(0))
    data = raw.tobytes()
    found, others = scan(raw, offsets)

    def example(label: int, text: bytes, start: int, end: int) -> tuple[int, int, bytes]:
        window = windows(text, start, end)[0].tobytes()
        return label, _hash(window), window

    for i, spans in found.items():
        text = data[offsets[i] : offsets[i + 1]]
        for start, end, kind in spans:
            if kind == "assign":
                start = ASSIGN.match(text, start).start(2)
            yield example(1, text, start, end)
    for i, a, b in others:
        word = data[offsets[i] + a : offsets[i] + b]
        order = _hash(word)
        if word.isalpha() and order % 16:
            continue
        text = data[offsets[i] : min(offsets[i] + b + AFTER, offsets[i + 1])]
        yield example(0, text, a, b)
        if word.isalpha():
            yield example(2, *_planted(text, a, b, harmless(order, word)))
            yield example(1, *_planted(text, a, b, random_key(order)))


def _like_keys(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the documents' own candidates, label 0, may be secrets: networks that learned from
    one half of the examples score the other half, and these score like most of the keys there."""
    out = np.zeros(len(x), dtype=bool)
    half = np.arange(len(x)) % 2 == 0  # the examples are in the order of a hash
    for rest in (half, ~half):
        learned, keys = label[~rest] == 1, rest & (label == 1)
        if min(learned.sum(), (~learned).sum(), keys.sum()) < 10:
            continue
        network = Network()
        network.fit(x[~rest], learned.astype(np.float32), steps=300)
        own = np.flatnonzero(rest & (label == 0))
        out[own] = network.logits(x[own]) >= np.quantile(network.logits(x[keys]), 1 - MOST_KEYS)
    return out


def _scored(network: Network):
    """(class, label, bin, token, n): counts of binned scores of all candidates of (text), label 0, of
    keys planted there, label 1, and of harmless tokens planted there, label 2. What `scan` does not
    find counts in the lowest bin. A token tells the candidates apart; it is 0 for what is planted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0, PART_BYTES):
                counts: Counter = Counter()
                raw, offsets = buffers(part.column(0))
                data = raw.tobytes()
                _, others = scan(raw, offsets)
                rows, what = [], []
                for i, a, b in others:
                    begin = offsets[i] + max(0, a - BEFORE)
                    text = data[begin : min(offsets[i] + b + AFTER, offsets[i + 1])]
                    start, end = int(offsets[i] + a - begin), int(offsets[i] + b - begin)
                    word = text[start:end]
                    rows.append((text, start, end))
                    order = _hash(word)
                    what.append((shape(word), 0, order))
                    if not word.isalpha() or order % PLANTED:
                        continue
                    around = text, start, end
                    for label, token in ((1, random_key(order >> 8)), (2, harmless(order >> 8, word))):
                        text, start, end = _planted(*around, token)
                        place = _found_by_scan(text, start, end)
                        if place is None:
                            counts[shape(token), label, 0, int(LOWEST / BIN)] += 1
                        else:
                            rows.append((text, *place))
                            what.append((shape(text[slice(*place)]), label, 0))
                if rows:
                    best = np.clip(network.scores(rows), LOWEST, HIGHEST)
                    bins = np.floor(best / BIN).astype(int).tolist()
                    counts.update((*k, b) for k, b in zip(what, bins, strict=True))
                columns = [pa.array([k[i] for k in counts], pa.int64()) for i in range(4)]
                columns.append(pa.array(list(counts.values()), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["kind", "label", "token", "bin", "n"])

    return run, "kind long, label long, token long, bin long, n long"


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    training_docs: int = TRAINING_DOCS,
    examples: int = EXAMPLES,
    recall: float = RECALL,
    most_false: float = MOST_FALSE,
) -> Network | None:
    """The network, fitted to a bounded sample and with thresholds set on all documents; None if
    there are fewer than 20 examples of a label. Runs jobs.

    Examples come from about `training_docs` documents, dealt by a hash of the id (rows without id
    are dealt alike), and of those the `examples` with the smallest hashes are taken per label;
    equal examples count once, so repeated rows add nothing. Null and empty texts have none.
    The thresholds' counts are one row per class, label and score bin; equal candidates of equal
    score count once there too, so copies of a secret do not pass for a common word.
    """
    step = max(1, math.ceil(docs.count() / training_docs))
    dealt = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("secrets")), F.lit(step)) == 0
    every = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), dealt.alias("dealt"))
    texts = every.filter("dealt").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0, PART_BYTES):
                rows = list(_examples(part))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
                types = [pa.int64()] * 2 + [pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["label", "at", "window"])

    found = texts.mapInArrow(run, "label long, at long, window binary").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("at", "window"))
    chosen = found.withColumn("place", place).filter(F.col("place") <= examples)
    rows = chosen.orderBy("at", "label", "window").select("label", "window").collect()
    label = np.array([r[0] for r in rows])
    if min((label != 1).sum(), (label == 1).sum()) < 20:
        return None
    x = np.stack([np.frombuffer(r[1], dtype=np.uint8).reshape(2, WIDTH) for r in rows])
    harmless_or_key = ~_like_keys(x, label)
    network = Network()
    network.fit(x[harmless_or_key], (label[harmless_or_key] == 1).astype(np.float32))
    count, schema = _scored(network)
    each = every.select("text").mapInArrow(count, schema).groupBy("kind", "label", "token", "bin")
    once = F.when(F.col("label") == 0, 1).otherwise(F.sum("n")).alias("n")
    bins = each.agg(once).groupBy("kind", "label", "bin").agg(F.sum("n"))
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for kind, label, b, n in bins.collect():
        counts.setdefault((kind, label), {})[b] = n
    if {label for _, label in counts} < {0, 1}:
        return None
    network.set_thresholds(counts, recall, most_false)
    return network


def findings(
    docs: DataFrame,
    network: Network | None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, findings): per row the secrets of its whole text, an array of (kind, start, end,
    value, score) ordered by start, then kind; places count characters, end is exclusive.

    Base findings have the kinds assign, access and hex, and score 1; those that the network adds
    have the kind model, never touch a base finding and are left out without a network. A null or
    empty text has none. Rows without id and repeated rows are scanned like others. Other columns
    are not read.
    """
    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    own = own.toDF("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, PART_BYTES):
                found = _found(*buffers(part.column(1)), sent.value)
                columns = [part.column(0), pa.array(found, _FINDINGS)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "findings"])

    kind = own.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"
    return own.mapInArrow(run, f"doc_id {kind}, findings {spans}")


_FINDINGS = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()),
         ("score", pa.float64())]
    )
)


def _found(raw: np.ndarray, offsets: np.ndarray, network: Network | None) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    base, others = scan(raw, offsets)
    spans = {i: [(a, b, kind, 1.0) for a, b, kind in found] for i, found in base.items()}
    if network and others:
        rows = []
        for i, a, b in others:
            begin = max(0, a - BEFORE)
            text = raw[offsets[i] : offsets[i + 1]][begin : b + AFTER].tobytes()
            rows.append((text, a - begin, b - begin))
        logits = network.scores(rows)
        scores = network.probability(logits).tolist()
        for (i, a, b), (text, *_), z, p in zip(others, rows, logits.tolist(), scores, strict=True):
            if z >= network.thresholds[shape(text[min(a, BEFORE) : min(a, BEFORE) + b - a])]:
                spans.setdefault(i, []).append((a, b, MODEL_KIND, p))
    order = {k: n for n, k in enumerate((*KINDS, MODEL_KIND))}
    for i, found in spans.items():
        text = raw[offsets[i] : offsets[i + 1]]
        chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        for a, b, kind, p in sorted(found, key=lambda x: (x[0], order[x[2]])):
            value = text[a:b].tobytes().decode()
            out[i].append(
                {"kind": kind, "start": int(chars[a]), "end": int(chars[b]), "value": value, "score": p}
            )
    return out
