"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = WORD.findall(lower(text))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def colliding_words():
    """Two words with the same polynomial hash modulo 2^64 under any base: the Thue-Morse word of
    1,024 letters and its complement."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    return word, word.translate(str.maketrans("ab", "ba"))


def near_duplicates(rows, size, percent=80):
    """{id: (set size, component)} of (id, text) rows with unique ids."""
    sets = {i: shingles(t, size) for i, t in rows}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in where[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def contained(docs, items, size=5, percent=80):
    found = set()
    sets = {i: shingles(t, size) for i, t in items}
    for d, text in docs:
        whole = shingles(text, size)
        for i, s in sets.items():
            shared = len(s & whole)
            if s and 100 * shared >= percent * len(s):
                found.add((d, i, len(s), shared))
    return found


def _feistel(key, kind, left, right, a, b):
    for i in range(1, 9):
        other = right if i % 2 else left
        h = int(hashlib.md5(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()[:12], 16)
        if i % 2:
            left = (left + h) % a
        else:
            right = (right + h) % b
    return left, right


def permuted_digits(key, kind, digits):
    cut = -(-len(digits) // 2)
    n = len(digits) - cut
    left, right = _feistel(
        key, f"{kind}{len(digits)}", int(digits[:cut]), int(digits[cut:]), 10**cut, 10**n
    )
    return f"{left:0{cut}d}{right:0{n}d}"


def check_digit(payload):
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def refilled(shape, digits):
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def card(key, found):
    digits = re.sub("[^0-9]", "", found)
    if check_digit(digits[:-1]) != digits[-1]:
        return found
    payload = digits[0] + permuted_digits(key, "card", digits[1:-1])
    return refilled(found, payload + check_digit(payload))


def ipv4(key, found):
    a, b, c, d = (int(x) for x in found.split("."))
    if max(a, b, c, d) > 255:
        return found
    x, y = _feistel(key, "ipv4", a * 256 + b, c * 256 + d, 65536, 65536)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def phone(key, found):
    digits = re.sub("[^0-9]", "", found)
    code = ""
    if found[0] == "+":
        two = [*range(30, 35), *range(43, 50), *range(51, 59), *range(60, 67), *range(90, 96), 20, 27, 36, 39, 40, 41]
        two += [81, 82, 84, 86, 98]
        code = digits[:1] if digits[0] in "17" else digits[:2] if int(digits[:2]) in two else digits[:3]
    return refilled(found, code + permuted_digits(key, "phone", digits[len(code) :]))


def mail(key, found):
    name = found.split("@")[0]
    left, right = name[: len(name) // 2], name[len(name) // 2 :]

    def shifted(text, other, i):
        stream = hashlib.sha512(f"{key}|mail|{i}|{other}".encode()).hexdigest()
        out = ""
        for n, c in enumerate(text):
            by = int(stream[2 * (n % 64) : 2 * (n % 64) + 2], 16)
            for first, size in ((97, 26), (65, 26), (48, 10)):
                if first <= ord(c) < first + size:
                    c = chr((ord(c) - first + by) % size + first)
                    break
            out += c
        return out

    for i in range(1, 5):
        if i % 2:
            left = shifted(left, right, i)
        else:
            right = shifted(right, left, i)
    return left + right + found[len(name) :]


ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.I | re.A,
)


def base_findings(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]
