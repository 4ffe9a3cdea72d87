"""Plain versions of the operators, over lists in memory, that the tests hold the Spark jobs against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc_mod(key, n: int) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


def word_list(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


# --- 1: decontamination


def letters(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    phrases = defaultdict(set)
    for item, text in items:
        w = letters(text)
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                phrases[tuple(w[i : i + window])].add(str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for key, text in docs:
        w, hit, found = letters(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[tuple(w[i : i + n])]
        out.append((key, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


# --- 2: lines


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(UPPER)


def without_repeats(docs: list[tuple], least: int = 10) -> list[tuple]:
    """(key, n_lines, n_dropped, kept text); rows of one id are one document."""
    order = lambda key: math.inf if key is None else key
    holders = defaultdict(set)
    for key, text in docs:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least:
                holders[line_key(line)].add(order(key))
    out = []
    for key, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[line_key(x)]) < 2 or min(holders[line_key(x)]) == order(key)]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


# --- 3: near duplicates


def shingle_set(text: str | None, size: int) -> set[tuple]:
    w = word_list(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_duplicates(docs: list[tuple], size: int, percent: int = 80) -> list[tuple]:
    sets = [(key, shingle_set(text, size)) for key, text in docs]
    parent = {key: key for key, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    low, high = sorted((find(a), find(b)))
                    parent[high] = low
    return [(key, len(x), find(key), find(key) == key) for key, x in sets]


# --- 4: secrets

SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place, end)."""
    return sorted((m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m.group(group)) >= least)


# --- 5: base rules


def rules(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(repeated), failed


# --- 7: language model


def language_model(docs: list[tuple], rounds: int = 60) -> list[tuple]:
    """(key, held_out, n_tokens, n_known, train_tokens, base, score), with the estimates kept as they are (no table of logarithms)."""
    texts = [(key, [*word_list(text), None]) for key, text in docs]
    kept = [t for key, t in texts if crc_mod(key, 7) not in (2, 3)]
    deleted = [t for key, t in texts if crc_mod(key, 7) == 3]

    def count(rows):
        one, two = Counter(), Counter()
        for t in rows:
            one.update(t)
            two.update(zip([None, *t[:-1]], t))
        return one, two, sum(one.values())

    def estimates(t, counts):
        one, two, n = counts
        for before, w in zip([None, *t[:-1]], t):
            c = one[before]
            yield min(c.bit_length(), 23), two[before, w] / max(c, 1), one[w] / max(n, 1)

    part = count(kept)
    seen = Counter(x for t in deleted for x in estimates(t, part))
    weights, uniform = {b: [0.4, 0.4, 0.2] for b in range(24)}, 1 / (len(part[0]) + 1)
    for _ in range(rounds if deleted else 0):
        sums = {b: [0.0, 1e-3, 1e-3] for b in range(24)}
        for (b, two, one), n in seen.items():
            share = [x * y for x, y in zip(weights[b], (two, one, uniform))]
            for k in range(3):
                sums[b][k] += n * share[k] / sum(share)
        weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}
    whole = count(kept + deleted)
    n, v = whole[2], len(whole[0])
    out = []
    for key, t in texts:
        base = sum(math.log10((whole[0][w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(weights[b][0] * two + weights[b][1] * one + weights[b][2] / (v + 1)) for b, two, one in estimates(t, whole))
        out.append((key, crc_mod(key, 7) == 2, len(t), sum(whole[0][w] > 0 for w in t), n, base, score))
    return out


# --- 6: toxicity

_LIKE = dict(zip(b"013457@", b"oieasta"))


def _symbols(word: bytes) -> list[int]:
    out = []
    for c in word:
        c = _LIKE.get(c, c | 32 if 65 <= c <= 90 else c)
        if 97 <= c <= 122 or c >= 128:
            out.append(c - 96 if c < 128 else 32 + c % 32)
    return out


def toxic_strings(text: str | None) -> list[tuple[list[int], int]]:
    """(symbols, words) of the strings of a text; 31 marks the beginning of a word."""
    raw, sentences, now, last = (text or "").encode(), [], [], 0
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        if now and b"\n" in raw[last : m.start()]:
            sentences.append(now)
            now = []
        now.append(_symbols(m[0]))
        last = m.end()
        if m[0][-1:] in (b".", b"!", b"?"):
            sentences.append(now)
            now = []
    out = []
    for words in [*sentences, now]:
        words = [w for w in words if w]
        for n in (1, 2, 3):
            out += [(sum(([31, *w] for w in words[i : i + n]), []), n) for i in range(len(words) - n + 1)]
        out += [(w[p : p + 24], 0) for w in words if len(w) > 24 for p in range(0, len(w) - 12, 12)]
        for run in re.finditer("1{4,}", "".join("1" if len(w) == 1 else "0" for w in words)):
            letters = [31] + [words[k][0] for k in range(*run.span())]
            out += [(letters[p : p + 25], 0) for p in range(0, max(1, len(letters) - 12), 12)]
    return out


def toxic_margin(text: str | None, weights, bias: float) -> float:
    """The largest margin of a text's strings, by all their three-symbol subsequences."""
    best = -2.0
    for x, words in toxic_strings(text):
        if len(x) - max(words, 1) >= 4:
            total = sum(0.6 ** (k - i - 2) * float(weights[(x[i] << 12) + (x[j] << 6) + x[k]]) for i in range(len(x)) for k in range(i + 2, min(i + 8, len(x))) for j in range(i + 1, k))
            n = min(len(x), 4095)
            norm = math.sqrt(sum(0.6 ** (2 * (far - 2)) * (far - 1) * max(n - far, 0) for far in range(2, 8)))
            best = max(best, total / 2.0**40 / norm + bias)
    return min(best, 1.0)


# --- 4: the battery


def distance(x: str, alphabet: str) -> float:
    """The sum of the deviations of the three tests."""
    c = [alphabet.index(y) + 1 for y in x.rstrip("=") if y in alphabet]
    n, k = len(c), len(alphabet)
    classes = min(max(n // 3, 2), k)
    counts = Counter((y - 1) * classes // k for y in c)
    chi, free = sum(v * v for v in counts.values()) * classes / n - n, classes - 1
    z_chi = ((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    side = [y > k / 2 for y in c]
    high, runs = sum(side), 1 + sum(a != b for a, b in zip(side, side[1:]))
    mean = 1 + 2 * high * (n - high) / n
    few_runs = (mean - runs) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 0.25))
    off = [y - (k + 1) / 2 for y in c]
    z_serial = abs(sum(a * b for a, b in zip(off, off[1:])) / max(sum(a * a for a in off), 1e-9)) * math.sqrt(n)
    return z_chi + few_runs + z_serial
