"""Documents with odd rows, and brute-force versions of the digest contracts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, chunk int, h long, fp long, copies int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lowered(text: str | None) -> list[str]:
    return words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def odd_rows(seed: int = 0) -> list[tuple]:
    """Nulls, empty and long texts, copies, repeated rows, ties, clashing column names."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(60), say(150)
    texts: list[str | None] = [None, "", " \n\t ", "one", "Two words", " a  b 　c\n\nd", "x" * 5000, say(9000)]
    texts += [base] * 6 + [base.replace(base.split()[k], "changed", 1) for k in (3, 40, 99)]
    texts += [f"{say(30)} {passage}\n{say(20)}" for _ in range(5)] + [say(rng.randint(5, 80)) for _ in range(12)]
    texts += ["spam spam spam spam spam " * 30, "line of text here\n" * 12, "# * $ % & | < > " * 9, say(13), say(12)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", None, "ü"]), len(t or ""), 7, 1, 2, 3, 4) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], (None, base, None, None, None, 7, 1, 2, 3, 4)]


def crc_fold(doc_id: int | None, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def repeats_brute(rows: list[tuple], window: int) -> list[tuple[int, list[bool]]]:
    """Per row, which words stand in a window that also starts in a smaller id."""
    big = 1 << 63
    least: dict[tuple, int] = {}
    for r in rows:
        w, key = words(r[1]), big if r[0] is None else r[0]
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, big), key)
    out = []
    for r in rows:
        w, key = words(r[1]), big if r[0] is None else r[0]
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < key:
                hit[i : i + window] = [True] * window
        out.append((r[0], hit))
    return out


def simhash_brute(text: str | None, k: int = 3) -> int:
    import xxhash

    w = lowered(text)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    ones = Counter()
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), seed=42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def groups_brute(n: int, near) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
