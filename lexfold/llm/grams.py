"""Hashed character n-grams of many words at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters of an ordinary word; longer ones are read in pieces, or few at a time.
WIDTH = 40
#: Printable ASCII other than letters and digits, stripped from a word's ends.
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def plain(word: str) -> str:
    return word.lower().strip(STRIP)


def pieces(words: list[str], overlap: int = 4) -> list[str]:
    """The words, those whose plain form is over WIDTH as pieces of WIDTH characters: every n-gram up to overlap + 1 is in one."""
    if max(map(len, words), default=0) <= WIDTH:
        return words
    out = []
    for w in words:
        if len(w) > WIDTH and len(p := plain(w)) > WIDTH:
            out += [p[i : i + WIDTH] for i in range(0, len(p) - overlap, WIDTH - overlap)]
        else:
            out.append(w)
    return out


def batches(words: Sequence[str], most: int = 10_000) -> Iterator[list[int]]:
    """Places of words, shorter ones first: most ordinary words at a time, or so many longer ones as take the same room."""
    part, order = [], sorted(range(len(words)), key=lambda i: max(WIDTH, len(words[i])))
    for i in order:
        if part and (len(part) + 1) * max(WIDTH, len(words[i])) > most * WIDTH:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def _mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x7FEB352D)
    h = h ^ (h >> np.uint32(15))
    return (h % np.uint32(buckets)).astype(np.int32)


def hashed(words: Sequence[str], sizes: Sequence[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, valid), [words, n-grams]: buckets of each plain word's n-grams and, first, of itself.

    A word is read between < and >, so n-grams at its ends are its affixes. An
    empty word has no n-gram. Of a word over WIDTH the place of itself is its beginning's.
    """
    raw = [w.encode("utf-32-le", "surrogatepass") for w in words]
    size = np.array([len(r) // 4 for r in raw], np.int64)
    width = int(size.max(initial=0)) + 2
    c = np.zeros((len(words), width), np.uint32)
    column = np.arange(width)
    c[:, 0] = 60
    c[(column >= 1) & (column <= size[:, None])] = np.frombuffer(b"".join(raw), "<u4")
    c[np.arange(len(words)), size + 1] = 62
    with np.errstate(over="ignore"):
        whole = np.full(len(words), 17, np.uint32)
        for i in range(min(width, WIDTH + 2)):
            whole = np.where(i <= size + 1, whole * np.uint32(0x01000193) ^ c[:, i], whole)
        places, valid = [_mixed(whole, buckets)[:, None]], [(size > 0)[:, None]]
        for n in sizes:
            if width < n:
                continue
            h = np.full((len(words), width - n + 1), 31 * n, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) ^ c[:, j : width - n + 1 + j]
            places.append(_mixed(h, buckets))
            valid.append((np.arange(width - n + 1) + n <= size[:, None] + 2) & (size > 0)[:, None])
    return np.concatenate(places, 1), np.concatenate(valid, 1)


def rows(words: Sequence[str], sizes: Sequence[int], buckets: int, batch: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The same of words, which are made plain here, in compressed rows: (places, where each word's start, with the end)."""
    flat, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), batch):
        p, v = hashed([plain(w) for w in words[i : i + batch]], sizes, buckets)
        flat.append(p[v])
        count.append(v.sum(1))
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(count))]).astype(np.int64)
