"""Keys of an edit join for a whole batch of lines at once, from running sums instead of substrings.

The hash of a run of elements (characters, or hashes of words) is the sum of element times power of
an odd base modulo 2^64, so every run of a batch comes from two entries of one array of running
sums, shifted to its start by the inverse power. Equal runs have equal hashes wherever they stand;
different runs with one hash only make a pair more to verify.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

PARITIES = 48
CHUNK = 1 << 20  # characters worked on at a time; a longer line is a chunk of its own

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SOLID = np.array([not chr(c).isspace() for c in range(0x3001)] + [True] * (0x110000 - 0x3001))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_made: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers; those for a chunk of usual size are kept."""
    if len(_made.get(base, ())) >= n:
        return _made[base][:n]
    made = np.full(max(n, CHUNK + (CHUNK >> 4)), base, np.uint64)
    made[0] = 1
    made = np.cumprod(made, dtype=np.uint64)
    if n <= 2 * CHUNK:
        _made[base] = made
    return made[:n]


class Runs:
    """Hashes of the runs [start, end) of a sequence of 64-bit elements."""

    def __init__(self, elements: np.ndarray):
        n = len(elements)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(elements * _powers(_BASE, n), dtype=np.uint64, out=self._sums[1:])
        self._back = _powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._back[start]


def word_limits(n: np.ndarray) -> np.ndarray:
    """`lines.word_edits` of an array of numbers of words."""
    band = np.frexp((n // 25).astype(np.float64))[1].astype(np.int64) - 1
    return np.where(band >= 0, np.maximum(1, 2 * band), 0)


def segment_keys(runs: Runs, first: np.ndarray, sizes: np.ndarray, limit: Callable[[np.ndarray], np.ndarray],
                 salt: int, asked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, own) of all lines: the segments each is stored under (own), and with `asked` the others too.

    Line r has the elements first[r] to first[r] + sizes[r]. `limit` gives the edits allowed at a size;
    lines where it is 0 have no keys. Places are those of `lines.asked_keys`.
    """
    rows, keys, own = [], [], []
    most = limit(sizes)
    for less in range(int(most.max(initial=0)) + 1 if asked else 1):
        edits = np.where((less <= most) & (less < sizes), limit(sizes - less), 0)
        for e in map(int, np.unique(edits[edits >= max(less, 1)])):
            r = np.flatnonzero(edits == e)
            size = sizes[r]
            short, longer = np.divmod(size - less, e + 1)
            even = e + 1 - longer
            label = (size - less).astype(np.uint64) * np.uint64(_BASE)
            for i in range(e + 1):
                at, long = short * i + np.maximum(0, i - even), short + (i >= even)
                low, high = (max(-i, less - (e - i)), min(i, less + (e - i))) if asked else (0, 0)
                moved = np.array(sorted(range(low, high + 1), key=abs))[:, None]
                start = at + moved
                new = (start >= 0) & (start + long <= size)
                begin = first[r] + np.where(new, start, 0)
                key = mixed(runs(begin, begin + long) + label + _salted(salt, i))
                if len(moved) > 1:  # of equal runs the least moved one stays
                    before = np.tri(len(moved), k=-1, dtype=bool)[:, :, None] & new
                    new = new & ~(before & (key[:, None] == key)).any(1)
                which, line = np.nonzero(new)
                rows.append(r[line])
                keys.append(key[new])
                own.append(which == 0 if less == 0 else np.zeros(len(line), bool))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def _parities(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per line one bit for each kind: whether its elements of that kind are odd in number."""
    return np.bitwise_xor.reduceat(np.uint64(1) << kinds, first)


def chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of lines of about CHUNK characters together."""
    number = np.cumsum(sizes) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield slice(int(a), int(b))


def characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lines in a row, and where each line begins and how long it is."""
    sizes = np.array([len(x) for x in lines], np.int64)
    first = np.cumsum(sizes) - sizes
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), first, sizes


def words_of(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all lines in a row, and how many words each line has."""
    solid = _SOLID[codes]
    begins, ends = np.zeros(len(codes) + 1, bool), np.zeros(len(codes) + 1, bool)
    begins[first], ends[first + sizes] = True, True
    begins[1:-1] |= ~solid[:-1]
    ends[1:-1] |= ~solid[1:]
    start = np.flatnonzero(solid & begins[:-1])
    end = np.flatnonzero(solid & ends[1:]) + 1
    counts = np.bincount(np.searchsorted(first, start, "right") - 1, minlength=len(sizes))
    return mixed(runs(start, end) + (end - start).astype(np.uint64)), counts


@cache
def _elements() -> np.ndarray:
    """What stands for each code point in a running sum."""
    return mixed((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def _runs_of(codes: np.ndarray) -> Runs:
    return Runs(_elements()[codes])


@cache
def _salted(salt: int, i: int) -> np.ndarray:
    return mixed(np.array([salt << 32 | i + 1], np.uint64))


Probes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def char_probes(lines: list[str], edits: int, asked: bool) -> tuple[Probes, np.ndarray, np.ndarray]:
    """Probes of non-empty lines by characters, hashes of their words in a row, and how many each line has."""
    codes, first, sizes = characters(lines)
    runs = _runs_of(codes)
    row, key, own = segment_keys(runs, first, sizes, lambda n: np.full(len(n), edits, np.int64), 1, asked)
    odd = _parities((codes & np.uint32(31)).astype(np.uint64), first)
    return (row, key, own, np.full(len(row), 2 * edits, np.uint64), odd[row]), *words_of(codes, first, sizes, runs)


def word_probes(words: np.ndarray, counts: np.ndarray, asked: bool) -> Probes | None:
    """Probes by words, as `char_probes` gives these; None if there are no words."""
    held = np.flatnonzero(counts)
    if not len(held):
        return None
    first = (np.cumsum(counts) - counts)[held]
    counts = counts[held]
    row, key, own = segment_keys(Runs(words), first, counts, word_limits, 2, asked)
    odd = _parities(words % np.uint64(PARITIES), first)
    return held[row], key, own, (2 * word_limits(counts)).astype(np.uint64)[row], odd[row]


def line_probes(lines: list[str], edits: int, asked: bool) -> Iterator[Probes]:
    """(row, key, own, room, parities) of non-empty lines, first by characters and then by words.

    `room` is the number of parities in which a linked line may differ at most.
    """
    by_chars, words, counts = char_probes(lines, edits, asked)
    yield by_chars
    by_words = word_probes(words, counts, asked)
    if by_words:
        yield by_words


def wide_parities(lines: list[str]) -> np.ndarray:
    """Per non-empty line c1, c2, w1, w2, words: 128 parities of characters, 128 of words, and edits of words allowed."""
    codes, first, sizes = characters(lines)
    words, counts = words_of(codes, first, sizes, _runs_of(codes))
    out = np.zeros((5, len(lines)), np.int64)
    held = np.flatnonzero(counts)
    for at, elements, where, whose in ((0, codes.astype(np.uint64), first, slice(None)),
                                       (2, words, (np.cumsum(counts) - counts)[held], held)):
        if not len(where):
            continue
        kind = elements & np.uint64(127)
        for half in (0, 1):
            bits = np.where(kind >> np.uint64(6) == half, np.uint64(1) << (kind & np.uint64(63)), np.uint64(0))
            out[at + half, whose] = np.bitwise_xor.reduceat(bits, where).view(np.int64)
    out[4] = word_limits(counts)
    return out


def word_codes(lines: list[str]) -> list[str]:
    """Per non-empty line one ASCII character a word: two lines are at least as far apart in words as these strings."""
    codes, first, sizes = characters(lines)
    words, counts = words_of(codes, first, sizes, _runs_of(codes))
    signs = ((words >> np.uint64(7)) % np.uint64(94) + np.uint64(33)).astype(np.uint8).tobytes().decode("ascii")
    ends = np.cumsum(counts).tolist()
    return [signs[a:b] for a, b in zip([0, *ends], ends)]
