"""Keys of a batch of lines against those cut out of each line one by one."""

import random

import numpy as np

from seqloom.llm import lines
from seqloom.llm.segments import chunks, line_probes, wide_parities, word_limits


def test_limits_of_words():
    assert word_limits(np.arange(3000)).tolist() == [lines.word_edits(n) for n in range(3000)]


def test_chunks_hold_every_line_once():
    sizes = np.array([1, 1 << 22, 5, 1 << 19, 1 << 19, 1 << 20, 2])
    got = [i for part in chunks(sizes) for i in range(part.start, part.stop)]
    assert got == list(range(len(sizes)))


def test_keys_are_those_of_single_lines():
    rng = random.Random(1)
    some = [f"w{i}" for i in range(40)] + ["中文", "\U0001f600", "　x"]
    made = [" ".join(rng.choice(some) for _ in range(rng.choice([12, 30, 60, 120, 400]))) for _ in range(150)]
    made += ["a" * 50, "ab" * 40, "a " * 60 + "b", "\t".join(["x y"] * 30)]
    of_whom: tuple[dict, dict] = ({}, {})
    for asked in (False, True):
        for kind, (row, key, own, room, odd) in enumerate(line_probes(made, 2, asked)):
            for i, line in enumerate(made):
                words = line.split()
                if kind:
                    want, stored = lines.word_keys(words, asked), lines.word_keys(words, False)
                    assert set(room[row == i]) <= {2 * lines.word_edits(len(words))}
                else:
                    want, stored = lines.asked_keys(line, 2) if asked else lines.stored_keys(line, 2), lines.stored_keys(line, 2)
                mine = key[row == i]
                assert len(mine) == len(set(mine)) == len(set(want))
                assert own[row == i].sum() == len(set(stored))
                # The same lines meet under both kinds of keys.
                for k, o in zip(mine, own[row == i]):
                    of_whom[kind].setdefault(k, set()).add(i)
    plain: dict = {}
    for i, line in enumerate(made):
        for k in lines.asked_keys(line, 2):
            plain.setdefault(k, set()).add(i)
    assert sorted(map(sorted, of_whom[0].values())) == sorted(map(sorted, plain.values()))


def test_lines_without_words_have_no_word_keys():
    assert [len(x[0]) for x in line_probes(["z" * 60], 2, True)][1:] == [0]


def test_wide_parities_never_part_linked_lines():
    rng = random.Random(5)
    base = [f"word{rng.randrange(200)}" for _ in range(110)]
    made = []
    for _ in range(60):
        w = list(base[: rng.choice([12, 30, 60, 110])])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(["new", "", "a b", "é中"])
        made.append(" ".join(w))
    c1, c2, w1, w2, most = ([int(v) & (1 << 64) - 1 for v in x] for x in wide_parities([*made, "zz" * 30]))
    for i, a in enumerate(made):
        for j, b in enumerate(made[:i]):
            by_chars = (c1[i] ^ c1[j]).bit_count() + (c2[i] ^ c2[j]).bit_count() <= 4
            by_words = (w1[i] ^ w1[j]).bit_count() + (w2[i] ^ w2[j]).bit_count() <= 2 * min(most[i], most[j])
            assert by_chars or by_words or not lines.near_lines(a, b, 2)
    assert most[-1] == 0
