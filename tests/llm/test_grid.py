"""Cells of the grid of lines: what their filters leave, and their rounds."""

import random

import numpy as np
import pytest

from hushframe.llm import lines
from hushframe.llm.common import Scratch


@pytest.fixture()
def scratch(spark):
    out = Scratch(spark)
    yield out
    out.drop()

def _unlike_and_near(lengths, seed):
    """Lines of one small set of syllables, and of each a copy with a fifth of its letters edited."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 3))) for _ in range(45)]
    rows, pairs = [], []
    for k, n in enumerate(lengths):
        line = ""
        while len(line) < n:
            line += rng.choice(syllables) if rng.random() < 0.7 else " " + rng.choice(syllables)
        line = line.strip()
        letters, most = list(line), len(line) // 5
        if k % 4 == 0:  # letters replaced anywhere
            for at in rng.sample(range(len(letters)), most):
                letters[at] = "x"
        elif k % 4 == 1:  # every fifth letter
            letters = ["x" if at % 5 == 4 else c for at, c in enumerate(letters)]
        elif k % 4 == 2:  # a tenth goes at the front and comes back behind it
            letters = letters[most // 2 :] + ["x"] * (most // 2)
        else:  # put in and taken out in the middle of halves
            at = len(letters) // 4
            letters[3 * at : 3 * at + most // 2] = []
            letters[at:at] = "y" * (most // 2)
        rows += [line, "".join(letters)]
        pairs.append((2 * k, 2 * k + 1))
    return rows, pairs


@pytest.mark.parametrize(("low", "high"), [(33, 60), (150, 180), (460, 560), (950, 1150)])
def test_cells_leave_near_lines_and_few_others(monkeypatch, low, high):
    rng = random.Random(low)
    rows, pairs = _unlike_and_near([rng.randint(low, high) for _ in range(120)], low)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    cell = lines.Cell([rows[i] for i in order], lines.PERCENT)
    monkeypatch.setattr(cell, "_settle", lambda: None)
    cell.compare(np.arange(len(rows)), np.arange(len(rows)))
    left = {frozenset((order[a], order[b])) for x, y in cell.waiting for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    alike = lines.alike([(rows[a], rows[b]) for a, b in pairs])
    assert alike.sum() > 100
    assert not {p for p, good in zip(pairs, alike, strict=True) if good and frozenset(p) not in left}
    assert len(left) < 0.02 * len(rows) * (len(rows) - 1) / 2


def test_cells_are_taken_in_rounds(spark, scratch, monkeypatch):
    monkeypatch.setattr(lines, "PART", 40)
    rows, pairs = _unlike_and_near([60 + k % 20 for k in range(120)], 9)
    released = []
    monkeypatch.setattr(scratch, "release", lambda: released.append(1))
    texts_ = spark.createDataFrame([(i, r, len(r)) for i, r in enumerate(rows)], "node long, norm string, chars int")
    found = {frozenset((r["u"], r["v"])) for r in lines.near_links(scratch, texts_).collect()}
    # six parts of a line's own band and of the next meet, so a line is shuffled several times, but twice at most in a round
    assert len(released) >= 3
    assert not {p for p, good in zip(pairs, lines.alike([(rows[a], rows[b]) for a, b in pairs]), strict=True) if good and frozenset(p) not in found}


@pytest.mark.parametrize(("low", "high"), [(60, 110), (950, 1150)])
def test_a_cell_holds_the_segments_of_a_slab_at_a_time(monkeypatch, low, high):
    rng = random.Random(high)
    rows, pairs = _unlike_and_near([rng.randint(low, high) for _ in range(60)], high)
    rows = sorted(rows, key=len)
    every = np.arange(len(rows))

    def found(slab):
        monkeypatch.setattr(lines, "SLAB", slab)
        held = []
        look_up = lines.Cell._look_up
        monkeypatch.setattr(lines.Cell, "_look_up", lambda self, h, tile, y, segments, *a: (held.append(segments.base.shape[1]), look_up(self, h, tile, y, segments, *a))[1])
        cell = lines.Cell(rows, lines.PERCENT)
        cell.compare(every, every)
        monkeypatch.undo()
        return max(held), {frozenset(np.flatnonzero(cell.label == k).tolist()) for k in set(cell.label.tolist())}

    whole, groups = found(1 << 30)
    most, same = found(10 * high)
    assert most <= 10 * high // low + 1 < whole and same == groups
    assert any(len(g) > 1 for g in groups)
