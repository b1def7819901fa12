import math
import random

import numpy as np
import pytest

from spendframe.llm import dual_tree


def plain_nearest(point, book):
    away = [sum((a - b) ** 2 for a, b in zip(point, entry)) for entry in book]
    return away.index(min(away)), min(away)


def plain_lloyd(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks by comparing every part with every entry in Python integers."""
    kept = [row for row in rows if row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])]
    kept = [(key, [math.floor(scale * x) for x in vector], label) for key, vector, label in kept]
    kept.sort(key=lambda row: (row[0] is None, row[0], row[1]))
    width = len(kept[0][1])
    kept = [row for row in kept if len(row[1]) == width]
    cuts = [width * i // parts for i in range(parts + 1)]
    split = lambda vector: [tuple(vector[a:b]) for a, b in zip(cuts, cuts[1:])]
    books = [list(book) for book in zip(*[split(vector) for _, vector, _ in kept[:entries]])]
    for _ in range(rounds):
        for part, book in enumerate(books):
            points = [split(vector)[part] for _, vector, _ in kept]
            nearest = [plain_nearest(point, book)[0] for point in points]
            for entry in range(len(book)):
                mine = [point for point, at in zip(points, nearest) if at == entry]
                if mine:
                    book[entry] = tuple(sum(column) // len(mine) for column in zip(*mine))
    answers = []
    for key, vector, label in kept:
        found = [plain_nearest(point, book) for point, book in zip(split(vector), books)]
        answers.append((key, label, "".join(f"{entry:02x}" for entry, _ in found), sum(d for _, d in found)))
    totals = {}
    for _, label, _, error in answers:
        totals[label] = totals.get(label, 0) + error
    return sorted([(*row, totals[row[1]]) for row in answers], key=str), books


def check(spark, rows, parts=8, entries=16, rounds=6, scale=4096):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    coded, books = dual_tree.compress(vectors, parts=parts, entries=entries, rounds=rounds, scale=scale)
    expected, plain = plain_lloyd(rows, parts, entries, rounds, scale)
    assert [[tuple(entry) for entry in book.tolist()] for book in books] == plain
    assert coded.columns == ["id", "label", "code", "error", "label_error"]
    assert sorted(map(tuple, coded.collect()), key=str) == expected


def floats(draw, width, spread=1.0):
    return [float(np.float32(draw.gauss(0, spread))) for _ in range(width)]


def test_rounds_match_the_definition(spark):
    draw = random.Random(3)
    centres = [floats(draw, 24) for _ in range(9)]
    rows = [(i, [float(np.float32(x + draw.gauss(0, 0.05))) for x in draw.choice(centres)], draw.choice([0, 1, None])) for i in range(500)]
    check(spark, rows)


def test_ties_repeats_and_few_values(spark):
    """A coarse scale makes many points, entries and distances equal."""
    draw = random.Random(4)
    rows = [(i, [float(draw.randrange(-2, 3)) for _ in range(16)], i % 3) for i in range(300)]
    check(spark, rows + rows[:40], scale=1)


def test_dropped_and_odd_rows(spark):
    draw = random.Random(5)
    rows = [(i, floats(draw, 8), 7) for i in range(10, 40)]
    rows += [(1, None, 7), (2, [None] * 8, 7), (3, [float("nan")] * 8, 7), (4, [1.0] * 7 + [float("inf")], 7), (5, [-float("inf")] + [0.0] * 7, 1)]
    rows += [(50, [1.0] * 5, 7), (51, [], 7), (None, floats(draw, 8), None), (None, floats(draw, 8), None)]
    check(spark, rows)


@pytest.mark.parametrize("width, parts", [(8, 8), (10, 4), (3, 5), (1, 1)])
def test_uneven_parts_and_few_rows(spark, width, parts):
    draw = random.Random(6)
    check(spark, [(i, floats(draw, width), i % 2) for i in range(5)], parts=parts)


def test_blocks_end_within_a_partition(spark, monkeypatch):
    draw = random.Random(7)
    monkeypatch.setattr(dual_tree.store_blocks, "__defaults__", (37,))
    check(spark, [(i, floats(draw, 16), 0) for i in range(200)])


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = dual_tree.compress(empty)
    assert coded.count() == 0 and all(len(book) == 0 for book in books)
    clash = spark.createDataFrame([(1, [0.5] * 8, 2, "x", 3)], "vec_id long, embedding array<float>, label int, code string, id int")
    assert tuple(dual_tree.compress(clash)[0].first()) == (1, 2, "00" * 8, 0, 0)


def test_numbers_beyond_64_bits_are_refused(spark):
    big = spark.createDataFrame([(1, [1e30] * 8, 2)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="cannot be measured in 64 bits"):
        dual_tree.compress(big)


def test_a_descent_equals_all_distances_and_prunes():
    """Well parted points: whole nodes are assigned, and few points are left for integer distances."""
    draw = np.random.default_rng(1)
    centres = draw.integers(-10_000, 10_000, (16, 6))
    points = centres[draw.integers(0, 16, 3000)] + draw.integers(-300, 300, (3000, 6))
    for entries in (centres, np.concatenate([centres[:5], centres[:5]]), centres[:1], draw.integers(-9000, 9000, (11, 6))):
        order = dual_tree.order_points(points, dual_tree.LEAF_POINTS)
        placed = points[order]
        tree = dual_tree.boxes(placed, dual_tree.LEAF_POINTS)
        whole, rows, chosen = dual_tree.assign(placed, tree, entries)
        answer = np.full(len(points), -1)
        for level, nodes, found in whole:
            for node, entry in zip(nodes, found):
                answer[tree[level].starts[node] : tree[level].starts[node + 1]] = entry
        assert (answer[rows] == -1).all()
        answer[rows] = chosen
        assert (answer == ((placed[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)).all()
        if entries is centres:
            assert len(rows) < 1500


def test_blocks_survive_packing():
    draw = np.random.default_rng(2)
    points = draw.integers(-5000, 5000, (333, 20))
    shape = dual_tree.Shape.of(20, 8)
    block = dual_tree.Block.build(points, shape)
    again = dual_tree.Block.unpack(333, shape, *block.pack())
    books = [points[:16, part] for part in shape.parts()]
    for (total, number), (other, count) in zip(block.sums(books), again.sums(books)):
        assert (total == other).all() and (number == count).all()
