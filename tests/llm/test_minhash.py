import random

from spendframe.llm import minhash


def plain_set(text, size=3):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)] if words else [])


def linked(one, other, percent=85):
    return bool(one and other) and 100 * len(one & other) >= percent * len(one | other)


def plain_components(rows, percent=85):
    """Smallest linked id by union-find over all pairs."""
    sets = [plain_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j], percent):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return [(key, len(sets[i]), smallest.get(find(i))) for i, (key, _) in enumerate(rows)]


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = minhash.near_duplicates(docs, **options)
    assert groups.columns == ["id", "n_shingles", "component", "kept"]
    answer = groups.collect()
    assert all(row.kept == (row.id == row.component) for row in answer)
    return sorted((tuple(row)[:3] for row in answer), key=str)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = draw.choice("pqrst") + str(draw.randrange(50))
    return " ".join(words)


def test_groups_match_all_pairs(spark):
    draw = random.Random(5)
    bases = [[f"w{draw.randrange(400)}" for _ in range(draw.choice([9, 40, 120]))] for _ in range(12)]
    texts = [edited(draw, draw.choice(bases), draw.choice([0, 0, 1, 1, 2, 3, 5])) for _ in range(220)]
    rows = list(enumerate(texts, 100))
    draw.shuffle(rows)
    assert found(spark, rows) == sorted(plain_components(rows), key=str)


def test_families_of_several_tiles(spark, monkeypatch):
    """Copies of which some are too far from each other, in tiles of a few nodes, products of a few columns."""
    monkeypatch.setattr(minhash, "TILE_NODES", 7)
    monkeypatch.setattr(minhash, "COLUMNS_AT_ONCE", 11)
    draw = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(draw, base[: draw.choice([70, 85, 92, 100])], draw.choice([1, 2, 3, 4]))) for i in range(150)]
    assert found(spark, rows) == sorted(plain_components(rows), key=str)


def test_texts_with_a_common_passage_are_dropped_early(spark):
    draw = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"w{draw.randrange(10**6)}" for _ in range(60)])) for i in range(80)] + [(500, " ".join(passage)), (501, " ".join(passage[1:]))]
    members = spark.createDataFrame([(i, len(plain_set(text)), bytearray(minhash.shingle_hashes(text.encode(), 3).tobytes())) for i, text in rows], "node long, n long, hashes binary")
    assert sorted(row.node for row in minhash.hopeful(members, 85).collect()) == [500, 501]
    assert found(spark, rows) == sorted(plain_components(rows), key=str)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "one\ttwo\x0bThree"),
            (9, "É é a"), (10, "é é a"), (3, " \n"), (4, "one"), (None, "one two"), (None, "alone here now"), (None, None)]
    assert found(spark, rows) == sorted(plain_components(rows), key=str)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b c d", 5, "x"), (2, "a b c d", 6, "y")], "doc_id long, text string, node int, digest string")
    assert sorted(map(tuple, minhash.near_duplicates(clash).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(random.Random(2).choices(["ab", "c", "déf"], k=900)).encode()
    whole = minhash.shingle_hashes(text, 3)
    monkeypatch.setattr(minhash, "word_blocks", lambda value: ([word] for word in value.split()))
    assert (minhash.shingle_hashes(text, 3) == whole).all()
    assert len(whole) == len(plain_set(text.decode()))
    before = minhash.signature(whole)
    monkeypatch.setattr(minhash, "HASHES_AT_ONCE", 3)
    assert (minhash.signature(whole) == before).all()


def test_signatures_differ_as_sets_do():
    """Places that differ are about 32 times the distance of the sets."""
    draw = random.Random(8)
    total = expected = 0
    for _ in range(300):
        words = [f"w{draw.randrange(10**6)}" for _ in range(150)]
        texts = [" ".join(words), edited(draw, words, 4)]
        one, two = (minhash.signature(minhash.shingle_hashes(text.encode(), 3)) for text in texts)
        total += sum((int(a) >> 16 * k & 0xFFFF) != (int(b) >> 16 * k & 0xFFFF) for a, b in zip(one, two) for k in range(4))
        a, b = map(plain_set, texts)
        expected += 32 * (1 - len(a & b) / len(a | b))
    assert abs(total / expected - 1) < 0.05


def test_signatures_within_15_places_share_a_key(spark):
    draw = random.Random(9)
    rows = []
    for i in range(200):
        values = [draw.getrandbits(16) for _ in range(32)]
        changed = list(values)
        for k in draw.sample(range(32), 15):
            changed[k] ^= draw.randrange(1, 1 << 16)
        for side, found_ in ((0, values), (1, changed)):
            packed = [sum(value << 16 * k for k, value in enumerate(found_[4 * c : 4 * c + 4])) for c in range(8)]
            rows.append((i, side, *[value - (1 << 64) if value >> 63 else value for value in packed]))
    prints = spark.createDataFrame(rows, f"id long, side int, {', '.join(f'{name} long' for name in minhash.SIGNATURE)}")
    keys = prints.select("id", "side", minhash._keys().alias("at")).select("id", "side", "at.*")
    assert keys.groupBy("id", "slot", "key").count().where("count > 1").select("id").distinct().count() == 200
