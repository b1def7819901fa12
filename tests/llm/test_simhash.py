import random

import xxhash

from spendframe.llm import queries, simhash


def plain_print(text, size=3):
    table = {byte: byte + 32 for byte in range(65, 91)}
    words = "".join(chr(table.get(ord(c), ord(c))) for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [word for word in words.split(" ") if word]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


def plain_groups(prints, bits):
    """Root by union-find over all pairs: dict from row number to the smallest linked row number."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_match_the_definition():
    draw = random.Random(1)
    for text in ["", " \n", "A", "one Two", "x y z", "É é É é\tx", *(" ".join(draw.choices("abcd", k=n)) for n in range(3, 60))]:
        assert simhash.text_fingerprint(text.encode(), 3) == signed(plain_print(text)), text


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    text = " ".join(random.Random(2).choices(["ab", "c", "déf"], k=400))
    whole = simhash.text_fingerprint(text.encode(), 3)
    monkeypatch.setattr(simhash, "word_blocks", lambda value: ([word] for word in value.split()))
    assert simhash.text_fingerprint(text.encode(), 3) == whole == signed(plain_print(text))


def near_values(count, seed):
    draw = random.Random(seed)
    values = {0}
    bases = [draw.getrandbits(64) for _ in range(6)]
    while len(values) < count:
        value = draw.choice(bases)
        for _ in range(draw.randint(0, 5)):
            value ^= 1 << draw.randrange(64)
        values.add(value)
    return sorted(values)


def test_links_connect_exactly_the_near_ones(spark):
    """Small bucket limits send everything through the star path, large ones through the pair path."""
    for bits, limit, count in [(2, 1, 150), (2, 8, 150), (2, 10_000, 150), (0, 64, 30), (4, 64, 60)]:
        values = near_values(count, bits + limit)
        frame = spark.createDataFrame([(signed(value),) for value in values], "fp long")
        found = {tuple(row) for row in simhash.links(frame, bits, limit).collect()}
        assert all((a ^ b).bit_count() <= bits if a ^ b >= 0 else ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits for a, b in found)
        wanted = plain_groups(values, bits)
        root = {signed(value): signed(values[r]) for value, r in zip(values, wanted)}
        nodes = {row.node: row.root for row in simhash.components(spark.createDataFrame(sorted(found), "a long, b long")).collect()}
        groups, expected = {}, {}
        for value in root:
            groups.setdefault(nodes.get(value, value), set()).add(value)
            expected.setdefault(root[value], set()).add(value)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_long_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (201, 200), (200, 201)]
    roots = {row.node: row.root for row in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {200: 200, 201: 200}


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (7, "a b c"), (7, "a b c"), (None, "A B\nC"), (None, "q r s t u v w")]
    docs = spark.createDataFrame([(*row, "clash", 1) for row in rows], "doc_id long, text string, fingerprint string, component int")
    found = sorted(((row.id, row.component) for row in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(5, 3), (3, 3), (7, 7), (7, 7), (None, 7), (None, None)], key=str)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((row.doc_id, row.text) for row in kept.collect()), key=str) == sorted([(3, ""), (7, "a b c"), (None, "q r s t u v w")], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(row.text) for row in docs]
    groups = plain_groups(prints, 2)
    expected = sorted((docs[i].doc_id, f"{prints[i]:016x}", docs[groups[i]].doc_id) for i in range(len(docs)))
    assert sorted(tuple(row) for row in queries.QUERIES["op10_simhash"](spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()) == expected
