"""Near-duplicate removal acts on rows: unlike texts under one id, repeated rows and clashing columns."""

from lorebank.llm import simhash

A = " ".join(f"alpha{k}" for k in range(4000))
NEAR = A.replace("alpha150 ", "changed ")
B = " ".join(f"beta{k}" for k in range(300))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = simhash.keep_representatives(docs)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_a_text_is_lost_only_to_a_near_duplicate(spark):
    assert simhash.linked(*(simhash.np.array([simhash.fingerprint(t)], simhash.np.uint64) for t in (A, NEAR)))[0]
    assert kept(spark, [(3, A), (5, A), (5, B)]) == [(3, A), (5, B)]
    assert kept(spark, [(5, A), (5, B)]) == sorted([(5, A), (5, B)], key=str)
    assert len(kept(spark, [(5, A), (5, NEAR), (5, B)])) == 2
    assert kept(spark, [(2, NEAR), (5, A), (5, A), (5, B), (5, B)]) == sorted([(2, NEAR), (5, B)], key=str)


def test_one_id_does_not_join_unlike_fingerprints(spark):
    docs = spark.createDataFrame([(1, A), (1, B), (2, A), (9, B)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1), (9, 1)]
    docs = spark.createDataFrame([(4, A), (7, A), (7, B), (9, B)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(4, 4), (7, 4), (7, 7), (9, 7)]


def test_repeated_rows_with_other_columns_leave_one_row_always_the_same(spark):
    rows = [(5, B, m, text_hash) for m, text_hash in ((3, "x"), (1, "y"), (2, "z"))] + [(None, B, 0, "n")]
    seen = set()
    for parts in (1, 2, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, text_hash string").repartition(parts)
        out = simhash.keep_representatives(docs)
        assert out.columns == docs.columns
        seen.add(tuple(sorted(out.collect(), key=str)))
    assert len(seen) == 1 and len(next(iter(seen))) == 2


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    rows = kept(spark, [(1, long), (2, long + " tail"), (3, "x" * 1_000_000), (4, "")])
    assert [r[0] for r in rows] == [1, 3, 4]


def test_long_lists_are_split_without_losing_links(spark, monkeypatch):
    import random

    from test_simhash import slow_components

    rng = random.Random(5)
    near_zero = {sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(150)}
    half = {rng.getrandbits(20) << 4 | 0xAB << 40 for _ in range(60)}
    fps = sorted(near_zero | half)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    for most in (5, 1, 10_000):
        monkeypatch.setattr(simhash, "LONG", most)
        links = [(r.a, r.b) for r in simhash.fingerprint_links(nodes).collect()]
        assert all(bin(fps[a] ^ fps[b]).count("1") <= 4 for a, b in links)
        own = list(range(len(fps)))
        for a, b in links:
            x, y = own[a], own[b]
            own = [min(x, y) if o in (x, y) else o for o in own]
        assert own == slow_components(fps), most
    assert own != list(range(len(fps)))
