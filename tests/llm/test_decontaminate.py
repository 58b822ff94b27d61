import random
import re

import pytest
from lorebank.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, body in items:
        own = plain_words(body)
        m = min(13, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
        for k in range(len(words) - m + 1) if m else ():
            if tuple(words[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def cases():
    rng = random.Random(3)
    vocab = ["a", "B", "c3", "é", "Zz"]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([1, 2, 3, 12, 13, 14, 40, 40])]
    items += [(8, items[6][1]), (9, ""), (10, None), (None, "a b"), (11, "É--x_9")]
    docs = [None, "", " .,", "\x00", "q" * 5000, items[6][1].upper().replace(" ", "-- ")]
    docs += [" ".join(rng.choices([*vocab, "xx"], k=rng.randint(0, 80))) for _ in range(60)]
    docs += [f"{' '.join(rng.choices(['u', 'v'], k=rng.randint(0, 400)))} {' '.join(items[7][1].split()[2:17])} v" for _ in range(10)]
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 50])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    docs, items = cases()
    d = spark.createDataFrame([(k, t, 0) for k, t in enumerate(docs)], "doc_id long, text string, hits int").repartition(3)
    b = spark.createDataFrame([*items, items[3]], "item_id long, text string")
    known = [(i, t) for i, t in items if i is not None]
    want = {k: plain(t, known) for k, t in enumerate(docs)}
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.contamination(d, b).collect()}
    assert got == want
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {k for k, w in want.items() if not w[3]}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    (row,) = decontaminate.contamination(d, b).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (3, 0, False)
    assert decontaminate.contamination(d.limit(0), b).count() == 0
