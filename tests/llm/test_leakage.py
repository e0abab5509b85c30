import random

from corpusloom.llm import leakage

DOC, ITEM = "doc_id long, text string, item_id int", "item_id long, text string, doc_id int"
RNG = random.Random(3)
WORDS = [f"w{n}" for n in range(40)]


def passage(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 0) for i, t in docs], DOC), spark.createDataFrame([(i, t, 0) for i, t in items], ITEM)


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_matches_brute_force_at_any_shard_and_block_size(spark):
    items = [(i, " ".join(passage(30))) for i in range(8)]
    docs = [(d, " ".join(passage(25))) for d in range(60)]
    docs += [(100 + k, " ".join(passage(9) + items[k % 8][1].split()[k % 10 : k % 10 + 9 + k % 8] + passage(9))) for k in range(60)]
    want = brute(docs, items)
    for shard, block in ((2_000_000, 32_000_000), (40, 100)):
        rows = leakage.leaked_passages(*frames(spark, docs, items), shard_words=shard, eval_chars=block)
        assert {(r.doc_id, r.item_id) for r in rows.collect()} == want and want


def test_longest_match_and_place(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, f"zzz {text.upper()}!"), (2, "> **One** two,\n> three four _five_ six [seven](http://x.y/z) eight&nbsp;nine\n> ten <b>eleven</b> twelve"), (3, text[:50]), (4, None), (5, ""), (6, "\n".join(f"{n}. {w}" for n, w in enumerate(text.split())))]
    rows = {r.doc_id: (r.words, r.word_offset) for r in leakage.leaked_passages(*frames(spark, docs + docs, [(1, text)])).collect()}
    assert rows == {1: (14, 1), 2: (12, 0), 6: (14, 0)}


def test_nothing_to_find(spark):
    long = " ".join(passage(20))
    assert leakage.leaked_passages(*frames(spark, [], [(1, long)])).count() == 0
    assert leakage.leaked_passages(*frames(spark, [(1, long)], [])).count() == 0
    assert leakage.leaked_passages(*frames(spark, [(1, long)], [(1, None), (2, ""), (3, "too short")])).count() == 0


def test_hot_copies_and_very_long_text(spark):
    text = " ".join(passage(15))
    docs = [(d, text) for d in range(500)] + [(999, " ".join(passage(100_000)) + " " + text)]
    found = leakage.leaked_passages(*frames(spark, docs, [(1, text), (2, text)]))
    assert found.filter("doc_id < 500").count() == 1000 and found.filter("doc_id = 999").count() == 2
    left = leakage.clean_documents(frames(spark, docs, [])[0], found)
    assert left.count() == 0


def test_long_items_stay_flat(spark):
    """An item of n words takes n numbers, and its matches are followed to their end."""
    rng = random.Random(5)
    item = [f"v{rng.randrange(5000)}" for _ in range(30_000)]
    index = leakage.EvalIndex.build([(1, " ".join(item)), (2, "a b"), (3, None)], 12)
    assert index.flat.nbytes < 200_000 and len(index.begins) == 30_000 - 11
    docs = [" ".join(item), "x " + " ".join(item[100:9000]) + " y " + " ".join(item[200:220]), " ".join(item[5:16])]
    assert sorted(index.matches([7, 8, 9], docs)) == [(0, 1, 30_000, 0), (1, 1, 8_900, 1)]
    same = " ".join(["w"] * 60)
    rows = leakage.leaked_passages(*frames(spark, [(1, same + " end"), (2, " ".join(["w"] * 12)), (3, " ".join(["w"] * 11))], [(1, same)])).collect()
    assert {(r.doc_id, r.words) for r in rows} == {(1, 60), (2, 12)}
    tag = "<a " + "title='" + "z" * 900 + "'>"
    assert leakage.words(f"one {tag} two") == ["one", "two"]
