from datetime import datetime, timedelta

from corpusloom.operators import references as R

T0 = datetime(2025, 1, 1)
REF, PARENT = "key string, at timestamp, extra int", "key string, born timestamp, died timestamp, extra int"


def day(n):
    return T0 + timedelta(days=n)


def found(spark, refs, parents, **more):
    rows = R.orphans(spark.createDataFrame([(k, a, 1) for k, a in refs], REF), spark.createDataFrame([(k, b, d, 2) for k, b, d in parents], PARENT), **more)
    return sorted((r.key, r.at) for r in rows.collect())


def test_alive_from_birth_until_just_before_death(spark):
    refs = [("a", day(0)), ("a", day(1)), ("a", day(2)), ("a", day(3)), ("b", day(9)), (None, day(1))]
    assert found(spark, refs, [("a", day(1), day(3)), ("b", day(1), None)]) == [("a", day(0)), ("a", day(3))]


def test_null_times_and_empty_tables(spark):
    assert found(spark, [("a", None), ("a", day(2))], [("a", day(1), None)]) == [("a", None)]
    assert found(spark, [("a", day(1))], []) == [("a", day(1))]
    assert found(spark, [], [("a", day(1), None)]) == []
    assert found(spark, [("a", day(1))], [("a", None, None), ("a", day(1), day(1)), (None, day(0), None)]) == [("a", day(1))]


def test_spans_merge_and_gaps_stay(spark):
    parents = [("a", day(1), day(3)), ("a", day(2), day(5)), ("a", day(7), day(9)), ("a", day(7), day(8)), ("a", day(20), None), ("a", day(21), day(22))]
    spans = R.life_spans(spark.createDataFrame([(*p, 0) for p in parents], PARENT)).collect()
    assert sorted((s.born, s.died) for s in spans if s.died) == [(day(1), day(5)), (day(7), day(9))]
    assert [s.born for s in spans if not s.died] == [day(20)]
    refs = [("a", day(n)) for n in (0, 4, 5, 6, 7, 9, 30)]
    assert found(spark, refs, parents) == [("a", day(n)) for n in (0, 5, 6, 9)]


def test_any_filter_size_gives_the_same(spark):
    refs = [(f"k{n}", day(n % 30)) for n in range(400)]
    parents = [(f"k{n}", day(n % 17), day(n % 17 + n % 9)) for n in range(0, 500, 2)]
    small, large = found(spark, refs, parents, max_words=1), found(spark, refs, parents)
    alive = {(k, a) for k, a in refs for p, b, d in parents if p == k and b <= a < d}
    assert small == large == sorted(set(refs) - alive)


def test_hot_key(spark):
    refs = [("hot", day(n % 50)) for n in range(3000)]
    assert set(found(spark, refs, [("hot", day(10), day(20))] * 500)) == {("hot", day(n)) for n in range(50) if not 10 <= n < 20}


def test_orphans_of_a_corpus(spark):
    imports = spark.createDataFrame([(1, "r", ".\\src//a.ts", T0), (2, "r", "SRC/a.ts", T0), (3, "r", None, T0)], "import_id long, repo string, resolved_path string, scanned_at timestamp")
    calls = spark.createDataFrame([(1, "r", "A.f", T0), (2, "r", "f", T0), (3, "r", "external:x.y", T0), (4, "q", "A.f", T0)], "call_id long, repo string, callee string, scanned_at timestamp")
    rules = spark.createDataFrame([(1, "r", [("src/a.ts", 1, None), (None, 1, None), ("gone.ts", None, "x")], T0), (2, "r", [], T0), (3, "r", None, T0)], "rule_no long, repo string, evidence array<struct<file:string,line:int,note:string>>, mined_at timestamp")
    files = spark.createDataFrame([("r", "./src/a.ts", T0, None)], "repo string, path string, scanned_at timestamp, removed_at timestamp")
    symbols = spark.createDataFrame([("r", "f", "A", T0, None)], "repo string, name string, parent_symbol string, scanned_at timestamp, removed_at timestamp")
    rows = R.orphan_references(imports.union(imports), calls, rules, files, symbols)
    assert sorted((r.ref_table, r.ref_id, r.ref_pos) for r in rows.collect()) == [("calls", 2, 0), ("calls", 4, 0), ("imports", 2, 0), ("rules", 1, 3)]
    assert {(r.ref_table, r.month): r.orphans for r in R.orphan_counts(rows).collect()} == {("calls", "2025-01"): 2, ("imports", "2025-01"): 1, ("rules", "2025-01"): 1}
