from pyspark.sql import functions as F

from tracewise.operators import divergence, structdiff, traces
from tracewise.schemas import EVENTS

NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def event(side, k, kind, function, statement, seen="{}", returned=None, raised=None):
    row = dict.fromkeys(NAMES) | {"agent": "gold", "instance_id": "r__r-1", "test_id": 0, "side": side, "event_id": k, "event_type": kind, "filepath": "f.py", "line_number": k, "function_name": function, "statement": statement, "vars_used": [], "vars_defined": [], "seen_variables": seen, "parameters": "{}", "return_value": returned, "exception_type": raised}
    return tuple(row.values())


def trace(side, seen):
    return [
        event(side, 0, "Function", "main", "main()"), event(side, 1, "Line", "main", "x = 1", '{"x": 1}'), event(side, 2, "Function", "f", "f(x)"),
        event(side, 3, "Line", "f", "y = x", seen), event(side, 4, "Return", "f", "return y", seen, "2"), event(side, 5, "Return", "main", "return", "{}", "3"),
    ]


def test_call_tree(spark):
    events = spark.createDataFrame(trace("buggy", "{}"), EVENTS)
    got = {r["event_id"]: (r["depth"], r["block_id"]) for r in traces.with_block(events).collect()}
    assert got == {0: (0, -1), 1: (1, 0), 2: (1, 0), 3: (2, 2), 4: (2, 2), 5: (1, 0)}
    calls = {r["block"]: r for r in traces.blocks(events).collect()}
    assert (calls[2]["parent_id"], calls[2]["block_depth"], calls[2]["return_value"], calls[2]["return_event"]) == (0, 2, "2", 4)
    assert traces.entry(traces.blocks(events)).first()["entry"] == 0


def test_stop_iteration_with_a_value_is_no_exception(spark):
    rows = [event("buggy", 0, "Function", "g", "g()"), event("buggy", 1, "Exception", "g", "raise", raised="StopIteration"), event("buggy", 2, "Return", "g", "return", returned="1"), event("buggy", 3, "Function", "h", "h()"), event("buggy", 4, "Exception", "h", "raise", raised="KeyError"), event("buggy", 5, "Return", "h", "")]
    calls = {r["name"]: r for r in traces.blocks(spark.createDataFrame(rows, EVENTS)).collect()}
    assert calls["g"]["exception"] is None
    assert calls["h"]["exception"]["type"] == "KeyError"
    assert calls["h"]["return_event"] == 4


def test_first_divergence(spark):
    rows = trace("buggy", '{"y": 1}') + trace("patched", '{"y": 2}')
    got = divergence.first_divergence(spark.createDataFrame(rows, EVENTS).withColumn("excluded", F.lit(False))).first()
    assert (got["status"], got["buggy_event_id"], got["diff_path"], got["before_or_after"], got["location"]) == ("ok", 3, "root['seen_variables']['y']", "before", "y = x")
    same = trace("buggy", "{}") + trace("patched", "{}")
    assert divergence.first_divergence(spark.createDataFrame(same, EVENTS).withColumn("excluded", F.lit(False))).first()["status"] == "empty"
    assert divergence.first_divergence(spark.createDataFrame(trace("buggy", "{}"), EVENTS).withColumn("excluded", F.lit(False))).collect() == []


def test_innermost_range(spark):
    points = spark.createDataFrame([("a", 5), ("a", 50), ("a", 2000)], "path string, line int")
    ranges = spark.createDataFrame([("a", 1, 3000, "outer"), ("a", 4, 60, "inner")], "path string, start int, end int, q string")
    got = {r["line"]: r["q"] for r in traces.innermost(points, ranges, ["path"], "line", "start", "end", ["q"]).collect()}
    assert got == {5: "inner", 50: "inner", 2000: "outer"}


def test_structural_filters(spark):
    pair = spark.createDataFrame([(1, '{"seen_variables": {"x": 1.00004, "_cache": 1, "s": "a b c d"}}', '{"seen_variables": {"x": 1.0, "_cache": 2, "s": "a b c e", "n": [1]}}')], "id int, a string, b string")
    d = structdiff.diffs(pair, "a", "b", ["id"])
    assert {(r["kind"], r["path"]) for r in d.collect()} == {("values_changed", "root['seen_variables']['_cache']"), ("values_changed", "root['seen_variables']['s']"), ("dictionary_item_added", "root['seen_variables']['n']")}
    left = structdiff.cascade(d, ["id"], [structdiff.not_cached, structdiff.not_docstring])
    assert [r["path"] for r in left.collect()] == ["root['seen_variables']['n']"]
    assert d.where(structdiff.shallow(1)).count() == 3
    assert d.where(structdiff.shallow(0)).count() == 0


def test_ranges_of_any_width_and_repeated_points(spark):
    import random

    rng = random.Random(3)
    ranges = [("a", s, s + rng.choice([0, 1, 2, 3, 7, 8, 9, 100, 10**6, -1]), k) for k, s in enumerate(rng.randint(-5000, 5000) for _ in range(80))] + [("a", -(2**61), 2**61, 80)]
    points = [("a", rng.randint(-6000, 6000), {"k": k}) for k in range(150)] * 2 + [("b", 1, None), ("a", None, None)]
    got = traces.innermost(spark.createDataFrame(points, "path string, line bigint, extra map<string, int>"), spark.createDataFrame(ranges, "path string, s bigint, e bigint, q int"), ["path"], "line", "s", "e", ["q"])

    def start(at):
        return max(r[1] for r in ranges if r[1] <= at <= r[2])

    rows = got.collect()
    assert sorted((r["line"], r["extra"]["k"]) for r in rows) == sorted((at, x["k"]) for p, at, x in points[:300])
    assert all(ranges[r["q"]][1] == start(r["line"]) for r in rows)


def marked(spark, *rows):
    return spark.createDataFrame([x for r in rows for x in r], EVENTS).withColumn("excluded", F.lit(False))


def test_a_parameter_that_differs_sends_the_walk_back(spark):
    def side(name, given, seen):
        at = NAMES.index("parameters")
        return [(*r[:at], given, *r[at + 1 :]) if (r[NAMES.index("function_name")], r[NAMES.index("event_type")]) == ("f", "Function") else r for r in trace(name, seen)]

    def found(*rows):
        return divergence.first_divergence(marked(spark, *rows)).first()

    near = found(side("buggy", '{"v": 1.000001}', '{"v": 1.0}'), side("patched", '{"v": 2}', '{"v": 2}'))
    assert near["status"] == "empty"  # equal to five decimals: the caller handed it over, where nothing differs
    one_sided = found(side("buggy", "{}", "{}"), side("patched", '{"v": 2}', '{"v": 2}'))
    assert one_sided["buggy_event_id"] is None
    changed = found(side("buggy", '{"v": 1}', '{"v": 5, "w": 7}'), side("patched", '{"v": 2}', '{"v": 2, "w": 7}'))
    assert (changed["buggy_event_id"], changed["diff_path"]) == (3, "root['seen_variables']['v']")
    assert (changed["buggy_variables"], changed["patched_variables"], changed["buggy_function_param"]) == ('{"v":5}', '{"v":2}', '{"v": 1}')
    # parameters on the line's own row say nothing
    on_line = [[(*r[: NAMES.index("parameters")], '{"y": 1}', *r[NAMES.index("parameters") + 1 :]) for r in trace(s, '{"y": %d}' % k)] for s, k in (("buggy", 1), ("patched", 2))]
    on_line = [[r if r[NAMES.index("event_type")] == "Line" else t for r, t in zip(x, trace(s, '{"y": %d}' % k), strict=True)] for x, (s, k) in zip(on_line, (("buggy", 1), ("patched", 2)), strict=True)]
    assert found(*on_line)["buggy_event_id"] == 3


def test_a_divergence_at_the_return_shows_what_came_back(spark):
    def ending(side, *last):
        return [*trace(side, "{}")[:4], event(side, 4, "Exception", "f", "raise", raised="KeyError") if side == "buggy" else event(side, 4, "Line", "f", "z = 1"), event(side, 5, "Return", "f", "return", *last), event(side, 6, "Return", "main", "return", "{}", "3")]

    patched = [(*r[: NAMES.index("filepath")], "new.py", *r[NAMES.index("filepath") + 1 :]) for r in ending("patched", "{}", '{"a": 1}')]
    events = marked(spark, ending("buggy"), patched)
    got = divergence.with_counts(divergence.first_divergence(events), events).first()
    assert (got["status"], got["buggy_event_id"], got["patched_event_id"], got["file_path"], got["before_or_after"]) == ("ok", 4, 5, "new.py", "after")
    assert (got["buggy_variables"], got["patched_variables"]) == ('{"__exception__":["KeyError",null]}', '{"__return__":{"a":1}}')
    assert got["location"].startswith("The return") and got["function_name"] == "f" and not got["seen_pmf"]


def test_counts_of_the_picked_events(spark):
    def looped(side, last):
        rows = [event(side, 0, "Function", "main", "main()")]
        rows += [(*r[: NAMES.index("line_number")], 7, *r[NAMES.index("line_number") + 1 :]) for r in (event(side, k, "Line", "main", "x += 1", '{"x": %d}' % (k if k < 5 else last)) for k in range(1, 6))]
        return [*rows, event(side, 6, "Return", "main", "return")]

    events = marked(spark, looped("buggy", 5), looped("patched", 6))
    got = divergence.with_counts(divergence.first_divergence(events), events).first()
    assert (got["buggy_event_id"], got["buggy_line_count"], got["patched_line_count"]) == (5, 5, 5)


def test_no_join_of_the_walk_gathers_its_keys_in_the_driver(spark):
    events = marked(spark, trace("buggy", '{"y": 1}'), trace("patched", '{"y": 2}'))
    found = divergence.first_divergence(events)
    for plan in (found, divergence.with_counts(found, events)):
        plan.collect()
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_one_pair_over_its_budget_leaves_the_others(spark):
    def named(k, rows):
        return [(r[0], f"r__r-{k}", *r[2:]) for r in rows]

    rows = [x for k in range(4) for s, v in (("buggy", 1), ("patched", 2)) for x in named(k, trace(s, '{"y": %d}' % v))]
    more = [x for s in ("buggy", "patched") for x in named(9, [event(s, k, "Line", "f", "x") for k in range(20)])]

    def never(a, b):
        while a["instance_id"] == "r__r-2":
            pass
        return divergence.same_place(a, b)

    found = divergence.first_divergence(marked(spark, rows, more), matches=never, seconds=60, longer={"r__r-2": 0.5}, most_events=15)
    assert {r["instance_id"]: r["status"] for r in found.collect()} == {"r__r-0": "ok", "r__r-1": "ok", "r__r-2": "error: time", "r__r-3": "ok", "r__r-9": "error: size"}


def test_a_walk_with_counts_shuffles_its_events_once(spark):
    cases = [trace(s, '{"y": %d}' % v) for s, v in (("buggy", 1), ("patched", 2))]
    alone = [(r[0], "r__r-alone", *r[2:]) for r in trace("buggy", "{}")]
    events = marked(spark, *cases, alone)
    got = divergence.first_divergence(events, counts=True)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [r.asDict() for r in got.collect()] == [r.asDict() for r in divergence.with_counts(divergence.first_divergence(events), events).collect()]


def test_waves_read_later_tests_only_of_what_is_open(spark, tmp_path):
    def of(k, test, rows):
        return [(r[0], f"r__r-{k}", test, *r[3:]) for r in rows]

    rows = []
    for k, solved in (("a", 0), ("b", 2), ("c", None)):
        for test in range(4):
            for s in ("buggy", "patched"):
                rows += of(k, test, trace(s, '{"y": %d}' % (1 if s == "buggy" and test == solved else 2)))
    events = marked(spark, rows)
    events.write.partitionBy("agent", "instance_id", "test_id").parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    want = {(r["instance_id"], r["test_id"], r["status"], r["diff_path"]) for r in divergence.first_useful(divergence.first_divergence(events)).collect()}
    asked = []

    def walked(df, **how):
        asked.append(sorted((r[0], r[1]) for r in df.select("instance_id", "test_id").distinct().collect()))
        return first(df, **how)

    first, divergence.first_divergence = divergence.first_divergence, walked
    try:
        got = divergence.first_useful_in_waves(events)
    finally:
        divergence.first_divergence = first
    assert {(r["instance_id"], r["test_id"], r["status"], r["diff_path"]) for r in got.collect()} == want == {("r__r-a", 0, "ok", "root['seen_variables']['y']"), ("r__r-b", 2, "ok", "root['seen_variables']['y']"), ("r__r-c", 0, "empty", None)}
    b, c = "r__r-b", "r__r-c"
    assert asked == [[("r__r-a", 0), (b, 0), (c, 0)], [(b, 1), (c, 1)], [(b, 2), (c, 2)], [(c, 3)]]


def test_lists_are_aligned_and_unordered_fields_are_sets():
    from tracewise.functions.values import difference, unordered_fields

    def of(a, b, repo=""):
        return [x[:2] for x in difference(a, b, unordered=unordered_fields(repo))]

    assert of([1, 2, 3, 4], [1, 9, 2, 3, 4]) == [("iterable_item_added", "root[1]")]
    assert of({"x": ["a", "b", "c", "d"]}, {"x": ["b", "c", "d"]}) == [("iterable_item_removed", "root['x'][0]")]
    assert of([1, 2], [2, 1]) == [("values_changed", "root[0]"), ("values_changed", "root[1]")]
    assert of([[1], 2], [3, [1], 2]) == [("type_changes", "root[0]"), ("type_changes", "root[1]"), ("iterable_item_added", "root[2]")]
    assert of([1, True], [1, 1.0]) == [("type_changes", "root[1]")]
    assert of({"vars_used": ["a", "b", "a"]}, {"vars_used": ["b", "a", "c"]}) == [("iterable_item_added", "root['vars_used'][2]")]
    assert of({"unit": [["m"], "s"]}, {"unit": ["s", ["m"]]}, "astropy") == [] != of({"unit": [["m"], "s"]}, {"unit": ["s", ["m"]]}, "django")
    assert of([], [1]) == [("iterable_item_added", "root[0]")] and of(None, []) == [("type_changes", "root")]


def test_keep_entries(spark):
    rows = [("values_changed", "root['a']", "1", "2"), ("type_changes", "root['b']", "1", "null"), ("values_changed", None, "1", "2")]
    d = spark.createDataFrame(rows, "kind string, path string, old_value string, new_value string")
    left = structdiff.keep_entries(d, lambda kind, path, old, new: (kind == "type_changes") | (new == "2"))
    assert [r["path"] for r in left.orderBy("path").collect()] == ["root['a']", "root['b']"]
    assert structdiff.keep_entries(d, lambda kind, path, old, new: F.lit(None).cast("boolean")).count() == 0
