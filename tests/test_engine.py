"""Operators on literal inputs."""

import json
import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.engine import Engine
from quillspan.functions import extract, scalars, text
from quillspan.operators import aggregates, heads, lifecycle, rollups, search, threads, tree
from quillspan.plans import filters, limits, runs
from quillspan.schemas import DELETION, EVENT, FEEDBACK, HOUR

A, B = "a" * 32, "b" * 32


def event(span="r1", start=10, end=None, status=1, kind="end", attrs="{}", project="demo", trace=A, parent=None, run_id=None, name="agent.run", run_type="chain", row=0, key=None):
    return (project, trace, span, span if run_id is None else run_id, None, parent, name, run_type, kind, start, start + 1 if end is None else end, status, attrs if isinstance(attrs, str) else json.dumps(attrs), row, key)


def frame(spark, *events):
    return spark.createDataFrame(list(events), EVENT)


def engine(spark, *events, **kw):
    return Engine(spark, frame(spark, *events), **kw)


def spans(df):
    return sorted(r["span_id"] for r in df.collect())


# Versions


def test_latest_version_and_late_event(spark):
    e = frame(spark, event(start=10, end=0, kind="start"), event(start=20, end=0, kind="update", row=1), event(start=30, end=60, status=2, row=2, name="last"), event(start=5, end=15, row=3, name="late"))
    r = heads.latest(e).head()
    assert (r["status"], r["end_time_unix_nano"], r["name"]) == ("error", 60, "last")
    assert [x["row_index"] for x in heads.lineage(e).orderBy("sequence").collect()] == [0, 3, 1, 2]


def test_ties_and_statuses(spark):
    assert heads.latest(frame(spark, event(kind="update", name="a", row=0), event(kind="update", name="b", row=1))).head()["name"] == "b"
    assert heads.latest(frame(spark, event(status=2, end=0))).head()["status"] == "error"
    assert heads.latest(frame(spark, event(status=0, end=0))).head()["status"] == "pending"


def test_replay_ends_with_a_tombstone(spark):
    assert heads.replay(frame(spark, event(), event(start=50, kind="tombstone", row=1))).count() == 0


# Scalars


def test_uuid5_and_buckets(spark):
    r = spark.range(1).select(scalars.generated_run_id(F.lit("p"), F.lit("t"), F.lit("s")).alias("u"), scalars.bucket(F.lit(-1), 10).alias("b"), scalars.parse_rfc3339(F.lit("2024-01-02T03:04:05.123456789Z")).alias("t"), scalars.format_rfc3339(F.lit(1704164645123456789)).alias("f"), scalars.dotted_order(F.lit(5), F.lit("s")).alias("d")).head()
    assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "quillspan:run:p:t:s")) == scalars.run_id_of("p", "t", "s")
    assert r["b"] == -10
    assert r["t"] == 1704164645123456789
    assert r["f"] == "2024-01-02T03:04:05.123456789Z"
    assert r["d"] == "0" * 19 + "5.s"


@pytest.mark.parametrize("values,p,want", [([10, 20], 50, 20), ([1, 2, 3], 50, 2), ([], 50, None), (list(range(100)), 99, 99), (list(range(101)), 95, 95)])
def test_nearest_rank(spark, values, p, want):
    r = spark.range(1).select(scalars.nearest_rank(F.array(*[F.lit(v) for v in values]).cast("array<long>"), p).alias("x")).head()
    assert r["x"] == want


# Extraction


def one(spark, attrs, start=10):
    return extract.extracted(frame(spark, event(start=start, attrs=attrs))).head()


def test_measures(spark):
    r = one(spark, {"usage": {"input_tokens": "12", "output_tokens": 4}, "metrics": {"prompt_cost": 0.001, "completion_cost": "0.002", "first_token_latency": 0.25}, "score": "0.9", "model": " GPT-Test ", "provider": "Open-AI"})
    assert (r["prompt_tokens"], r["completion_tokens"], r["total_tokens"]) == (12, 4, 16)
    assert r["total_cost"] == pytest.approx(0.003)
    assert (r["first_token_latency_nanos"], r["evaluator_score"], r["model_name"], r["provider_name"]) == (250_000_000, 0.9, "gpt-test", "openai")


def test_unusable_measures_are_null(spark):
    r = one(spark, {"prompt_tokens": "nope", "completion_tokens": -1, "total_cost": "NaN", "first_token_time_unix_nano": 3, "score": {"x": 1}, "total_tokens": 1.5})
    assert [r[c] for c in ("prompt_tokens", "completion_tokens", "total_tokens", "total_cost", "first_token_latency_nanos", "evaluator_score")] == [None] * 6
    assert one(spark, "not json")["model_name"] is None
    assert one(spark, {"prompt_tokens": -5, "usage": {"prompt_tokens": 3}})["prompt_tokens"] == 3


def test_dotted_keys_tags_and_metadata(spark):
    r = one(spark, {"gen_ai.request.model": "M", "tags": ["b", "a", "a", "x" * 200], "metadata": {"thread_id": " t1 ", "temperature": 0.7, "large": "x" * 300, "nested": {}}})
    assert r["model_name"] == "m" and r["tags"] == ["a", "b"] and r["thread_id"] == "t1"
    assert [tuple(p) for p in r["metadata"]] == [("temperature", "0.7"), ("thread_id", " t1 ")]
    assert one(spark, {"tags": ["session_id=s", "thread:t"]})["thread_id"] == "t"


@pytest.mark.parametrize(
    "attrs,want",
    [
        ({"langsmith.inputs": {"messages": [{"content": "a"}, {"content": "b"}]}, "outputs": {"choices": [{"message": {"content": "c"}}]}, "error": "e"}, ("b", "c", "e")),
        ({"langsmith.inputs": {"prompt": "p"}, "langsmith.outputs": {"answer": "x"}}, ("p", '{"answer":"x"}', None)),
        ({"langsmith.inputs": None, "inputs": {"prompt": "p"}}, (None, None, None)),
        ({"input": "é" * 400}, ("é" * 256, None, None)),
        ({"input": [{"content": [{"text": "part"}]}], "error": {"message": "bad"}}, ("part", None, "bad")),
    ],
)
def test_previews(attrs, want):
    assert extract.preview(json.dumps(attrs)) == want


# Trees


def test_nested_sets_with_late_parent_and_orphan():
    nodes = {n[0]: n for n in tree.build([("child", "root", "c", 20), ("root", None, "r", 10), ("grand", "child", "g", 30), ("lone", "gone", "l", 40)])}
    assert [nodes[k][5] for k in ("root", "child", "grand", "lone")] == [0, 1, 2, 0]
    assert nodes["root"][9] == 2 and nodes["lone"][10] and nodes["grand"][3] == "root"
    assert nodes["root"][7:9] == (0, 5) and nodes["child"][7:9] == (1, 4) and nodes["grand"][7:9] == (2, 3)


def test_cycles_become_roots():
    nodes = {n[0]: n for n in tree.build([("a", "b", "a", 1), ("b", "a", "b", 2), ("c", "a", "c", 3), ("self", "self", "s", 4)])}
    assert nodes["a"][11] and nodes["b"][11] and nodes["self"][11] and not nodes["c"][11]
    assert nodes["c"][2] == "a" and nodes["a"][2] is None and nodes["b"][2] is None


def test_deep_trace_does_not_recurse():
    nodes = tree.build([("0", None, "0", 0)] + [(str(i), str(i - 1), str(i), i) for i in range(1, 3000)])
    assert max(n[5] for n in nodes) == 2999


def test_nested_and_children(spark):
    e = engine(spark, event("root", 10), event("x", 20, parent="root"), event("y", 15, parent="root"))
    (top,) = e.trace_tree("demo", A)
    assert [c["span_id"] for c in top["children"]] == ["y", "x"]
    page = runs.children(e.heads)
    assert {r["span_id"]: r["child_run_ids"] for r in page.collect()} == {"root": ["y", "x"], "x": [], "y": []}


# Filters


def test_documented_filters_parse():
    for s in ('eq(name, "a")', "and(eq(is_root, true), gt(latency, 5))", 'or(eq(run_type, "llm"), neq(status, \'error\'))', 'in(id, ["a", "b"])', 'has(tags, "x")', 'AND(eq(metadata_key, "k"), eq(metadata_value, "v"))', 'search("a b")', 'json_key_search(inputs, "a.b", "c")', 'gte(start_time, "2024-01-01T00:00:00Z")', "lt(total_cost, -.5)", 'contains(name, "a\\"b")'):
        filters.parse(s)


@pytest.mark.parametrize("bad", ['eq(name, "a") x', "eq(name)", 'eq(name, "a"', "and(", "nope(name, 1)", "eq(name, @)"])
def test_broken_filters(bad):
    with pytest.raises(filters.FilterError, match="invalid filter"):
        filters.parse(bad)


def test_filter_limits():
    deep = "and(" * 17 + 'eq(name, "a")' + ")" * 17
    with pytest.raises(filters.FilterError, match="nested"):
        filters.parse(deep)
    with pytest.raises(filters.FilterError, match="conditions"):
        filters.parse("or(" + ", ".join(['eq(name, "a")'] * 128) + ")")
    with pytest.raises(filters.FilterError, match="unsupported"):
        filters.parse('eq(colour, "a")')


@pytest.fixture(scope="module")
def shop(spark):
    meta = lambda **m: {"metadata": m}
    return engine(
        spark,
        event("r1", 10, attrs=meta(env="prod", team="x") | {"tags": ["t1"], "model": "m1"}, name="Alpha"),
        event("r2", 20, attrs=meta(env="dev", team="prod") | {"tags": ["t2"]}, name="beta", status=2),
        event("r3", 30, end=0, status=0, attrs={}, name="gamma", run_id=""),
        feedback_log=spark.createDataFrame([("f1", "r1", None, "demo", "q", "0.8", '"good"', None, None, None, None, 5, 5), ("f2", "r2", None, "other", "q", "0.9", None, None, None, None, None, 6, 6)], FEEDBACK),
    )


@pytest.mark.parametrize(
    "source,want",
    [
        ('eq(name, "Alpha")', ["r1"]),
        ('contains(name, "ALPH")', ["r1"]),
        ('neq(model, "zzz")', ["r1"]),  # null is no match
        ("eq(error, false)", ["r1", "r3"]),  # pending isn't an error
        ('and(eq(metadata_key, "env"), eq(metadata_value, "prod"))', ["r1"]),
        ('and(eq(metadata_key, "env"), neq(metadata_value, "prod"))', ["r2"]),
        ('neq(metadata_value, "prod")', ["r3"]),
        ('neq(metadata_key, "env")', ["r3"]),
        ('and(and(eq(metadata_key, "env"), eq(metadata_value, "dev")), and(eq(metadata_key, "team"), eq(metadata_value, "prod")))', ["r2"]),
        ('and(eq(metadata_key, "env"), eq(metadata_value, "dev"), eq(metadata_key, "team"), eq(metadata_value, "prod"))', []),  # one row can't be both
        ('or(has(tags, "t1"), has(tags, "t2"))', ["r1", "r2"]),
        ('neq(tags, "t1")', ["r2", "r3"]),
        ('and(eq(feedback_key, "q"), gt(feedback_score, 0.5))', ["r1"]),  # the other row is another project's
        ('neq(feedback_key, "q")', ["r2", "r3"]),
        ('or(eq(feedback_value, "good"), eq(name, "gamma"))', ["r1", "r3"]),
        ('eq(latency, "0.000000001s")', ["r1", "r2"]),
        (f'eq(id, "{scalars.run_id_of("demo", A, "r3")}")', ["r3"]),
        ('neq(id, "r1")', ["r2", "r3"]),
    ],
)
def test_filter_semantics(shop, source, want):
    assert spans(runs.select_runs(shop.heads, runs.RunQuery(["demo"], filter=source), filters.Context(shop.feedback))) == want


@pytest.mark.parametrize("source", ["and()", "in(name, [])", 'gt(tags, "a")', 'has(name, "x")', 'or(eq(name, "a"), search("b"))', 'gt(is_root, true)'])
def test_refused_filters(shop, source):
    with pytest.raises(filters.FilterError):
        filters.apply(shop.heads, source, shop.context())


def test_structured_filters():
    assert filters.structured({"field": "name", "operator": "!=", "value": "a"}) == 'neq(name, "a")'
    assert filters.structured({"operator": "or", "conditions": [{"field": "run_type", "operator": "is one of", "value": ["a", "b"]}, {"field": "error", "value": True}]}) == 'or(in(run_type, ["a", "b"]), eq(error, true))'


def test_tree_filters(spark):
    e = engine(spark, event("root", 10, name="R"), event("mid", 20, parent="root", name="M"), event("leaf", 30, parent="mid", name="L"), event("other", 10, trace=B, name="R"))
    go = lambda s: spans(filters.tree_filter(e.heads, e.tree, s))
    assert go('eq(name, "L")') == ["leaf", "mid", "root"]
    assert go('child(eq(name, "L"))') == ["mid"]
    assert go('descendant(eq(name, "L"))') == ["mid", "root"]
    assert go('root(eq(name, "R"))') == ["leaf", "mid", "other", "root"]
    assert go('filtered_only(eq(name, "L"))') == ["leaf"]
    assert go('most_relevant(eq(name, "M"))') == ["mid", "root"]
    assert go('filtered_only(child(eq(name, "L")))') == []
    assert go('most_relevant(descendant(eq(name, "L")))') == ["mid", "root"]
    assert spans(filters.trace_filter(e.heads, 'eq(name, "R")')) == ["leaf", "mid", "other", "root"]
    with pytest.raises(filters.FilterError):
        filters.trace_filter(e.heads, 'search("x")')


def test_forests_of_batches_equal_those_built_run_by_run():
    """Random traces with orphans, cycles, runs that hang on cycles and nulls, cut into batches anywhere."""
    rng = random.Random(7)
    for _ in range(100):
        rows = []
        for t in range(rng.randint(1, 6)):
            n = rng.randint(1, 12)
            rows += [(None if t == 5 else f"p{t // 2}", f"t{t}", f"s{i}", rng.choice([None, *[f"s{rng.randint(0, n + 1)}" for _ in range(3)]]), f"r{t}-{i}", rng.randint(0, 4), rng.random() < 0.3) for i in range(n)]
        rows.sort(key=lambda r: (r[0] or "", r[1], r[5], r[2]))
        batch = pa.table(dict(zip("abcdefg", zip(*rows)))).cast(pa.schema([(c, pa.string()) for c in "abcde"] + [("f", pa.int64()), ("g", pa.bool_())])).combine_chunks().to_batches()[0]
        cuts = sorted({0, len(rows), *[rng.randint(0, len(rows)) for _ in range(4)]})
        want = {(*t, n[0]): n for t in {r[:2] for r in rows} for n in tree.build([(r[2], r[3], r[4], r[5]) for r in rows if r[:2] == t])}
        seen = 0
        for whole in tree._whole(batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])):
            f, cells = tree.Forest(whole), whole.to_pylist()
            below = f.descendants()
            sibling, place = f.places(below)
            hit = whole.column(6).to_numpy(zero_copy_only=False)
            got = {name: test(f, hit) for name, test in tree.RELATIONS.items()}
            nodes = [want[c["a"], c["b"], c["c"]] for c in cells]
            seen += len(cells)
            for i, (c, n) in enumerate(zip(cells, nodes)):
                start = 2 * place[i] - f.depth[i]
                assert (c["d"] if f.up[i] >= 0 else None, cells[f.root[i]]["c"], f.depth[i], sibling[i], start, start + 2 * below[i] + 1, below[i], f.given[i] and not f.known[i], f.cycle[i]) == (n[2], n[3], *n[5:])
                mine = [(m, x["g"]) for m, x in zip(nodes, cells) if (x["a"], x["b"]) == (c["a"], c["b"])]
                child, under, root = any(h and m[2] == n[0] for m, h in mine), any(h and n[7] < m[7] < n[8] for m, h in mine), any(h and m[5] == 0 for m, h in mine)
                assert [bool(got[k][i]) for k in ("root", "child", "descendant", "own_root", "own_child", "self_or_descendant")] == [root, child, under, c["g"] and n[5] == 0, False, c["g"] or under]
        assert seen == len(rows)


@pytest.mark.parametrize("condition", ['eq(name, "L")', 'or(eq(is_root, true), eq(root_span_id, "x"))'])
def test_keys_without_a_stored_tree_equal_tree_filters(spark, condition):
    tree_of = [event("root", 10, name="R"), event("mid", 20, parent="root", name="M"), event("leaf", 30, parent="mid", name="L"), event("lone", 5, parent="gone", name="L"), event("x", 1, parent="y", trace=B, name="L"), event("y", 2, parent="x", trace=B, name="M"), event("z", 3, parent="x", trace=B, name="L"), event("self", 4, parent="self", trace=B, name="L")]
    e = engine(spark, *tree_of)
    plain = heads.latest(e.events).cache()
    stored, nodes = e.heads.cache(), e.tree.cache()
    for form in ("{}", "root({})", "descendant({})", "filtered_only(root({}))", "filtered_only(child({}))", "most_relevant({})"):
        source = form.format(condition)
        assert spans(filters.tree_keys(plain, source)) == spans(filters.tree_filter(stored, nodes, source)), source
    assert spans(filters.trace_keys(plain, condition)) == spans(filters.trace_filter(stored, condition))


def test_a_wide_trace_is_not_paired_with_itself(spark):
    """100,000 runs, each a hit below one of 300: pairs of all runs would be 10 billion."""
    rows = spark.range(100_000).selectExpr("'p' AS project_name", "'t' AS trace_id", "concat('s', id) AS span_id", "CASE WHEN id > 0 THEN concat('s', id % least(id, 300)) END AS parent_span_id", "true AS hit")
    assert tree.related(rows, "child").count() == 300
    assert tree.related(rows, "self_or_descendant").count() == 100_000


def test_only_traces_where_a_hit_can_count_are_linked(spark, monkeypatch):
    """30 traces of three runs have a hit, ten of them the root alone; ten traces have none. A relation that returns all shows what reaches Python."""
    rows = spark.range(120).selectExpr("'p' AS project_name", "concat('t', id div 3) AS trace_id", "concat('s', id % 3) AS span_id", "CASE WHEN id % 3 > 0 THEN 's0' END AS parent_span_id", "id % 3 = id div 30 AS hit")
    assert {r: tree.related(rows, r).count() for r in tree.RELATIONS} == {"root": 30, "child": 20, "descendant": 20, "own_root": 10, "own_child": 0, "self_or_descendant": 50}
    for relation in tree.RELATIONS:
        monkeypatch.setitem(tree.RELATIONS, relation, lambda f, hit: hit | ~hit)
    assert {r: tree.related(rows, r).count() for r in tree.RELATIONS} == {"root": 90, "child": 60, "descendant": 60, "own_root": 90, "own_child": 0, "self_or_descendant": 90}


# Pages


def test_pages(spark):
    e = engine(spark, *[event(f"s{i}", 10 * i) for i in range(1, 5)])
    got = lambda **k: [r["span_id"] for r in e.list_runs(runs.RunQuery(["demo"], **k)).collect()]
    assert got(limit=2, offset=2) == ["s3", "s4"] and got(limit=0) == [] and got(descending=True, limit=1) == ["s4"]
    assert got(cursor="nonsense", limit=1) == ["s1"] and got(start_min=20, start_max=30) == ["s2", "s3"]
    assert [r["span_id"] for r in e.runs_by_id(["s3", "s1"]).collect()] == ["s3", "s1"]
    assert e.list_runs(runs.RunQuery([])).count() == 0


def test_response_shape(spark):
    e = engine(spark, event("root", 10), event("kid", 20, parent="root", run_id="", end=0, status=0, attrs={"langsmith.inputs": {"a": 1}}))
    r = runs.response(e.heads.where("span_id = 'kid'")).head()
    assert r["parent_run_id"] == scalars.run_id_of("demo", A, "root") and r["end_time"] is None and r["inputs"] == '{"a":1}' and r["id"] == scalars.run_id_of("demo", A, "kid")


# Threads


def chat(spark, *more):
    turn = lambda span, start, trace, text: event(span, start, trace=trace, attrs={"metadata": {"thread_id": "t"}, "inputs": {"prompt": text}, "metrics": {"prompt_tokens": 3, "completion_tokens": 4, "total_cost": 0.01}})
    return engine(spark, turn("s1", 100, A, "first"), turn("s2", 200, B, "second"), *more)


def test_thread_summary_and_messages(spark):
    e = chat(spark)
    r = e.threads.head()
    assert (r["count"], r["first_trace_id"], r["last_trace_id"], r["first_inputs"], r["total_tokens"], r["num_errored_turns"]) == (2, A, B, "first", 14, 0)
    assert [(m["role"], m["preview"]) for m in e.list_messages("demo", "t").collect()] == [("user", "first"), ("user", "second")]


def test_thread_cursor_is_stable(spark):
    first = chat(spark).list_thread_traces("demo", "t", limit=1).head()
    later = chat(spark, event("s0", 50, trace="c" * 32, attrs={"metadata": {"thread_id": "t"}}))
    page = later.list_thread_traces("demo", "t", cursor=f"trace:{first['start_time_unix_nano']}:{first['trace_id']}")
    assert [r["trace_id"] for r in page.collect()] == [B]


def test_threads_page_window(spark):
    rows = threads.summaries(chat(spark).thread_traces)
    assert runs.thread_page(rows, start_min=201).count() == 0 and runs.thread_page(rows, start_min=150, start_max=150).count() == 1


# Aggregates


def test_aggregate_and_rollup(spark):
    attrs = lambda n, c: {"metrics": {"total_tokens": n, "total_cost": c}, "model": "m"}
    e = engine(spark, event("a", 10, attrs=attrs(15, 0.03), run_type="llm"), event("b", 20, attrs=attrs(30, 0.05), run_type="llm", status=2), event("c", 30, run_type="tool"))
    q = runs.RunQuery(["demo"], group_by=("project", "time_bucket", "run_type"))
    rolled, source = e.aggregate_runs(q)
    scanned, other = e.aggregate_runs(q, use_rollups=False)
    assert (source, other) == ("rollup", "scan")
    r = {x["group_value"]: x for x in rolled.collect()}["llm"]
    s = {x["run_type"]: x for x in scanned.collect()}["llm"]
    assert (r["count"], r["error_count"], r["total_tokens_sum"]) == (2, 1, 45) == (s["count"], s["error_count"], s["total_tokens_sum"])
    assert r["total_cost_sum"] == pytest.approx(0.08) and r["latency_p95"] == s["latency_nanos_p95"]
    assert e.aggregate_runs(runs.RunQuery(["nobody"]))[0].count() == 0
    assert {(x["field"], x["distinct_values"]) for x in e.stats().collect()} == {("run_type", 2), ("model_name", 1)}


def test_conditions_that_rollups_do_not_hold_go_to_the_scan(spark):
    q = lambda **k: runs.RunQuery(["p"], group_by=("project", "time_bucket"), **k)
    assert not runs.beyond_rollups(q(run_type="llm", error=True, start_min=0, limit=5, cursor="3"))
    for k in ({"parent_run_id": "r"}, {"parent_span_id": "s"}, {"trace_id": "t"}, {"filter": "eq(name, 1)"}, {"is_root": False}, {"feedback_keys": ("k",)}, {"retention_cutoff": 0}):
        assert runs.beyond_rollups(q(**k)), k


def test_pages_give_cursors(spark):
    rows = spark.createDataFrame([("p", "th", f"t{i}", i) for i in range(5)], "project_name string, thread_id string, trace_id string, start_time_unix_nano long")
    seen, cursor = [], None
    for _ in range(3):
        got = runs.trace_page(rows, limit=2, cursor=cursor).collect()
        seen += [r["trace_id"] for r in got]
        cursor = got[-1]["next_cursor"]
    assert seen == ["t0", "t1", "t2", "t3", "t4"] and cursor is None
    assert runs.trace_page(rows, limit=5).where("next_cursor IS NOT NULL").count() == 0


def test_run_within_limits_notes_counters(spark):
    counters = limits.Counters(slow_seconds=0.0)
    rows, found = limits.run(spark.range(5), "five", limits.Limits(runs=5), counters)
    assert len(rows) == 5 and found.rows == 5 and found.seconds > 0 and (counters.queries, counters.slow, counters.rejected) == (1, 1, 0)
    with pytest.raises(limits.QueryRejected, match="runs"):
        limits.run(spark.range(6), "six", limits.Limits(runs=5), counters)
    assert (counters.queries, counters.rejected) == (2, 1)


def test_cycles_in_long_chains_take_linear_time():
    import time

    chain = {f"s{i}": f"s{i + 1}" for i in range(200_000)} | {"s200000": None}
    began = time.monotonic()
    assert tree._on_cycles(chain) == set()
    assert tree._on_cycles({**chain, "s200000": "s199998"}) == {"s199998", "s199999", "s200000"}
    assert time.monotonic() - began < 10
    assert tree._on_cycles({"a": "a", "b": "a", "c": "x", "d": "e", "e": "d"}) == {"a", "d", "e"}


def test_percentiles_of_large_groups_match_sorting(spark):
    import random

    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([0.0, -1.5, rnd.lognormvariate(0, 30), -rnd.lognormvariate(3, 2), float(rnd.randrange(5))])) for _ in range(3000)] + [("c", 7.0)]
    got = {r["k"]: r for r in aggregates.sorted_percentiles(spark.createDataFrame(data, "k string, x double"), ["k"], ["x"]).collect()}
    for k in ("a", "b", None, "c"):
        v = sorted(x for g, x in data if g == k)
        for p in (50, 95, 99):
            assert got[k][f"x_p{p}"] == v[((len(v) - 1) * p + 99) // 100], (k, p)


def test_rollup_eligibility():
    ok = ("project", "time_bucket", "run_type")
    assert rollups.eligible(ok, HOUR, run_type="llm") == "run_type"
    assert rollups.eligible(ok, HOUR, error=True) is None
    assert rollups.eligible(ok, HOUR, start_min=0, start_max=HOUR - 1) == "run_type"
    assert rollups.eligible(ok, HOUR, start_min=1) is None and rollups.eligible(ok, 60) is None
    assert rollups.eligible(ok, HOUR, filtered=True) is None and rollups.eligible(("project",), HOUR) is None


def test_feedback_aggregates(shop):
    r = aggregates.aggregate(shop.heads, ("feedback_key",), feedback=shop.feedback).head()
    assert (r["feedback_key"], r["count"], r["feedback_score_p50"], r["score_0_75_to_1"]) == ("q", 1, 0.8, 1)
    r = aggregates.aggregate(shop.heads, (), feedback=shop.feedback, feedback_keys=["q"]).head()
    assert r["count"] == 3 and r["feedback"]["q"]["feedback_score_count"] == 1
    with pytest.raises(ValueError):
        aggregates.aggregate(shop.heads, ("time_bucket",), bucket=0)


def test_feedback_is_upserted(spark):
    row = lambda score, created, modified: ("f", "r", None, "demo", "k", score, None, None, None, None, None, created, modified)
    e = engine(spark, event(), feedback_log=spark.createDataFrame([row("1", 5, 5), row('"0.5"', 9, 9)], FEEDBACK))
    (r,) = e.list_feedback(keys=["k"]).collect()
    assert (r["score_number"], r["created_at_unix_nano"]) == (0.5, 5)
    assert e.list_feedback(score_min=0.6).count() == 0


# Search


@pytest.fixture(scope="module")
def library(spark):
    return engine(spark, event("r1", attrs={"inputs": {"messages": [{"content": "hello invoice"}, {"content": "world peace"}]}, "n": 5}), event("r2", 20, attrs={"outputs": {"text": "Pay the Invoice number 77 today"}, "meta": {"a": None}}))


@pytest.mark.parametrize(
    "source,want",
    [
        ('search("invoice")', ["r1", "r2"]),
        ('search(inputs, "invoice world")', ["r1"]),
        ('search("\\"hello invoice\\"")', ["r1"]),
        ('search("\\"invoice world\\"")', []),  # a phrase doesn't run over array elements
        ('search("\\"pay the invoice\\"")', ["r2"]),  # stop words don't count
        ('search("the")', []),
        ('does_not_contain(inputs, "world")', ["r2"]),
        ('eq(outputs, "invoice")', []),
        ('eq(attributes_json, "5")', ["r1"]),
        ('neq(attributes_json, "5")', ["r2"]),
        ('json_key("inputs.messages.content")', ["r1"]),
        ('json_key("inputs")', []),  # leaves only
        ('json_key("*.text")', ["r2"]),
        ('json_key("meta.a")', ["r2"]),
        ('json_key_search("outputs.text", "number")', ["r2"]),
        ('search(name, "agent")', ["r1", "r2"]),
        ('and(search("invoice"), eq(name, "agent.run"), not_contains(inputs, "hello"))', ["r2"]),
    ],
)
def test_search(library, source, want):
    assert spans(filters.apply(library.heads, source, library.context())) == want


def test_tokens_leaves_and_wildcards(spark):
    assert text.tokenise("The Quick, brown-fox 123 a") == ["quick", "brown", "fox", "123"]
    assert spark.range(1).select(text.tokens(F.lit("The Quick, brown-fox 123 a é"))).head()[0] == ["quick", "brown", "fox", "123"]
    many = text.leaves_of(json.dumps({f"k{i}": i for i in range(266)}))
    assert len(many) == 256 and many[255][0] == "k255"
    paths = ["abab", "ab", "axb", "a", "inputs.x", "aXbYb"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for pattern in ("a*b", "*", "inp*", "*x", "a%", "ab"):
        got = {r[0] for r in df.where(search.path_test(F.col("path"), pattern)).collect()}
        assert got == {p for p in paths if text.wildcard(p, pattern)}, pattern
    assert not text.wildcard("abab", "a*b") and text.wildcard("axb", "a*b")


def test_payloads_reach_python_in_small_batches(spark):
    """An Arrow batch holds 10,000 payloads; a pickled one 100, so Python's memory doesn't grow with a partition."""
    payload = json.dumps({"inputs": {"prompt": "x" * 3000}, "n": [1, 2.5, None, {}, "\ud800"]})
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "{").otherwise(payload).alias("attributes_json"))
    found = df.select(text.leaves("attributes_json").alias("l"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert found.groupBy(F.size("l").alias("n")).count().sort("n").collect() == [(0, 200), (6, 100)]
    assert [r["value"] for r in found.where("size(l) > 0").head()["l"]][1:5] == ["1", "2.5", None, None]


def test_index_is_required(library):
    with pytest.raises(filters.FilterError, match="search index"):
        filters.apply(library.heads, 'search("a")')


# Lifecycle


def test_deletes_are_sticky(spark):
    gone = spark.createDataFrame([("demo", A, "r1", 99, "x")], DELETION)
    e = engine(spark, event("r1", 10), event("r1", 500, row=9), event("r2", 20), deletions=gone)
    assert spans(e.heads) == ["r2"]
    assert spans(e.list_runs(runs.RunQuery(["demo"], include_deleted=True))) == ["r1", "r2"]
    assert spans(e.compact().all_heads) == ["r2"]
    assert spans(e.delete(F.col("span_id") == "r2", 7).heads) == []


def test_retention(spark):
    e = engine(spark, event("old", 10), event("new", 40))
    kept = e.enforce_retention(spark.createDataFrame([("demo", 20)], "project_name string, ttl_nanos long"), 50)
    assert spans(kept.heads) == ["new"]
    assert spans(lifecycle.within_retention(e.heads, 40)) == ["new"]


def test_store_and_limits(spark, tmp_path):
    from quillspan.sources import store

    path = str(tmp_path / "log")
    store.write_events(store.synthetic(spark, 20), path, segment_rows=50)
    back = store.read_events(spark, path)
    assert back.count() == 160 and store.segments(spark, path).agg(F.sum("rows")).head()[0] == 160
    with pytest.raises(limits.QueryRejected, match="files"):
        limits.enforce(back, limits.Limits(files=1))
    assert limits.enforce(back, limits.Limits()).estimated_requests == 48 * len(back.inputFiles())
    assert lifecycle.compactable(store.segments(spark, path)).count() >= 1
    stored = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r[0] for r in lifecycle.orphans(stored, stored.where("path = 'a'")).collect()] == ["b"]


def test_wall_time(spark):
    with pytest.raises(limits.QueryRejected, match="wall time"):
        limits.timed(spark.range(1 << 33).select(F.sum(F.xxhash64("id") % 7)), 1.0, lambda df: df.collect())
    assert limits.timed(spark.range(3), None, lambda df: df.count()) == 3


# Sources and streaming


def test_otlp(spark):
    from quillspan.sources import otlp

    export = {
        "project_name": "p",
        "resourceSpans": [{"resource": {"attributes": [{"key": "service", "value": {"stringValue": 'q"x'}}, {"key": "own", "value": {"intValue": 1}}]},
            "scopeSpans": [{"spans": [
                {"traceId": bytearray(b"\x01" * 16), "spanId": bytearray(b"\x02" * 8), "name": "Call LLM", "startTimeUnixNano": 5, "endTimeUnixNano": 9, "attributes": [{"key": "resource.own", "value": {"doubleValue": 1.5}}, {"key": "b", "value": {"bytesValue": bytearray(b"\xff")}}], "status": {"code": 1}},
                {"traceId": bytearray(16), "spanId": bytearray(b"\x02" * 8), "name": "x", "startTimeUnixNano": 5, "endTimeUnixNano": 0, "attributes": [], "status": None},
            ]}]}],
    }
    good, bad = otlp.flatten(spark.createDataFrame([export], otlp.EXPORT)).orderBy("rejected").collect()
    assert bad["rejected"] and bad["event_type"] == "start" and not good["rejected"]
    assert (good["trace_id"], good["run_type"], good["event_type"]) == ("01" * 16, "llm", "end")
    assert json.loads(good["attributes_json"]) == {"resource.service": 'q"x', "resource.own": 1.5, "b": "ff"}


def test_patches_fold(spark):
    from quillspan.sources import writes

    rows = [("p", A, "s", "r", None, None, "n", "llm", 5, None, '{"q":1}', None, None, None, None, None, 1), ("p", A, "s", None, None, None, None, None, None, 9, None, '{"a":2}', None, None, None, None, 2), ("p", A, "s", None, None, None, None, None, None, None, None, None, None, None, None, '"boom"', 3)]
    out = writes.fold(spark.createDataFrame(rows, writes.PATCH)).orderBy("row_index").collect()
    assert [(r["event_type"], r["status_code"]) for r in out] == [("start", 0), ("end", 1), ("end", 2)]
    assert json.loads(out[1]["attributes_json"]) == {"langsmith.inputs": {"q": 1}, "langsmith.outputs": {"a": 2}}


def test_stream_is_idempotent_and_repairs_trees(spark, tmp_path):
    from quillspan.streaming import ingest

    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    seen = {}

    def keep(refreshed, number):
        seen[number] = {r["span_id"]: r["root_span_id"] for r in refreshed.collect()}

    schema = frame(spark).schema
    for n, batch in enumerate(([event("kid", 20, parent="root"), event("kid", 20, parent="root")], [event("root", 10), event("kid", 20, parent="root")])):
        frame(spark, *batch).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / "cp"), then=keep).awaitTermination()
    log = spark.read.parquet(f"{root}/log")
    assert log.count() == 2  # retries within and across batches are one event
    assert seen[max(seen)] == {"kid": "root", "root": "root"}
    bounded = ingest.bounded_dedup(spark.readStream.schema(schema).parquet(source))
    assert bounded.isStreaming and ingest.hourly(spark.readStream.schema(schema).parquet(source)).isStreaming
