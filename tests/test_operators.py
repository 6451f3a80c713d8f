import json
import os

import pytest
from pyspark.sql import functions as F

from velarium import session
from velarium.functions import numbers
from velarium.operators import aggregates, audit, graph, joins, metrics, rewards, sets, shaping, sqlrewards, windows
from velarium.sources import loaders, sinks
from velarium.streaming import logs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components_chain_and_star(spark):
    e = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (7, 3)]
    got = dict(rows(graph.components(spark.createDataFrame(e, "a int, b int"), "a", "b")))
    assert {got[i] for i in range(1, 41)} == {1}
    assert {got[i] for i in range(100, 130)} == {100}
    assert got[200] == 200


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_simple_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert [r[2] for r in rows(graph.simple_paths(e, 3))] == [["a", "b", "c"], ["a", "b", "c", "d"], ["b", "c", "d"]]


def test_interval_overlap_across_bins(spark):
    a = spark.createDataFrame([("d", 0, 5000), ("d", 5000, 5001)], "k string, s int, e int")
    b = spark.createDataFrame([("d", 4000, 6000), ("x", 0, 9)], "k string, s int, e int")
    got = joins.interval_overlap(a, b, "k", "s", "e").select("s", "s_r")
    assert rows(got) == [(0, 4000), (5000, 4000)]


def test_sharing_equals_brute_force(spark):
    import random

    r = random.Random(3)
    sets_ = {i: [f"w{r.randint(0, 12)}" for _ in range(r.randint(0, 8))] for i in range(60)}
    df = spark.createDataFrame([(i, s) for i, s in sets_.items()], "id int, a array<string>")
    want = sorted((i, j, len(set(sets_[i]) & set(sets_[j]))) for i in sets_ for j in sets_ if i < j and len(set(sets_[i]) & set(sets_[j])) >= 3)
    assert sorted(map(tuple, joins.sharing(df, "id", F.col("a"), 3).collect())) == want


def test_order_position_is_a_permutation(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("s"))
    got = windows.order_position(df, F.col("s"), "id").orderBy("rank0").collect()
    assert [r.rank0 for r in got] == list(range(1000))
    assert [(r.s, r.id) for r in got] == sorted((r.s, r.id) for r in got)


def test_upsert_replaces_and_children_do_not_double(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert rows(sets.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), "id")) == [(1, "a"), (2, "c"), (3, "d")]
    c = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert rows(sets.upsert_children(c, c.where("id = 2"), "id")) == [(1, "x"), (2, "y")]


def test_same_rows(spark):
    a = spark.createDataFrame([(1, 0.1), (1, 0.1)], "a int, b double")
    assert sets.same_rows(a, a) and not sets.same_rows(a, a.distinct())
    assert sets.same_rows_any_order(a, a.select("b", "a"))


@pytest.mark.parametrize("name,want", [("train_sft", "train"), ("eval", "validation"), ("test", "test"), ("extra", "extra")])
def test_split_name(name, want):
    assert sets.split_name(name) == want


def test_make_splits_part_all_rows(spark):
    df = spark.range(500)
    s = sets.make_splits(df, "id")
    assert sum(x.count() for x in s.values()) == 500 and set(s) == {"train", "validation", "test"}
    assert set(sets.make_splits(spark.range(2), "id")) == {"train"}


def test_processors(spark):
    assert shaping.processor_by_name("some/hh-rlhf") == "preference_marker"
    assert shaping.processor_by_columns(spark.createDataFrame([("a", "b")], "chosen string, rejected string")) == "preference"
    with pytest.raises(ValueError):
        shaping.mapped(spark.range(1), required=("prompt",))
    assert shaping.mapped(spark.range(1).withColumnRenamed("id", "question"), required=("prompt",)).columns == ["prompt"]


def test_split_preference(spark):
    df = spark.createDataFrame([("\n\nHuman: hi\n\nAssistant: a\n\nHuman: x\n\nAssistant: good", "\n\nHuman: hi\n\nAssistant: bad")], "c string, r string")
    assert tuple(df.select(*shaping.split_preference(F.col("c"), F.col("r"))).head()) == ("\n\nHuman: hi\n\nAssistant:", "good", "bad")


def test_fold_tool_turns(spark):
    m = [("system", "s"), ("user", "u"), ("tool", "t"), ("assistant", "a")]
    df = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    assert [tuple(x) for x in df.select(shaping.fold_tool_turns(F.col("m"))).head()[0]] == [("system", "s"), ("user", "u\n\nt"), ("assistant", "a")]


def test_reward_tiers_and_composition(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "n int")
    assert [r[0] for r in df.select(rewards.search_grounding(F.col("n"))).collect()] == [0.0, 0.2, 0.3]
    c = rewards.composed({"a": (F.lit(1.0), 1.0), "b": (F.lit(None).cast("double"), 3.0)})
    assert spark.range(1).select(c).head()[0] == 0.25
    with pytest.raises(ValueError):
        rewards.composed({"a": (F.lit(1.0), 0.0)})


def test_aggregates_of_empty_tables(spark):
    e = spark.createDataFrame([], "k string, v double")
    assert aggregates.index_percentiles(e, ["k"], "v").count() == 0
    assert aggregates.distribution(e, "k").count() == 0


def test_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"a;b"\n')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "c.json").write_text('[{"x": 1}, {"x": 2}, {"x": 3}]')
    assert tuple(loaders.load(spark, str(tmp_path / "a.csv"), delimiter=";").head()) == (1, "a;b")
    assert loaders.load(spark, str(tmp_path / "b.jsonl")).count() == 2
    assert loaders.load(spark, str(tmp_path / "c.json")).count() == 3
    assert set(loaders.load(spark, str(tmp_path))) == {"a", "b", "c"}
    with pytest.raises(ValueError):
        loaders.load(spark, "some/hub-name")


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "p.html").write_text("<title>T</title><script>no</script><p>seen</p><nav>no</nav>")
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "n.md").write_text("# head")
    (tmp_path / "bad.json").write_text("{")
    got = {r.doc_id: r.text for r in loaders.documents(spark, str(tmp_path)).collect()}
    assert got.pop("bad") is None
    assert got == {"p": "seen", "r::row0": "a: 1\nb: 2", "r::row1": "a: 3\nb: 4", "n": "# head"}


def test_squad_contracts(spark, tmp_path):
    qa = {"id": "T__Parties_1", "question": "q", "answers": [{"text": "x", "answer_start": 0}]}
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"title": "T", "paragraphs": [{"context": "x y", "qas": [qa]}]}]}))
    r = loaders.squad_contracts(spark, str(tmp_path / "a.json")).head()
    assert (r.category, r.text, r.question_id) == ("Parties", "x y", "T__Parties_1")
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"title": "T", "paragraphs": []}]}))
    with pytest.raises(Exception, match="not one paragraph"):
        loaders.squad_contracts(spark, str(tmp_path / "b.json")).collect()


def test_log_readers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert rows(loaders.audit_log(spark, str(tmp_path / "l.jsonl"), "a int")) == [(1,), (2,)]
    (tmp_path / "t.jsonl").write_text('{"input": "i", "label": "l"}\nplain\n[1]\n')
    assert rows(loaders.labelled_lines(spark, str(tmp_path / "t.jsonl"))) == sorted([("i", "l"), ("plain", None), ("[1]", None)], key=repr)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], 0.5)], "id int, a array<int>, reward double")
    sinks.dump(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d.parquet")).count() == 1 and spark.read.option("header", True).csv(str(tmp_path / "d.csv")).head().a == "[1,2]"
    sinks.append_jsonl(df, str(tmp_path / "j"), keep_reward=False)
    sinks.append_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(repr, (r.reward for r in spark.read.json(str(tmp_path / "j")).collect()))) == ["0.5", "None"]
    done = sinks.resumable(spark.range(3), str(tmp_path / "w"), "id", lambda x: x.withColumn("y", F.col("id") * 2))
    assert done.count() == 3
    assert sinks.resumable(spark.range(5), str(tmp_path / "w"), "id", lambda x: x.withColumn("y", F.col("id") * 2)).count() == 5
    sinks.provenance(str(tmp_path / "d"), rows=1)
    assert sinks.provenance(str(tmp_path / "e"), parent=str(tmp_path / "d"))["parent_provenance"]["rows"] == 1


def test_session_facade(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert session.register(spark, str(tmp_path)) == ["t"]
    assert session.query(spark, "SELECT count(*) FROM t;").head()[0] == 3
    for bad in ("DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)"):
        with pytest.raises(ValueError):
            session.query(spark, bad)
    assert session.reads_no_table(spark, "SELECT 1") and not session.reads_no_table(spark, "SELECT * FROM t")


def log_line(t, stage, kind="llm", status="ok", score=None, at=0):
    return json.dumps({"trajectory_id": t, "stage_name": stage, "stage_type": kind, "status": status, "score": score, "ts": f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}Z", "state_snapshot": "{}"})


def test_loop_counts_live_across_batches(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text("\n".join(log_line("t", "s") for _ in range(3)))
    run = lambda: logs.drain(logs.loops(logs.valid(logs.tail(spark, str(src)))), out, str(tmp_path / "cp"))
    run()
    assert not os.path.isdir(out) or spark.read.parquet(out).count() == 0
    (src / "2.json").write_text("\n".join([log_line("t", "s"), log_line("u", "s"), "broken"]))
    run()
    assert rows(spark.read.parquet(out)) == [("t", "s", "loop", 4)]


def test_drift_and_diversity_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(log_line("t", "s", "llm_judge", score=0.9 if i < 50 else 0.1, at=i) for i in range(100)))
    logs.drain(logs.drifts(logs.tail(spark, str(src))), str(tmp_path / "o"), str(tmp_path / "c"))
    r = spark.read.parquet(str(tmp_path / "o")).collect()
    assert len(r) == 1 and r[0].drifted and r[0].n == 100
    logs.drain(logs.diversity(logs.tail(spark, str(src))), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).head().ratio == 0.01


def test_fan_out_and_buffer(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(log_line("t", "s", "tool_call", "error", at=i) for i in range(5)))
    seen = []
    s = logs.crashes(logs.tail(spark, str(src)))
    logs.drain(s, "", str(tmp_path / "c"), sinks.fan_out(logs.buffered(str(tmp_path / "b"), 3), lambda df, n: seen.append(df.count())))
    assert seen == [5] and spark.read.parquet(str(tmp_path / "b" / "now")).count() == 3


def test_windows_drop_what_is_too_late(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    w = lambda: logs.drain(logs.windowed(logs.tail(spark, str(src)), "1 minute", late="1 minute"), str(tmp_path / "o"), str(tmp_path / "c"))
    (src / "1.json").write_text("\n".join([log_line("t", "s", at=5), log_line("t", "s", at=600)]))
    w()
    (src / "2.json").write_text("\n".join([log_line("t", "s", at=6), log_line("t", "s", at=1200)]))
    w()
    got = {(r.start.minute, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert (0, 1) in got and (0, 2) not in got


def test_entities_and_keyphrases_of_every_chunk(spark, tmp_path):
    from velarium.plans.more import flt12_entities_and_keyphrases

    many = [f" Name{i} " for i in range(14)]
    c = [("a", ["Agreement", *many, None, ""], [f"K{i}" for i in range(8)]), ("b", ["Acme Services Agreement", "PARTY", "x", "y", "x"], None), ("c", None, ["k ", None]), ("b", ["Acme Services Agreement", "PARTY", "x", "y", "x"], None)]
    spark.createDataFrame(c, "chunk_id string, entities array<string>, keyphrases array<string>").write.parquet(str(tmp_path / "chunks.parquet"))
    got = rows(flt12_entities_and_keyphrases(spark, str(tmp_path)))
    assert got == [("a", [f"name{i}" for i in range(12)], [f"k{i}" for i in range(6)]), ("b", ["acme services agreement", "x", "y", "x"], []), ("c", [], ["k"])]


def test_evidence_notes_equal_brute_force(spark, tmp_path):
    import random
    import re

    from velarium.operators import evaluation
    from velarium.plans.more import stx25_evidence_notes

    head = re.compile(r"\[chunk_id=(\S+)\s+doc_id=(\S+)\s+score=([\d.]+)\]")
    cap = lambda t, n: t[:n].rsplit(" ", 1)[0] + "…" if len(t) > n else t

    def notes(t):
        p = head.split(t)
        if "No results found" in p[0]:
            return "No results found."
        out = [f"evidence[chunk_id={p[i]} doc_id={p[i + 1]} score={p[i + 2]}]: " + cap(re.split(r"(?<=[.!?])\s|\n", p[i + 3].strip(), maxsplit=1)[0].strip(), 300) for i in range(1, len(p), 4)]
        return "\n".join(out[:5]) or cap(t.strip(), 1500)

    rng = random.Random(4)
    parts = ["[chunk_id=d::1 doc_id=d score=0.5]", "[chunk_id=x\n doc_id=y score=1.]", "[chunk_id=cut doc", "\n", "\r\n", " ", "A line. ", "B!\n", "1.5 ", "word " * 80, "w" * 320, "é…\u00a0", "No results found"]
    texts = ["".join(rng.choices(parts, [4, 2, 1, 3, 1, 3, 3, 2, 2, 1, 1, 1, 0.1], k=rng.randint(0, 30))) for _ in range(300)] + ["word " * 400, "", "a\nb. c"]
    spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "tool_call_id long, result string").write.parquet(str(tmp_path / "tool_calls.parquet"))
    assert dict(rows(stx25_evidence_notes(spark, str(tmp_path)))) == {i: notes(t) for i, t in enumerate(texts)}
    one = spark.createDataFrame([("First\nline ends. Next",)], "t string").select(evaluation.first_sentence(F.col("t"), 300))
    assert one.head()[0] == "First\nline ends."


def test_unreadable_files_are_reported(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(b"no archive")
    r = loaders.documents(spark, str(tmp_path)).collect()
    assert [(x.doc_id, x.text) for x in r] == [("x", None)] and "BadZipFile" in r[0].metadata_json


def test_buffer_counts_drains_and_tells_new_kinds(spark, tmp_path):
    b = logs.Buffer(spark, str(tmp_path / "b"), capacity=3)
    assert b.drain() == [] and b.type_counts() == {} and b.novel() == set()
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "failure string").coalesce(1)
    b.sink(rows("loop", "crash"), 0)
    b.sink(rows("loop", "loop"), 1)
    b.sink(rows("loop", "loop"), 1)  # a repeated batch
    assert b.type_counts() == {"loop": 2, "crash": 1} and b.novel() == {"loop", "crash"}
    assert [r["failure"] for r in b.drain()] == ["crash", "loop", "loop"] and b.type_counts() == {}
    b.sink(rows("loop", "drift"), 2)
    assert b.novel() == {"drift"}


def test_rows_in_order(spark):
    a = spark.range(100).repartition(7).orderBy("id")
    assert sqlrewards.same_rows_in_order(a, spark.range(100).orderBy("id"))
    assert not sqlrewards.same_rows_in_order(a, spark.range(100).orderBy(F.desc("id"))) and not sqlrewards.same_rows_in_order(a, spark.range(99).orderBy("id"))


def test_turns_of_several_calls_are_parted(spark):
    import json

    call = lambda i: {"id": i, "name": "f"}
    chat = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "t", "tool_calls": [call("a"), call("b")]}, {"role": "tool", "tool_call_id": "b", "content": "rb"}, {"role": "tool", "content": "loose"}, {"role": "tool", "content": "rest"}, {"role": "assistant", "content": "end"}]
    df = spark.createDataFrame([(json.dumps(chat),), ("no chat",), (None,)], "m string")
    got = [r.x for r in df.select(shaping.single_calls(F.col("m")).alias("x")).collect()]
    turns = json.loads(got[0])
    assert [(m["role"], m.get("content"), len(m.get("tool_calls", []))) for m in turns] == [("user", "q", 0), ("assistant", "t", 1), ("tool", "loose", 0), ("assistant", "", 1), ("tool", "rb", 0), ("tool", "rest", 0), ("assistant", "end", 0)]
    assert got[1:] == ["no chat", None]


def test_islands_over_ranges_equal_a_plain_pass(spark):
    import random

    rng = random.Random(1)
    rows = [(i * 3, rng.choice(["a", "a", "b", None])) for i in range(400)]
    got = {r.line: r.island for r in audit.islands(spark.createDataFrame(rows, "line bigint, v string"), "line", "v", width=50).collect()}
    want, n = {}, 0
    for k, (line, v) in enumerate(rows):
        n += k == 0 or v != rows[k - 1][1]
        want[line] = n
    assert got == want
    assert audit.islands(spark.createDataFrame([], "line bigint, v string"), "line", "v").count() == 0


def test_audit_rows(spark):
    log = spark.createDataFrame([(0, "p", "s", "llm_judge", 8.0), (1, "p", "s", "llm", None), (2, "q", "s", "llm", None), (3, "p", "s", "llm", None), (4, "p", "t", None, None)], "line bigint, pipeline_id string, stage_id string, stage_type string, score double")
    log = log.withColumns({"iteration": F.lit(None).cast("int"), "input": F.lit("i"), "output": F.lit(None).cast("string")})
    assert sorted((r.island, r.pipeline_id, r.n_steps, r.reward) for r in audit.audit_trajectories(log, "s").collect()) == [(1, "p", 2, 0.8), (2, "q", 1, 0.0), (3, "p", 1, 0.0)]
    e = spark.createDataFrame([("a", "i", "o", "Approve", None), ("b", "i", "o", None, 12.0)], "pipeline_id string, input string, output string, verdict string, score double")
    assert [r.label for r in audit.episode_records(e, "bco").orderBy("pipeline_id").collect()] == [1, 0]
    assert [r.reward for r in audit.episode_records(e, "rloo").orderBy("pipeline_id").collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        audit.episode_records(e, "sft")


def test_amounts(spark):
    got = spark.createDataFrame([("$1,234.5 (2,000) -$5 12% 3.2B 5th $10-$20 7k",)], "t string").select(numbers.amounts_in(F.col("t")).alias("a")).head().a
    assert got == [1234.5, -2000.0, -5.0, 0.12, 3.2e9, 5.0, 10.0, 20.0, 7000.0]


def test_readers_of_trajectories_and_questions(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"task": "x", "steps": [{"step_number": 1, "action": {"name": "f"}}]}\nbroken\n{"task": "y", "reward": 0.5}\n')
    r = loaders.trajectory_lines(spark, str(tmp_path / "t.jsonl")).orderBy("task").collect()
    assert [(x.task, x.reward, len(x.steps)) for x in r] == [("x", 0.0, 1), ("y", 0.5, 0)] and '"f"' in r[0].steps[0].action
    (tmp_path / "q.json").write_text('{"rows": [{"question": "a"}, {"question": "b"}]}')
    (tmp_path / "q.jsonl").write_text('{"question": "c"}\n')
    assert sorted(x.question for x in loaders.qa_rows(spark, str(tmp_path / "q.json")).collect()) == ["a", "b"]
    assert [x.question for x in loaders.qa_rows(spark, str(tmp_path / "q.jsonl")).collect()] == ["c"]
    c = loaders.corpus_from(spark.createDataFrame([("a", 1), (" ", 2), (None, 3)], "body string, n int"), "body")
    assert [(x.text, len(x.doc_id)) for x in c.collect()] == [("a", 40)]


def test_memory_is_read_through_its_links(spark):
    items = spark.createDataFrame([(1, "A Lease", "s", 5), (2, "b", "s", 1), (3, "c", "s", 9), (4, None, "s", 9), (5, "e", "t", 7)], "id int, content string, scope string, ts int")
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 5), (3, 1)], "src int, dst int")
    assert [r.id for r in graph.recall_linked(items, links, "lease", 5, 2).collect()] == [3, 5, 2]
    assert [r.id for r in graph.recall_linked(items, links, "lease", 5, 2, scope="s").collect()] == [3, 2]


def test_paths_keep_the_first_of_each_pair(spark):
    e = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (3, 4), (4, 5), (5, 5)], "src int, dst int")
    got = {(r.src, r.dst, tuple(r.path)) for r in graph.simple_paths(e, 3).collect()}
    assert (1, 4, (1, 2, 4)) in got and (1, 5, (1, 3, 4, 5)) in got and not any(len(set(p)) < len(p) for _, _, p in got)
    assert {(r.src, r.dst, tuple(r.path)) for r in graph.simple_paths(e, 2, per_pair=1).collect() if r.dst == 4} >= {(1, 4, (1, 2, 4))}


def test_values_at_positions_equal_sorting(spark):
    import random

    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 5) * 1.0, rng.random()])) for _ in range(3000)] + [("one", 2.0), ("none", None)]
    got = {r.k: (r.p50, r.p95) for r in aggregates.index_percentiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    want = {}
    for k in ("a", "b", None, "one"):
        v = sorted(x for y, x in data if y == k and x is not None)
        want[k] = (v[int(len(v) * 0.5)], v[max(0, int(len(v) * 0.95) - 1)])
    assert got == want
    assert aggregates.index_percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_nearest_vectors_in_blocks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)).round(3)
    x[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id bigint, embedding array<double>")
    from velarium.operators.retrieval import dense_topk

    got = {(r.q, r["rank"]): r.vec_id for r in dense_topk(df, df.where("vec_id % 10 = 3"), 4, rows=17, asks=3).collect()}
    u = x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    for q in range(3, 120, 10):
        s = u @ u[q]
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-s[i], i))[:4]
        assert [got[q, k + 1] for k in range(4)] == order
    assert dense_topk(df.limit(0), df, 4).count() == 0


def test_metrics_of_ones_own(spark):
    df = spark.createDataFrame([("a", "a", "q"), (None, "b", "q"), ("c", "d", "q")], "p string, g string, i string")
    metrics.METRICS.pop("mine", None)
    metrics.register("mine", metrics.custom(lambda p, g: len(p) + (p == g)))
    assert metrics.evaluated(df, ["mine", "exact"], "p", "g").head().mine == 1.0
    with pytest.raises(ValueError):
        metrics.register("mine", metrics.custom(lambda p, g: 0))
    with pytest.raises(ValueError):
        metrics.metric("nothing")
    got = {r.key: (r["mean"], r.n) for r in metrics.keyed_means(df, lambda p, g, i: {"n": len(p), "same": p == g}, "p", "g", "i").collect()}
    assert got == {"n": (1.0, 2), "same": (0.5, 2)}
    assert metrics.generated(df, lambda t: [(t, t.upper())], "g", "p").count() == 2


def test_decision_token_and_stacks(spark):
    df = spark.createDataFrame([("<decision:keep:search-again>",), ("x <decision:drop:answer-now>",), ("<decision>answer_now</decision>",), (None,)], "t string")
    assert [r.x for r in df.select(rewards.decision_token(F.col("t")).alias("x")).collect()] == [0.1, 0.2, 0.0, 0.0]
    parts = {k: F.lit(1.0) for k in rewards.STACKS["m2"]}
    assert spark.range(1).select(rewards.stacked("m2", parts).alias("x")).head().x == pytest.approx(1.0)
