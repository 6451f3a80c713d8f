"""Row shaping: trajectories to events, messages and training rows, and back."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velarium.functions import text

#: Other names of the columns a training row needs, by task. Fixed values.
SYNONYMS = {
    "prompt": ("prompt", "instruction", "question", "input", "query", "text"),
    "completion": ("completion", "response", "answer", "output", "target", "final_answer"),
    "chosen": ("chosen", "preferred", "better", "accepted"),
    "rejected": ("rejected", "dispreferred", "worse"),
}


def mapped(df: DataFrame, mapping: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed by ``mapping`` (new to old), then by synonyms; an error names required columns that are missing."""
    out = df.withColumnsRenamed({old: new for new, old in (mapping or {}).items() if old in df.columns})
    for want in required:
        if want not in out.columns:
            other = next((s for s in SYNONYMS.get(want, ()) if s in out.columns), None)
            if other is None:
                raise ValueError(f"no column for {want!r} among {out.columns}")
            out = out.withColumnRenamed(other, want)
    return out


#: Processors by a part of the data set's name, told by the longest part that fits. Fixed values.
BY_NAME = {"hh-rlhf": "preference_marker", "ultrafeedback": "best_worst", "ultrachat": "chat", "gsm8k": "marked_question", "mbpp": "mbpp", "humaneval": "humaneval", "preference": "preference"}


def processor_by_name(name: str) -> str | None:
    hits = [k for k in BY_NAME if k in name.lower()]
    return BY_NAME[max(hits, key=len)] if hits else None


def processor_by_columns(df: DataFrame, marker: str = "\n\nAssistant:") -> str | None:
    """Processor told from columns: chat messages, instruction with completions, or a preference pair with or without turns."""
    c = set(df.columns)
    if "messages" in c:
        return "chat"
    if {"instruction", "completions"} <= c:
        return "best_worst"
    if {"chosen", "rejected"} <= c:
        first = df.select("chosen").head(1)
        return "preference_marker" if first and marker in (first[0][0] or "") else "preference"
    return None


def split_preference(chosen: Column, rejected: Column, marker: str = "\n\nAssistant:") -> list[Column]:
    """Prompt to the first marker, and the responses after the last one."""
    return [F.concat(F.substring_index(chosen, marker, 1), F.lit(marker)).alias("prompt"), F.trim(F.substring_index(chosen, marker, -1)).alias("chosen"), F.trim(F.substring_index(rejected, marker, -1)).alias("rejected")]


def best_worst(df: DataFrame, key: str, order: str, score: str, response: str) -> DataFrame:
    """The best and the worst response of each key by score (missing counts 0, first of equals); no rejected for a single one."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(response, F.struct((-s).alias("s"), F.col(order))).alias("chosen"), F.min_by(response, F.struct(s.alias("s"), F.col(order))).alias("_worst"), F.count(F.lit(1)).alias("n")
    ).select(key, "chosen", F.when(F.col("n") > 1, F.col("_worst")).otherwise("").alias("rejected"))


def with_system(messages: Column, system: str) -> Column:
    """Messages with a system message in front, unless there is one."""
    m = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
    return F.when(F.get(messages, 0)["role"].eqNullSafe("system"), messages).otherwise(F.concat(F.array(m), messages))


def system_into_prompt(prompt: Column, system: str) -> Column:
    """A system text before the first end-of-turn mark of a templated prompt, else in front; not twice."""
    marks = ("<|eot_id|>", "<|im_end|>")
    out = F.concat(F.lit(system + "\n\n"), prompt)
    for m in marks:
        at = F.instr(prompt, m)
        out = F.when(at > 0, F.concat(F.substring(prompt, F.lit(1), at - 1), F.lit("\n" + system), F.substring(prompt, at, F.length(prompt)))).otherwise(out)
    return F.when(prompt.contains(system), prompt).otherwise(out)


def custom_map(df: DataFrame, f: Any, schema: str, batched: bool = False) -> DataFrame:
    """A user's function over rows (dict to dict) or Arrow batches (frame to frame)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b) if batched else pd.DataFrame([f(r) for r in b.to_dict("records")])

    return df.mapInPandas(run, schema)


#: Weight of each kind of segment in training. Fixed values.
WEIGHTS = {"reasoning": 1.0, "text": 1.0, "tool_call": 2.0, "tool_result": 0.0, "observation": 0.0}


def events(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """``(trajectory_id, seq, kind, payload)``: the task, then for each step reasoning, call, result, reward and turn end, then the answer and the episode's reward.

    ``seq`` is step number times 8 plus the place within the step, so it orders events without
    ordering whole trajectories in one task; -1 is the task, and the closing two come after all steps.
    """
    t = trajectories.where(F.col("trajectory_id").isNotNull()).groupBy("trajectory_id").agg(F.min("question").alias("q"), F.min("final_answer").alias("a"), F.min("reward").alias("r"))
    ev = lambda at, kind, payload: F.struct(at.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))
    last = F.lit(1 << 40)
    ends = t.select("trajectory_id", F.explode(F.array(ev(F.lit(-1), "observation", F.col("q")), ev(last, "text", F.col("a")), ev(last + 1, "episode_reward", F.round("r", 6)))).alias("e"))
    base = F.col("step_number").cast("bigint") * 8
    tool = F.coalesce("is_tool_step", F.lit(False))
    s = steps.where(F.col("trajectory_id").isNotNull() & F.col("step_number").isNotNull()).groupBy("trajectory_id", "step_number").agg(F.min_by(F.struct("thought", "action_name", "observation", "reward", "is_tool_step"), "step_id").alias("x")).select("trajectory_id", "step_number", "x.*")
    inner = s.select(
        "trajectory_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("thought").isNotNull(), ev(base, "reasoning", F.col("thought"))), F.when(tool, ev(base + 1, "tool_call", F.col("action_name"))), F.when(tool, ev(base + 2, "tool_result", F.col("observation"))),
                    F.when(F.col("reward").isNotNull(), ev(base + 3, "reward", F.round("reward", 6))), ev(base + 4, "turn_complete", F.lit("")),
                )
            )
        ).alias("e"),
    )
    return ends.unionByName(inner).select("trajectory_id", "e.*").where("kind <> 'episode_reward' or payload is not null")


def segment_weights(ev: DataFrame) -> DataFrame:
    """Training segments of events with weight and loss mask."""
    w = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in WEIGHTS.items()])
    return ev.where(F.col("kind").isin(*WEIGHTS)).select("trajectory_id", "seq", "kind", w.alias("weight"), (w == 0).alias("loss_mask"))


def merge_turns(messages: DataFrame, keys: list[str], order: list[str], role: str, content: str) -> DataFrame:
    """Successive messages of one role as one, joined by blank lines."""
    w = Window.partitionBy(*keys).orderBy(*order)
    m = messages.withColumn("_n", F.when(F.col(role).eqNullSafe(F.lag(role).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).withColumn("_i", F.sum("_n").over(w))
    g = m.groupBy(*keys, "_i", role).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(content).alias("_c")))).alias("_a"))
    return g.select(*keys, F.col("_i").alias("turn"), role, F.array_join("_a._c", "\n\n").alias(content))


def fold_tool_turns(messages: Column) -> Column:
    """Tool messages as user messages, then like turns merged, joined by blank lines."""
    as_user = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "tool", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content")))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.aggregate(
        as_user, empty,
        lambda out, m: F.when(
            (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["role"] == m["role"]) & (m["role"] == "user"),
            F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(m["role"].alias("role"), F.concat_ws("\n\n", F.try_element_at(out, F.lit(-1))["content"], m["content"]).alias("content")))),
        ).otherwise(F.concat(out, F.array(m))),
    )


def as_text(messages: Column) -> Column:
    """Messages as lines 'role: content'."""
    return F.array_join(F.transform(messages, lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")


def errors_before(steps: DataFrame) -> DataFrame:
    """Steps with ``status`` error where their result reports one, ok otherwise, found by number and not by a window."""
    s = steps.where(F.coalesce("is_tool_step", F.lit(False))).groupBy("trajectory_id", "step_number").agg(F.min_by(F.struct("action_name", "observation"), "step_id").alias("x")).select("trajectory_id", "step_number", "x.*")
    bad = F.lower(F.coalesce("observation", F.lit(""))).rlike("error|exception|invalid")
    return s.select("trajectory_id", "step_number", "action_name", F.when(bad, "error").otherwise("ok").alias("status"))


def round_robin(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two data sets in turn, with the rest of the longer after; ``rank0`` is the place."""
    from velarium.operators.windows import order_position

    x = order_position(a.withColumn("_k", F.col(key)), F.lit(0.0) + F.xxhash64(key), key).withColumn("source", F.lit(0))
    y = order_position(b.withColumn("_k", F.col(key)), F.lit(0.0) + F.xxhash64(key), key).withColumn("source", F.lit(1))
    n = F.least(F.lit(x.count()), F.lit(y.count()))
    both = x.unionByName(y)
    place = F.when(F.col("rank0") < n, F.col("rank0") * 2 + F.col("source")).otherwise(n + F.col("rank0"))
    return both.withColumn("rank0", place).drop("_k")


def trimmed_preference(df: DataFrame) -> DataFrame:
    """``(prompt, chosen, rejected)`` without white space at their ends; missing ones are empty."""
    return df.select(*[text.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("prompt", "chosen", "rejected")])


def marked_question(prompt: Column) -> Column:
    """A chat of one user message: the question between the first ``Q:`` line and the ``A:`` after it, else the whole prompt."""
    t = text.strip(F.coalesce(prompt, F.lit("")))
    rest = F.substring_index(F.substring(t, F.instr(t, "\nQ: ") + 4, F.length(t)), "\nA:", 1)
    both = (F.instr(t, "\nQ: ") > 0) & (F.instr(t, "\nA:") > 0)
    return F.array(F.struct(F.lit("user").alias("role"), F.when(both, text.strip(rest)).otherwise(t).alias("content")))


#: The words around a programming task. Fixed values.
TASK = ("Complete the following Python function:\n\n", "\n\nProvide only the function implementation in Python.")


def code_rows(df: DataFrame, task: str = "code") -> DataFrame:
    """Rows of short programming tasks ``(task_id, text, code, test_list)`` for code, sft or other training."""
    t, c = text.strip(F.coalesce("text", F.lit(""))), text.strip(F.coalesce("code", F.lit("")))
    if task == "code":
        return df.select("task_id", F.concat(F.lit(TASK[0]), t, F.lit(TASK[1])).alias("prompt"), F.coalesce("test_list", F.array().cast("array<string>")).alias("test_cases"), c.alias("reference_code"), F.col("text").alias("original_text"))
    return df.select(t.alias("prompt"), c.alias("completion" if task == "sft" else "response"))


def function_rows(df: DataFrame, task: str = "code") -> DataFrame:
    """Rows of functions to complete ``(task_id, prompt, test, canonical_solution, entry_point)`` for code, sft or other training."""
    p, c = text.strip(F.coalesce("prompt", F.lit(""))), text.strip(F.coalesce("canonical_solution", F.lit("")))
    if task == "code":
        return df.select("task_id", p.alias("prompt"), F.coalesce("test", F.lit("")).alias("test_cases"), c.alias("reference_code"), F.coalesce("entry_point", F.lit("")).alias("entry_point"))
    return df.select(p.alias("prompt"), c.alias("completion" if task == "sft" else "response"))


def chat_messages(steps: DataFrame) -> DataFrame:
    """``(trajectory_id, messages)``: a step with a tool as an assistant message with its call and a tool message, any other as an assistant message.

    Messages are ``(role, content, call)`` in step order; a step stored twice counts once (the first
    by ``step_id``). The row holds the whole chat, which is what the format is.
    """
    msg = lambda role, content, call: F.struct(F.lit(role).alias("role"), content.alias("content"), call.cast("string").alias("call"))
    s = steps.where(F.col("trajectory_id").isNotNull() & F.col("step_number").isNotNull()).groupBy("trajectory_id", "step_number").agg(F.min_by(F.struct("thought", "action_name", "action_args_json", "observation"), "step_id").alias("x")).select("trajectory_id", "step_number", "x.*")
    none = F.lit(None)
    called = F.to_json(F.struct(F.col("action_name").alias("name"), F.coalesce("action_args_json", F.lit("{}")).alias("arguments")))
    turns = F.when(F.length("action_name") > 0, F.array(msg("assistant", F.coalesce("thought", F.lit("")), called), msg("tool", F.col("observation"), none))).otherwise(F.array(msg("assistant", F.col("observation"), none)))
    g = s.select("trajectory_id", "step_number", turns.alias("m")).groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct("step_number", "m"))).alias("a"))
    return g.select("trajectory_id", F.flatten("a.m").alias("messages"))


def portable_records(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """``(trajectory_id, task, final_response, reward, steps)``: steps in order as ``(step_number, thought, name, arguments, observation)``.

    Ids count once; a step stored twice counts once. Arguments that aren't a JSON object stay text.
    """
    t = trajectories.where(F.col("trajectory_id").isNotNull()).groupBy("trajectory_id").agg(F.min(F.struct("question", "final_answer", "reward")).alias("r"))
    s = steps.where(F.col("trajectory_id").isNotNull() & F.col("step_number").isNotNull()).groupBy("trajectory_id", "step_number").agg(F.min_by(F.struct("thought", F.col("action_name").alias("name"), F.col("action_args_json").alias("arguments"), "observation"), "step_id").alias("x"))
    g = s.groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct("step_number", "x.thought", "x.name", "x.arguments", "x.observation"))).alias("steps"))
    out = t.join(g, "trajectory_id", "left")
    return out.select("trajectory_id", F.col("r.question").alias("task"), F.coalesce("r.final_answer", F.lit("")).alias("final_response"), F.coalesce("r.reward", F.lit(0.0)).alias("reward"), F.coalesce("steps", F.array().cast(g.schema["steps"].dataType)).alias("steps"))


def gold_rows(samples: DataFrame, chunks: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """``(sample_id, gold_path, passages)`` of ``(sample_id, gold_chunk_ids)``: the ids as JSON, and the passages there are, in the order of the path.

    A chunk stored twice counts once (the first by text); ids without a chunk give no passage.
    """
    path = samples.select(sample_id, F.col("gold_chunk_ids").alias("ids"), F.posexplode_outer("gold_chunk_ids").alias("place", "chunk_id"))
    text_ = chunks.where("chunk_id is not null and text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    g = path.join(text_, "chunk_id", "left").groupBy(sample_id, "ids").agg(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "chunk_id", "text")))).alias("a"))
    return g.select(sample_id, F.to_json("ids").alias("gold_path"), F.transform("a", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))).alias("passages"))


def memory_decision(thought: Column) -> Column:
    """``(memory, action)`` that a decision token names: keep, drop or compress, and search-again or answer-now; compress and null without a token."""
    token = r"<decision:(keep|drop|compress):(search-again|answer-now)>"
    part = lambda i: F.nullif(F.regexp_extract(F.coalesce(thought, F.lit("")), token, i), F.lit(""))
    return F.struct(F.coalesce(part(1), F.lit("compress")).alias("memory"), part(2).alias("action"))


def generated_samples(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """``(keys, question, answer, reasoning, status, discard_reason)`` of generated text that should hold a JSON object.

    Text without one is rejected as ``generate_parse_failure``, an object without question or answer as
    ``empty_qa``; the rest has no status yet.
    """
    from velarium.functions import jsonx

    v = jsonx.tolerant(F.col(text_col))
    read = lambda f: text.strip(F.coalesce(F.try_variant_get(F.col("_v"), f"$.{f}", "string"), F.lit("")))
    rows = df.select(*keys, v.alias("_v")).select(*keys, F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)).alias("_ok"), *[read(f).alias(f) for f in ("question", "answer", "reasoning")])
    empty = (F.col("question") == "") | (F.col("answer") == "")
    why = F.when(~F.col("_ok"), "generate_parse_failure").when(empty, "empty_qa")
    return rows.select(*keys, "question", "answer", "reasoning", F.when(why.isNotNull(), "rejected").alias("status"), why.alias("discard_reason"))


def single_calls(messages: Column) -> Column:
    """Messages as JSON with each assistant turn of several calls written as one turn a call, each with its result.

    Results go to the call with their id; those without one, or with one that no call has, go to the
    calls without a result in order, and the rest follows. Only the first turn keeps the text. Text
    that isn't an array of messages stays as it is.
    """
    import json

    def one(t: str | None) -> str | None:
        try:
            chat = json.loads(t or "")
        except ValueError:
            return t
        if not isinstance(chat, list) or not all(isinstance(m, dict) for m in chat):
            return t
        out: list[dict] = []
        results: list[dict] = []
        for m in reversed(chat):  # from the end, so that a turn meets the results after it
            if m.get("role") == "tool":
                results.insert(0, m)
                continue
            calls = m.get("tool_calls") or []
            block = [m, *results]
            if m.get("role") == "assistant" and len(calls) > 1:
                ids = [c.get("id") for c in calls]
                own = {r["tool_call_id"]: r for r in results if r.get("tool_call_id") in ids}
                loose = [r for r in results if not r.get("tool_call_id") or r["tool_call_id"] not in ids]
                block = []
                for k, call in enumerate(calls):
                    block.append(m | {"tool_calls": [call], "content": "" if k else m.get("content")})
                    found = own.get(call.get("id")) if call.get("id") else None
                    found = found or (loose.pop(0) if loose else None)
                    block += [found] if found else []
                block += loose
            out, results = block + out, []
        return json.dumps(results + out, ensure_ascii=False)

    def run(chats: pd.Series) -> pd.Series:
        return chats.map(one)

    return F.pandas_udf(run, "string")(messages)
