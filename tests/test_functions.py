import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from velarium.functions import jsonx, numbers, parsers, rules, text
from velarium.operators import evaluation, rewards


def one(spark, col, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(col.alias("x")).head()[0]


@pytest.mark.parametrize("a,b,want", [("The cat sat", "a cat sat!", 1.0), ("", "cat", 0.0), ("cat cat dog", "cat dog dog", 2 * 2 / 6), ("x", "y", 0.0)])
def test_token_f1(spark, a, b, want):
    assert one(spark, text.token_f1(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_relaxed_drops_article_and_form(spark):
    assert one(spark, text.relaxed(F.col("a")), a="The Acme, Inc.") == "acme"


@pytest.mark.parametrize("a,want", [("x <answer> 42 </answer> y", "42"), ("plain", "plain"), ("<answer></answer>", "")])
def test_answer(spark, a, want):
    assert one(spark, text.answer(F.col("a")), a=a) == want


def test_ngrams(spark):
    assert one(spark, text.ngrams(F.split("a", " "), 2), a="a b c") == ["a b", "b c"]
    assert one(spark, text.ngrams(F.split("a", " "), 4), a="a b c") == []


@pytest.mark.parametrize("a,want", [("$1,234.5", 1234.5), ("(3.2M)", -3.2e6), ("12th", None), ("7%", 0.07), ("none", None), ("-4", -4.0), ("2B", 2e9)])
def test_parse_number(spark, a, want):
    assert one(spark, numbers.parse_number(F.col("a")), a=a) == want


def test_pass_at_k_equals_the_estimator(spark):
    for n, c, k in itertools.product(range(1, 7), range(0, 7), (1, 2, 4)):
        if c > n:
            continue
        want = 0.0 if k > n or c == 0 else 1.0 - math.comb(n - c, k) / math.comb(n, k)
        assert one(spark, numbers.pass_at_k(F.col("n"), F.col("c"), k), n=n, c=c) == pytest.approx(want)


def test_cosine_of_zero_is_zero(spark):
    assert one(spark, numbers.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0


def test_tolerant_json(spark):
    for t in ('{"a": 1}', 'text ```json\n{"a": 1}\n``` more', 'so {"a": 1} it is'):
        assert one(spark, F.variant_get(jsonx.tolerant(F.col("a")), "$.a", "int"), a=t) == 1
    assert one(spark, jsonx.tolerant(F.col("a")).isNull(), a="nothing")


def test_judge_score(spark):
    assert [one(spark, jsonx.judge_score(F.col("a")), a=t) for t in ('{"score": 0.7}', "I say 0.4 of 1", "none", '{"score": 9}')] == [0.7, 0.4, 0.0, 1.0]


def _model(rule, row):
    """The rule language evaluated by hand: an ordering with a missing value ends the rule with false."""

    class Missing(Exception):
        pass

    def order(a, b, f):
        if a is None or b is None:
            raise Missing
        return f(a, b)

    names = {"lt": lambda: order(row["x"], 5, lambda a, b: a < b), "ge": lambda: order(row["y"], 2, lambda a, b: a >= b), "eq": lambda: row["x"] == 3}
    try:
        return bool(eval(rule.replace("x < 5", "lt()").replace("y >= 2", "ge()").replace("x == 3", "eq()"), {}, names))
    except Missing:
        return False


def test_rules_against_a_model(spark):
    rng = random.Random(1)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["x < 5", "y >= 2", "x == 3"])
        k = rng.choice(["not", "and", "or"])
        return f"(not {tree(depth - 1)})" if k == "not" else f"({tree(depth - 1)} {k} {tree(depth - 1)})"

    rows = [(x, y) for x in (None, 3, 9) for y in (None, 1, 2)]
    df = spark.createDataFrame(rows, "x int, y int")
    exprs = [tree(3) for _ in range(60)]
    got = df.select("x", "y", *[rules.compile_rule(e, {"x": F.col("x"), "y": F.col("y")}).alias(f"r{i}") for i, e in enumerate(exprs)]).collect()
    for r in got:
        for i, e in enumerate(exprs):
            assert r[f"r{i}"] == _model(e, {"x": r.x, "y": r.y}), (e, r.x, r.y)


@pytest.mark.parametrize("bad", ["1 < x < 5", "f(x)", "a._b == 1", "x +", "[1]"])
def test_rules_refuse(bad):
    with pytest.raises(ValueError):
        rules.compile_rule(bad, {"x": F.lit(1)} if False else {})


def test_interpolate_and_merge(spark):
    assert one(spark, rules.interpolate("a {x} {y} {p.q}!", {"x": F.col("x")}), x="1") == "a 1 {y} !"
    assert rules.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}}


@pytest.mark.parametrize(
    "t",
    [
        '<function=search><parameter=q>cats</parameter></function>', '<tool_call>{"name": "search", "arguments": {"q": "cats"}}</tool_call>', '[TOOL_CALLS] [{"name": "search", "arguments": {"q": "cats"}}]',
        'to=functions.search <|message|>{"q": "cats"}<|call|>', "Thought: hm\nAction: search\nAction Input: {\"q\": \"cats\"}\n", '```json\n{"tool": "search", "args": {"q": "cats"}}\n```', 'use {"function": {"name": "search", "arguments": "{\\"q\\": \\"cats\\"}"}}',
    ],
)
def test_parse_calls(t):
    assert parsers.parse_calls(t) == [("search", '{"q": "cats"}')]


def test_chunks_cover_and_keep_the_size():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["word ", "a", ". ", "\n", "\n\n", "x" * 40, "é"]) for _ in range(rng.randint(0, 120)))
        s = parsers.chunk_spans(t, 60, 12)
        assert all(0 < b - a <= 60 for a, b in s)
        covered = set().union(*[range(a, b) for a, b in s]) if s else set()
        assert all(not t[i].strip() for i in range(len(t)) if i not in covered)


@pytest.mark.parametrize("e,want", [("2^3", 8.0), ("1,000 * 2", 2000.0), ("50%", 0.5), ("(3-1)/4", 0.5), ("__import__('os')", None), ("1/0", None), ("sqrt(16)", 4.0), ("9**9**9", None), (None, None)])
def test_calculate(e, want):
    assert parsers.calculate(e) == want


@pytest.mark.parametrize("t,want", [("so \\boxed{\\frac{1}{2}} done", "0.5"), ("... #### 42", "42"), ("The answer is 7.", "7"), ("x = 3", "3"), ("1 and 2,000", "2000"), ("", ""), ("\\boxed{3} then #### 7", "7"), ("<SOLUTION>12</SOLUTION> of 99 items", "12"), ("#### 1,234 apples", "1234"), ("Therefore, Janet makes $18 every day for 5 days", "18")])
def test_math_answer(t, want):
    assert parsers.math_answer(t) == want


def test_rouge_and_bleu():
    assert parsers.rouge("the cat", "the cat") == (1.0, 1.0, 1.0)
    assert parsers.bleu("a b c d", "a b c d") == pytest.approx(1.0)
    assert parsers.bleu("", "a") == 0.0


def test_valid_arguments():
    s = {"f": {"properties": {"n": {"type": "integer"}}, "required": ["n"]}}
    assert parsers.valid_arguments("f", '{"n": 1}', s)
    assert not any(parsers.valid_arguments(*x, s) for x in (("g", "{}"), ("f", "{}"), ("f", '{"n": "1"}'), ("f", '{"n": true}'), ("f", "{"), ("f", '{"n": 1, "m": 2}')))


def test_literal_rows():
    assert parsers.literal_rows("[(1, 'a'), (2, None)]") == [["1", "a"], ["2", "None"]]
    assert parsers.literal_rows("open('x')") is None
    assert json.loads("1") == 1


@pytest.mark.parametrize(
    "t, want",
    [
        ('<think><function=f></function></think>done', []), ('My dog is {"name": "Bob"}', []), ('<tool_call>{"name": "directly-answer", "arguments": {}}</tool_call>', []), ("the list is [2, 3]", []),
        ('<tool_call>f\n<arg_key>q</arg_key>\n<arg_value>cats</arg_value></tool_call>', [("f", '{"q": "cats"}')]), ('<|START_ACTION|>[{"tool_call_id": "0", "tool_name": "f", "parameters": {"q": 1}}]<|END_ACTION|>', [("f", '{"q": 1}')]),
        ('{"tool_names": ["f"], "parameters": {"q": 1}}', [("f", '{"q": 1}')]), ('{"function_name": "f", "arguments": "plain text"}', [("f", "plain text")]), ('<invoke name="f"><parameter name="q">cats</parameter></invoke>', [("f", '{"q": "cats"}')]),
        ('Action: ```json\n[{"tool_name": "f", "parameters": {}}]\n```', [("f", "{}")]), ('to=functions.fjson{"a": 1}', [("f", '{"a": 1}')]), ('<function=f>{"a": oops}</function>', []), ('<tool_call>{"name": "f", "arguments": {"a": 1}}', [("f", '{"a": 1}')]),
        ('<function=a><parameter=x>1</parameter></function><function=b></function>', [("a", '{"x": "1"}'), ("b", "{}")]), (None, []), ("", []),
    ],
)
def test_parse_calls_notations(t, want):
    assert parsers.parse_calls(t) == want


def test_chunks_are_stripped_and_separators_begin_the_next():
    t = "First sentence here. Second one is here. Third ends"
    assert [t[a:b] for a, b in parsers.chunk_spans(t, 30, 0)] == ["First sentence here", ". Second one is here", ". Third ends"]
    assert parsers.chunk_spans("  \n\n ", 3, 0) == [] and parsers.chunk_spans("", 5, 0) == []


def test_scores_as_defined(spark):
    one_ = lambda c, **v: one(spark, c, **v)
    p, g = F.col("p"), F.col("g")
    assert one_(numbers.number_recall(p, g), p="x", g="no numbers") == 1.0
    assert one_(rewards.answer_correctness(p, g), p="The answer.", g="answer") == 0.5
    assert one_(rewards.citation(p), p="see section 3 [1]") == 0.0 and one_(rewards.citation(p), p="see a.b@c.de") == 0.2
    assert one_(rewards.placeholder_coverage(p, g), p="<answer>it was $5 and 7</answer>", g="$5 7% 9M") == 0.5
    assert one_(evaluation.span_grounded(p, g), p="n/a", g="x") and not one_(evaluation.span_grounded(p, g), p="five words not in it", g="it")
    assert one_(text.bare(p), p=" $1,779,000. ") == "1779000" and one_(text.bare(p), p="€5!") == "€5!"
    assert one_(text.relaxed(p), p="Acme GmbH") == "acme" and one_(text.relaxed(p), p="Acme LP") == "acme lp"
