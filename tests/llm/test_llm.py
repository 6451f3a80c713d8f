"""Operators of the language-model subpackage: defined cases, brute force, round trips and held-out accuracy."""

import itertools
import os
import random
import re

import pytest

pytest.importorskip("velarium.llm")

from pyspark.sql import functions as F

from velarium.llm import conversations, language, mailtext, mixing, overlap, pairs, pii, queries, runs, splitting, tokens

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- 8: tokens


def test_joined_encodings_equal_the_whole():
    rng = random.Random(0)
    parts = ["a", "'", "l", "s", " ", "  ", "\n", "\t", "1", "23", "é", "中", "😀", "\xa0", "!", "...", "'ll", " the", "x" * 30]
    enc = tokens.encoding(tokens.TOKENIZER)
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        assert tokens.encode_tree(tokens.TOKENIZER, t, rng.choice([1, 3, 17])) == enc.encode_ordinary(t)


def test_encode_corpus_cases(spark):
    long = "word, another word and 中文 " * 400 + "y" * 3000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "hi there", 0), (4, "hi there", 0), (5, long, 0), (6, "<|endoftext|>", 0)], "doc_id bigint, text string, ids int")
    got = tokens.encode_corpus(df, piece=500).collect()
    enc = tokens.encoding(tokens.TOKENIZER)
    want = sorted((i, enc.encode_ordinary(t or "")) for i, t in [(1, ""), (2, ""), (3, " \n"), (4, "hi there"), (4, "hi there"), (5, long), (6, "<|endoftext|>")])
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want
    assert all(enc.decode(ids) == (t or "") for (_, ids), t in zip(want, ["", "", " \n", "hi there", "hi there", long, "<|endoftext|>"]))
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# ---- 1: overlaps

QUESTIONS = [
    "What price in million crowns did Jorley Inc pay for the 2003 purchase of Norcroft SARL under deal South?", "what price in million crowns did jorley inc pay for the 2003 purchase of norcroft sarl under deal south?",
    "Under deal South, what price in million crowns did Jorley pay for the acquisition of Norcroft SARL in 2003?", "Question: What price in million crwnos did Jorley Inc pay for the 2003 purchase of Norcroft SARL under deal South?? Thanks!",
    "What price in million crowns did Jorley Inc pay for the 2004 purchase of Norcroft SARL under deal South?", "What price in million crowns did Jorley Inc pay for the 2003 purchase of Norcrest SARL under deal South?",
    "What price in million crowns did Jorley Inc pay for the 2003 purchase of Norcroft SARL under deal North?", "Which law governs the supply agreement South signed in 2003 between Jorley Inc and Norcroft SARL?",
]


def _asked(spark, questions):
    t = [(f"{s}{i}", s, x) for s in "te" for i, x in enumerate(questions)]
    return spark.createDataFrame(t, "trajectory_id string, run_id string, question string")


def _linked(questions, known):
    parsed = [overlap.parse(x, known) for x in questions]
    return {(i, j) for i, p in enumerate(parsed) for j, q in enumerate(parsed) if overlap.same_question(p, q, known)}


def test_same_question(spark):
    df = _asked(spark, QUESTIONS)
    known = overlap.known_words(df)
    same = {(i, j) for i, j in _linked(QUESTIONS, known) if i < j}
    assert same == set(itertools.combinations(range(4), 2))


def _runs(spark):
    return spark.createDataFrame([("t", "Training"), ("e", "held-out eval"), ("n", None), ("b", " ")], "run_id string, run_type string")


def test_overlaps_and_report(spark):
    t = [(f"x{i}", "t" if i % 2 else "e", q) for i, q in enumerate(QUESTIONS)] + [("x0", "e", QUESTIONS[0]), ("y", None, QUESTIONS[0]), ("z", "n", QUESTIONS[0]), ("w", "b", QUESTIONS[0]), ("v", "t", None), ("u", "t", "  ")]
    df = spark.createDataFrame(t, "trajectory_id string, run_id string, question string").withColumn("split", F.lit("clash"))
    got = overlap.overlaps(df, _runs(spark))
    assert rows(got.select("id_train", "id_eval")) == [("x1", "x0"), ("x1", "x2"), ("x3", "x0"), ("x3", "x2")]
    assert {r.run_id: r.n_overlapping for r in overlap.overlap_report(df, _runs(spark)).collect()} == {"t": 2, "e": 2}
    assert overlap.overlaps(df.limit(0), _runs(spark)).count() == 0


def test_overlap_candidates_lose_no_pair(spark):
    """Recall against the comparison of all pairs, and how many links lie at a distance of more than 0."""
    d = spark.read.parquet("/root/testdata/sf0.01/trajectories.parquet"), spark.read.parquet("/root/testdata/sf0.01/runs.parquet")
    q = overlap.questions_by_split(*d)
    known = overlap.known_words(q)
    texts = {s: sorted({r.question for r in q.collect() if r.split == s}) for s in ("train", "eval")}
    parsed = {s: [overlap.parse(x, known) for x in v] for s, v in texts.items()}
    want = {(x, y) for x, p in zip(texts["train"], parsed["train"]) for y, r in zip(texts["eval"], parsed["eval"]) if overlap.same_question(p, r, known)}
    text_of = {r.trajectory_id: r.question for r in q.collect()}
    got = {(text_of[a], text_of[b]) for a, b in rows(overlap.overlaps(*d).select("id_train", "id_eval"))}
    far = lambda x, y: (int(overlap.simhash(overlap.features(overlap.parse(x, known))), 16) ^ int(overlap.simhash(overlap.features(overlap.parse(y, known))), 16)).bit_count()
    assert got <= want and len(got) >= 0.97 * len(want)
    assert sum(far(x, y) > 0 for x, y in got) > 0.05 * len(got)


def test_overlap_of_questions_of_any_kind(spark):
    """Nothing but the counted words tells what a question is about."""
    q = ["What is the capital of France?", "what is the capital of france?", "Please tell: what is the capital of France", "What is the capital of Spain?", "Who wrote the anthem of France?", "Who wrote the anthem of Spain?", "", " ", "?"]
    got = rows(overlap.overlaps(_asked(spark, q), _runs(spark)).select("id_train", "id_eval"))
    groups = [(0, 1, 2), (3,), (4,), (5,), (8,)]
    assert got == sorted([(f"t{i}", f"e{j}") for g in groups for i in g for j in g], key=repr)


def test_overlap_uses_whole_texts(spark):
    """Years, parties and facts count wherever they stand, after a question mark, a full stop or a long text too."""
    price, law, other = QUESTIONS[0], QUESTIONS[7], lambda x: x.replace("Norcroft SARL", "Fendale BV")
    named = "Name the price in million crowns that Jorley Inc paid for Yewcrest AG under deal South."
    long = " Look into the filing and count what was paid at the end of each quarter." * 200
    q = [
        price, f"{price}{long}", f"{law}{long}", f"{price} And in 2005?", f"{named} In 2003.", f"{named} In 2004.",
        f"Have you read all the papers of this case? {other(price)}", f"Have you read all the papers of this case? {other(law)}",
        f"{price}{long} Only Yewcrest of Ostermark.", f"{price}{long} Only Yewcrest of Lindhaven.",
    ]
    got = rows(overlap.overlaps(_asked(spark, q), _runs(spark)).select("id_train", "id_eval"))
    groups = [(0, 1), *[(i,) for i in range(2, 10)]]
    assert got == sorted([(f"t{i}", f"e{j}") for g in groups for i in g for j in g], key=repr)


def test_overlap_learns_statements_that_only_frame(spark):
    """How to answer, said with many questions, makes neither different questions the same nor the same ones differ."""
    ends = ["Put the result in answer tags.", "Answer briefly and without giving any further explanation."]
    q = [f"What price did Jorley pay for Norcroft in {2000 + i}? {e}" for i in range(15) for e in ends] + [f"Which law governs the contract of Jorley with Norcroft from 2003? {ends[0]}"]
    known = overlap.known_words(_asked(spark, q))
    assert known.framing == {e.lower().rstrip(".") for e in ends}
    assert _linked(q, known) == {(i, j) for i in range(30) for j in range(30) if i // 2 == j // 2} | {(30, 30)}


def test_overlap_of_one_question_that_most_rows_ask(spark):
    t = [(f"t{i}", "t", QUESTIONS[0]) for i in range(200)] + [("e0", "e", QUESTIONS[2]), ("e1", "e", QUESTIONS[4])]
    df = spark.createDataFrame(t, "trajectory_id string, run_id string, question string")
    assert overlap.overlaps(df, _runs(spark)).groupBy("id_eval").count().collect() == [("e0", 200)]
    assert {r.run_id: r.n_overlapping for r in overlap.overlap_report(df, _runs(spark)).collect()} == {"t": 200, "e": 1}


# ---- 2: conversations

STEP = "step_id bigint, trajectory_id string, step_number int, thought string, action_name string, action_args_json string, observation string, is_tool_step boolean, started_at timestamp"


def _steps(spark, items):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t, n, th, "tool" if tool else None, "{}", ob, tool, None if at is None else t0 + datetime.timedelta(seconds=at)) for i, (t, n, th, ob, tool, at) in enumerate(items)], STEP)


def test_conversation_defects(spark):
    s = _steps(spark, [
        ("ok", 0, "a", "o", True, 0), ("ok", 1, "b", None, False, 1), ("ok", 0, "a", "o", True, 0), ("gap", 1, "a", None, False, 0), ("gap", 3, "b", None, False, 1), ("late", 2, "a", None, False, 0),
        ("two", 1, "a", None, False, 0), ("two", 1, "b", None, False, 0), ("mute", 1, "a", "​", True, 0), ("blank", 1, None, " ", None, None), ("gone", 1, "x", None, False, 0),
    ])
    t = spark.createDataFrame([(x, "q") for x in ("ok", "ok", "gap", "late", "two", "mute", "blank", "none", None)], "trajectory_id string, question string")
    assert rows(conversations.defects(t, s)) == sorted([("gap", "broken"), ("late", "broken"), ("two", "broken"), ("mute", "missing_reply"), ("blank", "empty"), ("none", "empty")])
    turns = conversations.conversations(t, s).orderBy("turn").collect()
    assert [(r.trajectory_id, r.turn, r.role, r.text) for r in turns] == [("ok", 0, "user", "q"), ("ok", 1, "assistant", "a"), ("ok", 2, "tool", "o"), ("ok", 3, "assistant", "b")]
    assert rows(conversations.defects(t, s.limit(0))) == sorted((x, "empty") for x in ("ok", "gap", "late", "two", "mute", "blank", "none"))


def test_clock_offsets(spark):
    s = _steps(spark, [("good", 0, "a", None, False, 0), ("good", 1, "b", "o", True, 5), ("skew", 0, "a", None, False, 100), ("skew", 1, "b", "o", True, 40), ("skew", 2, "c", None, False, 110), ("bad", 0, "a", None, False, 10), ("bad", 1, "b", None, False, 0), ("none", 0, "a", None, False, None)])
    got = {r.trajectory_id: (r.clock, {o.sender: o.seconds for o in r.offsets or []}) for r in conversations.examined(s).collect()}
    assert got["good"] == ("consistent", {}) and got["bad"] == ("infeasible", {}) and got["none"] == ("consistent", {})
    assert got["skew"][0] == "corrected" and got["skew"][1] == {"": 0.0, "tool": pytest.approx(65.0)}
    t = spark.createDataFrame([(x, "q") for x in ("good", "skew", "bad")], "trajectory_id string, question string")
    assert rows(conversations.defects(t, s)) == [("bad", "infeasible")]
    at = {(r.trajectory_id, r.turn): r["at"].timestamp() for r in conversations.conversations(t, s).collect() if r["at"]}
    assert at["skew", 1] < at["skew", 3] < at["skew", 5] and not any(k[0] == "bad" for k in at)


def test_offsets_meet_all_constraints_or_none_do():
    """Against brute force over a grid: feasible exactly if some offsets are, and then the least-squares ones within them."""
    rng = random.Random(4)
    for _ in range(300):
        pairs = [(a, b, rng.randint(1, 5), m + rng.choice([0, 1, 3]), m) for a, b in itertools.permutations("xyz", 2) if rng.random() < 0.6 for m in [rng.randint(-4, 4)]]
        d = conversations.offsets([(a, b, n, float(mean), float(least)) for a, b, n, mean, least in pairs])
        fits = lambda d: all(least + d.get(b, 0) - d.get(a, 0) >= -1e-6 for a, b, _, _, least in pairs)
        grid = any(fits({"x": 0, "y": y, "z": z}) for y in range(-16, 17) for z in range(-16, 17))
        assert (d is not None) is (grid or not pairs) and (d is None or fits(d))


# ---- 3: runs


@pytest.mark.parametrize(
    "a,b,same",
    [
        (("search_corpus", '{"query": "Garwell notice period 2021", "top_k": 3}'), ("SearchCorpus", '{"top_k":"3","query":"GARWELL  noticee period 2021","retry":2,"sent_at":17}'), True),
        (("search_corpus", '{"query": "Garwell notice period 2021"}'), ("search_corpus", '{"query": "Garwell notice period 2020"}'), False), (("search_corpus", '{"query": "Garwell notice"}'), ("search_corpus", '{"query": "Garwood notice"}'), False),
        (("calculator", '{"expression":"(9 - 6) / 3"}'), ("calculator", '{"expression":" (9-6)/3 "}'), True), (("calculator", '{"expression":"(9 - 6) / 3"}'), ("calculator", '{"expression":"(9 + 6) / 3"}'), False),
        (("read_document", '{"doc_id":"cd-01","page":2}'), ("read-document", '{"page":2.0,"doc_id":"cd-01"}'), True), (("read_document", '{"doc_id":"cd-01","page":2}'), ("read_document", '{"doc_id":"cd-01","page":3}'), False),
        (("list_senders", "{}"), ("list_senders", None), True), (("a_tool", "{}"), ("b_tool", "{}"), False),
    ],
)
def test_same_call(a, b, same):
    assert runs.same_call(runs.canonical(*a), runs.canonical(*b)) is same


def test_collapse_equals_one_pass(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, t, n, rng.choice(["x", "x", "y", None]), rng.choice(['{"q": 1}', '{"q":1.0}', '{"q": 2}'])) for i, (t, n) in enumerate((t, n) for t in ("a", "b") for n in range(300) if rng.random() < 0.9)]
    rng.shuffle(items)
    import datetime

    df = spark.createDataFrame([(*x, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=x[2])) for x in items] + [(9999, None, 1, "x", "{}", None)], "step_id bigint, trajectory_id string, step_number int, action_name string, action_args_json string, started_at timestamp")
    want = []
    for t in ("a", "b"):
        seq = sorted((x for x in items if x[1] == t), key=lambda x: x[2])
        for a, e in runs.spans((x[3], x[4]) for x in seq):
            want.append((t, seq[a][2], seq[e - 1][2], e - a, float(seq[e - 1][2] - seq[a][2])))
    for block in (4096, 7):
        monkeypatch.setattr(runs, "BLOCK", block)
        got = runs.collapse(df).select("trajectory_id", "first_step", "last_step", "n_steps", "duration_s")
        assert rows(got) == sorted(want, key=repr)
    assert runs.collapse(df.limit(0)).count() == 0


# ---- 4: splitting


def test_pieces_keep_limit_overlap_and_text():
    rng = random.Random(6)
    for _ in range(150):
        t = "".join(rng.choice(["word ", "a, ", "end. ", "\n", "\n\n", "x" * 90, "中文。", "| 1 "]) for _ in range(rng.randint(1, 400))).strip()
        c = splitting.cuts(t)
        assert c[0][0] == 0 and c[-1][1] == len(t) and all(0 < e - a <= 512 for a, e in c)
        for (_, e), (a2, e2) in itertools.pairwise(c):
            assert e - 64 <= a2 <= e < e2


def test_dynamic_program_is_optimal():
    t = "aaaa bbbb. cccc dd, eee ffff gg. hhhh iii"
    pos, cost = splitting.boundaries(t, 5)
    limit, overlap_ = 16, 4
    best = splitting.cuts(t, limit, overlap_)

    def price(c):
        at = dict(zip(pos.tolist(), cost.tolist()))
        return sum((1 - (e - a) / limit) ** 2 + 1 + at[e] for a, e in c)

    natural = [p for p in pos.tolist() if dict(zip(pos.tolist(), cost.tolist()))[p] < splitting.PENALTY["none"]]
    start = lambda p: next((q for q in natural if p - overlap_ <= q < p), p - overlap_)

    def every(prev_end, done):
        if prev_end == len(t):
            yield done
            return
        a = 0 if not done else start(prev_end)
        for p in pos.tolist():
            if p > prev_end and p - a <= limit:
                yield from every(p, [*done, (a, p)])

    assert price(best) == pytest.approx(min(map(price, every(0, []))))


def test_split_cases(spark):
    df = spark.createDataFrame([("chunk", "a", "w " * 300), ("chunk", "a", "w " * 300), ("chunk", "b", " " * 600), ("chunk", "c", None), ("chunk", None, "x" * 600), ("chunk", "d", "\n " + "x" * 512 + "\t"), ("chunk", "e", "x" * 513)], "item_kind string, item_id string, text string")
    assert rows(splitting.split(df).groupBy("item_id").count()) == [("a", 2), ("e", 2)]
    assert splitting.split(df.limit(0)).count() == 0


# ---- 5: personal information

NAMES = pii.Names({"ingrid", "mark", "will", "june"}, {"solelan", "wenelan", "krasson"})


@pytest.mark.parametrize(
    "t,want",
    [
        ("write to a.b+c (at) mail (dot) skerry (dot) example now", [("email", "a.b+c (at) mail (dot) skerry (dot) example")]), ("x at ordelan dot test, ok", [("email", "x at ordelan dot test")]),
        ("call (415) 555-0132 or +49 (0)30 23125-586", [("phone", "(415) 555-0132"), ("phone", "+49 (0)30 23125-586")]), ("New line 555-0117 ext. 79.", [("phone", "555-0117 ext. 79")]),
        ("Part no. 555-92-0107 and invoice 439233909 dated 25/03/2001; Meter reading 0513 20373 528 looks off", []), ("tax ID =\n> 00 951 152 966.", [("id_number", "00 951 152 966")]), ("his SSN is 924-84-6499", [("id_number", "924-84-6499")]),
        ("ID card no. =\nBCL 464585. The", [("id_number", "BCL 464585")]), ("driving licence D951-4788-5714", [("id_number", "D951-4788-5714")]), ("Send it to\n2245 Harrowgate Lane, Apt 3B, Ostermark, ZX 00639.", [("address", "2245 Harrowgate Lane, Apt 3B, Ostermark, ZX 00639")]),
        ("wohnhaft Birkenweg 8, 00454 Ostermark.", [("address", "Birkenweg 8, 00454 Ostermark")]), ("45 impasse des Forges, 00304 Lindhaven, bye", [("address", "45 impasse des Forges, 00304 Lindhaven")]), ("P.O. Box 2371, Tarnfield, ZX 00181", [("address", "P.O. Box 2371, Tarnfield, ZX 00181")]),
        ("I met Ingrid\nSOLELAN and Krasson, Ingrid with L. Krasson", [("name", "Ingrid SOLELAN"), ("name", "Krasson, Ingrid"), ("name", "L. Krasson")]), ("Merci d'appeler M. Krasson au matin", [("name", "Krasson")]),
        ("Hi Mark,\nIn May the mark was missed and will slip. Krasson Logistics called.\n\nWill", [("name", "Mark"), ("name", "Will")]), (None, []), ("", []),
    ],
)
def test_spans(t, want):
    assert [(k, x) for _, _, k, x in pii.spans(t, NAMES)] == want


def test_redaction_keeps_the_rest():
    t = "> Hi Ingrid,\r\n> call 415-555-0132,\r\n> now"
    assert pii.redact(t, NAMES) == "> Hi [NAME],\r\n> call [PHONE],\r\n> now"
    assert pii.redact(None, NAMES) is None


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.dni("12345678Z") and not pii.dni("12345678A")
    assert pii.tax_id("86095742719") and not pii.tax_id("86095742718")


def test_checksums_decide_without_a_keyword():
    found = lambda t: [x for _, _, k, x in pii.spans(t, NAMES) if k == "id_number"]
    assert found("Kraubo, 12345678Z, Maren") == ["12345678Z"] and found("Kraubo, 12345678A, Maren") == []
    assert found("X1234567L signed") == ["X1234567L"] and found("X1234567A signed") == []
    assert found("1 84 12 76 451 089 46 signed") == ["1 84 12 76 451 089 46"] and found("1 84 12 76 451 089 47 signed") == []
    assert found("046 454 286 (SIN)") == ["046 454 286"] and found("046 454 287 (SIN)") == [] and found("046 454 286 crates") == []
    assert found("86095742719 is the tax number") == ["86095742719"] and found("86095742718 is the tax number") == []
    assert found("See invoice 046454286 for the SIN") == []
    assert found("the identity\n> card 89802160E. Bye") == ["89802160E"]


def test_find_cases(spark):
    df = spark.createDataFrame([(1, "From: Ingrid Solelan\nTo: Solelan, Ingrid\n", "Ingrid Solelan <i@x.test>", "s"), (1, "From: Ingrid Solelan\nTo: Solelan, Ingrid\n", "Ingrid Solelan <i@x.test>", "s"), (2, None, None, None), (None, "a@b.test", None, None)], "id bigint, body string, from_address string, found_text string")
    assert rows(pii.find(df)) == sorted([(1, "body", "name", "Ingrid Solelan"), (1, "body", "name", "Solelan, Ingrid"), (1, "from_address", "email", "i@x.test"), (1, "from_address", "name", "Ingrid Solelan")], key=repr)
    assert pii.find(df.limit(0)).count() == 0


def test_rare_header_names_count_at_every_size(spark):
    mails = [(i, f"Dear Tobrin,\nJasvik Ordelmann called {i}.", "Mark Wenelan <m@x.test>") for i in range(60)] + [(90, "To: Jasvik Ordelmann <j@x.test>\n\nok", "o@x.test"), (91, None, "Krellhoff, Tobrin <t@x.test>"), (92, "> Hi TOBRIN,\r\n> ok", None)]
    df = spark.createDataFrame(mails, "id bigint, body string, from_address string")
    whole, cut = pii.find(df), pii.find(df, share=20)
    assert not {"jasvik", "tobrin", "ordelmann"} & (set(pii.header_names(df, 20).given) | set(pii.header_names(df, 20).surnames))
    assert rows(whole) == rows(cut) and {r.found_text for r in cut.collect()} >= {"Tobrin", "Jasvik Ordelmann", "Krellhoff, Tobrin", "TOBRIN"}
    assert rows(pii.redacted(df)) == rows(pii.redacted(df, share=20))


def test_names_in_lower_case():
    t = "hi ingrid,\nplease ask mark wenelan, l. krasson and solelan,\ningrid.\nWe will mark it in june, will solely. Thanks,\ningrid"
    assert [x for _, _, k, x in pii.spans(t, NAMES)] == ["ingrid", "mark wenelan", "l. krasson", "solelan, ingrid", "ingrid"]


# ---- 6 and 10: pairs and languages


@pytest.fixture(scope="module")
def model(spark):
    return language.fit_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize(
    "q,a,want",
    [
        ("What is the cap in the 2001 licence A?", None, "empty"), ("q", "<think></think><answer>​</answer>", "empty"), ("What is the cap in the 2001 licence A?", "<answer>what is the cap in the 2001 licence a</answer>", "copies_question"),
        ("What is the cap in the 2001 licence A?", "You asked: What is the cap in the 2001 licence A? The cap is 5 million crowns.", None), ("What is the cap in the 2001 licence A?", "I'm sorry, but I can't help with that request.", "refusal"),
        ("What is the cap in the 2001 licence A?", "The supplier cannot provide a later version, but the cap of licence A is 5 crowns.", None), ("What is the cap in the 2001 licence A?", "<answer>The cap is five mil", "truncated"), ("What is the cap in the 2001 licence A?", "5.1", None),
        ("What is the cap in the 2001 licence A?", "Maren", None), ("What is the cap in the 2001 licence A?", "Die Haftung ist nach dem Vertrag auf fünf Millionen Kronen begrenzt.", "other_language"),
    ],
)
def test_pair_defects(spark, model, q, a, want):
    df = spark.createDataFrame([("t", q, a, "x")], "trajectory_id string, question string, final_answer string, defect string")
    assert [r.defect for r in pairs.defects(df, model).collect()] == ([want] if want else [])


def test_shortened_equals_brute_force(spark):
    rng = random.Random(7)
    full = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts = sorted({*full, *(t[: rng.randint(3, len(t))] for t in full)})
    want = {t for t in texts if len(t.split()) >= 2 and any(u != t and u.startswith(t) and re.match(r"\w| ", u[len(t) :]) for u in texts)}
    got = {r.a for r in pairs.shortened(spark.createDataFrame([(t,) for t in texts], "a string"), "a").collect()}
    assert got == want


@pytest.mark.parametrize("label,code", [("eng", "en"), ("de-AT", "de"), ("English", "en"), ("fr_FR", "fr"), ("zho", "zh"), ("??", None), ("und", None), ("", None), (None, None), ("unknown", None), ("ja", "ja")])
def test_label_code(label, code):
    assert language.label_code(label) == code


def test_languages_held_out(spark, model):
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text", "lang").limit(1500).collect() if r.text and language.label_code(r.lang)]
    right = sum(language.identify(model, r.text)[0] == language.label_code(r.lang) for r in docs)
    assert right / len(docs) > 0.85  # labels themselves are wrong in part


def test_model_is_trained_on_every_text(spark):
    """Long texts, rare languages and copies: the distributed counts are those of all different texts."""
    en = [f"The supplier must pay each invoice within {'x' * (i % 9 + 1)}ten days because it is due." for i in range(400)]
    long = ["Najemca odpowiada za szkody, ponieważ umowa nie została rozwiązana. " * 200 + "x", "De huurder moet de rekening betalen voordat het contract wordt beëindigd. " * 3]
    df = spark.createDataFrame([(x,) for x in [*en, *long, *[long[1]] * 50, "", None, "中文"]], "text string")
    want = language.fit({x for x in [*en, *long, "中文"]})
    got = language.fit_on(df)
    assert (got.table == want.table).all()
    assert (language.fit([]).table != want.table).any(axis=1)[language.LATIN.index("pl")]


def test_language_cases(spark, model):
    df = spark.createDataFrame(
        [(1, "The supplier must pay each invoice within ten days.", None), (2, "Der Lieferant muss alle Rechnungen rechtzeitig begleichen.", "en"), (3, "The draft was sent out this morning. Der Mieter haftet für unmittelbare Schäden, weil der Vertrag nichts anderes vorsieht.", "English"), (4, None, None), (5, " \n", "de"), (6, "9da5c79587f3ac54", None), (7, "供应商根据附件57的规定不得转让其权利。", "zh-CN")],
        "doc_id bigint, text string, lang string",
    )
    got = language.issues(language.detect(df, model=model))
    assert rows(got) == sorted([(1, "missing", "en"), (2, "wrong", "de"), (3, "mixed", "de"), (3, "mixed", "en"), (3, "wrong", "de")], key=repr) or rows(got) == sorted([(1, "missing", "en"), (2, "wrong", "de"), (3, "mixed", "de"), (3, "mixed", "en")], key=repr)
    assert language.detect(df.limit(0), model=model).count() == 0


# ---- 7: mails

MAIL = "Hi Mark,\n\nThe draft is ready, margin >\n> 97% was the target.\n\nBest,\nIngrid\n\n-- \nIngrid Solelan\nTrader\nPh: 415.555.0141\n\nThis mail is confidential. If it reached you by mistake, delete it and tell the sender.\n\n-----Original Message-----\nFrom: Mark Wenelan\nSent: 2001-01-01 10:00\nTo: Solelan, Ingrid\nSubject: x\n\nOld text.\n"


def test_mail_parts(spark):
    df = spark.createDataFrame([(1, "s", MAIL, "b"), (2, "s", "ok\n\nOn 2001-01-01 10:00, Mark Wenelan <m@x.test> wrote:\n> old\n> older\n\nmore new text", "b"), (3, None, None, None), (4, "s", "The memo is confidential until Monday.\n\nRegards\nMark", "b"), (5, "s", "see you\n\nSent from my handheld", "b")], "id bigint, subject string, body string, block string")
    assert rows(mailtext.blocks(df)) == sorted([(1, "disclaimer"), (1, "quote"), (1, "signature"), (2, "quote"), (5, "signature")])
    new = {r.id: r.new_text for r in mailtext.reduced(df).collect()}
    assert new[1] == "Hi Mark,\n\nThe draft is ready, margin >\n> 97% was the target.\n\nBest,\nIngrid" and new[2] == "ok\n\nmore new text" and new[3] == "" and new[5] == "see you"
    assert mailtext.blocks(df.limit(0)).count() == 0


# ---- 9: mixing


def test_flight_keeps_counts_and_sizes():
    rng = random.Random(8)
    sizes = [float(rng.randint(1, 900)) for _ in range(4000)]
    p = mixing.landing(sizes, mixing.flight(sizes, [0.37] * 4000, [rng.random() for _ in range(4000)]), [rng.random() for _ in range(9)])
    assert set(p) == {0.0, 1.0} and abs(sum(p) - 0.37 * 4000) <= 1
    assert abs(sum(x * s for x, s in zip(p, sizes)) - 0.37 * sum(sizes)) <= 2 * max(sizes)


def test_mix_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rng = random.Random(9)
    docs = [(i, rng.choice(["a"] * 8 + ["B "] * 2 + [None]), " word" * rng.randint(1, 60)) for i in range(1500)] + [(2000, "a", None), (2001, "a", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("uses", F.lit(1))
    t = spark.createDataFrame([("A", 0.4, 1), ("b", 0.5, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t).cache()
    s = {r.source: r for r in mixing.shares(m, t).collect()}
    assert s["none"].n_docs == 0 and s["a"].most_uses <= 1 and s["b"].most_uses <= 3
    assert s["a"].reached_share == pytest.approx(0.4 / 0.9, abs=0.01) and s["b"].reached_share == pytest.approx(0.5 / 0.9, abs=0.01)
    assert m.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.mix(d.limit(0), t).count() == 0


# ---- all queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_and_match_sql(spark, name):
    import duckdb

    df = queries.queries()[name](spark, DATA)
    got = rows(df)
    if name in queries.oracle_sql():
        c = duckdb.connect()
        for n in os.listdir(DATA):
            c.execute(f"CREATE VIEW {n.split('.')[0]} AS SELECT * FROM '{DATA}/{n}'")
        assert got == sorted(c.execute(queries.oracle_sql()[name]).fetchall(), key=repr)
    elif name.endswith("_found"):
        assert got


def test_runs_symbols_are_those_of_the_event_wherever_it_stands():
    a, b = ("search", '{"q": "annual report"}'), ("search", '{"q": "notice period"}')
    x = runs.symbols([a, b, a, (None, None), ("search", '{"q": "anual report"}'), ("search", '{"q": "annuall report"}'), a])
    assert x[0] == x[2] == x[4] == x[5] == x[6] and x[1] != x[0] and x[3] not in (x[0], x[1])


@pytest.mark.parametrize("a, b, same", [
    (("get_message", '{"message_id": 1}'), ("get_message", '{"message_id": 2}'), False),
    (("cancel", '{"job_id": "a1"}'), ("cancel", '{"job_id": "zz9"}'), False),
    (("subtract", '{"operands": [3, 10]}'), ("subtract", '{"operands": [10, 3]}'), False),
    (("find", '{"words": ["lease", "rent"]}'), ("find", '{"words": ["rent", "lease"]}'), True),
    (("find", '{"q": "x", "attempt": 1, "sent_at": 17}'), ("find", '{"q": "x", "attempt": 2, "sent_at": 18}'), True),
])
def test_runs_what_is_the_same_call(a, b, same):
    assert (runs.symbols([a, b])[0] == runs.symbols([a, b])[1]) is same


def test_pairs_shortened_looks_past_the_next_answer(spark):
    texts = ["foo bar", "foo bar, x", "foo barn door", "the price is five thousan", "the price is five thousan-x", "the price is five thousand crowns.", "abc def", "abc def."]
    assert {r.t for r in pairs.shortened(spark.createDataFrame([(x,) for x in texts], "t string"), "t").collect()} == {"foo bar", "the price is five thousan"}


def test_pairs_shortened_equals_brute_force_over_task_borders(spark):
    rng = random.Random(3)
    texts = sorted({" ".join(rng.choice(["a", "ab", "abc", "b", "a,", "b-"]) for _ in range(rng.randint(1, 5))) for _ in range(1500)})
    got = {r.t for r in pairs.shortened(spark.createDataFrame([(x,) for x in texts], "t string"), "t").collect()}
    assert got == {a for a in texts if pairs._unfinished(a) and any(pairs._continued(a, b) for b in texts)}


def test_mixing_landing_has_the_least_token_error():
    sizes, probs = [5000.0, 10.0, 30.0], [0.5, 0.5, 0.5]
    p = mixing.landing(sizes, probs, [0.1])
    error = lambda t: abs(sum((x - q) * s for x, q, s in zip(t, probs, sizes)))
    assert error(p) == min(error(t) for t in itertools.product((0.0, 1.0), repeat=3))


def test_mixing_shares_are_met_within_half_a_percent(spark):
    docs, targets = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "mix_targets"))
    rows = mixing.shares(mixing.mix(docs, targets), targets).where("n_tokens > 0").collect()
    wanted = sum(r.target_share for r in rows)
    assert max(abs(r.reached_share / (r.target_share / wanted) - 1) for r in rows) < 0.005


def test_tokens_join_reads_only_the_end_of_the_left_text():
    path, rng = tokens.TOKENIZER, random.Random(5)
    enc = tokens.encoding(path)
    for _ in range(500):
        x = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'s", "12", ".", "é", "中", "don't", "\t", "\u00a0", "\x1c", "word"]) for _ in range(rng.randint(0, 60)))
        assert tokens.encode_tree(path, x, rng.choice([1, 3, 7, 17])) == enc.encode_ordinary(x)
    assert tokens._last_start("x " * 100_000) > 199_000 and tokens._last_start("x" * 1000) == 0


def test_languages_the_model_does_not_know(model):
    for text in ("Avtalet ska gälla från och med den första januari och kan sägas upp av vardera parten.", "Sözleşme ocak ayının birinden itibaren geçerlidir ve taraflarca feshedilebilir.", "Smlouva platí od prvního ledna a může být vypovězena kteroukoli ze stran."):
        assert language.identify(model, text)[0] == "other"
    assert language.identify(model, "The cat sat quietly by the window while rain fell on the empty street.")[0] == "en"


def test_unknown_languages_are_no_wrong_labels(spark, model):
    df = spark.createDataFrame([(1, "Avtalet ska gälla från och med den första januari och kan sägas upp av vardera parten.", "sv")], "doc_id bigint, text string, lang string")
    r = language.detect(df, model=model).collect()[0]
    assert r.lang is None and r.confidence == 0 and r.segments[0].lang == "other" and language.issues(language.detect(df, model=model)).count() == 0


@pytest.mark.parametrize("text, kinds", [
    ("Pay to GB82 WEST 1234 5698 7654 32 please", ["iban"]), ("Pay to GB82 WEST 1234 5698 7654 33 please", []), ("DE89370400440532013000 is it", ["iban"]), ("DE89370400440532013001 is it", []),
    ("on 4111 1111 1111 1111 then", ["card"]), ("on 4111 1111 1111 1112 then", []), ("on 378282246310005 then", ["card"]), ("on 378282246310006 then", []),
    ("then 12345678Z stands", ["id_number"]), ("then 12345678A stands", []), ("X1234567L applied", ["id_number"]), ("X1234567A applied", []),
    ("2 55 08 14 168 025 38 noted", ["id_number"]), ("2 55 08 14 168 025 39 noted", []), ("046 454 286 is my social security card", ["id_number"]),
])
def test_checksums_decide_what_no_word_tells(text, kinds):
    assert [k for _, _, k, _ in pii.spans(text, NAMES)] == kinds
