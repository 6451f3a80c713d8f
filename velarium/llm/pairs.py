"""Defects of question and answer pairs: empty, truncated, refusal, copy of the question, other language.

Shortened answers are found by sorting all answers by text: those that begin with a given answer follow
it without a gap, so one pass that keeps the answers still open as prefixes of the one at hand compares
each with all that continue it. Lengths
at which far more answers stop in mid-sentence than around them are taken for a length limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import kept, one_row_per, spread, tasks
from velarium.llm.language import Model, identify_all, words_of

_TAG = re.compile(r"</?[A-Za-z_][\w-]*\s*/?>")
_BLANK = re.compile(r"[\s​-‍⁠﻿]+")
_THINK = re.compile(r"(?is)<think>.*?</think>")
_OPEN = re.compile(r"(?is)<(answer|think)>(?!.*</\1>)|</?[a-z]{0,10}$")
_END = re.compile(r"[.!?…。！？:][\"'”’»)\]]*$")
_WORD = re.compile(r"[^\W_]+")
#: Words put before a repeated question. Fixed values.
_FRAME = re.compile(r"(?i)^\s*(?:you asked|the question (?:is|was)|question|your question|frage|pregunta|q)\s*[:)]\s*")
#: Ways to decline in the languages of the questions and some others. Fixed values.
_REFUSAL = re.compile(
    r"(?i)\bi(?:'m| am)?(?:,? \w+,?)? (?:(?:do not|don't|did not|can ?not|can't|could not|couldn't|won't|will not|am not|'m not|must not)(?: be)? (?:able to |allowed to |permitted to |going to |in a position to |have enough access to |feel able to )?"
    r"(?:answer|help|assist|share|discuss|provide|give|disclose|respond|comply|comment|reveal|talk|speak|do that|fulfil|support|say)|(?:unable|not able|not allowed|not permitted|not authori[sz]ed|not in a position) to|(?:must|have to|will have to|need to|will)? ?(?:decline|refrain|refuse|pass on)|(?:would|'d) (?:rather|prefer) not)"
    r"|\bi (?:do not|don't|would not|wouldn't) (?:feel comfortable|feel right|want to|wish to|think i (?:can|should))|\b(?:not|un)comfortable (?:with )?(?:talking|answering|discussing|sharing|giving)|nicht wohl dabei|pas à l'aise|no me siento cómod|\bi'm (?:unable|not able|not allowed|not permitted|not authori[sz]ed) to|\bi(?:'d| would) rather not|\bi (?:must|have to|will have to) (?:decline|refrain|refuse|pass)|^\W*(?:unable|not able) to (?:comply|answer|help|assist|provide)"
    r"|(?:outside|beyond) what i(?:'m| am) allowed|not something i can (?:help|answer|discuss|share)|isn't something i can|request (?:can't|cannot|can not) be (?:fulfilled|met|answered)|no (?:answer|comment|information) (?:will|can) be given"
    r"|answering (?:\w+ )?would (?:go against|violate|breach)|(?:guidelines|policy|policies|instructions|rules) (?:don't|do not|doesn't|does not) (?:permit|allow)|not be appropriate for me to|against my (?:instructions|guidelines|policy)"
    r"|kann ich\b[^.]{0,60}\b(?:nicht (?:helfen|beantworten|antworten|sagen|weiterhelfen)|keine (?:auskunft|angaben|antwort|informationen))|darf ich\b[^.]{0,60}\b(?:nicht|keine)\b|ich (?:kann|darf|möchte)\b[^.]{0,60}\b(?:nicht|keine)\b[^.]{0,40}\b(?:helfen|beantworten|antworten|geben|sagen|teilen)|tut mir leid"
    r"|je (?:ne )?(?:peux|puis|suis|dois|souhaite)\b[^.]{0,20}\b(?:pas|refuser|décliner)\b[^.]{0,30}(?:répondre|aider|fournir|parler|donner|autoris|partager|demande)|je suis désolé|je regrette, mais|m'est impossible|je préfère ne pas"
    r"|lo siento|no (?:puedo|debo) (?:ayudar|dar|responder|proporcionar|compartir|hablar|facilitar|contestar)|no me está permitido|no estoy autorizad|no se me permite|prefiero no"
    r"|mi dispiace|non (?:posso|sono autorizzat)|não (?:posso|estou autorizad)|lamento, mas|het spijt me|kan ik (?:niet|geen)|mag ik (?:niet|geen)|nie (?:mogę|wolno mi)|przykro mi|не могу|не имею права|к сожалению, я|我(?:无法|不能)|抱歉"
)


def words(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def answer_of(text: str) -> str:
    """The answer itself: what an answer tag holds, else all but the reasoning; without tags."""
    rest = _THINK.sub(" ", text)
    m = re.search(r"(?is)<answer>(.*?)(?:</answer>|$)", rest)
    return _TAG.sub(" ", m.group(1) if m and m.group(1).strip() else rest).strip()


def is_empty(text: str | None) -> bool:
    return not _BLANK.sub("", _TAG.sub("", text or ""))


def stops_midway(text: str) -> bool:
    """Whether an answer has an open tag, or is a sentence without an end."""
    if _OPEN.search(text.strip()):
        return True
    body = answer_of(text)
    return len(body.split()) >= 4 and not _END.search(body) and not words_of(body)[0]


def copies(question: str | None, answer: str) -> bool:
    """Whether an answer only repeats the question."""
    body = answer_of(answer)
    q, a = words(_FRAME.sub("", question or "")), words(_FRAME.sub("", body))
    if len(q) < 4 or len(a) < 0.6 * len(q):
        return False
    if not {w for w in q if any(c.isdigit() for c in w)} <= set(a):
        return False
    common = len(set(a) & set(q))
    if len(a) > len(q) and set(a) <= set(q):
        return True  # the question more than once
    return len(a) <= 1.15 * len(q) + 1 and common >= 0.85 * len(set(a)) and common >= 0.7 * len(set(q))


def refuses(question: str | None, answer: str) -> bool:
    """Whether an answer declines: it has a phrase that does, and no other sentence that answers."""
    body = answer_of(answer).replace("’", "'")
    asked = words(question or "")
    if not _REFUSAL.search(body):
        return False
    for s in re.split(r"(?<=[.!?。！？])\s+|\n", body):
        if _REFUSAL.search(s):
            continue
        w = words(s)
        if sum(x in asked for x in w) >= 4 and any(x not in asked for x in w) and len(w) >= 6:
            return False
    return True


def defects(pairs: DataFrame, model: Model, id_col: str = "trajectory_id", question_col: str = "question", answer_col: str = "final_answer") -> DataFrame:
    """``(id, defect)`` of each defective pair; one defect a pair, the first that holds of empty,
    copies_question, refusal, truncated and other_language.

    Each id counts once (rows repeated with other texts: the first by text). A null answer is
    empty; without a question only empty, refusal and truncated can hold. Null ids are left out;
    other columns are ignored; an empty table gives an empty one.
    """
    spark = pairs.sparkSession
    rows = one_row_per(pairs.select(F.col(id_col).alias("_id"), F.col(question_col).alias("q"), F.col(answer_col).alias("a")), "_id")
    id_type = rows.schema["_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known: dict[str, str | None] = {}
        for b in batches:
            out, bodies = [], {}
            for k, (i, q, a) in enumerate(zip(b["_id"], b["q"], b["a"])):
                midway, defect = False, None
                if is_empty(a):
                    defect = "empty"
                elif copies(q, a):
                    defect = "copies_question"
                elif refuses(q, a):
                    defect = "refusal"
                elif stops_midway(a):
                    defect, midway = "truncated", True
                elif q and (body := answer_of(a)) and (words_of(body)[0] or len(body.split()) >= 4):
                    bodies[k] = body
                out.append([i, defect, midway, (a or "").strip(), len(a or "")])
            # Languages of all questions and answers at once.
            if len(known) > 50_000:
                known.clear()
            new = list({q for k in bodies if (q := b["q"].iloc[k]) not in known})
            known |= {q: lang for q, (lang, _) in zip(new, identify_all(m, new))}
            for k, (lang, sure) in zip(bodies, identify_all(m, bodies.values())):
                asked = known[b["q"].iloc[k]]
                if asked and lang and "other" not in (asked, lang) and lang != asked and sure > 0.9:
                    out[k][1] = "other_language"
            yield pd.DataFrame(out, columns=["_id", "defect", "midway", "a", "n"])

    judged = kept(spread(rows, "_id").mapInPandas(rules, f"_id {id_type}, defect string, midway boolean, a string, n int"))  # read several times below
    open_ = judged.where(F.col("defect").isNull() | F.col("midway"))
    short = shortened(open_.select("a"), "a")
    limits = length_limits(judged.groupBy("n").agg(F.count(F.lit(1)).alias("all"), F.count_if("midway").alias("cut")))
    cut = (
        judged.where(F.col("defect").isNull())
        .join(short, "a", "left_semi")
        .unionByName(judged.where(F.col("defect").isNull() & ~F.col("a").rlike(r"[.!?…。！？][\"'”’»)\]]*(</answer>)?$") & (F.size(F.split("a", " ")) >= 3)).join(limits, "n", "left_semi").select("a", "_id", "defect", "midway", "n"))
        .select("_id", F.lit("truncated").alias("defect"))
    )
    return judged.where(F.col("defect").isNotNull()).select("_id", "defect").unionByName(cut).distinct().withColumnRenamed("_id", id_col)


def length_limits(lengths: DataFrame) -> DataFrame:
    """``(n)``: lengths at which at least 20 answers stop midway, ten times as many as on average within 10 characters around."""
    w = F.floor(F.col("n") / 20)
    near = lengths.groupBy(w.alias("w")).agg(F.avg("cut").alias("mean"), F.max("cut").alias("top"), F.sum("cut").alias("sum"))
    others = (F.col("sum") - F.col("cut")) / 19
    return lengths.withColumn("w", w).join(near, "w").where((F.col("cut") >= 20) & (F.col("cut") >= 10 * others)).select("n")


def shortened(texts: DataFrame, col: str) -> DataFrame:
    """Texts that another text continues in mid-word or mid-sentence, each once.

    A text counts only if it does not itself end like a sentence and has two words or more, so that
    complete short answers are not taken for the beginnings of longer ones. Sorting is by range, so
    no task holds more than its part however many texts begin alike; a text that is still open at
    the end of its task is compared with the tasks after it.
    """
    spark = texts.sparkSession
    rows = kept(texts.select(F.col(col).alias("t")).where(F.length("t") > 0).distinct().repartitionByRange(tasks(spark), "t").sortWithinPartitions("t"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, first, open_ = TaskContext.get().partitionId(), None, []
        for b in batches:
            out = []
            for t in b["t"]:
                if first is None:
                    first = t
                    out.append((task, "first", t))
                out += [(task, "found", a) for a in open_ if _continued(a, t)]
                # Texts that the one at hand doesn't begin with can't begin a later one.
                open_ = [a for a in open_ if t.startswith(a) and not _continued(a, t)]
                if _unfinished(t):
                    open_.append(t)
            yield pd.DataFrame(out, columns=["task", "kind", "t"])
        yield pd.DataFrame([(task, "open", a) for a in open_], columns=["task", "kind", "t"])

    seen = kept(rows.mapInPandas(near, "task int, kind string, t string"))
    found = seen.where("kind = 'found'").select(F.col("t").alias(col))
    # At most the prefixes of one text for each task, and the tasks whose first text begins with them.
    first = seen.where("kind = 'first'").select(F.col("task").alias("later"), F.col("t").alias("f"))
    left = seen.where("kind = 'open'").join(F.broadcast(first), (F.col("later") > F.col("task")) & F.startswith("f", "t")).select(F.col("later").alias("task"), F.col("t").alias("a"))
    beyond = (
        rows.withColumn("task", F.spark_partition_id())
        .join(F.broadcast(left), "task")
        .where(F.startswith("t", "a") & F.expr("substring(t, length(a) + 1, 1)").rlike(r"(?U)[\w ]"))
        .select(F.col("a").alias(col))
    )
    return found.unionByName(beyond).distinct()


def _unfinished(a: str) -> bool:
    return len(a.split()) >= 2 and not _END.search(_TAG.sub("", a).strip())


def _continued(a: str, b: str) -> bool:
    """Whether ``b`` goes on where ``a`` stops, within a word or with the next."""
    return b.startswith(a) and len(b) > len(a) and (b[len(a)] == " " or bool(re.match(r"\w", b[len(a)])))
