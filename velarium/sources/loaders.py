"""Readers for tables, documents and logs. All are lazy and split by Spark's own readers where one exists."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, title string, text string, metadata_json string"


def load(spark: SparkSession, path: str, **options: str) -> DataFrame | dict[str, DataFrame]:
    """A table told from its suffix; a folder gives a table for each file, named by its stem."""
    low = path.lower()
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if os.path.isdir(path):
        return folder(spark, path)
    if low.endswith(".csv"):
        return csv(spark, path, options.get("delimiter", ","))
    if low.endswith((".json", ".jsonl")):
        return json(spark, path)
    raise ValueError(f"no reader for {path!r}; names of hosted data sets can't be read")


def csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    return spark.read.option("sep", delimiter).option("multiLine", True).option("escape", '"').csv(path, header=True, inferSchema=True)


def json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or one array or object over several lines."""
    return spark.read.option("multiLine", not path.lower().endswith(".jsonl")).json(path)


def folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each file of a folder as a split named by its stem; an error if none fits."""
    found = {os.path.splitext(n)[0]: load(spark, os.path.join(path, n)) for n in sorted(os.listdir(path)) if n.lower().endswith((".parquet", ".csv", ".json", ".jsonl"))}
    if not found:
        raise ValueError(f"no data files in {path!r}")
    return found


def sliced(df: DataFrame, spec: str, order: str) -> DataFrame:
    """Rows ``[a:b]`` or ``[i]`` of an order; the end is clipped, negative numbers are refused."""
    from velarium.operators.windows import order_position

    m = re.fullmatch(r"\[(\d+)?(?:(:)(\d+)?)?\]", spec)
    if not m:
        raise ValueError(f"not a slice: {spec!r}")
    a = int(m[1] or 0)
    b = int(m[3]) if m[3] else (None if m[2] else a + 1)
    ranked = order_position(df, F.xxhash64(F.lit(0)).cast("double") * 0, order)
    return ranked.where((F.col("rank0") >= a) & ((F.col("rank0") < b) if b is not None else F.lit(True))).drop("rank0")


def audit_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an audit log; blank and malformed lines are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v")).where("v is not null and r is not null").select("r.*")


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(input, label)`` of a test set: objects as they are, any other line as an input without label."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    obj = F.schema_of_variant(v).startswith("OBJECT")
    return raw.select(F.when(obj, F.try_variant_get(v, "$.input", "string")).otherwise(F.col("value")).alias("input"), F.when(obj, F.try_variant_get(v, "$.label", "string")).alias("label"))


def contracts(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, title, text)`` of all .txt files below a folder; blank ones are skipped."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("text"))
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode("f"), "/"), -1), r"\.txt$", "")
    return t.where(F.trim("text") != "").select(stem.alias("doc_id"), stem.alias("title"), "text")


SQUAD = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"


def squad_contracts(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, title, text, question_id, question, category, answers)``; an error unless each contract has one paragraph.

    The category is the part of the id after the title, without a closing number.
    """
    d = spark.read.option("multiLine", True).schema(SQUAD).json(path).select(F.explode("data").alias("d")).select("d.*")
    one = F.when(F.size("paragraphs") == 1, F.get("paragraphs", 0)).otherwise(F.raise_error(F.concat(F.lit("not one paragraph: "), "title")))
    q = d.select("title", one.alias("p")).select("title", F.col("p.context").alias("text"), F.explode("p.qas").alias("q"))
    category = F.regexp_replace(F.element_at(F.split("q.id", "__"), -1), r"_\d+$", "")
    return q.select(F.col("title").alias("doc_id"), "title", "text", F.col("q.id").alias("question_id"), F.col("q.question").alias("question"), category.alias("category"), F.col("q.answers").alias("answers"))


def filings(spark: SparkSession, path: str) -> DataFrame:
    """``(ticker, tokens)`` of HTML filings: the name before '-' or '_' in upper case, files of one ticker in order."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    t = f.select(F.upper(F.regexp_extract(name, r"^([^-_.]+)", 1)).alias("ticker"), name.alias("name"), visible_text(F.col("content").cast("string")).alias("text"))
    toks = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    return t.select("ticker", "name", toks.alias("a")).groupBy("ticker").agg(F.flatten(F.sort_array(F.collect_list(F.struct("name", "a")))["a"]).alias("tokens"))


class _Visible(HTMLParser):
    HIDDEN = {"script", "style", "nav", "footer", "header", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.title, self.in_title = 0, [], "", False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.HIDDEN
        self.in_title |= tag == "title"
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4"):
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.HIDDEN and self.depth > 0
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.depth:
            self.parts.append(data)


def _html(text: str | None) -> tuple[str, str]:
    p = _Visible()
    p.feed(text or "")
    p.close()
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(p.parts).splitlines()]
    return p.title.strip(), "\n".join(x for x in lines if x)


def visible_text(html: Column) -> Column:
    """Text a reader sees; scripts, styles and page furniture dropped."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: _html(x)[1])

    return F.pandas_udf(run, "string")(html)


def _parts(name: str, data: bytes) -> Iterator[tuple[str, str, str]]:
    """``(id suffix, title, text)`` of each document in a file."""
    stem, ext = os.path.splitext(name)
    ext = ext.lower()
    if ext in (".txt", ".md", ".markdown"):
        yield "", stem, data.decode("utf-8", "replace")
    elif ext in (".html", ".htm"):
        title, text = _html(data.decode("utf-8", "replace"))
        yield "", title or stem, text
    elif ext == ".csv":
        rows = pd.read_csv(io.BytesIO(data), dtype=str, keep_default_na=False)
        for i, r in enumerate(rows.to_dict("records")):
            yield f"::row{i}", stem, "\n".join(f"{k}: {v}" for k, v in r.items())
    elif ext in (".json", ".jsonl"):
        import json as j

        text = data.decode("utf-8", "replace")
        objs = [j.loads(x) for x in text.splitlines() if x.strip()] if ext == ".jsonl" else j.loads(text)
        for i, o in enumerate(objs if isinstance(objs, list) else [objs]):
            yield f"::obj{i}", stem, o if isinstance(o, str) else j.dumps(o, ensure_ascii=False)
    elif ext == ".docx":
        xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8")
        paragraphs = ["".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in re.findall(r"(?s)<w:p[ >].*?</w:p>", xml)]
        yield "::section0", stem, "\n".join(x for x in paragraphs if x.strip())
    elif ext == ".pptx":
        z = zipfile.ZipFile(io.BytesIO(data))
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for i, n in enumerate(slides):
            yield f"::slide{i}", stem, "\n".join(re.findall(r"<a:t>([^<]*)</a:t>", z.read(n).decode("utf-8")))
    elif ext == ".pdf":
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise ValueError("reading PDF needs pypdf") from e
        for i, p in enumerate(PdfReader(io.BytesIO(data)).pages):
            yield f"::page{i}", stem, p.extract_text() or ""


def documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "html", "htm", "csv", "json", "jsonl", "docx", "pptx", "pdf")) -> DataFrame:
    """Documents of all files below a folder: one for each page, slide, row or object.

    A file that can't be read gives one row with a null text and the reason as ``error`` in its metadata.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json as j

        for b in batches:
            out = []
            for p, data in zip(b["path"], b["content"]):
                name = os.path.basename(p)
                try:
                    out += [(os.path.splitext(name)[0] + s, t, x, j.dumps({"file": name})) for s, t, x in _parts(name, data) if x.strip()]
                except Exception as e:  # noqa: BLE001 - one unreadable file must not end the job
                    out.append((os.path.splitext(name)[0], name, None, j.dumps({"file": name, "error": f"{type(e).__name__}: {e}"})))
            yield pd.DataFrame(out, columns=["doc_id", "title", "text", "metadata_json"])

    return files.mapInPandas(run, DOCUMENT)


def mail_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mails and recipients from raw mails with address arrays ``to``, ``cc`` and ``bcc``."""
    kinds = [raw.select(F.col("message_id").alias("email_id"), F.explode(k).alias("recipient_address"), F.lit(k).alias("recipient_type")) for k in ("to", "cc", "bcc")]
    r = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).where(F.trim("recipient_address") != "").distinct()
    return raw.drop("to", "cc", "bcc"), r


def ingestion_corpus(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A made-up ledger ``(row_id, region, department, revenue, cost)``, the same for a seed."""
    h = lambda s: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(s)), F.lit(10_000))
    pick = lambda s, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(h(s), F.lit(len(xs))) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("row_id"), pick("r", ("north", "south", "east", "west")).alias("region"), pick("d", ("sales", "service", "research")).alias("department"), (h("v") / 10.0 + 500).alias("revenue"), (h("c") / 20.0 + 200).alias("cost"))


def ingestion_truth(ledger: DataFrame) -> DataFrame:
    """Sum, margin and the region and department with the most revenue."""
    top = lambda c: ledger.groupBy(c).agg(F.sum("revenue").alias("s")).agg(F.max_by(c, F.struct("s", c)).alias(f"top_{c}"))
    return ledger.agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.round((F.sum("revenue") - F.sum("cost")) / F.sum("revenue"), 6).alias("margin")).crossJoin(top("region")).crossJoin(top("department"))


#: A trajectory as it is exported, one to a line.
TRAJECTORY = "task string, trajectory_id string, reward double, final_response string, steps array<struct<step_number: int, state: string, action: string, observation: string, thought: string, reward: double>>, metadata string"


def trajectory_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trajectories from JSON lines; a missing reward is 0, missing texts are empty, actions and metadata stay JSON text. Broken lines are left out."""
    rows = spark.read.schema(TRAJECTORY).option("mode", "DROPMALFORMED").json(path).where(F.col("task").isNotNull())
    return rows.withColumns({"reward": F.coalesce("reward", F.lit(0.0)), "final_response": F.coalesce("final_response", F.lit("")), "steps": F.coalesce("steps", F.array().cast(rows.schema["steps"].dataType))})


def _objects(spark: SparkSession, path: str, wrappers: tuple[str, ...]) -> DataFrame:
    """Objects of a JSON file that is an array, an object that wraps one, or JSON lines."""
    rows = spark.read.json(path) if path.endswith(".jsonl") else spark.read.option("multiLine", True).json(path)
    for w in wrappers:
        if w in rows.columns and rows.schema[w].dataType.typeName() == "array":
            return rows.select(F.explode(w).alias("x")).select("x.*")
    return rows


def qa_rows(spark: SparkSession, path: str) -> DataFrame:
    """Question and answer rows from a JSON array, one wrapped as ``data`` or ``rows``, or JSON lines."""
    return _objects(spark, path, ("data", "rows"))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios from a JSON array, one wrapped as ``scenarios``, or JSON lines."""
    return _objects(spark, path, ("scenarios",))


def corpus_from(df: DataFrame, text_col: str, id_col: str | None = None, title_col: str | None = None, max_docs: int | None = None) -> DataFrame:
    """``(doc_id, title, text)`` of any table's columns; rows without text are left out, a missing id is a hash of the text. ``max_docs`` is the operator's own limit."""
    out = df.where(F.length(F.trim(F.col(text_col))) > 0)
    out = out.select((F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")).alias("doc_id"), (F.col(title_col).cast("string") if title_col else F.lit("")).alias("title"), F.col(text_col).cast("string").alias("text"))
    out = out.withColumn("doc_id", F.coalesce("doc_id", F.sha1("text")))
    return out.orderBy("doc_id").limit(max_docs) if max_docs else out


def company_tables(spark: SparkSession, rows: DataFrame, table: str = "table_name") -> list[str]:
    """A view for each financial table in long form ``(table_name, row_label, column_label, value)``; the views' names in order. Tables without rows give none."""
    names = sorted(r[0] for r in rows.where(F.length(table) > 0).select(table).distinct().collect())  # one for each table of the catalog
    for n in names:
        view = "t_" + re.sub(r"\W+", "_", n.lower()).strip("_")
        rows.where(F.col(table) == n).groupBy("row_label").pivot("column_label").agg(F.first("value", ignorenulls=True)).createOrReplaceTempView(view)
    return ["t_" + re.sub(r"\W+", "_", n.lower()).strip("_") for n in names]
