"""Language of documents and of each segment of mixed-language documents.

Every sentence gets a likelihood for each language from word-bounded character n-grams. For each
document, expectation-maximisation estimates the share of each language over its sentences; a
language joins the document's set only if it raises the likelihood by more than a penalty. The
n-gram model is trained on all different texts of the corpus itself, started from function words, so
neither outside data nor the documents' labels are needed; the counting is distributed, and only the
tables, of fixed size, come to the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import kept, spread

#: Function words that start the training. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most after also did many must before back through where much your way well down should because each just those shall under still within unless between upon during despite".split(),
    "de": "der die das und ist nicht ein eine einer eines dem den des im in zu von mit auf für sich es er sie wir ihr ich auch als an nach wie bei aus durch oder aber noch nur war wird werden wurde hat haben kann muss sind sein seine dass wenn weil obwohl über bis unter zwischen ohne gegen vor während keine kein zum zur dort wer was hier diese dieser dieses so mehr sehr bitte".split(),
    "fr": "le la les de des du un une et est dans que qui ne pas pour sur au aux avec ce cette ces son sa ses il elle nous vous ils elles on par plus mais ou où donc a été sont être avoir fait comme tout très bien sans sous entre après avant pendant depuis leur leurs lui y en se si quel quelle dont n'a d'un d'une l'on parce malgré doit peut".split(),
    "es": "el la los las de del un una unos y es en que no por para con se su sus lo al como más pero o si ya todo esta este esto ese esa son fue ha han ser está están hay muy sin sobre entre después antes durante desde porque cuando quien qué cuál nos le les me mi tu nadie ni hasta también puede debe todavía".split(),
    "it": "il lo la i gli le di del della dei delle un uno una e è che non per con si su al alla ai da dal dalla nel nella sono come più ma o se anche questo questa questi quello ha hanno essere stato stata dopo prima senza sotto fra tra durante perché quando chi cosa ci mi ti loro suo sua deve può ancora sia ogni".split(),
    "pt": "o a os as de do da dos das um uma e é que não em no na nos nas por para com se seu sua ao à como mais mas ou foi são ser está estão tem há muito sem sob sobre entre depois antes durante desde porque quando quem qual isso isto este esta ele ela eles elas também pelo pela até deve pode ainda já".split(),
    "nl": "de het een en van in is dat op te voor met niet zijn aan er om ook als dan maar bij of door naar uit nog wel geen hij zij ze wij we ik je u dit deze die wat wie waar hoe omdat hoewel tot over onder tussen zonder tegen na worden wordt werd heeft hebben had kan moet mag zou zal alle meer heel".split(),
    "pl": "i w na z do nie się że to jest o za od po przez dla jak ale lub oraz a był była było są być może ma mają tylko już jeszcze tak czy co kto który która które ten ta te tego tej tym pod nad przed między bez ponieważ chociaż gdy kiedy gdzie jego jej ich nas wszystko bardzo został zgodnie musi".split(),
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему".split(),
    "zh": list("的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年"),
}
LANGS = tuple(FUNCTION_WORDS)
LATIN = tuple(x for x in LANGS if x not in ("ru", "zh"))
#: Scripts that decide the language by themselves. Fixed values.
SCRIPTS = {"zh": "㐀-䶿一-鿿", "ru": "Ѐ-ӿ", "ja": "぀-ヿ", "ko": "가-힯", "el": "Ͱ-Ͽ", "ar": "؀-ۿ", "he": "֐-׿", "th": "฀-๿", "hi": "ऀ-ॿ"}
#: Two-letter codes of languages, to tell a label that names a language from one that doesn't. Fixed values.
CODES = set("aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split())
#: Other usual names of languages. Fixed values.
NAMES = {
    "en": "eng english anglais englisch inglés ingles inglese",
    "de": "deu ger german deutsch allemand alemán aleman tedesco",
    "fr": "fra fre french français francais französisch francés frances francese",
    "es": "spa spanish español espanol castellano spanisch espagnol spagnolo",
    "it": "ita italian italiano italienisch italien",
    "pt": "por portuguese português portugues portugiesisch portugais",
    "nl": "nld dut dutch nederlands niederländisch néerlandais flemish vlaams",
    "pl": "pol polish polski polnisch polonais",
    "ru": "rus russian русский russisch russe",
    "zh": "zho chi cmn chinese mandarin 中文 汉语 漢語 chinesisch chinois",
    "ja": "jpn japanese 日本語", "ko": "kor korean 한국어", "ar": "ara arabic", "sv": "swe swedish svenska", "da": "dan danish dansk", "no": "nor norwegian norsk", "fi": "fin finnish suomi", "cs": "ces cze czech čeština", "tr": "tur turkish türkçe", "uk": "ukr ukrainian", "el": "ell gre greek", "hu": "hun hungarian magyar", "ro": "ron rum romanian", "sk": "slk slo slovak", "bg": "bul bulgarian", "he": "heb hebrew", "hi": "hin hindi", "th": "tha thai", "vi": "vie vietnamese", "id": "ind indonesian", "hr": "hrv croatian", "sr": "srp serbian", "ca": "cat catalan",
}
_NAMED = {w: k for k, v in NAMES.items() for w in v.split()}
BUCKETS = 1 << 16
#: N-grams of a language that its counts stand for at most, so that function words and unseen n-grams weigh the same in a corpus of any size.
EVIDENCE = 100_000
VOTES = [f"v{i}" for i in range(len(LATIN))]
#: Nats by which a further language must raise a document's likelihood.
PENALTY = 8.0
#: Log-likelihood of an n-gram in a language that isn't among those of the model; a sentence of ``OTHER_WORDS`` words or more that fits none better is in another.
OTHER, OTHER_WORDS = -9.8, 4
#: Nats by which a sentence must prefer its language to the document's main one to stand for it.
MARGIN = 4.0

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]}]*\s+|(?<=[。！？])|[\r\n]+")
_NOISE = re.compile(r"`[^`]*`|<[^<>]{0,80}>|\S+@\S+|https?://\S+|\b\w+\([^)]*\)?|\"\w+\"\s*:|[\x21-\x7e]*[_\d{}\[\]|/\\=][\x21-\x7e]*")
_NOISY = re.compile(r"[`<@_\d{}\[\]|/\\=\"(]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SCRIPT = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_NOT_LATIN = re.compile("[" + "".join(SCRIPTS.values()) + "]")
_HIDDEN = re.compile("[​-‏⁠﻿­\x00-\x08\x0e-\x1f\x7f]")


def label_code(label: str | None) -> str | None:
    """Two-letter code of a language label in any usual form; None if it names no language."""
    x = (label or "").strip().casefold()
    if x in _NAMED:
        return _NAMED[x]
    x = re.split(r"[-_ (,;]", x)[0]
    return _NAMED.get(x) or (x if x in CODES else None)


def sentences(text: str) -> list[str]:
    """Pieces of a text between sentence ends and line ends, in order; none are empty."""
    return [s.strip() for s in _SENTENCE.split(_HIDDEN.sub("", text)) if s and s.strip()]


def words_of(sentence: str) -> tuple[str, list[str], int]:
    """``(script language or '', words, weight)`` of a sentence without codes, names of fields and proper names."""
    clean = _NOISE.sub(" ", sentence) if _NOISY.search(sentence) else sentence
    if _NOT_LATIN.search(clean):
        counts = {k: len(p.findall(clean)) for k, p in _SCRIPT.items()}
        if counts["ja"]:
            counts["ja"] += counts["zh"]
        best = max(counts, key=counts.get)
        latin = sum(len(w) for w in _WORD.findall(clean)) - sum(counts.values())
        n = counts[best] * (2 if best in ("zh", "ja", "ko") else 1)
        if n and (n >= 0.4 * latin or n >= 8):
            return best, [], n
        clean = _NOT_LATIN.sub(" ", clean)
    words = _WORD.findall(clean)
    kept = [w for i, w in enumerate(words) if i == 0 or not w[0].isupper()]
    if len(kept) < 2:
        kept = [w for w in words if not w.isupper() or len(words) == 1]
    if words and all(w.isupper() for w in words):
        kept = words
    kept = [w.lower().replace("’", "'") for w in kept]
    return "", kept, sum(map(len, kept))


@lru_cache(maxsize=100_000)
def _grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in (2, 3, 4) for i in range(max(1, len(w) - n + 1))] + [zlib.crc32(("=" + word).encode()) % BUCKETS] * 2


class Model:
    """Log-probabilities of n-gram buckets, one row for each Latin-script language: at most 8 x 65,536 floats."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self._rows: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.table

    def __setstate__(self, table):
        self.__init__(table)

    def _row(self, w: str) -> np.ndarray:
        """A word's log-likelihoods and its number of n-grams, which count a third each as they overlap."""
        if w not in self._rows:
            if len(self._rows) > 200_000:
                self._rows.clear()
            g = _grams(w)
            self._rows[w] = np.append(self.table[:, g].sum(axis=1) / 3, len(g) / 3)
        return self._rows[w]

    def score_all(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each sentence in each Latin-script language, and its number of n-grams."""
        out = _sums(sentences, self._row, len(LATIN) + 1)
        return out[:, :-1], out[:, -1]

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of the words in each Latin-script language."""
        return self.score_all([words])[0][0]


def _sums(sentences: list[list[str]], row, width: int) -> np.ndarray:
    """For each sentence the sum of its words' rows; each different word's row is made once."""
    out = np.zeros((len(sentences), width))
    sizes = np.array([len(w) for w in sentences], dtype=np.int64)
    flat = np.array([x for w in sentences for x in w], dtype=object)
    if len(flat):
        codes, words = pd.factorize(flat)
        full = sizes > 0
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = np.add.reduceat(np.array([row(w) for w in words], dtype=np.float64)[codes], starts, axis=0)
    return out


def _tables(seen: np.ndarray) -> Model:
    """Model of n-gram counts by language, beside those of the function words."""
    counts = seen * np.minimum(1.0, EVIDENCE / np.maximum(1, seen.sum(axis=1, keepdims=True)))
    for k, lang in enumerate(LATIN):
        for w in FUNCTION_WORDS[lang]:
            np.add.at(counts[k], _grams(w), 2.0)
    # A flat prior over languages: each language's counts as if it had as much text as the others.
    counts *= counts.sum(axis=1).mean() / counts.sum(axis=1, keepdims=True)
    counts += 0.05
    return Model(np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


_STARTS = [set(FUNCTION_WORDS[k]) for k in LATIN]


def _started(w: str) -> list[float]:
    return [2.0 * (w in s) for s in _STARTS]


def _scores(model: Model | None, sentences: list[list[str]]) -> np.ndarray:
    """How well sentences fit each language: function words before there is a model."""
    if model is None:
        return _sums(sentences, _started, len(LATIN))
    x = model.score_all(sentences)[0]
    return np.maximum(x - x.max(axis=1, keepdims=True), -30.0)


def _parts(text: str) -> list[tuple[str, ...]]:
    return [tuple(w) for s in sentences(text) for script, w, _ in [words_of(s)] if not script and len(w) > 1]


def _votes(scores: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Language that each document's sentences, ``sizes`` of them in turn, prefer together; -1 if two are as good."""
    total = np.add.reduceat(scores, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), axis=0)
    top = np.sort(total, axis=1)
    return np.where(top[:, -1] > top[:, -2], total.argmax(axis=1), -1)


def _labels(scores: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Language of each sentence by its own score and its documents' votes; -1 if it isn't clear."""
    x = scores - scores.max(axis=1, keepdims=True) + 8 * votes / np.maximum(1.0, votes.sum(axis=1, keepdims=True))
    top = np.sort(x, axis=1)
    return np.where(top[:, -1] > top[:, -2] + 1, x.argmax(axis=1), -1)


def _count(seen: np.ndarray, sentences: list[list[str]], labels: np.ndarray) -> None:
    """N-grams of labelled sentences added to ``seen`` by language."""
    flat = np.array([x for w, k in zip(sentences, labels) if k >= 0 for x in w], dtype=object)
    if not len(flat):
        return
    codes, words = pd.factorize(flat)
    of = np.repeat(labels[labels >= 0], [len(w) for w, k in zip(sentences, labels) if k >= 0])
    n = np.bincount(codes * len(LATIN) + of, minlength=len(words) * len(LATIN)).reshape(-1, len(LATIN))
    grams = [_grams(w) for w in words]
    at, rep = np.concatenate(grams), [len(g) for g in grams]
    for k in range(len(LATIN)):
        if n[:, k].any():
            seen[k] += np.bincount(at, weights=np.repeat(n[:, k], rep), minlength=BUCKETS).astype(np.int64)


def fit(texts: Iterable[str], rounds: int = 2) -> Model:
    """Train on texts: function words give each document a language, then the model takes over.

    A sentence is labelled by its own likelihood and by the languages of all documents it stands in,
    so that short sentences without function words follow their usual company.
    """
    docs = [d for d in (_parts(t) for t in texts if t) if d]
    every = list(dict.fromkeys(w for d in docs for w in d))
    place = {w: i for i, w in enumerate(every)}
    model = None
    for _ in range(rounds + 1):
        score, seen = _scores(model, every), np.zeros((len(LATIN), BUCKETS), dtype=np.int64)
        votes = np.zeros((len(every), len(LATIN)))
        if docs:
            for d, k in zip(docs, _votes(score[[place[w] for d in docs for w in d]], [len(d) for d in docs])):
                if k >= 0:
                    for w in d:
                        votes[place[w], k] += 1
            _count(seen, every, _labels(score, votes))
        model = _tables(seen)
    return model


def fit_on(docs: DataFrame, text_col: str = "text", rounds: int = 2) -> Model:
    """``fit`` over all different texts of a table, each whole: votes and n-grams are counted by the tasks."""
    sc = docs.sparkSession.sparkContext
    texts = docs.where(F.length(text_col) > 0).select(F.col(text_col).alias("t")).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"d": [x for x in ([" ".join(w) for w in _parts(t)] for t in b["t"]) if x]})

    parts = kept(spread(texts, "t").mapInPandas(split, "d array<string>"))
    model = None
    for _ in range(rounds + 1):
        shared = sc.broadcast((model,))

        def vote(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = shared.value[0]
            for b in batches:
                if len(b):
                    flat = [s for d in b["d"] for s in d]
                    sizes = [len(d) for d in b["d"]]
                    k = _votes(_scores(m, [s.split(" ") for s in flat]), sizes)
                    yield pd.DataFrame({"s": flat, "k": np.repeat(k, sizes).astype("int32")}).groupby(["s", "k"], sort=False).size().reset_index(name="n")

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m, seen = shared.value[0], np.zeros((len(LATIN), BUCKETS), dtype=np.int64)
            for b in batches:
                if len(b):
                    sentences = [s.split(" ") for s in b["s"]]
                    _count(seen, sentences, _labels(_scores(m, sentences), b[VOTES].to_numpy(dtype=float)))
            flat = seen.ravel()
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"cell": at.astype("int32"), "n": flat[at]})

        votes = parts.mapInPandas(vote, "s string, k int, n bigint").groupBy("s").agg(*[F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).alias(v) for i, v in enumerate(VOTES)])
        found = spread(votes, "s").mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        seen = np.zeros(len(LATIN) * BUCKETS, dtype=np.int64)
        seen[found["cell"].to_numpy()] = found["n"].to_numpy()
        model = _tables(seen.reshape(len(LATIN), BUCKETS))
    return model


def _read(text: str | None) -> list[tuple[str, str, list[str], int]]:
    """``(sentence, script language, words, weight)`` of the sentences that have words of a language."""
    return [p for p in ((s, *words_of(s)) for s in sentences(text or "")) if p[1] or p[2]]


Mixture = tuple[list[tuple[str, float]], list[tuple[int, str, str, float, int, int]]]
NAMED = [*LATIN, *SCRIPTS, "other"]


def mixtures(model: Model, texts: Iterable[str | None]) -> list[Mixture]:
    """``mixture`` of each text; the sentences of all of them are scored together."""
    read = [_read(t) for t in texts]
    scores, grams = model.score_all([p[2] for parts in read for p in parts])
    ends = np.cumsum([0, *map(len, read)])
    return [_mixture(parts, scores[a:b], grams[a:b]) for parts, a, b in zip(read, ends, ends[1:])]


def mixture(model: Model, text: str | None) -> Mixture:
    """Languages with their shares, and ``(no, sentence, language, confidence, weight, words)`` of each sentence; "other" is a language the model doesn't know."""
    return mixtures(model, [text])[0]


def _mixture(parts: list[tuple[str, str, list[str], int]], scores: np.ndarray, grams: np.ndarray) -> Mixture:
    if not parts:
        return [], []
    names = NAMED
    like = np.full((len(parts), len(names)), -1e4)
    latin = np.array([not p[1] for p in parts])
    top = scores.max(axis=1)
    like[latin, : len(LATIN)] = (scores - top[:, None])[latin]
    long = latin & (np.array([len(p[2]) for p in parts]) >= OTHER_WORDS)
    like[long, -1] = (OTHER * grams - top)[long]
    for i in np.flatnonzero(~latin):
        like[i, names.index(parts[i][1])] = 0
    weight = np.array([p[3] for p in parts], dtype=float)

    def em(langs: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        sub = np.maximum(like[:, langs], -200.0)
        pi = np.full(len(langs), 1 / len(langs))
        for _ in range(12):
            z = sub + np.log(pi + 1e-12)
            m = z.max(axis=1, keepdims=True)
            r = np.exp(z - m)
            norm = r.sum(axis=1, keepdims=True)
            r /= norm
            pi = (weight[:, None] * r).sum(axis=0) / weight.sum()
        return float((m + np.log(norm)).sum()), pi, r

    # Languages that no sentence prefers can't help; the search goes over the rest.
    wanted = sorted({int(like[i].argmax()) for i in range(len(parts))})
    chosen = [max(wanted, key=lambda k: np.maximum(like[:, k], -200.0) @ weight / weight.mean())]
    best = em(chosen) if len(wanted) > 1 else (0.0, None, None)
    while len(chosen) < len(wanted):
        k, trial = max(((k, em([*chosen, k])) for k in wanted if k not in chosen), key=lambda x: x[1][0])
        if trial[0] - best[0] < PENALTY:
            break
        chosen.append(k)
        best = trial
    if len(wanted) == 1:
        pi, r = np.ones(1), np.ones((len(parts), 1))
    else:
        _, pi, r = best
    order = np.argsort(-pi)
    shares = [(names[chosen[k]], float(pi[k])) for k in order]
    segs = []
    # How sure a sentence's language is: its likelihood against that of all languages, not only the chosen ones.
    among = np.exp(like).sum(axis=1)
    main = chosen[int(order[0])]
    for i, (s, _script, words, n) in enumerate(parts):
        k = int(r[i].argmax())
        sure = chosen[k] == main or like[i, chosen[k]] - like[i, main] >= MARGIN
        segs.append((i, s, names[chosen[k]] if sure else names[main], float(min(1.0, np.exp(like[i, chosen[k] if sure else main]) / among[i])), int(n), len(words)))
    return shares, segs


def identify_all(model: Model, texts: Iterable[str | None]) -> list[tuple[str | None, float]]:
    """Main language of each text with a confidence from 0 to 1; ``(None, 0)`` without words of a language, ``("other", ...)`` for one the model doesn't know."""
    out = []
    for shares, segs in mixtures(model, texts):
        size: dict[str, int] = {}
        for x in segs:
            size[x[2]] = size.get(x[2], 0) + x[4]
        lang = max(size, key=lambda k: (size[k], k)) if shares else None
        own = [x for x in segs if x[2] == lang]
        out.append((lang, float(sum(x[3] * x[4] for x in own) / max(1, sum(x[4] for x in own)))))
    return out


def identify(model: Model, text: str | None) -> tuple[str | None, float]:
    """``identify_all`` of one text."""
    return identify_all(model, [text])[0]


SEGMENTS = "array<struct<segment_no: int, segment: string, lang: string, confidence: double>>"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """Language of every document: ``(id, label, label_lang, lang, confidence, langs, segments)``.

    ``lang`` is the main language, null with confidence 0 for null, empty and blank texts and for
    texts without words of a language or mainly in one that the model doesn't know, whose segments
    are "other". ``langs`` holds each language with whole sentences (three
    words or more, or six characters of a script without blanks), ``segments`` each run of
    sentences of one language. Repeated ids give repeated rows; other columns are ignored; an
    empty table gives an empty one. Texts are used whole.
    """
    model = model or fit_on(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(label_col).cast("string").alias("_label")), "_id", "_text")
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = []
            for i, label, (_, segs) in zip(b["_id"], b["_label"], mixtures(m, b["_text"])):
                size: dict[str, int] = {}
                whole: set[str] = set()
                runs: list[list] = []
                for no, s, lang, conf, n, words in segs:
                    size[lang] = size.get(lang, 0) + n
                    if lang != "other" and (words >= 3 or (lang in SCRIPTS and n >= 6)):
                        whole.add(lang)
                    if runs and runs[-1][2] == lang:
                        runs[-1][1] += " " + s
                        runs[-1][3] = min(runs[-1][3], conf)
                    else:
                        runs.append([len(runs), s, lang, conf])
                main = max(size, key=lambda k: (size[k], k)) if size else None
                conf = sum(s[3] * s[4] for s in segs if s[2] == main) / max(1, sum(size.values()))
                if main == "other":
                    main, conf = None, 0.0
                out.append((i, label, label_code(label), main, conf, sorted(whole), [dict(zip(("segment_no", "segment", "lang", "confidence"), r)) for r in runs]))
            yield pd.DataFrame(out, columns=["_id", "label", "label_lang", "lang", "confidence", "langs", "segments"]).astype({"_id": b["_id"].dtype})

    done = rows.mapInPandas(run, f"_id {id_type}, label string, label_lang string, lang string, confidence double, langs array<string>, segments {SEGMENTS}")
    return done.withColumnRenamed("_id", id_col)


def issues(detected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, issue, lang)``: labels that are missing or wrong, and each language of a mixed document."""
    found = detected.where(F.col("lang").isNotNull())
    kinds = F.array(
        F.when(F.col("label_lang").isNull(), F.struct(F.lit("missing").alias("issue"), F.col("lang").alias("lang"))),
        F.when(F.col("label_lang") != F.col("lang"), F.struct(F.lit("wrong").alias("issue"), F.col("lang").alias("lang"))),
    )
    mixed = F.when(F.size("langs") > 1, F.transform("langs", lambda x: F.struct(F.lit("mixed").alias("issue"), x.alias("lang"))))
    every = F.explode(F.concat(F.array_compact(kinds), F.coalesce(mixed, F.array().cast("array<struct<issue:string,lang:string>>"))))
    return found.select(id_col, every.alias("x")).select(id_col, "x.issue", "x.lang").distinct()
