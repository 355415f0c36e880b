"""Languages of texts: segmentation, n-gram models trained by expectation-maximisation, mixtures per document.

``train`` fits one model a language on the sentences of all rows: function words give the first labels (labels of
the rows are too often wrong to be trusted), a naive Bayes model over character n-grams and words is fitted on them,
relabels all sentences, and is fitted again.  Texts are split into sentences once, in a written table that the rounds of the
fit and the detection read.  ``Mixture`` then estimates a document's language
proportions by expectation-maximisation over its sentences, and selects the set of languages by penalised likelihood.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.plans.workspace import Workspace

LANGS = ("en", "de", "fr", "es", "pt", "it", "ru")

# Frequent function words, without accents and case.
FUNCTION_WORDS = {
    "en": "the and that with which this from have has is are was were for not when because of to it you only still before been its can my would should there",
    "de": "der die das und ist nicht ein eine einen mit auf fur den dem wenn noch sich weil ich wir nach soll wird dass bitte zu im von bei oder als aus kann wie",
    "fr": "le les des est une dans pour qui que pas nous vous avec sur du et quand ce plus encore parce au aux ne se mais ou par cette sont",
    "es": "el los las una que del con para por cuando hasta desde y es en se cada esta pero ya hemos despues porque lo mas sin sobre como",
    "pt": "o os uma que nao com para do da em quando se ainda foi mais porque ja cada no na ate depois pelo num ao dos das isso um",
    "it": "il gli che non della con per una di sono quando ancora nel alla questo perche piu dopo del ogni anche si lo ha prima delle un",
    "ru": "и в не на что с по как это для из если чтобы когда еще после уже был но к до только все за от так почему мы нужно",
}
# Codes and names under which the languages appear as labels.
LABELS = {
    "en": "en eng english anglais englisch ingles inglese английский",
    "de": "de deu ger german deutsch allemand aleman alemao tedesco немецкий",
    "fr": "fr fra fre french francais franzosisch frances francese французский",
    "es": "es spa spanish espanol castellano espagnol spanisch espanhol spagnolo испанский",
    "pt": "pt por portuguese portugues portugais portugiesisch portoghese португальский",
    "it": "it ita italian italiano italien italienisch итальянский",
    "ru": "ru rus russian russe russisch ruso russo русский",
}
_BY_LABEL = {name: lang for lang, names in LABELS.items() for name in names.split()}

MIN_COUNT = 2
MAX_GRAMS = 60_000  # per language, so the model has a fixed size
MIN_WORDS = 6
SEED_WEIGHT = 2.0
BACKGROUND = 0.02
PENALTY = 6.0  # nats that a further language must gain, besides those of the information criterion

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_SPEAKER = re.compile(r"^\s*(?:[>*#\-•|\s]|\d+[.)]\s)*(?:(?:user|human|subagent|agent|assistant|ai|tool|system)\s*:)?\s*", re.I)
_STOP = re.compile(r"(?<=[.!?…])[\"'”’»)\]*_`]*\s+|\s*[\r\n\u2028\u2029]+\s*")
_CODE_MARK = re.compile(r"[/\\_=<>{}\[\]$@#|`\d]|\w\.\w|\w\(|[a-zß-ÿ][A-Z]")
_EDGES = "*_.,;:!?\"'()[]«»“”‘’…¿¡–—"
_LOG_LINE = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d[T ]|\$ |[{\[]|at \S+\(|File \"|[A-Z]+ \S+ rc=|(?:\s{4}|\t)\S+\()")
_QUOTED_CODE = re.compile(r"`[^`]*`")
_LINE = re.compile(r"[^\r\n\u2028\u2029]+")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def fold(text: str) -> str:
    """Lower case without accents: texts that lost theirs look like those that didn't."""
    if text.isascii():
        return text.lower()
    plain = "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))
    return plain.replace("’", "'")


def label_of(label: str | None) -> str | None:
    """The language a label names: None if it is missing, says unknown or names none that is known."""
    if not label:
        return None
    parts = _LETTERS.findall(fold(label))
    return next((_BY_LABEL[p] for p in parts[:1] if p in _BY_LABEL), None)


def _blank(match: re.Match) -> str:
    """Spaces of a match's length and a line's end, so that places in the text stay."""
    return " " * (len(match[0]) - 1) + "\n"


_tokens: dict[str, tuple[str, ...]] = {}
_KNOWN = 200_000  # tokens remembered by a process


def _words_of(token: str) -> tuple[str, ...]:
    """The folded words of a token between spaces: without emphasis and punctuation around it; one with marks of code inside is a name."""
    found = _tokens.get(token)
    if found is None:
        bare = token.strip(_EDGES)
        found = () if not bare or _CODE_MARK.search(bare) else tuple(_LETTERS.findall(fold(bare)))
        if len(_tokens) >= _KNOWN:
            _tokens.clear()
        _tokens[token] = found
    return found


def placed_sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, folded words) of the natural-language sentences; places are code points of the text as it is."""
    if not text:
        return []
    kept = None
    if _INVISIBLE.search(text):
        kept = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
        text = "".join(text[i] for i in kept)
    text = _FENCE.sub(_blank, text.replace("\xa0", " "))
    out = []
    for whole in _LINE.finditer(text):
        line = whole[0]
        if _LOG_LINE.match(line):
            continue
        at = _SPEAKER.match(line).end()
        rest, base = line[at:], whole.start() + at
        ends = [m.span() for m in _STOP.finditer(rest)]
        for i, j in zip([0, *(e for _, e in ends)], [*(b for b, _ in ends), len(rest)]):
            part = rest[i:j]
            if not part:
                continue
            if "`" in part:
                part = _QUOTED_CODE.sub(" ", part)
            w = [x for t in part.split() for x in _words_of(t)]
            if w:
                start, end = base + i, base + j
                out.append((kept[start], kept[end - 1] + 1, w) if kept else (start, end, w))
    return out


def sentences(text: str | None) -> list[list[str]]:
    """The natural-language sentences of a text as lists of folded words; code, logs, paths and speakers left out."""
    return [w for _, _, w in placed_sentences(text)]


def by_function_words(words: list[str], margin: float = 1.0) -> int | None:
    """The language whose function words lead by ``margin``; a word of several languages counts in parts."""
    score = np.zeros(len(LANGS))
    for w in words:
        v = _SEED.get(w)
        if v is not None:
            score += v
    order = np.argsort(score)
    return int(order[-1]) if score[order[-1]] - score[order[-2]] >= margin else None


def _seed_table() -> dict[str, np.ndarray]:
    table: dict[str, np.ndarray] = {}
    for k, lang in enumerate(LANGS):
        for w in FUNCTION_WORDS[lang].split():
            table.setdefault(w, np.zeros(len(LANGS)))[k] = 1.0
    return {w: v / v.sum() for w, v in table.items()}


_SEED = _seed_table()


def grams(word: str) -> list[str]:
    """A word's features: itself and its character runs of two to four with the borders."""
    b = f"^{word}$"
    return [b, *(b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1) if n < len(b))]


class Model:
    """Log-likelihoods of words in each language: one matrix over the n-grams, and one over the words met so far."""

    def __init__(self, grams_at: dict[str, int], logs: np.ndarray):
        self.at, self.logs = grams_at, logs.astype(np.float32)
        self._forget()

    def __getstate__(self):
        return {"at": self.at, "logs": self.logs}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self):
        self._words: dict[str, int] = {}
        self._rows = np.zeros((1024, len(LANGS)), np.float32)

    @classmethod
    def fit(cls, counts: dict[str, list[int]]) -> Model:
        c = np.asarray(list(counts.values()), dtype=np.float64).reshape(-1, len(LANGS))
        total, overall = np.maximum(c.sum(0), 1), c.sum(1, keepdims=True) / max(c.sum(), 1)
        # mixed with the overall share, so that what a language lacks says the same whether much or little of it was seen
        logs = np.log((1 - BACKGROUND) * c / total + BACKGROUND * overall) if len(c) else c
        return cls({g: i for i, g in enumerate(counts)}, logs)

    def _word(self, w: str) -> np.ndarray:
        g = [i for x in grams(w) if (i := self.at.get(x)) is not None]
        # n-grams of a word overlap: their mean, scaled to the word's length, keeps the evidence honest
        v = self.logs[g].mean(0) * min(len(w), 8) if g else np.zeros(len(LANGS), np.float32)
        if w in _SEED:  # a prior that also serves where there is little to train on
            v = v + SEED_WEIGHT * _SEED[w]
        return v - v.max()

    def _row(self, w: str) -> int:
        n = len(self._words)
        if n == len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        self._rows[n] = self._word(w)
        self._words[w] = n
        return n

    def scores(self, parts: list[list[str]]) -> np.ndarray:
        """One row a part (a list of words, none empty), the sum of its words' log-likelihoods."""
        if not parts:
            return np.zeros((0, len(LANGS)))
        if len(self._words) > _KNOWN:
            self._forget()
        known = self._words
        rows = np.fromiter((i if (i := known.get(w)) is not None else self._row(w) for part in parts for w in part), np.int64)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        return np.add.reduceat(self._rows[rows].astype(np.float64), starts)

    def best(self, parts: list[list[str]], margin: float = 2.0) -> list[int | None]:
        """The language of each part that leads by ``margin``."""
        s = self.scores(parts)
        if not len(s):
            return []
        two = np.partition(s, -2, axis=1)[:, -2:]
        return [int(k) if lead >= margin else None for k, lead in zip(s.argmax(1), two[:, 1] - two[:, 0])]


PLACED = "starts array<int>, ends array<int>, said string"


def placed(spark: SparkSession, rows: DataFrame, text_col: str, keep: str = "") -> DataFrame:
    """The rows with a natural-language sentence, written once: the columns ``keep`` (name and type) with ``PLACED`` in the text's place.

    ``said`` has a sentence a line, its folded words apart by spaces; words are letters and apostrophes, so both can be split again.
    """
    names = [c.split()[0] for c in keep.split(",") if c.strip()]

    def split(batches):
        for pdf in batches:
            found = [placed_sentences(t) for t in pdf.pop("text")]
            pdf["starts"], pdf["ends"] = [[x[0] for x in parts] for parts in found], [[x[1] for x in parts] for parts in found]
            pdf["said"] = ["\n".join(" ".join(x[2]) for x in parts) for parts in found]
            yield pdf[pdf["said"] != ""]

    texts = rows.select(*names, F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return Workspace(spark, "sentences").save(texts.mapInPandas(split, f"{keep}, {PLACED}" if keep else PLACED), "placed")


def split_said(said: str) -> list[list[str]]:
    """The sentences' words of a row of ``placed``."""
    return [line.split(" ") for line in said.split("\n")]


def _grams_of(total: list[Counter]):
    """One frame (gram, lang, n) a language from its counts of words."""
    import pandas as pd

    for k, by_word in enumerate(total):
        by_gram: Counter = Counter()
        for w, n in by_word.items():
            for g in grams(w):
                by_gram[g] += n
        yield pd.DataFrame([(g, k, n) for g, n in by_gram.items()], columns=["gram", "lang", "n"])


def _count(batches, label):
    """Frames of n-gram counts by language over all sentences; those of a gram are partial and add up."""
    total = [Counter() for _ in LANGS]
    for pdf in batches:
        met = Counter(line for said in pdf["said"] for line in said.split("\n"))  # a sentence that recurs is labelled once
        parts = [line.split(" ") for line in met]
        for words, n, k in zip(parts, met.values(), label(parts)):
            if k is not None:
                by_word = total[k]
                for w in words:
                    by_word[w] += n
        if sum(map(len, total)) > _KNOWN:  # what a process holds is bounded, what it counts is not
            yield from _grams_of(total)
            total = [Counter() for _ in LANGS]
    yield from _grams_of(total)


def _counts(said: DataFrame, label) -> dict[str, list[int]]:
    """n-gram counts by language over all sentences, labelled by ``label``; the model's size is bounded by MAX_GRAMS a language."""
    counted = said.mapInPandas(lambda batches: _count(batches, label), "gram string, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    wide = counted.groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(LANGS))), F.sum("n").alias("n"))
    top = wide.filter(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "gram").limit(MAX_GRAMS * len(LANGS))
    return {r[0]: list(r[1 : 1 + len(LANGS)]) for r in top.collect()}


def fit(spark: SparkSession, sentences_: DataFrame, *, rounds: int = 2) -> Model:
    """A model from all sentences of ``placed``."""
    said = sentences_.select("said")
    model = Model.fit(_counts(said, lambda parts: [by_function_words(words) for words in parts]))
    for _ in range(rounds - 1):
        sent = spark.sparkContext.broadcast(model)  # of fixed size
        model = Model.fit(_counts(said, lambda parts, sent=sent: sent.value.best(parts)))
    return model


def train(spark: SparkSession, texts: DataFrame, text_col: str, id_col: str | None = None, *, rounds: int = 2) -> Model:
    """A model from all ``texts``, the same at every run; ``id_col`` decides nothing, as every row counts."""
    return fit(spark, placed(spark, texts, text_col), rounds=rounds)


def price(sentences_: int, penalty: float = PENALTY) -> float:
    """What a further language must gain in a document of so many sentences."""
    return penalty + 0.5 * math.log(max(sentences_, 2))


class Mixture:
    """A document's languages from its sentences' likelihoods."""

    def __init__(self, scores: np.ndarray, penalty: float = PENALTY, rounds: int = 20):
        self.scores = scores.astype(np.float64)
        n = len(scores)
        # forward selection: start with the best single language, add the one that gains most while it pays
        totals = self.scores.sum(0)
        chosen = [int(np.argmax(totals))]
        best, self.share = self._fit(chosen, rounds)
        cost = price(n, penalty)
        while len(chosen) < len(LANGS):
            cap = np.maximum(self.scores, self.scores[:, chosen].max(1, keepdims=True)).sum(0)
            more = int(np.argmax(np.where(np.isin(np.arange(len(LANGS)), chosen), -np.inf, cap)))
            value, share = self._fit([*chosen, more], rounds)
            if value - best < cost:
                break
            chosen, best, self.share = [*chosen, more], value, share
        self.langs = chosen

    def _fit(self, chosen: list[int], rounds: int = 20) -> tuple[float, np.ndarray]:
        s = self.scores[:, chosen]
        top = s.max(1, keepdims=True)
        e = np.exp(s - top)
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(rounds if len(chosen) > 1 else 0):
            p = e * share
            new = (p / p.sum(1, keepdims=True)).mean(0)
            if np.abs(new - share).max() < 1e-4:
                share = new
                break
            share = new
        return float((np.log(np.maximum((e * share).sum(1), 1e-300)) + top[:, 0]).sum()), share

    def assign(self) -> list[tuple[int, float]]:
        """(language, confidence) of each sentence, its posterior under the mixture."""
        s = self.scores[:, self.langs] + np.log(np.maximum(self.share, 1e-12))
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        k = p.argmax(1)
        # a confidence against all languages, not only the selected ones
        q = np.exp(self.scores - self.scores.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        return [(self.langs[j], float(min(p[i, j], q[i, self.langs[j]]))) for i, j in enumerate(k)]


def _assigned(model: Model, docs: list[list[list[str]]]) -> list[list[tuple[int, float]]]:
    """(language, confidence) of each sentence of each document (none empty).

    All sentences are scored at once.  A document in which no second language can gain its price, even if every sentence took
    the better of both, needs no mixture; that is what forward selection would find out first.
    """
    if not docs:
        return []
    s = model.scores([words for doc in docs for words in doc])
    sizes = np.array([len(doc) for doc in docs])
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    main = np.add.reduceat(s, starts).argmax(1)
    own = s[np.arange(len(s)), np.repeat(main, sizes)]
    gain = np.add.reduceat(np.maximum(s - own[:, None], 0), starts).max(1)
    e = np.exp(s - s.max(1, keepdims=True))
    sure = np.exp(own - s.max(1)) / e.sum(1)
    out = []
    for d, (at, n) in enumerate(zip(starts, sizes)):
        if gain[d] < price(int(n)):
            out.append([(int(main[d]), float(c)) for c in sure[at : at + n]])
        else:
            out.append(Mixture(s[at : at + n]).assign())
    return out


def segments_of(model: Model, texts: list[str | None], *, min_words: int = MIN_WORDS, confidence: float = 0.9) -> list[list[tuple[str, int, int, float, int, float, int]]]:
    """For each text (lang, start, end, confidence, words, best, sure) of each run of consecutive sentences of one language.

    Every sentence belongs to a run, also short and doubtful ones.  ``confidence`` is the mean of the sentences' by words;
    ``best`` is the highest of a sentence of ``min_words`` or more that reaches the demanded confidence, and ``sure`` such
    sentences' number of words, both 0 without one.  Sentences under three words follow the run before them, or the first.
    """
    return segments_of_sentences(model, [placed_sentences(t) for t in texts], min_words=min_words, confidence=confidence)


def segments_of_sentences(model: Model, docs: list[list[tuple[int, int, list[str]]]], *, min_words: int = MIN_WORDS, confidence: float = 0.9) -> list[list[tuple[str, int, int, float, int, float, int]]]:
    """``segments_of`` texts given as their ``placed_sentences``."""
    long = [[w for _, _, w in parts if len(w) >= 3] for parts in docs]
    scored = iter(_assigned(model, [doc for doc in long if doc]))
    return [_runs(parts, next(scored), min_words, confidence) if doc else [] for parts, doc in zip(docs, long)]


def _runs(parts: list[tuple[int, int, list[str]]], assigned: list[tuple[int, float]], min_words: int, confidence: float) -> list[tuple[str, int, int, float, int, float, int]]:
    runs: list[list] = []
    waiting, at = None, iter(assigned)
    for start, end, w in parts:
        if len(w) < 3:
            if runs:
                runs[-1][2] = end
            else:
                waiting = start if waiting is None else waiting
            continue
        k, c = next(at)
        if not runs or runs[-1][0] != k:
            runs.append([k, start if waiting is None else waiting, end, 0.0, 0, 0.0, 0])
            waiting = None
        run = runs[-1]
        run[2], run[3], run[4] = end, run[3] + c * len(w), run[4] + len(w)
        if len(w) >= min_words and c >= confidence:
            run[5], run[6] = max(run[5], c), run[6] + len(w)
    return [(LANGS[k], start, end, c / n, n, best, sure) for k, start, end, c, n, best, sure in runs]


def segments(model: Model, text: str | None, **how) -> list[tuple[str, int, int, float, int, float, int]]:
    """``segments_of`` one text."""
    return segments_of(model, [text], **how)[0]


def languages(model: Model, text: str | None, *, min_words: int = MIN_WORDS, confidence: float = 0.9) -> list[tuple[str, float, int]]:
    """(language, confidence, words) for each language in which a sentence of ``min_words`` or more is written."""
    found: dict[str, tuple[float, int]] = {}
    for lang, _, _, _, _, best, sure in segments(model, text, min_words=min_words, confidence=confidence):
        if sure:
            c, n = found.get(lang, (0.0, 0))
            found[lang] = (max(c, best), n + sure)
    return sorted(((lang, c, n) for lang, (c, n) in found.items()), key=lambda x: -x[2])


SEGMENTS = "doc_id bigint, label string, seg int, lang string, start int, end int, confidence double, words int, best double, sure int"


def document_segments(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The ``segments`` of every document, numbered by ``seg`` from 0; ``label`` is the document's normal label.

    Defined results: null and empty texts, and texts without a sentence of three words, have no row; a null, empty or
    unknown label gives a null ``label``; repeated documents give repeated rows; extra columns are ignored.
    """
    parts = placed(spark, docs, "text", "doc_id bigint, lang string")
    sent = spark.sparkContext.broadcast(fit(spark, parts))

    def detect(batches):
        import pandas as pd

        model = sent.value
        for pdf in batches:
            found = segments_of_sentences(model, [list(zip(*row)) for row in zip(pdf["starts"], pdf["ends"], map(split_said, pdf["said"]))])
            rows = [(i, label_of(lab), k, lang, start, end, round(c, 6), n, round(best, 6), sure) for i, lab, runs in zip(pdf["doc_id"], pdf["lang"], found)
                    for k, (lang, start, end, c, n, best, sure) in enumerate(runs)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "seg", "lang", "start", "end", "confidence", "words", "best", "sure"])

    return parts.mapInPandas(detect, SEGMENTS)


def document_languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The segments that hold a sure sentence of six words or more: what ``mislabelled`` judges documents by."""
    return document_segments(spark, docs).filter("sure > 0").select("doc_id", "label", "lang", "confidence", "words")


def mislabelled(found: DataFrame) -> DataFrame:
    """(doc_id, lang) of the documents without a label, with a wrong one, or in several languages."""
    by_doc = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.collect_set("lang").alias("langs"))  # at most seven a document
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return by_doc.filter(F.coalesce(wrong, F.lit(True))).select("doc_id", F.explode("langs").alias("lang"))
