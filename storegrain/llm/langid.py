"""Language identification: script ranges, word scores and a Viterbi path over the words of a text.

The script of a word leaves the languages that were seen in that script. Each word then has a log-likelihood
in each of them from hashed character n-grams. A Viterbi path over the words, with a penalty for each change
of language, labels spans, so that a text in several languages gets several.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import bounded_share, free_name, held_out, slices

#: First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
NAMES = [*SCRIPTS, "other"]
WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
#: Distinct words that a task remembers.
REMEMBERED = 100_000
#: Words that go through the Viterbi recursion in one step-wise pass; longer texts are chained exactly.
CHUNK = 256
#: Languages that are learned at most; half a megabyte of the model each.
MOST_LANGS = 300
#: States up to which chunks of a sequence run side by side from every start state; back-pointers that are in memory at once beyond.
FEW_STATES, CELLS = 16, 20_000_000


@lru_cache(maxsize=100_000)
def script_of(letter: str) -> int:
    """Index in NAMES of a letter's script."""
    return next((k for k, ranges in enumerate(SCRIPTS.values()) if any(a <= ord(letter) <= b for a, b in ranges)), len(SCRIPTS))


def first_letter(word: str) -> str:
    """Empty if the word has no letter, as of superscript digits only."""
    return word[0] if word.isalpha() else next((x for x in word if x.isalpha()), "")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of the hashed character 2- to 4-grams of all lower-cased words with their borders."""
    c = np.frombuffer("".join([f"<{w.lower()}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(c == ord("<")) - 1
    h, cells, at = c, [], []
    for n in (2, 3, 4):
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        inside = word[: len(c) - n + 1] == word[n - 1 :]
        x = h[inside]
        cells.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        at.append(word[: len(c) - n + 1][inside])
    return np.concatenate(cells), np.concatenate(at)


def train(docs: DataFrame, *, bound: int = 4_000) -> dict:
    """Model from docs (doc_id, text, lang): about `bound` documents of those with text and lang, chosen by a hash of doc_id
    and text; equal rows count once.

    Its size depends on the number of languages only: log-probabilities of BUCKETS hashed n-grams and the
    scripts seen, both by language. The MOST_LANGS languages of most rows are learned, of equally many the first by name.
    Without labelled documents the model knows no language.
    """
    labelled = docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    # a row a language, also of a column of free text: only the first of them come to the driver
    counted = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    total = sum(r["count"] for r in counted)
    learned = docs.sparkSession.createDataFrame([(r["lang"],) for r in counted], "lang string")
    labelled = labelled.join(F.broadcast(learned), "lang", "left_semi")
    labelled = labelled.filter(F.xxhash64("doc_id", "text") <= bounded_share(bound, total)).dropDuplicates(["doc_id", "text", "lang"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        words: dict[tuple[str, str], int] = {}

        def add() -> None:
            for lang in {x for x, _ in words}:
                s = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
                own = {w: n for (x, w), n in words.items() if x == lang and first_letter(w)}
                if own:
                    n = np.array([*own.values()], dtype=float)
                    cells, at = grams([*own])
                    s[:BUCKETS] += np.bincount(cells, n[at], BUCKETS)
                    s[BUCKETS:] += np.bincount([script_of(first_letter(w)) for w in own], n, len(NAMES))
            words.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                for w, n in Counter(WORD.findall(text)).items():
                    words[lang, w] = words.get((lang, w), 0) + n
                if len(words) > REMEMBERED:
                    add()
        add()
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"lang": lang, "cell": at, "n": s[at]})

    rows = labelled.select("lang", "text").mapInPandas(count, "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    n = np.zeros((BUCKETS + len(NAMES), len(langs)))
    n[rows["cell"].to_numpy(int), rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int)] = rows["n"]
    g, scripts = n[:BUCKETS] + 0.1, n[BUCKETS:]
    seen = scripts > 0.001 * np.maximum(scripts.sum(0), 1)
    return {"langs": langs, "logp": np.log(g / g.sum(0)).T.copy(), "seen": seen}


class Scorer:
    """Scores, paths and labels of texts under a model."""

    def __init__(self, model: dict, penalty: float):
        self.langs, self.logp, self.seen, self.penalty = model["langs"], model["logp"], model["seen"], penalty
        self.ids: dict[str, int] = {}
        self.known, self.scores = 0, np.zeros((0, len(self.langs)))

    def learn(self, new: list[str]) -> None:
        """Scores of words not seen before, to `scores`; words without a letter get -1."""
        self.ids |= dict.fromkeys(new, -1)
        new = [w for w in new if first_letter(w)]
        if not new or not self.langs:
            return
        cells, at = grams(new)
        n = np.bincount(at, minlength=len(new))
        s = np.stack([np.bincount(at, x[cells], len(new)) for x in self.logp], 1)
        s *= (np.minimum(n, 8) / n)[:, None]
        allowed = self.seen[[script_of(first_letter(w)) for w in new]]
        allowed |= ~allowed.any(1, keepdims=True)  # a script never seen leaves all
        s = np.where(allowed, s, s.min(1, keepdims=True) - 20)
        self.ids |= zip(new, range(self.known, self.known + len(new)))
        self.scores = np.concatenate([self.scores[: self.known], s - s.max(1, keepdims=True)])
        self.known += len(new)

    def paths(self, texts: list[str]) -> list[np.ndarray]:
        """Language index of every word with a letter, text by text."""
        if len(self.ids) > REMEMBERED:
            self.ids, self.known = {}, 0
        found = [WORD.findall(t) for t in texts]
        self.learn([w for w in dict.fromkeys(chain.from_iterable(found)) if w not in self.ids])
        words = [np.fromiter(map(self.ids.__getitem__, f), np.int64, len(f)) for f in found]
        words = [w[w >= 0] for w in words]
        if not self.langs:
            return [np.zeros(0, int)] * len(texts)
        return viterbi([self.scores[w] for w in words], self.penalty)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best path of each sequence of score rows, each change of state costing penalty.

    All sequences are cut into chunks that run side by side from every start state; the chunks of one
    sequence are then chained, so the result is that of one pass over it whatever its length.
    """
    n_states = max((s.shape[1] for s in scores), default=0)
    if n_states > FEW_STATES:
        return _side_by_side(scores, penalty, n_states)
    sizes = [len(s) for s in scores]
    n_chunks = [-(-n // CHUNK) for n in sizes]
    total = sum(n_chunks)
    if not total:
        return [np.zeros(0, int) for _ in scores]
    steps = min(CHUNK, max(sizes))
    e = np.zeros((steps, total, n_states))
    length = np.zeros(total, int)
    k = 0
    for s in scores:
        for i in range(0, len(s), CHUNK):
            part = s[i : i + CHUNK]
            e[: len(part), k] = part
            length[k] = len(part)
            k += 1
    # best[c, a, b]: best score of chunk c that ends in b, when the word before it is in a
    best = np.where(np.eye(n_states, dtype=bool), 0.0, -np.inf)[None].repeat(total, 0)
    back = np.zeros((steps, total, n_states, n_states), np.int8)
    for t in range(steps):
        live = t < length
        top = best.argmax(2)
        jump = np.take_along_axis(best, top[..., None], 2) - penalty
        stay = best >= jump
        back[t] = np.where(stay, np.arange(n_states)[None, None], top[..., None])
        new = np.where(stay, best, jump) + e[t][:, None, :]
        best = np.where(live[:, None, None], new, best)
    # chain the chunks of each sequence: where each of them is entered from, and where it ends
    enter, leave = np.zeros(total, int), np.zeros(total, int)
    k = 0
    for chunks in n_chunks:
        v, came = np.zeros(n_states), []
        for c in range(k, k + chunks):
            m = v[:, None] + best[c]
            came.append(m.argmax(0))
            v = m.max(0)
        b = int(v.argmax())
        for c in range(k + chunks - 1, k - 1, -1):
            leave[c], enter[c] = b, came[c - k][b]
            b = enter[c]
        k += chunks
    paths, each, b = np.zeros((total, steps), np.int64), np.arange(total), leave
    for t in range(steps - 1, -1, -1):
        live = t < length
        paths[:, t] = b
        b = np.where(live, back[t, each, enter, b], b)
    out, k = [], 0
    for n, chunks in zip(sizes, n_chunks, strict=True):
        out.append(paths[k : k + chunks].reshape(-1)[:n])
        k += chunks
    return out


def _side_by_side(scores: list[np.ndarray], penalty: float, n_states: int) -> list[np.ndarray]:
    """The same for many states: whole sequences of like length side by side, as many as CELLS back-pointers allow, so the work grows with states and not with their square."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
    order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: len(scores[k]))
    while order:
        steps = len(scores[order[-1]])
        group, order = order[-max(1, CELLS // (steps * n_states)) :], order[: -max(1, CELLS // (steps * n_states))]
        length = np.array([len(scores[k]) for k in group])
        back = np.zeros((steps, len(group), n_states), np.min_scalar_type(n_states))
        best = np.zeros((len(group), n_states))
        for t in range(steps):
            live = np.flatnonzero(t < length)
            top = best[live].argmax(1)
            jump = np.take_along_axis(best[live], top[:, None], 1) - penalty
            stay = best[live] >= jump
            back[t, live] = np.where(stay, np.arange(n_states)[None], top[:, None])
            best[live] = np.where(stay, best[live], jump) + np.stack([scores[group[k]][t] for k in live])
        at = best.argmax(1)
        for j, k in enumerate(group):
            path, b = np.empty(length[j], np.int64), int(at[j])
            for t in range(length[j] - 1, -1, -1):
                path[t] = b
                b = int(back[t, j, b])
            out[k] = path
    return out


def spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, end word, language index) of each run of one language."""
    if not len(path):
        return []
    cuts = np.flatnonzero(np.diff(path)) + 1
    starts = [0, *cuts.tolist()]
    return [(a, b, int(path[a])) for a, b in zip(starts, [*starts[1:], len(path)], strict=True)]


def with_language(docs: DataFrame, model: dict, *, penalty: float = 6.0) -> DataFrame:
    """docs with lang_pred, score, and spans (start word, end word, lang).

    lang_pred is the language of most words, of equal ones the first by name; score is its share of them.
    Null texts, texts without a letter and all texts under a model without languages are `und` with score 0.
    Rows are judged one by one: repeated rows have equal results and an empty table gives none. All columns of docs
    stay; where it has one of the three names, the new one gets underscores.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * languages numbers
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    names = [free_name(docs.columns, c) for c in ("lang_pred", "score", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(given.value, penalty)
        langs = scorer.langs
        for b in slices(batches, 200):
            rows = []
            for path in scorer.paths([t or "" for t in b.column("text").to_pylist()]):
                if len(path):
                    n = np.bincount(path, minlength=len(langs))
                    rows.append((langs[int(n.argmax())], float(n.max() / n.sum()), [{"start": x, "end": y, "lang": langs[z]} for x, y, z in spans(path)]))
                else:
                    rows.append(("und", 0.0, []))
            pred, score, found = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(span))], [*b.schema.names, *names])

    new = docs.withColumns({n: F.lit(None).cast(k) for n, k in zip(names, ("string", "double", "array<struct<start:int,end:int,lang:string>>"), strict=True)})
    return docs.mapInArrow(run, new.schema)


def identify(docs: DataFrame, model: dict, *, penalty: float = 6.0) -> DataFrame:
    """The same without docs' other columns: doc_id, lang_pred, score, spans."""
    return with_language(docs.select("doc_id", "text"), model, penalty=penalty).select("doc_id", "lang_pred", "score", "spans")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
