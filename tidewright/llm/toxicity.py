"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes disguises: case, accents, homoglyphs of other alphabets and digits or signs for letters
inside words. The lexicon has words and word beginnings (stems, for languages that inflect); weights come
from labelled rows over a small prior. A match inside an exception phrase doesn't count. Hits are
normalised by length, and a logistic curve fitted on the same rows turns them into a score.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import held_out, map_slices, materialise, table

#: Prior lexicon: insults and their weights before any label is seen.
PRIOR = {
    "idiot": 3.0, "moron": 3.0, "stupid": 2.5, "scum": 3.0, "loser": 2.5, "pathetic": 2.0, "worthless": 2.0, "disgusting": 2.0, "trash": 1.5, "clown": 1.5,
    "imbecile": 3.0, "dumbass": 3.0, "bastard": 3.0, "asshole": 3.5, "bitch": 3.5, "dickhead": 3.5, "retard": 3.5,
}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "pond scum", "sore loser rule")
#: Letters that look alike, and digits and signs that stand for letters inside words.
HOMOGLYPHS = dict(zip("аеорсухіјѕѵԁһӏкмтвнαονρτικυ", "aeopcyxijsvdhlkmtbhaovptiku", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Labelled rows to learn from, at most, of either class.
TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
#: Log likelihood ratio that an entry needs: of a million terms that mean nothing, about six reach it.
EVIDENCE = 12.0
STEMS = (4, 5, 6)
_LEET = re.compile(r"(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])|(?<![\w@$!|])[0134578@$|]+(?=[^\W\d_])")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


class Folder:
    """text -> lower-case words of letters, parted and surrounded by single spaces."""

    def __init__(self):
        self.table: dict[int, str] = {}

    def _fold(self, c: str) -> str:
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        return "".join(HOMOGLYPHS.get(x, x) for x in base)

    def __call__(self, text: str) -> str:
        text = text.lower()
        for c in set(text) if not text.isascii() else ():
            if ord(c) not in self.table:
                self.table[ord(c)] = self._fold(c)
        if not text.isascii():
            text = text.translate(self.table)
        if any(d in text for d in DIGITS):
            text = _LEET.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
        return f" {_NOT_LETTERS.sub(' ', text).strip()} "


class Lexicon:
    """entries: folded word or stem -> weight; a whole word ends with a space, a stem doesn't."""

    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for e, w in entries.items():
            self.machine.add_word(f" {e}", (w, len(e) + 1))
        for e in exceptions:
            self.machine.add_word(f" {e} ", (None, len(e) + 2))
        self.machine.make_automaton()

    def features(self, folded: str) -> tuple[float, float, float]:
        """(log of the weight matched, log of that weight per 100 words, largest weight).

        Of matches that start at one word only the heaviest counts.
        """
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (weight, size) in self.machine.iter(folded):
            at = end - size + 1
            if weight is None:
                excused.append((at, end))
            else:
                found[at] = max(weight, found.get(at, 0.0))
        if excused:
            excused.sort()
            starts = [a for a, _ in excused]
            reach = list(accumulate((b for _, b in excused), max))
            found = {at: w for at, w in found.items() if (k := bisect_right(starts, at)) == 0 or reach[k - 1] <= at}
        total = sum(found.values())
        words = folded.count(" ") - 1
        return float(np.log1p(total)), float(np.log1p(100 * total / max(words, 1))), max(found.values(), default=0.0)


class Model:
    def __init__(self, entries: dict[str, float], curve: np.ndarray):
        self.entries, self.curve = entries, curve

    def start(self):
        folder, lexicon = Folder(), Lexicon(self.entries)

        def score(texts: list[str | None]) -> list[float]:
            x = np.array([lexicon.features(folder(t or "")) for t in texts]).reshape(-1, 3)
            return (1 / (1 + np.exp(-np.clip(x @ self.curve[1:] + self.curve[0], -40, 40)))).tolist()

        return score


def terms(folded: str) -> set[str]:
    """Whole words (with a trailing space) and stems of a folded text."""
    words = set(folded.split())
    out = {f"{w} " for w in words}
    for n in STEMS:
        out.update(w[:n] for w in words if len(w) >= n)
    return out


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights by smoothed log odds of document frequencies in sample(text, toxic): every term with the evidence is an entry.

    Of rows with the same sketch (the least hash of their word pairs) one counts, or copies of a document
    would make evidence of its chance words; the one with the least hash, so that the entries don't depend on how
    the rows are parted. Empty without rows of either class.
    """

    def sketch():
        folder = Folder()

        def f(rows: dict) -> dict:
            texts = [folder(t) for t in rows["text"]]
            words = [t.split() for t in texts]
            return {"text": texts, "toxic": rows["toxic"], "sketch": [min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(w, w[1:], strict=False)), default=-1) for w in words]}

        return f

    folded = map_slices(sample, sketch, "text string, toxic int, sketch bigint")
    sample = materialise(folded.groupBy("sketch", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic"), "unlike")
    found = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = found.get(1, 0), found.get(0, 0)
    if not n_toxic or not n_clean:
        return {}

    def start():
        def f(rows: dict) -> dict:
            seen = {0: Counter(), 1: Counter()}
            for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
                seen[toxic].update(terms(text))
            keys = list(seen[0].keys() | seen[1].keys())
            return {"term": keys, "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys]}

        return f

    counted = map_slices(sample, start, "term string, toxic bigint, clean bigint", rows=1024).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = F.col("toxic") + F.col("clean")
    share, base = F.col("toxic") / n, n_toxic / (n_toxic + n_clean)
    evidence = F.col("toxic") * F.log(share / base) + F.col("clean") * F.log(F.greatest(1 - share, F.lit(1e-9)) / (1 - base))
    odds = F.log((F.col("toxic") + 0.05) / (n_toxic + 1) / ((F.col("clean") + 0.05) / (n_clean + 1)))
    best = counted.where("toxic > 0").withColumn("odds", odds).where((F.col("odds") > 2.5) & (evidence > EVIDENCE))
    weights = {r["term"]: float(r["odds"]) for r in sorted(best.select("term", "odds").collect())}  # of the bounded rows' terms
    # a longer entry that is matched wherever its stem is adds nothing
    return {t: w for t, w in weights.items() if not any(t[:n] != t and weights.get(t[:n], 0) >= w - 0.7 for n in STEMS)}


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression by damped Newton steps; classes weigh alike."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    ridge = np.diag([1e-6, 1e-4, 1e-4, 1e-4])
    w = np.zeros(4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + ridge
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge @ w)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from docs(doc_id, text) and labels(doc_id, toxic).

    At most TOXIC_ROWS and CLEAN_ROWS labelled rows, by the order of a hash of doc_id. Rows whose toxic
    isn't 0 or 1 or whose doc_id is null teach nothing; of documents that share a doc_id the one whose text has the least
    hash does, with the smaller of its labels. With either class missing among the documents the prior alone is
    used. The model doesn't depend on how the tables are parted.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    picked = None
    for toxic, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        some = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.unionByName(some)
    ids = [(r["doc_id"], r["toxic"]) for r in picked.collect()]  # TOXIC_ROWS + CLEAN_ROWS at most
    spark = docs.sparkSession
    prior = {f"{k} ": v for k, v in PRIOR.items()}
    alone = Model(prior, np.array([-1.5, 0.0, 1.2, 0.6]))
    if len({t for _, t in ids}) < 2:
        return alone
    chosen = spark.createDataFrame(ids, T.StructType([known.schema["doc_id"], T.StructField("toxic", T.IntegerType())]))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    sample = sample.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), "text", "toxic")).alias("row")).select("row.*")
    sample = materialise(sample, "labelled")  # read three times, and as bounded as the labels picked
    found = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return alone
    entries = prior | {k: max(v, prior.get(k, 0.0)) for k, v in learn_lexicon(sample).items()}

    def start():
        folder, lexicon = Folder(), Lexicon(entries)

        def f(rows: dict) -> dict:
            got = [lexicon.features(folder(t)) for t in rows["text"]]
            return {"a": [g[0] for g in got], "b": [g[1] for g in got], "c": [g[2] for g in got], "y": rows["toxic"]}

        return f

    got = map_slices(sample, start, "a double, b double, c double, y int").collect()
    got.sort()
    x = np.array([[r["a"], r["b"], r["c"]] for r in got])
    return Model(entries, fit_curve(x, np.array([r["y"] for r in got], dtype=float)))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns `carry` of docs and score double (0 to 1, higher: more likely toxic), a row for every row.

    Null and empty texts are scored as texts without a match. `name` is that of the column that is added;
    ValueError if a carried one has it.
    """
    if name in carry:
        raise ValueError(f"a carried column must not be named {name!r}")
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField(name, T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # entries learned from the bounded labelled rows, and the prior

    def start():
        own = shipped.value.start()

        def f(rows: dict) -> dict:
            return {c: rows[c] for c in carry} | {name: own(rows["text"])}

        return f

    return map_slices(docs.select(*[c for c in carry if c != "text"], "text"), start, schema)


def op7_lexicon_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = ~held_out(F.col("doc_id"))
    model = fit(docs.where(train), labels.where(train))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
