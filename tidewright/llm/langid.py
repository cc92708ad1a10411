"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, map_slices, table

#: Families of closely related languages, by ISO 639-1 code. A code that no family lists is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "semitic": ("ar", "he", "mt", "am"),
}
#: Hashed character n-grams: 2**BITS features of GRAMS letters each.
BITS, GRAMS = 13, (1, 2, 3, 4)
#: Labelled rows that the classifier is fitted on, about, over all languages.
TRAIN_ROWS = 2000
UNDETERMINED = "und"
#: Characters of a text that are counted at once; what is counted doesn't depend on it.
PART = 500_000
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


class Features:
    """Whole text -> counts of hashed n-grams of letters; other characters part words."""

    def __init__(self, part: int = PART):
        self.part = part
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000)

    def counts(self, text: str) -> np.ndarray:
        """float64 of length 2**BITS; all zero for a text without letters. Long texts go in parts, each with the last
        letters of the one before it, so that the counts are those of the whole text."""
        total, seen = np.zeros(1 << BITS), False
        text = text.lower()
        before = np.zeros(0, dtype=np.uint32)  # what the next part's n-grams may begin with
        for at in range(0, max(1, len(text)), self.part):
            codes = np.frombuffer(text[at : at + self.part].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            is_letter = self.letter[np.minimum(codes, 0xFFFF)]
            high = codes > 0xFFFF
            if high.any():
                is_letter[high] = [chr(c).isalpha() for c in codes[high]]
            seen = seen or bool(is_letter.any())
            first, last = at == 0, at + self.part >= len(text)
            codes = np.concatenate((before, [32] if first else [], np.where(is_letter, codes, 32), [32] if last else [])).astype(np.uint32)
            gap = codes == 32
            keep = np.concatenate(([True], ~(gap[1:] & gap[:-1])))
            keep[: len(before)] = True
            codes, done = codes[keep], len(before)
            h = np.zeros(len(codes), dtype=np.uint32)
            for n in range(1, max(GRAMS) + 1):
                if n > len(codes):
                    break
                h = h[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :] * _MULTIPLIERS[(n - 1) % 4]
                if n in GRAMS:
                    own = h[max(0, done - n + 1) :]  # those that end in this part
                    mixed = (own ^ own >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
                    total += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
            before = codes[-(max(GRAMS) - 1) :]
        return total if seen else np.zeros(1 << BITS)

    def rows(self, texts: list[str]) -> np.ndarray:
        """Unit rows: square roots of the counts' shares."""
        x = np.stack([self.counts(t) for t in texts]) if texts else np.zeros((0, 1 << BITS))
        return np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps; y is +1 or -1, classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    v, c = w, b
    rate = 1.0 / (1.0 / cost + 4.0)
    for k in range(steps):
        margin = np.maximum(0, 1 - y * (x @ v + c))
        g = (-2 * weight * y * margin).astype(np.float32)
        w2, b2 = v - rate * (v / cost + g @ x), c - rate * float(g.sum())
        v, c = w2 + k / (k + 3) * (w2 - w), b2 + k / (k + 3) * (b2 - b)
        w, b = w2, b2
    return w, float(b)


class Model:
    """Per family a one-versus-rest machine, per pair of languages in a family a one-versus-one machine."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        own = np.array(langs, dtype=object)
        fam = np.array([family_of(v) for v in langs], dtype=object)
        self.families = sorted(set(fam))
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.family = [fit_svm(x, np.where(fam == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for members in self.members.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    rows = (own == a) | (own == b)
                    self.pairs[a, b] = fit_svm(x[rows], np.where(own[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores in 0..1: the family's softmax share times the winner's share of pairwise odds."""
        if not len(x):
            return [], np.zeros(0)
        if self.family:
            m = 4 * np.stack([x @ w + b for w, b in self.family], axis=1).astype(float)
            p = np.exp(m - m.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
        else:
            p = np.ones((len(x), 1))
        best = p.argmax(axis=1)
        langs, score = [""] * len(x), np.zeros(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = self.members[f]
            odds = np.zeros((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    w, b = self.pairs[a, members[j]]
                    won = 1 / (1 + np.exp(-np.clip(4 * (x[rows] @ w + b), -40, 40).astype(float)))
                    odds[:, i] += won
                    odds[:, j] += 1 - won
            share = odds / np.maximum(odds.sum(axis=1, keepdims=True), 1e-9) if len(members) > 1 else np.ones((len(rows), 1))
            top = share.argmax(axis=1)
            for r, t in zip(rows, top, strict=True):
                langs[r] = members[t]
            score[rows] = p[rows, k] * share[np.arange(len(rows)), top]
        return langs, np.clip(score, 0, 1)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Fits on about `train_rows` rows of docs(doc_id, text, lang), spread evenly over the languages.

    Rows whose lang is null or whose text has no letter teach nothing. None if no row is left.
    """
    docs = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # languages
    if not counts:
        return None
    share, left = {}, train_rows
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda c: c[1])):
        take = min(n, left // (len(counts) - k))
        share[lang], left = take / n, left - take
    pick = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < F.create_map(*[F.lit(v) for kv in share.items() for v in kv])[F.col("lang")] * (1 << 30)

    def start():
        features = Features()

        def f(rows: dict) -> dict:
            out = {"lang": [], "at": [], "n": []}
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                c = features.counts(text)
                nz = np.flatnonzero(c)
                if len(nz):
                    out["lang"].append(lang)
                    out["at"].append(nz.astype("<u2").tobytes())
                    out["n"].append(c[nz].astype("<f4").tobytes())
            return out

        return f

    sample = map_slices(docs.where(pick).select("lang", "text"), start, "lang string, at binary, n binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))  # the fit must not depend on the order of tasks
    x = np.zeros((len(sample), 1 << BITS), dtype=np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<f4")
    x /= x.sum(axis=1, keepdims=True)
    np.sqrt(x, out=x)
    return Model(x, [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `carry` of docs, lang_pred string and score double (0 to 1), a row for every row.

    A null text, one without a letter, or any text where there is no model gets `und` and score 0. `names` are
    those of the two columns that are added; ValueError if a carried one has such a name. Other columns of docs
    are not read.
    """
    if set(names) & set(carry):
        raise ValueError(f"carried columns must not be named {names}")
    carried = [f for c in carry for f in docs.schema.fields if f.name == c]
    from pyspark.sql import types as T

    schema = T.StructType([*carried, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    rest = [c for c in carry if c != "text"]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed: 2**BITS weights for each family and pair

    def start():
        features, own = Features(), shipped.value

        def f(rows: dict) -> dict:
            texts = rows["text"]
            known = [i for i, t in enumerate(texts) if own is not None and has_letter(t)]
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if known:
                for i, lang, score in zip(known, *own.predict(features.rows([texts[i] for i in known])), strict=True):
                    langs[i], scores[i] = lang, float(score)
            return {c: rows[c] for c in carry} | {names[0]: langs, names[1]: scores}

        return f

    return map_slices(docs.select(*rest, "text"), start, schema, rows=128)


def op8_hierarchical_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
