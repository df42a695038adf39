"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features: densities of a fixed insult lexicon and of a learned one (words and beginnings of words that labelled toxic
rows hold far more often, weighed by their log-odds; a word counts by its best beginning), also after undoing look-alike characters; how near insults stand to a second person; capitals, punctuation and obfuscation rates; length.
The trees learn from at most `most_rows` labelled rows (documented bound); the isotonic map from a fold of them that the
trees have not seen. Rows whose crc32 of the id divides by 5 are never learned from.

Cases: null and empty texts have all features zero and get the score of such a text; texts of any length are read
whole; without usable labels the score is the prior 0.5 clipped below it, so that nothing is called toxic. Repeated rows get equal
scores. Empty tables give no rows. Labels of ids that are not in the documents are ignored, and so are other columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import common
from chronolake.llm.boosting import Isotonic, Trees
from chronolake.llm.training import labelled_sample

# Common insults and second persons in English, German, French and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns jerk fool filthy garbage "
    "imbecile cretin dimwit halfwit scumbag lowlife hideous vile despicable "
    "idioten dumm dummkopf blöd trottel abschaum wertlos ekelhaft versager widerlich "
    "stupide crétin débile abruti ordure dégoûtant imbécile raclure minable "
    "estúpido imbécil basura asqueroso patético tonto inútil payaso escoria".split()
)
SECOND_PERSON = frozenset("you your yours yourself ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
LOOK_ALIKES = str.maketrans("0134578@$!", "oieastbasi")

TOKEN = re.compile(r"[^\W_]+(?:[@$*!0-9]+[^\W\d_]+)*")
ODD = re.compile(r"[^\W\d_][@$*0-9]+[^\W\d_]|([^\W\d_])\1\1")
NEAR = 6
FEATURES = 18
#: Lengths of the beginnings of words that the learned lexicon may hold next to whole words.
BEGINNINGS = range(3, 9)
#: Words whose weight a Lexicon remembers.
REMEMBERED = 100_000


class Lexicon:
    """Terms with log-odds: whole words as they are, beginnings with a hyphen after them."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self._known = terms, {}

    def weight(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            terms = self.terms
            found = terms.get(word, 0.0)
            for k in BEGINNINGS:
                if k > len(word):
                    break
                found = max(found, terms.get(word[:k] + "-", 0.0))
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[word] = found
        return found


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * FEATURES
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    marks = int((((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | (raw >= 91) & (raw <= 96)).sum())
    shouts = int((raw == 33).sum())
    words = TOKEN.findall(text.lower())
    n = len(words) or 1
    fixed, known, weight, most, hidden, persons, at = 0, 0, 0.0, 0.0, 0, [], []
    weigh = lexicon.weight
    for i, w in enumerate(words):
        if w in INSULTS:
            fixed += 1
            at.append(i)
        elif w in SECOND_PERSON:
            persons.append(i)
        if own := weigh(w):
            known += 1
            weight += own
            most = max(most, own)
            if w not in INSULTS:
                at.append(i)
        elif not w.isalpha() and (plain := w.translate(LOOK_ALIKES).replace("*", "")) != w and (plain in INSULTS or weigh(plain)):
            hidden += 1
            at.append(i)
    if at and persons:
        p = np.array(persons)
        spots = np.searchsorted(p, at)
        gaps = [min((abs(int(p[k]) - i) for k in (s - 1, s) if 0 <= k < len(p)), default=99) for i, s in zip(at, spots)]
        near = sum(g <= NEAR for g in gaps)
    else:
        near = 0
    odd = sum(1 for _ in ODD.finditer(text))
    return [
        100 * fixed / n,
        100 * known / n,
        100 * hidden / n,
        math.log1p(fixed),
        math.log1p(known),
        100 * weight / n,
        most,
        math.log1p(len(at)),
        100 * near / n,
        near / len(at) if at else 0.0,
        100 * len(persons) / n,
        upper / (upper + lower or 1),
        marks / len(raw),
        100 * shouts / len(raw),
        100 * odd / n,
        len(set(words)) / n,
        math.log1p(len(words)),
        len(raw) / n,
    ]


def learned_lexicon(sample: DataFrame, most_terms: int, least_share: float) -> Lexicon:
    """Terms that at least such a share of the toxic rows hold (4 rows at least) and other rows hardly do; the most_terms that tell most."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    terms = [F.transform(F.filter(words, lambda w, k=k: F.length(w) >= k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("-"))) for k in BEGINNINGS]
    seen = sample.select("y", F.explode(F.array_distinct(F.concat(words, *terms))).alias("term"))
    toxic, clean = (int(x or 0) for x in sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not toxic or not clean:
        return Lexicon({})
    counts = seen.groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    top = counts.where(F.col("t") >= max(4.0, least_share * toxic)).select("term", odds.alias("odds"), (F.col("t") * odds).alias("told")).where("odds > 2.5")
    return Lexicon({r["term"]: r["odds"] for r in top.orderBy(F.desc("told"), "term").limit(most_terms).collect()})


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: Trees, curve: Isotonic | None):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, FEATURES)
        return np.full(len(x), 0.499) if self.curve is None else self.curve(self.trees.margin(x))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_terms: int = 500, least_share: float = 0.01) -> ToxicityModel:
    """Learns from at most most_rows labelled rows; features, not texts, come to the driver."""
    sample = labelled_sample(labels, "toxic", most_rows)
    rows = common.cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    lexicon = learned_lexicon(rows.where("fold < 4"), most_terms, least_share)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "fold": b["fold"], "x": [features(t, lexicon) for t in b["text"]]})

    got = rows.mapInPandas(extract, "y int, fold int, x array<double>").toPandas()
    x, y, fold = np.array(got["x"].tolist()).reshape(-1, FEATURES), got["y"].to_numpy(float), got["fold"].to_numpy()
    order = np.lexsort([*x.T, y])  # the rows' order changes from run to run
    x, y, fold = x[order], y[order], fold[order]
    if len(np.unique(y[fold < 4])) < 2 or not (fold == 4).any():
        return ToxicityModel(lexicon, Trees(), None)
    trees = Trees().fit(x[fold < 4], y[fold < 4])
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.margin(x[fold == 4]), y[fold == 4]))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores (double, 0 to 1)."""
    return common.with_score(docs, text_col, name, lambda texts: model.score(texts.to_pylist()))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, common.labels(spark, sf_dir))
    return score(docs, model).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
