"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or abstain on each text. Expectation-maximisation estimates how
often each labeller votes what under either class, without any true label; texts with equal votes are one row of it,
so it works on at most 3^labellers rows however many texts there are. The posteriors are the labels of a hashed linear
scorer, fitted on a bounded sample of texts and applied to all.

Two models run side by side, one of quality and one of toxicity. A text is kept if its quality score is at least
KEEP_QUALITY and its toxicity score under KEEP_TOXIC. No column but the text is read.

The sample is SAMPLE_DOCS texts in expectation, drawn by a hash of the text. Defined results: null and empty texts have
no votes but the length labeller's; without any text there is no model and no row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import and_, eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, materialize

SAMPLE_DOCS = 6000
BUCKETS = 1 << 18
EPOCHS = 12
RATE = 0.5
ROUNDS = 60
KEEP_QUALITY = 0.5
KEEP_TOXIC = 0.5
MEMO = 200_000
BEGINNING = 4  # characters of a word that stand for its family

GOOD, BAD, NONE = "1", "0", "-"

# Frequent function words of English, French, German and Spanish; insults by theme.
FUNCTION_WORDS = frozenset("the of and to in a is that it for was on are with as be at by this from or an not de la le les et des en un une du que est pour dans qui au par der die das und ein eine von zu den mit ist nicht im dem auf für el los las y por con una se no su lo para del al".split())
ENGLISH = frozenset("the of and to in is that it for was on are with as be at by this from or an not".split())
MOCKERY = frozenset("idiot idiots moron morons stupid dumb imbecile fool fools".split())
CONTEMPT = frozenset("trash scum garbage worthless filth vermin pathetic disgusting".split())
DERISION = frozenset("clown clowns loser losers freak freaks jerk crap bastard".split())
INSULTS = MOCKERY | CONTEMPT | DERISION

_SYMBOL = re.compile(r"[#$%&*|<>{}~^=\\]+")
_TRAILING = frozenset("#$%&*|<>{}~^=!")
_ENDS = ".,;:!?\"'()"
_WORD = re.compile(r"[^\W\d_]+")


def _vote(value: float, bad: bool, good: bool) -> str:
    return BAD if bad else GOOD if good else NONE


def votes(text: str | None) -> tuple[str, str]:
    """A character a labeller: those of quality, those of toxicity (there 1 is toxic)."""
    text = text or ""
    words = text.split()
    n = len(words)
    low = text.lower()
    tokens = _WORD.findall(low)
    quality = [_vote(n, n < 1, n >= 2)]
    if n >= 5:
        same = list(map(eq, words, words[1:]))
        repeat = sum(same) / n
        quality.append(_vote(repeat, repeat > 0.15, repeat < 0.03))
        longest = max(map(len, bytes(same).split(b"\0")))
        quality.append(_vote(longest, longest > 3, longest < 2))
        thrice = sum(map(and_, same, same[1:])) / n
        quality.append(_vote(thrice, thrice > 0.08, thrice == 0))
        symbols = len(_SYMBOL.findall(text)) / n
        quality.append(_vote(symbols, symbols > 0.15, symbols < 0.03))
        capitals = sum(w.isupper() for w in words) / n
        quality.append(_vote(capitals, capitals > 0.3, capitals < 0.1))
        marks = text.count("!") / n
        quality.append(_vote(marks, marks > 0.3, marks < 0.05))
        top = Counter(tokens).most_common(1)[0][1] / len(tokens) if tokens else 1.0
        quality.append(_vote(top, top > 0.3, top < 0.15) if n >= 20 else NONE)
        known = sum(map(FUNCTION_WORDS.__contains__, tokens)) / max(len(tokens), 1)
        quality.append(_vote(known, known < 0.03 or known > 0.75, 0.12 < known < 0.6))
        trailing = sum(w[-1] in _TRAILING for w in words) / n
        quality.append(_vote(trailing, trailing > 0.2, trailing < 0.03))
        letters = sum(map(len, tokens)) / max(len(text) - text.count(" "), 1)
        quality.append(_vote(letters, letters < 0.75, letters > 0.88))
    else:
        quality += [NONE] * 10
    seen = INSULTS.intersection(tokens)
    hits = sum(map(INSULTS.__contains__, tokens)) if seen else 0
    share = hits / max(len(tokens), 1)
    # the lists are English: that none of their words is there says something of English texts only
    clean = BAD if not seen and sum(map(ENGLISH.__contains__, tokens)) > 0.08 * len(tokens) else NONE
    toxic = [
        GOOD if seen & MOCKERY else clean,
        GOOD if seen & CONTEMPT else clean,
        GOOD if seen & DERISION else clean,
        GOOD if len(seen) > 1 or share > 0.01 else clean,
    ]
    return "".join(quality), "".join(toxic)


@dataclass
class LabelModel:
    """Class prior and, by class and labeller, the probabilities of the votes bad and good of those who vote."""

    prior: float
    table: np.ndarray

    @classmethod
    def fit(cls, patterns: list[str], counts: list[int], rounds: int = ROUNDS) -> LabelModel:
        """Expectation-maximisation over vote patterns. The last character of a pattern is what a person said of the text,
        if one did: that is not estimated but holds."""
        said = np.array([(BAD + GOOD + NONE).index(p[-1]) for p in patterns])
        patterns = [p[:-1] for p in patterns]
        codes = np.array([[(BAD + GOOD + NONE).index(v) for v in p] for p in patterns])
        weight = np.array(counts, np.float64)
        shown = np.eye(3)[codes]  # pattern, labeller, vote
        # begin with the majority: it also fixes which class is which
        q = (shown[:, :, 1].sum(axis=1) + 0.5) / (shown[:, :, :2].sum(axis=(1, 2)) + 1)
        q = np.where(said < 2, said, q)
        model = cls(0.5, np.zeros((2, codes.shape[1], 3)))
        for _ in range(rounds):
            table = []
            for share in (1 - q, q):
                mass = np.einsum("p,plv->lv", weight * share, shown) + 0.5
                mass[:, :2] /= mass[:, :2].sum(axis=1, keepdims=True)
                mass[:, 2] = 1  # who abstains says nothing
                table.append(mass)
            model = cls(float(np.clip((weight * q).sum() / weight.sum(), 1e-4, 1 - 1e-4)), np.stack(table))
            new = np.where(said < 2, said, model._posterior(patterns))
            if np.abs(new - q).max() < 1e-6:
                break
            q = new
        return model

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability of the class 1 for each pattern; what a person said settles it."""
        own = self._posterior([p[:-1] for p in patterns])
        return np.array([float(p[-1]) if p[-1] != NONE else x for p, x in zip(patterns, own.tolist(), strict=True)])

    def _posterior(self, patterns: list[str]) -> np.ndarray:
        codes = np.array([[(BAD + GOOD + NONE).index(v) for v in p] for p in patterns])
        logs = np.log(self.table)[:, np.arange(codes.shape[1]), codes].sum(axis=2) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


_memo: dict[str, tuple[int, int, int]] = {}


def _places(word: str) -> tuple[int, int, int]:
    """Buckets of a word in lower case, of its shape (kinds of characters, runs shortened) and of its beginning."""
    known = _memo.get(word)
    if known is None:
        core = word.strip(_ENDS)
        if core.isalpha():
            shape = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[1:].islower() else "aA"
        else:
            shape = re.sub(r"(.)\1+", r"\1+", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:40]))
            core = "".join(_WORD.findall(word)) or word
        low = core.lower()
        known = xxhash.xxh32_intdigest(low, 1) % BUCKETS, xxhash.xxh32_intdigest(shape, 2) % BUCKETS, xxhash.xxh32_intdigest(low[:BEGINNING], 3) % BUCKETS
        if len(_memo) >= MEMO:
            _memo.clear()
        _memo[word] = known
    return known


def features(text: str | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Buckets and values by scorer. Quality: words and shapes by the root of their share, and how many words repeat the
    one before. Toxicity: which words and families of words are there, since one is enough in however long a text."""
    words = (text or "").split()
    if not words:
        return {"quality": (np.zeros(1, np.int64), np.ones(1, np.float32)), "toxic": (np.zeros(1, np.int64), np.ones(1, np.float32))}
    counts = Counter(words)
    places = np.array([_places(w) for w in counts], np.int64)
    share = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / len(words))
    repeat = sum(map(eq, words, words[1:])) / len(words)
    shapes, which = np.unique(places[:, 1], return_inverse=True)
    kinds = np.sqrt(np.bincount(which, share**2)).astype(np.float32)
    own = np.unique(places[:, [0, 2]])
    at = np.concatenate((places[:, 0], shapes, [0, 1]))
    return {
        "quality": (at, np.concatenate((share, kinds, [1.0, 4 * repeat])).astype(np.float32)),
        "toxic": (np.concatenate((own, [0])), np.concatenate((np.ones(len(own)), [1.0])).astype(np.float32)),
    }


def fit_scorer(name: str, texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Weights of a logistic scorer by adaptive gradient steps, in a fixed order."""
    rows = [features(t)[name] for t in texts]
    weights, seen = np.zeros(BUCKETS, np.float32), np.full(BUCKETS, 1e-3, np.float32)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, value = rows[i]
            step = (_logistic(weights[at] @ value) - labels[i]) * value
            seen[at] += step * step
            weights[at] -= rate * step / np.sqrt(seen[at])
    return weights


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def score(models: dict[str, np.ndarray], texts: list[str | None]) -> list[tuple[float, ...]]:
    """Probabilities of each text under each scorer."""
    out = []
    for t in texts:
        own = features(t)
        out.append(tuple(_logistic(w[own[name][0]] @ own[name][1]) for name, w in models.items()))
    return out


VOTES = T.StructType([T.StructField("quality_votes", T.StringType()), T.StructField("toxic_votes", T.StringType())])
_WEIGHTS = T.StructType([T.StructField("name", T.StringType()), T.StructField("weights", T.BinaryType())])
SCORES = T.StructType([T.StructField("quality_score", T.DoubleType()), T.StructField("toxic_score", T.DoubleType())])


def _label_model(voted: DataFrame, column: str) -> tuple[LabelModel, dict[str, float]] | None:
    rows = sorted((r[0], r[1]) for r in voted.groupBy(column).count().collect())
    if not rows:
        return None
    patterns = [p for p, _ in rows]
    model = LabelModel.fit(patterns, [n for _, n in rows])
    return model, dict(zip(patterns, model.posterior(patterns).tolist(), strict=True))


def _fit(sample: DataFrame, posteriors: dict[str, dict[str, float]]) -> dict[str, np.ndarray]:
    """A scorer a name, each fitted in one task on the bounded sample."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["name"].iloc[0]
        judged = pdf[pdf["pattern"].str.strip(NONE) != ""]  # of the rest nothing is known
        pdf = judged if len(judged) else pdf.sort_values(["text"], na_position="first")
        labels = np.array([posteriors[name][p] for p in pdf["pattern"]])
        return pd.DataFrame({"name": [name], "weights": [fit_scorer(name, list(pdf["text"]), labels).astype("<f4").tobytes()]})

    both = sample.select("text", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_votes").alias("pattern")) for n in posteriors])))
    return {r["name"]: np.frombuffer(bytes(r["weights"]), "<f4") for r in both.groupBy("name").applyInPandas(fit, _WEIGHTS).collect()}


def _said(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with said_quality and said_toxic: what a person said of them, 1 or 0, or - where nobody did."""
    if labels is None:
        return rows.select("*", F.lit(NONE).alias("said_quality"), F.lit(NONE).alias("said_toxic"))
    one = lambda c: F.when(F.min(c) == F.max(c), F.max(c).cast("int").cast("string")).alias(f"said_{c}")  # noqa: E731  people who differ say nothing
    by_id = labels.groupBy(F.col("doc_id").alias("label_id")).agg(one("quality"), one("toxic"))
    joined = rows.join(by_id, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(NONE)) for c in ("said_quality", "said_toxic")})


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, quality_score, toxic_score, keep: one row a text.

    labels (doc_id, quality, toxic) is what people said of some of the texts, if there is any: in the label model it holds
    as it is and the heuristic labellers are measured against it. The scorers are fitted on sample_docs texts with and
    as many without it in expectation; ids and labels are no inputs of a score.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    draw = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("weak")), F.lit(1_000_000_000))
    judge = lambda texts: [votes(t) for t in texts]
    # labels join digests of the texts' votes, not the texts
    voted = _said(arrow_map(rows.select("doc_id", draw.alias("draw"), "text"), lambda: judge, "text", VOTES), labels)
    voted = materialize(voted.select("doc_id", "draw", *[F.concat(f"{n}_votes", f"said_{n}").alias(f"{n}_votes") for n in ("quality", "toxic")]), "votes")
    models = {name: _label_model(voted, f"{name}_votes") for name in ("quality", "toxic")}
    said = F.col("quality_votes").substr(-1, 1) != NONE
    total, labelled = voted.agg(F.count("*"), F.count_if(said)).first()
    if not total:
        return rows.select("doc_id", *[F.lit(None).cast("double").alias(c) for c in SCORES.names], F.lit(False).alias("keep"))
    posteriors = {name: m[1] for name, m in models.items()}
    limit = lambda n: int(min(1.0, sample_docs / max(n, 1)) * 1_000_000_000)
    chosen = voted.where(F.when(said, F.col("draw") < limit(labelled)).otherwise(F.col("draw") < limit(total - labelled))).select("doc_id", "draw", "quality_votes", "toxic_votes").distinct()
    sample = rows.withColumn("draw", draw).join(chosen, ["doc_id", "draw"]).select("text", "quality_votes", "toxic_votes")
    weights = _fit(sample.dropDuplicates(["text"]), posteriors)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def each():
        own = shared.value
        return lambda texts: list(score({name: own[name] for name in ("quality", "toxic")}, texts))

    scored = arrow_map(rows, each, "text", SCORES, size=64)
    return scored.withColumn("keep", (F.col("quality_score") >= KEEP_QUALITY) & (F.col("toxic_score") < KEEP_TOXIC))
