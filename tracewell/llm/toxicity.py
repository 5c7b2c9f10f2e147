"""Toxicity by weak supervision.

Many voters look at a text: lexicons, patterns, and lexicons mined from labelled rows (words and stems that are
significantly more frequent under the label). A generative model treats the votes as noisy views of one hidden
class: it estimates each voter's accuracy and, by a tree of the strongest dependences given the class, their
correlations; the annotators are one more voter. Its posterior labels train a linear classifier, which scores
every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import crc_text, slices, stored, strings, whole_text

MAX_LABELLED = 50_000  # labelled rows that the models are fitted on, by hash of the id
MAX_TERMS = 2_000  # mined terms that may become features
MINED_VOTERS = 4  # voters that share the mined words, and as many for each length of stem
STEMS = (4, 5, 6)
SIGNIFICANT = 3.0  # standard errors of a mined term's log odds
TELLING = 2.5  # its least log odds ratio: twelve times the odds
ANNOTATORS = ((0.001, 0.05), (0.7, 0.999))  # bounds of P(labelled toxic | clean) and P(labelled toxic | toxic)
SLICE_CHARS = 4_000_000
CACHED = 500_000

# Seed lexicons: common insults and abuse. Fixed values.
LEXICONS = {
    "insult": "idiot idiots moron morons imbecile imbeciles fool fools dumbass jerk jerks loser losers clown clowns dimwit halfwit cretin bozo",
    "contempt": "scum scumbag trash garbage filth vermin parasite parasites worm worms pig pigs swine rat rats lowlife",
    "adjective": "stupid dumb pathetic worthless disgusting useless retarded ugly despicable repulsive brainless moronic idiotic",
    "profanity": "fuck fucking fucked fucker shit shitty bullshit bitch bitches bastard bastards asshole assholes crap damn dick cunt whore slut",
    "violence": "kill murder strangle stab shoot hang burn rape beat destroy exterminate eradicate",
    "hate": "hate hates hated despise loathe detest",
    "french": "idiot idiote imbécile connard connasse salaud salope débile crétin abruti ordure pute merde",
    "german": "idiot idioten dummkopf arschloch trottel depp abschaum wertlos scheiße hurensohn schlampe vollidiot",
    "spanish": "idiota imbécil estúpido estúpida cabrón puta mierda basura gilipollas pendejo asqueroso inútil",
}
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = {
    "you are": re.compile(r"\byou(?:'re| are)\s+(?:such\s+)?(?:an?\s+)?(?:complete\s+|total\s+|fucking\s+)?(?:idiot|moron|loser|fool|clown|disgrace|joke|stupid|pathetic|worthless)"),
    "go away": re.compile(r"\b(?:shut (?:the \w+ )?up|go to hell|get lost|kill yourself|drop dead|go die)\b"),
    "threat": re.compile(r"\b(?:i will|i'll|i'm going to|we will|we'll) (?:kill|hurt|hunt|find|beat|destroy) (?:you|them|him|her)\b"),
    "masked": re.compile(r"\b(?:f[*#@]+ck|f\*+|sh[*#@!]+t|b[*#@!]+tch|a[*#@]+hole|[i1]d[i1]0t)"),
    "shouting": re.compile(r"!{3,}|\?!\?!"),
}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    """The word itself and its longer stems; a stem carries its mark, so it never equals a word."""
    return [word, *[f"{word[:n]}~" for n in STEMS if len(word) > n]]


@dataclass
class Lexicons:
    """Words and stems with the voters they fire and the feature they are."""

    voters: list[str]
    fires: dict[str, int]  # term -> bits of voters
    feature: dict[str, int]  # mined term -> feature

    def __post_init__(self):
        self.cache: dict[str, tuple[int, tuple[int, ...]]] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def look(self, text: str) -> tuple[int, set[int]]:
        """Votes as bits, and the features of the text."""
        votes, found, cache = 0, set(), self.cache
        for w in words_of(text):
            hit = cache.get(w)
            if hit is None:
                terms = terms_of(w)
                bits = 0
                for t in terms:
                    bits |= self.fires.get(t, 0)
                hit = cache[w] = (bits, tuple(self.feature[t] for t in terms if t in self.feature))
            if hit is not _NOTHING and (hit[0] or hit[1]):
                votes |= hit[0]
                found.update(hit[1])
        if len(cache) > CACHED:
            cache.clear()
        lower = text.lower()
        for k, pattern in enumerate(PATTERNS.values()):
            if pattern.search(lower):
                votes |= 1 << (len(LEXICONS) + k)
        return votes, found


_NOTHING = (0, ())


def lexicons(mined: list[str]) -> Lexicons:
    voters = [*LEXICONS, *PATTERNS]
    fires: dict[str, int] = {}
    for k, text in enumerate(LEXICONS.values()):
        for w in text.split():
            fires[w] = fires.get(w, 0) | 1 << k
    kinds = {0: "words", **{n: f"stems of {n}" for n in STEMS}}
    first = {}
    for kind, name in kinds.items():
        first[kind] = len(voters)
        voters += [f"mined {name} {k}" for k in range(MINED_VOTERS)]
    for k, term in enumerate(sorted(mined)):
        kind = len(term) - 1 if term.endswith("~") else 0
        fires[term] = fires.get(term, 0) | 1 << (first[kind] + k % MINED_VOTERS)
    return Lexicons(voters, fires, {t: k for k, t in enumerate(sorted(mined))})


def mined_terms(sample: DataFrame) -> list[str]:
    """Terms of labelled texts (``text, toxic``) whose log odds under the label are significant, the surest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                for t in {t for w in words_of(text) for t in terms_of(w)}:
                    counts.setdefault(t, [0, 0])[toxic] += 1
            both = list(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[1] for x in both], pa.int64()), pa.array([x[0] for x in both], pa.int64())], ["term", "p", "n"])

    totals = sample.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not totals["p"] or not totals["n"]:
        return []
    counts = sample.select("text", "toxic").mapInArrow(run, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n = F.col("p") + 0.5, F.col("n") + 0.5
    odds = F.log(p / (totals["p"] + 1 - p)) - F.log(n / (totals["n"] + 1 - n))
    surest = counts.where("p >= 3").withColumn("z", odds / F.sqrt(1 / p + 1 / n)).where(F.col("z") >= SIGNIFICANT).where(odds >= TELLING)
    return [r["term"] for r in surest.orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect()]


def bits_of(votes: np.ndarray, voters: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(voters)) & 1).astype(np.int8)


class LabelModel:
    """Hidden class with dependent voters: P(y) and P(vote | vote of the parent, y), fitted by EM.

    ``seen`` is the annotators' vote (1, 0, or -1 where there is none), a voter without parent.
    """

    def __init__(self, votes: np.ndarray, seen: np.ndarray, rounds: int = 15):
        table = np.column_stack([votes, seen])
        self.patterns, inverse, self.weight = np.unique(table, axis=0, return_inverse=True, return_counts=True)
        self.inverse = inverse.ravel()
        self.votes, self.seen = self.patterns[:, :-1].astype(int), self.patterns[:, -1]
        self.parent = np.full(votes.shape[1], -1)
        fired = self.votes.any(axis=1)
        # The start: the annotators where they voted, else whether any voter fires.
        self.posterior = np.where(self.seen >= 0, np.where(self.seen == 1, 0.9, 0.05), np.where(fired, 0.6, 0.05))
        for turn in range(2):
            for _ in range(rounds):
                self._maximise()
                self.posterior = self._expect(True)
            if turn == 0:
                self.parent = self._tree()

    def _maximise(self) -> None:
        w1, w0 = self.weight * self.posterior, self.weight * (1 - self.posterior)
        self.prior = float((w1.sum() + 1) / (self.weight.sum() + 10))
        self.chance = np.empty((self.votes.shape[1], 2, 2))  # voter, parent's vote, class
        for j, parent in enumerate(self.parent):
            up = self.votes[:, parent] if parent >= 0 else np.zeros(len(self.votes), dtype=int)
            for value in (0, 1):
                here = up == value
                for y, w in enumerate((w0, w1)):
                    self.chance[j, value, y] = ((w * self.votes[:, j])[here].sum() + (0.02 if y == 0 else 0.2)) / (w[here].sum() + 1)
        known = self.seen >= 0
        rates = [((w * (self.seen == 1))[known].sum() + a) / (w[known].sum() + 2) for w, a in ((w0, 0.1), (w1, 1.9))]
        self.annotator = [float(np.clip(r, *bounds)) for r, bounds in zip(rates, ANNOTATORS)]

    def _expect(self, with_annotator: bool) -> np.ndarray:
        logit = np.log(self.prior / (1 - self.prior)) + np.zeros(len(self.votes))
        for j, parent in enumerate(self.parent):
            up = self.votes[:, parent] if parent >= 0 else np.zeros(len(self.votes), dtype=int)
            chance = np.clip(self.chance[j, up], 1e-6, 1 - 1e-6)
            vote = self.votes[:, j]
            logit += np.where(vote == 1, np.log(chance[:, 1] / chance[:, 0]), np.log((1 - chance[:, 1]) / (1 - chance[:, 0])))
        if with_annotator:
            a0, a1 = self.annotator
            logit += np.where(self.seen == 1, np.log(a1 / a0), np.where(self.seen == 0, np.log((1 - a1) / (1 - a0)), 0))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def _tree(self) -> np.ndarray:
        """The spanning tree of the largest mutual information given the class (pairs without any stay apart)."""
        voters = self.votes.shape[1]
        total, information = self.weight.sum(), np.zeros((voters, voters))
        for w in (self.weight * self.posterior, self.weight * (1 - self.posterior)):
            both = (self.votes * w[:, None]).T @ self.votes
            ones, n = np.diag(both), w.sum() + 1e-9
            for a in (0, 1):
                for b in (0, 1):
                    joint = both if a and b else ones[:, None] - both if a else ones[None, :] - both if b else n - ones[:, None] - ones[None, :] + both
                    expected = np.outer(ones if a else n - ones, ones if b else n - ones) / n
                    joint = np.maximum(joint, 0)
                    information += np.where((joint > 0) & (expected > 0), joint * np.log(np.maximum(joint, 1e-12) / np.maximum(expected, 1e-12)), 0) / total
        np.fill_diagonal(information, 0)
        parent, inside = np.full(voters, -1), np.zeros(voters, dtype=bool)
        for _ in range(voters):
            reach = np.where(inside[:, None] & ~inside[None, :], information, -1)
            a, b = np.unravel_index(reach.argmax(), reach.shape)
            if reach[a, b] <= 1e-6:
                b = int(np.flatnonzero(~inside)[0])
            else:
                parent[b] = a
            inside[b] = True
        return parent

    def labels(self) -> np.ndarray:
        return self.posterior[self.inverse]

    def accuracies(self) -> np.ndarray:
        """P(vote fires | toxic) and P(silent | clean) for each voter, over its parent's votes."""
        w1, w0 = self.weight * self.posterior, self.weight * (1 - self.posterior)
        return np.column_stack([(self.votes * w1[:, None]).sum(0) / max(w1.sum(), 1e-9), 1 - (self.votes * w0[:, None]).sum(0) / max(w0.sum(), 1e-9)])


def linear_classifier(rows: np.ndarray, features: np.ndarray, n_rows: int, n_features: int, label: np.ndarray, l2: float = 0.3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; the rows' features are pairs ``(row, feature)``. Scaled gradient steps."""
    weight, bias = np.zeros(n_features), float(np.log((label.sum() + 1) / (n_rows - label.sum() + 1)))
    seen = np.bincount(features, minlength=n_features) if len(features) else np.zeros(n_features)
    size = np.bincount(rows, minlength=n_rows).max() if len(rows) else 1
    momentum, speed = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for turn in range(1, rounds + 1):
        margin = bias + np.bincount(rows, weights=weight[features], minlength=n_rows)
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label
        gradient = np.append(np.bincount(features, weights=error[rows], minlength=n_features) + l2 * weight, error.sum())
        momentum = 0.9 * momentum + 0.1 * gradient
        speed = 0.99 * speed + 0.01 * gradient**2
        step = 0.15 * (momentum / (1 - 0.9**turn)) / (np.sqrt(speed / (1 - 0.99**turn)) + 1e-8)
        weight, bias = weight - np.where(seen > 0, step[:-1], 0), bias - step[-1]
    return weight, bias


@dataclass
class ToxicityModel:
    lexicons: Lexicons
    weight: np.ndarray
    bias: float
    label_model: LabelModel | None = None

    def __getstate__(self):
        return {**self.__dict__, "label_model": None}

    def score(self, text: str) -> float:
        votes, found = self.lexicons.look(text)
        margin = self.bias + sum(self.weight[k] for k in found)
        first = len(self.lexicons.feature)
        k = 0
        while votes:
            if votes & 1:
                margin += self.weight[first + k]
            votes >>= 1
            k += 1
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def train_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit voters, label model and classifier on labelled rows outside the held-out fold, at most MAX_LABELLED ids.

    Several labels of one id count as their majority, a tie as toxic; null labels and ids are left out. Without
    toxic and clean rows nothing can be mined or estimated, and the fixed lexicons vote with equal weights.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.pmod(crc_text("doc_id"), F.lit(folds)) != held_out)
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = docs.select(docs[id_col].alias("doc_id"), whole_text(text_col).alias("text"))
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["text"]), "labelled")
    # Terms are mined on one half, so that on the other half their votes are honest.
    mined = mined_terms(sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    own = lexicons(mined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looked = [own.look(t) for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in looked], pa.int64()), pa.array([sorted(f) for _, f in looked], pa.list_(pa.int32())), batch.column(1)], ["votes", "features", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "votes long, features array<int>, toxic int").toPandas()  # MAX_LABELLED at most
    size = len(mined) + len(own.voters)
    if not 0 < rows["toxic"].sum() < len(rows):
        return ToxicityModel(own, np.concatenate([np.zeros(len(mined)), np.full(len(own.voters), 2.0)]), -3.0)
    votes = bits_of(rows["votes"].to_numpy(np.int64), len(own.voters))
    model = LabelModel(votes, rows["toxic"].to_numpy())
    lists = [np.asarray(f, dtype=np.int64) for f in rows["features"]]
    at = np.repeat(np.arange(len(rows)), [len(f) for f in lists])
    fired = np.nonzero(votes)
    weight, bias = linear_classifier(
        np.concatenate([at, fired[0]]), np.concatenate([*lists, fired[1] + len(mined)]).astype(np.int64), len(rows), size, model.labels()
    )
    return ToxicityModel(own, weight, bias, model)


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every whole text; a null text is empty. The score column replaces its namesake."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_TERMS weights and terms
    rest = [c for c in docs.columns if c != score_col]
    where = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = pa.array([own.score(t) for t in strings(batch.column(where).cast(pa.string()))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, score_col])

    out = docs.select(*rest).schema.add(score_col, "double")
    return docs.select(*rest).mapInArrow(run, out)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Labels outside the fold train the model; labels and other columns are never inputs of a score. A null text is
    empty; empty texts score by the classifier's constant. A null id is never held out. An empty table gives an
    empty one; repeated rows score alike.
    """
    model = train_toxicity(docs, labels, folds, held_out, id_col, text_col)
    fold = F.coalesce(F.pmod(crc_text("doc_id"), F.lit(folds)) == held_out, F.lit(False))
    scored = score_texts(docs.select(docs[id_col].alias("doc_id"), whole_text(text_col).alias("text")), model)
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
