"""Scores for abusive, hateful or sexual content from passages of a document."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.ordinal import OrdinalModel, Rows
from rillstone.plans.cut import cut

# Grades of the labels, in the order in which the labels name ever graver content as this engine ranks it, so
# that one scale serves review (insults below attacks on groups, these below explicit content); letters that look alike; digits and signs in place of letters.
GRADES = {"none": 0, "abusive": 1, "hateful": 2, "sexual": 3}
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁɡαεικνορτυχ", "abekmhopctyxijsdgaeiknoptux")
SIGNS = str.maketrans("013457@$!|+€", "oieastasiite")

FEATURES = 1 << 18
MOST_LABELLED = 10_000
MOST_PASSAGES = 30_000
POSITIVE_WEIGHT = 1.5
ROUNDS = (60, 40, 40, 100)
DOUBT = 0.1
LEAST_LIMIT = 0.25
MOST_CHARS = 40_000_000
TEXTS_AT_ONCE = 250
BREAK = "\0"
TAG = re.compile(r"<!--.*?-->|<[/!?]?[a-zA-Z][^<>]*>", re.S)
END = re.compile(r"(?<=[.!?;:])\s+|[\n|]+|(?<=[,])\s+(?=(?:and|but|so|then|plus)\b)")
TOKEN = re.compile(r"[^\W_]+(?:[@$!*|+€.'-]+[^\W_]+)*|[@$*|][^\W_@$*|]+|\0")
SPACED = re.compile(r"\b(?:[^\W\d_][ .*_-]){2,}[^\W\d_]\b")


class _Letters(dict):
    """What becomes of a character: marks and format characters vanish, look-alike letters are read as Latin ones."""

    def __missing__(self, c: int) -> int | str | None:
        gone = unicodedata.category(chr(c)) in ("Mn", "Me", "Cf")
        self[c] = found = None if gone else LOOKALIKES.get(c, c)
        return found


_LETTERS = _Letters()


def fold(text: str) -> str:
    """Text without tags and entities, in lower case, with marks, format characters and look-alike letters undone."""
    if "<" in text:
        text = TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_LETTERS)
    return text.replace(BREAK, " ")


def plain(token: str) -> str:
    """A token as a word: signs and digits within it read as letters, masked letters as one star, long runs of a letter as one."""
    if "*" in token:
        return re.sub(r"\*+", "*", token.strip(".'-!"))
    if not token.isalpha():
        bare = re.sub(r"[.'-]", "", token)
        token = bare if bare.isdigit() else bare.translate(SIGNS)
    return re.sub(r"(.)\1{2,}", r"\1", token)


def pieces(text: str | None) -> list[str]:
    """Tokens of a text in order, with `BREAK` between its passages (sentences or parts of one). Letters written apart are joined."""
    if not text:
        return []
    text = SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m.group()), fold(text))
    return TOKEN.findall(END.sub(BREAK, text))


def passages(text: str | None) -> list[list[str]]:
    """Words of each passage."""
    found: list[list[str]] = [[]]
    for token in pieces(text):
        if token == BREAK:
            found.append([])
        else:
            found[-1].append(plain(token))
    return [words for words in found if words]


class Lexicon(dict):
    """Numbers of tokens as they come up, with the code of each one's word and the word's own features.

    A word has itself and its four-letter pieces as features. The break between passages has number 0. `BOUND` limits
    what is remembered between batches, not what is read.
    """

    BOUND = 100_000

    def __init__(self):
        super().__init__({BREAK: 0})
        self.codes, self.starts, self.own = [0], [0, 0], []
        self._kept = [np.zeros(0, np.int64)] * 3

    def arrays(self) -> list[np.ndarray]:
        """Codes, starts of own features and own features; only what is new since the last call is converted."""
        now = (self.codes, self.starts, self.own)
        self._kept = [np.concatenate([k, np.array(x[len(k) :], np.int64)]) if len(x) > len(k) else k for k, x in zip(self._kept, now)]
        return self._kept

    def __missing__(self, token: str) -> int:
        word = plain(token)
        padded = f"<{word}>"
        found = ["w " + word] + [f"c {padded[i : i + 4]}" for i in range(len(padded) - 3) if len(word) > 3]
        self.codes.append(zlib.crc32(word.encode()))
        self.own += [zlib.crc32(x.encode()) % FEATURES for x in found]
        self.starts.append(len(self.own))
        self[token] = at = len(self.codes) - 1
        return at


class Batch:
    """The passages of some texts as arrays: tokens by number, the passage of each token, and the text of each passage."""

    def __init__(self, texts: list[str | None], lexicon: Lexicon):
        tokens, ends = [], []
        for text in texts:
            tokens += pieces(text)
            tokens.append(BREAK)
            ends.append(len(tokens))
        ids = np.fromiter(map(lexicon.__getitem__, tokens), np.int64, len(tokens))
        kept = np.flatnonzero(ids)
        passage = np.cumsum(ids == 0)[kept]
        first = np.r_[True, passage[1:] != passage[:-1]] if len(kept) else np.zeros(0, bool)
        self.passage = np.cumsum(first) - 1
        self.text = np.searchsorted(np.array(ends, np.int64), kept[first], "right")
        self.ids = ids[kept]
        self.lexicon = lexicon

    def neighbours(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(passage, feature) of pairs of neighbours, of pairs with one word between, and of triples."""
        c, p = self.lexicon.arrays()[0][self.ids], self.passage
        near, far = np.flatnonzero(p[1:] == p[:-1]), np.flatnonzero(p[2:] == p[:-2])
        a, b, d = c[far], c[far + 1], c[far + 2]
        return [
            (p[near], (c[near] * 31 + c[near + 1] * 17 + 1) % FEATURES),
            (p[far], (a * 37 + d * 13 + 2) % FEATURES),
            (p[far], (a * 41 + b * 29 + d * 7 + 3) % FEATURES),
        ]

    def features(self) -> list[np.ndarray]:
        """Hashed features of each passage, as often as they occur: those of its words and of their neighbourhoods."""
        _, starts, own = self.lexicon.arrays()
        n = starts[self.ids + 1] - starts[self.ids]
        at = np.repeat(starts[self.ids] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        every = [(np.repeat(self.passage, n), own[at]), *self.neighbours()]
        passage, feature = (np.concatenate(x) for x in zip(*every))
        order = np.argsort(passage, kind="stable")
        return np.split(feature[order].astype(np.int32), np.cumsum(np.bincount(passage, minlength=len(self.text)))[:-1]) if len(self.text) else []

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The score `Rows.dot` gives the features of each passage."""
        _, starts, own = self.lexicon.arrays()
        sums = np.r_[0.0, np.cumsum(weights[own])]
        word, length = sums[starts[1:]] - sums[starts[:-1]], (starts[1:] - starts[:-1]).astype(float)
        size = len(self.text)
        total = np.bincount(self.passage, word[self.ids], size)
        count = np.bincount(self.passage, length[self.ids], size)
        for passage, feature in self.neighbours():
            total += np.bincount(passage, weights[feature], size)
            count += np.bincount(passage, minlength=size)
        return total / np.sqrt(np.maximum(count, Rows.SHORT))


def document_features(texts: list[str | None]) -> list[list[np.ndarray]]:
    """The features of each passage of each text."""
    lexicon = Lexicon()
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        batch = Batch(texts[at : at + TEXTS_AT_ONCE], lexicon)
        for text, row in zip(batch.text.tolist(), batch.features()):
            found[at + text].append(row)
    return found


class PassageModel:
    """The grade of a document is that of its worst passage; which one that is, is learned with the weights.

    Turn by turn: of a graded document the passage with the highest score is an example of its grade; passages of documents
    graded 0 are examples of grade 0, at most `most_passages` of them: one half spread evenly, the other those with the
    highest scores so far. The first scores are log-odds of features between graded and other documents. Examples that the
    model of the turn before finds very unlikely are taken for wrong labels and left out, at most half of the graded ones.
    """

    def __init__(self, most_passages: int = MOST_PASSAGES, least_limit: float = LEAST_LIMIT):
        self.model = OrdinalModel(FEATURES, len(GRADES))
        self.limit, self.most_passages, self.least_limit = 2.0, most_passages, least_limit

    def fit(self, rows: list[list[np.ndarray]], grade: np.ndarray) -> "PassageModel":
        """Learns the weights from all rows, and the limit from a model of three quarters of them scored on the rest."""
        if not (grade > 0).any() or not (grade == 0).any():
            return self
        held = np.arange(len(rows)) % 4 == 3
        try_on = [r for r, h in zip(rows, held) if h]
        trial = PassageModel(self.most_passages, self.least_limit)
        trial._learn([r for r, h in zip(rows, held) if not h], grade[~held])
        chance, bad = trial.chances(try_on), grade[held] > 0
        order = np.argsort(-chance, kind="stable")
        hits = np.cumsum(bad[order])
        f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(bad.sum(), 1))
        if len(f1):
            best = int(np.argmax(f1))
            after = chance[order[best + 1]] if best + 1 < len(order) else 0.0
            self.limit = max(self.least_limit, float((chance[order[best]] + after) / 2))
        self._learn(rows, grade)
        return self

    def _learn(self, rows: list[list[np.ndarray]], grade: np.ndarray) -> None:
        flat = [p for doc in rows for p in doc]
        doc_of = np.repeat(np.arange(len(rows)), [len(d) for d in rows])
        if not flat:
            return
        x = Rows(flat)
        pos, neg = np.zeros(FEATURES), np.zeros(FEATURES)
        for doc, bad in zip(rows, grade > 0):
            if doc:
                (pos if bad else neg)[np.unique(np.concatenate(doc))] += 1
        odds = np.log((pos + 0.5) / ((grade > 0).sum() + 1)) - np.log((neg + 0.5) / ((grade == 0).sum() + 1))
        z = x.dot(np.where((pos + neg >= 3) & (odds > 1.0), odds, 0.0))
        clean = np.flatnonzero(grade[doc_of] == 0)
        half = self.most_passages // 2
        for turn, rounds in enumerate(ROUNDS):
            best = self._best(z, doc_of, len(rows))
            worst = best[(grade > 0) & (best >= 0)]
            if turn:
                chance = self.model.at_least_one(z)
                worst = worst[chance[worst] >= min(DOUBT, float(np.median(chance[worst])))] if len(worst) else worst
                clean = clean[chance[clean] <= 1 - DOUBT / 4]
            hard = clean[np.argsort(-z[clean], kind="stable")[:half]]
            even = clean[np.linspace(0, len(clean) - 1, min(half, len(clean))).astype(int)] if len(clean) else clean
            at = np.r_[worst, np.union1d(hard, even)]
            g = np.r_[grade[doc_of[worst]], np.zeros(len(at) - len(worst), np.int64)]
            weight = np.where(g > 0, POSITIVE_WEIGHT, 1.0)
            self.model.fit(Rows([flat[i] for i in at], joined=True), g, weight, rounds=rounds)
            z = x.dot(self.model.w)

    @staticmethod
    def _best(z: np.ndarray, doc_of: np.ndarray, docs: int) -> np.ndarray:
        order = np.lexsort((-np.arange(len(z)), z, doc_of))
        best = np.full(docs, -1)
        best[doc_of[order]] = order
        return best

    def worst(self, rows: list[list[np.ndarray]]) -> np.ndarray:
        """The highest passage score of each document; minus infinity without passages."""
        z = Rows([p for doc in rows for p in doc]).dot(self.model.w)
        found = np.full(len(rows), -np.inf)
        np.maximum.at(found, np.repeat(np.arange(len(rows)), [len(d) for d in rows]), z)
        return found

    def chances(self, rows: list[list[np.ndarray]]) -> np.ndarray:
        z = self.worst(rows)
        return np.where(np.isfinite(z), self.model.at_least_one(z), 0.0)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_chars: int = MOST_CHARS) -> tuple[list[str | None], np.ndarray]:
    """Texts and grades of at most `most` labelled documents, those with the smallest hash of their id.

    The texts together have at most `most_chars` characters; from the document on that exceeds it, the rest is left out. A
    document with several labels has the highest of their grades; null and unknown labels say nothing. Repeated rows of a
    document count once. The documents are read once.
    """
    graded = F.element_at(F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv]), F.lower(F.trim("label")))
    one = labels.where(F.lower(F.trim("label")).isin(list(GRADES)) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(graded).alias("grade"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    sample = cut(found.dropDuplicates(["doc_id"]).withColumn("chars", F.char_length("text")), "sample")
    within, total = [], 0
    for r in sample.select("doc_id", "chars", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        total += r.chars
        if total > most_chars:
            break
        within.append((r.doc_id,))
    kept = sample.sparkSession.createDataFrame(within, sample.select("doc_id").schema)
    rows = sample.join(F.broadcast(kept), "doc_id").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return [r.text for r in rows], np.array([r.grade for r in rows], np.int64)


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_chars: int = MOST_CHARS, most_passages: int = MOST_PASSAGES, least_limit: float = LEAST_LIMIT) -> PassageModel:
    """A model of a bounded sample of the labelled documents: at most `most` of them with `most_chars` characters together.

    `most_passages` bounds the examples of grade 0 in a turn of learning, and `least_limit` is the lowest chance from which
    on a document comes out: with few labels the chance learned from held-out ones may be set by a single wrong label.
    """
    texts, grades = labelled_sample(documents, labels, most, most_chars)
    return PassageModel(most_passages, least_limit).fit(document_features(texts), grades)


def abuse_scores(documents: DataFrame, model: PassageModel, *keep: str) -> DataFrame:
    """The columns `keep`, `severity` (0 to 3), `chance` and `flagged` of every document; the rows stay where they are.

    Null and empty texts have severity 0. Repeated rows are scored alike.
    """
    spark = documents.sparkSession
    weights = model.model.w.astype(np.float32)
    used = np.flatnonzero(weights).astype(np.int32)
    sent = spark.sparkContext.broadcast((used, weights[used], model.model.cuts, model.limit))
    if {*keep} & {"text", "severity", "chance", "flagged"}:
        raise ValueError("text, severity, chance and flagged are names of the operator's own columns")
    schema = documents.select(*keep).schema
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schema)
    return documents.select(*keep, "text").mapInArrow(_scorer(sent, keep), f"{kinds}, severity double, chance double, flagged boolean")


def _scorer(sent, keep: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, cuts, limit = sent.value
        model = OrdinalModel(FEATURES, len(GRADES))
        model.cuts = cuts
        table = np.zeros(FEATURES)
        table[used] = weights
        lexicon = Lexicon()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            z = np.full(len(texts), -np.inf)
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                found = Batch(texts[at : at + TEXTS_AT_ONCE], lexicon)
                np.maximum.at(z, found.text + at, found.scores(table))
                if len(lexicon) > Lexicon.BOUND:
                    lexicon = Lexicon()
            some = np.isfinite(z)
            severity, chance = np.zeros(len(z)), np.zeros(len(z))
            severity[some], chance[some] = model.severity(z[some]), model.at_least_one(z[some])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(severity), pa.array(chance), pa.array(chance >= limit)], [*keep, "severity", "chance", "flagged"])

    return run


def rates(scored: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, severity) per source; documents without a source have a row of their own."""
    source = F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source")
    found = scored.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.avg("severity"), 6).alias("severity"))
    return found.withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))
