"""Language identification: words first, then shorter and shorter character n-grams.

Each language has log frequencies of words.  A word that the training texts hold is scored
by them.  For an unseen word the character n-grams of order five are tried, then four,
three, two and one; the first order of which any n-gram is known gives the mean of its
known ones.  A text's score is the sum over its words.

The model is fitted on a documented, bounded sample: at most ``per_language`` different
texts of each language, those of least hash, copies once; and at most ``words`` pairs of language and word.
Each language gives its most frequent word, then each its second, and so on, so that none is left
out for being small.  The model, which is broadcast, thus has a bound that doesn't depend on the
corpus.  Every text is judged whole.

Defined cases: null texts and texts without letters are ``und`` with score 0.  Without any
training row every text is ``und``.  Ties go to the language that sorts first.  Very long texts
are counted block by block, and their runs of letters are judged whole.  Rows are
independent: repeats give repeats, a null doc_id is passed on, columns of other names are
ignored, and an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescan.llm.common import map_rows, whole_text

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Words that a worker remembers beyond the model.
REMEMBERED = 200_000
#: Longer words are judged, but not remembered.
LONGEST = 64
#: A text is cut into blocks of about so many characters, at spaces.
BLOCK = 1 << 18

#: What a word says: the number of its table (0 words, then by order), its weight there, and
#: what each language that knows it adds to that table's value for what a language doesn't know.
Evidence = tuple[int, float, list[tuple[int, float]]]


def counted(text: str) -> Counter:
    """Words in lower case; long texts block by block."""
    out: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            while end < len(text) and (text[end].isalpha() and text[end - 1].isalpha()):
                end += 1
        out.update(WORD.findall(text[at:end].lower()))
        at = end
    for w in [w for w in out if not w.isalpha()]:  # the pattern also takes numerals that aren't decimal digits
        n = out.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            out[part] += n
    return out


class Model:
    """Tables of words and n-grams; each entry holds only the languages that know it."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        """rows: language, word, count."""
        self.languages = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(self.languages)}
        counts: list[dict[str, dict[int, int]]] = [{} for _ in range(1 + len(ORDERS))]
        for lang, word, n in rows:
            k = at[lang]
            for table, found in zip(counts, ([word], *self.grams(word)), strict=True):
                for g in found:
                    own = table.setdefault(g, {})
                    own[k] = own.get(k, 0) + n
        #: By table: the value of a language for what it doesn't know.
        self.floors: list[list[float]] = []
        self.tables: list[dict[str, list[tuple[int, float]]]] = []
        for table in counts:
            totals = [0.5 * len(table)] * len(at)
            for own in table.values():
                for k, n in own.items():
                    totals[k] += n
            self.floors.append([math.log(0.5 / t) if t else 0.0 for t in totals])
            self.tables.append({g: [(k, math.log(2 * n + 1)) for k, n in own.items()] for g, own in table.items()})

    @staticmethod
    def grams(word: str):
        w = f"^{word}$"
        return ([w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word) for n in ORDERS)

    def unseen(self, word: str) -> Evidence:
        w = f"^{word}$"
        for number, n in enumerate(ORDERS, 1):
            text, known = w if n > 1 else word, self.tables[number]
            hits, sums = 0, {}
            for i in range(len(text) - n + 1):  # one by one: a word can be as long as a text
                if (own := known.get(text[i : i + n])) is not None:
                    hits += 1
                    for k, x in own:
                        sums[k] = sums.get(k, 0.0) + x
            if hits:
                return number, 1.0, [(k, x / hits) for k, x in sums.items()]
        return 0, 0.0, []


class Judge:
    def __init__(self, model: Model):
        self.model, self.memory = model, {}

    def evidence(self, word: str) -> Evidence:
        if (own := self.model.tables[0].get(word)) is not None:
            return 0, 1.0, own
        if (v := self.memory.get(word)) is None:
            v = self.model.unseen(word)
            if len(word) <= LONGEST:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = v
        return v

    def __call__(self, text: str | None) -> tuple[str, float]:
        words, languages = counted(text or ""), self.model.languages
        if not words or not languages:
            return UNKNOWN, 0.0
        totals, weights, n = [0.0] * len(languages), [0.0] * len(self.model.floors), 0
        for w, c in words.items():
            n += c
            number, weight, own = self.evidence(w)
            weights[number] += c * weight
            for k, x in own:
                totals[k] += c * x
        for weight, floor in zip(weights, self.model.floors, strict=True):
            if weight:
                totals = [t + weight * f for t, f in zip(totals, floor, strict=True)]
        best = max(range(len(totals)), key=lambda k: (totals[k], -k))
        # Words of a text depend on each other: evidence grows with the root of their number.
        return languages[best], 1 / sum(math.exp((x - totals[best]) / math.sqrt(n)) for x in totals)


def fit(docs: DataFrame, per_language: int = 2000, words: int = 200_000) -> list[tuple[str, str, int]]:
    """Counts of the sample's words: language, word, count."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Copies count once.  Only languages of more texts than the bound are listed.
    large = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().where(F.col("count") > per_language).collect()}
    order = F.pmod("h", F.lit(1 << 30))
    if large:
        # Of each of these a share by hash, a little above the bound, so that no task ranks all texts of a language.
        share = F.coalesce(F.create_map(*(F.lit(x) for lang, n in large.items() for x in (lang, 1.2 * (per_language + 20) / n)))[F.col("lang")], F.lit(1.0))
        rows = rows.where(order < share * (1 << 30))
    sample = rows.groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "h"))
    sample = sample.withColumn("rank", rank).where(F.col("rank") <= per_language)
    fields = [("lang", "string", pa.string()), ("counts", "map<string,int>", pa.map_(pa.string(), pa.int32()))]
    table = map_rows(sample, ["lang", "text"], lambda: lambda lang, text: (lang, list(counted(text).items())), fields)
    table = table.select("lang", F.explode("counts").alias("word", "n")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return [tuple(r) for r in table.withColumn("place", place).orderBy("place", "lang").limit(words).select("lang", "word", "n").collect()]


def predict(docs: DataFrame, counts: list[tuple[str, str, int]]) -> DataFrame:
    """doc_id, lang_pred, score: a row for each row.  Reads doc_id only to pass it on."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def make():
        judge = Judge(_model(sent))
        return lambda doc_id, text: (doc_id, *judge(text))

    fields = [("doc_id", "long", pa.int64()), ("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), ["doc_id", "text"], make, fields)


_made: list = [None, None]


def _model(sent) -> Model:
    """One per worker process."""
    if _made[0] is not sent.value:
        _made[:] = sent.value, Model(sent.value)
    return _made[1]
