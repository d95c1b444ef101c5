"""Language identification by hierarchical discrimination: the family first, then the language within it.

A text is counted as hashed runs of one to four characters, lower-cased, with everything that is not a letter as one blank.
The counts of a text, scaled to length one, are its vector. Linear support vector machines decide: for each family one
against the rest, the largest margin wins; within the family one for each pair of languages, the most votes win, then
the largest sum of margins, then the name. All are fitted in numpy by coordinate descent on the dual problem, with the languages of
a side weighing the same. Weights are rounded to integers, so that sums of counts times weights are exact and a prediction depends on
the text alone, not on its neighbours in a batch.

Fitting uses at most ``SAMPLE`` rows in all, as many of each language, chosen by a hash of the doc_id; their whole texts are counted on
the executors and only vectors reach the driver, so at most SAMPLE times BUCKETS numbers. At most ``LANGUAGES`` languages are
learned, the most frequent ones. One in five of the sampled rows is set aside to fit the slopes that turn margins into the score.
Families of languages by code are fixed; a language of no listed family is a family of its own.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text where no language was learned; with one
language learned all others get that and score 1; texts are read whole, however long, some ``PIECE`` characters at a time; rows without an
id are predicted but not learned from, and are not held out; of several rows with one id the least (language, then text) may be learned from; repeated
rows are predicted each, alike; an empty table gives no rows. Columns of ``docs`` other than the text stay as they are; ``__lang`` and ``__score`` are this
operator's names, and columns that have them are dropped.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import cut, table

BUCKETS, LONGEST_GRAM = 1 << 14, 4
#: Rows to fit on, in all, and languages to learn.
SAMPLE, LANGUAGES = 2000, 100
#: Characters counted at a time.
PIECE = 1 << 18
#: Steps of a weight's size; sums of counts times weights stay below 2**53.
UNIT = 1 << 20
#: Cost of a violated margin, and passes over the rows.
COST, PASSES, SEED = 100.0, 60, 7

# Two-letter codes of the languages of a family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la lmo oc pt rm ro sc scn",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "iranian": "ckb fa ku ps tg",
    "semitic": "am ar arz he mt",
    "austronesian": "ceb id jv mg ms su tl",
    "dravidian": "kn ml ta te",
    "sinitic": "wuu yue zh",
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), "language " + lang)


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of others than letters as one 0, and a 0 at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = letters()[points]
    points = np.where(ok, points, 0)
    return np.concatenate([[0], points[ok | np.append(True, ok[:-1])] if len(points) else points, [0]]).astype(np.uint32)


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's runs occur in a text; None if it has no letter."""
    out = np.zeros(BUCKETS, np.int64)
    some = False
    whole = symbols(text) if text else np.zeros(0, np.uint32)
    for a in range(0, len(whole), PIECE):
        s = whole[a : a + PIECE + LONGEST_GRAM - 1].astype(np.uint64)
        starts = min(PIECE, len(s))
        some = some or bool(s.any())
        h = np.zeros(len(s), np.uint64)
        for n in range(1, LONGEST_GRAM + 1):
            if n > len(s):
                break
            h = (h[: len(s) - n + 1] * np.uint64(0x100000001B3) + s[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((h[:starts] >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return out if some else None


def machine(gram: np.ndarray, y: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The rows' factors in the weights of a linear support vector machine; y: 1 or -1; the groups of a side weigh the same."""
    rng = np.random.default_rng(SEED)
    most = np.zeros(len(y))
    for side in (1, -1):
        names = np.unique(groups[y == side])
        for g in names:
            most[(y == side) & (groups == g)] = COST / (len(names) * ((y == side) & (groups == g)).sum())
    most *= len(y) / 2
    alpha, margin = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(y)):
            step = min(max(alpha[i] - (y[i] * margin[i] - 1) / gram[i, i], 0), most[i]) - alpha[i]
            if step:
                alpha[i] += step
                margin += step * y[i] * gram[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return alpha * y


def slope(margins: np.ndarray, right: np.ndarray) -> float:
    """The factor of a margin that makes its logistic the likeliest; one more row of either kind than there are."""
    tries = np.geomspace(0.25, 16, 25)
    m, ok = np.append(margins, [1, 1]), np.append(right, [1, 0])
    return float(tries[np.argmin([np.logaddexp(0, np.where(ok == 1, -a, a) * m).sum() for a in tries])])


class Model:
    """``weights``: a row of integers for each machine; one, pairs: which row is whose. ``x``, the counts, is scaled in place."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.languages = sorted(set(langs))
        of = np.array([family_of(v) for v in langs])
        langs = np.array(langs, object)
        self.families = {f: sorted(v for v in self.languages if family_of(v) == f) for f in sorted(set(of.tolist()))}
        rows, self.one, self.pairs = [], {}, {}
        for row in x:  # in place: a copy would be as large again
            row /= max(np.sqrt(np.dot(row, row)), 1e-30)
        # of each language the first rows are fitted on, as it may have few; one in five is set aside
        number = np.array([np.count_nonzero(langs[:i] == v) for i, v in enumerate(langs)])
        fit, aside = np.flatnonzero(number % 5 != 4), np.flatnonzero(number % 5 == 4)
        of_fit, langs_fit = of[fit], langs[fit]
        gram = (x @ x.T)[np.ix_(fit, fit)].astype(np.float64) + 1

        def learned(part, side):
            factors = np.zeros(len(x), x.dtype)
            factors[fit[part]] = machine(gram[np.ix_(part, part)], np.where(side[part], 1, -1), langs_fit[part])
            rows.append(np.append(factors @ x, factors.sum()))

        if len(self.families) > 1:
            for f in self.families:
                self.one[f] = len(rows)
                learned(np.arange(len(fit)), of_fit == f)
        for f, names in self.families.items():
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    self.pairs.setdefault(f, []).append((a, b, len(rows)))
                    learned(np.flatnonzero((langs_fit == a) | (langs_fit == b)), langs_fit == a)
        self.weights = np.rint(np.array(rows, np.float64).reshape(len(rows), BUCKETS + 1) * UNIT)
        self.slopes = (1.0, 1.0)
        aside = [(self.decide(self.weights[:, :-1] @ x[i] / UNIT + self.weights[:, -1] / UNIT), langs[i]) for i in aside]
        self.slopes = tuple(slope(np.array([m[k] for (_, m), _ in aside]), np.array([float((family_of(v) == family_of(a)) if k == 0 else v == a) for (v, _), a in aside])) for k in (0, 1))

    def decide(self, margins: np.ndarray) -> tuple[str, tuple[float, float]]:
        """The language, and how far the family and the language in it are from the next."""
        names, first, second = sorted(self.families), np.inf, np.inf
        family = names[0]
        if self.one:
            values = [margins[self.one[f]] for f in names]
            order = np.argsort(np.negative(values), kind="stable")
            family, first = names[order[0]], float(values[order[0]] - values[order[1]])
        lang = self.families[family][0]
        if family in self.pairs:
            votes = dict.fromkeys(self.families[family], (0, 0.0))
            for a, b, row in self.pairs[family]:
                m = float(margins[row])
                votes[a] = (votes[a][0] + (m >= 0), votes[a][1] + m)
                votes[b] = (votes[b][0] + (m < 0), votes[b][1] - m)
            lang = min(votes, key=lambda v: (-votes[v][0], -votes[v][1], v))
            second = min(float(margins[row]) if a == lang else -float(margins[row]) for a, b, row in self.pairs[family] if lang in (a, b))
        return lang, tuple(min(max(m, -50.0), 50.0) for m in (first, second))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text, and how sure it is (0 to 1)."""
        if not self.languages or (c := counts(text)) is None:
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        at = np.flatnonzero(c)
        n = c[at].astype(np.float64)
        sums = self.weights[:, at] @ n  # integers below 2**53: exact in any order
        lang, margins = self.decide((sums / np.sqrt((n * n).sum()) + self.weights[:, -1]) / UNIT)
        return lang, float(np.prod([1 / (1 + np.exp(-a * m)) for a, m in zip(self.slopes, margins, strict=True)]))


def usable(docs: DataFrame) -> DataFrame:
    """doc_id, lang of the rows that may be learned from."""
    return docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1").select("doc_id", "lang")


def sampled(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, list[str]]:
    """Count vectors and languages of at most ``sample`` rows with letters, as many of each language."""
    import pyarrow as pa

    frequent = [r.lang for r in usable(docs).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    if not frequent:
        return np.zeros((0, BUCKETS), np.float32), []
    each = max(1, sample // len(frequent))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("language"), "doc_id"), "doc_id")
    ids = usable(docs).groupBy("doc_id").agg(F.min("lang").alias("lang")).where(F.col("lang").isin(*frequent))
    chosen = cut(ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("doc_id", "lang"))
    rows = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # at most ``sample`` ids

    def run(batches):
        for b in batches:
            found = [(i, v, c) for i, v, t in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if (c := counts(t)) is not None]
            at = [np.flatnonzero(c) for _, _, c in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in found], b.schema.field("doc_id").type), pa.array([v for _, v, _ in found], pa.string()), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int64).tobytes() for a, (_, _, c) in zip(at, found, strict=True)], pa.binary())],
                ["doc_id", "lang", "at", "n"],
            )

    got = rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])).collect()
    got.sort(key=lambda r: (r.doc_id * 7919 % 1000003 if isinstance(r.doc_id, int) else 0, str(r.doc_id)))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return x, [r.lang for r in got]


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return Model(*sampled(docs, sample))


def predicted(docs: DataFrame, model: Model, text: bool = True) -> DataFrame:
    """``docs`` with its columns, text only if asked for, and ``__lang``, ``__score``."""
    import pyarrow as pa

    docs = docs.drop("__lang", "__score")
    kept = [c for c in docs.columns if text or c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANGUAGES bound its machines, BUCKETS their size

    def run(batches):
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column("__text")]
            columns = [b.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v for v, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*kept, "__lang", "__score"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    return docs.select(*kept, F.col("text").alias("__text")).mapInArrow(run, schema)


def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predicted(docs.select("doc_id", "text"), fitted(docs), text=False)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
