"""Quality classifier by co-training of two views.

The text view sees what the characters and words of a text are; the metadata view sees language, source and layout.
Each round both logistic models score every unlabelled document, and each hands confident pseudo-labels to the other's training
set, from every language and source. After the rounds, each view is calibrated on labels that no round has seen, and their log odds are
added around the prior to score every document.

Features are taken once and stored. Fits use bounded draws (parameters below); scoring covers all documents with column expressions over one feature row.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import share_of, stored, with_features

SYMBOLS = re.compile(r"[*%$&#@^~=<>|\\{}\[\]_+]")
NOISY = re.compile(r"[*%$&#@^~=]{2,}|[!?]{2,}")
DIGIT = re.compile(r"\d")
LETTER = re.compile(r"[^\W\d_]")
LANGS, SOURCES = 16, 64  # hashed one-hot columns

TEXT_VIEW = ("symbols", "noisy_words", "upper_words", "digits", "letters", "distinct_words", "repeated_next", "pipes", "exclamations", "word_chars", "ended", "words_log", "pairs_distinct", "empty")
LAYOUT = ("lines_log", "line_chars_log", "short_lines", "chars_log", "blank_lines")


def text_view(text: str) -> list[float]:
    """Shares of odd characters and words, each between 0 and about 1."""
    words = text.split()
    if not words:
        return [0.0] * (len(TEXT_VIEW) - 1) + [1.0]
    n, chars = len(words), len(text)
    noisy = sum(1 for _ in NOISY.finditer(text))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    cap = lambda x, full: min(1.0, x / full)
    few = min(n, 2000)  # variety is a share of the expected one, so that long texts do not look repetitive
    return [cap(sum(1 for _ in SYMBOLS.finditer(text)) / chars, 0.1), cap(noisy / n, 0.2), cap(upper / n, 0.3), cap(sum(1 for _ in DIGIT.finditer(text)) / chars, 0.3),
            sum(1 for _ in LETTER.finditer(text)) / chars, cap(len(set(words)) / n ** 0.85 if n > few else len(set(words)) / n, 1.0), cap(again / n, 0.2), cap(text.count("|") / n, 0.2),
            cap(text.count("!") / n, 0.2), cap(chars / n, 20.0), cap(sum(w[-1] in ".!?" for w in words) / n, 0.3), cap(math.log1p(n), 10.0),
            cap(len(set(zip(words, words[1:]))) / max(1, n - 1), 1.0), 0.0]


def layout(text: str) -> list[float]:
    lines = text.split("\n")
    return [min(1.0, math.log1p(len(lines)) / 8), min(1.0, math.log1p(len(text) / len(lines)) / 10), sum(len(x) < 30 for x in lines) / len(lines),
            min(1.0, math.log1p(len(text)) / 14), sum(not x.strip() for x in lines) / len(lines)]


def viewed(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``row, lang, source, text_view, meta_view`` of every whole text; null texts count as empty, null language and source are values of their own."""
    def bucket(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("\0"))), F.lit(n)).cast("int")

    def compute(text: str, where: tuple[int, int]) -> tuple[list[float], list[float]]:
        placed = [0.0] * (LANGS + SOURCES)
        placed[where[0]] = placed[LANGS + where[1]] = 1.0
        return text_view(text), placed + layout(text)

    return with_features(docs, text_col, ("text_view", "meta_view"), compute, (bucket(lang_col, LANGS).alias("lang"), bucket(source_col, SOURCES).alias("source")))


def fit(rows: DataFrame, view: str) -> tuple[list[float], float]:
    """Weights and intercept of a logistic model; rows of one kind give its smoothed log odds alone."""
    kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    if len(kinds) < 2:
        return [], 0.0 if not kinds else math.log((kinds.get(1.0, 0) + 1) / (kinds.get(0.0, 0) + 1))
    model = LogisticRegression(labelCol="label", featuresCol="v", weightCol="weight", regParam=0.002, maxIter=60).fit(
        rows.select("label", "weight", array_to_vector(view).alias("v")))
    return [float(c) for c in model.coefficients], float(model.intercept)


def log_odds(view: str, model: tuple[list[float], float]) -> Column:
    weights, intercept = model
    if not weights:
        return F.lit(intercept)
    products = F.zip_with(F.col(view), F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return F.aggregate(products, F.lit(intercept), lambda a, x: a + x)


def probability(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def calibrated(held: DataFrame, z: Column) -> tuple[float, float]:
    """Slope and offset that fit the labels to the log odds; a view that says nothing gets slope 0 and the prior."""
    rows = held.select("label", F.array(z).alias("z"), F.lit(1.0).alias("weight"))
    weights, intercept = fit(rows, "z")
    return max(0.0, weights[0]) if weights else 0.0, intercept


def confident(pool: DataFrame, models: dict[str, tuple[list[float], float]], confidence: float) -> DataFrame:
    """``pool`` with ``view, label`` for each view that gives the document a label of at least ``confidence``."""
    says = [F.struct(F.lit(view).alias("view"), probability(log_odds(view, model)).alias("p")) for view, model in models.items()]
    sure = pool.withColumn("said", F.explode(F.array(*says))).filter(F.greatest("said.p", 1 - F.col("said.p")) >= confidence)
    return sure.withColumn("view", F.col("said.view")).withColumn("label", (F.col("said.p") >= 0.5).cast("double")).drop("said")


def drawn(sure: DataFrame, size: int, least: int, salt: str) -> DataFrame:
    """A draw of about ``size`` rows of each view in which every row has a chance, by a hash of the id and ``salt``.

    Groups of one view, language, source and label share ``size`` by the roots of their counts, so that a hot source leaves room for the
    others; a group has ``least`` rows on average, or all it has. The counts are at most 4 * LANGS * SOURCES numbers.
    """
    group = ["view", "lang", "source", "label"]
    counts = sure.groupBy(*group).count().collect()
    roots: dict[str, float] = {}
    for r in counts:
        roots[r["view"]] = roots.get(r["view"], 0.0) + math.sqrt(r["count"])
    rates = [(*(r[g] for g in group), min(1.0, max(least, size * math.sqrt(r["count"]) / roots[r["view"]]) / r["count"])) for r in counts]
    rates = sure.sparkSession.createDataFrame(rates, "view string, lang int, source int, label double, rate double")
    place = share_of(F.concat_ws(" ", F.col("doc_id").cast("string"), F.xxhash64("text_view", "meta_view").cast("string")), salt)
    return sure.join(F.broadcast(rates), group).filter(place < F.col("rate"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality",
           rounds: int = 3, max_labelled: int = 12_000, exchanged: int = 2_000, least: int = 20, confidence: float = 0.97, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (the input row as a struct, or its columns in ``keep``), ``text_score, meta_score, score`` of every document; ``score`` is the chance of quality 1.

    At most ``max_labelled`` labelled ids, chosen by a hash of the id, fit the views; a fifth of them are kept for calibration. Each round
    both views score every unlabelled document with an id, and each hands over a draw of about ``exchanged`` more of its pseudo-labels of at
    least ``confidence``: about ``least`` of every language, source and class, or all there are, and another draw each round. Ids labelled twice count as
    1 if any label does; null labels and ids do not count. Without labels, or with labels of one kind, every score is the smoothed share. Repeated rows are scored each.
    """
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
             .groupBy("doc_id").agg((F.max("label") > 0).cast("double").alias("label")))
    row = F.col("row") if keep is None else F.struct(*[F.col("row").getField(c).alias(c) for c in keep])
    seen = stored(viewed(docs, text_col, lang_col, source_col).select(row.alias("row"), F.col("row").getField(id_col).alias("doc_id"), "lang", "source", "text_view", "meta_view"), "quality-views")
    features = seen.drop("row").filter("doc_id is not null")
    ids = features.select("doc_id").distinct().withColumn("place", share_of(F.col("doc_id"), "quality"))
    chosen = stored(ids.join(known, "doc_id").orderBy("place", "doc_id").limit(max_labelled), "quality-chosen")
    columns = ["doc_id", "text_view", "meta_view", "label", "weight"]
    labelled = stored(features.join(F.broadcast(chosen), "doc_id").withColumn("weight", F.lit(1.0)).select(columns), "quality-labelled")
    pool = stored(features.join(known, "doc_id", "left_anti").distinct(), "quality-pool")
    is_held = share_of(F.col("doc_id"), "held") < 0.2
    start, held = labelled.filter(~is_held), labelled.filter(is_held)
    if held.select("label").distinct().count() < 2:  # too few labels to keep some back
        start = held = labelled
    views = ("text_view", "meta_view")
    extra, models = {}, {}
    for turn in range(rounds + 1):
        models = {view: fit(start.unionByName(extra[view]) if view in extra else start, view) for view in views}
        if turn == rounds or not any(weights for weights, _ in models.values()):  # views that learned nothing teach nothing
            break
        draw = drawn(confident(pool, models, confidence), exchanged * (turn + 1), least, f"turn {turn}").withColumn("weight", F.lit(0.5))
        draw = stored(draw.select("view", *columns), "quality-pseudo")
        extra = {view: draw.filter(F.col("view") != view).select(columns) for view in views}
    odds = {}
    for view, model in models.items():
        slope, offset = calibrated(held, log_odds(view, model))
        odds[view] = log_odds(view, model) * F.lit(slope) + F.lit(offset)
    counts = start.agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("one"), F.count("*").alias("n")).first()
    prior = math.log((counts["one"] + 1) / (counts["n"] - counts["one"] + 1))
    out = seen.select("row", odds["text_view"].alias("t"), odds["meta_view"].alias("m"))
    return out.select("row", probability(F.col("t")).alias("text_score"), probability(F.col("m")).alias("meta_score"), probability(F.col("t") + F.col("m") - F.lit(prior)).alias("score"))


def good_documents(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                   **options) -> DataFrame:
    """The documents with a score of at least ``keep_from``, with all their columns.

    Texts are not stored: rows are scored under a 128-bit key of what the views read, and those with a rejected key go. Rows equal in it have
    one score.
    """
    read = [docs[c] for c in (text_col, lang_col, source_col)]
    parts = [x for c in read for x in (c.isNull(), c)]
    key = F.struct(F.xxhash64(F.lit("one"), *parts).alias("one"), F.xxhash64(F.lit("two"), *parts).alias("two"))
    slim = docs.select(docs[id_col], *read, key.alias("__key"))
    found = scored(slim, labels, id_col, text_col, lang_col, source_col, keep=("__key",), **options)
    gone = stored(found.filter(~(F.col("score") >= keep_from)).select("row.__key.one", "row.__key.two").distinct(), "quality-rejected")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.getField("one").alias("one"), key.getField("two").alias("two"))
    return rows.join(gone, ["one", "two"], "left_anti").select("row.*")
