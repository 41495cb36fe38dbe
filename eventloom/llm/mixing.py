"""Sources mixed to target weights.

Token totals per source, language and topic form a small contingency table. Iterative proportional
fitting rakes it to the sources' target shares while the language and topic marginals keep the corpus's
own shares; a document is then used as often as its cell's weight says. The fraction of a copy is its
calibrated probability, drawn systematically: along a source's documents, ordered by size and cell, the
probabilities are summed up and every whole number passed takes the document there, so that a source
gets its tokens to within a few documents. No source's weight exceeds its cap.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import checkpoint_dir

VOCABULARY = os.environ.get("EVENTLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The byte-level tokenizer's public splitting pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_ENCODERS: dict = {}


def encoder(path: str = VOCABULARY):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(df: DataFrame, keep: list[str], text: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns with ``tokens``, the number of tokens of the whole text; null text has 0."""
    rows = df.select(*keep, text.alias("__text"))
    schema = rows.drop("__text").schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return rows.mapInArrow(run, schema)


def rake(cells: np.ndarray, shares: np.ndarray, caps: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """(weights, total): copies per document of each (source, language, topic) cell, and the tokens in all.

    The total is the largest at which every source that has documents reaches its share within its cap;
    shares of sources without documents are left out and the rest scaled up. A cell's weight never
    exceeds its source's cap: what raking to languages and topics would add beyond it goes to the
    source's other cells.
    """
    have = cells.sum((1, 2))
    usable = (have > 0) & (shares > 0) & (caps > 0)
    if not usable.any():
        return np.zeros_like(cells), 0.0
    want = np.where(usable, shares, 0.0)
    want = want / want.sum()
    total = float((caps[usable] * have[usable] / want[usable]).min())
    goal = want * total
    base = cells * usable[:, None, None]
    lang, topic = base.sum((0, 2)), base.sum((0, 1))
    lang, topic = lang / lang.sum() * total, topic / topic.sum() * total
    x = base.copy()
    top = base * caps[:, None, None]
    for _ in range(rounds):
        for axes, aim in (((0, 2), lang), ((0, 1), topic), ((1, 2), goal)):
            now = x.sum(axes)
            ratio = np.divide(aim, now, out=np.zeros_like(now), where=now > 0)
            shape = [1, 1, 1]
            shape[({0, 1, 2} - set(axes)).pop()] = -1
            x = np.minimum(x * ratio.reshape(shape), top)
    for _ in range(50):  # the sources' shares are the hard ones
        now = x.sum((1, 2))
        x = np.minimum(x * np.divide(goal, now, out=np.zeros_like(now), where=now > 0)[:, None, None], top)
    return np.divide(x, cells, out=np.zeros_like(x), where=cells > 0), total


#: Languages by the beginnings of their names and codes (fixed values); any other text is a language of its own name.
LANGUAGES = {"english": "en", "german": "de", "deutsch": "de", "spanish": "es", "espanol": "es", "español": "es", "castellano": "es", "french": "fr", "français": "fr", "francais": "fr"}
MOST_TOPICS, MOST_LANGUAGES, MOST_SOURCES = 1000, 50, 10_000
OTHER = "(other)"
SIZES_PER_OCTAVE, HASH_PARTS = 4, 16


def language_code(c: Column) -> Column:
    """The code before a region mark, or of a spelled-out name, in lower case; null gives an empty text."""
    first = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^[^\s_-]*", 0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[first], first)


def _largest(sized: DataFrame, column: str, most: int) -> list[str] | None:
    """The values with most tokens if there are more than ``most`` of them, else None."""
    got = [r[0] for r in sized.groupBy(column).agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), column).limit(most + 1).collect()]
    return got[:most] if len(got) > most else None


def _systematic(docs: DataFrame, fraction: Column, parts: int = HASH_PARTS) -> DataFrame:
    """Adds ``extra``, 1 for documents drawn with the given probability and 0 for the others, systematically per source.

    Order: size class, cell, hash part, size, id. Probabilities before a (cell, size class, hash part) come
    from counts of these groups, whose number follows the cells, not the documents; only inside a group are
    documents put in order, so a source of any size is spread over its groups.
    """
    group = ["source", "lang", "topic", "size", "part"]
    d = docs.withColumns({"f": fraction, "size": F.floor(F.log2(F.col("tokens") + 1) * SIZES_PER_OCTAVE).cast("int"), "part": F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")})
    n = d.groupBy(*group).agg(F.sum("f").alias("fs"))
    before = Window.partitionBy("source").orderBy("size", "lang", "topic", "part").rowsBetween(Window.unboundedPreceding, -1)
    start = n.withColumn("start", F.coalesce(F.sum("fs").over(before), F.lit(0.0))).drop("fs")
    inside = Window.partitionBy(*group).orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # a random start per source, the same in every run
    phase = F.pmod(F.xxhash64("source", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    upto = d.join(start, group).withColumn("upto", F.round(F.col("start") + phase + F.sum("f").over(inside), 6))
    return upto.withColumn("extra", (F.floor("upto") - F.floor(F.round(F.col("upto") - F.col("f"), 6))).cast("long")).drop("upto", "start", "size", "part")


def mixture(
    documents: DataFrame, targets: DataFrame, *, doc_id: Column, text: Column, source: Column, lang: Column, topic: Column, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uses, report, margins).

    uses: (doc_id, source, tokens, copies), copies at least 1 and at most the source's max_repeats.
    report: one row per target source, its share aimed at and reached, and how often it is used; a
    source without documents reaches 0. margins: aimed and reached share of all tokens per source,
    language and topic. Sources are matched apart from letter case, outer blanks and the mark between
    their words; documents of unnamed or unknown sources and those without text are not used; a document
    row that comes twice counts once. Targets without share or cap are passed over. Languages and topics
    beyond the MOST_LANGUAGES and MOST_TOPICS with most tokens are raked together as one; their documents
    are used like all others.

    Texts are tokenised once, and the token counts, not the texts, are shuffled and kept.
    """
    tidy = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    spark = documents.sparkSession
    checkpoint_dir(spark)
    goal = [tuple(r) for r in targets.select(tidy(F.col("source")), F.col("target_share").cast("double"), F.col("max_repeats").cast("double")).dropna().distinct().orderBy("source").limit(MOST_SOURCES + 1).collect()]
    if len(goal) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = [g[0] for g in goal]
    docs = documents.select(doc_id.cast("long").alias("doc_id"), tidy(source).alias("source"), language_code(lang).alias("lang"), F.coalesce(topic, F.lit("")).alias("topic"), text.alias("text"))
    docs = docs.where(F.col("source").isin(*names) & F.col("text").rlike(r"\S")) if names else docs.where(F.lit(False))
    sized = count_tokens(docs, ["doc_id", "source", "lang", "topic"], F.col("text"), vocabulary).dropDuplicates(["doc_id"]).checkpoint()
    for column, most in (("lang", MOST_LANGUAGES), ("topic", MOST_TOPICS)):
        if kept := _largest(sized, column, most):
            sized = sized.withColumn(column, F.when(F.col(column).isin(*kept), F.col(column)).otherwise(OTHER))
    # sources, languages and topics are bounded above, so the table is whatever the corpus
    cell = [tuple(r) for r in sized.groupBy("source", "lang", "topic").agg(F.sum("tokens")).collect()]
    langs, topics = ({x: i for i, x in enumerate(sorted({c[k] for c in cell}))} for k in (1, 2))
    at = {s: i for i, s in enumerate(names)}
    table = np.zeros((len(names), max(1, len(langs)), max(1, len(topics))))
    for s, g, t, n in cell:
        table[at[s], langs[g], topics[t]] = n
    caps = np.array([g[2] for g in goal])
    weights, _ = rake(table, np.array([g[1] for g in goal]), caps) if names else (table, 0.0)
    rows = [(s, g, t, float(weights[at[s], langs[g], topics[t]]), int(caps[at[s]])) for s, g, t, _ in cell]
    w = spark.createDataFrame(rows, "source string, lang string, topic string, weight double, cap long")
    weighted = sized.join(F.broadcast(w), ["source", "lang", "topic"])
    drawn = _systematic(weighted, F.col("weight") - F.floor("weight"))
    copies = F.least(F.col("cap"), F.floor("weight").cast("long") + F.col("extra"))
    used = drawn.select("doc_id", "source", "lang", "topic", "tokens", copies.alias("copies")).where("copies > 0")
    sums = [F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("documents_used"), F.sum("copies").alias("copies_used"), F.max("copies").alias("most_copies")]
    by_cell = used.groupBy("source", "lang", "topic").agg(*sums)
    total = F.sum("tokens_used").alias("tokens_used")
    got = by_cell.groupBy("source").agg(total, F.sum("documents_used").alias("documents_used"), F.sum("copies_used").alias("copies_used"), F.max("most_copies").alias("most_copies"))
    aims = spark.createDataFrame([(g[0], g[1], int(g[2])) for g in goal], "source string, target_share double, max_repeats long")
    report = aims.join(got, "source", "left")
    all_tokens = report.agg(F.sum("tokens_used").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.coalesce(F.col("tokens_used") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share")
    report = report.crossJoin(F.broadcast(all_tokens)).select("source", "target_share", "max_repeats", zero("documents_used"), zero("copies_used"), zero("tokens_used"), zero("most_copies"), share)
    wanted, whole = weights * table, max(1.0, float((weights * table).sum()))
    want = [(kind, x, float(wanted.sum(axes)[i]) / whole) for kind, places, axes in (("source", at, (1, 2)), ("lang", langs, (0, 2)), ("topic", topics, (0, 1))) for x, i in places.items()]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("margin"), F.col(k).alias("value")) for k in ("source", "lang", "topic")])).alias("m")
    reached = by_cell.select("tokens_used", each).groupBy("m.margin", "m.value").agg(total)
    margins = spark.createDataFrame(want, "margin string, value string, aimed_share double").join(reached, ["margin", "value"], "left").crossJoin(F.broadcast(all_tokens))
    return used.select("doc_id", "source", "tokens", "copies"), report, margins.select("margin", "value", "aimed_share", share)
