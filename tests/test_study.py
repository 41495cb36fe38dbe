"""Sources, guards, text scores, as-of rules and the price stream on small fixtures."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from eventloom import sources
from eventloom.operators import closest, guards
from eventloom.operators import similarity as S
from eventloom.operators.asof import asof_join
from eventloom.operators.vectors import nearest_vectors
from eventloom.streaming import latest_prices


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "01.0"), (2, None)], "id int, code string")
    df.write.parquet(f"{tmp_path}/a/b")
    df.write.parquet(f"{tmp_path}/a/c/d")
    (tmp_path / "a" / "._side.parquet").write_bytes(b"no parquet")
    assert sources.parquet_archive(spark, f"{tmp_path}/a", df.schema).count() == 4
    with pytest.raises(FileNotFoundError):
        sources.parquet_archive(spark, f"{tmp_path}/none")
    sources.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, sources.csv_table(spark, f"{tmp_path}/csv", df.schema).collect())) == [(1, "01.0"), (2, None)]
    sources.write_parquet(df, f"{tmp_path}/p", "id")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    assert sources.paired_topic_files(["b_pm_topics.csv", "a_pm_topics.csv", "a_k_topics.csv", "x_k_topics.csv"]) == [("a", "a_pm_topics.csv", "a_k_topics.csv")]


def test_guards(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", None), (2, "c", 0.7)], "k int, v string, p double")
    assert guards.require_unique(df, ["v"], "t").count() == 3 and guards.duplicates(df, ["k"]).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        guards.require_unique(df, ["k"], "t")
    with pytest.raises(ValueError, match="nothing"):
        guards.require_rows(df.limit(0), "nothing found")
    with pytest.raises(ValueError, match="1 rows without p; 1 rows that break"):
        guards.require_output(df, ["v"], ["p"], F.col("k") == 1)
    with pytest.raises(ValueError, match="no rows"):
        guards.require_output(df.limit(0), ["v"], ["p"])
    assert guards.require_output(df, ["v"], ["v"]).count() == 3


def test_text_scores(spark):
    df = spark.createDataFrame([("Will the Red Fox, win?", "the red fox"), ("abcd", "bcde"), (None, ""), ("x" * 30_000, "x")], "a string, b string")
    got = df.select(S.normalize_market_text(F.col("a")).alias("n"), S.key_nouns(F.col("a")).alias("k"), S.sequence_ratio("a", "b").alias("r")).collect()
    assert got[0].n == "the red fox, win" and got[0].k == ["red", "fox,", "win"] and got[1].r == 0.75 and got[2].r is None and got[2].n == ""
    assert [r[0] for r in df.limit(1).select(S.confidence_bucket(F.lit(0.9), 0.85, 0.7)).collect()] == ["HIGH_CONFIDENCE"]


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_asof_rules(spark, chunk):
    right = [("a", 1, 1, 10.0), ("a", 5, 1, 11.0), ("a", 5, 2, None), ("a", 5, 10, 12.0), ("a", 9, 1, 13.0), ("b", 30, 1, 1.0), (None, 1, 1, 2.0), ("a", None, 9, 3.0), ("c", 1, 3, 4.0), ("c", 2, 1, None)]
    left = [("a", 0, "x"), ("a", 1, "x"), ("a", 6, "x"), ("a", 800, "x"), ("b", 29, "x"), ("b", 31, "x"), ("d", 4, "x"), (None, 4, "x"), ("c", 40, "x")]
    l = spark.createDataFrame(left, "k string, t long, tie string")
    r = spark.createDataFrame(right, "k string, u long, tie_ long, price double")
    got = {(x.k, x.t): (x.source_u, x.price) for x in asof_join(l, r, "k", "t", "u", "tie_", ["price"], chunk).collect()}
    assert got == {("a", 0): (None, None), ("a", 1): (1, 10.0), ("a", 6): (5, 12.0), ("a", 800): (9, 13.0), ("b", 29): (None, None), ("b", 31): (30, 1.0), ("d", 4): (None, None), (None, 4): (None, None), ("c", 40): (2, None)}
    assert asof_join(l.limit(0), r, "k", "t", "u", "tie_", ["price"], chunk).count() == 0 and asof_join(l, r.limit(0), "k", "t", "u", "tie_", ["price"], chunk).count() == len(left)


def test_nearest_vectors_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(90, None), (91, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 9 = 0 OR vec_id > 80")
    rows = {r.vec_id: r.embedding for r in v.collect() if r.embedding and any(r.embedding)}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 9)
    want = {i: max((cos(rows[i], b), -j) for j, b in rows.items() if j != i)[1] * -1 for i in rows if i % 9 == 0}
    for n in (3, 4096):
        assert {r.vec_id: r.best_id for r in nearest_vectors(q, v, n).collect()} == want


def test_price_stream_equals_the_table(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    rows = [(k, base + dt.timedelta(hours=h), p) for k, h, p in (("a", 1, 5), ("a", 4, 6), ("a", 6, 7), ("b", 16, 8), ("a", 18, 9))] + [(None, base, 1), ("c", None, 2)]
    spark.createDataFrame(rows, "ticker string, ts timestamp, price int").write.parquet(f"{tmp_path}/in")
    table = latest_prices(spark.read.parquet(f"{tmp_path}/in"), F.col("ticker"), "ts", "price")
    stream = latest_prices(spark.readStream.schema("ticker string, ts timestamp, price int").parquet(f"{tmp_path}/in"), F.col("ticker"), "ts", "price")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = ({tuple(r) for r in df.collect()} for df in (spark.table("latest"), table))
    assert got == want and len(want) == 4


def test_frequent_terms_make_no_pairs_of_texts(spark):
    """Every text shares three frequent words with all others; only pairs that may reach a half are compared, and all that do."""
    rows = [("g", x, i * 2 + (x == "k"), f"will cut rates {f'name{i}' if i % 3 or x == 'p' else f'other{i}'} {f'town{i % 50}'}") for x in "pk" for i in range(300)]
    z = S.tfidf(spark.createDataFrame(rows, "slug string, side string, no long, t string"), "slug", ["side", "no"], F.col("t"))
    got = {(r.no_p, r.no_k) for r in S.cosine_pairs(z, "slug", ["no"], "side", 0.5).collect()}
    w: dict = {}
    for r in z.collect():
        w.setdefault((r.side, r.no), {})[r.term] = r.weight
    true = {(a, b) for (x, a), u in w.items() if x == "p" for (y, b), v in w.items() if y == "k" and sum(u[t] * v.get(t, 0.0) for t in u) >= 0.5}
    assert true and true <= got and len(got) < 300 * 300 / 20


def _closest_by_hand(text, nouns, partners):
    def score(t, n, ticker):
        a, b = set(nouns.split()), set(n.split())
        sequence, share = SequenceMatcher(None, text, t).ratio(), len(a & b) / len(a | b) if a and b else 0.0
        return 0.6 * sequence + 0.4 * share, (ticker is not None, ticker or ""), sequence, share

    combined, (_, ticker), sequence, share = max(score(*p) for p in partners)
    return ticker or None, sequence, share, combined


def _odd_texts(n, seed):
    r = random.Random(seed)
    words = ["rate", "rates", "bank", "fox,", "fox", "2025", "\U0001f642b", "of", "the", "\u00e9\u00e9", "m" * 30]
    texts = {"", "a", "x" * 70, "ab " * 70 + "c"} | {" ".join(r.choice(words) for _ in range(r.randint(1, r.choice([5, 12, 50])))) for _ in range(n)}
    return [(t, " ".join(dict.fromkeys(w for w in t.split(" ") if len(w) >= 3 and w != "the"))) for t in sorted(texts)]


def test_few_pairs_of_texts_are_scored(monkeypatch):
    """All texts share two nouns; the best partner of each is that of a search of all pairs, and only a few pairs get their ratio."""
    scored = []
    monkeypatch.setattr(closest, "SequenceMatcher", lambda *a: scored.append(1) or SequenceMatcher(*a))
    r = random.Random(3)
    name = lambda: "".join(r.choice("abdefiklmnorstu") for _ in range(8))
    names = [(name(), name()) for _ in range(300)]
    mine = [(t, t) for t in (f"central bank {a} {b} cuts rates" for a, b in names)]
    partners = [(t, t, f"k{i}") for i, t in enumerate(f"{a} central bank decision {b[:5]} rates" for a, b in names)]
    got = closest.Group(partners).best([t for t, _ in mine], [n for _, n in mine])
    assert len(scored) < 300 * 300 / 50
    assert all(got[i] == _closest_by_hand(*mine[i], partners) for i in range(0, 300, 10))


def test_closest_texts_in_blocks(spark):
    mine, theirs = _odd_texts(30, 1), _odd_texts(40, 2)
    texts = [(g, *x) for g in "ab" for x in mine] + [("lonely", "no partner", "partner")]
    partners = [(g, *x, [None, "t", f"t{i % 7}"][i % 3]) for g in "ab" for i, x in enumerate(theirs)]
    df = spark.createDataFrame(partners, "g string, text string, nouns string, k_ticker string")
    want = {(g, *x): _closest_by_hand(*x, [(t, n, k) for h, t, n, k in partners if h == g]) for g in "ab" for x in mine}
    for limits in ((7, 10**6), (1000, 300), (1000, 10**6)):
        got = closest.closest_texts(spark.createDataFrame(texts, "g string, text string, nouns string"), df, *limits)
        assert {(r.g, r.text): (r.k_ticker, r.sequence, r.nouns, r.combined) for r in got.collect()} == {k[:2]: v for k, v in want.items()}
    assert closest.closest_texts(spark.createDataFrame(texts, "g string, text string, nouns string"), df.limit(0)).count() == 0


def test_best_partner_needs_no_shared_noun(spark, tmp_path):
    """Alike wordings without a common noun meet; rows without a slug stand for their own pair only."""
    from eventloom.plans.registry import queries

    rows = [("s", "1", "alpha-one, beta-two", "A", "rain tomorrow"), ("s", "2", "snow today", "B", "alpha-one; beta-two;"), (None, "3", "gamma three", "C", "gamma four"), (None, "4", "delta", "D", "gamma three")]
    spark.createDataFrame([(*r, None, None) for r in rows], "slug string, pm_id string, pm_question string, k_ticker string, k_title string, k_yes_subtitle string, k_no_subtitle string").write.parquet(f"{tmp_path}/market_matches_embeddings.parquet")
    got = {r.pm_id: (r.slug, r.k_ticker, r.match_type) for r in queries()["best_text_matches"](spark, str(tmp_path)).collect()}
    assert got == {"1": ("s", "B", "HIGH_CONFIDENCE"), "3": (None, "C", "LOW_CONFIDENCE")}
