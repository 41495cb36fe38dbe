"""The training-data operators against brute force, SQL and awkward rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import queries
from eventloom.llm.fmindex import FMIndex
from eventloom.llm.leaks import leaked_passages, removal_spans
from eventloom.llm.linkage import agreement, deadline, frames, link_markets, read_market, with_known_sub_titles
from eventloom.llm.mixing import mixture, rake
from eventloom.llm.nearest import LearnedIndex, nearest_in_time
from eventloom.llm.subjects import document_subjects
from eventloom.llm.words import close, words
from tests.compare import ROOT, differences

SF = f"{ROOT}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == ""


def test_learned_index_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        groups = [np.unique(rng.lognormal(20, 3, n).astype(np.int64)) for n in rng.integers(0, 3000, 6)]
        starts = np.r_[0, np.cumsum([len(g) for g in groups])]
        index = LearnedIndex(np.concatenate(groups), starts)
        g, q = rng.integers(0, 6, 500), rng.lognormal(20, 3, 500).astype(np.int64)
        assert index.lower_bound(g, q).tolist() == [int(starts[a] + np.searchsorted(groups[a], b)) for a, b in zip(g, q)]


def nearest(spark, left, right, **kw):
    base = dt.datetime(2025, 1, 1)
    at = lambda s: None if s is None else base + dt.timedelta(seconds=s)
    l = spark.createDataFrame([(i, k, at(s)) for i, k, s in left], "id long, entity string, ts timestamp")
    r = spark.createDataFrame([(i, k, at(s)) for i, k, s in right], "id long, entity string, ts timestamp")
    c = F.col
    got = nearest_in_time(l, r, left_entity=c("entity"), left_time=c("ts"), left_id=c("id"), right_entity=c("entity"), right_time=c("ts"), right_id=c("id"), **kw)
    return sorted(tuple(x) for x in got.collect())


def test_nearest_rules(spark):
    left = [(1, "a", 10_000), (1, "a", 10_000), (2, "a", 50_000), (3, "b", 0), (4, None, 5), (5, "a", None), (6, "a", 21_600)]
    right = [(9, "a", 8_200), (8, "a", 11_800), (7, "a", 8_200), (6, "b", -1_800), (5, "b", 1_801), (4, "a", None), (3, "a", 21_590), (2, "a", 21_611)]
    assert nearest(spark, left, right) == [(1, 7), (3, 6), (6, 3)]
    assert nearest(spark, left, []) == nearest(spark, [], right) == []


def test_nearest_in_small_chunks(spark):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(200_000)) for i in range(300)]
    right = [(i, rng.choice("aaaab"), rng.randrange(200_000)) for i in range(3000)]
    want = []
    for i, k, s in left:
        near = [(abs(t - s), t, j) for j, e, t in right if e == k and abs(t - s) <= 1800]
        want += [(i, min(near)[2])] if near else []
    assert nearest(spark, left, right, chunk_rows=50) == sorted(want) == nearest(spark, left, right)


def test_fm_index_finds_all():
    rng = np.random.default_rng(0)
    for _ in range(10):
        s = np.r_[rng.integers(1, rng.integers(2, 40), rng.integers(1, 700)), 0]
        f, p = FMIndex(s), rng.integers(1, 40, (40, 3))
        for a, b, q in zip(*f.search(p), p):
            assert sorted(f.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s) - 3) if (s[i : i + 3] == q).all()]


ITEM = "Only 7 of the 444 witnesses called by Zedor Damwenka had seen how the health ministry admitted the public alert; the remaining ones, all from Katanvelthorpe, repeated what Halzanlo Systems had printed on 21 March 2049."
OTHER = ITEM.replace("7", "3").replace("444", "291").replace("Zedor Damwenka", "Kelfi Bowoki").replace("Katanvelthorpe", "Woheneville").replace("Halzanlo Systems", "Delworen Labs").replace("21 March 2049", "16 May 2031")


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, text string")
    return leaked_passages(d, e, doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text"))


def test_leaks(spark):
    w = ITEM.split()
    soft = " ".join("<b>" + x[:1] + "­" + x[1:] + "</b>" if i % 3 == 0 else x for i, x in enumerate(w))
    docs = [(1, "x. " + ITEM + " y"), (2, OTHER), (3, " ".join(w[4:26])), (4, " ".join(w[4:16])), (5, soft.upper()), (6, None), (7, "  "), (8, "filler words here " * 40_000 + ITEM), (1, "x. " + ITEM + " y"), (9, " ".join(w[:8] + ["indeed"] + w[8:14] + w[15:30]))]
    got = leaks(spark, [(i, t, "clash") for i, t in docs], [(70, ITEM), (71, "too short an item"), (72, None), (70, ITEM)])
    assert sorted({(r.doc_id, r.item_id) for r in got.collect()}) == [(1, 70), (3, 70), (5, 70), (8, 70), (9, 70)]
    spans = {r.doc_id: (r.first_word, r.last_word) for r in removal_spans(got).collect()}
    assert spans[1] == (1, 1 + len(words(ITEM))) and spans[8][0] == 120_000
    assert leaks(spark, [], [(70, ITEM)]).count() == 0 == leaks(spark, [(1, ITEM, "")], []).count()


def test_leaks_in_item_blocks_equal_those_in_one(spark):
    w = ITEM.split()
    d = spark.createDataFrame([(1, "x. " + ITEM), (2, " ".join(w[4:26])), (3, OTHER), (4, None)], "doc_id long, text string")
    e = spark.createDataFrame([(70, ITEM), (71, OTHER), (72, "many other words " * 9)], "item_id long, text string")
    run = lambda n: sorted(tuple(r) for r in leaked_passages(d, e, doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text"), block_words=n).collect())
    assert run(30) == run(10_000) and {r[:2] for r in run(30)} == {(1, 70), (2, 70), (3, 71)}


def altered(rng, ws, every, how):
    """Words of a passage, every so manieth altered: two letters swapped, the word left out, or another word put in."""
    out = []
    for i, w in enumerate(ws):
        if i % every or (how == "swap" and (len(w) < 4 or w.isdigit())):
            out.append(w)
        elif how == "swap":
            k = next((k for k in range(len(w) - 1) if w[k] != w[k + 1]), 0)
            out.append(w[:k] + w[k + 1] + w[k] + w[k + 2 :])
        elif how == "insert":
            out += [w, rng.choice(["indeed", "so", "then"])]
    return out


@pytest.mark.parametrize("every,how", [(2, "swap"), (3, "swap"), (4, "swap"), (6, "drop"), (4, "insert")])
def test_recall_of_altered_passages(every, how):
    """Passages of 22 words of the held-out items, altered and set between words of other texts: nine in ten or more are found."""
    import pandas as pd

    from eventloom.llm.leaks import Items, search_shard

    rng = random.Random(5)
    rows = pd.read_parquet(f"{ROOT}/sf0.01/eval_items.parquet")[["item_id", "text"]].itertuples(index=False)
    items = Items([tuple(r) for r in rows])
    picked = [k for k in range(len(items.ids)) if len(items.words[k]) >= 30][:60]
    docs = []
    for k in picked:
        a = rng.randrange(len(items.words[k]) - 24)
        docs.append("some words before it".split() + altered(rng, items.words[k][a : a + 24], every, how) + "and after it".split())
    found = {(d, i) for d, i, *_ in search_shard(items, docs)}
    assert sum((d, k) in found for d, k in enumerate(picked)) >= 0.9 * len(picked)
    assert all(k == picked[d] for d, k in found)


def test_close_words():
    assert close("damwenka", "damwneka") and close("damwenka", "damwenk") and not close("damwenka", "zelwenka") and not close("444", "445") and not close("the", "she")


def test_deadlines_meet():
    same = ["by december 31, 2025", "in 2025", "before 2026", "before jan 1, 2026", "before jan 2026", "by the end of 2025", "this year (2025)", "by the end of december 2025"]
    assert {deadline(x) for x in same} == {"2026-01-01"}
    assert deadline("by feb 30, 2025") is None and deadline("some day") is None


def test_read_and_agree():
    a, b = read_market("Will Kelze Narnartan x Sofa Tanbelpel meeting by the end of November 2025?", None), read_market("Will Narnartan, Kelze meet Tanbelpel before Dec 1, 2025?", "Sofa Tanbelpel")
    assert a[0] == b[0] and agreement(a[1].split(), b[1].split()) == 1.0
    assert agreement(["kelze", "narnartan"], ["narnartan"]) < 1 and agreement(["kelze", "narnartan"], ["sofa", "narnartan"]) < 0.5
    assert read_market(None, None) is None and read_market(" ", "") is None and read_market("x" * 20_000, None) is None


def test_links(spark):
    now = dt.datetime(2025, 1, 1)
    p = [("1", "Davel Dokumar wins Golden Lantern in 2026?"), ("2", "Will D. Dokumar win the 2026 Golden Lantern?"), ("3", "Davel Dokumar wins Golden Lantern in 2027?"), ("4", None), (None, "x"), ("1", "Davel Dokumar wins Golden Lantern in 2026?")]
    k = [("A", "Golden Lantern winner (2026)?", "Davel Dokumar"), ("B", "Who will win Golden Lantern in 2026?", "Pelra Sonubat"), ("C", "", None)]
    P = spark.createDataFrame([(*x, now) for x in p], "id string, q string, at timestamp")
    K = spark.createDataFrame([(*x, now) for x in k], "id string, q string, sub string, at timestamp")
    l, r = frames(P, F.col("id"), F.col("q"), F.lit(None).cast("string"), F.col("at")), frames(K, F.col("id"), F.col("q"), F.col("sub"), F.col("at"))
    got = link_markets(l, r).collect()
    assert sorted((x.left_id, x.right_id) for x in got) == [("1", "A"), ("2", "A")]
    assert all(0.5 <= x.confidence <= 1 for x in got)
    assert link_markets(l.limit(0), r).count() == 0


def test_links_do_not_hang_on_the_number_of_markets(spark):
    now = dt.datetime(2025, 1, 1)
    rows = [("1", "Will Ann win the 2026 Golden Lantern?"), ("5", "Will Bo Karel be indicted in 2025?"), ("6", "Will Keldorrvanet release its rocket by May 31, 2026?")]
    rows += [(f"x{i}", f"Will {'abcdefghij'[i % 10]}{'klmnop'[i // 10]}vesta Moru win the 2026 Golden Lantern?") for i in range(60)]
    K = spark.createDataFrame([("A", "Golden Lantern 2026 winner?", "Ann", now), ("E", "Bo Karel indicted?", "Before 2026", now), ("F", "When will Keldrovanet release its rocket?", "Before Jun 1, 2026", now)], "id string, q string, sub string, at timestamp")
    P = spark.createDataFrame([(*x, now) for x in rows], "id string, q string, at timestamp")
    got = link_markets(frames(P, F.col("id"), F.col("q"), F.lit(None).cast("string"), F.col("at")), frames(K, F.col("id"), F.col("q"), F.col("sub"), F.col("at"))).collect()
    assert {(x.left_id, x.right_id) for x in got} == {("1", "A"), ("5", "E"), ("6", "F")}


def test_open_questions_match_nothing_unless_a_sub_title_is_known(spark):
    now = dt.datetime(2025, 1, 1)
    names = ["Davel Dokumar", "Pelra Sonubat", "Hefar Wojolin", "Zuka Terfolba"]
    P = spark.createDataFrame([(str(i), f"Will {n} win the 2026 Golden Lantern?", now) for i, n in enumerate(names)], "id string, q string, at timestamp")
    ask = "Who will win Golden Lantern in 2026?"
    rows = [("A", ask, None, "Davel Dokumar", now), ("B", "Golden Lantern winner (2026)?", "Pelra Sonubat", " ", now), ("B", ask, None, None, now + dt.timedelta(1)), ("C", ask, " ", None, now), ("D", ask, None, None, now)]
    K = spark.createDataFrame(rows, "id string, title string, yes_sub_title string, no_sub_title string, at timestamp")
    others = spark.createDataFrame([("C", None, "Hefar Wojolin"), ("B", "Zuka Terfolba", None), (None, "x", "x")], "id string, yes_sub_title string, no_sub_title string")
    right = frames(with_known_sub_titles(K, others), F.col("id"), F.col("title"), F.col("sub"), F.col("at"))
    got = link_markets(frames(P, F.col("id"), F.col("q"), F.lit(None).cast("string"), F.col("at")), right).collect()
    assert {(x.left_id, x.right_id) for x in got} == {("0", "A"), ("1", "B"), ("2", "C")}
    assert read_market(ask, None) is None and read_market("Golden Lantern winner (2026)?", " ") is None and read_market("Will Ann Boru be the winner of the 2026 Golden Lantern?", None)


def test_the_plan_does_not_grow_with_the_rounds(spark):
    from eventloom.llm.linkage import solve

    rows = [("f#ann boru", "f#ann boru", 0.9, 1, 0), ("f#ann borus", "f#ann boru", 0.8, 0, 0)]
    got = solve(spark.createDataFrame(rows, "l_class string, r_class string, sim double, key_says int, days_say int"), rounds=4)
    assert got._jdf.queryExecution().executedPlan().toString().count("Window") <= 2


def test_solution_is_the_least_loss(spark):
    """Two left classes of one right class, with a shared key, against a search of all values in steps."""
    from eventloom.llm.linkage import W_EXCLUSIVE, W_KEY, W_LIKE, W_NOT, W_OTHER_KEY, W_SIM, agreement, solve

    for sims, says in (((0.9, 0.6), (1, 0)), ((0.9, 0.9), (0, -1))):
        a, b = "f#ann boru", "f#ann borus"
        rows = [(a, "f#ann boru", sims[0], says[0], 0), (b, "f#ann boru", sims[1], says[1], 0)]
        got = {r.l_class: (r.confidence, r.residual) for r in solve(spark.createDataFrame(rows, "l_class string, r_class string, sim double, key_says int, days_say int"), rounds=30).collect()}
        near = sims[0] - sims[1] <= 0.15
        alone = (1.0, 1.0)
        shares = (0.5, 0.5) if near else (1.0, 1.0)
        like = agreement("ann borus".split(), "ann boru".split())
        x = np.arange(0, 1.0001, 0.005)
        X, Y = np.meshgrid(x, x, indexing="ij")
        loss = W_LIKE * np.maximum(0, like + X - 1 - Y) + W_EXCLUSIVE * np.maximum(0, shares[0] * X + shares[1] * Y - 1)
        for v, s, k, own in ((X, sims[0], says[0], alone[0]), (Y, sims[1], says[1], alone[1])):
            loss = loss + W_SIM * np.maximum(0, s - v) + W_NOT * np.maximum(0, v - s) + (W_KEY * np.maximum(0, 1 - v) if k == 1 else 0) + (W_OTHER_KEY * v if k == -1 else 0) + W_EXCLUSIVE * np.maximum(0, own * v - 1)
        i, j = (round(200 * got[c][0]) for c in (a, b))
        assert loss[i, j] <= loss.min() + 0.1 and max(r for _, r in got.values()) < 0.03, (sims, says, got)


def test_rake_keeps_caps_and_shares():
    cells = np.random.default_rng(0).integers(1, 100, (4, 2, 3)).astype(float)
    cells[3] = 0
    shares, caps = np.array([0.5, 0.3, 0.1, 0.1]), np.array([3, 2, 4, 9.0])
    w, total = rake(cells, shares, caps)
    got = (w * cells).sum((1, 2))
    assert (w <= caps[:, None, None] + 1e-9).all()
    assert np.allclose(got[:3] / got.sum(), shares[:3] / shares[:3].sum(), atol=1e-3) and got[3] == 0 and abs(got.sum() - total) < 1e-3 * total


def test_mixture(spark):
    rows = [(i, "word " * (10 + i % 7), " Big Press " if i % 2 else "forum", "en", "KXA") for i in range(400)] + [(900, None, "forum", "en", "KXA"), (901, " ", "forum", None, None), (902, "x", None, "en", ""), (1, "word " * 11, " Big Press ", "en", "KXA")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    t = spark.createDataFrame([("big_press", 0.7, 3), ("forum", 0.2, 1), ("none", 0.1, 2)], "source string, target_share double, max_repeats long")
    uses, report, margins = mixture(d, t, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"), lang=F.col("lang"), topic=F.col("topic"))
    got = {r.source: r for r in report.collect()}
    assert abs(got["big_press"].reached_share - 7 / 9) < 0.01 and got["none"].tokens_used == 0 and got["big_press"].most_copies <= 3 and got["forum"].most_copies <= 1
    assert uses.groupBy("doc_id").count().where("count > 1").count() == 0
    shares = {(r.margin, r.value): (r.aimed_share, r.reached_share) for r in margins.collect()}
    assert {k for k, _ in shares} == {"source", "lang", "topic"} and shares["lang", "en"] == (1.0, 1.0) and abs(shares["source", "forum"][1] - 2 / 9) < 0.01


def test_sources_reach_their_aims(spark):
    got = queries.QUERIES["p7_mix"](spark, f"{ROOT}/sf0.01").collect()
    whole = sum(r.target_share for r in got if r.tokens_used)
    for r in got:
        assert r.most_copies <= r.max_repeats and (not r.tokens_used or abs(r.reached_share - r.target_share / whole) < 0.02 * r.target_share), r


AREAS = [(n, None) for n in ("law", "sports", "climate", "science")] + [("general", "nothing else"), (None, "x")]


def subjects(spark, d, areas=AREAS, **kw):
    c = F.col
    return document_subjects(d, spark.createDataFrame(areas, "subject string, description string"), doc_id=c("doc_id"), text=c("text"), lang=c("lang"), source=c("source"), address=c("subject"), **kw)


def test_subjects(spark):
    law = "The magistrate enjoined the indictment after the deposition. "
    sport = "The goalkeeper benched the championship squad before the playoff. "
    stock = "The comment section is the real jury here. "
    rows = [(i, (law if i % 2 else sport) * 4 + stock, "en", "news", "KXA") for i in range(60)] + [(100, stock * 3, "en", None, None), (101, None, "en", None, None), (102, "  ", None, "news", "KXA"), (103, law * 4 + sport, "en", "news", "KXA"), (104, law * 6 + sport, "en", "news", "KXA")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    got: dict = {}
    for r in subjects(spark, d, stock_share=0.9).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert got[1] == {"law"} and got[2] == {"sports"} and 101 not in got and 102 not in got
    assert got[103] == {"law", "sports"} and got[104] == {"law"} and got[100] == {"general"}
    assert subjects(spark, d.limit(0)).count() == 0
    with pytest.MonkeyPatch.context() as m:  # more sources and addresses than are sent to every task
        m.setattr("eventloom.llm.subjects.MOST_KEYS", 0)
        other: dict = {}
        for r in subjects(spark, d, stock_share=0.9).collect():
            other.setdefault(r.doc_id, set()).add(r.subject)
    assert other == got


def test_copies_and_small_languages_are_not_stock(spark):
    law = "The magistrate enjoined the indictment after the deposition. "
    sport = "The goalkeeper benched the championship squad before the playoff. "
    fill = [(i, f"Note {'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10] * 3} arrived. " * 2, "en", "news", "KXB") for i in range(100)]
    copies = [(200 + i, law * 4, "en", "news", "KXA") for i in range(50)]
    small = [(300 + i, sport * (i + 1), None, "news", "KXC") for i in range(3)]
    more = [(310 + i, sport * 2 + f"Word {x} came late. ", "en", "news", "KXC") for i, x in enumerate(("uvw", "vwx", "wxy"))]
    d = spark.createDataFrame(fill + copies + small + more, "doc_id long, text string, lang string, source string, subject string")
    got: dict = {}
    for r in subjects(spark, d).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got[i] == {"law"} for i in range(200, 250))
    assert all(got[i] == {"sports"} for i in (300, 301, 302, 310, 311, 312))


def test_leaked_part_without_telling_words(spark):
    plain = "the ministry said that the public alert had been sent out before the storm came over the coast last night again"
    items = [(i, f"{a} {b} {c} {plain}") for i, (a, b, c) in enumerate([("Zedor", "Damwenka", "444"), ("Kelfi", "Bowoki", "291"), ("Halzan", "Delworen", "73")])]
    got = leaks(spark, [(1, "so " + plain + " indeed", ""), (2, "nothing of it", "")], items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 0), (1, 1), (1, 2)}


def test_frequent_and_short_names_meet(spark):
    many = [(f"x{i}", f"win|{1900 + i}||", f"name{'abcdefghij'[i % 10]} trump") for i in range(60)]
    L = spark.createDataFrame([*many, ("1", "exit|2026||", "d trump"), ("3", "exit|2026||", "trmup"), ("5", "exit|2027||", "li wu")], "id string, frame string, names string")
    R = spark.createDataFrame([*many, ("2", "exit|2026||", "donald trump"), ("4", "exit|2026||", "trump"), ("6", "exit|2027||", "l wu")], "id string, frame string, names string")
    got = {(x.left_id, x.right_id) for x in link_markets(L, R).collect() if x.left_id[0] != "x"}
    assert got == {("1", "2"), ("3", "4"), ("5", "6")}


def test_a_full_lexicon_needs_little_memory():
    """What the driver makes of a full table of two areas: under 24 bytes an entry, where an object per row alone takes more."""
    import tracemalloc

    import pyarrow as pa

    from eventloom.llm.subjects import WIDTH, Lexicon, _joined

    k, n = 3, WIDTH
    ratios = np.random.default_rng(0).integers(-100, 100, (n, k)).astype(np.int8)
    ends = np.arange(0, n * k + 1, k, dtype=np.int32)
    column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(ratios)])
    entries = np.random.default_rng(1).permutation(n).astype(np.int32)
    tracemalloc.start()
    lexicon = Lexicon(entries, _joined(pa.chunked_array([column[: n // 3], column[:0], column[n // 3 :]])), {}, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * n
    assert (lexicon.ratios[lexicon.at[entries[[0, 7, n - 1]]]] == ratios[[0, 7, n - 1]]).all()


def test_a_new_area_is_read_from_the_table(spark):
    rows = [(i, f"The {'violin orchestra' if i % 2 else 'magistrate deposition'} of number {'abcdef'[i % 6]} was praised. ", "en", "news", "KXA" if i % 2 else "KXB") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    got = {r.doc_id: r.subject for r in subjects(spark, d, [*AREAS, ("concerts", "violin and orchestra evenings")], stock_share=0.99).collect()}
    assert got[1] == "concerts" and got[2] == "law"


def test_subjects_agree_with_hand_labels(spark):
    """Hand labels are partly wrong and incomplete: nine in ten of a document's agreed labels are among its subjects."""
    sf = f"{ROOT}/sf0.01"
    got: dict = {}
    for r in queries.QUERIES["p8_found"](spark, sf).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    labels: dict = {}
    for r in spark.read.parquet(f"{sf}/doc_labels.parquet").where("doc_id IS NOT NULL AND subject IS NOT NULL").collect():
        labels.setdefault(r.doc_id, set()).add(r.subject.strip().lower())
    pairs = [(d, x) for d, xs in labels.items() for x in xs if d in got]
    assert len(pairs) > 50 and sum(x in got[d] for d, x in pairs) >= 0.8 * len(pairs)
