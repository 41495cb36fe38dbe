"""Awkward rows through the core's data-preparation operators."""

import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import functions as F

from eventloom.operators.instants import PACIFIC, UTC, with_instant
from eventloom.operators.orphans import Bitmap, orphan_references
from eventloom.operators.wide import Registers, melt, to_wide
from tests.compare import ROOT

ATTR = "raw_id long, ticker string, attr_name string, attr_value string, recorded_at timestamp, cell string"


def wide_cells(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], ATTR)
    return {(r.ticker, r.column_name): r.cell_value for r in melt(to_wide(df, 2)).collect()}


def test_wide_cells(spark):
    t = lambda h: dt.datetime(2025, 7, 20, h)
    got = wide_cells(spark, [
        (1, "kxa", "Yes.2025.6.30.close.1700.PT", "$0.07", t(1)), (2, " KXA ", "yes_20250630_close_1700_PT", "n/a", t(5)),
        (3, "KXA", "yes-2025-07-03-open-0500-PT", "9 %", t(1)), (4, "KXA", "yes_2025_07_16_open_0500_PT", "0.5", t(1)),
        (5, "KXA", "openInterest", "1,234.00", t(1)), (6, "KXA", "Volume", "12.5", t(1)), (7, "KXA", "canCloseEarly", "Y", t(1)),
        (8, "KXA", "expiration date", "January 9, 2026", t(1)), (9, "KXA", "expiration_date", "2026-02-30", t(9)), (10, "KXA", "yes_sub_title", "  null hypothesis accepted ", t(1)),
        (11, "KXA", "STATUS", " Closed", t(2)), (12, "KXA", "status", "active", t(2)), (12, "KXA", "status", "active", t(2)),
        (13, None, "status", "x", t(1)), (14, "KXA", None, "x", t(1)), (15, "KXA", "result", None, t(1)), (16, "KXB", "result", "YES", None), (17, "KXC", "note", "x", t(1)),
        (18, "KXB", "last_price", "00000083", None), (19, "KXB", "yes_2025_07_04_close_1700_PT", "7e-2", None), (20, "KXB", "yes_2025_07_04_open_0500_PT", "1.01", t(1)),
    ])
    assert got == {
        ("KXA", "yes_2025_06_30_close_1700_PT"): "7", ("KXA", "yes_2025_07_03_open_0500_PT"): "9", ("KXA", "open_interest"): "1234", ("KXA", "can_close_early"): "true",
        ("KXA", "expiration_date"): "2026-01-09", ("KXA", "yes_sub_title"): "null hypothesis accepted", ("KXA", "status"): "active", ("KXB", "result"): "yes", ("KXB", "last_price"): "83",
        ("KXB", "yes_2025_07_04_close_1700_PT"): "7",
    }


def test_wide_of_nothing(spark):
    assert wide_cells(spark, []) == {}


def test_registers_merge_in_any_order():
    cells = [(0, 5, 1, "a"), (0, 5, 2, "b"), (1, 1, 1, "c"), (0, 4, 9, "d")]
    def fold(order):
        reg = {}
        for slot, *cell in order:
            Registers.put(reg, slot, tuple(cell))
        return reg
    whole = fold(cells)
    assert whole == fold(cells[::-1]) == Registers.merge(fold(cells[:2]), fold(cells[2:])) == Registers.merge(fold(cells[3:]), fold(cells[:3]))
    assert whole[0][2] == "b"


def us(y, m, d, h=0, mi=0, s=0, f=0, zone="UTC"):
    at = dt.datetime(y, m, d, h, mi, s, tzinfo=ZoneInfo(zone))
    return int(at.timestamp()) * 1_000_000 + f


TEXTS = [
    ("2025-03-11 00:00:00+00:00", UTC, us(2025, 3, 11)), ("2025-03-10T17:00", PACIFIC, us(2025, 3, 10, 17, zone=PACIFIC)), ("Tue, 22 Apr 2025 07:00:00 -0500", PACIFIC, us(2025, 4, 22, 12)),
    ("2025-09-20T17:00:00-07:00[America/Los_Angeles]", PACIFIC, us(2025, 9, 21)), ("2025-02-28 05:00:00 America/New_York", PACIFIC, us(2025, 2, 28, 10)), ("04/29/25 5:00 PM PDT", PACIFIC, us(2025, 4, 30)),
    ("5/10/2025 5:00 AM PT", PACIFIC, us(2025, 5, 10, 12)), ("Mar 3, 2025 8:00 AM EST", PACIFIC, us(2025, 3, 3, 13)), ("Sun Mar  9 03:30:00 PDT 2025", PACIFIC, us(2025, 3, 9, 10, 30)), ("20250309T103000Z", UTC, us(2025, 3, 9, 10, 30)),
    ("1741516200", UTC, 1741516200_000000), ("1741352400000 ", UTC, 1741352400_000000), ("1748873641622222", PACIFIC, 1748873641622222), ("1760267480.0", UTC, 1760267480_000000), ("1.756925674E9", UTC, 1756925674_000000), ("0x67664257", UTC, 0x67664257 * 1_000_000),
    ("2024-11-03T02:40:58.426396639Z", PACIFIC, us(2024, 11, 3, 2, 40, 58, 426396)), ("2025-02-02 16:02:46.581125", PACIFIC, us(2025, 2, 3, 0, 2, 46, 581125)), ("11/3/2024 12:01 AM PT", PACIFIC, us(2024, 11, 3, 7, 1)),
    ("2025-01-17 04:11:55 EST", UTC, us(2025, 1, 17, 9, 11, 55)), ("\t2025-09-17 05:00:00-07:00\n", PACIFIC, us(2025, 9, 17, 12)), ("2025-02-02", UTC, us(2025, 2, 2)),
    ("2044-05-01 05:00:00", UTC, us(2044, 5, 1, 5)), ("1985-05-01 05:00:00", UTC, us(1985, 5, 1, 5)), ("1985-05-01 05:00:00", PACIFIC, us(1985, 5, 1, 5, zone=PACIFIC)), ("2044-07-01 05:00 ET", UTC, us(2044, 7, 1, 5, zone="America/New_York")),
    ("2163-07-01 05:00:00", PACIFIC, us(2163, 7, 1, 5, zone=PACIFIC)), ("2400-02-29 05:00:00", PACIFIC, us(2400, 2, 29, 5, zone=PACIFIC)), ("1890-02-28 05:00:00", "Europe/Berlin", us(1890, 2, 28, 5) - 3208 * 10**6), ("1925-07-01 05:00:00", "Europe/London", us(1925, 7, 1, 4)),
]
BAD = [("2024-11-03 01:30:00", PACIFIC, "ambiguous"), ("2025-03-09 02:30 PT", PACIFIC, "nonexistent"), ("pending", UTC, "unreadable"), ("pending", PACIFIC, "unreadable"), ("0000-00-00 00:00:00", PACIFIC, "unreadable"), ("0000-00-00 00:00:00", UTC, "unreadable"), ("2025-02-30 00:00:00", UTC, "unreadable"), (" ", UTC, "blank"), (None, UTC, "blank"), ("2025-01-01 25:00:00", UTC, "unreadable"), ("x" * 50_000, UTC, "unreadable")]


def test_instants(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(TEXTS + BAD)], "i int, text string, instant_zone string")
    got = {r.i: r for r in with_instant(df, F.col("text"), F.col("instant_zone")).collect()}
    assert len(got) == len(TEXTS) + len(BAD)
    for i, (t, _, want) in enumerate(TEXTS):
        assert (got[i].instant_us, got[i].instant_state) == (want, "ok"), t
    for i, (t, _, want) in enumerate(BAD, len(TEXTS)):
        assert (got[i].instant_us, got[i].instant_state) == (None, want), t


def test_bitmaps_are_sets():
    rng = np.random.default_rng(1)
    for n in (0, 10, 30_000, 200_000):
        a, b = rng.integers(0, 300_000, n), rng.integers(0, 300_000, n // 2)
        A, B = Bitmap(a), Bitmap(b)
        assert A.decode().tolist() == sorted(set(a.tolist()))
        assert A.and_not(B).decode().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert (A & B).decode().tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert (A | B).decode().tolist() == sorted(set(a.tolist()) | set(b.tolist()))
        assert len(A) == len(set(a.tolist()))


def orphans(spark, refs, parents, **kw):
    r = spark.createDataFrame(refs, "space string, key string, ref_id long, us long, kind string")
    p = spark.createDataFrame(parents, "space string, key string, us long, deleted boolean, period string")
    return {(x.space, x.ref_id, x.kind) for x in orphan_references(r, p, **kw).collect()}


def test_orphans(spark):
    day = 86_400_000_000
    refs = [("c", "a", 1, 5 * day, "x"), ("c", "b", 2, 5 * day, "x"), ("c", "d", 3, 5 * day, "x"), ("c", "e", 4, 5 * day + 10, "x"), ("c", "e", 5, 5 * day + 30, "x"), ("c", None, 6, day, "x"), ("c", "b", 7, None, "x"), ("r", "b", 8, 9 * day, "x"), ("c", "a", 1, 5 * day, "x"), ("c", "d", 9, 8 * day, "x")]
    parents = [("c", "b", day, False, "y"), ("c", "b", 2 * day, True, "y"), ("c", "d", 7 * day, None, "y"), ("c", "e", 5 * day + 20, False, "y"), ("c", "e", 6 * day, False, "y"), ("c", None, day, False, "y")]
    want = {("c", 1, "missing"), ("c", 2, "deleted"), ("c", 7, "deleted"), ("c", 3, "late"), ("c", 4, "late"), ("r", 8, "missing")}
    assert orphans(spark, refs, parents) == want == orphans(spark, refs, parents, ranges=50, salts=3)
    assert orphans(spark, refs, []) == {(s, i, "missing") for s, k, i, _, _ in refs if k}
    assert orphans(spark, [], parents) == set()


def test_nearest_vector_of_any_label(spark, tmp_path):
    from eventloom.plans.reference import cosine_top1

    rows = [(0, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (3, [2.0, 0.1], "b"), (2, [2.0, 0.1], "b")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in cosine_top1(spark, str(tmp_path)).collect()] == [(0, 2)]


def test_review_candidates_are_whole(spark, tmp_path):
    from eventloom.plans.reference import _FIELDS, review_candidates

    row = lambda ex, i, key, subject: (ex, f"{ex}{i}", key, "sig", *["x" if c != "subject" else subject for c in _FIELDS])
    rows = [row("polymarket", i, "p", "a") for i in range(30)] + [row("kalshi", i, "k", "b") for i in range(30)]
    names = ["exchange", "market_id", "contract_key", "entity_signature", *_FIELDS]
    spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).write.parquet(f"{tmp_path}/contract_canonical_markets.parquet")
    got = review_candidates(spark, str(tmp_path)).collect()
    assert len(got) == 900 and {r.reason for r in got} == {"subject_mismatch:a!=b"}


def test_every_cutoff_has_a_column(spark):
    from eventloom.plans.reference import cutoff_calendar, snapshots_wide

    labels = {f"yes_{r.cutoff_label}" for r in cutoff_calendar(spark, "").collect()}
    assert len(labels) == 60 and set(snapshots_wide(spark, f"{ROOT}/sf0.001").columns) == {"user_id"} | labels
