"""Book, splits, statistics and signals on hand-checkable inputs."""

import dataclasses
import itertools
import json
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators import signals as sig
from tidewright.operators.book import Account, Book, Commission, Financing, Frictions, Slippage, step_book
from tidewright.operators.leaks import cut_points, detect_look_ahead, signal_differences
from tidewright.operators.spans import PurgedSplitter, merge_spans, subtract_spans, walk_forward_folds
from tidewright.operators.runs import equity_of, fills_of, manifest, run_backtests, run_summaries
from tidewright.plans import cli, report
from tidewright.plans.strategies import live_rule, per_bar_momentum
from tidewright.sources import bars as src
from tidewright.streaming.paper import FeedError, Journal, PaperSession, Polling, run_session, tail_csv


def _run(account, closes, weights, **bar):
    book, marks, fills = Book(account.capital, {"S": 0.0}), [], []
    for t, c in enumerate(closes):
        before = closes[max(t - 1, 0)]
        o, h, low, v = bar.get(
            "open", before
        ), bar.get("high", max(before, c)), bar.get("low", min(before, c)), bar.get("volume", 1e6)
        w = weights[t] if t < len(weights) else None
        mark, f = step_book(book, account, t, {"S": (o, h, low, c, v)}, [] if w is None else [("S", w)])
        marks.append(mark)
        fills += f
    return book, marks, fills


def test_costs_land_in_the_next_mark_and_cash_balances():
    account = Account(Slippage("bps", 10), Commission("bps", bps=5), capital=1000.0)
    _, marks, fills = _run(account, [100, 110, 99], [1.0, None, 0.0])
    assert marks[0][3] == 1000
    t, s, units, price, ref, fee = fills[0]
    assert (t, units, ref) == (0, 10.0, 100) and price == pytest.approx(100.1) and fee == pytest.approx(1001 * 5e-4)
    assert marks[1][3] == pytest.approx(1000 - 1001 - fee + 1100)


def test_next_open_prices_the_open_and_the_last_order_never_fills():
    _, _, fills = _run(Account(fill_timing="next_open", capital=1000.0), [100, 110, 120], [1.0, None, 0.0], open=105)
    assert [(f[0], f[3]) for f in fills] == [(1, 105)]


def test_cap_carries_the_rest():
    account = Account(frictions=Frictions(max_participation=0.25), capital=1_000_000.0)
    _, _, fills = _run(account, [100] * 50, [1.0], volume=1000)
    assert [f[0] for f in fills] == list(range(40)) and all(f[2] == 250 for f in fills)


@pytest.mark.parametrize(("low", "n"), [(99.9, 0), (99.0, 1)])
def test_limit_needs_a_trade_through_and_expires(low, n):
    book, _, fills = _run(
        Account(frictions=Frictions(limit_offset_bps=10, limit_expiry_bars=1), capital=1000.0),
        [100, 100],
        [1.0],
        low=low,
    )
    assert len(fills) == n and (book.expired > 0) == (n == 0)
    assert not fills or fills[0][3] == pytest.approx(99.9)


def test_financing_compounds_on_cash():
    _, marks, _ = _run(
        Account(frictions=Frictions(financing=Financing(cash_rate=0.05)), capital=1000.0), [100] * 253, []
    )
    assert marks[-1][3] == pytest.approx(1000 * (1 + 0.05 / 252) ** 252)


def test_permanent_push_decays():
    account = Account(Slippage("permanent", 0, 0, 0.01, 1.0, 1.0), capital=1000.0)
    book, _, _ = _run(account, [100, 100], [1.0], volume=10)
    assert book.push["S"][0] == pytest.approx(0.01)


def test_band_and_wiped_out_account_do_not_trade():
    _, _, fills = _run(Account(capital=1000.0, band=0.05), [100, 101], [1.0, 0.97])
    assert len(fills) == 1
    assert not _run(Account(capital=1000.0), [0.0, 0.0], [1.0, 1.0])[2]


def test_account_round_trip():
    a = Account(
        Slippage("permanent"),
        Commission("share"),
        Frictions(0.1, 5.0, 2, Financing(0.01)),
        "next_open",
        5.0,
        0.1,
        False,
    )
    assert Account.from_dict(json.loads(json.dumps(a.to_dict()))) == a
    for bad in ({"fill_timing": "x"}, {"capital": 0}):
        with pytest.raises(ValueError):
            Account(**bad)


@pytest.mark.parametrize("seed", range(12))
def test_purged_splits_equal_sets_of_bars(seed):
    rng = random.Random(seed)
    n, start = rng.randint(2, 9), rng.randint(0, 80)
    s = PurgedSplitter(n, rng.randint(1, n - 1), rng.randint(0, 9), rng.randint(0, 6))
    end = start + rng.randint(60 * n, 90 * n)
    spans, splits = s.groups(end, start), s.splits(end, start)
    assert [t for a, b in spans for t in range(a, b)] == list(range(start, end))
    assert [x.held_out for x in splits] == list(itertools.combinations(range(n), s.n_test_groups))
    for x in splits:
        tested = {t for g in x.held_out for t in range(*spans[g])}
        near = {t + d for t in tested for d in range(-s.purge, s.purge + s.embargo + 1)}
        assert {t for span in x.tests for t in range(*span)} == tested
        assert {t for span in x.trains for t in range(*span)} == set(range(start, end)) - near
        assert all(b < c for (_, b), (c, _) in itertools.pairwise(x.trains))
    used = [pair for path in s.paths(splits) for pair in path]
    assert sorted(used) == sorted((g, x.index) for x in splits for g in x.held_out)
    assert all([g for g, _ in path] == list(range(n)) for path in s.paths(splits)) and len(s.paths(splits)) == s.n_paths


def test_folds_and_span_arithmetic():
    f = walk_forward_folds(300, 100, 50, warmup=10)[0]
    assert (f.train, f.seen, f.test) == ((0, 100), (90, 150), (100, 150))
    assert len(walk_forward_folds(1000, 200, 100)) == 8
    with pytest.raises(ValueError):
        walk_forward_folds(1000, 200, 100, step=50)
    assert merge_spans([(5, 7), (0, 2), (2, 3)]) == [(0, 3), (5, 7)]
    assert subtract_spans((0, 10), [(0, 3), (5, 7)]) == [(3, 5), (7, 10)]


def test_statistics(spark):
    c = spark.createDataFrame(
        [("a", i, float(x)) for i, x in enumerate([100, 120, 60, 110])] + [("z", i, 0.0) for i in range(3)],
        "series_id string, t int, equity double",
    )
    m = {r["series_id"]: r for r in stats.curve_metrics(c, ["series_id"]).collect()}
    assert m["a"]["max_drawdown"] == pytest.approx(-0.5) and m["a"]["total_return"] == pytest.approx(0.1)
    assert m["z"]["sharpe"] == 0 and m["z"]["max_drawdown"] == 0 and m["z"]["total_return"] == 0
    flat = spark.createDataFrame(
        [("a", i, 0.001) for i in range(100)] + [("b", 0, 0.1), ("b", 1, 0.2)], "series_id string, t int, r double"
    )
    assert {r["series_id"]: r["sharpe"] for r in stats.sharpe(flat, ["series_id"]).collect()}["a"] == 0
    assert all(r["psr"] == 0.5 for r in stats.probabilistic_sharpe(flat, ["series_id"]).collect())
    x = spark.createDataFrame([(v,) for v in (-6.0, -1.0, 0.0, 2.5)], "x double").select(
        "x", stats.normal_cdf("x").alias("c"), stats.normal_inverse("exp(-abs(x)) / 2 + 0.1").alias("i")
    )
    for r in x.collect():
        assert r["c"] == pytest.approx(NormalDist().cdf(r["x"]), abs=1e-14)
        assert r["i"] == pytest.approx(NormalDist().inv_cdf(math.exp(-abs(r["x"])) / 2 + 0.1), abs=1e-12)
    assert stats.expected_max_sharpe(1, 1.0) == 0


def _bars(spark, n=300, seed=3):
    return src.synthetic_bars(src.synthetic_paths(spark, [seed], src.SyntheticConfig(n_bars=n)))


def test_guard_and_leak_check(spark):
    b = _bars(spark, 250)
    of = b.withColumn("span_id", F.lit(0).cast("long"))
    with pytest.raises(sig.LookAheadError):
        sig.assert_no_look_ahead(sig.momentum_leaky(of, {"lookback": 5}))
    spec = sig.momentum_spec((5,), 40)
    assert detect_look_ahead(b, spec, 2).passed
    report_ = detect_look_ahead(b, spec, 2, look_ahead=True)
    assert not report_.passed and "changed" in report_.summary()
    assert cut_points(3, 95) == (1,)


def test_leak_check_sees_strengths_behind_limited_weights(spark):
    rows = [
        (span, 0, "A", 0, t, 1.0 if t < 3 else w, None if t == 0 else s) for span, s, w in ((0, 9.0, 1.0), (1, 5.0, 0.5)) for t in range(5)
    ]
    signals = spark.createDataFrame(
        rows, "span_id long, setting_id int, symbol string, seq int, t int, target_weight double, strength double"
    )
    assert [r["t"] for r in signal_differences(signals, (4,)).collect()] == [3]
    found = signal_differences(signals, (4,), strengths=True).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 1.0, 1.0, 9.0, 5.0)]
    assert not signal_differences(signals, (0,), strengths=True).count()

    # a rise so steep at first that the leaky weight is 1 in both futures
    steep = [100 * math.exp(min(t, 8) * 0.5 + 0.01 * math.sin(t)) for t in range(60)]
    b = spark.createDataFrame(
        [("A", "A", t, p, p, p, p, 1.0) for t, p in enumerate(steep)],
        "series_id string, symbol string, t int, open double, high double, low double, close double, volume double",
    )
    spec = sig.momentum_spec((5,), 40)
    assert detect_look_ahead(b, spec, 2, look_ahead=True).findings[0]["t"] > 4
    report_ = detect_look_ahead(b, spec, 2, look_ahead=True, strengths=True)
    assert report_.findings[0]["t"] == 4 and "strength" in report_.summary()
    assert detect_look_ahead(b, spec, 2, strengths=True).passed


def test_callback_strategy_equals_expression(spark):
    of = _bars(spark, 160).withColumn("span_id", F.lit(0).cast("long"))
    a = {r["t"]: r["target_weight"] for r in sig.momentum(of, {"lookback": 10}).collect()}
    call = sig.per_bar(lambda history, **p: per_bar_momentum(10)(history))
    b = {r["t"]: r["target_weight"] for r in call(of, {}).collect()}
    assert a.keys() == b.keys() and all(a[t] == pytest.approx(b[t], abs=1e-12) for t in a)


def test_price_file_rules(spark, tmp_path):
    def load(text, **o):
        p = tmp_path / "abc.csv"
        p.write_text(text)
        return [
            tuple(r) for r in src.load_bars(spark, str(p), **o).select(
                "symbol", "open", "close", "volume"
            ).orderBy("t").collect()
        ]

    good = "Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,100,102,99,101,50.5,1000\n2024-01-03,101,103,100,102,51,1100\n"
    assert load(good)[0] == ("ABC", 50.0, 50.5, 1000.0)
    assert load(good, use_adjusted=False)[0][2] == 101
    for bad in ("0", "-3", "nan", "abc", ""):
        with pytest.raises(src.BarFormatError):
            load(f"date,close,volume\n2024-01-02,1,1\n2024-01-03,{bad},1\n")
    for text in (
        "date,close,volume\n2024-01-03,1,1\n2024-01-02,1,1\n",
        "date,close\n2024-01-02,1\n2024-01-03,1\n",
        "close,volume\n1,1\n",
        "date,close,volume\n2024-01-02,1,1\n",
    ):
        with pytest.raises(src.BarFormatError):
            load(text)


def test_align_panel(spark):
    rows = [
        (
            s, s, 0, d, 1.0, 1.0, 1.0, 1.0, 1.0
        ) for s, days in (("A", "0123"), ("B", "0234")) for d in [f"2024-01-1{x}" for x in days]
    ]
    df = spark.createDataFrame(
        rows,
        "series_id string, symbol string, t int, time string, open double, high double, low double, close double, volume double",
    ).withColumn("time", F.col("time").cast("timestamp_ntz"))
    out = src.align_panel(df)
    assert sorted((r["symbol"], r["t"]) for r in out.collect()) == [
        (s, t) for s in "AB" for t in range(3)
    ] and src.same_calendar(out)


def test_live_session_resumes_and_refuses_rewrites(tmp_path):
    closes = [100 * 1.01 ** ((i * 7) % 11) for i in range(60)]
    feed = [(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", (c, c, c, c, 1e6)) for i, c in enumerate(closes)]

    def strategy(history):
        return 1.0 if history[-1][0] % 2 else 0.2

    account = Account(Slippage("bps", 3), Commission("share"), capital=10_000.0, fill_timing="next_close")
    whole = run_session(iter(feed), "S", account, strategy, history=[])
    j = Journal(str(tmp_path / "j.jsonl"))
    run_session(iter(feed[:30]), "S", account, strategy, journal=j)
    with pytest.raises(FileExistsError):
        run_session(iter(feed), "S", account, strategy, journal=j)
    rest = run_session(iter(feed[30:]), "S", account, strategy, history=feed[:30], journal=j, resume=True)
    assert [r["equity"] for r in rest] == pytest.approx([r["equity"] for r in whole[30:]])
    s = PaperSession(account, strategy, 10)
    s.step("S", *feed[0])
    assert s.step("S", *feed[0]) is None
    with pytest.raises(FeedError):
        s.step("S", feed[0][0], (1.0, 1.0, 1.0, 1.0, 1.0))
    polls = iter([feed[:2], feed[:3], feed[:3]])
    clock = iter(range(100))
    got = list(Polling(1.0, 2, lambda s: None, lambda: next(clock)).bars(lambda: next(polls, feed[:3])))
    assert got == feed[:3]


def test_reports_are_safe():
    row = {
        "name": "<b>",
        "sharpe": 1.0,
        "p_edge": 0.9999,
        "total_return": 0.1,
        "annual_return": 0.1,
        "max_drawdown": -0.2,
        "n_trades": 3,
        "chosen": '[{"lookback": 5}, {"lookback": 20}]',
        "honest": True,
    }
    assert "lookback=5/20" in report.render_table([row]) and report.probability(1e-9) == "<0.1%"
    page = report.render_html([row], equity=[1.0, 2.0])
    assert "<script" not in page and "&lt;b&gt;" in page
    assert json.loads(report.to_json({"x": float("nan")}))["x"] is None


@dataclasses.dataclass(frozen=True)
class Toll:
    """A cost model of one's own: a fixed amount a unit."""

    amount: float = 0.5

    def price(self, sign, quantity, reference, volume, push=0.0):
        return reference + sign * self.amount


def test_a_cost_model_of_ones_own():
    account = Account(Toll(0.25), capital=1000.0)
    assert Account.from_dict(json.loads(json.dumps(account.to_dict()))) == account
    _, _, fills = _run(account, [100, 100], [1.0])
    assert fills[0][3] == 100.25


def test_costs_over_columns_equal_the_book(spark):
    rows = [
        (
            s, q, 50.0, v, p
        ) for s in (1.0, -1.0) for q in (0.0, 3.0, 900.0, 5000.0) for v in (0.0, 1000.0) for p in (0.02, -0.01)
    ]
    df = spark.createDataFrame(rows, "s double, q double, px double, v double, push double")
    for slip in (Slippage(), Slippage("bps", 4), Slippage("impact"), Slippage("permanent")):
        got = [
            r[0] for r in df.select(
                slip.column(F.col("s"), F.col("q"), F.col("px"), F.col("v"), F.col("push"))
            ).collect()
        ]
        assert got == pytest.approx(
            [slip.price(s, q, px, v, p if slip.remembers else 0.0) for s, q, px, v, p in rows], rel=1e-12
        )
    for fee in (Commission(), Commission("share"), Commission("bps", bps=3)):
        got = [r[0] for r in df.select(fee.column(F.col("q"), F.col("px"))).collect()]
        assert got == pytest.approx([fee.fee(q, px) for _, q, px, _, _ in rows], rel=1e-12)


def test_a_run_summary_equals_the_metrics_of_its_book(spark):
    bars = _bars(spark, 400).withColumn("span_id", F.lit(0).cast("long"))
    signals = sig.momentum_spec((5, 20), 40).signals(bars)
    rows = [
        {
            "run_id": k,
            "span_id": 0,
            "setting_id": k,
            "warmup": w,
            "account": Account(Slippage("impact"), Commission("share")),
        } for k, w in ((0, 40), (1, 0))
    ]
    runs = manifest(spark, rows).withColumn("keep", F.col("run_id") == 0)
    book = run_backtests(runs, bars, signals)
    want = {
        r["run_id"]: r for r in stats.curve_metrics(stats.scored(equity_of(book), runs), ["run_id"]).join(
            stats.costs_by_run(fills_of(book)), "run_id"
        ).collect()
    }
    for r in run_summaries(runs, bars, signals).select("run_id", "returns", *stats.metrics_of_summary()).collect():
        for name in (
            "sharpe",
            "total_return",
            "annual_return",
            "annual_volatility",
            "max_drawdown",
            "mean_equity",
            "n_trades",
            "commission",
            "slippage",
            "notional",
            "n_returns",
        ):
            assert r[name] == pytest.approx(want[r["run_id"]][name], rel=1e-9), name
        assert (r["returns"] is not None) == (r["run_id"] == 0) and (
            r["returns"] is None or len(r["returns"]) == r["n_returns"]
        )


def test_guard_reads_what_a_strategy_adds(spark):
    bars = _bars(spark, 60).withColumn("span_id", F.lit(0).cast("long"))
    mean = bars.groupBy("span_id").agg(F.avg("close").alias("m"))
    assert sig.look_ahead_faults(
        bars.join(mean, "span_id"), bars
    ) and not sig.look_ahead_faults(sig.momentum(bars, {}), bars)
    by_bar = bars.groupBy("span_id", "t").agg(F.avg("close").alias("m"))
    assert not sig.look_ahead_faults(bars.join(by_bar, ["span_id", "t"]), bars)


def test_tail_rules(tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("Date,Close,Adj Close,Volume\n2024-01-02,10,5,100\n2024-01-03,12,6,\n")
    once = Polling(0.0, 0.0)
    with pytest.raises(FeedError):
        list(tail_csv(str(path), once))
    got = list(tail_csv(str(path), once, default_volume=7.0))
    assert got == [("2024-01-02", (5.0, 5.0, 5.0, 5.0, 100.0)), ("2024-01-03", (5.0, 6.0, 5.0, 6.0, 7.0))]
    assert [
        b[3] for _, b in tail_csv(str(path), once, use_adjusted=False, default_volume=7.0, after="2024-01-02")
    ] == [12.0]
    path.write_text("date,close,volume\n2024-01-02,nan,1\n")
    with pytest.raises(FeedError):
        list(tail_csv(str(path), once))


def test_config_files_tell_all_that_is_wrong(tmp_path):
    good = tmp_path / "a.json"
    good.write_text(
        json.dumps(
            {"file": "p.csv", "strategy": "rules.py:SPEC", "cpcv": [6, 2], "no-adjusted": True, "limit-expiry-bars": 3}
        )
    )
    a = cli.parse(cli.command("audit"), ["--config", str(good), "--capital", "5"])
    assert (a.file, a.strategy, a.cpcv, a.no_adjusted, a.capital, a.limit_expiry_bars) == (
        str(tmp_path / "p.csv"), str(tmp_path / "rules.py:SPEC"), (6, 2), True, 5.0, 3
    )
    good.write_text(json.dumps({"fill": "sometimes", "nonsense": 1, "markdown": 3, "capital": "much"}))
    with pytest.raises(cli.ConfigError) as e:
        cli.parse(cli.command("study"), ["--config", str(good)])
    assert all(x in str(e.value) for x in ("fill", "nonsense", "markdown", "capital"))
    with pytest.raises(cli.ConfigError):
        cli.load_config(str(tmp_path / "a.txt"))


def test_downloads_and_live_rules(spark):
    with pytest.raises(src.BarFormatError):
        src.fetched_bars(spark, "X", "2024-01-01", "2024-02-01", lambda *_: [])
    spec = sig.Spec("mine", sig.scripted((None, 0.5, 0.25)))
    rule = live_rule(spark, spec, {})
    history = [(k, 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(3)]
    assert [rule(history[: k + 1]) for k in range(3)] == [None, 0.5, 0.25]


def test_charts_are_whole_pages():
    rows = [
        {
            "name": f"r{k}",
            "sharpe": 1.0 - k,
            "p_edge": 0.5,
            "total_return": 0.1,
            "annual_return": 0.1,
            "max_drawdown": -0.1,
            "n_trades": 3,
            "chosen": "[{}]",
            "honest": k > 0,
            "commission": 2.0 * k,
            "slippage": 3.0 * k,
        } for k in range(3)
    ]
    page = report.render_html(rows, equity=[100.0, 120.0, 90.0], paths=[0.1, 0.4, 0.2], notes="<b>")
    assert page.count("<svg") == page.count("</svg>") == 6 and "&lt;b&gt;" in page and "nan" not in page
    assert json.loads(report.to_json(report.document("cpcv", paths=[float("nan")]))) == {
        "schema_version": 1, "kind": "cpcv", "paths": [None]
    }
