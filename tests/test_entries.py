"""Every reason of the entry gates, and the book against a plain walk over all candidates."""

import datetime as dt
import math
import random

import pytest

from tessera.operators import entries

SCHEMA = """id long, run string, score double, day date, short boolean, insider_usd double, eligible boolean, report date, last double, adv double, atr_pct double, unit double, holding double,
open_order boolean, can_short boolean, easy boolean, industry string, equity double, cash double, n_open int, open_risk double, held double"""
DAY = dt.date(2024, 1, 5)  # a Friday
GOOD = {
    "score": 0.7, "day": DAY, "short": False, "insider_usd": 0.0, "eligible": True, "report": None, "last": 50.0, "adv": 2e7, "atr_pct": 0.05, "unit": 1.0, "holding": 0.0, "open_order": False,
    "can_short": True, "easy": True, "industry": "tech", "equity": 100_000.0, "cash": 50_000.0, "n_open": 0, "open_risk": 0.0, "held": 0.0,
}
NAMES = ["id", "run", *GOOD]


def candidates(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA)


def admitted(spark, rows, rules=entries.Rules()):  # noqa: B008
    x = candidates(spark, rows).withColumn("down", -entries.F.col("score"))
    return {r["id"]: (r["reason"], r["shares"], round(r["dollars"], 6)) for r in entries.admit(x, "run", ["down", "id"], rules).collect()}


CASES = {
    "ok": {},
    "insider_selling": {"insider_usd": -1_000_001.0},
    "universe": {"eligible": None},
    "max_positions": {"n_open": 40},
    "earnings": {"report": dt.date(2024, 1, 10)},
    "no_bars": {"last": None, "adv": None, "atr_pct": None},
    "too_thin": {"adv": None},
    "new_listing": {"atr_pct": None},
    "too_calm": {"atr_pct": 0.029},
    "no_cash": {"cash": 49.0},
    "untracked_holding": {"holding": 1.0},
    "ticker_cap": {"equity": 3000.0, "unit": 0.01},
    "no_risk_room": {"open_risk": 10_000.0},
    "open_order": {"open_order": True},
    "price": {"last": 5000.0},
    "not_shortable": {"short": True, "easy": False},
    "sector_full": {"held": 29_000.0},
}


def test_each_reason_alone(spark):
    rows = [GOOD | {"id": i, "run": reason} | change for i, (reason, change) in enumerate(CASES.items())]
    got = admitted(spark, rows)
    assert {r["run"]: got[r["id"]][0] for r in rows} == {k: k for k in CASES}
    assert set(CASES) == {"ok", *entries.REASONS}


def test_the_first_failing_gate_names_the_reason(spark):
    # all gates from one on fail, as far as they can fail together
    order, rows = list(entries.REASONS), []
    for i in range(len(order)):
        row = GOOD | {"id": i, "run": str(i)}
        for reason in reversed(order[i:]):
            row |= CASES[reason]
        if i == 0:
            row["short"] = False  # else the first gate does not ask
        rows.append(row)
    got = admitted(spark, rows)
    for i, reason in enumerate(order):
        seen = got[i][0]
        assert order.index(seen) >= i, (reason, seen)
    for i in range(4):
        assert got[i][0] == order[i]


def test_shorts_are_not_vetoed_and_need_no_calm_market(spark):
    rows = [GOOD | {"id": 1, "run": "a", "short": True, "insider_usd": -9e9}, GOOD | {"id": 2, "run": "b", "short": True, "can_short": False}]
    assert {k: v[0] for k, v in admitted(spark, rows).items()} == {1: "ok", 2: "not_shortable"}


def plain(rows, r):
    """One candidate after another, all gates written out."""
    out, runs = {}, {}
    for x in rows:
        runs.setdefault(x["run"], []).append(x)
    for xs in runs.values():
        xs.sort(key=lambda x: (-x["score"], x["id"]))
        n, cash, risk, by, stopped = xs[0]["n_open"], xs[0]["cash"], xs[0]["open_risk"], {}, False
        for x in xs:
            reason, shares, cost = None, 0, 0.0
            tier = 0.08 if x["score"] > 0.6 else 0.05 if x["score"] > 0.45 else 0.02
            sized = min(max(x["equity"] * tier, 50), 20_000, x["cash"])
            notional = sized * x["unit"] if x["cash"] >= 50 and sized >= 50 else None
            blackout = False
            if x["report"] and x["report"] >= x["day"]:
                ahead = [x["day"] + dt.timedelta(k) for k in range(1, (x["report"] - x["day"]).days + 1)]
                blackout = sum(d.weekday() < 5 for d in ahead) <= 3
            if stopped:
                reason = "max_positions"
            elif not x["short"] and x["insider_usd"] < -1e6:
                reason = "insider_selling"
            elif not x["eligible"]:
                reason = "universe"
            elif n >= 40:
                reason, stopped = "max_positions", True
            elif blackout:
                reason = "earnings"
            elif x["last"] is None:
                reason = "no_bars"
            elif x["adv"] is None or x["adv"] < 1e7 or x["last"] < 5:
                reason = "too_thin"
            elif x["atr_pct"] is None:
                reason = "new_listing"
            elif x["atr_pct"] < 0.03:
                reason = "too_calm"
            elif notional is None:
                reason = "no_cash"
            elif x["holding"] > 0:
                reason = "untracked_holding"
            elif min(notional, x["equity"] * 0.08) < 50:
                reason = "ticker_cap"
            else:
                stop = min(max(3 * x["atr_pct"], 0.03), 0.15)
                want = min(min(x["equity"] * 0.005 * x["unit"], max(x["equity"] * 0.1 - risk, 0)) / stop, x["equity"] * 0.08, max(cash, 0))
                q = math.floor(want / x["last"])
                if want < 50:
                    reason = "no_risk_room"
                elif x["open_order"]:
                    reason = "open_order"
                elif q == 0:
                    reason = "price"
                elif x["short"] and not (x["can_short"] and x["easy"]):
                    reason = "not_shortable"
                elif x["industry"] is not None and x["held"] + by.get(x["industry"], 0) + q * x["last"] > x["equity"] * 0.3:
                    reason = "sector_full"
                else:
                    reason, shares, cost = "ok", q, q * x["last"]
                    n, cash, risk = n + 1, cash - want, risk + want * stop
                    by[x["industry"]] = by.get(x["industry"], 0) + cost
            out[x["id"]] = (reason, shares, round(cost, 6))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    books = {f"run{k}": {"equity": rng.choice([3e3, 3e4, 2e5]), "cash": rng.choice([40.0, 3e3, 1e5]), "n_open": rng.choice([0, 36, 40]), "open_risk": rng.choice([0.0, 2e3, 2e4])} for k in range(40)}
    rows = []
    for i in range(1500):
        run = rng.choice(list(books)) if i % 3 else "run0"  # a run with a third of all candidates
        x = GOOD | books[run] | {"id": i, "run": run, "score": rng.choice([0.3, 0.5, 0.7]), "last": rng.choice([50.0, 6.0, 900.0]), "industry": rng.choice(["tech", "oil", None]), "held": books[run]["equity"] * rng.choice([0, 0.2, 0.28])}
        if rng.random() < 0.3:
            x |= {k: v for k, v in CASES[rng.choice(list(CASES))].items() if k not in books[run]}
        rows.append(x)
    assert admitted(spark, rows) == plain(rows, entries.Rules())


def test_no_candidates(spark):
    assert admitted(spark, []) == {}


def test_bars_of_candidates_are_shuffled_once(spark):
    """Bars, and windows over them, lie where the lines were shuffled to by part."""
    from tessera.plans.views import bars

    plan = entries.bar_features(bars(spark, "/root/testdata/sf0.001", True), entries.Rules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
