"""Order simulation on hand-made bars whose results are worked out by hand."""

from barframe.operators.strategy import Broker, Settings


def play(bars, orders, **settings):
    """bars: (time, o, h, l, c); orders: (time, command)."""
    broker = Broker(Settings(**({"initial_capital": 1000.0, "mintick": 0.1} | settings)))
    out = []
    for t, *prices in bars:
        given = [{"seq": i, "side": "long"} | c for i, (at, c) in enumerate(orders) if at == t]
        out += broker.bar(t, *map(float, prices), given)
    return broker, out


def fills(events):
    return [(e["time"], e["id"], e["qty"], e["price"], e["position_after"], e.get("reason")) for e in events if e["kind"] == "order"]


FLAT = [(1, 10, 10, 10, 10), (2, 11, 13, 8, 11), (3, 11, 12, 10, 12), (4, 12, 13, 11, 12)]


def test_market_round_trip_with_costs():
    b, ev = play([(1, 10, 10, 10, 10), (2, 12, 12, 12, 12)], [(1, {"type": "entry", "id": "L", "qty": 1.0}), (2, {"type": "close", "id": "L"})], slippage=2, commission_type="cash_per_order", commission_value=0.5)
    assert fills(ev) == [(1, "L", 1.0, 10.2, 1.0, None), (2, "L", 1.0, 11.8, 0.0, None)]
    trade = next(e for e in ev if e["kind"] == "trade")
    assert round(trade["profit"], 8) == 1.6 and trade["commission"] == 1.0 and round(trade["net_profit"], 8) == 0.6
    assert round(b.equity(12.0), 8) == 1000.6


def test_bracket_priority_on_one_bar():
    orders = [(1, {"type": "entry", "id": "L", "qty": 1.0}), (1, {"type": "exit", "id": "X", "stop": 9.0, "limit": 12.0}), (2, {"type": "exit", "id": "X", "stop": 9.0, "limit": 12.0})]
    for kind, want in (({}, ("stop", 9.0)), ({"same_bar": "limit_first"}, ("limit", 12.0)), ({"path": "open_high_low_close"}, ("limit", 12.0)), ({"path": "open_low_high_close"}, ("stop", 9.0))):
        _, ev = play(FLAT[:2], orders, **kind)
        assert fills(ev)[1] == (2, "X", 1.0, want[1], 0.0, want[0])


def test_resting_orders_gap_cancel_replace_and_stop_limit():
    _, ev = play(FLAT, [(1, {"type": "order", "id": "B", "qty": 1.0, "limit": 9.0}), (1, {"type": "order", "id": "C", "qty": 1.0, "limit": 1.0}), (3, {"type": "cancel", "id": "C"})])
    assert fills(ev) == [(2, "B", 1.0, 9.0, 1.0, "limit")]
    assert [(e["id"], e["status"]) for e in ev if e["kind"] == "lifecycle"] == [("B", "pending"), ("C", "pending"), ("B", "filled"), ("C", "canceled")]
    _, ev = play([(1, 10, 10, 10, 10), (2, 15, 16, 14, 15)], [(1, {"type": "order", "id": "S", "qty": 1.0, "stop": 12.0})])
    assert fills(ev) == [(2, "S", 1.0, 15.0, 1.0, "stop")]  # a gap fills at the open
    _, ev = play([(1, 10, 10, 10, 10), (2, 10, 13, 10, 13), (3, 13, 13, 11, 12)], [(1, {"type": "order", "id": "SL", "qty": 1.0, "stop": 12.0, "limit": 11.5})])
    assert fills(ev) == [(3, "SL", 1.0, 11.5, 1.0, "limit")]  # armed on bar 2, reached on bar 3


def test_reversal_pyramiding_position_cap_and_netting():
    _, ev = play(FLAT, [(1, {"type": "entry", "id": "L", "qty": 2.0}), (2, {"type": "entry", "id": "L2", "qty": 1.0}), (3, {"type": "entry", "id": "S", "qty": 1.0, "side": "short"})])
    assert fills(ev) == [(1, "L", 2.0, 10.0, 2.0, None), (3, "S", 1.0, 12.0, -1.0, None)]
    assert [e["reason"] for e in ev if e.get("status") == "rejected"] == ["pyramiding_exceeded"]
    _, ev = play(FLAT, [(1, {"type": "entry", "id": "L", "qty": 5.0})], max_position_size=3.0)
    assert fills(ev) == [(1, "L", 3.0, 10.0, 3.0, None)]
    _, ev = play(FLAT, [(1, {"type": "order", "id": "a", "qty": 3.0}), (2, {"type": "order", "id": "b", "qty": 1.0, "side": "short"})])
    assert [f[4] for f in fills(ev)] == [3.0, 2.0]


def test_oca_groups_margin_and_risk_locks():
    group = {"oca_name": "g", "oca_type": "cancel"}
    _, ev = play(FLAT, [(1, {"type": "order", "id": "A", "qty": 1.0, "limit": 9.0} | group), (1, {"type": "order", "id": "B", "qty": 1.0, "limit": 8.0} | group)])
    assert [f[1] for f in fills(ev)] == ["A"] and [(e["id"], e["canceled_by"]) for e in ev if e.get("status") == "canceled"] == [("B", "A")]
    group["oca_type"] = "reduce"
    b, ev = play(FLAT[:2], [(1, {"type": "order", "id": "A", "qty": 1.0, "limit": 9.0} | group), (1, {"type": "order", "id": "B", "qty": 3.0, "limit": 5.0} | group)])
    assert b.resting[0]["qty"] == 2.0
    _, ev = play(FLAT, [(1, {"type": "entry", "id": "L", "qty": 500.0})], margin_long=100.0)
    assert [e["reason"] for e in ev if e.get("status") == "rejected"] == ["margin"]
    b, ev = play(FLAT, [(1, {"type": "entry", "id": "L", "qty": 100.0}), (3, {"type": "entry", "id": "M", "qty": 1.0})], max_intraday_loss=10.0)
    assert fills(ev)[1] == (2, "risk.max_intraday_loss", 100.0, 8.0, 0.0, None) and b.locked
    assert [e["reason"] for e in ev if e.get("status") == "rejected"] == ["risk_locked"]
    _, ev = play(FLAT, [(t, {"type": "order", "id": str(t), "qty": 1.0}) for t in (1, 2, 3)], max_intraday_filled_orders=2)
    assert len(fills(ev)) == 2


def test_partial_exits_by_entry_and_percent():
    b, ev = play(FLAT, [(1, {"type": "entry", "id": "A", "qty": 2.0}), (2, {"type": "entry", "id": "B", "qty": 4.0}), (3, {"type": "close", "id": "B", "qty_percent": 50.0}), (4, {"type": "close_all"})], pyramiding=1)
    trades = [(e["entry_id"], e["qty"], e["entry_price"], e["price"]) for e in ev if e["kind"] == "trade"]
    assert trades == [("B", 2.0, 11.0, 12.0), ("A", 2.0, 10.0, 12.0), ("B", 2.0, 11.0, 12.0)]
    assert b.size == 0 and b.wins == 8.0
