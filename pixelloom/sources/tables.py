"""Images made of tables: pixels as rows, for tests and examples."""

from __future__ import annotations

from pixelloom.functions.sql import whole
from pixelloom.plans.rel import Rel, Tables


def pixels(rows: Rel, key: str, side: int, total: str, **channels: str) -> Rel:
    """Square images of `side` from rows with a dense integer key from 0, `total` of them; only complete images stay."""
    area = side * side
    # keys are dense from 0, so only the last image can be incomplete
    return rows.where(f"{key} < {area} * {whole(f'{total} / {area}e0')}").pick(
        image_id=whole(f"{key} / {area}e0"),
        width=f"cast({side} as bigint)",
        height=f"cast({side} as bigint)",
        y=whole(f"({key} % {area}) / {side}e0"),
        x=f"cast({key} % {side} as bigint)",
        **{c: f"cast({e} as double)" for c, e in channels.items()},
    )


def px_events(tables: Tables, side: int = 16) -> Rel:
    return pixels(tables("events", "event_id", "user_id", "value"), "event_id", side, tables.count("events"), r="(event_id * 37 % 256) / 255e0", g="(user_id * 11 % 256) / 255e0", b="least(value / 500e0, 1e0)", a="1e0")


def px_orders(tables: Tables, side: int = 16) -> Rel:
    rows = tables("orders", "o_orderkey", "o_custkey", "o_totalprice")
    return pixels(rows, "o_orderkey", side, tables.count("orders"), r="(o_custkey * 7 % 256) / 255e0", g="(o_orderkey * 13 % 256) / 255e0", b=f"({whole('o_totalprice')} % 256) / 255e0", a="((o_orderkey % 4) + 1) / 4e0")


def px_part(tables: Tables, side: int = 8) -> Rel:
    rows = tables("part", "p_partkey", "p_size", "p_retailprice")
    return pixels(rows, "p_partkey", side, tables.count("part"), r="p_size * 5 / 255e0", g="(p_partkey * 29 % 256) / 255e0", b=f"({whole('p_retailprice')} % 256) / 255e0", a="1e0")
