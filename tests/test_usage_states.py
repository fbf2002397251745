import datetime
import random

from engram.operators import usage
from engram.schemas import USAGE_EVENTS

START = datetime.datetime(2024, 3, 1)


def events(spark, days, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + datetime.timedelta(days=rng.choice(days), seconds=rng.randrange(86_400))
        ok = rng.random() < 0.9
        rows.append((f"{seed}-{i}", f"u{rng.randrange(300)}", "k", "r", rng.choice(["recall", "list"]), 2, rng.randrange(1000), ok, None if ok else "x", at))
    return spark.createDataFrame(rows, USAGE_EVENTS)


def test_ranges_of_days_from_states(spark, tmp_path):
    path = str(tmp_path / "states")
    first, second = events(spark, [0, 1, 2], 6_000, 1), events(spark, [3, 4], 4_000, 2)
    usage.write_states(first, path)
    usage.write_states(second, path)
    usage.write_states(second, path)  # days that come again
    states = spark.read.parquet(path)
    every = [r for r in first.union(second).collect()]
    for low, high in ((0, 5), (1, 4), (2, 3)):
        since, until = (START + datetime.timedelta(days=d) for d in (low, high))
        found = {r.tool_name: r for r in usage.usage_between(states, str(since.date()), str(until.date())).collect()}
        for tool in ("recall", "list"):
            mine = [r for r in every if r.tool_name == tool and since <= r.occurred_at < until]
            values = sorted(r.latency_ms for r in mine)
            got = found[tool]
            assert (got.calls, got.tokens, got.max_ms) == (len(mine), 2 * len(mine), values[-1])
            assert got.failures == sum(not r.success for r in mine)
            for p, value in ((0.5, got.p50_ms), (0.95, got.p95_ms)):
                below, upto = (sum(op(v) for v in values) / len(values) for op in (value.__gt__, value.__ge__))
                assert below - 0.01 <= p <= upto + 0.01
            assert abs(got.users - len({r.user_id for r in mine})) <= 0.05 * got.users
    assert usage.usage_between(states, "2030-01-01", "2031-01-01").count() == 0


def test_no_events(spark):
    assert usage.usage_states(spark.createDataFrame([], USAGE_EVENTS)).count() == 0
