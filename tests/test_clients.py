"""Client ids, sessions and admission."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.operators import admission, clients

HEADERS = "remote_addr string, x_forwarded_for string, x_real_ip string, user_agent string, accept_language string, session_id string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ids(spark, *rows):
    return [r.client_id for r in clients.with_client_id(spark.createDataFrame(list(rows), HEADERS)).collect()]


def test_client_id_text(spark):
    got = ids(
        spark,
        ("1.2.3.4:99", None, None, None, None, None),
        ("1.2.3.4:99", " 9.9.9.9 , 8.8.8.8", "7.7.7.7", "  Mozilla/5.0 (X11)", "DE-de", "cookie"),
        ("1.2.3.4:99", "", "7.7.7.7", "", "", ""),
    )
    full = f"ip:9.9.9.9|ua:mozilla/5.0|lang:de|sess:{sha('cookie')[:8]}"
    assert got == [sha("ip:1.2.3.4:99")[:16], sha(full)[:16], sha("ip:7.7.7.7")[:16]]


def test_address_agent_and_cookie_each_tell_clients_apart(spark):
    base = ("1.1.1.1:1", None, None, "a", "en", "s")
    changed = [base, ("1.1.1.2:1", *base[1:]), (*base[:3], "b", *base[4:]), (*base[:5], "t"), base]
    got = ids(spark, *changed)
    assert len(set(got[:4])) == 4 and got[0] == got[4] and all(len(i) == 16 for i in got)


def requests(spark, rows):
    df = spark.createDataFrame(rows, "client_id string, us long, request_id long")
    return df.select("client_id", F.timestamp_micros("us").alias("ts"), "request_id")


def random_log(seed, n, clients_, spread):
    """A third and more of the log belongs to one client, with bursts and exact multiples of gaps."""
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(n):
        c = "hot" if rng.random() < 0.4 else f"c{rng.randrange(clients_)}"
        t = clock.get(c, 1_700_000_000_000_000 + rng.randrange(C.HOUR_US))
        t += rng.choice([0, 1, C.SECOND_US, 6 * C.SECOND_US, 30 * C.SECOND_US, 5 * C.MINUTE_US, 5 * C.MINUTE_US + 1, rng.randrange(spread)])
        clock[c] = t
        rows.append((c, t, i))
    return rows


def test_sessions_equal_the_walk(spark):
    rows = random_log(3, 800, 6, 20 * C.MINUTE_US)
    expected = set()
    for c in {r[0] for r in rows}:
        times = sorted(t for k, t, _ in rows if k == c)
        start = prev = times[0]
        n = 0
        for t in times:
            if t - prev > 5 * C.MINUTE_US:
                expected.add((c, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        expected.add((c, start, prev, n))
    got = clients.client_sessions(requests(spark, rows)).select(
        "client_id", F.unix_micros("session_start"), F.unix_micros("last_seen"), "requests").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_idle_clients_leave_no_open_session(spark):
    now = 1_700_000_000_000_000
    rows = [(f"c{i}", now - 10 * C.MINUTE_US, i) for i in range(3)]
    ended = clients.client_sessions(requests(spark, rows)).filter(F.unix_micros("session_end") > now)
    assert ended.count() == 0


@pytest.mark.parametrize("depth, verdict", [(0, "admit"), (31, "admit"), (32, "admit"), (33, "delay"), (39, "delay"), (40, "reject"), (50, "reject")])
def test_admission(spark, depth, verdict):
    sample = spark.createDataFrame([(depth, 50)], "depth long, capacity long")
    assert admission.queue_admission(sample).first().verdict == verdict
    assert admission.queue_admission(sample, backpressure=False).first().verdict == "admit"
