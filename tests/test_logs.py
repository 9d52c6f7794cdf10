from datetime import datetime, timezone

from hypothesis import given, settings
from hypothesis import strategies as st

from provelight.functions.logscan import entries, scan_time
from provelight.operators.logs import parse_logs

LINES = [
    ("2026-02-01T15:31:37.754Z ERROR [kernel.replay] boom", (1769959897754, "error", "kernel.replay", "boom")),
    ("2026-02-01T15:31:37.7549Z \x1b[33mWARN\x1b[0m [a-b] x", (1769959897754, "warning", "a-b", "x")),
    ("2026-02-05 12:25:35,178 - mount.proxy - DBG - a - b", (1770294335178, "debug", "mount.proxy", "a - b")),
    ('ts=2026-02-01T11:39:27.450+09:00 level=WARN component=net.fence msg="x \\"y\\" z"', (1769913567450, "warning", "net.fence", 'x "y" z')),
    ('ts=2026-02-01T11:39:27.450-05:30 attempt=3 component=c level=INF msg="m"', (1769965767450, "info", "c", "m")),
    ('{"time": 1770025075651, "level": "Critical", "logger": "q", "message": "m\\nn"}', (1770025075651, "fatal", "q", "m\nn")),
    ('{"logger":"q","message":"m","time":"2026-02-02T09:37:45.648Z","level":"info"}', (1770025065648, "info", "q", "m")),
    ("Feb  1 02:40:11 box06 timekeeperd[9104]: INF: error count", (1769913611000, "info", "timekeeperd", "error count")),
    ("02/Feb/2026:03:26:17 +0000 | fatal | mount.proxy | m | n", (1770002777000, "fatal", "mount.proxy", "m | n")),
    ("E0203 02:46:15.478879 65086 cgroup_watch.cc:37] miss", (1770086775478, "error", "cgroup_watch.cc", "miss")),
    ("[1770086776.874] (judge_queue) INFO: m", (1770086776874, "info", "judge_queue", "m")),
    ("Main.lean:6:44: warning: unused", (-1, "warning", "Main.lean", "unused")),
    ("C:\\work\\My Tree\\Main.lean:59:1: error(lean.kettle): rw", (-1, "error", "C:\\work\\My Tree\\Main.lean", "rw")),
]
OTHERS = [
    "    2026-02-01T15:31:44.232Z ERROR [grader.worker] quoted", "== sandbox image ready ==", "{", "}", '  "level": "info"', '{"level": "info"}',
    "h12 : inlet k ≤ 655", "⊢ False", "✔ [84/340] Built Yoke", "toolchain minor-8", "Traceback (innermost call last):", "", "level: info kept",
    "2026-02-01 no head here", "2026-13-45T99:99:99Z ERROR [x] no date", '{"level": "info", "logger": "x"', "[12] x: y", "a=b c=d",
]


def test_every_layout():
    for line, (ms, level, component, message) in LINES:
        assert entries(line, 2026) == [(1, ms, level, component, message)], line


def test_other_lines_continue_or_belong_to_none():
    for other in OTHERS:
        assert entries(other, 2026) == [], other
        got = entries(f"{other}\r\n{LINES[0][0]}\r\n{other}\r\n", 2026)
        assert len(got) == 1 and got[0][0] == 2 and got[0][4].startswith("boom"), other


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 17)), max_size=20), st.booleans())
def test_mixed_streams(picks, crlf):
    lines = [LINES[i % len(LINES)][0] if head else OTHERS[i % len(OTHERS)] for head, i in picks]
    got = entries(("\r\n" if crlf else "\n").join(lines), 2026)
    assert [e[0] for e in got] == [k + 1 for k, (head, _) in enumerate(picks) if head]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_survived(text):
    entries(text, 2026)
    scan_time(text)


def test_operator(spark):
    at = datetime(2026, 2, 1, tzinfo=timezone.utc)
    long = "\n".join([LINES[0][0]] + ["continued"] * 20000)
    data = [(1, at, LINES[7][0], None), (2, None, "", LINES[7][0]), (3, at, None, long), (1, at, LINES[7][0], None)]
    df = spark.createDataFrame(data, "run_id bigint, started_at timestamp, stdout string, stderr string").selectExpr("*", "'x' as level")
    got = sorted((r["run_id"], r["stream"], r["line_no"], r["ts_ms"]) for r in parse_logs(df, "run_id", ["stdout", "stderr"], "started_at").collect())
    assert got == [(1, "stdout", 1, 1769913611000)] * 2 + [(2, "stderr", 1, 2688011000 + 0)] + [(3, "stderr", 1, 1769959897754)]
    assert parse_logs(df.limit(0), "run_id", ["stdout"], "started_at").count() == 0
