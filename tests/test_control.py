import subprocess
import sys
import threading
from pathlib import Path

import pytest

from notewright.plans.control import Busy, RunController
from notewright.sources import history


def store(n):
    def fetch(offset, limit):
        ids = [i for i in range(n, 0, -1) if not offset or i < offset][:limit]
        return [{"source_msg_id": i} for i in ids]

    return fetch


@pytest.mark.parametrize(("n", "after", "most", "page"), [(0, 0, 10, 3), (10, 0, 100, 3), (10, 4, 100, 3), (10, 0, 5, 3), (10, 9, 1, 1)])
def test_pages_end_where_they_should(n, after, most, page):
    got = [r["source_msg_id"] for r in history.pages(store(n), after, most, page)]
    assert got == [i for i in range(n, 0, -1) if i > after][:most]


def test_a_cursor_that_stalls_ends_the_scan():
    assert len(list(history.pages(lambda o, n: [{"source_msg_id": 5}], 0, 100, 1))) == 2


def test_waits_are_waited_for():
    slept, left = [], [2]

    def call():
        if left[0]:
            left[0] -= 1
            raise history.Wait(3)
        return "ok"

    assert history.patiently(call, sleep=slept.append) == "ok" and slept == [3, 3]
    left[0] = 99
    with pytest.raises(history.Wait):
        history.patiently(call, attempts=2, sleep=slept.append)


def test_one_run_at_a_time():
    gate, control = threading.Event(), RunController()
    control.trigger(lambda: gate.wait(10))
    with pytest.raises(Busy):
        control.trigger(lambda: None)
    gate.set()
    assert control.wait(10).state == "succeeded"
    control.trigger(lambda: 1 / 0)
    status = control.wait(10)
    assert status.state == "failed" and status.runs == 2 and status.failures == 1 and "ZeroDivisionError" in status.error


def test_the_entry_works_without_the_optional_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)


def test_history_is_a_data_source(spark, tmp_path, monkeypatch):
    (tmp_path / "fetcher_fixture.py").write_text("def fetch(chat, offset, limit):\n    return [{'source_chat': chat, 'source_msg_id': i, 'text': 't'} for i in range(7, 0, -1) if not offset or i < offset][:limit]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "fetcher_fixture.py"))
    spark.dataSource.register(history.HistorySource)
    got = spark.read.format("history").option("fetcher", "fetcher_fixture:fetch").option("chat", "c").option("after", "2").option("page", "2").load()
    assert sorted(r.source_msg_id for r in got.collect()) == [3, 4, 5, 6, 7]
