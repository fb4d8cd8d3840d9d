"""What fits in several threads share of a session."""

import time
from multiprocessing.pool import ThreadPool
from types import SimpleNamespace

from parityframe import session


def test_threads_ship_one_package(monkeypatch):
    files = []

    def slow_walk(top, walk=session.os.walk):
        time.sleep(0.1)
        return walk(top)
    monkeypatch.setattr(session.os, "walk", slow_walk)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(addPyFile=files.append))
    with ThreadPool(4) as pool:
        pool.map(lambda _: session.ship(spark), range(4), chunksize=1)
    assert len(files) == 1
