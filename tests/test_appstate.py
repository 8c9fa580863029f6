from datetime import datetime

import pytest

from corpusmill.operators import appstate as A


def test_sessions_messages_and_settings(spark):
    t = [datetime(2024, 1, 1, h) for h in range(5)]
    s, other = A.new_session("One", at=t[0]), A.new_session(at=t[0])
    sessions = spark.createDataFrame([s, other, (s[0], "Renamed", t[0], t[1], "", "")], A.SESSIONS)
    messages = A.append(spark.createDataFrame([], A.MESSAGES), [A.new_message(s[0], "user", "q", [{"a": 1}], t[3]), A.new_message(other[0], "user", "x", at=t[2])])
    now = {r.id: (r.title, r.updated_at) for r in A.current_sessions(sessions, messages).collect()}
    assert now == {s[0]: ("Renamed", t[3]), other[0]: ("New Chat", t[2])}
    left = A.delete_session(sessions, messages, s[0])
    assert left[0].count() == 1 and left[1].count() == 1
    with pytest.raises(ValueError):
        A.new_message("s", "bot", "x")
    settings = spark.createDataFrame([("k", "1", t[0]), ("k", "[2]", t[1])], A.SETTINGS)
    assert A.setting(settings, "k") == [2] and A.setting(settings, "none", 7) == 7
    log = spark.createDataFrame([("c", "p", "started", 0, t[0], None), ("c", "p", "done", 3, t[1], None), ("d", "p", "started", 0, t[0], None)], A.INGESTS)
    assert A.ingests(log).count() == 2 and [r.collection for r in A.ingests(log, True).collect()] == ["d"]


class Stub:
    def __init__(self, reply):
        self.reply, self.seen = reply, None

    def chat(self, messages):
        self.seen = messages
        if isinstance(self.reply, Exception):
            raise self.reply
        return self.reply


def test_providers_and_answers():
    p = A.Providers({"a": Stub("1"), "b": Stub("2")})
    assert p.active.chat([]) == "1"
    p.activate("b")
    assert p.active.chat([]) == "2"
    with pytest.raises(ValueError):
        p.activate("c")
    stub = Stub("yes")
    assert A.answer(stub, [{"role": "user", "content": "q"}], lambda q: f"[{q}]") == "yes" and stub.seen[-1]["content"].endswith("[q]")
    assert A.sub_queries(None, "q", str.split) == ["q"] and A.sub_queries(Stub(ValueError()), "q", str.split) == ["q"]
    assert A.sub_queries(Stub("one"), "q", str.split) == ["q"] and A.sub_queries(Stub("one two"), "q", str.split) == ["one", "two"]


def test_config():
    c = A.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4})
    assert c == {"a": {"b": 3, "c": 2}, "d": 4} and A.setting_at(c, "a.b") == 3 and A.setting_at(c, "a.x.y", 0) == 0
