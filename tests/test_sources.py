"""Readers over tiny hand-written stores."""

import gzip
import json
import sqlite3

import pytest

from tracelode import catalog_sources
from tracelode.sources import common, registry, sinks


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def claude_store(tmp_path):
    put(tmp_path / "claude" / "s1.jsonl", [
        {"type": "user", "sessionId": "s1", "cwd": "/home/me/work/atlas", "timestamp": "2024-01-02T03:04:05Z", "userType": "external", "message": {"role": "user", "content": "fix the cache"}},
        {"type": "assistant", "sessionId": "s1", "timestamp": "2024-01-02T03:04:06Z", "message": {"model": "m-1", "content": [{"type": "text", "text": "looking"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "sessionId": "s1", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "a.py", "is_error": False}]}},
        {"type": "assistant", "sessionId": "s1", "message": {"model": "<synthetic>", "content": [{"type": "text", "text": "done"}]}},
        {"type": "user", "sessionId": "s1", "isMeta": True, "message": {"content": "hidden"}},
        {"type": "user", "sessionId": "s1", "message": {"content": "<command-name>x</command-name>"}},
        {"type": "user", "sessionId": "s1", "isCompactSummary": True, "message": {"content": "summary so far"}},
        "{broken",
    ])
    put(tmp_path / "claude" / "agent-7.jsonl", [{"type": "user", "sessionId": "s1", "message": {"content": "side task"}}])
    return str(tmp_path / "claude")


def test_claude(spark, claude_store):
    messages, events, intake = registry.READERS["claude"](spark, claude_store)
    assert rows(messages, "session", "turn", "text", "who", "reply", "model", "side") == [
        ("agent-7", 0, "side task", "user", "", "", True), ("s1", 0, "fix the cache", "user", "looking\n\ndone", "m-1", False), ("s1", 1, "summary so far", "recap", "", "", False)]
    assert {r.project for r in messages.filter("session = 's1'").collect()} == {"atlas"}
    assert rows(messages.filter("turn = 0 and session = 's1'"), "ts") == [(1704164645000,)]
    assert rows(events, "session", "name", "input", "output", "ok", "call_id") == [("s1", "Bash", "ls", "a.py", True, "t1")]
    assert rows(intake.groupBy("outcome").count(), "outcome", "count") == [("agent_row", 2), ("error", 1), ("event", 1), ("row", 3), ("skip", 2)]


def test_codex(spark, tmp_path):
    put(tmp_path / "r.jsonl", [
        {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "c1", "cwd": "/w/app"}},
        {"type": "turn_context", "payload": {"model": "gx", "cwd": "/w/app"}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "add a test"}},
        {"type": "response_item", "timestamp": "2024-01-01T00:00:01Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "add a test"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "injected context"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": ["bash", "-lc", "make"]}), "call_id": "k"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": json.dumps({"output": "bad", "metadata": {"exit_code": 2}})}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "added"}]}},
    ])
    messages, events, _ = registry.READERS["codex"](spark, str(tmp_path))
    assert rows(messages, "session", "turn", "text", "reply", "model", "project") == [("c1", 0, "add a test", "added", "gx", "w/app")]
    assert rows(events, "name", "input", "output", "ok") == [("shell", "bash -lc make", "bad", False)]


def test_gemini_and_cline(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "one.json").write_text(json.dumps({"sessionId": "g1", "messages": [
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "content": "hello there"},
        {"type": "gemini", "content": "hi", "model": "gm", "toolCalls": [{"id": "1", "name": "read", "args": {"path": "a"}, "status": "success", "result": [{"functionResponse": {"response": {"output": "text"}}}]}]}, {"type": "info", "content": "x"}]}))
    messages, events, _ = registry.READERS["gemini"](spark, str(tmp_path / "g"))
    assert rows(messages, "session", "text", "reply", "model", "project") == [("g1", "hello there", "hi", "gm", "gemini")]
    assert rows(events, "name", "input", "output", "ok") == [("read", "a", "text", True)]
    task = tmp_path / "c" / "tasks" / "1704067200000"
    task.mkdir(parents=True)
    (tmp_path / "c" / "taskHistory.json").write_text(json.dumps([{"id": "1704067200000", "cwdOnTaskInitialization": "/x/y/tool"}]))
    (task / "api_conversation_history.json").write_text(json.dumps([
        {"role": "user", "content": [{"type": "text", "text": "<task>\nrename it\n</task>"}, {"type": "text", "text": "<environment_details>noise</environment_details>"}]},
        {"role": "assistant", "content": [{"type": "text", "text": "renamed"}, {"type": "tool_use", "id": "u", "name": "edit", "input": {"path": "f"}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u", "content": "no", "is_error": True}]}]))
    messages, events, _ = registry.READERS["cline"](spark, str(tmp_path / "c"))
    assert rows(messages, "session", "ts", "text", "reply", "project") == [("1704067200000", 1704067200000, "rename it", "renamed", "tool")]
    assert rows(events, "name", "output", "ok") == [("edit", "no", False)]


def test_kimi_and_antigravity(spark, tmp_path):
    put(tmp_path / "k" / "s" / "context.jsonl", [{"role": "user", "content": "first"}, {"role": "assistant", "content": "ok", "tool_calls": [{"id": "z", "function": {"name": "sh", "arguments": json.dumps({"command": "id"})}}]}, {"role": "tool", "tool_call_id": "z", "content": "<system>ERROR no"}, {"role": "user", "content": "second"}])
    put(tmp_path / "k" / "s" / "wire.jsonl", [{"timestamp": t, "message": {"type": "TurnBegin"}} for t in (1.5, 2.5, 3.5)])
    messages, events, _ = registry.READERS["kimi"](spark, str(tmp_path / "k"))
    assert rows(messages, "turn", "text", "ts", "reply") == [(0, "first", 2500, "ok"), (1, "second", 3500, "")]
    assert rows(events, "name", "input", "ok") == [("sh", "id", False)]
    put(tmp_path / "a" / "s9" / "transcript.jsonl", [
        {"type": "USER_INPUT", "source": "USER_EXPLICIT", "content": "<USER_REQUEST>do it</USER_REQUEST> more", "created_at": "2024-01-01T00:00:00Z"},
        {"type": "PLANNER_RESPONSE", "source": "MODEL", "content": "planning", "tool_calls": [{"name": "RUN", "args": {"command": "a"}}, {"name": "VIEW", "args": {"path": "b"}}]},
        {"type": "RUN", "source": "MODEL", "content": "out a", "status": "DONE"}, {"type": "VIEW", "source": "MODEL", "content": "out b", "status": "ERROR"}])
    messages, events, _ = registry.READERS["antigravity"](spark, str(tmp_path / "a"))
    assert rows(messages, "session", "text", "reply") == [("s9", "do it", "planning")]
    assert rows(events, "name", "output", "ok") == [("RUN", "out a", True), ("VIEW", "out b", False)]


def test_pi_tree(spark, tmp_path):
    records = [
        {"type": "session", "id": "p1", "version": 3, "cwd": "/w/q"}, {"type": "message", "id": "1", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "one"}},
        {"type": "message", "id": "2", "parentId": "1", "message": {"role": "assistant", "content": "dead end"}}, {"type": "model_change", "id": "3", "parentId": "1", "modelId": "mm"},
        {"type": "message", "id": "4", "parentId": "3", "message": {"role": "assistant", "content": "good"}}, {"type": "message", "id": "5", "parentId": "4", "message": {"role": "bashExecution", "command": "ls", "output": "x", "exitCode": 0}}]
    (tmp_path / "s.jsonl.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, records)).encode()))
    messages, events, intake = registry.READERS["pi"](spark, str(tmp_path))
    assert rows(messages, "session", "text", "reply", "model", "project") == [("p1", "one", "good", "mm", "/w/q")]
    assert rows(events, "name", "input", "ok") == [("bash", "ls", True)]
    assert intake.filter("reason = 'unreferenced'").count() == 1


def test_sqlite_stores(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "opencode.db")
    db.executescript("create table session(id, directory, parent_id, title); create table message(id, session_id, data, time_created); create table part(id, message_id, session_id, data, time_created);")
    db.execute("insert into session values ('o1', '/w/demo', null, 't'), ('o2', '/w/demo', 'o1', 'child')")
    db.executemany("insert into message values (?, 'o1', ?, ?)", [("m1", json.dumps({"role": "user"}), 10), ("m2", json.dumps({"role": "assistant", "modelID": "om"}), 20)])
    db.executemany("insert into part values (?, ?, 'o1', ?, ?)", [
        ("p1", "m1", json.dumps({"type": "text", "text": "question"}), 11), ("p2", "m1", json.dumps({"type": "text", "text": "injected", "synthetic": True}), 12), ("p3", "m2", json.dumps({"type": "text", "text": "answer"}), 21),
        ("p4", "m2", json.dumps({"type": "tool", "tool": "grep", "callID": "c", "state": {"status": "completed", "input": {"pattern": "x"}, "output": "hit"}}), 22)])
    db.commit()
    messages, events, _ = registry.READERS["opencode"](spark, str(tmp_path))
    assert rows(messages, "session", "text", "reply", "model", "project") == [("o1", "question", "answer", "om", "demo")]
    assert rows(events, "kind", "name", "ok", "child_session") == [("subagent_start", "task", None, "o2"), ("tool", "grep", True, "")]
    folder = tmp_path / "crushed"
    folder.mkdir()
    db = sqlite3.connect(folder / "crush.db")
    db.executescript("create table sessions(id, parent_session_id, title); create table messages(id, session_id, role, parts, model, created_at);")
    db.execute("insert into sessions values ('x', null, 't')")
    db.executemany("insert into messages values (?, 'x', ?, ?, ?, ?)", [
        ("1", "user", json.dumps([{"type": "text", "data": {"text": "hey"}}]), None, 1704067200), ("2", "assistant", json.dumps([{"type": "text", "data": {"text": "yo"}}, {"type": "tool_call", "data": {"id": "c", "name": "ls", "input": "{\"path\": \"d\"}"}}]), "cm", 1704067201),
        ("3", "tool", json.dumps([{"type": "tool_result", "data": {"tool_call_id": "c", "content": "f", "is_error": False}}]), None, 1704067202)])
    db.commit()
    messages, events, _ = registry.READERS["crush"](spark, str(folder))
    assert rows(messages, "session", "ts", "text", "reply", "model", "project") == [("x", 1704067200000, "hey", "yo", "cm", "crushed")]
    assert rows(events, "name", "input", "output", "ok") == [("ls", "d", "f", True)]
    db = sqlite3.connect(tmp_path / "state.vscdb")
    db.execute("create table cursorDiskKV(key, value)")
    db.executemany("insert into cursorDiskKV values (?, ?)", [
        ("composerData:q", json.dumps({"createdAt": 1704067200000, "fullConversationHeadersOnly": [{"bubbleId": "b1", "type": 1}, {"bubbleId": "b2", "type": 2}, {"bubbleId": "b3", "type": 2}]})),
        ("bubbleId:q:b1", json.dumps({"text": "why"})), ("bubbleId:q:b2", json.dumps({"text": "hmm", "isThought": True})), ("bubbleId:q:b3", json.dumps({"text": "because", "toolFormerData": {"name": "run", "params": "{\"command\": \"w\"}", "status": "completed", "toolCallId": "t", "result": "r"}}))])
    db.commit()
    messages, events, _ = registry.READERS["cursor"](spark, str(tmp_path))
    assert rows(messages, "session", "ts", "text", "reply", "project") == [("q", 1704067200000, "why", "because", "cursor")]
    assert rows(events, "name", "input", "output", "ok") == [("run", "w", "r", True)]


def test_corpus_and_sinks(spark, claude_store, tmp_path):
    messages, events, _ = registry.read_all(spark, {"claude": claude_store})
    corpus = registry.build_corpus(messages, events)
    assert rows(corpus.filter("session = 's1'"), "turn", "who") == [(0, "agent"), (0, "tool"), (0, "user"), (1, "recap")]
    sinks.write_corpus(corpus, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == corpus.count()
    hits = corpus.withColumn("snippet", corpus["text"])
    sinks.write_flat(hits, str(tmp_path / "flat"))
    assert any("fix the cache" in r.value and r.value.count("\t") == 5 for r in spark.read.text(str(tmp_path / "flat")).collect())
    assert all(json.loads(r.value)["session"] for r in sinks.envelope(hits).collect())


def test_empty_store(spark, tmp_path):
    (tmp_path / "e").mkdir()
    put(tmp_path / "e" / "x.jsonl", [""])
    messages, events, intake = registry.READERS["claude"](spark, str(tmp_path / "e"))
    assert messages.count() == 0 and events.count() == 0 and intake.count() == 0


def test_lines_once(spark, tmp_path):
    """Many small files are read once and by few tasks; the setting for that stays out of the caller's session."""
    for i in range(60):
        put(tmp_path / f"{i}.jsonl", [str(i), "", f'"{i}é"'])
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    once = common.lines_once(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert rows(once, "file", "ordinal", "value") == rows(common.lines(spark, str(tmp_path)), "file", "ordinal", "value") and once.count() == 120
    assert not [f for f in once.inputFiles() if f.endswith(".jsonl")]


def test_files_by_key(spark, tmp_path):
    talk = spark.createDataFrame([(f"s/{i % 5}", i, f"line {i} é") for i in range(100)], "key string, n int, value string")
    ordered = talk.repartition(3, "key").sortWithinPartitions("key", "n").select("key", "value")
    for _ in range(2):  # a second run replaces the same files
        assert sum(r.files for r in ordered.mapInArrow(sinks.files_by_key(f"file:{tmp_path}/a b%20"), "files bigint").collect()) == 5
    found = [p for p in (tmp_path / "a b%20").rglob("*") if p.is_file()]
    assert sorted(p.read_text() for p in found) == sorted("".join(f"line {i} é\n" for i in range(k, 100, 5)) for k in range(5))


def raw_table(spark, tmp_path):
    given = [(i, f"s-{i % 50}", i // 50, f"ask {i}", f"say {i}", 1_704_067_200_000 + i * 1000, f"m{i % 3}") for i in range(150)]
    spark.createDataFrame(given, "rm_id bigint, session string, turn int, text string, reply string, ts bigint, model string").write.parquet(f"{tmp_path}/raw_messages.parquet")
    return sorted((s, n, text, reply, ts, model) for _, s, n, text, reply, ts, model in given)


def test_scan_codex_store(spark, tmp_path):
    """The messages come from the lines that were read once."""
    want = raw_table(spark, tmp_path)
    out = catalog_sources.scan_codex(spark, str(tmp_path))
    assert rows(out, "session", "turn", "text", "reply", "ts", "model") == want
    assert not [f for f in out.inputFiles() if f.endswith(".txt")]


def test_scan_pi_store(spark, tmp_path):
    want = raw_table(spark, tmp_path)
    out = catalog_sources.scan_pi(spark, str(tmp_path))
    assert rows(out, "session", "turn", "text", "reply", "ts", "model") == want
    assert not [f for f in out.inputFiles() if f.endswith(".txt")]
