import base64
import json
import threading
import urllib.error
import urllib.request
from io import StringIO

import pytest

from quillspark import cli
from quillspark.operators.recursive import RecursionLimit, fixed_point
from quillspark.operators.store import DocumentStore
from quillspark.sources import render
from quillspark.streaming.reindex import keep_indexed, windowed_counts


def test_renderers():
    cols, rows = ["a", "b|c"], [[1, 'x, "y"'], [4.0, None], [True, "p|q\nr" + "z" * 80]]
    table = render.to_table(cols, rows)
    assert "│ 4 " in table and "…" in table and table.endswith("(3 rows)\n")
    assert render.to_csv(cols, rows).split("\n")[1] == '1,"x, ""y"""'
    assert json.loads(render.to_json(cols, rows))[1] == {"a": 4.0, "b|c": None}
    assert "p\\|q r" in render.to_markdown(cols, rows)
    assert "&quot;y&quot;" in render.to_html(cols, rows)
    assert render.to_tsv(cols, rows[:1]) == 'a\tb|c\n1\tx, "y"\n'
    assert render.to_table([], []) == "(no columns)\n" and render.to_table(["a"], []) == "(0 rows)\n"


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    (root / "src").mkdir()
    (root / "src" / "a.md").write_text("# A\n\n## B\n\n- item\n")
    assert cli.main(["index", str(root / "store"), str(root / "src")]) == 0
    return root


def test_commands(saved, capsys):
    store = str(saved / "store")
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    assert "A" in run("list", store)[1]
    assert run("mq", store, ".h2")[1] == "## B\n"
    assert "<li>item</li>" in run("mq", store, ".list", "--html")[1]
    assert run("sql", store, "SELECT count(*) AS n FROM blocks", "--format", "csv")[1] == "n\n3\n"
    code, out = run("lint", store)
    assert code == 1 and "item" in out
    assert "heading" in run("stats", store)[1]
    assert "files_after" in run("vacuum", store)[1]
    assert "item" in run("show", store, "0")[1]


def test_repl(spark, saved):
    out = StringIO()
    cli.repl(DocumentStore.open(spark, str(saved / "store")), "table", False, [".mode csv", ".h1", "SELECT content FROM blocks WHERE depth = 2", "SELECT nothing FROM nowhere", ".help", ".quit", ".h1"], out)
    text = out.getvalue()
    assert text.count("# A") == 1 and "B" in text and "error:" in text


def test_server(spark, saved):
    server = cli.serve(DocumentStore.open(spark, str(saved / "store")), 0, "key")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert urllib.request.urlopen(base + "/health").status == 200
    ask = lambda path, body, key: urllib.request.urlopen(urllib.request.Request(base + path, body.encode(), {"X-Api-Key": key}))
    assert json.load(ask("/sql", "SELECT content FROM blocks WHERE depth = 1", "key")) == [{"content": "A"}]
    assert json.load(ask("/mq", ".h2 | to_text", "key"))[0]["output"] == "B"
    for body, key, code in (("SELECT 1", "bad", 401), ("SELECT oops FROM blocks", "key", 400), ("DELETE FROM blocks", "key", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask("/sql", body, key)
        assert e.value.code == code
    server.shutdown()


def test_server_guards(spark, saved):
    assert [limit.allows(a) for limit in [cli.RateLimit(2, lambda: 5.5)] for a in "xxxy"] == [True, True, False, True]
    at = iter([0.1, 0.2, 1.0])
    limit = cli.RateLimit(1, lambda: next(at))
    assert [limit.allows("x") for _ in range(3)] == [True, False, True]
    store = DocumentStore.open(spark, str(saved / "store"))
    server = cli.serve(store, 0, "key", "me:secret", rate_limit=1000, timeout=60)
    slow = cli.serve(store, 0, None, timeout=0.05)
    for s in (server, slow):
        threading.Thread(target=s.serve_forever, daemon=True).start()

    def ask(s, headers, path="/sql", body="SELECT count(*) AS n FROM blocks"):
        try:
            return urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", body.encode(), headers)).status
        except urllib.error.HTTPError as e:
            return e.code

    token = base64.b64encode(b"me:secret").decode()
    assert ask(server, {"Authorization": f"Basic {token}"}) == 200 == ask(server, {"Authorization": "Bearer key"}) == ask(server, {"X-Api-Key": "key"})
    assert ask(server, {}) == 401 == ask(server, {"Authorization": "Basic bad"}) == ask(server, {"Authorization": "Bearer bad"})
    assert ask(server, {"X-Api-Key": "key"}, "/else") == 404
    assert ask(slow, {}) == 408
    for s in (server, slow):
        s.shutdown()


def test_repl_write_back_is_saved(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("# Old\n")
    where = str(tmp_path / "store")
    assert cli.main(["index", where, str(tmp_path / "src")]) == 0
    monkeypatch.setattr("sys.stdin", StringIO("UPDATE blocks SET content = 'New' WHERE depth = 1\n.quit\n"))
    assert cli.main(["repl", where, "--write-back"]) == 0
    assert (tmp_path / "src" / "a.md").read_text() == "# New\n"
    assert [r["title"] for r in DocumentStore.open(spark, where).documents().collect()] == ["New"]


def test_streaming_index(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# One\n")
    go = lambda: keep_indexed(spark, str(src), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    go()
    (src / "b.md").write_text("# Two\n")
    (src / "note.txt").write_text("# no\n")
    go()
    assert sorted(r["title"] for r in DocumentStore.open(spark, str(tmp_path / "store")).documents().collect()) == ["One", "Two"]


def test_windowed_counts_in_batch_and_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    batch = sorted(map(tuple, windowed_counts(events).select("window_start", "event_type", "n").collect()))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("SELECT window_start, event_type, n FROM counts").collect())) == batch


def test_fixed_point_limit(spark):
    start = spark.range(1)
    with pytest.raises(RecursionLimit):
        fixed_point(start, lambda new: new.selectExpr("id + 1 AS id"), limit=3)
    assert fixed_point(start, lambda new: new.selectExpr("(id + 1) % 5 AS id")).count() == 5
