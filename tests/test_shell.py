"""Printers, command line, server and streams."""

import io
import json
import os
import threading
import urllib.error
import urllib.request
from datetime import datetime

from astrolith import cli
from astrolith.plans.dialect import looks_like_sql
from astrolith.render import json_envelope, text_table
from astrolith.server import make_server
from astrolith.session import FactSession
from astrolith.streaming import watch

SHOP = os.path.join(os.path.dirname(__file__), "fixtures", "shop")


def test_text_table():
    assert text_table(["a", "bb"], [[1, "x"], [None, "yy"]]) == "a | bb\n--+---\n1 | x\n  | yy\n(2 rows)\n"
    assert text_table(["a"], []).endswith("(no rows)\n") and text_table(["a"], [[1]]).endswith("(1 row)\n")


def test_json():
    assert json.loads(json_envelope(["a"], [[1], [None]])) == {"success": True, "columns": ["a"], "rows": [["1"], [""]], "row_count": 2}
    assert json.loads(json_envelope([], [], 'no "x"')) == {"success": False, "error": 'no "x"'}


def test_looks_like_sql():
    assert looks_like_sql("select 1") and looks_like_sql(".tables") and looks_like_sql("  WITH x AS (..)")
    assert not looks_like_sql("selection of files") and not looks_like_sql("which classes are there?")


def test_arguments():
    o, sources, clang = cli.split_arguments(["a.cpp", "-I", "inc", "--http", "b.cpp:x", "-DX", "--", "-std=c++17"])
    assert (o.http, sources, clang) == (8080, ["a.cpp", "b.cpp:x"], ["-I", "inc", "-DX", "-std=c++17"])


def test_command_line(spark, capsys):
    book = os.path.join(SHOP, "book.cpp")
    assert cli.main([book, "-e", "SELECT name FROM classes ORDER BY name LIMIT 1"], spark) == 0
    assert capsys.readouterr().out == "name\n----\nBook\n(1 row)\n"
    assert cli.main([book, "-e", "SELECT x FROM classes"], spark) == 1
    assert cli.main(["-e", "SELECT 1"], spark) == 1
    assert cli.main([book, f"{SHOP}/other.cpp:o", "-e", "SELECT COUNT(*) FROM book_classes JOIN o_classes USING (usr)"], spark) == 0
    assert cli.main(["--project", SHOP, "--exclude", "none", "-e", "SELECT COUNT(*) FROM files"], spark) == 0


def test_shell(spark):
    s = FactSession(spark)
    s.attach(os.path.join(SHOP, "book.cpp"), "book", prefix=False)
    out = io.StringIO()
    cli.shell(s, [".tables\n", ".schema enums\n", "SELECT name\n", "FROM enums WHERE is_scoped;\n", "hello;\n", ".quit\n", "SELECT 1;\n"], out)
    text = out.getvalue()
    assert "string_literals" in text and "CREATE TABLE enums" in text and "Status" in text and "not a statement" in text and "1\n-" not in text


def test_server(spark):
    s = FactSession(spark)
    s.attach(os.path.join(SHOP, "book.cpp"), "srv")
    server = make_server(s, port=0, token="t0ken")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None, token="t0ken"):
        r = urllib.request.Request(base + path, data=body and body.encode(), headers={"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(r, timeout=60) as a:
                return a.status, a.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert call("/help")[0] == 200 and call("/status", token="no")[0] == 401 and call("/none")[0] == 404
    assert "srv" in json.loads(call("/status")[1])["schemas"]
    assert json.loads(call("/query", "SELECT COUNT(*) AS n FROM srv_enums")[1])["rows"] == [["2"]]
    assert call("/query", "DROP TABLE x")[0] == 400
    rpc = lambda m, **p: json.loads(call("/tools", json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": p}))[1])
    assert [t["name"] for t in rpc("tools/list")["result"]["tools"]] == ["query", "ask"]
    assert "Status" in rpc("tools/call", name="query", arguments={"sql": "SELECT name FROM srv_enums"})["result"]["content"][0]["text"]
    assert rpc("tools/call", name="ask", arguments={"text": "what is here?"})["result"]["isError"] is True
    assert rpc("nope")["error"]["code"] == -32601 and call("/tools", "{")[0] == 200
    assert call("/shutdown", " ")[0] == 200


def test_stream_follows_sources(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "facts"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.cpp").write_text("int a() { return 1; }\n")
    q = watch.follow(spark, str(src), out, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(out).where("table_name = 'functions'").count() == 1
    (src / "b.cpp").write_text("int b() { return 1; }\nint c() { return b(); }\n")
    q = watch.follow(spark, str(src), out, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(out).where("table_name = 'functions'").count() == 3


def test_stale_and_windows(spark):
    t = datetime(2025, 1, 1, 10)
    facts = spark.createDataFrame([("a", t), ("b", t)], "path string, parsed_at timestamp")
    files = spark.createDataFrame([("a", datetime(2025, 1, 2)), ("b", datetime(2024, 1, 2)), ("c", t)], "path string, modificationTime timestamp")
    assert sorted(r.path for r in watch.stale(facts, files).collect()) == ["a", "c"]
    e = spark.createDataFrame([(t, "x"), (datetime(2025, 1, 1, 10, 30), "x"), (datetime(2025, 1, 1, 12), "y")], "ts timestamp, k string")
    assert sorted((r.start.hour, r.k, r.n) for r in watch.windowed_counts(e, "ts", "k").collect()) == [(10, "x", 2), (12, "y", 1)]


def test_settings(tmp_path):
    from astrolith import settings

    f = str(tmp_path / "x" / "s.json")
    assert settings.load(f) == settings.Settings()
    settings.save(settings.Settings(provider="p", timeout_ms=5), f)
    assert (settings.load(f).provider, settings.load(f).timeout_ms) == ("p", 1000)
    (tmp_path / "x" / "s.json").write_text("{broken")
    assert settings.load(f) == settings.Settings()
