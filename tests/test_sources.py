from __future__ import annotations

import gzip
import http.server
import json
import random
import threading

import pytest

from cordon.sources import advisories, messages
from cordon.sources.json_objects import json_objects


def entry(i: str, module: str, *events) -> dict:
    return {"id": i, "modified": "2024-01-02T00:00:00Z", "summary": f"Flaw {i}", "affected": [{"package": {"name": module, "ecosystem": "Go"}, "ranges": [{"type": "SEMVER", "events": list(events)}], "ecosystem_specific": {"imports": [{"path": module, "symbols": ["F"]}]}}], "unknown": 1}


ENTRIES = [entry("A-1", "example.com/a", {"introduced": "0"}, {"fixed": "1.2.0"}), entry("A-2", "example.com/a", {"introduced": "1.0.0"}), entry("B-1", "example.com/b", {"introduced": "0"}, {"fixed": "0.5.0"})]
INDEX = [{"path": "example.com/a", "vulns": [{"id": "A-1", "modified": "2024-01-02T00:00:00Z", "fixed": "1.2.0"}, {"id": "A-2", "modified": "2024-01-02T00:00:00Z"}]}, {"path": "example.com/b", "vulns": [{"id": "B-1", "modified": "2024-01-02T00:00:00Z", "fixed": "0.5.0"}]}]


def files() -> dict[str, object]:
    return {"index/db": {"modified": "2024-01-02T00:00:00Z"}, "index/modules": INDEX, **{f"ID/{e['id']}": e for e in ENTRIES}}


@pytest.fixture
def tree(tmp_path):
    for name, body in files().items():
        p = tmp_path / f"{name}.json"
        p.parent.mkdir(exist_ok=True)
        p.write_text(json.dumps(body))
    return tmp_path


def answers(spark, entries, compat=False):
    requests = spark.createDataFrame([(0, "example.com/a", "v1.1.0"), (1, "example.com/a", "v1.5.0"), (2, "example.com/a", ""), (3, "example.com/b", "v0.5.0"), (4, "example.com/none", "v1.0.0")], "ordinal int, path string, version string")
    got = advisories.by_modules(requests, advisories.build_index(entries), entries, compat)
    flat = advisories.by_modules(requests, advisories.flat_index(entries), compat=compat)
    out = sorted((r.ordinal, r.id) for r in got.collect())
    assert out == sorted((r.ordinal, r.id) for r in flat.collect())
    return out


WANT = [(0, "A-1"), (0, "A-2"), (1, "A-2"), (2, "A-1"), (2, "A-2")]


def test_layouts(spark, tree, tmp_path_factory):
    assert answers(spark, advisories.open_database(spark, f"file://{tree}/")) == WANT
    flat = tmp_path_factory.mktemp("flat")
    for e in ENTRIES:
        (flat / f"{e['id']}.json").write_text(json.dumps(e))
    (flat / "notes.txt").write_text("not an entry")
    assert answers(spark, advisories.open_database(spark, f"file://{flat}")) == WANT
    (flat / "C-1.json").write_text(json.dumps(ENTRIES[0]))
    with pytest.raises(Exception, match="differ"):
        advisories.read_flat(spark, str(flat)).collect()
    with pytest.raises(ValueError, match="URL"):
        advisories.open_database(spark, str(tree))
    index = {r.path: [(v.id, v.fixed) for v in r.vulns] for r in advisories.build_index(advisories.read_tree(spark, str(tree))).collect()}
    stored = {r.path: [(v.id, v.fixed or "") for v in r.vulns] for r in advisories.read_modules_index(spark, str(tree)).collect()}
    assert index == stored


def test_http(spark):
    bodies = {f"/{k}.json.gz": gzip.compress(json.dumps(v).encode()) for k, v in files().items()}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = bodies.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            if body and self.command == "GET":
                self.wfile.write(body)

        do_HEAD = do_GET

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert answers(spark, advisories.open_database(spark, f"http://127.0.0.1:{server.server_port}/")) == WANT
    finally:
        server.shutdown()


def test_requests_are_checked(spark):
    entries = advisories.from_rows(spark, [])
    bad = spark.createDataFrame([(0, "m", "x.y")], "ordinal int, path string, version string")
    with pytest.raises(Exception, match="invalid version"):
        advisories.checked_requests(bad).collect()
    assert advisories.build_index(entries).count() == 0


def test_file_urls():
    assert advisories.local_path("file:///a/b%20c") == "/a/b c"
    assert advisories.local_path("file:///C:/x") == "C:/x"
    assert advisories.local_path("file://host/share") == "//host/share"
    assert advisories.file_url("/a/b c") == "file:///a/b%20c"
    assert advisories.file_url("C:\\x") == "file:///C:/x"


def test_messages(spark, tmp_path):
    stream = [{"config": {"scan_level": "symbol"}}, {"progress": {"message": "x"}}, {"osv": ENTRIES[0]}, {"finding": {"osv": "A-1", "trace": [{"module": "example.com/a"}]}}]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(m, indent=2) for m in stream))
    got = messages.read_messages(spark, str(tmp_path / "m.json")).orderBy("ordinal").collect()
    assert [[k for k in ("config", "progress", "SBOM", "osv", "finding") if r[k] is not None] for r in got] == [["config"], ["progress"], ["osv"], ["finding"]]
    assert got[3].finding.trace[0].module == "example.com/a"


def test_blob(spark, tmp_path):
    body = {"path": "x", "pkgSymbols": [{"pkg": "b", "name": "G"}, {"pkg": "a", "name": "F"}], "goos": "linux", "goarch": "amd64"}
    (tmp_path / "in").write_text(json.dumps({"name": "bin", "version": "1"}) + "\n" + json.dumps(body) + "\n")
    df = messages.read_blob(spark, str(tmp_path / "in"), "bin", "1")
    messages.write_blob(df, str(tmp_path / "out"), "bin", "1")
    again = messages.read_blob(spark, str(tmp_path / "out"), "bin", "1").first()
    assert [(s.pkg, s.name) for s in again.pkgSymbols] == [("a", "F"), ("b", "G")] and again.goos == "linux"
    for text in ("", "{}\n{}\n", json.dumps({"name": "bin", "version": "2"}) + "\n{}", json.dumps({"name": "bin", "version": "1"}) + "\n{}\n{}"):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(Exception, match="abstraction"):
            messages.read_blob(spark, str(tmp_path / "bad"), "bin", "1").collect()


@pytest.mark.parametrize("block", [64, 1000, 1 << 27])
def test_objects_of_any_layout_over_many_blocks(spark, tmp_path, block):
    """Braces, brackets, quotes and backslashes in strings, nested lists, every layout; blocks that start anywhere."""
    rng = random.Random(block)
    signs = ['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "a", "}{", '\\"', "]}"]
    deep = lambda k: "".join(rng.choice(signs) for _ in range(rng.randrange(30))) if k == 0 else rng.choice([lambda: [deep(k - 1) for _ in range(rng.randrange(4))], lambda: {deep(0): deep(k - 1), "x": deep(k - 1)}])()
    objects = [{"k": i, "v": deep(3)} for i in range(60)]
    plain = "".join(json.dumps(o, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n", " \n\n"]) for o in objects)
    for name, text in (("a.json", plain), ("b.json", ""), ("c.json", "{}{}")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "d.json").write_text(json.dumps(objects, indent=2), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = {(r.file.rsplit("/", 1)[1], r.ordinal): json.loads(r.json) for r in json_objects(spark, f"{tmp_path}/*.json").collect()}
        listed = {r.ordinal: json.loads(r.json) for r in json_objects(spark, str(tmp_path / "list"), array=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.json", i): o for i, o in enumerate(objects)} | {("c.json", 0): {}, ("c.json", 1): {}}
    assert listed == dict(enumerate(objects))


def test_text_after_the_last_object_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"k": 1}\n{"k": [')
    with pytest.raises(Exception, match="text after the last object"):
        json_objects(spark, str(tmp_path / "x.json")).collect()
