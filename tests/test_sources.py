import io
import json
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from loomwright.sources import readers, shards, sinks
from loomwright.sources.paths import brace_expand


def test_braces():
    assert brace_expand("s-{00008..00011}.tar") == [f"s-{i:05d}.tar" for i in range(8, 12)]
    assert brace_expand("{a,b}/{0..1}") == ["a/0", "a/1", "b/0", "b/1"]
    assert brace_expand("plain{x}") == ["plain{x}"] and brace_expand("{2..0}") == ["2", "1", "0"]


def tar(members):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def test_broken_shards(spark, tmp_path):
    whole = tar([("a.txt", b"one"), ("a.json", b"{}"), ("b.TXT", b"two" * 500)])
    (tmp_path / "ok.tar").write_bytes(whole)
    (tmp_path / "cut.tar").write_bytes(whole[:1100])
    (tmp_path / "junk.tar").write_bytes(b"not a tar" * 100)
    got = shards.read_tar(spark, f"file://{tmp_path}").collect()
    by = {}
    for r in got:
        by.setdefault(r.shard.rsplit("/", 1)[-1], []).append((r.member, r.ext, r.error is None))
    assert by["ok.tar"] == [("a.txt", "txt", True), ("a.json", "json", True), ("b.TXT", "txt", True)]
    assert by["cut.tar"][0] == ("a.txt", "txt", True) and not by["cut.tar"][-1][2]
    assert by["junk.tar"] == [(None, None, False)]
    only = shards.read_tar(spark, f"file://{tmp_path}/ok.tar", exts=("json",)).collect()
    assert [(r.ord, bytes(r.payload)) for r in only] == [(1, b"{}")]
    with pytest.raises(Exception, match="cut off|unexpected end|ReadError"):
        shards.read_tar(spark, f"file://{tmp_path}/cut.tar", tolerant=False).collect()


def test_image_sizes():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"x" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 200) + b"x" * 10
    assert shards.image_size(png) == (640, 480) and shards.image_size(jpg) == (200, 300)
    assert shards.image_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9) and shards.image_size(b"nothing") is None


def test_json_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken {\n{"a": 2}\n[1]\n')
    path = f"file://{tmp_path}/x.jsonl"
    assert sorted(r.a for r in readers.read_json_lines(spark, path, "a int").collect()) == [1, 2]
    assert sorted(r.line for r in readers.read_json_lines(spark, path, "a int", rejects=True).collect()) == ["[1]", "broken {"]
    items = [{"caption": "c", "image": "i", "video": "v"}, {"question": "q", "answer": "a", "image": "i"}, {"image": "i"}, {"video_id": "w"}]
    (tmp_path / "l.json").write_text(json.dumps(items))
    schema = "caption string, image string, video string, question string, answer string, video_id string, instruction string, source_image string, target_image string"
    assert readers.select_items(readers.read_json_list(spark, f"file://{tmp_path}/l.json", schema)).count() == 4
    (tmp_path / "c1.json").write_text(json.dumps({"annotations": [{"caption": "x", "image": "p", "image_id": 3}, {"image": "p"}]}))
    (tmp_path / "c2.json").write_text(json.dumps([{"caption": "y", "image": "q"}]))
    (tmp_path / "c3.json").write_text('{"other": 1}')
    assert sorted(r.caption for r in readers.read_annotations(spark, [f"file://{tmp_path}/c{i}.json" for i in (1, 2)]).collect()) == ["x", "y"]
    with pytest.raises(Exception, match="neither a list"):
        readers.read_annotations(spark, f"file://{tmp_path}/c3.json").collect()


def test_tables_and_sizes(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('a "b" dog\tn1\nno ids\tn2\n')
    caps = readers.read_tsv(spark, f"file://{tmp_path}/m.tsv", "caption string, image_name string")
    store = spark.createDataFrame([("n1", [1, 2])], "image_name string, image_ids array<int>")
    got = {r.image_name: (r.caption, r.image_ids) for r in readers.captions_with_ids(caps, store).collect()}
    assert got == {"n1": ('a "b" dog', [1, 2]), "n2": (None, None)}
    sh = spark.createDataFrame([("a",), ("b",), ("c",)], "shard string")
    sizes = spark.createDataFrame([("a", 3), ("b", 4)], "shard string, size long")
    assert readers.dataset_size(sh, sizes, strict=False) == 7
    with pytest.raises(KeyError):
        readers.dataset_size(sh, sizes)
    with pytest.raises(ValueError):
        readers.load(spark, "x.pkl")
    for cls in ("cat", "dog"):
        (tmp_path / "im" / cls).mkdir(parents=True)
        (tmp_path / "im" / cls / "1.jpg").write_bytes(b"x")
    folder = readers.read_image_folder(spark, f"file://{tmp_path}/im", labelled=True)
    assert sorted((r.path, r["class"], r.label) for r in folder.collect()) == [("cat/1.jpg", "cat", 0), ("dog/1.jpg", "dog", 1)]
    lines = readers.number_lines(spark.createDataFrame([("x/f.jsonl", 2)], "path string, place int"))
    assert lines.first().key == "f_line2"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 0, "b"), (2, 1, 1, "c")], "id int, rank int, place int, answer string")
    assert {r.id: r.answer for r in sinks.merge_results(df, "id", "rank", "place").collect()} == {1: "a", 2: "c"}
    sinks.save_json(df, f"file://{tmp_path}/r")
    sinks.append_metrics(df.limit(1), f"file://{tmp_path}/m")
    sinks.append_metrics(df.limit(1), f"file://{tmp_path}/m")
    assert spark.read.json(f"file://{tmp_path}/r").count() == 3 and spark.read.json(f"file://{tmp_path}/m").count() == 2
    sinks.append_chat_log(spark.createDataFrame([(86400.5, "vote")], "tstamp double, type string"), f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").first().day.isoformat() == "1970-01-02"
    sinks.write_report(df, f"file://{tmp_path}/t")
    assert spark.read.csv(f"file://{tmp_path}/t", sep="\t", header=True).count() == 3
    sinks.write_samples(spark.range(25).coalesce(1), f"file://{tmp_path}/s", per_file=10)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3
    line = df.limit(1).select(sinks.leaderboard_line(F.lit(7), F.lit("x")).alias("l")).first().l
    assert json.loads(line) == {"7": {"direct_answer": "x", "multiple_choice": ""}}
    tars = shards.pack_tar(spark.createDataFrame([("k", "text", bytearray(b"\x00"))], "k string, t string, b binary"), "k", {"txt": "t", "bin": "b"})
    members = shards.expand_tar(tars.select(F.lit("x").alias("path"), "content")).collect()
    assert [(m.member, bytes(m.payload)) for m in members] == [("k.txt", b"text"), ("k.bin", b"\x00")]


def test_fetching(spark):
    from loomwright.sources.fetch import fetch, http_get

    def get(url, attempt):
        if url == "late" and attempt < 3:
            raise OSError("reset")
        if url == "never":
            raise ValueError("bad url")
        return {"gone": 404, "busy": 503}.get(url, 200), url.encode()

    df = spark.createDataFrame([("a", "ok"), ("b", "late"), ("c", "never"), ("d", "gone"), ("e", "busy"), ("f", None)], "name string, link string")
    got = {r.name: (r.status, r.tries, r.error, r.payload and bytes(r.payload)) for r in fetch(df, "name", "link", get, wait=0.0).collect()}
    assert got["a"] == (200, 1, None, b"ok") and got["b"] == (200, 3, None, b"late") and got["c"] == (None, 3, "ValueError: bad url", None)
    assert got["d"] == (404, 1, None, None) and got["e"] == (503, 3, None, None) and got["f"][0] is None and "Error" in got["f"][2]
    assert fetch(df.limit(0), "name", "link", get).count() == 0
    with pytest.raises(Exception):
        http_get("http://127.0.0.1:9/nothing", 1, timeout=0.2)


def test_archives(spark):
    import gzip
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("d/a.TXT", "one")
        z.writestr("b", "")
        z.mkdir("empty")
    files = [("x/z.zip", buf.getvalue()), ("x/y.json.gz", gzip.compress(b"{}")), ("x/cut.zip", buf.getvalue()[:40]), ("x/cut.gz", gzip.compress(b"abc" * 99)[:20]), ("x/no.txt", b"plain")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    got = {}
    for r in shards.expand_archive(df).collect():
        got.setdefault(r.shard, []).append((r.member, r.ext, r.payload if r.payload is None else bytes(r.payload), r.error is None))
    assert got["x/z.zip"] == [("d/a.TXT", "txt", b"one", True), ("b", "", b"", True)] and got["x/y.json.gz"] == [("y.json", "json", b"{}", True)]
    assert all(len(got[p]) == 1 and not got[p][0][3] for p in ("x/cut.zip", "x/cut.gz", "x/no.txt"))
    with pytest.raises(Exception):
        shards.expand_archive(df, tolerant=False).collect()


def test_fetching_pages_from_a_server(spark):
    """Pages by their own paths from a server on this machine: found, gone, overloaded once, and no answer at all."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import urlsplit

    from loomwright.sources.fetch import fetch

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(12).collect()
    html, seen = {urlsplit(p.url).path + f"?{p.page_id}": p.html for p in pages}, {}

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            k = int(self.path.rsplit("?", 1)[-1]) % 4
            status = 404 if k == 0 else 503 if k == 1 and seen[self.path] == 1 else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(html[self.path].encode() if status == 200 else b"")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    rows = [(p.page_id, at + urlsplit(p.url).path + f"?{p.page_id}") for p in pages] + [(-1, "http://127.0.0.1:1/none")]
    got = {r.page_id: r for r in fetch(spark.createDataFrame(rows, "page_id long, url string"), "page_id", "url", tries=2, wait=0.01).collect()}
    server.shutdown()
    for p in pages:
        r, k = got[p.page_id], p.page_id % 4
        assert (r.status, r.tries, r.payload and bytes(r.payload).decode()) == ((404, 1, None) if k == 0 else (200, 2 if k == 1 else 1, p.html))
    assert got[-1].status is None and got[-1].tries == 2 and got[-1].error.startswith("URLError")


def test_members_of_many_small_archives_are_one_table():
    class Files:
        select = lambda self, *_: self
        mapInPandas = staticmethod(lambda f, _: f)

    import gzip

    import pandas as pd

    pdf = pd.DataFrame({"path": [f"x/{i}.txt.gz" for i in range(50)] + ["x/bad"], "content": [gzip.compress(b"%d" % i) for i in range(50)] + [b"plain"]})
    made = list(shards.expand_archive(Files())(iter([pdf])))
    assert len(made) == 1 and made[0]["payload"].tolist() == [*(b"%d" % i for i in range(50)), None] and made[0]["error"].notna().sum() == 1


class _Function:
    """A table whose mapIn... gives the function back."""

    select = lambda self, *_: self
    mapInArrow = mapInPandas = staticmethod(lambda f, _: f)


def test_many_empty_members_are_handed_on():
    """Rows take memory where members have no bytes: 50,000 of them are several batches, of a tar and of a zip."""
    import zipfile

    import pandas as pd
    import pyarrow as pa

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for i in range(50_000):
            z.writestr(f"{i}.txt", b"")
    whole = tar([(f"{i}.txt", b"") for i in range(50_000)])
    expand = shards.expand_tar(_Function())
    made = [b.column("ord").to_pylist() for b in (expand(iter([pa.RecordBatch.from_pydict({"path": ["x"], "content": [whole]})])))]
    assert max(map(len, made)) < 20_000 and sum(made, []) == list(range(50_000))
    zips = [len(d) for d in shards.expand_archive(_Function())(iter([pd.DataFrame({"path": ["x"], "content": [buf.getvalue()]})]))]
    assert max(zips) < 20_000 and sum(zips) == 50_000


def test_small_tars_share_a_batch_and_damage_stays_in_order():
    import pyarrow as pa

    one = [tar([(f"{i}.txt", b"%d" % i), (f"{i}.bin", b"")]) for i in range(30)]
    content = [*one[:10], one[10][:700], None, *one[11:]]
    got = list(shards.expand_tar(_Function())(iter([pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(content))]), pa.array(content, pa.binary())], ["path", "content"])])))
    assert len(got) == 1
    rows = got[0].to_pylist()
    assert [r["payload"] for r in rows if r["ext"] == "txt" and r["shard"] > "1"] and [(r["shard"], r["ord"]) for r in rows if r["error"]] == [("10", 1), ("11", 0)]
    assert [r["payload"] for r in rows if r["ext"] == "txt"] == [b"%d" % i for i in range(30)]


def test_packed_shards_end_by_their_bytes(spark):
    d = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 100000) AS t", "IF(id % 2 = 0, '\u00e9', NULL) AS m")
    made = shards.pack_tar(d, "id", {"txt": "t", "m": "m"}, shard_bytes=1 << 20)
    assert made.count() >= 4 and made.selectExpr("max(length(content))").first()[0] < 1_300_000
    rows = shards.expand_tar(made.select(F.concat_ws("-", "part", "shard").alias("path"), "content")).collect()
    assert sorted((int(r.member.split(".")[0]), r.ext, len(r.payload)) for r in rows) == sorted([(i, "txt", 100_000) for i in range(40)] + [(i, "m", 2) for i in range(0, 40, 2)])
