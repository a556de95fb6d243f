"""Expressions, documents, walks, streams and the perceptual hash."""

import hashlib
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.functions import paths, phash, values
from sieveworks.operators import folders, similar
from sieveworks.operators.components import components
from sieveworks.plans import gate, review
from sieveworks.sources import caches, documents, walk
from sieveworks.sources.state import PresenceSnapshots, StateFolder
from sieveworks.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "copy"),
    [("a (1).txt", True), ("a - copy.txt", True), ("copy of a.txt", True), ("Copia de a.txt", True), ("a_copia.txt", True), ("a-2.txt", True), ("a copy.txt", True), ("a.txt", False), ("scopy of a.txt", False), ("a2.txt", False)],
)
def test_copy_names(spark, name, copy):
    assert one(spark, paths.is_copy_name(F.lit(f"/x/{name}"))) is copy


def test_paths(spark):
    assert one(spark, paths.canonical(F.lit("//a///b/"))) == "/a/b"
    assert one(spark, paths.canonical(F.lit("///"))) == "/"
    assert one(spark, paths.depth_under(F.lit("/ab/c"), F.lit("/a"))) == 0
    assert one(spark, paths.common_parent(F.lit("/a/b/c/x"), F.lit("/a/b/d"))) == "/a/b"
    assert one(spark, paths.common_parent(F.lit("/a/x"), F.lit("/b/x"))) is None
    assert one(spark, paths.rename_target(F.lit("/k/a.mp4"), F.lit("/n/b.c.mov"))) == "/k/b.c.mp4"


def test_values(spark):
    assert one(spark, values.bytes_parsed(F.lit("2 kb"))) == 2048
    assert one(spark, values.bytes_parsed(F.lit("999999999999 gb"))) is None
    assert one(spark, values.bytes_shown(F.lit(1536))) == "1.5 KB"
    assert one(spark, values.bytes_shown(F.lit(-4))) == "0 B"
    assert one(spark, values.is_scan_id(F.lit("20240101-000000-000000\n"))) is False
    assert [w for _, w in values.band_layout(5)] == [11, 11, 11, 11, 10, 10]


def test_hamming_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    flipped = [int(np.int64(h) ^ np.int64(np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, k)))) for k in range(1, 8) for h in base[:12]]
    own = [(f"/p{i:04d}", h) for i, h in enumerate(base + flipped)]
    found = {(r.a, r.b) for r in similar.similar_pairs(spark.createDataFrame(own, "path string, hash bigint")).collect()}
    assert found == {(p, q) for p, x in own for q, y in own if p < q and bin((x ^ y) & (2**64 - 1)).count("1") <= similar.DISTANCE}


def test_video_pairs_at_long_distances_go_by_tiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    own = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    own += [int(np.int64(h) ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 64, k))) for k in range(6, 18) for h in own[:8]]
    monkeypatch.setattr(similar, "TILE", 16)
    monkeypatch.setattr(similar, "hamming_join", None)  # 12 bits apart, its bands join 40 % of all pairs
    df = spark.createDataFrame([(f"/v{i:04d}", [h]) for i, h in enumerate(own)], "path string, frames array<bigint>")
    found = {(r.a, r.b) for r in similar.video_pairs(df, 12, 0.1).collect()}
    assert found == {(f"/v{i:04d}", f"/v{j:04d}") for j, y in enumerate(own) for i, x in enumerate(own[:j]) if bin((x ^ y) & (2**64 - 1)).count("1") <= 12}


def test_video_similarity_is_asymmetric(spark):
    a, b = [0] * 8, [0]
    df = spark.createDataFrame([("/a", a), ("/b", b)], "path string, frames array<bigint>")
    assert [r.similarity for r in similar.video_pairs(df).collect()] == [1.0]
    swapped = spark.createDataFrame([("/a", b), ("/b", a)], "path string, frames array<bigint>")
    assert similar.video_pairs(swapped).collect() == []


def test_folder_pairs_leave_out_nested_and_root(spark):
    t = spark.createDataFrame([("/r/a/x", "1"), ("/r/b/x", "1"), ("/r/b/c/x", "1"), ("/r/x", "1")], "path string, digest string")
    assert [(r.a, r.b) for r in folders.pairs(t, 0.9).orderBy("a", "b").collect()] == [("/r/a", "/r/b/c")]


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5)], "a bigint, b bigint")
    for one_task in (0, 1000):
        got = {r.id: r.component for r in components(edges, one_task).collect()}
        assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}
        assert components(edges.limit(0), one_task).count() == 0


def test_documents(spark, tmp_path):
    value = {"scan_id": "s", "root": "/r", "created_at": "t", "groups": [{"size": 3, "sha256": "ab", "files": ["/é", "/e\u0301"]}]}
    name = documents.save_document(str(tmp_path), "a.json", value)
    assert documents.parse_strict(open(name).read()) == value
    (tmp_path / "bad.json").write_text("{")
    assert sorted(r.path for r in documents.read_exact_scans(spark, str(tmp_path)).collect()) == ["/e\u0301", "/é"]
    assert documents.delete_document(str(tmp_path), "a.json") and not documents.delete_document(str(tmp_path), "a.json")
    with pytest.raises(ValueError):
        documents.parse_strict('{"a": NaN}')
    with pytest.raises(ValueError):
        documents.as_int(1.0)
    assert documents.parse_strict('{"a": 1, "a": 2}') == {"a": 1}
    assert documents.dump_document({"a": "\x7f"}) == '{\n  "a": "\\u007f"\n}\n'


def moved(path, **other):
    return {"original_path": path, "resulting_path": f"/t{path}", "mechanism": "trash", "size": 1, "sha256": "0a" * 32, "group_key": "g", "scan_id": "s", "timestamp": "t", **other}


def test_journal(spark, tmp_path):
    lines = [moved("/a"), moved("/b"), {"original_path": "/a", "undone_at": "t"}, moved("/c", mechanism="burn"), moved("/d", sha256="0a"), moved("/e", format_version=2), {"original_path": "/f"}]
    (tmp_path / "j1").write_text("\n".join([*map(json.dumps, lines), "not json", "", '{"original_path": "/to']))
    (tmp_path / "j2").write_text(json.dumps(moved("/a")) + "\n")
    good, bad = documents.read_journal(spark, str(tmp_path / "j*"))
    assert sorted((r.file[-2:], r.line, r.original_path) for r in good.collect()) == [("j1", 2, "/b"), ("j2", 1, "/a")]
    assert sorted(r.line for r in bad.collect()) == [4, 5, 6, 7, 8, 10]


def test_state_folder(spark, tmp_path):
    one_id, other = "20240131-235959-999999", "20240201-000000-000000"
    assert StateFolder({"XDG_STATE_HOME": ""}, "/h/").root == "/h/.local/state/sieveworks"
    assert StateFolder({"XDG_STATE_HOME": "~/s"}, "/h").root == "/h/s/sieveworks"
    assert not StateFolder({"XDG_STATE_HOME": "~x"}, "/h").is_absolute
    own = StateFolder({"XDG_STATE_HOME": str(tmp_path)}, "/h")
    for bad in ("../../etc/passwd", "", one_id + "\n"):
        with pytest.raises(ValueError):
            own.file("scans", bad)
    own.save("similar-scans", one_id, {"pairs": []})
    own.save("similar-scans", other, {"pairs": []})
    own.save("similar-decisions", one_id, {"a|b": "keep_both"})
    own.save_renames(one_id, ["/x"])
    assert own.load("similar-renames", one_id) == {"format_version": 1, "name_from": ["/x"]}
    own.save_renames(other, [])
    assert own.load("similar-renames", other) is None and own.ids("similar-scans") == [other, one_id]
    assert own.delete_scan("similar-scans", one_id) and not own.delete_scan("similar-scans", one_id)
    assert own.ids("similar-scans") == [other] and own.ids("similar-renames") == [] == own.ids("similar-decisions")
    own.check_journal(one_id)
    assert own.ids("journal") == []
    assert own.append_journal(one_id, []) == 0 and own.append_journal(one_id, [moved("/a"), moved("/b")]) == 2
    own.append_restored(one_id, "/a", "t")
    good, bad = documents.read_journal(spark, own.file("journal", one_id))
    assert [(r.line, r.original_path) for r in good.collect()] == [(2, "/b")] and bad.isEmpty() and own.ids("journal") == [one_id]


def test_presence_snapshots(tmp_path):
    own, one_id = PresenceSnapshots(str(tmp_path)), "20240131-235959-999999"
    assert own.load(one_id) is None and not own.forget(one_id) and own.load("../x") is None
    first = open(own.save(one_id, "t", {"b": True, "a": False})).read()
    assert first == open(own.save(one_id, "t", {"a": False, "b": True})).read() and own.load(one_id) == ("t", {"a": False, "b": True})
    (tmp_path / f"{one_id}.json").write_text("[]")
    assert own.load(one_id) is None and own.forget(one_id)


def test_caches(spark, tmp_path):
    salt, path = caches.pipeline_salt(32, 1), str(tmp_path / "c")
    assert salt != caches.pipeline_salt(32, 2) and caches.pipeline_salt() == "cbf29ce484222325"
    of = lambda *rows: spark.createDataFrame(rows, caches.PERCEPTUAL_ROW)
    row = lambda inode, hashes, n, s=salt: (1, inode, 5, 7, 0, "image", hashes, s, n)
    caches.append(of(row(2, [1], 1), row(1, [1], 2), row(3, [], 3), row(4, [1], 4, "other"), row(None, [1], 5)), None, path)
    known = caches.perceptual_hashes(spark.read.schema(caches.PERCEPTUAL_ROW).parquet(path), salt)
    caches.append(of(row(1, [1], 6), row(2, [9], 7), row(3, [3], 8)), known, path)
    assert spark.read.parquet(path).count() == 7  # the row that says nothing new is not written
    caches.compact(spark, path, caches.PERCEPTUAL_ROW, salt)
    assert [(r.inode, r.hashes) for r in spark.read.parquet(path).coalesce(1).collect()] == [(1, [1]), (2, [9]), (3, [3])]
    assert os.listdir(tmp_path) == ["c"]
    files = spark.createDataFrame([(1, 1, 5, 7, 0, "image"), (1, 1, 5, 7, 0, "video"), (None, 1, 5, 7, 0, "image")], "volume bigint, inode bigint, size bigint, mtime_ns bigint, generation bigint, kind string")
    assert sorted((r.volume or 0, r.kind, r.hashes) for r in caches.probe_hashes(files, spark.read.parquet(path)).collect()) == [(0, "image", None), (1, "image", [1]), (1, "video", None)]


def test_dry_run_gate():
    flow = gate.DryRunGate()
    assert flow.advance("dry run", "f") is None and flow.advance("apply") is None
    flow.edited(True)
    with pytest.raises(PermissionError):
        flow.authorise("f")
    assert flow.advance("dry run", "f") == "dry run done"
    flow.authorise("f")
    with pytest.raises(PermissionError):
        flow.authorise("g")
    flow.edited(True)
    assert not flow.allows("apply")
    flow.advance("dry run", "f")
    assert flow.advance("apply") == "scanned" and flow.advance("rescan") == "scanned" and not flow.has_decisions


def test_disposers(tmp_path):
    def broken(path):
        raise gate.DisposalError("failed", path)

    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(folder)
    put = gate.fallback(broken, gate.quarantine(str(tmp_path / "q"), "s"))
    a, b = (str(tmp_path / k / "x.txt") for k in "ab")
    assert put(a) == (a, str(tmp_path / "q/s/x.txt"), "quarantine", 1) and not os.path.exists(a)
    want = hashlib.sha256(b"b").hexdigest()
    for expected, path, kind in (({}, b, "content changed"), ({b: "0"}, b, "content changed"), ({a: want}, a, "missing")):
        with pytest.raises(gate.DisposalError) as e:
            gate.verifying(put, expected)(path)
        assert e.value.kind == kind
    assert gate.verifying(put, {b: want})(b)[1] == str(tmp_path / "q/s/x-2.txt")
    assert gate.free_name("/x", lambda p: True) is None


def test_watcher_opens_a_replaced_folder(spark, tmp_path):
    seen, told, into = [], streams.Progress(), tmp_path / "in"

    def start():
        rows = spark.readStream.schema("k int").json(str(into))
        return rows.writeStream.foreachBatch(lambda b, n: seen.extend(r.k for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()

    into.mkdir()
    (into / "a.json").write_text('{"k": 1}')
    spark.streams.addListener(told)
    watcher = streams.Watcher(str(into), start)
    try:
        watcher.query.processAllAvailable()
        assert not watcher.check()
        into.rename(tmp_path / "old")
        assert not watcher.check()
        into.mkdir()
        (into / "b.json").write_text('{"k": 2}')
        assert watcher.check() and watcher.restarts == 1
        watcher.query.processAllAvailable()
    finally:
        watcher.stop()
    assert seen == [1, 2]
    for _ in range(100):
        if told.snapshot()["ended"] == 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(told)
    assert told.snapshot() | {"batches": 0} == {"started": 2, "ended": 2, "batches": 0, "rows": 2}


def test_walk(spark, tmp_path):
    (tmp_path / "d" / ".git").mkdir(parents=True)
    (tmp_path / "d" / "a").write_text("x")
    (tmp_path / "d" / "empty").write_text("")
    (tmp_path / ".h").write_text("x")
    os.symlink(tmp_path / "d" / "a", tmp_path / "link")
    rows, skipped, closed = walk.walk(str(tmp_path))
    assert [os.path.basename(r[0]) for r in rows] == ["a"] and closed == []
    assert skipped == {"ignored name": 1, "below minimum": 1, "hidden": 1, "symlink": 1}
    assert walk.root_state(str(tmp_path)) == "ok" and walk.root_state(str(tmp_path / "no")) == "missing"
    assert walk.listing(spark, str(tmp_path)).count() == 1
    assert walk.digests(spark, str(tmp_path / "d")).where("size = 1").count() == 1


def test_phash():
    assert bin(phash.image_hash(np.full((40, 50), 7)) & (2**64 - 1)).count("1") == 1
    blocks = np.kron(np.random.default_rng(5).integers(0, 200, (8, 8)), np.ones((4, 4)))
    assert phash.image_hash(blocks) == phash.image_hash(blocks + 20)  # a shift changes the first coefficient alone
    x = np.random.default_rng(1).random(32)
    k = np.arange(32)
    assert np.allclose(phash.dct2(x), [(x * np.cos(np.pi * (2 * k + 1) * i / 64)).sum() for i in range(32)])


def test_simulation_stops():
    assert review.simulate(["failed"] * 25) == ([(0, "failed")] * 20, True)
    assert review.simulate(["failed"] * 19 + ["moved"] + ["failed"] * 19)[1] is False
    assert review.fnv1a(b"") == 0xCBF29CE484222325


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (5.0,)], "s double").select(F.timestamp_millis((F.col("s") * 1000).cast("bigint")).alias("ts"))
    assert sorted(r.events for r in streams.debounced(events).collect()) == [1, 3]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1, "v": 2, "seq": 1}\n{"k": 1, "v": 3, "seq": 2}\n')
    stream = spark.readStream.schema("k int, v int, seq int").json(str(tmp_path / "in"))
    streams.upsert(stream, str(tmp_path / "out"), ["k"], "seq", str(tmp_path / "ck")).awaitTermination()
    assert [(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 3)]


def test_ranked_numbers_all_rows(spark):
    from sieveworks.operators.ordering import ranked

    df = spark.range(500).select((F.col("id") % 7).alias("x"), "id").repartition(5)
    got = [(r["rank"], r.x, r.id) for r in ranked(df, F.desc("x"), F.asc("id")).orderBy("rank").collect()]
    assert got == [(k + 1, x, i) for k, (x, i) in enumerate(sorted(((i % 7, i) for i in range(500)), key=lambda r: (-r[0], r[1])))]


def test_apply_outcomes_equal_the_simulation(spark):
    rng = np.random.default_rng(5)
    rows = [(p, k, str(rng.choice(["failed", "refused", "moved"], p=[0.9, 0.08, 0.02]))) for p in range(6) for k in range(90)]
    got = review.apply_outcomes(spark.createDataFrame(rows, "plan int, seq int, outcome string")).orderBy("plan", "seq").collect()
    stopped = 0
    for p in range(6):
        done, stop = review.simulate([o for q, _, o in rows if q == p])
        stopped += stop
        assert [(r.batch, r.outcome) for r in got if r.plan == p and r.reached] == done
    assert stopped


def test_undo_plan(spark):
    from sieveworks.operators.library import plan_undo

    entries = [
        (1, 1, "trash", "/a/f", "/t/f", "df", False), (1, 2, "rename", "/a/n", "/a/f", "dn", False),  # the rename took the trashed file's name
        (1, 3, "trash", "/a/g", "/t/g", "dg", True), (1, 4, "trash", "/a/h", "/t/h", "dh", False), (1, 5, "trash", "/a/i", "/t/i", "di", False), (1, 6, "trash", "/x/j", "/t/j", "dj", False),
        (1, 7, "trash", "/a/k", "/t/k", "dk", False), (1, 8, "trash", "/a/l", "/t/l", "dl", False), (1, 9, "trash", "/a/m", "/t/m", "dm", False), (1, 10, "trash", "/a/o", "/t/o", "do", False),
        (2, 1, "rename", "/a/q", "/a/r", "dq", False), (2, 2, "rename", "/a/p", "/a/q", "dp", False),
    ]
    there = [("/a", None, True), ("/t/f", "df", False), ("/a/f", "dn", False), ("/a/g", "dg", False), ("/a/h", "dh", False), ("/a/i", "other", False), ("/t/j", "dj", False), ("/t/l", None, False), ("/t/m", "edited", False), ("/a/o", None, True), ("/a/q", "dp", False), ("/a/r", "dq", False)]
    e = spark.createDataFrame(entries, "session bigint, seq bigint, mechanism string, original string, resulting string, digest string, restored boolean")
    got = {(r.session, r.seq): (r.step, r.state) for r in plan_undo(e, spark.createDataFrame(there, "path string, digest string, is_directory boolean")).collect()}
    assert got[1, 2] == (0, "restore") and got[1, 1] == (1, "restore")
    states = ["already restored", "already restored", "original occupied", "parent missing", "moved file missing", "unverifiable", "content changed", "original is a directory"]
    assert [got[1, k][1] for k in range(3, 11)] == states
    assert got[2, 2] == (0, "restore") and got[2, 1] == (1, "restore")  # the newest first frees the older one's name


def test_free_names(spark):
    arrivals = [(1, "a.txt"), (2, "a.txt"), (3, "a.txt"), (4, "b"), (5, "b"), (6, "b-2"), (7, ".x"), (8, ".x"), (9, "c.txt")]
    df = spark.createDataFrame(arrivals, "k int, name string")
    there = spark.createDataFrame([("a-2.txt",), ("c.txt",), ("c-2.txt",)], "name string")
    got = {r.k: r.unique_name for r in similar.free_names(df, there, ["k"]).collect()}
    assert got == {1: "a.txt", 2: "a-3.txt", 3: "a-4.txt", 4: "b", 5: "b-3", 6: "b-2", 7: ".x", 8: ".x-2", 9: "c-3.txt"}


def test_free_names_beyond_a_thousand(spark):
    df = spark.range(2500).select(F.col("id").alias("k"), F.lit("a.txt").alias("name"))
    there = spark.createDataFrame([("a.txt",), ("a-3.txt",), ("a-1500.txt",), ("a-20000.txt",), ("a-02.txt",)], "name string")
    free = [f"a-{n}.txt" for n in range(2, 3000) if n not in (3, 1500)]
    assert {r.k: r.unique_name for r in similar.free_names(df, there, ["k"]).collect()} == dict(enumerate(free[:2500]))


def test_next_free_id_and_codecs(spark):
    at = F.to_timestamp(F.lit("2024-01-31 23:59:59.999999"))
    taken = F.array(F.lit("20240131-235959-999999"))
    assert one(spark, values.next_free_id(at, taken)) == "20240201-000000-000000"
    assert one(spark, values.next_free_id(at, taken, limit=1)) is None
    assert one(spark, values.codec_name(F.lit("HEV1"))) == "hevc" and one(spark, values.codec_efficiency(F.lit("Av01"))) == 3.0
    assert one(spark, paths.tilde(F.lit("~x/a"), F.lit("/h"))) == "~x/a" and one(spark, paths.trimmed(F.lit("//"))) == "/"
