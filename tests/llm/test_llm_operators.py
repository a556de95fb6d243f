"""Each operator against a brute-force version, and on odd tables: nulls, empty and long texts, ties,
repeated rows, no rows, and extra columns whose names clash with the operators' own."""

import collections
import glob
import hashlib
import itertools
import math
import os
import random
import time
import uuid
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import bpe, embedding_dedup, exact_dedup, language_id, line_dedup, linking, minhash_dedup, mixing, pii, ppm, queries, sharding
from sieveworks.llm.common import maybe_in

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, a string, n int, key string, comp int, size int, tile int, uid int"


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [
        (1, "One small text of words.\nA second line of it here.", "en", "s1"), (2, None, "en", "s1"), (3, "", "fr", None), (4, "   \n\t ", None, "s2"), (5, long, "en", "s1"),
        (6, "One small text of words.\nA second line of it here.", "en", "s1"), (7, "Été à la plage, où êtes vous donc allés hier soir?", "fr", "s2"), (None, "no id at all in here", "en", "s1"),
        (8, "漢字 かな 12345 !!!", None, "s2"), (8, "漢字 かな 12345 !!!", None, "s2"), (9, "x" * 50000, "en", "s3"), (10, "<|endoftext|> and <|endof", "en", "s3"), (11, "123 456", None, None),
    ]
    return [(*r, len(r[1] or ""), 1, "a", 2, "k", 3, 4, 5, 6) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def odd_path(odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    odd.write.parquet(path)
    return path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_sql_of_queries(spark):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        found = con.execute(sql)
        columns = [x[0] for x in found.description]
        assert sorted(columns) == sorted(df.columns)
        mine = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
        assert mine == sorted(repr(tuple(r)) for r in found.fetchall())


def test_bitmap_lets_all_keys_through(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("k"))
    some = rows.where("k % 7 = 0")
    found = maybe_in(rows, "k", some, "k")
    assert found.columns == ["k"]
    assert {r.k for r in some.collect()} <= {r.k for r in found.collect()}
    assert maybe_in(rows, "k", some.limit(0), "k").count() == 0


def test_bitmap_flags_the_keys_alone(spark):
    from sieveworks.llm.common import in_bitmap

    keys = spark.createDataFrame([(k,) for k in (*range(0, 70_000, 7), *range(64))], "k bigint")
    found = in_bitmap(spark.range(70_000), "id", keys, "k", "flag").where("flag").toPandas()["id"]
    assert sorted(found) == sorted({*range(0, 70_000, 7), *range(64)})


# 1 line dedup


def line_brute_force(rows):
    """rows: (doc_id, text) in order; the texts that are left."""
    occurrences = [(k, i, n) for k, (_, t) in enumerate(rows) for i, n in enumerate(line_dedup.normalised_lines(t or "")) if len(n.split()) >= line_dedup.MIN_WORDS]
    nodes = list(dict.fromkeys(n for _, _, n in occurrences))
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(nodes)), 2):
        if edit_distance(nodes[i], nodes[j]) <= int(max(len(nodes[i]), len(nodes[j])) * (1 - line_dedup.EDIT) + 1e-9):
            parent[root(nodes[i])] = root(nodes[j])
    seen, gone = {}, collections.defaultdict(set)
    for k, i, n in occurrences:
        group = root(n)
        if group in seen and (rows[k], i) != seen[group]:
            gone[k].add(i)
        seen.setdefault(group, (rows[k], i))
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, (_, t) in enumerate(rows)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def test_edit_alike_equals_levenshtein():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = "".join(rng.choice(list("abc "), rng.integers(0, 40)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            b.insert(rng.integers(0, len(b) + 1), rng.choice(list("abc")))
        b = "".join(b)
        assert line_dedup.edit_alike(a, b) == (edit_distance(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9))


def test_edits_within_equals_edit_alike(monkeypatch):
    rng = np.random.default_rng(4)
    left, right = [], []
    for k in range(1200):
        a = "".join(rng.choice(list("abcde fg漢\U0001f600"), rng.integers(0, (40, 200, 700)[k % 3])))
        b = list(a)
        for _ in range(rng.integers(0, len(a) // 8 + 2)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 3))] = list(rng.choice(list("abcz"), rng.integers(0, 3)))
        left, right = [*left, a], [*right, "".join(b)]
    want = [line_dedup.edit_alike(a, b) for a, b in zip(left, right)]
    assert 200 < sum(want) < 1000
    for few in (0, 16):  # with 0, all are compared together
        monkeypatch.setattr(line_dedup, "FEW", few)
        assert line_dedup.edits_within(left, right).tolist() == want


def test_banded_distance_equals_levenshtein(monkeypatch):
    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    monkeypatch.setattr(line_dedup, "_quickly_aligned", lambda *_: False)
    monkeypatch.setattr(line_dedup, "_grams_allow", lambda *_: True)
    some = random.Random(5)
    for _ in range(2000):
        a = "".join(some.choice("abc") for _ in range(some.randint(0, 30)))
        b = "".join(some.choice(("", x, x, x, x + "c", "b")) for x in a)
        edit = some.choice((0.9, 0.8, 0.5, 0.2))
        assert line_dedup.edit_alike(a, b, edit) == (levenshtein(a, b) <= int(max(len(a), len(b)) * (1 - edit) + 1e-9)), (a, b, edit)


def test_few_edits_near_each_other_need_no_alignment(monkeypatch):
    def never(*_):
        raise AssertionError

    for name in ("_quickly_aligned", "_grams_allow", "_in_band"):
        monkeypatch.setattr(line_dedup, name, never)
    text = " ".join(f"word{i}" for i in range(900))
    assert line_dedup.edits_within([text] * 3, [text.replace("word450", "other"), text.replace("word0", ""), text]).tolist() == [True] * 3


def test_quick_alignment_never_claims_too_few_edits():
    rng = np.random.default_rng(3)
    said = 0
    for _ in range(400):
        a = "".join(rng.choice(list("abc de"), rng.integers(1, 90)))
        b = list(a)
        for _ in range(rng.integers(0, 10)):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 3))] = list(rng.choice(list("abcz"), rng.integers(0, 3)))
        b = "".join(b)
        most = len(a) // 8
        found = line_dedup._quickly_aligned(a, b, most)
        said += found
        assert not found or edit_distance(a, b) <= most
    assert said > 100


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"], 18)) for _ in range(4)]
    lines = [b.replace("alpha", f"alph{k}", 1) if k % 3 else b + "s" * (k % 4) for b in base for k in range(9)] + ["Ti.", "", "a b c", "A,  b: C!", "a b 1", "a b 2"]
    rows = [(i, "\n".join(rng.choice(lines, 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for small in (64, 2):  # with 2, most buckets are compared inside tasks
        monkeypatch.setattr(line_dedup, "SMALL", small)
        got = [r.text for r in line_dedup.dedup_lines(df).orderBy("doc_id").collect()]
        assert got == line_brute_force(rows)


def test_line_dedup_finds_small_edits(spark):
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, rng.integers(3, 9)))
    lines = []
    for n in [6, 8, 12, 20, 40, 80] * 10:
        words = [word() for _ in range(n)]
        at = int(rng.integers(n))
        changed = [*words[:at], words[at][:-1] + rng.choice(letters), *words[at + 1 :]] if n < 20 else [*words[:at], word()[: len(words[at])], *words[at + 1 :]]
        lines.append((" ".join(words), " ".join(changed)))
    assert all(line_dedup.edit_alike(x, y) for x, y in lines)
    rows = [(i, x) for i, x in enumerate([*(x for x, _ in lines), *(y for _, y in lines)])]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.text for r in out] == [*(x for x, _ in lines), *([""] * len(lines))]


def test_lines_of_many_texts_are_normalised_at_once():
    def plain(text):
        lines = ["".join("0" if c in "0123456789" else " " if c in line_dedup.string.punctuation + "\t\r\x0b\x0c" else c for c in x) for x in text.lower().split("\n")]
        return [" ".join(w for w in x.split(" ") if w) for x in lines]

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aB  \n\t.7é漢Σ"), rng.integers(0, 14))) for _ in range(300)]
    assert line_dedup._normalised(texts).tobytes().decode().split("\n") == [x for t in texts for x in plain(t)]


def test_pivots_meet_once(spark, monkeypatch):
    """Of a block of several slices and tiles, every pair with a pivot is compared in one task alone; sketches are not stored."""
    own, tables, store = linking.link_blocks, [], linking.stored

    def counted(df, what):
        tables.append(what)
        return store(df, what)

    monkeypatch.setattr(line_dedup, "stored", counted)
    path = linking.stored(spark.createDataFrame([], "a bigint, b bigint"), "met")[1]

    def watched(members, verify, payload, close, **more):
        def watching(pivots, others, label, among):
            n, k, texts = len(pivots) + len(others), len(pivots), [*pivots.to_pylist(), *others.to_pylist()]
            met = [(texts[i], texts[j]) for i in range(k) for j in range(i + 1 if among else k, n)]
            os.makedirs(path.removeprefix("file://"), exist_ok=True)
            with open(f"{path.removeprefix('file://')}/{uuid.uuid4().hex}.txt", "w") as out:
                out.writelines("|".join(sorted(x)) + "\n" for x in met)
            return close(pivots, others, label, among)

        return own(members, verify, payload, watching, **more | {"small": 2, "pivots": 8, "tile": 16})

    monkeypatch.setattr(line_dedup, "link_blocks", watched)
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefghij "), 120))
    rows = [(i, base[:60] + "".join(rng.choice(list("klmnopqrst"), 30)) + base[60:]) for i in range(60)]
    line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    met = [x for p in glob.glob(f"{path.removeprefix('file://')}/*.txt") for x in open(p).read().splitlines()]
    assert met and len(met) == len(set(met)) and "sketches" not in tables


def test_hopeless_pairs_leave_the_band_early(monkeypatch):
    """Steps of a table end when all its pairs need too many edits; pairs of any kind get the same answers whatever shares their table."""
    rng = np.random.default_rng(8)
    some = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    left = [some(600) for _ in range(200)]
    right = [some(600) for _ in range(200)]
    steps, own = [], np.invert
    monkeypatch.setattr(np, "invert", lambda *a, **b: steps.append(1) or own(*a, **b))
    assert not line_dedup.edits_within(left, right).any()
    assert 0 < len(steps) < 400  # 600 columns of two words have 2400
    for k in range(300):  # like and unlike ones of many lengths
        a = some(int(rng.integers(20, 500)))
        b = list(a)
        for _ in range(int(rng.integers(0, len(a) // 8 + 1)) if k % 3 else 3 * len(a) // 10):
            b[int(rng.integers(0, len(b)))] = "z"
        left, right = [*left, a], [*right, "".join(b)]
    want = [line_dedup.edit_alike(a, b) for a, b in zip(left, right)]
    assert 50 < sum(want) < 250
    for few, cells in ((0, 48_000_000), (6, 48_000_000), (6, 100_000)):
        monkeypatch.setattr(line_dedup, "FEW", few)
        monkeypatch.setattr(line_dedup, "CELLS", cells)
        assert line_dedup.edits_within(left, right).tolist() == want


def test_block_keys_are_mixed_at_once(monkeypatch):
    """A call for each row of the blocks, not for each row of each block."""
    calls, own = [], line_dedup.mixed
    monkeypatch.setattr(line_dedup, "mixed", lambda *a: calls.append(1) or own(*a))
    lines = [f"a line with the number {k} and some more words of its own kind" for k in range(5)]
    for kind, (run, rows) in enumerate(line_dedup.KINDS):
        calls.clear()
        sketch, keys = line_dedup.sketched(lines, kind)
        assert len(calls) == rows + 1 and keys.shape == (5, line_dedup.MINHASHES // rows)
        for b in range(keys.shape[1]):  # the keys of a block, by themselves
            key = np.zeros(5, np.uint64)
            for odd in line_dedup._ODD[b * rows : (b + 1) * rows]:
                key = own(key * np.uint64(3) + np.array([min(_run_hashes(x, run) * odd) for x in lines], np.uint64), 2 * b + kind)
            assert (key == keys[:, b]).all()


def _run_hashes(text, run):
    x = np.array([ord(c) for c in text], np.uint32)
    h = np.zeros(len(x) - run + 1, np.uint32)
    for k in range(run):
        h = h * np.uint32(0x9E3779B1) + x[k : len(x) - run + 1 + k]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def test_lines_of_one_half_hash_are_told_apart(spark, monkeypatch):
    own = line_dedup.node_hashes
    monkeypatch.setattr(line_dedup, "node_hashes", lambda lines: (np.array([7 if x.startswith(b"same half") else h for x, h in zip(lines, own(lines)[0])], np.uint64), own(lines)[1]))
    one, two = "same half of a hash, the first text of two", "same half, but another text altogether: nothing is alike"
    rows = [(1, f"{one}\nrest 1"), (2, f"{two}\nother"), (3, f"{one}\nsome"), (4, f"{two}\nmore")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: f"{one}\nrest 1", 2: f"{two}\nother", 3: "some", 4: "more"}


def test_line_dedup_takes_short_lines(spark):
    rows = [(1, "Ja.\n漢字仮名交じり文です\n\n---\nfirst"), (2, "ja\n漢字仮名交じり文です\n\n---\nsecond"), (3, "no\n今日は天気がいいから散歩しましょう"), (4, "今日は天気がいいから散步しましょう\nJA!")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.text for r in out] == [rows[0][1], "\n---\nsecond", rows[2][1], ""]


def test_line_dedup_odd(spark, odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, odd_rows()[0][1]) in got and (6, "") in got and (2, None) in got and (8, odd_rows()[8][1]) in got
    assert out.count() == odd.count()
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 2 MinHash near-dedup


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def near_brute_force(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def near_copies():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(500)]
    base = list(rng.choice(words, 90))
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.integers(0, 7)):
            own[rng.integers(0, len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    return rows + [(200 + i, " ".join(rng.choice(words, 40))) for i in range(20)] + [(300, "a b"), (301, "A  B"), (302, "a b c"), (303, ""), (304, "a b c d e"), (305, "a b c d e")]


def test_minhash_equals_brute_force(spark, texts):
    for rows in (list(texts.items()), near_copies()):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r[0]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(df, 4).collect()}
        assert got == near_brute_force(rows, 4)


def test_minhash_small_tiles(spark, monkeypatch):
    own = linking.link_blocks
    monkeypatch.setattr(minhash_dedup, "link_blocks", lambda *a, **b: own(*a, **b, small=2, tile=16, pivots=8))
    rows = near_copies()
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()}
    assert got == near_brute_force(rows, 4)


def test_rounds_keep_a_row_for_an_id(spark, monkeypatch):
    seen, store = [], linking.stored

    def counted(df, what):
        out = store(df, what)
        if what == "left":
            seen.append((out[0].count(), out[0].select("id").distinct().count()))
        return out

    monkeypatch.setattr(linking, "stored", counted)
    own = linking.link_blocks
    monkeypatch.setattr(minhash_dedup, "link_blocks", lambda *a, **b: own(*a, **b, small=2, tile=16, pivots=64))
    minhash_dedup.near_duplicates(spark.createDataFrame(near_copies(), "doc_id bigint, text string"), width=4)
    assert seen and all(rows == ids for rows, ids in seen)


def test_buckets_of_common_keys(spark):
    """Keys that most rows have, at both ends of the range, and keys of one row; small batches and several parts."""
    rng = np.random.default_rng(8)
    rows = [(i, [-1, 0, *map(int, rng.integers(-(2**63), 2**63, 3)), *([int(rng.integers(5)) + 7] if i % 2 else [])]) for i in range(-20, 300)]
    rows.append((1000, []))
    df = spark.createDataFrame(rows, "id bigint, keys array<bigint>").repartition(3)
    count = collections.Counter(k for _, keys in rows for k in keys)
    want = sorted((k, i) for i, keys in rows for k in keys if count[k] > 1)
    for parts in (None, 1, 5):
        assert sorted(map(tuple, linking.buckets(df, parts).collect())) == want
    assert linking.buckets(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", [65_536, 40])
def test_sifted_keys_are_shared(spark, monkeypatch, part):
    """Every key of two rows or more stays, also in small parts and at both ends of the range; of the others hardly any do."""
    monkeypatch.setattr(linking, "SIFTED_A_PART", part)
    rng = np.random.default_rng(9)
    common = [-(2**63), -1, 0, 2**63 - 1, *map(int, rng.integers(-(2**63), 2**63, 20))]
    rows = [(i, -i, [*map(int, rng.integers(-(2**63), 2**63, 14)), *(int(x) for x in rng.choice(common, 2, replace=False))]) for i in range(400)]
    count = collections.Counter(k for *_, keys in rows for k in keys)
    kind = "id bigint, info bigint, keys array<bigint>"
    packed, path = linking.stored(spark.createDataFrame(rows, kind).repartition(3).mapInArrow(linking.as_rows, "id binary, info binary, keys binary"), "rows")
    found = packed.mapInArrow(linking.sifted(packed, len(rows)), kind).collect()
    assert len(found) == len({r.id for r in found}) and all(r.info == -r.id and set(r["keys"]) <= set(rows[r.id][2]) for r in found)
    got = collections.Counter(k for r in found for k in r["keys"])
    assert {k: n for k, n in got.items() if n > 1} == {k: n for k, n in count.items() if n > 1}
    assert sum(n == 1 for n in got.values()) < 0.02 * len(count)
    assert packed.limit(0).mapInArrow(linking.sifted(packed.limit(0), 0), kind).count() == 0


def test_keys_of_one_line_are_not_shuffled(spark, monkeypatch):
    """Of lines that are like no other, hardly a key is sent to the buckets, and the table of keys goes."""
    own, sent = linking.link_blocks, []

    def watched(members, *a, opened, **more):
        keys = members.mapInArrow(opened, "id bigint, info bigint, keys array<bigint>")
        sent.append((keys.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()["n"], members.inputFiles()))
        return own(members, *a, opened=opened, **more)

    monkeypatch.setattr(line_dedup, "link_blocks", watched)
    rng = np.random.default_rng(6)
    lines = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 90)) for _ in range(300)]
    rows = [(i, x) for i, x in enumerate([*lines, lines[0][:40] + "Q" + lines[0][41:]])]
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {i: int(i == 300) for i in range(301)}
    (n, files), = sent
    assert 2 <= n < 0.05 * 16 * 301 and files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_shuffle_files_go_with_their_query(spark):
    """stored() leaves no shuffle files that only the driver's garbage collection would remove, and leaves the session's setting alone."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, tops = spark.conf.get(name, None), [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for top in tops for p in glob.glob(f"{top}/*/shuffle_*")}
    old = files()
    held = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table, _ = linking.stored(held, "sums")
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.2)
    assert not files() - old and table.count() == held.count() == 1000
    assert spark.conf.get(name, None) == before


def test_large_buckets_take_one_turn(spark, monkeypatch):
    """Keys of the members of open buckets are unpacked once, not once in each round of a few pivots."""
    seen, store = collections.Counter(), linking.stored

    def counted(df, what):
        seen[what] += 1
        return store(df, what)

    monkeypatch.setattr(linking, "stored", counted)
    own = linking.link_blocks
    monkeypatch.setattr(minhash_dedup, "link_blocks", lambda *a, **b: own(*a, **b, small=2, tile=16, pivots=4))
    rows = near_copies()
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()}
    assert got == near_brute_force(rows, 4) and seen["active"] == 1


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for j in (0.8, 0.9, 0.97):
        both = rng.integers(0, 2**64, 2000, dtype=np.uint64)
        k = int(2000 * (1 - j) / (1 + j))
        a, b = both.copy(), both.copy()
        a[:k], b[:k] = rng.integers(0, 2**64, (2, k), dtype=np.uint64)
        x, y = (minhash_dedup.odd_sketch(minhash_dedup.samples(s)) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= minhash_dedup.most_differing_bits(0.8)


def test_minhash_odd(odd):
    got = {(r[0], *tuple(r)[1:]) for r in minhash_dedup.near_duplicates(odd, 4).collect()}
    assert {(2, 0, 2, True), (3, 0, 3, True), (6, 8, 1, False), (1, 8, 1, True), (8, 1, 8, True)} <= {g for g in got}
    assert sum(g[0] is None and g[2] is None for g in got) == 1
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


# 3 sharding


@pytest.mark.parametrize("n", [1, 2, 3, 41, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    y = sharding.permute(x, n)
    assert sorted(y) == list(x) and (sharding.permute(y, n, inverse=True) == x).all()


def test_shards(docs, odd):
    for df in (docs, odd):
        rows = sharding.feistel_shards(df, 7).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert len(rows) == df.count() and all(sorted(s) == list(range(len(s))) for s in by.values())
        assert max(map(len, by.values())) - min(len(by[k]) for k in range(7)) <= 1
    place = {r.doc_id: (r.size, r.text_crc32) for r in sharding.feistel_shards(odd).collect()}
    text = b"<|endoftext|> and <|endof"
    assert place[2] == (16, 0) and place[10] == (16 + len(text), zlib.crc32(text))
    order = sorted(docs.select("doc_id").collect())
    expected = sharding.permute(np.arange(len(order)), len(order))
    assert {r.doc_id: r.position for r in sharding.feistel_shards(docs).collect()} == {d.doc_id: p for d, p in zip(order, expected.tolist(), strict=True)}
    assert sharding.feistel_shards(odd.limit(0)).count() == 0


# 4 mixing


def test_mixing_meets_targets(docs):
    out = mixing.mix(docs, power=1.0, keep=0.5)
    r = out.agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("x"), F.sum("n_tokens").alias("n")).first()
    assert r.x == pytest.approx(0.5 * r.n)
    assert out.agg(F.max(F.abs(F.col("mix_weight") - 1))).first()[0] < 1e-6  # present shares are met by present weights


def test_mixing_copies_meet_targets(spark):
    rng = np.random.default_rng(3)
    kinds = [("s%d" % s, lang, text) for s in range(3) for lang in ("en", "fr") for text in ("some words of prose", "under the license of", "write to a@b.example")]
    p = np.array([(s + 1) ** 3 * (5 if lang == "en" else 1) * t for s in range(3) for lang in ("en", "fr") for t in (20, 2, 1)], float)
    rows = [(i, *kinds[k]) for i, k in enumerate(rng.choice(len(kinds), 20000, p=p / p.sum()))]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")).persist()
    assert out.where("probability = 1").count() > 0  # drawing alone cannot meet these targets
    total = out.agg(F.sum(F.col("n_tokens") * F.col("copies")) / F.sum("n_tokens")).first()[0]
    assert total == pytest.approx(mixing.KEEP, rel=0.02)
    for axis in mixing.AXES:
        found = out.groupBy(axis).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("copies")).alias("c")).collect()
        power, copied = sum(r.t**mixing.POWER for r in found), sum(r.c for r in found)
        for r in found:
            assert r.c / copied == pytest.approx(r.t**mixing.POWER / power, abs=0.01)


def test_mixing_odd(spark, odd, odd_path):
    out = mixing.mix(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd_path}/*.parquet')")
    expected = {(i, n, d) for i, _, _, _, n, _, _, d in con.execute(mixing.oracle()).fetchall()}
    assert {(r.doc_id, int(r.n_tokens), r.drawn) for r in out.collect()} == expected
    assert mixing.mix(odd.limit(0)).count() == 0


# 5 language identification


def test_models_are_distributions():
    rng = np.random.default_rng(1)
    sample = [(lang, "".join(rng.choice(list(a), 3000))) for lang, a in (("x", "abc de"), ("y", "cdefg ")) for _ in range(4)]
    model = language_id.KneserNey(sample)
    alphabet = sorted({ord(c) for _, t in sample for c in t})
    for context in ("abc", "dde", "zzz", "   "):
        window = np.array([*map(ord, context), 0], np.uint64)
        p = np.zeros(2)
        for c in [*alphabet, 0x4E00]:
            window[3] = c
            p += np.exp(model._log(window, np.array([3]), language_id.ORDER)[0].astype(np.float64))
        assert p == pytest.approx([1, 1], abs=1e-4)


def test_held_out_accuracy(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in language_id.op5_language_id(spark, SF).collect() if r.held_out]
    assert len(out) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    assert all(r.accepted and 0 <= r.score <= 1 for r in out)


def test_language_odd(docs, odd):
    model = language_id.fit(docs)
    out = language_id.identify(odd, model)
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].lang_pred for k in (2, 3, 4, 11)] == ["und"] * 4 and not got[2].accepted and got[2].score == 0
    assert got[7].lang_pred == "fr" and got[8].lang_pred != "und"
    assert not model.predict(["漢字かな交じり文 " * 20])[3][0]  # a few letters are not enough to reject
    assert out.count() == odd.count() and language_id.identify(odd.limit(0), model).count() == 0
    assert language_id.fit(odd.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


# 6 pseudonyms


def test_pseudonyms():
    own, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", inverse=True)
    text = "Ask Ann.Lee7@mail3.example.com, +1 (017) 555-7713, 4111 1111 1111 1111, 10.20.30.40, 2024-02-29, 31/12/1999, 123-45-6789, DE89 3704 0044 0532 0130 00; token = \"" + "0a" * 20 + '"'
    new, counts = own.replace(text)
    assert counts == dict.fromkeys(pii.KINDS, 1) | {"date": 2}
    assert back.replace(new)[0] == text  # octets may be longer or shorter, all else keeps its length
    for old in ("Ann.Lee7", "555-7713", "4111", "10.20.30.40", "2024-02-29", "31/12/1999", "123-45", "3704", "0a0a"):
        assert old not in new
    card = new.split(", ")[2]
    assert pii.luhn(card.replace(" ", "")) and own.replace("4111111111111111")[0] == card.replace(" ", "")
    for clean in ("4111 1111 1111 1112", "999.1.1.1", "2023-02-29", "000-12-3456", "v1.2.3.4.5", "12345", "a@b", "1/2"):
        assert own.replace(clean)[0] == clean
    assert pii.Pseudonyms(b"other").replace(text)[0] != new


def test_pseudonyms_of_more_dates():
    own, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", inverse=True)
    for text in ("2024-02-29T10:00:00Z", "2024/02/29", "29-02-2024", "02-29-2024", "9-2-2024", "on 2024-02-29T10:00 and 2024/12/31."):
        new, counts = own.replace(text)
        assert counts["date"] == text.count("202") and "2024-02-29" not in new and new != text
        assert back.replace(new)[0] == text
    assert own.replace("2024/02/29")[0].replace("/", "-") == own.replace("2024-02-29")[0] == own.replace("2024-02-29T10:00:00Z")[0][:10]
    for clean in ("2023/02/29", "30-02-2024", "2024-02-29T", "2024-02-29Tag", "1-2-3-2024", "2024/02/29/1"):
        assert own.replace(clean)[0] == clean


@pytest.mark.parametrize("n", [2, 3, 10, 1000])
def test_pseudonyms_are_permutations(n):
    own, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", inverse=True)
    out = [own.permute(x, n, "t") for x in range(n)]
    assert sorted(out) == list(range(n)) and [back.permute(y, n, "t") for y in out] == list(range(n))


def test_equal_values_stay_linked_in_any_form():
    p = pii.Pseudonyms()
    digits = lambda t: "".join(c for c in t if c.isdigit())
    one, two, three = (p.replace(t)[0] for t in ("+44 20 7946 0958", "+442079460958", "+44 (20) 7946 0958"))
    assert digits(one) == digits(two) == digits(three) != "442079460958" and one.startswith("+44 ")
    y, m, d = p.replace("2024-02-29")[0].split("-")
    assert [p.replace(t)[0] for t in ("29/02/2024", "02/29/2024", "29.02.2024", "2024/02/29")] == [f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{d}.{m}.{y}", f"{y}/{m}/{d}"]
    text, n = p.replace('api_key = "sk_live_51Habc9XYZ123" and internationalization2')
    assert n["secret"] == 1 and "51Habc9XYZ123" not in text and text.endswith("internationalization2") and pii.Pseudonyms(inverse=True).replace(text)[0].startswith('api_key = "sk_live_51Habc9XYZ123"')


def test_bytes_that_are_no_utf8(spark):
    rows = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62' as string)").alias("text"))
    assert [r.text for r in pii.pseudonymise(rows).collect()] == ["a\ufffdb"]
    assert bpe.encode_documents(rows).count() == minhash_dedup.near_duplicates(rows).count() == 1


def test_pseudonyms_odd(odd):
    out = pii.pseudonymise(odd)
    assert out.columns == [*odd.columns, "n_pii", *(f"n_{k}" for k in pii.KINDS)]
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter((r.doc_id, r.text) for r in odd.collect())
    assert pii.pseudonymise(odd.limit(0)).count() == 0


# 7 prediction by partial matching


def naive_model(rows):
    """A function (context, symbol) -> probability, with dictionaries of contexts, the oldest byte first."""
    tries = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    for t, train in rows:
        x = [ppm.END] * ppm.ORDER + list(b" ".join((t or "").encode().lower().split())) + [ppm.END]
        for i in range(ppm.ORDER, len(x)) if train else ():
            tries[ppm.ORDER][tuple(x[i - ppm.ORDER : i])][x[i]] += 1
    for k in range(ppm.ORDER - 1, -1, -1):  # shorter contexts count distinct longer ones
        for context, node in tries[k + 1].items():
            for s in node:
                tries[k][context[1:]][s] += 1
    cell = lambda k, n, q: int(ppm.escape_class(k, np.array([n]), np.array([q]))[0])
    new, known = collections.Counter(), collections.Counter()
    for k, trie in enumerate(tries):
        for node in trie.values():
            n, q = sum(node.values()), len(node)
            for c in node.values() if n > 1 else ():
                (new if c == 1 else known)[cell(k, n - 1, q - (c == 1))] += c
    memo = {}

    def spread(context):
        if context not in memo:
            k = len(context)
            below = spread(context[1:]) if k else np.full(ppm.SYMBOLS, 1 / ppm.SYMBOLS)
            if node := tries[k].get(context):
                n, q = sum(node.values()), len(node)
                e = (new[cell(k, n, q)] + 0.5) / (new[cell(k, n, q)] + known[cell(k, n, q)] + 1)
                rest = below.copy()
                rest[list(node)] = 0
                below = rest / rest.sum() * e
                for s, c in node.items():
                    below[s] = c / n * (1 - e)
            memo[context] = below
        return memo[context]

    return spread


def naive_scores(rows):
    """(n_tokens, n_known, N, base, score) by (text, train); plain dictionaries and loops."""
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = collections.Counter(w for t, train in rows if train for w in tokens(t))
    total, kinds, spread, result = sum(counts.values()), len(counts), naive_model(rows), []
    for t, _ in rows:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        x = [ppm.END] * ppm.ORDER + list(b" ".join(words[:-1])) + [ppm.END]
        score = sum(math.log10(spread(tuple(x[i - ppm.ORDER : i]))[x[i]]) for i in range(ppm.ORDER, len(x)))
        result.append((len(words), sum(counts[w] > 0 for w in words), total, base, score))
    return result


def test_ppm_equals_naive(spark, texts, monkeypatch):
    monkeypatch.setattr(ppm, "MERGE_KEYS", 3000)
    ids = sorted(texts, key=lambda i: len(texts[i] or ""))[:60]
    rows = [(texts[i], zlib.crc32(str(i).encode()) % 5 != 1) for i in ids] + [("a" * 300 + " ÿÿ z", True), (None, False), ("", True), ("word order matters here", True), ("here order matters word", False)]
    df = spark.createDataFrame([(i, t, x, i % 3) for i, (t, x) in enumerate(rows)], "doc_id int, text string, train boolean, block bigint")
    got = {r.doc_id: r for r in ppm.ppm_scores(df).collect()}
    for i, (n_tokens, n_known, total, base, score) in enumerate(naive_scores(rows)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, total, not rows[i][1])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert got[len(rows) - 2].score > got[len(rows) - 1].score  # contexts cross words


def test_ppm_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(list(b"abc "), 400)) for _ in range(3)]
    grams, n = np.unique(ppm.grams_of(texts)[0], return_counts=True)
    orders = ppm.orders_of(grams, n, ppm.ORDER, ppm.SHARED)
    short = orders[0].below(ppm.SHARED - 1)
    low, escape = ppm.fit_low(short.grams, short.n, np.sum([o.events(k) for k, o in enumerate(orders, ppm.SHARED)], axis=0))
    for context in [*(grams[:: len(grams) // 20] >> np.uint64(8)), np.uint64(0x7A7A7A7A7A), np.uint64(0x617A7A7A7A)]:
        every = context << np.uint64(8) | np.arange(256, dtype=np.uint64)
        assert (10.0 ** ppm.log10_of(every, grams, n, low, escape)).sum() == pytest.approx(1)


def test_ppm_odd(odd):
    flagged = odd.withColumns({"train": F.lit(True), "block": F.lit(None).cast("bigint")})
    got = {r.doc_id: r for r in ppm.ppm_scores(flagged).collect()}
    assert got[2].n_tokens == got[3].n_tokens == 1 and got[2].score == got[3].score < 0
    assert ppm.ppm_scores(flagged.limit(0)).count() == 0
    untrained = ppm.ppm_scores(flagged.withColumn("train", F.lit(False))).collect()
    assert {(r.train_tokens, r.n_known) for r in untrained} == {(0, 0)} and all(math.isfinite(r.score) for r in untrained)


# 8 BPE


def odd_texts():
    rng = np.random.default_rng(8)
    parts = ["a", "B", "12", " ", "  ", "\n", "\t", "!", "'s", "é", "漢", "<|endoftext|>", "<|endof", " ", "\x1c", "😀", " the", "\u0085"]
    return ["".join(rng.choice(parts, rng.integers(0, 3000))) for _ in range(40)] + ["x" * 20000, "漢字" * 5000, "", "\n" * 4000, " " * 3000 + "x"]


def test_bpe_equals_library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    for own in (odd_texts(), list(texts.values())):
        coder = bpe.Encoder(bpe.RANKS, bpe.SPECIAL, reuse_chars=50_000)
        expected = [x.ids for x in library.encode_batch(own, add_special_tokens=False)]
        got = [x.tolist() for x in coder.encode_all(own)]
        assert got == expected and [coder.decode(np.array(x, np.uint32)) for x in got] == own
        assert [library.decode(x, skip_special_tokens=False) for x in got] == own


def test_bpe_reuses_chunks():
    coder = bpe.Encoder(bpe.RANKS, {})
    text = " ".join(f"word{i * i % 7919}" for i in range(20000))
    coder.encode_all([text])
    once = coder.encoded_chars
    coder.encode_all(["A new start. " + text])
    assert coder.encoded_chars - once < 0.2 * once


def test_bpe_leaves_workers_to_other_operators():
    from sieveworks.llm import batches

    coder = bpe.encoder()
    batches.release("bpe")
    assert bpe.encoder() is coder
    batches.release()
    assert not batches.held("bpe") and bpe.encoder() is not coder


def test_bpe_odd(odd):
    got = {r.doc_id: r for r in bpe.encode_documents(odd, with_ids=True).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, none, none) == (got[3].n_tokens, got[3].ids_sha256, got[3].decoded_sha256)
    assert got[10].ids[0] == 50256 and bpe.encode_documents(odd.limit(0)).count() == 0
    assert bpe.encode_documents(odd).count() == odd.count()


# 9 exact dedup


def copies(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    best = {t: max((i for i in v if i is not None), default=None) for t, v in by.items()}
    return collections.Counter((i, best[t or ""], len(by[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda text: F.substring(F.sha2(text, 256), 1, 1)])
def test_exact_dedup_equals_brute_force(spark, odd, odd_path, docs, digest):
    """The second digest has one hexadecimal digit, so equal digests of different texts abound."""
    for path, df in ((odd_path, odd), (f"{SF}/documents.parquet", docs)):
        got = exact_dedup.streaming_exact_dedup(spark, path, digest=digest, files_per_batch=1)
        assert collections.Counter(tuple(r) for r in got.collect()) == copies([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    path, state = str(tmp_path / "t.parquet"), str(tmp_path / "state")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(path)
    assert exact_dedup.digest_state(spark, path, checkpoint=state).count() == 2
    spark.createDataFrame([(3, "a")], "doc_id long, text string").write.mode("append").parquet(path)
    got = exact_dedup.digest_state(spark, path, checkpoint=state)
    assert sorted((r.keep_id, r.group_size) for r in got.collect()) == [(2, 1), (3, 2)]


def test_exact_dedup_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e.parquet"))
    assert exact_dedup.streaming_exact_dedup(spark, str(tmp_path / "e.parquet")).count() == 0


# 10 embedding near-dedup


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(scale=0.25, size=16)], i % 2) for i in range(300)]
    rows += [(400 + i, rows[3][1], rows[3][2]) for i in range(40)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, rows[0][1], None), (505, [1.0, 2.0], 0), (506, [2.0, 4.0], 0), (507, [], 0), (508, [float("inf")] * 16, 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.9, tile_rows=32).collect()}
    sound = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = collections.defaultdict(set)
    for (i, v, x), (j, w, y) in itertools.combinations(sound, 2):
        if x == y and len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.9:
            links[i].add(j)
            links[j].add(i)
    label = {r[0]: r[0] for r in rows}
    for _ in range(len(rows)):
        new = {i: min([label[i], *(label[j] for j in links[i])]) if i is not None else None for i in label}
        if new == label:
            break
        label = new
    assert got == {i: (len(links[i]), label[i], label[i] == i) for i in label}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
