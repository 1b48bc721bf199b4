"""Duplicates and near copies against comparing every two texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import checks, lists, quality, rules, sketches


def _shingles(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _groups(rows, similar=0.8):
    sets = [_shingles(t) for _, _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both >= similar * len(sets[i] | sets[j]) or (rows[i][2] is not None and rows[i][2] == rows[j][2]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i, (repo, path, _) in enumerate(rows):
        out.setdefault(find(i), []).append((repo, path))
    return sorted((f, min(g), len(g)) for g in out.values() if len(g) > 1 for f in g)


def test_near_copies_equal_all_pairs(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(12)]
    for _ in range(110):
        own = r.choice(texts).split()
        for _ in range(r.randint(0, 2)):
            own[r.randrange(len(own))] = r.choice(words)
        texts.append(" ".join(own))
    texts += ["", " ", "one", "one", texts[3]]
    rows = [(f"r{i % 2}", f"f{i:03}.py", t) for i, t in enumerate(texts)]
    found = quality.near_copies(spark.createDataFrame(rows, "repo string, file_path string, content string"))
    got = sorted(((x["repo"], x["file_path"]), (x["first_repo"], x["first_path"]), x["files"]) for x in found.collect())
    expected = [x for x in _groups(rows)]
    assert got == expected


def _counted(monkeypatch):
    """How many pairs each comparison gets."""
    seen = []
    compared = quality._compared
    monkeypatch.setattr(quality, "_compared", lambda pairs, *rest: seen.append(pairs.count()) or compared(pairs, *rest))
    return seen


def test_a_large_group_takes_few_comparisons(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{r.randrange(2000)}" for _ in range(400)]
    rows = []
    for i in range(400):
        own = list(base)
        own[r.randrange(400)] = f"x{i}"
        rows.append((f"f{i:04}", " ".join(own)))
    seen = _counted(monkeypatch)
    found = quality.near_copies(spark.createDataFrame(rows, "file_path string, content string"))
    assert [(x["first_path"], x["files"]) for x in found.select("first_path", "files").distinct().collect()] == [("f0000", 400)]
    assert len(seen) <= lists.ROUNDS + 1 and sum(seen) < 400 * 20


@pytest.mark.parametrize("files", [40, 160, 2000])
def test_unlike_files_under_one_header(spark, monkeypatch, files):
    """A header of two thirds of every text brings no comparisons that grow with the square of the files."""
    r = random.Random(6)
    header = " ".join(f"license{i}" for i in range(120))
    rows = [(f"f{i:04}", header + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for i in range(files)]
    rows.append(("twin", rows[3][1] + " more"))
    seen = _counted(monkeypatch)
    found = quality.near_copies(spark.createDataFrame(rows, "file_path string, content string").repartition(3))
    assert sorted((x["file_path"], x["first_path"], x["files"]) for x in found.collect()) == [("f0003", "f0003", 2), ("twin", "f0003", 2)]
    assert len(seen) <= lists.ROUNDS + 1 and sum(seen) <= 5


def test_rounds_and_order_never_change_the_groups(spark, monkeypatch):
    """Chains, stragglers and several groups in a list, however many rounds there are and whatever is frequent."""
    r = random.Random(8)
    rows, own = [], [f"c{i}" for i in range(60)]
    for i in range(60):  # a chain: each is near the next only
        own = own[1:] + [f"d{i}"] if i % 2 else [f"e{i}"] + own[:-1]
        rows.append(("r", f"chain{i:02}", " ".join(own)))
    shared = [f"s{i}" for i in range(40)]
    rows += [("r", f"mix{i:02}", " ".join(shared[: 30 + i % 11] + [f"m{i % 6}{j}" for j in range(i % 14)])) for i in range(60)]
    r.shuffle(rows)
    expected = _groups(rows)
    files = spark.createDataFrame(rows, "repo string, file_path string, content string")
    for rounds, few, often in ((0, 0, 4), (1, 0, 2), (4, 10**9, 4), (4, 0, 10**9)):
        monkeypatch.setattr(quality, "OFTEN", often)
        monkeypatch.setattr(lists, "FEW", few)
        members = quality.near_lists(sets := quality.stored(files.selectExpr("xxhash64(file_path) AS text", "content").mapInArrow(quality._shingled, "text long, shingles array<long>"), "test-sets"))
        groups = lists.list_components(members, quality._fits(0.8), lambda pairs: quality._compared(pairs, sets, 0.8), rounds=rounds)
        named = files.selectExpr("xxhash64(file_path) AS node", "file_path").join(groups, "node", "left").selectExpr("coalesce(root, node) AS root", "file_path").collect()
        found = {}
        for x in named:
            found.setdefault(x["root"], []).append(x["file_path"])
        assert sorted((f, min(g), len(g)) for g in found.values() if len(g) > 1 for f in g) == [(f[1], g[1], n) for f, g, n in expected]


def test_no_files(spark):
    assert quality.near_copies(spark.createDataFrame([], "file_path string, content string")).isEmpty()


def test_equal_paths_of_two_repositories_stay_apart(spark, rows):
    files = spark.createDataFrame([(r, "a.py", f'import b\npassword = "hunter22{r}"') for r in ("x", "y")] + [("x", "b.py", "import a")], "repo string, file_path string, content string")
    assert rows(rules.security_findings(files), "repo", "file_path") == [("x", "a.py"), ("y", "a.py")]
    assert rules.security_scores(files).count() == 3
    assert rows(quality.refactor_suggestions(files).filter("category = 'error handling'"), "repo", "file_path") == [("x", "a.py"), ("x", "b.py"), ("y", "a.py")]
    assert rows(checks.import_degrees(files.withColumnRenamed("content", "source_code"))) == [("x", "a.py", 1, 1), ("x", "b.py", 1, 1), ("y", "a.py", 0, 0)]
    same = files.withColumn("content", F.lit("same"))
    assert rows(quality.duplicate_code(same), "copies", "first_repo", "first_path") == [(3, "x", "a.py")]


def test_only_sets_of_paired_texts_move(spark, rows, monkeypatch):
    own = {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5, 6], 3: [1, 2, 9], 4: [7, 8]}
    sets = quality.stored(spark.createDataFrame(list(own.items()), "text long, shingles array<long>"), "test-sets")
    pairs = quality.stored(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long"), "test-pairs")
    for most in (quality.TRAVEL_TEXTS, 0):
        monkeypatch.setattr(quality, "TRAVEL_TEXTS", most)
        near = quality._compared(pairs, sets, 0.8)
        assert rows(near) == [(1, 2)]
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join LeftSemi") == 2 and plan.count("strategy=broadcast") == (2 if most else 0)


def _some_alike(r, groups=12):
    """Threes of texts that share half of their words, so that they meet in lists but aren't near, a near pair, and a text that comes twice."""
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    texts = [" ".join(shared + words(30)) for shared in (words(30) for _ in range(groups)) for _ in range(3)]
    return [(f"f{i:03}", text) for i, text in enumerate([*texts, texts[0] + " more", texts[4]])]


def test_only_sets_of_pairs_that_may_be_near_are_kept(spark, monkeypatch):
    """Neither texts nor all sets move: what meets but isn't alike is dropped by sketches, and only the sets of the other pairs are stored."""
    kept = {}
    keep = quality.stored

    def stored(df, purpose):
        out = keep(df, purpose)
        kept.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(quality, "stored", stored)
    seen = _counted(monkeypatch)
    files = spark.createDataFrame(_some_alike(random.Random(9)), "file_path string, content string")
    found = sorted((x["file_path"], x["first_path"], x["files"]) for x in quality.near_copies(files).collect())
    assert found == [("f000", "f000", 2), ("f004", "f004", 2), ("f036", "f000", 2), ("f037", "f004", 2)]
    assert sum(seen) == 1 and sum(kept["near-sets"]) == 2
    assert sum(kept["near-lists"]) > 5  # they met


@pytest.mark.parametrize("short", [1, 2, 24])
def test_lists_texts_and_marks_of_any_size_give_the_same_groups(spark, monkeypatch, short):
    """Pairs of short lists or entries of long ones, numbers or marks, a few texts together: the groups of all pairs."""
    r = random.Random(10)
    rows = [("r", path, text) for path, text in _some_alike(r, 4)]
    base = [f"b{i}" for i in range(80)]
    for i in range(30):
        own = list(base)
        own[r.randrange(80)] = f"x{i % 7}"
        rows.append(("r", f"g{i:02}", " ".join(own)))
    rows += [("r", f"e{i}", x) for i, x in enumerate(["one two", "one two", "one  two three", "", None])]
    monkeypatch.setattr(quality, "SHORT", short)
    for name, value in (("TRAVEL_TEXTS", 0), ("MARKS", 64), ("TOGETHER", 5), ("REMEMBERED", 3)):
        monkeypatch.setattr(quality, name, value)
    found = quality.near_copies(spark.createDataFrame(rows, "repo string, file_path string, content string").repartition(3))
    got = sorted(((x["repo"], x["file_path"]), (x["first_repo"], x["first_path"]), x["files"]) for x in found.collect())
    assert got == _groups(rows)


def test_lists_go_on_over_batches():
    """What meets doesn't depend on where batches end, and a repeated entry counts once."""
    entries = [(1, 1), (2, 1), (2, 2), (3, 1), (3, 1), (4, 1), (4, 1), (4, 2), (4, 5), (5, 1), (5, 2), (5, 3), (5, 4), (5, 6), (6, 3), (6, 9)]
    rows = [{"list": x, "node": y, "n": 10, "place": 0, "often": False} for x, y in entries] + [{"list": 9, "node": 1, "n": 10, "place": 0, "often": True}]
    expected = {(None, 1, 2), (None, 1, 5), (None, 2, 5), (None, 3, 9), (9, 1, None), *((5, x, None) for x in (1, 2, 3, 4, 6))}
    for size in (1, 2, 3, 5, 17):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size]) for i in range(0, len(rows), size)]
        met = [x for batch in quality._scanned(batches, 0.8, 3) for x in batch.to_pylist()]
        assert {(x["list"], x["node"], x["other"]) for x in met} == expected


def test_sketches_never_drop_near_sets():
    r = np.random.default_rng(3)
    for n in (1, 9, 700, 1024, 3000, 9000):
        hashes = r.integers(-(1 << 63), (1 << 63) - 1, 2 * n)
        one = hashes[:n]
        for changed in {0, n // 9, n}:
            other = np.concatenate([one[: n - changed], hashes[n : n + changed]])
            apart = max(sketches.bits_apart(f(one), f(other)) for f in (sketches.sketch_of, sketches.wide_sketch_of) if f(one) is not None)
            assert apart <= 2 * changed
            if 8 < changed == n:
                assert not sketches._enough(2 * n, apart, 0.8)
            if n - changed >= 0.8 * (n + changed):
                assert sketches._enough(2 * n, apart, 0.8)
