"""Snapshots against dictionaries of files."""

import random

import pytest

from ctxloom.operators import snapshots as S


@pytest.fixture
def repo(spark, tmp_path):
    return S.Repo(spark, str(tmp_path / "repo"))


def files(spark, d):
    return spark.createDataFrame(list(d.items()), "path string, content string")


def state(repo, commit, folder="/"):
    return {r.path: r.content for r in S.contents(repo, S.show(repo, commit, folder)).collect()}


def test_history_differences_and_restore(spark, repo):
    rng = random.Random(1)
    one = {f"/{rng.choice('abc')}/{rng.choice('xyz')}/{i}.md": f"text {i % 7}" for i in range(40)} | {"/top.md": "top", "/a/deep/er/still/f.md": ""}
    two = {p: c for p, c in one.items() if rng.random() > 0.2} | {"/new/n.md": "n", "/top.md": "changed"}
    a = S.commit(repo, files(spark, one), "one", "me", "2024-01-01")
    blobs, trees = repo.table("blobs").count(), repo.table("trees").count()
    assert blobs == len(set(one.values()))
    b = S.commit(repo, files(spark, two), "two", "me", "2024-01-02", a)
    assert repo.table("blobs").count() == len(set(one.values()) | set(two.values()))
    assert S.commit(repo, files(spark, two), "two", "me", "2024-01-02", a) == b and repo.table("commits").count() == 2
    assert repo.table("trees").count() < 2 * trees
    assert state(repo, a) == one and state(repo, b) == two and state(repo, b, "/a") == {p: c for p, c in two.items() if p.startswith("/a/")}
    assert state(repo, b, "/top.md") == {"/top.md": "changed"} and state(repo, b, "/none") == {}
    want = {p: "delete" if p not in two else "write" for p in one.keys() | two.keys() if one.get(p) != two.get(p)}
    assert {r.path: r.action for r in S.changes(repo, a, b).collect()} == want
    assert S.changes(repo, a, a).collect() == []
    same, plan = S.restore(repo, b, a, "r", "me", "2024-01-03", "/a", dry_run=True)
    assert same == b and {r.path for r in plan.collect()} == {p for p in want if p.startswith("/a/")}
    c, _ = S.restore(repo, b, a, "r", "me", "2024-01-03", "/a")
    assert state(repo, c) == {p: v for p, v in two.items() if not p.startswith("/a/")} | {p: v for p, v in one.items() if p.startswith("/a/")}
    assert S.restore(repo, c, a, "r", "me", "2024-01-04", "/a")[0] == c
    assert [(r.age, r.message, r.parent) for r in S.log(repo, c).orderBy("age").collect()] == [(0, "r", b), (1, "two", a), (2, "one", None)]
    with pytest.raises(KeyError):
        S.show(repo, "nothing")


def test_odd_files(spark, repo):
    empty = S.commit(repo, files(spark, {"/x": "y"}).limit(0), "none", "me", "2024-01-01")
    some = S.commit(repo, spark.createDataFrame([("/x", None), ("/x", "b"), ("/x", "a"), (None, "z"), ("/y/z", None)], "path string, content string"), "odd", "me", "2024-01-02", empty)
    assert state(repo, empty) == {} and state(repo, some) == {"/x": "b", "/y/z": ""}
    assert {r.path: r.action for r in S.changes(repo, some, empty).collect()} == {"/x": "delete", "/y/z": "delete"}


def test_unchanged_directories_are_not_opened(spark, repo, monkeypatch):
    base = {f"/d{i}/f{j}": "x" for i in range(20) for j in range(5)}
    a = S.commit(repo, files(spark, base), "a", "me", "2024-01-01")
    b = S.commit(repo, files(spark, base | {"/d3/f1": "y"}), "b", "me", "2024-01-02", a)
    met = []
    real = S.scratch.written
    monkeypatch.setattr(S.scratch, "written", lambda df, name: met.append(real(df, name)) or met[-1])
    assert [tuple(r) for r in S.changes(repo, a, b).collect()] == [("/d3/f1", "write")]
    assert [m.count() for m in met] == [1, 1]  # one directory, one file
