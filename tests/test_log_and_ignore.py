"""The snapshot log with rival and killed writers; ignore rules against a plain walk."""

import fnmatch
import random
import threading

import pytest

from skein.sources.ignore import ignored, rules_of
from skein.sources.log import Conflict, SnapshotLog


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_two_writers_and_a_killed_one(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"))
    table = lambda *x: {"files": spark.createDataFrame([(i,) for i in x], "n long")}
    first, how = log.ensure("s1", lambda: table(1, 2))
    assert how == "built" and first.version == 1
    # both saw version 1; the second to commit must look again
    a, b = log.stage("s2", table(3)), log.stage("s3", table(4))
    killed = log.stage("s4", table(9))  # never committed
    assert log.commit("s2", a, seen=first).version == 2
    with pytest.raises(Conflict):
        log.commit("s3", b, seen=first)
    assert log.commit("s3", b, seen=log.manifest()).current == "s3"
    # a reader that pinned a version reads on
    assert rows(log.read("files", version=1)) == [(1,), (2,)] and rows(log.read("files")) == [(4,)] and rows(log.read("files", snapshot="s2")) == [(3,)]
    with pytest.raises(KeyError):
        log.read("files", snapshot="s4")
    assert log.recover(older_than=3600) == []  # its writer may be at work
    assert log.recover(older_than=-1) == [killed.split("/")[1]]
    assert rows(log.read("files", version=1)) == [(1,), (2,)]
    # reuse: a complete snapshot is activated, not built
    again, how = log.ensure("s1", lambda: pytest.fail("built again"))
    assert how == "activated" and again.current == "s1" and rows(log.read("files")) == [(1,), (2,)]
    assert log.ensure("s1", lambda: pytest.fail("built again"))[1] == "current"
    log.drop("s2")
    with pytest.raises(ValueError):
        log.drop("s1")
    with pytest.raises(KeyError):
        log.activate("s2")
    assert log.recover(older_than=-1, keep=1) == [a.split("/")[1]] and rows(log.read("files")) == [(1,), (2,)]


def test_many_writers_at_once(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"))
    folder = log.stage("s", {"t": spark.range(1)})
    wrong = []

    def write(i):
        try:
            log.commit(f"s{i}", folder)
        except Exception as error:
            wrong.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and log.latest() == 6 and set(log.manifest().snapshots) == {f"s{i}" for i in range(6)}


def test_repair(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"))
    log.commit("s", log.stage("s", {"t": spark.range(1)}), {"parse": "ready", "dense": "building", "graph": "failed"})
    built = []

    def broken(snapshot):
        raise OSError

    assert log.repair({"dense": built.append, "graph": broken, "parse": broken}) == ["dense"] and built == ["s"]
    assert log.manifest().views["s"] == {"parse": "ready", "dense": "ready", "graph": "failed"}
    assert log.repair({"graph": built.append}) == []  # once for each process
    assert SnapshotLog(spark, str(tmp_path / "log")).repair({"graph": built.append}) == ["graph"]


# --- ignore files ------------------------------------------------------------


def plain_ignored(path, files):
    """Node by node, rule by rule, from the first folder down."""
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        node, folder = "/".join(parts[:depth]), depth < len(parts)
        verdict = None
        for name in (".ignore", ".gitignore"):
            for up in range(depth - 1, -1, -1):
                top = "/".join(parts[:up])
                text = files.get(f"{top}/{name}" if top else name)
                inside = "/".join(parts[up:depth])
                for line in reversed((text or "").split("\n")):
                    line = line.rstrip(" ")
                    if not line or line.startswith("#"):
                        continue
                    no, line = line.startswith("!"), line.lstrip("!")
                    if line.endswith("/"):
                        if not folder:
                            continue
                        line = line.rstrip("/")
                    tail = inside if "/" in line else inside.split("/")[-1]
                    if matches(line.lstrip("/"), tail):
                        verdict = not no
                        break
                if verdict is not None:
                    break
            if verdict is not None:
                break
        if verdict:
            return node
    return None


def matches(glob, path):
    globs, parts = glob.split("/"), path.split("/")

    def go(i, j):
        if i == len(globs):
            return j == len(parts)
        if globs[i] == "**":
            if i == len(globs) - 1:
                return j < len(parts)
            return any(go(i + 1, k) for k in range(j, len(parts) + 1))
        return j < len(parts) and fnmatch.fnmatchcase(parts[j], globs[i]) and go(i + 1, j + 1)

    return go(0, 0)


def test_ignore_rules(spark):
    rng = random.Random(2)
    names = ["a", "b", "build", "x.log", "y.log", "keep.log", "z.txt", "a+b", "c[1]"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(400)})
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
    globs = ["*.log", "!keep.log", "/build", "build/", "a/*.txt", "**/b/a", "a/**", "!a/b", "a/**/z.txt", "?.log", "[xy].log", "[!x].log", "# no", "", "a+b", "b/build/", "!x.log  ", "*"]
    for _ in range(6):
        folders = ["", "a", "a/b", "b", "build"]
        files = {(f"{f}/" if f else "") + rng.choice([".gitignore", ".ignore"]): "\n".join(rng.sample(globs[:-1], 5)) for f in rng.sample(folders, 4)}
        table = spark.createDataFrame(list(files.items()), "path string, text string")
        got = {r.path: r.by for r in ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules_of(table)).collect()}
        assert got == {p: plain_ignored(p, files) for p in paths}


def test_escaped_rules(spark):
    table = spark.createDataFrame([(".gitignore", "\\#a\n\\!b\nc\\*\nd\\?\n/\n!\n\r\n  \n")], "path string, text string")
    got = {r.path: r.ignored for r in ignored(spark.createDataFrame([(p,) for p in ("#a", "!b", "c*", "cc", "d?", "dd", "#b")], "path string"), rules_of(table)).collect()}
    assert got == {"#a": True, "!b": True, "c*": True, "cc": False, "d?": True, "dd": False, "#b": False}
