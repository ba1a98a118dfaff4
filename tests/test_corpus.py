"""Operators over a small workspace of our own, dependency documents and graphs."""

import fnmatch
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, text
from lodestone.operators import chunks, graph, rank, search, symbols, vectors
from lodestone.sources import workspace
from lodestone.streaming.increment import index_stream

FILES = {
    "src/app.py": "#!/usr/bin/env python\nimport os\n\ndef greet(name, times=1):\n    return name * times\n\n@decorate\nclass Shop(Base, other.Base):\n    def sell(self, item):\n        def inner():\n            pass\n        return item\n\n    @staticmethod\n    async def close(*args):\n        pass\n",
    "src/broken.py": "def (:\n",
    "web/view.js": "export class View extends Base {\n  draw(x) {\n    return x;\n  }\n}\nfunction start() {\n  go();\n}\nconst later = (a) => a;\n",
    "lib/Tool.java": "public class Tool {\n    public static int add(int a, int b) {\n        return a + b;\n    }\n}\n",
    ".env": "KEY=1\n",
    "node_modules/x/index.js": "x",
    "notes.bin": "no",
    "README": "TODO: one\nfixme\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("workspace")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (root / "latin.txt").write_bytes("caf\xe9\n".encode("latin-1"))
    (root / "out").symlink_to("/etc/hostname")
    return root


@pytest.fixture(scope="module")
def files(spark, folder):
    workspace.register(spark)
    return spark.read.format("workspace").load(str(folder))


def test_workspace(spark, folder, files):
    got = {r.path: r for r in files.collect()}
    assert set(got) == {*FILES, "latin.txt"}  # hidden names too; nothing from outside the root
    assert (got["latin.txt"].content, got["latin.txt"].encoding) == ("café\n", "latin-1")
    assert spark.read.format("workspace_names").load(str(folder)).count() == len(got)
    shown = {r.path for r in search.list_files(files).collect()}
    assert shown == {"src/app.py", "src/broken.py", "web/view.js", "lib/Tool.java", ".env", "README", "latin.txt"}


def test_search(files):
    hits = [(r.path, r.line, r.content) for r in search.grep(files, "todo|FIXME", limit=9).collect()]
    assert hits == [("README", 1, "TODO: one"), ("README", 2, "fixme")]
    assert search.grep(files, r"def\s+\w+", "*.py").count() == 4
    with pytest.raises(Exception):
        search.grep(files, "(", None).collect()
    lines = {r.path: r for r in search.read_lines(files, 4, 5).collect()}
    assert lines["src/app.py"].content == "def greet(name, times=1):\n    return name * times"
    assert lines["README"].error == "start is beyond the end of the file"
    found = {r.path: r.language for r in files.select("path", paths.language(F.col("path"), F.col("content")).alias("language")).collect()}
    assert (found["src/app.py"], found["web/view.js"], found["README"]) == ("python", "javascript", "unknown")


def test_symbols(files):
    got = {(r.path, r.name, r.type, r.start_line, r.end_line, r.parent_name) for r in symbols.symbols(files).where("error is null").collect()}
    assert got >= {
        ("src/app.py", "greet", "function", 4, 5, None),
        ("src/app.py", "Shop", "class", 8, 16, None),
        ("src/app.py", "sell", "method", 9, 12, "Shop"),
        ("src/app.py", "close", "method", 15, 16, "Shop"),
        ("web/view.js", "View", "class", 1, 5, None),
        ("web/view.js", "draw", "method", 2, 4, "View"),
        ("web/view.js", "start", "function", 6, 8, None),
        ("web/view.js", "later", "function", 9, 9, None),
        ("lib/Tool.java", "Tool", "class", 1, 5, None),
        ("lib/Tool.java", "add", "method", 2, 4, "Tool"),
    }
    assert not any(n == "inner" for _, n, *_ in got)
    assert symbols.symbols(files).where("error is not null").select("path").collect() == [("src/broken.py",)]
    shop = symbols.find_class(files, "app.Shop").first()
    assert (shop.base_classes, shop.decorators) == (["Base"], ["decorate"])
    close = symbols.find_function(files, "Shop.close").first()
    assert (close.is_async, close.is_static, close.parameters) == (True, True, [])
    view = symbols.view_spans(files, ["View.draw"]).first()
    assert view.content == "  draw(x) {\n    return x;\n  }"


def test_patterns_of_names():
    rng = random.Random(1)
    import re

    for _ in range(300):
        p = "".join(rng.choice("ab*?[].!/-") for _ in range(rng.randint(1, 6)))
        s = "".join(rng.choice("ab./-!") for _ in range(rng.randint(0, 5)))
        try:
            ours = bool(re.match(paths.fnmatch_regex(p).replace(r"\z", r"\Z"), s))
        except re.error:
            continue
        assert ours == fnmatch.fnmatchcase(s, p), (p, s)
    glob = lambda p, s, **k: bool(re.match(paths.glob_regex(p, **k).replace(r"\z", r"\Z"), s))
    assert glob("src/**/*.py", "src/main.py") and glob("src/**/*.py", "src/a/b.py") and not glob("src/*.py", "src/a/b.py")
    assert glob("*.py", "a/b.py", anywhere=True) and not glob("*.py", "a/b.py")


def test_splitlines(spark):
    rng = random.Random(2)
    rows = ["".join(rng.choice("ab\r\n\x0b\x0c\x1c\x85 ") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.splitlines(F.col("t")).alias("l")).collect()
    assert all(r.l == r.t.splitlines() for r in got)


def test_replace_nth(spark):
    c = F.col("t")
    d = spark.createDataFrame([("a.b.c.d",)], "t string")
    row = d.select(text.replace_nth(c, ".", "-", 2), text.replace_nth(c, ".", "-", 0), text.replace_nth(c, ".", "-", 9), text.occurrences(c, ".")).first()
    assert tuple(row) == ("a.b-c.d", "a-b-c-d", None, 3)


def test_ranking(files):
    q = rank.analyse("How to validate user_name in the test function?")
    assert q.intent == "find_function" and q.concepts == ["test"] and "UserName" in q.keywords and "the" not in q.keywords
    best = rank.rank_files(files, "find class Shop").collect()
    assert best[0].path == "src/app.py" and all(a.score >= b.score for a, b in zip(best, best[1:]))


def test_embedding(files):
    found = vectors.embed(chunks.line_chunks(files), batch=2).collect()
    assert len(found) == chunks.line_chunks(files).count() and all(len(r.embedding) == 1024 for r in found)


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (3, 2, 4.0), (2, 4, 1.0)], "src long, dst long, weight double")


def test_dependency_document(spark, tmp_path):
    doc = {"variables": ["a/x.py", "a/y.py"], "cells": [{"src": 0, "dest": 1, "values": {"Call": 2.0}}, {"src": 0, "dest": 1, "values": {"Import(possible)": 1.0, "Odd": 5.0}}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    nodes, e = graph.from_cells(spark, str(tmp_path / "d.json"))
    assert nodes.count() == 2
    assert [(r.src, r.dst, r.weight) for r in e.select("src", "dst", "weight").collect()] == [(0, 1, 8.3)]


def test_graph_levels(spark, edges):
    assert not graph.is_dag(edges) and graph.is_dag(edges.where("src <> 2"))
    assert {r.node: r.level for r in graph.topological_levels(edges.where("src <> 2 or dst = 4")).collect()} == {0: 0, 3: 0, 1: 1, 2: 2, 4: 3}
    assert {r.node: r.level for r in graph.bfs_levels(edges, spark.createDataFrame([(3,)], "node long")).collect()} == {3: 0, 2: 1, 0: 2, 4: 2, 1: 3}


def test_pagerank_with_sinks(edges):
    got = {r.node: r.rank for r in graph.pagerank(edges, tolerance=1e-9).collect()}
    e, nodes = [tuple(r) for r in edges.collect()], range(5)
    out = {n: sum(w for s, _, w in e if s == n) for n in nodes}
    r = dict.fromkeys(nodes, 0.2)
    for _ in range(200):
        lost = sum(r[n] for n in nodes if not out[n])
        r = {n: 0.15 / 5 + 0.85 * (lost / 5 + sum(r[s] * w / out[s] for s, d, w in e if d == n)) for n in nodes}
    assert sum(got.values()) == pytest.approx(1) and all(got[n] == pytest.approx(r[n], abs=1e-6) for n in nodes)


def test_communities(spark):
    rng = random.Random(4)
    rows = [(10 * g + a, 10 * g + b, 1.0) for g in range(4) for a in range(10) for b in range(10) if a < b and rng.random() < 0.8] + [(0, 10, 0.1), (10, 20, 0.1), (20, 30, 0.1)]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    got = graph.communities(e, most=12).collect()
    assert len(got) == 40 and len({r.node for r in got}) == 40
    sizes = {}
    for r in got:
        sizes[r.community] = sizes.get(r.community, 0) + 1
    assert max(sizes.values()) <= 12 and len(sizes) < 20
    assert sorted(map(tuple, graph.communities(e, most=12).collect())) == sorted(map(tuple, got))


def test_index_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a.txt", "x" * 60), ("b.txt", "short")], "path string, content string").write.parquet(str(source))
    for _ in range(2):  # a second run finds nothing new
        index_stream(spark.readStream.schema("path string, content string").parquet(str(source)), str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).count() == 1
