"""Indexes, retrieval, reading modes, ends of blocks, ranks and the shared folder, on tables of our own."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.operators import chunks, graph, rank, search, spans, symbols, vectors
from lodestone.plans import index
from lodestone.sources import shared, store, workspace

FILES = "path string, content string"


def table(spark, rows):
    return spark.createDataFrame(rows, FILES)


def test_reading_modes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes(b"x\xe9y")
    (tmp_path / "c.txt").write_bytes(b"z" * 100)
    workspace.register(spark)
    read = lambda **o: {r.path: (r.content, r.encoding, r.error is not None) for r in spark.read.format("workspace").options(maxFileSize=50, **o).load(str(tmp_path)).collect()}
    assert read() == {"a.txt": ("é", "utf-8", False), "b.txt": ("xéy", "latin-1", False), "c.txt": (None, None, True)}
    assert read(errors="ignore")["b.txt"] == ("xy", "utf-8", False)
    assert read(errors="strict")["b.txt"] == (None, None, True)


def test_index_is_built_once(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    files = table(spark, [("a.py", "class A(B):\n    def first(self):\n        return 'some longer body of a method here'\n" * 3), ("b.md", "words about trees and rivers\n" * 50), ("c.exe", "not shown " * 20)])
    made = index.build(files, path)
    assert made["built"] and made["files"] == 2 and sum(made["by_type"].values()) == made["chunks"] == sum(made["by_language"].values())
    assert made["tokens"] > 100
    stored = spark.read.parquet(path).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in stored) and len({r.id for r in stored}) <= made["chunks"]
    assert index.build(files, path) == {k: v for k, v in made.items() if k != "tokens"} | {"built": False}
    fewer = index.build(files, path, pattern="*.md", force=True)
    assert fewer["built"] and fewer["files"] == 1 and index.status(spark, path) == {"exists": True, "chunks": fewer["chunks"]}
    best = index.find(spark, path, "trees and rivers", 1).first()
    assert best.path == "b.md" and len(best.preview) <= 203
    with pytest.raises(ValueError):
        index.build(files, f"{path}2", pattern="*.none")
    assert index.stats(spark, f"{path}3")["chunks"] == 0 and not index.status(spark, f"{path}2")["exists"]


def test_retrieval(spark):
    files = table(spark, [("src/a.py", "def cache():\n    pass\n"), ("src/test_a.py", "cache cache\n"), ("b.txt", "nothing"), ("node_modules/c.py", "cache " * 9), ("d.txt", None)])
    got = [r.path for r in rank.retrieve(files, "where is the cache").collect()]
    assert sorted(got) == ["src/a.py", "src/test_a.py"]
    assert [r.path for r in rank.retrieve(files, "cache", category="test").collect()] == ["src/test_a.py"]
    assert [r.path for r in rank.retrieve(files, "cache", pattern="**/a.py").collect()] == ["src/a.py"]
    with pytest.raises(ValueError):
        rank.retrieve(files, " ")
    twice = rank.rank_files(table(spark, [("x.txt", "cache"), ("x.txt", "cache")]), "cache").collect()
    assert len(twice) == 2 and twice[0].score == twice[1].score  # rows with one path don't multiply


def test_preview_texts(spark):
    files = table(spark, [("a", "one\ntwo\na cache here\nfour\nfive\nsix"), ("b", "p\nq\nr\ns"), ("c", "cache\n" * 30)])
    got = {r.path: r.preview for r in rank.preview_text(files, "cache").collect()}
    assert got["a"] == "Match in general_code (line 3):\n  two\n  a cache here\n  four\n  five\n---"
    assert got["b"] == "p\nq\nr..." and len(got["c"].split("\n")) == 15


def test_first_rows_say_if_there_are_more(spark):
    files = table(spark, [(f"f{i}.py", "x") for i in range(5)])
    for limit, more in ((3, True), (5, False), (9, False), (None, False)):
        got = search.find_files(files, "*", limit=limit, flag=True).collect()
        assert len(got) == min(5, limit or 5) and all(r.truncated is more for r in got)
    grep = search.grep(files, "x", limit=2, flag=True).collect()
    assert [(r.path, r.truncated) for r in grep] == [("f0.py", True), ("f1.py", True)]


def test_replacing_and_writing(spark, tmp_path):
    files = table(spark, [("a.py", "x y x y x"), ("b.py", "z"), ("c.exe", "x")])
    got = {r.path: tuple(r)[1:] for r in search.replace_in_files(files, "x", "!", 2).collect()}
    assert got["a.py"] == ("x y ! y x", 1, 3, None) and got["b.py"][:3] == ("z", 0, 0) and "not there" in got["b.py"][3] and "occurrence 2 of 1" in got["c.exe"][3]
    assert {r.path: r.replaced for r in search.replace_in_files(files, "x", "!").collect()} == {"a.py": 3, "b.py": 0, "c.exe": 1}
    out = {r.path: r.error is None for r in store.save_versions(files, f"file://{tmp_path}/v").collect()}
    assert out == {"a.py": True, "b.py": True, "c.exe": False}
    assert {r.path for r in spark.read.parquet(f"{tmp_path}/v").collect()} == {"a.py", "b.py"}


def test_embedding_is_tried_again(spark, tmp_path):
    def shaky(texts):
        marker = tmp_path / "failed"
        if not marker.exists():
            marker.touch()
            raise OSError("no answer")
        return vectors.hashed_embedding(texts, 8)

    chunks_ = spark.createDataFrame([("1", "some text"), ("2", None)], "id string, content string").coalesce(1)
    got = vectors.embed(chunks_, shaky, pause=0.01, usage=True).collect()
    assert sorted((r.id, len(r.embedding), r.tokens) for r in got) == [("1", 8, 2), ("2", 8, 0)]
    with pytest.raises(Exception, match="2 texts, 1 vectors"):
        vectors.embed(chunks_, lambda texts: [[1.0]]).collect()


def test_table_functions(spark):
    registry.register_sql(spark)
    table(spark, [("a.py", "class A(B):\n    def first(self):\n        return 1\n"), ("b.py", "def broken(:\n"), ("c.txt", "words " * 20), ("d.py", None)]).createOrReplaceTempView("some_files")
    got = spark.sql("SELECT path, s.name, s.type, s.start_line FROM some_files, LATERAL symbols_of(path, content) s").collect()
    assert {tuple(r) for r in got} == {("a.py", "A", "class", 1), ("a.py", "first", "method", 2), ("b.py", "broken", "function", 1)}
    assert {r.path for r in spark.sql("SELECT path, c.* FROM some_files, LATERAL chunks_of(path, content) c").collect()} >= {"c.txt"}
    assert [r.path for r in chunks.split_errors(spark.table("some_files")).collect()] == ["b.py"]


def test_policy_in_searches(spark):
    files = table(spark, [("a.py", "x"), ("node_modules/x.py", "x"), ("a.exe", "x"), ("b/Makefile", "x")])
    assert {r.path for r in search.find_files(files, "*").collect()} == {"a.py", "b/Makefile"} == {r.path for r in search.grep(files, "x").collect()}
    assert [r.path for r in search.too_large(files.withColumn("content", F.repeat("content", F.when(F.col("path") == "a.py", 9).otherwise(1))), 5).collect()] == ["a.py"]
    assert {r.path for r in search.find_files(files, ["a*", "*.py"]).collect()} == {"a.py"}


def test_line_ranges(spark):
    files = table(spark, [("a", "1\n2\n3")])
    view = lambda *a: tuple(search.view_range(files, *a).first())[1:4]
    assert view(2) == (2, 2, "2") and view(-5, 2) == (1, 2, "1\n2") and view(2, 9) == (2, 3, "2\n3") and view(4) == (None, None, None)
    assert "beyond" in search.view_range(files, 4).first().error


SOURCE = '''class A(B):
    """Several
    lines"""

    def first(self,
              x):
        """One line."""
        # a comment
        if x:
            y = (1
        )
            z = 2
        w = [
    ]
    , more
        return y


        left = 1
    def second(self): pass
    x = 3
import os
def third(a):
\t"""Text
def not_code(): pass
"""
\treturn a
after = 1
'''


def test_ends_of_blocks():
    lines = spans.Lines(SOURCE)
    assert spans.class_end(lines, 1) == 21  # before the import
    assert spans.function_end(lines, 5) == 19  # a return, and the next definition within its reach
    assert spans.function_end(lines, 23) == 27
    assert spans.block_end(lines, 9) == 12 and spans.block_end(lines, 20) == 21
    flat = spans.Lines("def f():\n" + "    x = 1\n" * 300)
    assert spans.function_end(flat, 1) == 51 and spans.block_end(flat, 1) == 31 and spans.class_end(flat, 1) == 201
    short = spans.Lines("def f():\n    return 1\n" + "    a\n" * 9)
    assert spans.function_end(short, 1) == 4  # a return and what may clean up behind it


def test_broken_python_is_found_by_its_lines(spark):
    files = table(spark, [("a.py", SOURCE), ("b.py", "def third(x):\n    return x\n")])
    got = {(r.path, r.name, r.type, r.start_line, r.end_line, r.parent_name) for r in symbols.symbols(files, fallback=True).collect()}
    assert {("a.py", "A", "class", 1, 21, None), ("a.py", "first", "method", 5, 19, "A"), ("a.py", "second", "method", 20, 21, "A"), ("b.py", "third", "function", 1, 2, None)} <= got
    assert sorted(r.path for r in symbols.find_function(files, "third").collect()) == ["a.py", "b.py"]
    assert [r.content.split("\n")[0].strip() for r in symbols.view_spans(files, ["A.second"]).collect()] == ["def second(self): pass"]
    assert [(r.path, r.name) for r in symbols.symbols(files).where("error is not null").collect()] == [("a.py", None)]


def test_pagerank_settles_or_raises(spark):
    rng = np.random.default_rng(2)
    links = {(int(a), int(b)): float(rng.integers(1, 5)) for a, b in rng.integers(0, 12, (40, 2)) if a != 11}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src long, dst long, weight double")
    nodes = sorted({x for e in links for x in e})
    m = np.zeros((len(nodes), len(nodes)))
    for (a, b), w in links.items():
        m[nodes.index(b), nodes.index(a)] = w
    m = np.where(m.sum(axis=0) > 0, m / np.maximum(m.sum(axis=0), 1e-12), 1 / len(nodes))
    want = np.full(len(nodes), 1 / len(nodes))
    for _ in range(200):
        want = 0.15 / len(nodes) + 0.85 * m @ want
    got = {r.node: r.rank for r in graph.pagerank(edges).collect()}
    assert np.allclose([got[n] for n in nodes], want, atol=1e-5)
    with pytest.raises(RuntimeError):
        graph.pagerank(edges, rounds=1)
    assert graph.pagerank(edges.limit(0)).collect() == []


def test_communities_are_a_partition_that_pays(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 60, (150, 2)) if a != b] + [(100 * g + i, 100 * g + j, 5.0) for g in range(1, 4) for i in range(5) for j in range(i)]
    edges = spark.createDataFrame(links, "src long, dst long, weight double")
    of = {r.node: r.community for r in graph.communities(edges, most=8).collect()}
    assert set(of) == {x for a, b, _ in links for x in (a, b)}
    sizes = [list(of.values()).count(c) for c in set(of.values())]
    assert max(sizes) <= 8
    assert all(len({of[100 * g + i] for i in range(5)}) == 1 for g in range(1, 4))
    total, degree = sum(w for *_, w in links), {n: 0.0 for n in of}
    for a, b, w in links:
        degree[a] += w
        degree[b] += w
    gain = lambda member: sum(w for a, b, w in links if member[a] == member[b]) / total - sum((sum(degree[n] for n in member if member[n] == c) / (2 * total)) ** 2 for c in set(member.values()))
    assert gain(of) > gain({n: n for n in of}) and gain(of) > gain(dict.fromkeys(of, 0))


def test_shared_folder():
    def session(folder, known, master="spark://host"):
        option = SimpleNamespace(isDefined=lambda: known is not None, get=lambda: known)
        inner = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, applicationId="app", _jsc=inner))

    assert shared.base_folder(session("hdfs://x/y/", None)) == "hdfs://x/y/lodestone-app"
    assert shared.base_folder(session(None, "s3://b/c")) == "s3://b/c/lodestone-app"
    assert shared.base_folder(session(None, None, "local[2]")).startswith("file:///")
    with pytest.raises(RuntimeError):
        shared.base_folder(session(None, None))
