"""Queries that leave out nothing, against brute force on small tables with what the driver's lack."""

import re

import pytest

from lodestone.plans.catalog import QUERIES


def test_keywords_on_lines_beyond_ascii(spark, tmp_path):
    text = "with from\nfa\u00e7ade with WITH\n\u00e9with with\u00e9\nfrom \u6f22\u5b57\n\nwithout\nwith\u00e9 with"
    rows = [(1, text, "en", "s"), (2, "plain from", "fr", "s"), (3, None, "fr", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.path, r.keyword, r.line, r.n) for r in QUERIES["keyword_occurrences"](spark, str(tmp_path)).collect()}
    want = set()
    for i, t, lang, source in rows:
        for line, x in enumerate((t or "").split("\n"), 1):
            for k in ("with", "from"):
                if n := len(re.findall(rf"\b{k}\b", x, re.IGNORECASE)):
                    want.add((f"{source}/{lang}/doc_{i}.txt", k, line, n))
    assert got == want and ("s/en/doc_1.txt", "with", 2, 2) in got


def slow_levels(edges):
    """Kahn's algorithm: the longest way to each node that is not on or behind a cycle."""
    left, level, now = set(edges), {}, 0
    nodes = {x for e in edges for x in e}
    while free := {x for x in nodes - level.keys() if x not in {b for _, b in left}}:
        level |= dict.fromkeys(free, now)
        left = {e for e in left if e[0] not in free}
        now += 1
    return level, nodes


@pytest.mark.parametrize("last, back", [(400, False), (130, True)])
def test_graphs_of_whole_tables(spark, tmp_path, last, back):
    spark.createDataFrame([(k,) for k in range(last)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    links = [(k % 40, 1000 + k) for k in range(300)] + [(1000, 1041)] + [(1041, 0)] * back  # folded modulo 20 both have cycles
    spark.createDataFrame(links, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    want, nodes = slow_levels([(k // 3, k) for k in range(1, last)])
    assert set(want) == nodes == set(range(last))
    for name in ("bfs_levels", "topo_levels"):
        assert {r.node: r.level for r in run(name)} == want
    found, nodes = slow_levels(links)
    assert {r.graph: r.is_dag for r in run("is_dag")} == {"tree": True, "links": set(found) == nodes} == {"tree": True, "links": not back}


def test_lines_with_mock_are_scored(spark, tmp_path):
    spark.createDataFrame([(1, "plain\na Mock here\na test here", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.line: (r.score, r.relevance) for r in QUERIES["context_score"](spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 3} and got[1] == (1.0, 1.0) and got[3] == (1.8, 0.5)
    assert got[2][0] == 1.8


def test_conversations_with_fences(spark, tmp_path):
    said = ["plain", "look:\n```\ncode\n```\nend", "```json\n{}\n```", "a ``` b"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.block for r in QUERIES["extract_fenced_block"](spark, str(tmp_path)).collect()}
    assert got == {i: re.search(r"```json\n(.*?)\n```", f"```json\n{t}\n```", re.DOTALL)[1] for i, t in enumerate(said)}
