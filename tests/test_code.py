"""Chunks of code, what is kept between runs, the registry, and steps over communities."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions import text
from lodestone.operators import chunks, graph, nearest, vectors
from lodestone.plans.catalog import QUERIES
from lodestone.sources import store

LONG = "    x = 'a line that is long enough to count by itself, really'\n"
FILES = {
    "a/shop.py": 'class Shop(Base):\n    """What a shop is, on more than one line,\n    so that the quotes come up again."""\n    @mark\n    async def sell(self, item):\n    ' + LONG + "        return item\n\ndef greet(name):\n" + LONG + "    return name\n",
    "a/big.py": "def big():\n" + LONG * 60,
    "a/broken.py": "def (:\n" + LONG * 45,
    "a/plain.txt": "word " * 20,
    "a/empty.txt": " \n\t\n",
    "a/null.txt": None,
    "node_modules/x.py": LONG * 3,
}
ROWS = "path string, content string"


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    for r in chunks.code_chunks(spark.createDataFrame(list(FILES.items()), ROWS)).collect():
        out.setdefault(r.path, []).append(r)
    return out


def test_code_chunks(found):
    assert set(found) == {"a/shop.py", "a/big.py", "a/broken.py", "a/plain.txt"}
    shop = {r.chunk_type: r for r in found["a/shop.py"]}
    assert len(found["a/shop.py"]) == 3  # as many as three: no blocks of lines beside them
    assert (shop["class_header"].start_line, shop["class_header"].end_line, shop["class_header"].base_classes) == (1, 3, ["Base"])
    sell = shop["method"]
    assert (sell.name, sell.parent_name, sell.parameters, sell.decorators, sell.is_async, sell.start_line, sell.end_line) == ("sell", "Shop", ["self", "item"], ["mark"], True, 5, 7)
    assert sell.content == "\n".join(FILES["a/shop.py"].split("\n")[4:7])
    assert (shop["function"].name, shop["function"].start_line, shop["function"].end_line) == ("greet", 9, 11)


def test_code_chunks_without_definitions(found):
    kinds = [(r.chunk_type, r.name) for r in found["a/big.py"]]
    assert kinds == [("function", "big"), ("context", "context_1"), ("context", "context_2")]
    assert found["a/big.py"][0].content.endswith("\n# ... (truncated)") and len(found["a/big.py"][0].content) == 2000 + len("\n# ... (truncated)")
    assert [(r.chunk_type, r.name, r.start_line) for r in found["a/broken.py"]] == [("text_chunk", "chunk_1", 1), ("text_chunk", "chunk_2", 41)]
    assert [r.chunk_type for r in found["a/plain.txt"]] == ["text_chunk"]


def test_code_chunks_of_nothing(spark):
    assert chunks.code_chunks(spark.createDataFrame([], ROWS)).count() == 0


def test_token_parts(spark):
    body = "\n".join(["w" * 39] * 5 + ["z" * 90] + ["end"])
    got = [r.content for r in chunks.token_split(spark.createDataFrame([("i", body), ("j", "s"), ("k", None)], "id string, content string"), 20).where("id = 'i'").orderBy("part").collect()]
    assert got == ["\n".join(["w" * 39] * 2)] * 2 + ["w" * 39, "z" * 80, "z" * 10, "end"]


def test_index_is_kept(spark, tmp_path):
    path = str(tmp_path / "index")
    assert store.load_index(spark, path).count() == 0
    index = chunks.line_chunks(spark.createDataFrame([("a.txt", "x" * 60)], ROWS)).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    store.save_index(index, path)
    store.save_index(index, path, append=True)
    again = store.load_index(spark, path)
    assert again.count() == 2 and vectors.lookup(again.withColumn("at", F.monotonically_increasing_id()), [again.first().id], position="at").count() == 1
    with pytest.raises(ValueError):
        store.clear_index(spark, path)
    assert store.exists(spark, path) and store.clear_index(spark, path, confirm=True) and not store.exists(spark, path)


def test_graph_and_report_are_kept(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 2.0)], "src long, dst long, weight double")
    store.save_graph(str(tmp_path / "g"), nodes=graph.nodes_of(e), edges=e)
    back = store.load_graph(spark, str(tmp_path / "g"))
    assert set(back) == {"nodes", "edges"} and back["edges"].collect() == e.collect()
    store.write_report(spark.createDataFrame([("m", [1, 2])], "module string, nodes array<int>"), spark.createDataFrame([("@startuml",)], "t string"), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r/result.json")).first()[0]) == {"module": "m", "nodes": [1, 2]}
    assert spark.read.text(str(tmp_path / "r/graph.puml")).first()[0] == "@startuml"
    written = store.save_versions(spark.createDataFrame([("p", "é\n")], ROWS), str(tmp_path / "v")).first()
    assert tuple(written) == ("p", 2, 3, None) and spark.read.parquet(str(tmp_path / "v")).count() == 1


def test_registry(spark):
    files = spark.createDataFrame([("a.txt", "one\ntwo")], ROWS)
    assert registry.call("grep", files, pattern="TWO").collect() == [("a.txt", 2, "two")]
    with pytest.raises(ValueError, match="pattern"):
        registry.call("grep", files)
    with pytest.raises(KeyError):
        registry.call("no such", files)


def test_model_output(spark):
    rows = [('a ```json\n {"x": 1} \n``` ```plantuml\nA -> B\n```',), ("```json\n{x\n```",), (None,)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "t string").select(text.llm_output(F.col("t"))).collect()]
    assert got == [('{"x": 1}', "A -> B"), (None, None), (None, None)]


def test_isolated_in_turn(spark):
    members = spark.createDataFrame([("a/b/c", 0), ("x/y", 1)], "path string, community long")
    alone = spark.createDataFrame([("a/b/d", 1), ("q/r", 2), ("q/r/s", 3)], "path string, turn long")
    assert sorted(map(tuple, graph.assign_isolated_in_turn(alone, members, 0.5).collect())) == [("a/b/d", 0), ("q/r", 2), ("q/r/s", 2)]


def test_types_of_contracted_edges(spark):
    e = spark.createDataFrame([(0, 2, 1.0, {"a": 1.0}), (1, 2, 2.0, {"a": 2.0, "b": 1.0}), (0, 1, 9.0, {"a": 9.0}), (2, 0, 1.0, None)], "src long, dst long, weight double, types map<string,double>")
    member = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node long, community long")
    got = {(r.src, r.dst): (r.weight, r.types) for r in graph.contract_types(e, member).collect()}
    assert got == {(0, 1): (3.0, {"a": 3.0, "b": 1.0}), (1, 0): (1.0, None)}


def test_reclustering(spark):
    rows = [(10 * g + a, 10 * g + b, 1.0) for g in range(6) for a in range(5) for b in range(a)] + [(10 * g, 10 * g + 10, 0.2) for g in range(5)]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    first, again = graph.communities(e, most=5), graph.recluster(e, most=5, below=3)
    assert again.count() == first.count() == 30
    assert again.select("community").distinct().count() < first.select("community").distinct().count()
    assert again.join(first.withColumnRenamed("community", "c"), "node").groupBy("c").agg(F.countDistinct("community").alias("n")).where("n > 1").count() == 0


def slow_merging(links, most):
    """Node -> community, by the rounds of graph.communities in plain Python."""
    tie = {}
    for a, b, w in links:
        if a != b:
            tie[min(a, b), max(a, b)] = tie.get((min(a, b), max(a, b)), 0.0) + w
    total, of = sum(tie.values()), {x: x for a, b, _ in links for x in (a, b)}
    while True:
        pairs, degree, size = {}, {}, {}
        for c in of.values():
            size[c] = size.get(c, 0) + 1
        for (a, b), w in tie.items():
            x, y = sorted((of[a], of[b]))
            for c in (x, y):  # a pair within one counts twice
                degree[c] = degree.get(c, 0.0) + w
            if x != y:
                pairs[x, y] = pairs.get((x, y), 0.0) + w
        best = {}
        for (x, y), w in pairs.items():
            gain = w / total - degree[x] * degree[y] / (2 * total * total)
            if gain > 0 and size[x] + size[y] <= most:
                for me, other in ((x, y), (y, x)):
                    best[me] = min(best.get(me, (1,)), (-gain, other))
        agreed = {y: x for x, (_, y) in best.items() if x < y and best[y][1] == x}
        if not agreed:
            return of
        of = {n: agreed.get(c, c) for n, c in of.items()}


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_merging_takes_few_jobs_and_is_the_same_by_joins(spark):
    rng = random.Random(7)
    links = [(100 + s, rng.randrange(9), float(rng.randint(1, 6))) for s in range(60) for _ in range(4)]  # nine nodes that tie all others
    links += [(rng.randrange(100, 160), rng.randrange(100, 160), 1.0) for _ in range(25)] + [(7, 7, 1.0), (999, 999, 2.0)]
    e = spark.createDataFrame(links, "src long, dst long, weight double").cache()
    want = slow_merging(links, 6)
    assert {r.node: r.community for r in graph.communities(e, most=6).collect()} == want
    assert {r.node: r.community for r in graph.communities(e, most=6, in_task=0).collect()} == want
    while (n := len(set(want.values()))) >= 4:
        level = slow_merging([(want[a], want[b], w) for a, b, w in links if want[a] != want[b]], 6)
        want = {x: level.get(c, c) for x, c in want.items()}
        if len(set(want.values())) == n:
            break
    got, made = jobs(spark, "recluster", lambda: graph.recluster(e, most=6, below=4).collect())
    assert {r.node: r.community for r in got} == want and made < 40
    # above the bound the first levels are made by joins, the rest in one task
    assert {r.node: r.community for r in graph.recluster(e, most=6, below=4, in_task=150).collect()} == want
    text = e.select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"), "weight")
    assert {r.node: r.community for r in graph.communities(text, most=6).collect()} == {r.node: r.community for r in graph.communities(text, most=6, in_task=0).collect()}


def test_mean_similarity_through_parts_that_all_share(spark):
    rng = random.Random(3)
    path = lambda i: "/".join(["src", *(f"d{rng.randrange(3)}" for _ in range(rng.randrange(3))), f"e{rng.randrange(40)}", f"f{i % 90}"][: rng.randrange(1, 6)])
    alone, members = sorted({path(i) for i in range(120)}), [(path(i), i % 3) for i in range(150)]  # some members twice
    split = lambda p: set(p.strip("/").split("/"))
    want = {}
    for p in alone:
        for c in range(3):
            each = [len(split(p) & split(m)) / len(split(p) | split(m)) for m, d in members if d == c]
            if any(each):
                want[p, c] = sum(each) / len(each)
    one, two = spark.createDataFrame([(p,) for p in alone + alone[:5]], "path string"), spark.createDataFrame(members, "path string, community long")
    for few in (3, 50):
        rows = graph.mean_similarity(one, two, few).collect()
        got = {(r.path, r.community): r.similarity for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def most_rows(df):
    """The most rows that a step of a collected frame's plan has made."""

    def each(node):
        name = node.nodeName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
        children = node.children()
        n = node.metrics().get("numOutputRows")
        return max([n.get().value() if n.isDefined() else 0, *map(each, inner), *(each(children.apply(i)) for i in range(children.size()))])

    return each(df._jdf.queryExecution().executedPlan())


def test_pairs_of_similar_paths_grow_with_the_paths(spark):
    alone = spark.range(600).select(F.concat(F.lit("host/en/a"), "id").alias("path"))
    members = spark.range(600).select(F.concat(F.lit("host/en/b"), "id").alias("path"), (F.col("id") % 2).alias("community"))
    out = graph.mean_similarity(alone, members)
    assert {(r.community, r.similarity) for r in out.collect()} == {(0, 0.5), (1, 0.5)}
    assert 1200 <= most_rows(out) < 10_000  # 360,000 pairs share a host


def test_isolated_at_once_over_paths_of_one_host(spark, tmp_path):
    paths = [f"h.example/{'de' if i % 3 else 'en'}/{'x' * (i % 5)}{i}" for i in range(500)]
    spark.createDataFrame([("https://" + p, "") for p in paths], "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = QUERIES["assign_isolated_oneshot"](spark, str(tmp_path))
    got = {r.path: r.community for r in out.collect()}
    sets, want = {p: set(p.split("/")) for p in paths}, {}
    for p in (p for p in paths if len(p) % 2):
        near = {}
        for m in (m for m in paths if not len(m) % 2):
            near.setdefault(len(m) % 4, []).append(len(sets[p] & sets[m]) / len(sets[p] | sets[m]))
        mean = {c: round(sum(s) / len(s), 9) for c, s in near.items()}
        best = min(mean, key=lambda c: (-mean[c], c))
        if mean[best] >= 0.1:
            want[p] = best
    assert got == want and len(want) > 200 and most_rows(out) < 10_000


def slow_turns(members, alone, threshold):
    sets, out = {}, []
    for p, c in members:
        sets.setdefault(c, []).append(set(p.split("/")))
    for p in alone:
        s = set(p.split("/"))
        mean = {c: sum(len(s & m) / len(s | m) for m in ms) / len(ms) for c, ms in sets.items()}
        best = min(mean, key=lambda c: (-mean[c], c), default=None)
        if best is None or not mean[best] or mean[best] < threshold:
            best = max(sets, default=-1) + 1
        sets.setdefault(best, []).append(s)
        out.append((p, best))
    return out


def test_turns_cost_the_kinds_of_paths():
    rng = random.Random(11)
    path = lambda: "/".join([f"h{rng.randrange(4)}", rng.choice(("de", "en")), *(f"d{rng.randrange(30)}" for _ in range(rng.randrange(3))), f"f{rng.randrange(500)}"])
    members, alone = [(path(), 3 * rng.randrange(4)) for _ in range(300)], [path() for _ in range(300)] + ["q", "q/r", "only"]
    want = slow_turns(members, alone, 0.3)
    assert len({c for _, c in want}) > 20
    for cells, few in ((10_000_000, 50), (10_000_000, 5), (400, 5), (0, 1000), (0, 0)):
        assert nearest.in_turn(members, alone, 0.3, cells, few) == want
    assert nearest.in_turn([], ["a/b", "a/b"], 0.5) == [("a/b", 0), ("a/b", 0)]
    begin = time.process_time()  # one by one these are 37 million similarities
    got = nearest.in_turn([(f"h/en/m{i}", i % 2) for i in range(5000)], [f"h/en/a{i}" for i in range(5000)], 0.2)
    assert {c for _, c in got} == {0} and time.process_time() - begin < 4


def test_similar_paths_of_frequent_parts_make_no_pairs(spark):
    path = lambda kind: F.concat(F.lit("h"), F.expr("id % 7"), F.lit("/"), F.expr("id div 7 % 7"), F.lit("x/"), F.expr("id div 49 % 7"), F.lit(f"y/{kind}"))
    alone = spark.range(343).select(path("a").alias("path"))
    members = spark.range(343).select(path("b").alias("path"), (F.col("id") % 2).alias("community"))
    out = graph.mean_similarity(alone, members, few=20)
    got = {(r.path, r.community): r.similarity for r in out.collect()}
    sets = [(set(r.path.split("/")), r.community) for r in members.collect()]
    for r in alone.collect()[::20]:
        p = set(r.path.split("/"))
        for c in (0, 1):
            each = [len(p & s) / len(p | s) for s, d in sets if d == c]
            assert got[r.path, c] == pytest.approx(sum(each) / len(each), abs=1e-12)
    assert len(got) == 686 and most_rows(out) < 20_000  # 43,561 pairs share a part


def test_mean_similarity_of_deep_paths(spark):
    rng = random.Random(5)
    path = lambda i: "/".join(["src", *(f"d{rng.randrange(12)}" for _ in range(rng.randrange(14))), f"f{i % 60}"])
    alone, members = sorted({path(i) for i in range(80)}), [(path(i), i % 3) for i in range(100)] + [("", 1), ("src//a", 2)]
    sets, want = [(set(m.split("/")), c) for m, c in members], {}
    for p in alone:
        for c in range(3):
            each = [len(set(p.split("/")) & s) / len(set(p.split("/")) | s) for s, d in sets if d == c]
            if any(each):
                want[p, c] = sum(each) / len(each)
    one, two = spark.createDataFrame([(p,) for p in alone], "path string"), spark.createDataFrame(members, "path string, community long")
    for few, small in ((3, 6), (0, 2)):
        rows = graph.mean_similarity(one, two, few, small).collect()
        got = {(r.path, r.community): r.similarity for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
