"""Every registered query, and every stage of the pipeline, against brute force over a small folder of tables."""

import copy
import math
import os
import random
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import decontaminate, language, quality, queries

from .test_html import random_pages, slow_text
from .test_operators import crc, roots, slow_fingerprint, slow_repeats, whole_ids

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
STEMS = {"en": "the and ing tion wh ea".split(), "fr": "eau ê oi que ç aux".split(), "de": "sch ung ß ä ver ie".split()}


def make_tables(seed=11):
    rng = random.Random(seed)
    word = lambda l: "".join(rng.choice(STEMS[l]) for _ in range(rng.randint(1, 4)))
    prose = lambda l, n: " ".join(word(l) for _ in range(n))
    items = [(i, prose("en", n)) for i, n in enumerate((40, 25, 16, 12, 6))]
    passage = prose("fr", 70)
    docs = []
    for i in range(90):
        l = rng.choice(list(STEMS))
        docs.append((i, prose(l, rng.randint(2, 160)), l, "s"))
    docs += [(90, docs[3][1], "en", "s"), (91, docs[3][1], "fr", "t"), (92, docs[5][1] + " " + word("en"), docs[5][2], "s")]
    docs += [(93 + k, f"{prose('en', 30)}\n{passage}\n{prose('fr', 20)} é{k}", "fr", "s") for k in range(3)]
    docs += [(96, prose("en", 20) + " " + items[0][1], "en", "s"), (97, items[3][1].upper(), "en", "s"), (98, items[4][1], "en", "s")]
    docs += [(99, None, None, "s"), (100, "", "en", "s"), (101, " \n\t ", "de", None), (102, "12 34 !!", "en", "s")]
    docs += [(103, "long " + " ".join([prose("de", 4000)] * 2), "de", "s"), (104, "x" * 30_000, "en", "s")]
    docs += [(None, "no id but some words of text", "en", "s"), (None, None, None, None), docs[7], docs[7], (8, prose("de", 60), "de", "s")]
    docs += [(110 + k, prose("en", 80) + " " + " ".join(["stupid idiot moron"] * 3), "en", "s") for k in range(8)]
    labels = [(i, 1, int(i >= 110)) for i in list(range(0, 60)) + list(range(110, 118))]
    return docs, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    docs, items, labels = make_tables()
    rows = [(i, t, l, s, len(t or "")) for i, t, l, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(random_pages(seed=2), "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def docs():
    return make_tables()[0]


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def plain(text):
    return [w for w in (x.lower().strip(decontaminate.PUNCTUATION) for x in WORD.findall((text or "").encode())) if w]


def slow_overlaps(docs, items, window=16, similarity=0.8, least=8, shortest=3):
    """(doc_id, item) pairs that overlap: every diagonal of every pair is looked at."""
    out = Counter()
    for d, text, *_ in docs:
        words = plain(text)
        for i, t in items:
            item = plain(t)
            size, hit = min(window, len(item)), False
            if len(item) < shortest:
                continue
            for shift in range(-len(item) + 1, len(words)):
                lo, hi = max(0, -shift), min(len(item), len(words) - shift)
                same = [words[k + shift] == item[k] for k in range(lo, hi)]
                if hi - lo < size:
                    hit |= hi - lo >= least and all(same)
                else:
                    need = 1.0 if size < least else similarity
                    hit |= any(sum(same[k : k + size]) >= need * size - 1e-9 for k in range(len(same) - size + 1))
            out[d, i] += hit
    return +out


def test_op1(spark, folder, docs):
    got = run(spark, folder, "op1_decontamination")
    want = slow_overlaps([d for d in docs if d[0] not in (103,)], make_tables()[1])
    assert Counter((r.doc_id, r.item_id) for r in got if r.doc_id != 103) == want
    assert {(96, 0), (97, 3), (98, 4)} <= set(want)


def test_masks_hit_all_that_verification_accepts():
    """Every way to change a fifth of the words of 8 to 16 leaves one of the masks whole somewhere."""
    from itertools import combinations

    fits = lambda gone, n: any(all(m[k] == "0" or a + k not in gone for k in range(len(m))) for m in decontaminate.MASKS for a in range(n - len(m) + 1))
    for n in range(8, 17):
        most = n - math.ceil(0.8 * n - 1e-9)
        assert all(fits(set(gone), n) for gone in combinations(range(n), most))


def test_op2(spark, folder, docs):
    lengths = [len(whole_ids(t)) + 1 for _, t, *_ in docs]
    got = {r.n_tokens: (r.n_docs, r.docs_over, r.tokens_over, r.truncated_total) for r in run(spark, folder, "op2_token_histogram")}
    assert got == {n: (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n), sum(min(x, n) for x in lengths)) for n in set(lengths)}


def test_op3(spark, folder, docs):
    got = sorted(run(spark, folder, "op3_binary_records"), key=lambda r: r.start)
    ids = Counter((i, crc([*whole_ids(t), 2]), len(whole_ids(t)) + 1) for i, t, *_ in docs)
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == ids
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)


def test_op4(spark, folder):
    rows = random_pages(seed=2)
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in run(spark, folder, "op4_html_text"))
    assert got == Counter({(*k, len(k[2])): n for k, n in slow_text(rows).items()})


def components_of(docs):
    fps = [slow_fingerprint(t) for _, t, *_ in docs]
    root = roots([(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3], set(fps))
    return fps, [root[f] for f in fps]


def test_op5(spark, folder, docs):
    fps, root = components_of(docs)
    least = defaultdict(list)
    for (i, *_), x in zip(docs, root):
        least[x] += [i] * (i is not None)
    want = Counter((i, f"{f:016x}", min(least[x], default=None)) for (i, *_), f, x in zip(docs, fps, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, folder, "op5_simhash")) == want


def check_packs(got, docs):
    want = Counter()
    for i, t, *_ in docs:
        ids = [*whole_ids(t), 1]
        want.update((i, a, min(2048, len(ids) - a), crc(ids[a : a + 2048]), len(ids)) for a in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    packs = defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    for pieces in packs.values():
        ends = np.cumsum([0] + [n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(packs) <= 1.05 * sum(r.length for r in got) / 2048 + 1


def test_op6(spark, folder, docs):
    check_packs(run(spark, folder, "op6_packing"), docs)


def test_op7(spark, folder, docs):
    from lodestone.llm.common import table

    rules = quality.with_marks(quality.toxic_marks(table(spark, folder, "documents"), table(spark, folder, "labels")))
    want = Counter()
    for i, t, *_ in docs:
        t = t or ""
        words = [w.decode() for w in WORD.findall(t.encode())]
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x.encode())]
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        kept = not failed and not any(fails(quality.document(t.encode())) for fails in rules.values())  # every rule is asked
        want[i, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed, kept] += 1
    got = run(spark, folder, "op7_quality_cascade")
    assert Counter(tuple(r) for r in got) == want
    assert any(r.kept for r in got) and not any(r.kept for r in got if r.doc_id and r.doc_id >= 110)


def test_op8(spark, folder, docs):
    got = run(spark, folder, "op8_repeated_strings")
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == slow_repeats([d[:2] for d in docs], 200)


def test_op9(spark, folder, docs):
    got = run(spark, folder, "op9_kneser_ney")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None]
    c = Counter(w for i, t, *_ in docs if not held(i) for w in tokens(t))
    n, v, want = sum(c.values()), len(c), Counter()
    for i, t, *_ in docs:
        x = tokens(t)
        want[i, held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)


def slow_language(train, texts, margin=0.2):
    """Counts, classifiers and decoding one n-gram at a time."""
    counts = {}
    grams = lambda t: [f for order in language.ngrams([t])[0] for f in order.tolist()]
    for t, l in train:
        if l is not None and language.letters(t):
            counts.setdefault(l, Counter()).update(f for f in grams(language.letters(t)) if f < language.FEATURES)
    names = sorted(counts)
    code = language.codewords(len(names))
    total = {l: sum(counts[l].values()) + 0.1 * language.FEATURES for l in names}
    p = np.array([[(counts[l][f] + 0.1) / total[l] for f in range(language.FEATURES)] for l in names])
    w = np.stack([np.log(p[code[:, b] > 0].mean(axis=0)) - np.log(p[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])], axis=1)
    sure = np.maximum(code * (p @ w), 1e-3)
    sure = sure / sure.sum(axis=1, keepdims=True) * code.shape[1]
    out = []
    for t in texts:
        if not language.letters(t):
            out.append(("und", 0.0))
            continue
        margins = sum(w[f] for f in grams(language.letters(t)) if f < language.FEATURES) / len(language.ORDERS)
        near = [sum(s * math.log1p(math.exp(-c * m)) if -c * m < 500 else s * -c * m for s, c, m in zip(sure[i], code[i], margins)) for i in range(len(names))]
        best = int(np.argmin(near))
        out.append((names[best], 1 / sum(math.exp(max(-700, near[best] - x)) for x in near)))
    return out


def test_op10(spark, folder, docs):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    some = [d for d in docs if d[0] not in (103, 104)]
    found = slow_language([(t, l) for i, t, l, _ in docs if not held(i)], [t for _, t, *_ in some])
    want = Counter((i, held(i), l, round(score, 3)) for (i, *_), (l, score) in zip(some, found))
    got = run(spark, folder, "op10_language")
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 3)) for r in got if r.doc_id not in (103, 104)) == want
    assert len(got) == len(docs) and {r.lang_pred for r in got} == {"en", "fr", "de", "und"}


def test_language_of_nothing(spark, folder, docs):
    from lodestone.llm.common import table

    d = table(spark, folder, "documents")
    assert language.predict(d.limit(0), language.fit(d)).collect() == []
    assert {r.lang_pred for r in language.predict(d, language.fit(d.limit(0))).collect()} == {"und"}


# the stages, each on documents as given and on what another could leave

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, folder, name, rows):
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    out = dict(corpus_pipeline.STAGES)[name](spark, d, folder)
    if name != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    return out.collect()


def rows_of(found):
    return Counter(tuple(r) for r in found)


def test_stage_language(spark, folder, docs):
    got = rows_of(stage(spark, folder, "language", docs))
    train = [(t, l) for _, t, l, _ in docs]
    some = [d for d in docs if d[0] not in (103, 104)]
    want = Counter((*d, len(d[1])) for d, (l, score) in zip(some, slow_language(train, [t for _, t, *_ in some])) if l != "und" and 2 * score - 1 > 0.25)
    assert not want - got and not got - Counter((*d, len(d[1] or "")) for d in docs if language.letters(d[1]))


def test_stage_near_duplicates(spark, folder, docs):
    rows = [*docs, (200, docs[1][1], "en", "s"), (None, docs[1][1], "en", "s"), (3, "one more text under an id that others have", "en", "s"), (None, "alone", "fr", "s")]
    got = stage(spark, folder, "near_duplicates", rows)
    fps, root = components_of(rows)
    groups = defaultdict(set)
    for (i, t, *_), f, x in zip(rows, fps, root):
        groups[x].add((i is None, i or 0, f, t))
    firsts = {g: min((n, i) for n, i, *_ in rows_) for g, rows_ in groups.items()}
    of = {t: x for (_, t, *_), x in zip(rows, root)}
    assert Counter(of[r.text] for r in got) == Counter(dict.fromkeys(groups, 1))  # one of each group, and of no other
    assert all((r.doc_id is None, r.doc_id or 0) == firsts[of[r.text]] for r in got)
    assert {(r.doc_id, r.text) for r in got} <= {r[:2] for r in rows}
    assert stage(spark, folder, "near_duplicates", []) == []


def test_stage_repeated_strings(spark, folder, docs):
    odd = "�" + "".join(random.Random(3).choice("aé漢� ") for _ in range(400))
    rows = [*docs, (300, odd, "en", "s"), (301, "b" + odd[1:] + "�!", "en", "s")]
    got = rows_of(stage(spark, folder, "repeated_strings", rows))
    data = [(t or "").encode() for _, t, *_ in rows]
    seen, want = Counter(t[k : k + 200] for t in data for k in range(len(t) - 199)), Counter()
    for (i, t, l, s), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gone[:-1], [True]]).astype(int)))
        text = "".join(b[x:y].decode(errors="ignore") for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()))
        want[i, t if t is None else text, l, s, None if t is None else len(text)] += 1
    assert got == want


def test_stage_decontamination(spark, folder, docs):
    some = [d for d in docs if d[0] != 103] + [(96, "another text under the id of one that is found", "en", "s")]
    items, want = make_tables()[1], Counter()
    for d in some:
        if not slow_overlaps([d], items):
            want[(*d, len(d[1] or ""))] += 1
    assert rows_of(stage(spark, folder, "decontamination", some)) == want


def test_stage_packing(spark, folder, docs):
    check_packs(stage(spark, folder, "packing", docs), docs)
    assert stage(spark, folder, "packing", []) == []


def test_pipeline(spark, folder, docs):
    got = run(spark, folder, "pipeline")
    kept = {r.doc_id for r in got}
    assert not kept & {90, 91, 96, 97, 98, 99, 100, 101, 102}, kept
    assert {10, 20, 30} <= kept
    packs = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        packs[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 for p in packs.values())


# files that are gone


@pytest.mark.parametrize("name", ["op8_repeated_strings", "op9_kneser_ney"])
def test_a_lost_file_is_an_error(spark, folder, monkeypatch, name, tmp_path):
    from lodestone.llm import hash_files, kneser_ney
    from lodestone.llm.common import table

    docs = table(spark, folder, "documents")
    if name == "op9_kneser_ney":
        model = kneser_ney.train(docs, order=3)
        for f in ("words", "pairs", "triples"):
            own = f"{tmp_path}/{f}"
            shutil.copytree(model.folder.removeprefix("file://"), own)
            os.remove(f"{own}/{f}-1")
            broken = copy.copy(model)
            broken.folder = own
            with pytest.raises(Exception, match="No such file|FileNotFound"):
                kneser_ney.score(docs, broken).collect()
        return
    files = hash_files.write_hashes(docs.selectExpr("xxhash64(text) as hash"), f"file://{tmp_path}", "set", 3)
    some = np.arange(1 << 12, dtype=np.uint64) << np.uint64(52)
    assert files.find(some).sum() == 0
    (tmp_path / "set-1").unlink()
    with pytest.raises(FileNotFoundError):
        hash_files.HashFiles(files.folder, files.name, files.buckets).find(some)


def test_hash_files(spark, tmp_path):
    import pyarrow as pa

    values = spark.range(3000).selectExpr("xxhash64(id % 1000) as hash").repartition(4)
    known = {r.hash for r in values.distinct().collect()}
    files = hash_of(values, tmp_path)
    asked = np.array([*list(known)[:500], *range(1, 400)], np.int64)
    assert (files.find(asked.view(np.uint64)) > 0).tolist() == [x in known for x in asked.tolist()]
    from lodestone.llm.hash_files import repeated

    rows = spark.range(500).selectExpr("id").union(spark.range(100).selectExpr("id")).union(spark.range(10).selectExpr("id"))
    found = repeated(rows.repartition(3), lambda batches: (mixed_ids(b) for b in batches), f"file://{tmp_path}", 3, 2)
    assert found.find(mixed_ids(pa.RecordBatch.from_pydict({"id": pa.array(range(500), pa.int64())}))).tolist() == [2] * 10 + [1] * 90 + [0] * 400


def hash_of(values, tmp_path):
    from lodestone.llm.hash_files import write_hashes

    return write_hashes(values, f"file://{tmp_path}", "set", 3)


def mixed_ids(batch):
    from lodestone.llm.common import mixed

    return mixed(batch.column(0).to_numpy())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder.removeprefix('file://')}/documents.parquet/*.parquet')")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, folder)
    assert sorted(want.columns) == sorted(got.columns)
    near = lambda x: round(x, 3) if isinstance(x, float) else x
    assert Counter(tuple(map(near, r)) for r in want.select(", ".join(got.columns)).fetchall()) == Counter(tuple(map(near, r)) for r in got.collect())
