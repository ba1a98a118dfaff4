"""The operators against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm import decontaminate, kneser_ney, language, packing, quality, records, repeats, simhash, token_counts
from lodestone.llm.components import components
from lodestone.llm.encode import default_path, encoder

WORDS = "the of and stone river Árbol façade idiot walk's 42 !!! #tag a|b <|endoftext|> 漢字 naïve".split()
#: Columns that clash with names used inside.
SCHEMA = "doc_id long, text string, k long, fp long, n string, key int, host string, lang string"


def texts(n=60, seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 120))) for _ in range(n)]
    base += [base[0], base[0], base[1] + " the", "", " \n\t ", None, "one", "x" * 5000, base[2] + "\n" + base[3], "A\u0085B\x1cC d e"]
    return base


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(texts())]
    return [*out, out[0], (3, "other text under an id of another row"), (None, "no id at all"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "n", 3, "h", "en" if (i or 0) % 2 else "fr") for i, t in rows], SCHEMA).repartition(3)


def whole_ids(text):
    return encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return Counter(tuple(r) for r in rows)


def test_encoding_by_runs_is_the_librarys():
    rng = random.Random(3)
    odd = "ab \n\t́é'sßẞΣ​\x1c\x85 <|endoftext|>漢1 !"
    some = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [t or "" for t in texts()]
    some += ["".join(rng.choice("aÀÿŸΣςİıΩ\u212a한\u1112\u1161ǅ.,!? '|%x") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(default_path()).ids(some)]
    assert got == [whole_ids(t) for t in some]


def test_token_histogram(spark, docs, rows):
    lengths = sorted(len(whole_ids(t)) + 1 for _, t in rows)
    sums = token_counts.suffix_sums(token_counts.histogram(docs, end_tokens=1))
    got = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        assert (r.docs_over, r.tokens_over) == (sum(x > k for x in lengths), sum(x for x in lengths if x > k))
        assert r.truncated_total == sum(min(x, k) for x in lengths)
    for limit in (0, 7, 50, 10**6):
        assert token_counts.truncated_total(sums, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(sums, 0.5).first()[0] == lengths[math.ceil(len(lengths) / 2) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(empty(spark))).collect() == []


def test_encoding_forgets(monkeypatch):
    from lodestone.llm.encode import Encoder

    rng, some = random.Random(7), Encoder(default_path(), 50)
    for _ in range(30):
        part = [" ".join("".join(rng.choice("abcÉß.,!") for _ in range(rng.randint(1, 6))) for _ in range(30)) for _ in range(5)] + [None, "the The THE, the."]
        flat, counts = some.encode(pa.array(part))
        want = [whole_ids(t) for t in part]
        assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]
        assert some.encode(pa.array(part).slice(2, 3), with_ids=False)[1].tolist() == list(map(len, want[2:5]))
    assert len(some.known.number) < 400


def test_runs_that_share_a_hash(monkeypatch):
    from lodestone.llm import encode

    data = np.frombuffer(b"ab cd ab\nef", np.uint8)
    monkeypatch.setattr(encode, "mixed", lambda x: x % np.uint64(2))
    begins, ends, run, firsts = encode.runs_of(data, np.array([0, 4, 11]))
    assert [data[i:j].tobytes() for i, j in zip(begins, ends)] == [b"ab", b"c", b"d", b"ab", b"ef"]
    assert run.tolist() == [0, 1, 2, 0, 3] and firsts.tolist() == [0, 1, 2, 4]


def test_checksum_of_records():
    data = np.frombuffer(b"123456789" + bytes(32) + b"ab" + bytes(range(256)) * 5, np.uint8)
    found = records.crc32c(data, np.array([0, 9, 41, 43, 0]), np.array([9, 32, 0, 1280, 2]))
    assert found[0] == 0xE3069283 and found[1] == 0x8A9136AA and found[2] == 0

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert found[3] == slow(bytes(range(256)) * 5) and found[4] == slow(b"12")
    framed, at = records.frame([b"", b"abc", b"x" * 700])
    assert records.unframe(framed, at, np.array([0, 3, 700])) == [b"", b"abc", b"x" * 700]
    with pytest.raises(ValueError):
        records.unframe(framed[:-6] + b"y" + framed[-5:], at, np.array([0, 3, 700]))


def test_records_round_trip(spark, docs, rows):
    manifest = records.write_records(docs)
    got = sorted(records.read_records(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, np.array([*whole_ids(t), 2], "<u4").tobytes()) for i, t in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    mixed = records.read_records(manifest, shuffle_seed=5)
    assert plain(mixed.select("doc_id", "start", "ids").collect()) == plain((r.doc_id, r.start, r.ids) for r in got)
    assert records.read_records(records.write_records(empty(spark))).collect() == []


@pytest.mark.parametrize("size", [16, 64])
def test_packing(spark, docs, rows, size):
    got = packing.pack(docs, size).collect()
    want = Counter()
    for i, t in rows:
        ids = [*whole_ids(t), 1]
        want.update((i, a, crc(ids[a : a + size]), len(ids)) for a in range(0, len(ids), size))
    assert Counter((r.doc_id, r.start, zlib.crc32(r.ids), r.doc_tokens) for r in got) == want
    room = defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in got)
    assert len(room) <= 1.1 * math.ceil(total / size) + 1
    assert packing.pack(empty(spark), size).collect() == []


def test_patterns_of_hot_and_odd_lengths():
    rng = random.Random(2)
    for h in ({1: 100_000}, {100: 1000}, {2048: 5, 1025: 7}, {rng.randint(1, 2048): rng.randint(1, 500) for _ in range(300)}, {}):
        found = packing.patterns(h)
        placed = Counter()
        for n, runs in found:
            assert n > 0 and sum(k * t for k, t in runs) <= 2048
            for k, t in runs:
                placed[k] += n * t
        assert placed == Counter(h)
    total = sum(k * n for k, n in {100: 1000}.items())
    assert sum(n for n, _ in packing.patterns({100: 1000})) <= 1.05 * total / 2000 + 1


def slow_fingerprint(t):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered)]
    if not words:
        return 0
    s = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def test_simhash_links(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base:
        for _ in range(8):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps |= {f & ~0xFFFFFFFF | rng.getrandbits(32) for f in base[:1] for _ in range(300)}  # a value that many share
    fps = sorted(fps)
    want = roots([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for chunk in (4096, 16):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        found = [tuple(r) for r in simhash.links(table).collect()]
        assert all(0 < ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in found)
        got = roots([(a % (1 << 64), b % (1 << 64)) for a, b in found], fps)
        groups = lambda r: {frozenset(n for n in r if r[n] == x) for x in set(r.values())}
        assert groups(got) == groups(want)


def test_near_duplicates(spark, docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fp = [slow_fingerprint(t) for _, t in rows]
    root = roots([(a, b) for a in fp for b in fp if a != b and (a ^ b).bit_count() <= 3], set(fp))
    least = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = Counter((i, f, least.get(root[f])) for (i, _), f in zip(rows, fp))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)] + [(5, 5), (7, 6)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    root = roots(links, nodes)
    least = {r: min(n for n in nodes if root[n] == r) for r in set(root.values())}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: least[root[n]] for n in nodes}


def slow_repeats(rows, w):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen, out = Counter(t[i : i + w] for _, t in data for i in range(len(t) - w + 1)), Counter()
    for d, t in data:
        gone = [False] * len(t)
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                gone[i : i + w] = [True] * w
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out[d, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("width,gram", [(20, 6), (9, 4), (200, 48)])
def test_repeated_strings(spark, docs, rows, width, gram):
    found = repeats.remove_repeats(docs, width, gram)
    digest = found.select("doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s), F.size("removed"), F.sha2("kept", 256))
    assert plain(digest.collect()) == slow_repeats(rows, width)
    assert repeats.remove_repeats(empty(spark), width, gram).collect() == []


def test_repeated_strings_of_few_symbols(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(repeats, "PIECE", 300)
    monkeypatch.setattr(repeats, "IN_MEMORY", 0)
    pool = ["".join(rng.choice("ab \x00é") for _ in range(rng.randint(5, 60))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("abcde \x00") for _ in range(12)) for _ in range(rng.randint(0, 30)))) for i in range(30)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 12, 3)
    digest = found.select("doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s), F.size("removed"), F.sha2("kept", 256))
    assert plain(digest.collect()) == slow_repeats(rows, 12)


@pytest.mark.parametrize("hot", [20, 50_000])
def test_texts_that_go_on_repeating_themselves(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)  # their anchors come at each repetition
    rows = [(i, f"this one is number {i * 7919}. " + "Is onhe. " * (60 + i % 7) + "and so on " * (i % 3)) for i in range(40)] + [(50, "x" * 900), (50, "x" * 900), (51, "x" * 899 + "y"), (None, "Is onhe. " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.remove_repeats(docs)
    digest = found.select("doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s), F.size("removed"), F.sha2("kept", 256))
    assert plain(digest.collect()) == slow_repeats(rows, 200)
    assert repeats.spans(repeats.keyed(docs)).count() < 40 * len(rows)  # each text has about 400 windows that repeat


def test_kneser_ney(spark, docs, rows):
    model = kneser_ney.train(docs.where("doc_id % 3 <> 1"))
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in kneser_ney.score(docs, model).collect())
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    train = [tokens(t) for i, t in rows if i is not None and i % 3 != 1]
    c1, c2 = Counter(x for t in train for x in t), Counter(p for t in train for p in zip([None, *t], t))
    n, v, cont = sum(c1.values()), len(c1), Counter(x for _, x in c2)
    times = lambda c: np.array([list(c.values()).count(i) for i in (1, 2, 3, 4)])
    high, low = kneser_ney.discounts(times(c2)), kneser_ney.discounts(times(cont))
    d = lambda c, of: of[min(c, 3) - 1] if c else 0.0
    total, rest = Counter(), Counter()
    for (p, _), c in c2.items():
        total[p] += c
        rest[p] += d(c, high)
    gamma = sum(d(c, low) for c in cont.values())

    def p(before, x):
        base = (cont[x] - d(cont[x], low) + gamma / (v + 1)) / len(c2)
        return (c2[before, x] - d(c2[before, x], high) + rest[before] * base) / total[before] if total[before] else base

    assert sum(p(b"the", x) for x in c1) + p(b"the", b"never seen") == pytest.approx(1)
    want = Counter()
    for i, t in rows:
        t = tokens(t)
        base = sum(math.log10((c1[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        want[i, len(t), sum(c1[x] > 0 for x in t), n, round(base, 6), round(sum(math.log10(p(b, x)) for b, x in zip([None, *t], t)), 6)] += 1
    assert got == want
    nothing = kneser_ney.train(empty(spark))
    assert {r.score for r in kneser_ney.score(docs, nothing).collect()} == {0.0}


def test_kneser_ney_of_trigrams(spark, docs, rows):
    model = kneser_ney.train(docs.where("doc_id % 3 <> 1"), order=3)
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in kneser_ney.score(docs, model).collect())
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    train = [[None, *tokens(t)] for i, t in rows if i is not None and i % 3 != 1]
    pairs = Counter(g for t in train for g in zip(t, t[1:]))
    c3 = Counter(g for t in train for g in zip(t, t[1:], t[2:]))
    befores = Counter((v, x) for _, v, x in c3)
    c2 = Counter({g: befores[g] if g[0] is not None else n for g, n in pairs.items()})
    c1, words = Counter(x for _, x in pairs), {x for t in train for x in t[1:]}
    times = lambda c: np.array([list(c.values()).count(i) for i in (1, 2, 3, 4)])
    d = lambda c, of: of[min(c, 3) - 1] if c else 0.0
    levels = []
    for c in (c1, c2, c3):
        of, total, rest = kneser_ney.discounts(times(c)), Counter(), Counter()
        for g, n in c.items():
            context = g[:-1] if isinstance(g, tuple) else ()
            total[context] += n
            rest[context] += d(n, of)
        levels.append((c, of, total, rest))

    def p(u, v, x):
        out = 1 / (len(words) + 1)
        for g, (c, of, total, rest) in zip((x, (v, x), (u, v, x)), levels):
            context = g[:-1] if isinstance(g, tuple) else ()
            if total[context] and not (context and len(context) == 2 and v is None):
                out = (c[g] - d(c[g], of) + rest[context] * out) / total[context]
        return out

    assert sum(p(b"the", b"of", x) for x in words) + p(b"the", b"of", b"never seen") == pytest.approx(1)
    want = Counter()
    for i, t in rows:
        t = [None, None, *tokens(t)]
        want[i, len(t) - 2, round(sum(math.log10(p(*g)) for g in zip(t, t[1:], t[2:])), 6)] += 1
    assert got == want
    nothing = kneser_ney.train(empty(spark), order=3)
    assert {r.score for r in kneser_ney.score(docs, nothing).collect()} == {0.0}


def test_language(spark):
    rng = random.Random(8)
    stems = {"xx": "kra ven tol mi".split(), "yy": "ço éla ruí on".split(), "zz": "шо ра ки ну".split()}
    make = lambda l, n: " ".join("".join(rng.choice(stems[l]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(l, rng.randint(3, 60)), l, "t") for i, l in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(900, None, "xx", "t"), (901, "12 !! 34", "yy", "t"), (902, "", None, "t"), (903, make("xx", 9), None, "t"), (None, make("zz", 9), "zz", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs.where("doc_id % 4 <> 1"))
    assert model.languages == ["xx", "yy", "zz"] and model.code.shape == (3, 3)
    got = language.predict(docs, model, keep=("doc_id", "lang")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
        else:
            assert r.lang_pred == (r.lang or "xx") and 0 <= r.score <= 1
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    half = make("xx", 1) + " " + make("yy", 1)
    assert language.predict(spark.createDataFrame([(1, half)], "doc_id long, text string"), model).first().score <= 1
    many = language.codewords(20)
    assert min((a != b).sum() for i, a in enumerate(many) for b in many[:i]) >= 8


def test_quality_cascade(spark, docs, rows):
    order = quality.measure(docs, sample_rows=40)
    assert sorted(order) == sorted(quality.RULES)
    got = quality.cascade(docs, order).collect()
    want = Counter()
    for i, t in rows:
        t = t or ""
        words = t.encode().split()
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        want[i, len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    backwards = quality.cascade(docs, order[::-1])
    assert plain((r.doc_id, r.n_words, r.kept) for r in got) == plain(backwards.select("doc_id", "n_words", "kept").collect())
    assert quality.cascade(empty(spark), quality.measure(empty(spark))).collect() == []


def test_quality_rules():
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    verdict = lambda t: [n for n, fails in quality.RULES.items() if fails(quality.document(t.encode()))]
    assert verdict(clean) == []
    assert "symbols" in verdict(clean.replace(" ", " | ", 30))
    assert "shouting" in verdict(clean.upper())
    assert "letters" in verdict(clean + " 12 34" * 60)
    assert "repeated_lines" in verdict("\n".join([clean, *["again"] * 4]))


def test_learned_toxic_words(spark):
    rng = random.Random(5)
    clean = lambda n: [f"{rng.choice('bdfglmn')}{rng.choice('aeiou')}{rng.randrange(10**6):06d}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n)]
    toxic = lambda: clean(70) + ["Schurkä" + rng.choice(("en", "in", "lich")) for _ in range(3)]
    rows = [(i, " ".join(toxic() if i % 4 == 0 else clean(73)), int(i % 4 == 0)) for i in range(80)]
    rows += [(None, rows[0][1], 0), (200, None, 1), (201, rows[1][1] + " schurkäen", 0), *[(300 + i, " ".join(["twin", *clean(1)] * 40) if not i else None, 1) for i in range(2)]]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows if i is not None and i < 60], "doc_id long, toxic int")  # the rest is held out
    known = quality.toxic_marks(docs, labels)
    assert "schurk" in known and not any(m.startswith("twin") for m in known)
    rules = quality.with_marks(known)
    got = {r.doc_id: r.rejected_by for r in quality.cascade(docs, quality.measure(docs, rules), rules).collect() if r.doc_id is not None}
    assert all((got[i] == "learned_toxic") == bool(bad) for i, _, bad in rows[:80]) and got[201] is None
    assert quality.with_marks(quality.toxic_marks(docs, labels.limit(0))) == quality.RULES


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (30, 12, 9, 4)]
    fill = lambda n: [word() for _ in range(n)]
    fifth = [w if i % 5 else "zzz" for i, w in enumerate(items[0])]  # every fifth word is another
    half = [w if i % 2 else "zzz" for i, w in enumerate(items[0])]
    docs = [
        (0, " ".join(fill(40) + items[0] + fill(5))),
        (1, " ".join(fill(7) + fifth + fill(90))),
        (2, " ".join(fill(50) + half)),
        (3, "Oh, " + " ".join(w.upper() + "," for w in items[1])),
        (4, "\n".join(items[2])),
        (5, " ".join(items[3])),
        (6, " ".join(items[0][:10])),
        (7, " ".join(fill(200))),
        (7, " ".join(items[0])),
        (8, None),
        (9, ""),
        (None, " ".join(items[1])),
    ]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id long")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (None, "")], "item_id long, text string")
    got = decontaminate.overlaps(d, b).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(0, 0), (1, 0), (3, 1), (4, 2), (5, 3), (6, 0), (7, 0), (None, 1)])
    first = next(r for r in got if r.doc_id == 0)
    assert (first.from_word, first.to_word, first.n_same, first.similarity) == (40, 70, 30, 1.0)
    assert decontaminate.overlaps(d, b.limit(0)).collect() == [] == decontaminate.overlaps(d.limit(0), b).collect()


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(5)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(table.withColumnRenamed("item_id", "doc_id"), table).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter((i, i) for i in range(5))


def test_kneser_ney_tokens_are_those_of_bytes():
    rng = random.Random(9)
    some = [bytes([i]) for i in [*range(9, 14), 32, 32, 32, 0, 28, 31, 0x85, 0xA0, 0xC2, 0xE2, 0xFF, 65, 90, 97, 122]]
    for _ in range(300):
        raw = [None if rng.random() < 0.1 else b"".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        want = [[xxh64_intdigest(w, 42) for w in [*(r or b"").lower().split(), kneser_ney.END]] for r in raw]
        for kind, shown in ((pa.binary(), pa.string()), (pa.large_binary(), pa.large_string()), (pa.binary(), pa.binary())):
            ids, sizes, hashed = kneser_ney.batch_tokens(pa.array([b"x", *raw], kind).view(shown).slice(1))
            assert sizes.tolist() == [len(w) for w in want] and hashed[ids].tolist() == [h for w in want for h in w]
            assert (np.diff(hashed.astype(object)) > 0).all() and set(ids.tolist()) == set(range(len(hashed)))


def test_kneser_ney_worker_maps_each_file_once(tmp_path):
    model = kneser_ney.Model(str(tmp_path), 100, [1] * 100, 100)
    every = [(f"file{i}", b) for i in range(14) for b in range(100)]
    for name, b in every:
        (tmp_path / f"{name}-{b}").write_bytes(np.array([b], "<u8").tobytes())
    before = len(os.listdir("/proc/self/fd"))
    first = [model.file(name, b, "<u8") for name, b in every]
    assert all(model.file(name, b, "<u8") is x and x.tolist() == [b] for (name, b), x in zip(every, first))  # 1,400 files
    assert len(os.listdir("/proc/self/fd")) < before + 10
