"""Each operator against brute force on small rows, and on odd rows of every kind."""

import collections
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tarnwick.llm import chats, decontaminate, lines, lmscore, nearcopies, packing, passages, simhash, topk, toxicity, urls
from tarnwick.llm.components import connected_components
from tarnwick.llm.wordscan import Scanner, split_letters, split_white

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, severity string, n_lines string, drop string, fp int, `odd.name` int"


def words(rng, n, vocabulary=400):
    return " ".join("w" + "abcdefghij"[(k := rng.randrange(vocabulary)) % 10] + "klmnopqrst"[k // 10 % 10] + "uvxyz"[k // 100] for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ordinary texts, copies, near copies, a very long text, and odd ones."""
    rng = random.Random(7)
    out = [(i, words(rng, rng.randrange(60, 200))) for i in range(60)]
    copy, passage = out[3][1], words(rng, 70)
    out += [(100 + i, copy) for i in range(8)]
    near = copy.split()
    for i in range(6):
        near[rng.randrange(len(near))] = f"edit{i}"
        out.append((120 + i, " ".join(near)))
    out += [(140 + i, words(rng, 30) + "\n" + passage + "\n" + words(rng, 30)) for i in range(4)]
    out += [(150 + i, words(rng, 20) + f"\nSeen {i} times at http://a.b/{i}\n" + words(rng, 20)) for i in range(30)]
    out += [(200, words(rng, 20_000)), (201, None), (202, ""), (203, " \t\n"), (204, "one"), (205, "Été  déjà vu\n\nß € 日本"), (None, copy), (None, None), (206, "a b"), (206, "a b"), (207, "x" * 5000)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", "v", "n", "d", 1, 2) for d, t in rows], DOCS).repartition(3)


def tokens(text):
    return (text or "").encode().lower().split()


def test_word_scanner_splits_and_tells_words_apart():
    texts = [b"The the\tTHE\x0bx", b"", b"  ", "déjà vu".encode(), b"end"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, starts = Scanner(split_white(), lower=True, seed=1).words(data, offsets)
    assert np.diff(starts).tolist() == [4, 0, 0, 2, 1]
    assert len(set(h.tolist())) == 5 and h[0] == h[1] == h[2]
    h, starts = Scanner(split_letters(), lower=True, seed=1).words(np.frombuffer(b"a.b c", np.uint8), np.array([0, 5]))
    assert len(h) == 3
    rng = random.Random(1)
    many = [bytes(rng.choice(b"abAB12") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    h, _ = Scanner(split_white(), lower=False, seed=1).words(np.frombuffer(b" ".join(many), np.uint8), np.array([0, sum(map(len, many)) + len(many) - 1]))
    assert len(set(h.tolist())) == len(set(many))


def brute_topk(vectors, k=10):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 100 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 0.2) for _ in range(20)]) for i in range(700)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(30)]  # ties
    vectors += [(2000, None), (2001, []), (2002, [None] * 20), (2100, [float("nan")] * 20), (2200, [1.0] * 3), (2203, [2.0] * 3), (None, [0.1] * 20), (2300, [float("inf")] + [0.0] * 19)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string").repartition(3)
    monkeypatch.setattr(topk, "CHUNK", 64)
    for block in (4, 8192):
        got = topk.exact_topk(df, F.col("vec_id") % 100 == 0, query_block=block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_topk(vectors)
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_with_values_beyond_doubles(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, 1.0]), (2, [1e8, 2.0])], "vec_id long, embedding array<float>")
    got = topk.exact_topk(df, F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, (1024 * 10**8) ** 2 + 2 * 1024**2), (1, (1024 * 10**8) ** 2 + 1024**2)] or got[0].score == 2**63 - 1


@pytest.mark.parametrize("block_tokens", [16_000_000, 3000])
def test_packing(spark, rows, block_tokens):
    tokenizer = Tokenizer.from_file(packing.public_paths()[0])
    rows = [*rows, (300, "<|endoftext|>"), (301, "hello <|endoftext|> x"), (302, "<|endoftext" + "|>" * 3 + " é")]
    got = packing.pack_documents(frame(spark, rows), packing.public_paths(), fan_in=2, block_tokens=block_tokens).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for k, (a, n) in enumerate(packing.cut(len(ids), 1024)):
            want[d, k, a, n, zlib.crc32(ids[a : a + n].tobytes()), ids[a : a + n].tobytes()] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 1024) + (6 if block_tokens > 3000 else 10)
    assert [bytes(r.ids) for r in got if r.doc_id == 300] == [np.array([50256, 2], "<u4").tobytes()]
    assert packing.pack_documents(frame(spark, rows).limit(0), packing.public_paths()).count() == 0
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_best_fit_takes_the_tightest_bin():
    bins, places, loads = packing.best_fit(np.array([6, 5, 4, 3]), 10)
    assert bins.tolist() == [0, 1, 0, 1] and places.tolist() == [0, 0, 6, 5] and loads.tolist() == [10, 8, 10, 8]


def brute_fingerprint(text):
    w = tokens(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, rows):
    from pyspark.sql import functions as F

    for shard, levels in ((1000, 3), (2, 3), (2, 1)):
        got = simhash.near_duplicates(frame(spark, rows), shard=shard, levels=levels).collect()
        prints = [brute_fingerprint(t) for _, t in rows]
        parent = list(range(len(rows)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    parent[root(i)] = root(j)
        groups = collections.defaultdict(list)
        for i, (d, _) in enumerate(rows):
            if d is not None:
                groups[root(i)].append(d)
        want = sorted((str(d), prints[i], str(min(groups[root(i)], default=None))) for i, (d, _) in enumerate(rows))
        assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    one = spark.createDataFrame([("The quick  Brown",)], "text string").select(F.xxhash64(F.lit("the quick brown")).alias("x")).first().x
    assert brute_fingerprint("The quick  Brown") == one & (2**64 - 1)
    kept = simhash.stage(spark, frame(spark, rows), "").collect()
    assert len(kept) == len({r.component_id if r.component_id is not None else r.fp for r in got})
    assert set(kept[0].asDict()) == set(frame(spark, rows).columns)


def brute_groups(texts):
    """Numbers of texts that are linked by a Jaccard similarity of five-word shingles of at least 0.8."""
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) * 5 >= 4 * len(x | y):
                a, b = sorted((low[i], low[j]))
                low = [a if k == b else k for k in low]
    return low


def test_near_dedup_stage_finds_every_pair_of_similar_texts(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(1, 200)) for _ in range(30)]
    for base in list(texts):
        for rate in (0.01, 0.02, 0.03):
            texts.append(" ".join(edited(rng, base.split(), rate)))
    base = words(rng, 300).split()
    texts += [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in range(100)]  # a large group
    texts += ["Other ends " + " ".join(base[:30]) + " " + words(rng, 100) for _ in range(20)] + [None, "", " ", texts[4].upper()]
    df = frame(spark, list(enumerate(texts)))
    got = dict(corpus_pipeline.STAGES)["near-dedup"](spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(brute_groups(texts)))
    assert set(got[0].asDict()) == set(df.columns) and nearcopies.stage(spark, df.limit(0), "").count() == 0


def edits_at(base, number, places):
    """The base with so many words replaced, every number by its own: no two of these texts share an edit."""
    for p in places:
        base = [*base[:p], f"edit{number}x{p}", *base[p + 1 :]]
    return " ".join(base)


def test_texts_just_under_the_similarity_make_no_row_for_each_pair(spark, monkeypatch):
    made = collections.Counter()

    def counted(df, name, write=nearcopies.written):
        found = write(df, name)
        made[name] += found.count()
        return found

    monkeypatch.setattr(nearcopies, "written", counted)
    rng = random.Random(31)
    base = words(rng, 204).split()
    # 5 edits replace 25 of 200 shingles: 0.78 to the base, less to each other
    texts = [" ".join(base)] + [edits_at(base, i, rng.sample(range(5, 199, 11), 5)) for i in range(80)]
    texts.append(texts[1] + " tail")
    got = nearcopies.near_copies(frame(spark, list(enumerate(texts)))).collect()
    assert len({r.group for r in got}) == len(set(brute_groups(texts))) == 81
    assert all(count <= made["shared-shingles"] for count in made.values()), str(made)


def test_blocks_of_a_cluster_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SKETCH_BLOCK", 5)
    monkeypatch.setattr(nearcopies, "SET_BLOCK", 3)
    monkeypatch.setattr(nearcopies, "SHARED", 1)
    rng = random.Random(32)
    base = words(rng, 204).split()
    texts = [edits_at(base, i, rng.sample(range(5, 199, 11), 5)) for i in range(20)]
    texts += [edits_at(x.split(), 100 + i, [100]) for i, x in enumerate(texts)] + [" ".join(x.split()[: 180 + i]) for i, x in enumerate(texts)]
    got = {r.doc_id: r.group for r in nearcopies.near_copies(frame(spark, list(enumerate(texts)))).collect()}
    want = brute_groups(texts)
    assert 1 < len(set(want)) < len(texts)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(33)
    for n in (1, 3, 12, 60, 63, 64, 65, 130, 600, 20_000):
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = np.unique(np.concatenate([own[len(own) // 10 :], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
        sets = [own, other, own[len(own) // 5 :], np.unique(rng.integers(0, 2**63, n).astype(np.uint64))]
        size, part, component = np.array([len(x) for x in sets]), np.zeros(4, int), np.arange(4)
        both = np.array([[len(np.intersect1d(x, y)) for x in sets] for y in sets])
        similar = (both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-9) & ~np.eye(4, dtype=bool)
        found = nearcopies.suspects(part, size, component, [nearcopies.sketch(x) for x in sets], 0.8)
        assert found[similar.any(axis=1)].all() and (n < 60 or not found[3])
        links = nearcopies.forest(part, component, component, sets, 0.8)
        assert all(similar[a, b] for a, b in links) and {x for e in links for x in e} == set(np.flatnonzero(similar.any(axis=1)).tolist())
        halves = np.array([0, 0, 1, 1])
        assert all(halves[a] != halves[b] for a, b in nearcopies.forest(halves, component, component, sets, 0.8))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(50, 90)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300 + i) for i in range(40)] + [(7, 7)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {v: c for v, c in low.items() if v != 7}


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    tree = simhash.BKTree()
    for i, v in enumerate(values):
        assert sorted(tree.add_and_find(v, 3)) == [j for j in range(i) if (values[j] ^ v).bit_count() <= 3]


def test_chats(spark):
    call = json.dumps({"tool_calls": [{"id": "c1", "name": "reply", "arguments": '{"prompt":"hi","turn":1}'}, {"id": "c2", "name": "other", "arguments": "{}"}, {"id": "c3", "name": "reply", "arguments": '{"turn":"x"}'}]})
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "hi"), (1, 2, "assistant", "ho\n\"é\""), (1, 4, "assistant", "lost"), (1, 5, "user", ""),
        (2, 3, "assistant", call), (2, 1, "tool", '{"tool_call_id":"c1","content":"early"}'), (2, 5, "tool", '{"tool_call_id":"zz","content":"?"}'),
        (None, None, None, None), (3, 0, "user", None), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = chats.format_turns(df).collect()
    by_id = {(r.level, r.call_id): r for r in got}
    assert by_id[1, "1:1"].status == "ok" and by_id[1, "1:5"].status == "open, prompt: too short" and by_id[1, "3:0"].status == "prompt: missing"
    assert by_id[2, "1:3"].status == "orphan" and by_id[2, "1:1"].status == "linked"
    assert by_id[1, "c1"].status == "ok" and by_id[1, "c2"].status == "open, no schema" and by_id[1, "c3"].status == "open, prompt: missing"
    assert (by_id[2, "c1"].order_turn, by_id[2, "zz"].status) == (3, "orphan")  # after its call, though logged before
    assert sum(r.call_id == "3:0" and r.level == 2 for r in got) == 2
    for r in got:
        value = json.loads(r.json)
        assert r.json == json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert chats.format_turns(df.limit(0)).count() == 0


def test_chats_keep_repeated_calls_and_link_within_a_conversation(spark):
    call = json.dumps({"tool_calls": [{"id": "call_1", "name": "other", "arguments": "{}"}]})
    rows = [(c, 1, "assistant", call) for c in (1, 2)] + [(2, 2, "tool", '{"tool_call_id":"call_1","content":"x"}'), (3, 2, "tool", '{"tool_call_id":"call_1","content":"y"}'), (4, 0, "user", "one"), (4, 0, "user", "two")]
    got = chats.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    found = sorted((r.conv_id, r.level, r.status) for r in got if r.call_id in ("call_1", "4:0"))
    assert found == [(1, 1, "open, no schema"), (2, 1, "no schema"), (2, 2, "linked"), (3, 2, "orphan"), (4, 1, "open, ok"), (4, 1, "repeated, ok")]


def test_arguments_are_checked_by_the_types_of_their_tokens(spark):
    from pyspark.sql import functions as F

    schema = (("s", "string", True, 2), ("i", "integer", True, 0), ("n", "number", False, 0), ("b", "boolean", False, None))
    cases = {
        '{"s":"ab","i":3}': "ok", '{"s":"ab","i":"3"}': "i: not of type integer", '{"s":5,"i":3}': "s: not of type string",
        '{"s":"a","i":3}': "s: too short", '{"s":"ab","i":-1}': "i: too small", '{"s":"ab","i":1.5}': "i: not of type integer",
        '{"s":"ab","i":123456789012345678901234567890}': "ok", '{"s":"ab","i":null}': "i: missing", '{"i":1}': "s: missing",
        '{"s":"ab","i":1,"n":1.5,"b":true}': "ok", '{"s":"ab","i":1,"n":"1"}': "n: not of type number", '{"s":"ab","i":1,"b":"true"}': "b: not of type boolean",
        '{"s":"ab","i":1,"n":2e3,"x":{"y":[1]}}': "ok", "[1]": "no object", "null": "no object", "{": "no object", "": "no object", '"x"': "no object", '{"s":["ab"],"i":1}': "s: not of type string", '{}': "s: missing",
    }
    df = spark.createDataFrame([(a,) for a in cases] + [(None,)], "a string")
    got = {r.a: r.p for r in df.select("a", chats.problem(F.col("a"), schema).alias("p")).collect()}
    assert got == {**cases, None: "no object"}


def edited(rng, w, rate):
    out = []
    for x in w:
        u = rng.random()
        if u < rate / 3:
            continue
        out.append("zzz" if u < 2 * rate / 3 else x)
        if u > 1 - rate / 3:
            out.append("yyy")
    return out


def test_decontamination(spark, rows):
    rng = random.Random(9)
    items = [(i, words(rng, n)) for i, n in enumerate((45, 20, 12, 7, 3, 1, 30))] + [(7, None), (8, " ."), (9, "rep a rep a rep a rep a rep b"), (None, words(rng, 15))]
    texts = list(rows)
    for k in range(80):
        base = rng.choice([t for _, t in rows if t and len(t) < 2000]).split()
        cut = rng.randrange(len(base) + 1)
        item = rng.choice([t for _, t in items if t])
        texts.append((1000 + k, " ".join(base[:cut] + edited(rng, item.upper().split(), rng.choice([0, 0.1, 0.2, 0.3])) + base[cut:])))
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = collections.Counter()
    for d, t in texts:
        w = decontaminate.words_of((t or "").encode())
        for i, b in items:
            bw = decontaminate.words_of((b or "").encode())
            if bw and set(bw) & set(w):
                found = decontaminate.align(bw, w)
                if found[4] >= 0.8 - 1e-12:
                    want[d, i, found[0]] += 1
    for block in (3, 5000):
        got = decontaminate.leaks(frame(spark, texts), benchmark, item_block=block).collect()
        assert collections.Counter((r.doc_id, r.item_id, r.score) for r in got) == want
    assert decontaminate.leaks(frame(spark, texts).limit(0), benchmark).count() == 0
    assert decontaminate.leaks(frame(spark, texts), benchmark.limit(0)).count() == 0


def test_decontamination_folds_the_case_of_all_letters(spark):
    item = "Où était l'élève âgé né à Orléans après l'été où naît la forêt dorée straße über größe"
    texts = [(1, item.upper()), (2, "Voilà " + item.lower() + " fin"), (3, item.replace("é", "x"))]
    benchmark = spark.createDataFrame([(5, item), (6, item.upper())], "item_id long, text string")
    got = decontaminate.leaks(frame(spark, texts), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in got) == [(1, 5, 1.0), (1, 6, 1.0), (2, 5, 1.0), (2, 6, 1.0)]


def test_an_item_of_four_words_is_found_with_a_word_inserted(spark):
    benchmark = spark.createDataFrame([(5, "alpha beta gamma delta")], "item_id long, text string")
    got = decontaminate.leaks(frame(spark, [(1, "so alpha beta other gamma delta it is")]), benchmark).collect()
    assert [(r.doc_id, r.similarity) for r in got] == [(1, 0.8)]


def test_alignment():
    score, first, end, matches, similarity = decontaminate.align([1, 2, 3, 4, 5], [9, 1, 2, 8, 4, 5, 9])
    assert (score, first, end, matches, similarity) == (7, 1, 6, 4, 0.8)


def test_lm_scores(spark, rows, monkeypatch):
    counts = collections.Counter()
    for d, t in rows:
        if not (d is not None and zlib.crc32(str(d).encode()) % 7 == 2):
            counts.update([*tokens(t), b" "])
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for d, t in rows:
        w = [*tokens(t), b" "]
        want[d].append((len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    scores = {}
    for how in ({}, {"frequent": 20}, {"frequent": 0, "pass_bytes": 2000}):
        got = collections.defaultdict(list)
        for r in lmscore.lm_scores(frame(spark, rows), **how).collect():
            got[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score))
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
            assert r.score < 0
            scores.setdefault(str(how), {})[r.doc_id] = r.score
        assert got.keys() == want.keys()
        for d in want:
            assert np.allclose(sorted(got[d]), sorted(want[d]), rtol=1e-9)
    passes = {r.doc_id: r.score for r in lmscore.lm_scores(frame(spark, rows), pass_bytes=2000).collect()}
    copies = [d for d, t in rows if d is not None and t == rows[3][1]]
    base = {d: want[d][0][3] for d in copies}
    assert all(scores["{}"][d] > base[d] for d in copies)  # bigrams of a text seen in training
    assert all(math.isclose(scores["{}"][d], x, rel_tol=1e-9) for d, x in passes.items())  # passes over parts add up
    assert lmscore.lm_scores(frame(spark, rows).limit(0)).count() == 0


def test_lm_scores_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HOT_SHARE", 2.0)  # the same contexts are hot in both
    texts = [(i, "common common rare" + "abcdefgh"[i % 8] + " once" + str(i)) for i in range(40)]
    scores = [{r.doc_id: r.score for r in lmscore.lm_scores(frame(spark, texts), frequent=n).collect()} for n in (1_000_000, 5)]
    assert all(math.isclose(scores[0][d], x, rel_tol=1e-9) for d, x in scores[1].items())


def test_bloom_filter_gives_back_quantised_counts():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    counts = rng.integers(1, 200, len(keys))
    size, raw = lmscore.filled(keys, counts)
    model = lmscore.Filter(np.array([True]), np.array([size], np.uint64), np.array([0]), raw)
    level = model.level(keys, np.zeros(len(keys), np.uint64))
    exact = lmscore.levels_of(counts)
    assert (level >= exact).all() and (level == exact).mean() > 0.9
    other = rng.integers(2**63, 2**64, 5000, dtype=np.uint64)
    assert (model.level(other, np.zeros(5000, np.uint64)) > 0).mean() < 0.06


def test_urls(spark):
    cases = [
        ("http://www.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/2?x=/fr/", "a.example.com", "/en/2", "example.com/en/", "block"),
        ("https://a.example.com/fr/2#top", "a.example.com", "/fr/2", "com/", "allow"),
        ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("http://x.net", "x.net", "", None, None),
        ("http://x.com?q=/", "x.com", "", None, None),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("nothing", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("ftp://ÄB.ORG/a b\nc", "Äb.org", "/a b\nc", None, None),
        ("http://" + "a" * 5000 + ".net/fr/x", "a" * 5000 + ".net", "/fr/x", "net/fr/", "block"),
    ]
    pages = [(i, c[0]) for i, c in enumerate(cases)] + [(None, cases[0][0]), (3, cases[3][0])]
    df = spark.createDataFrame([(i, u, "<p>", "h", "r") for i, u in pages], "page_id long, url string, html string, host string, rule string")
    got = urls.judge(df, trees=2).collect()
    assert len(got) == len(pages)
    by_id = {r.page_id: r for r in got}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, rule)
        assert by_id[i].verdict == verdict if verdict else by_id[i].verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(df.where("url IS NULL")).collect()} == {"allow"}


def labelled_urls(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "url string, blocked int")
    return df.withColumn("host", urls.host_of(F.col("url"))).withColumn("path", urls.path_of(F.col("url")))


def test_trees_learn_from_labelled_urls(spark):
    rows = [(f"http://h{i}.org/" + ("a/" * 6 + f"{i:09d}" if i % 2 else "page"), i % 2) for i in range(300)]
    ready = labelled_urls(spark, rows)
    model = urls.train(ready)
    scored = urls.features(ready, model["statistics"]).select("blocked", (urls.raw_score(model) > 0).cast("int").alias("p")).collect()
    assert sum(r.blocked == r.p for r in scored) >= 290


def test_suffix_statistics_are_of_other_folds_and_of_all_suffixes(spark):
    rng = random.Random(8)
    # the verdict hangs on the suffix, but for 400 suffixes that occur once, whose verdict hangs on the path
    rows = [(f"http://{'bad' if i % 2 else 'good'}.net/{rng.randrange(10**6)}", i % 2) for i in range(200)]
    rows += [(f"http://x.once{i}.org/" + ("a/b/c/d" if i % 2 else "a"), i % 2) for i in range(400)]
    ready = labelled_urls(spark, rows)
    model = urls.train(ready, trees=10, depth=3)
    assert model["statistics"].count() == 402
    new = labelled_urls(spark, [("http://bad.net/712345", 1), ("http://good.net/712345", 0), ("http://y.never.org/a/b/c/d", 1), ("http://y.never.org/a", 0)])
    got = urls.features(new, model["statistics"]).select("url", "blocked", (urls.raw_score(model) > 0).cast("int").alias("p")).collect()
    assert all(r.blocked == r.p for r in got), got
    summed, _ = urls.summed(ready, 1.0, 1.0)
    alone = summed.where("f_suffix_weight = 0 AND f_depth = 4").collect()  # a suffix seen once knows nothing of itself
    assert sum(r.n for r in alone) == 400


def brute_passages(rows, n):
    seen = collections.defaultdict(set)
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add(d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        start = None
        for i in range(len(w) - n + 2):
            repeats = i <= len(w) - n and len(seen[tuple(w[i : i + n])]) > 1
            if repeats and start is None:
                start = i
            if not repeats and start is not None:
                out.append((str(d), start, i - 1 - start + n))
                start = None
    return sorted(out)


def test_passages(spark, rows, monkeypatch):
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.first_word, r.n_words) for r in got) == brute_passages(rows, 50)
    assert any(140 <= (r.doc_id or 0) < 144 and r.n_words == 70 for r in got)
    # small passages over a small vocabulary: many mixed contexts; several passes; spread keys
    rng = random.Random(4)
    common = [words(rng, 12, 9) for _ in range(6)]
    mixed = [(i, " ".join(rng.choice([rng.choice(common), words(rng, 5, 9)]) for _ in range(8))) for i in range(60)]
    monkeypatch.setattr(passages, "SPREAD", 3)
    got = passages.repeated_passages(frame(spark, mixed), passage=12, gram=2, block=4, pass_keys=40, shard_windows=50).collect()
    assert sorted((str(r.doc_id), r.first_word, r.n_words) for r in got) == brute_passages(mixed, 12)
    assert passages.repeated_passages(frame(spark, rows).limit(0)).count() == 0


def test_lines(spark, rows):
    got = {r.doc_id: r for r in lines.drop_recurring_lines(frame(spark, rows)).collect()}
    assert got[150].text == "\n".join(rows[[d for d, _ in rows].index(150)][1].split("\n")[::2]) and (got[150].n_lines, got[150].n_dropped) == (3, 1)
    before = dict(rows)
    assert all(got[d].text == before[d] for d in got if d is not None and not 150 <= d < 180)
    assert (got[201].n_lines, got[202].n_lines, got[203].n_lines) == (0, 1, 2)
    kept = lines.stage(spark, frame(spark, rows), "")
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows) and kept.first()["n_lines"] == "n"
    assert lines.drop_recurring_lines(frame(spark, rows).limit(0)).count() == 0


def test_line_stage_counts_each_group_of_copies_once(spark):
    rng = random.Random(15)
    footer, block = ["First footer line.", "Les."], ["Share this", "Tweet that", "Print me", "All rights held."]
    docs = [(i, [*[words(rng, 12) for _ in range(4)], *(footer if i < 40 else block)]) for i in range(80)]
    body = [words(rng, 40) for _ in range(6)]
    copies = [(1000 + i, [*body[:5], f"{body[5]} copy" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10], *footer]) for i in range(60)]
    copies += [(2000 + i, copies[0][1]) for i in range(60)]
    texts = {d: "\n".join(x) for d, x in docs + copies + [(3000, ["Les."]), (3001, ["Les."])]}
    got = {r.doc_id: r.text for r in lines.stage(spark, frame(spark, list(texts.items())), "").collect()}
    assert all(got[d] == "\n".join(x[:4]) for d, x in docs)
    assert all(got[d] == "\n".join(x[:6]) for d, x in copies)
    assert got[3000] == got[3001] == ""


def brute_recurring(rows, support):
    """The masked lines whose templates recur, by the rule as lines.py states it."""
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n") if t is not None else ():
            masked = " ".join("<*>" if re.search(r"[0-9@]|://", y) else y for y in re.sub(r"[ \t\r\f\x0B]+", " ", x).strip(" ").split(" "))
            if masked:
                held[masked].add(-1 if d is None else d)
    lead = {}
    for d in {d for ds in held.values() for d in ds}:
        points = collections.Counter()
        for x, ds in held.items():
            if d in ds:
                points[min(ds)] += len(x)
        others = sorted((-n, f) for f, n in points.items() if f != d)
        lead[d] = others[0][1] if others and -others[0][0] * 3 >= sum(points.values()) else d
    credit = {x: {lead[d] for d in ds} for x, ds in held.items()}
    leaves = collections.defaultdict(set)
    for x in credit:
        w = x.split(" ")
        for i in range(3 if len(w) >= 3 else 0):
            leaves[len(w), i, tuple(w[len(w) * i // 3 : len(w) * (i + 1) // 3])].add(x)
    meets = collections.defaultdict(set)
    for (n, _, _), own in leaves.items():
        everyone = set().union(*(credit[x] for x in own))
        if len(everyone) < support:
            continue
        at = collections.Counter()
        for x in own:
            for p, token in enumerate(x.split(" ")):
                at[p, token] += len(credit[x])
        for x in own:
            for stays in (lambda c: c >= support, lambda c, k=sum(len(credit[x]) for x in own): 5 * c >= 4 * k):
                pattern = tuple(token if stays(at[p, token]) else "<*>" for p, token in enumerate(x.split(" ")))
                if 5 * sum(stays(at[p, token]) for p, token in enumerate(x.split(" "))) >= 3 * n:
                    meets[pattern].add(x)
    found = {x for x, c in credit.items() if len(c) >= support}
    for own in meets.values():
        if len(set().union(*(credit[x] for x in own))) >= support:
            found |= own
    return found


@pytest.mark.parametrize("wide", [lines.WIDE, 1])
def test_line_templates_with_words_in_their_fields(spark, monkeypatch, wide):
    monkeypatch.setattr(lines, "WIDE", wide)  # what stays in a leaf is joined as one array, or token by token
    rng = random.Random(16)
    names, cities = [words(rng, 1) for _ in range(300)], [words(rng, 1) for _ in range(300)]
    kinds = (
        lambda i: f"user {names[i]} logged in from office",
        lambda i: f"Posted by {names[i]} in {cities[i]}",
        lambda i: f"{names[i]} replied to the post by {names[-i]}",
        lambda i: f"Filed under {'news' if i % 3 else cities[i]} on page {i}",  # one value is frequent
        lambda i: f"{names[i]} likes {cities[i]}",  # too little stays
        lambda i: f"{names[i]} and {names[-i]} saw {cities[i]}",
    )
    rows = []
    for k, kind in enumerate(kinds):
        for i in range(40):
            rows.append((100 * k + i, "\n".join([words(rng, 9), kind(i), words(rng, 9)])))
    rows += [(700 + i, f"{words(rng, 9)}\nrare {names[i]} of them seen\n{words(rng, 9)}") for i in range(10)]  # too few
    rows += [(800 + i, words(random.Random(1), 90) + f"\nCopy of {names[i]} was here\n" + words(random.Random(2), 90)) for i in range(50)]  # near copies
    rows += [(None, rows[0][1]), (None, None), (900, ""), (901, " \n\t"), (902, "user x logged in from office"), (0, rows[0][1])]
    got = collections.defaultdict(list)
    for r in lines.drop_recurring_lines(frame(spark, rows)).collect():
        got[r.doc_id].append(r.text)
    bad = brute_recurring(rows, 20)
    for d, t in rows:
        mask = lambda x: " ".join("<*>" if re.search(r"[0-9@]|://", y) else y for y in re.sub(r"\s+", " ", x).strip().split(" "))
        want = None if t is None else "\n".join(x for x in t.split("\n") if mask(x) not in bad)
        assert want in got[d], (d, t)
    left = {d: len(x[0].split("\n")) for d, x in got.items() if x[0]}
    assert all(left[100 * k + i] == 2 for k in range(4) for i in range(40)) and all(left[100 * k + i] == 3 for k in (4, 5) for i in range(40))
    assert all(left[d] == 3 for d in [*range(700, 710), *range(800, 850)]) and got[902] == [""]


def test_masked_lines(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a  12\tb ",), ("a 7x b",), ("a mail@x b",), ("a b",), ("",)], "x string")
    assert [r[0] for r in df.select(lines.masked(lines.bare(F.col("x")))).collect()] == ["a <*> b"] * 3 + ["a b", ""]


def test_toxicity(spark, rows):
    rng = random.Random(6)
    bad = ["foul", "vile", "nasty"]
    texts, grades = list(rows), []
    for i in range(400):
        severe = i % 3
        texts.append((5000 + i, words(rng, 60) + (" " + " ".join(rng.choices(bad, k=1 + 4 * (severe == 2))) if severe else "")))
        grades.append((5000 + i, int(severe > 0), int(severe != 2)))
    labels = spark.createDataFrame([(d, q, t, 1) for d, t, q in grades[:250]] + [(None, 1, 1, 1), (5000, None, None, 1), (99999, 1, 1, 1)], "doc_id long, quality int, toxic int, text int")
    df = frame(spark, texts)
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert all(got[d].rejected == bool(t) for d, t, _ in grades[250:])
    assert not any(got[d].rejected for d, _ in rows)
    assert all(abs(sum(r.grade_probabilities) - 1) < 1e-9 for r in got.values())
    assert np.mean([got[d].severity for d, t, q in grades if not q]) > np.mean([got[d].severity for d, t, q in grades if t and q])
    assert toxicity.toxicity(df, labels.limit(0)).where("rejected").count() == 0
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def test_the_ordinal_fit_is_the_least_loss():
    rng = random.Random(21)
    docs, grades = [], []
    for _ in range(600):
        x = [f for f in range(4) if rng.random() < 0.4]
        z = 1.5 * (0 in x) + 0.7 * (1 in x) - 1.0 * (2 in x) + math.log((u := rng.random()) / (1 - u))
        docs.append(x)
        grades.append(int(z > 0.5) + int(z > 2.0))
    model = toxicity.fit(np.array(grades), docs, list("abcd"), steps=3000, shrink=0.0)

    def loss(p):
        w, cuts = p[:4], p[4:]
        return sum(math.log1p(math.exp(-s * (sum(w[f] for f in x) - c))) for x, g in zip(docs, grades, strict=True) for j, c in enumerate(cuts) for s in [1 if g > j else -1]) / len(docs)

    p, step = [0.0] * 4 + [0.5, 2.0], 0.5  # one coordinate at a time, by trial
    while step > 1e-3:
        before = loss(p)
        for k in range(6):
            for d in (step, -step):
                q = [*p]
                q[k] += d
                if loss(q) < loss(p):
                    p = q
        if before - loss(p) < 1e-9:
            step /= 2
    assert np.allclose([model.weights[x] for x in "abcd"] + model.cuts, p, atol=0.02)


def test_toxic_grades_by_dose():
    assert toxicity.by_dose([0, 1, 1, 1, 0], [[1], [1], [1, 2], [1, 2, 3, 9], []], {1, 2, 3}) == [0, 1, 1, 2, 0]
    assert toxicity.by_dose([0, 0], [[], []], {1}) == [0, 0] and toxicity.by_dose([], [], set()) == []


def test_toxicity_of_given_grades_and_its_stage(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = random.Random(22)
    texts = [(i, words(rng, 40) + ["", " sharp", " sharp vile", " sharp vile foul"][i % 4]) for i in range(400)]
    df = frame(spark, [*texts, (None, None), (900, ""), (901, None), (3, texts[3][1])])
    labels = spark.createDataFrame([(i, i % 4, int(i % 4 > 0), 1) for i, _ in texts[:200]] + [(5, 0, 0, 1), (None, 3, 1, 1)], "doc_id long, harm int, toxic int, quality int")
    model = toxicity.train(df, labels, grade=F.col("harm"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    means = [np.mean([got[i].severity for i, _ in texts[200:] if i % 4 == g]) for g in range(4)]
    assert len(model.cuts) == 3 and model.cuts == sorted(model.cuts) and means == sorted(means) and means[3] - means[0] > 2
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = toxicity.stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter([*(i for i, _ in texts if i % 4 == 0), None, 900, 901])
    assert toxicity.stage(spark, df.limit(0), str(tmp_path)).count() == 0
