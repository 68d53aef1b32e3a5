"""Small worked examples for the library's operators."""

import math
import random
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import vocabulary
from tarnwick.operators import corpus, evaluation, extraction, graph, search
from tarnwick.plans import catalogue
from tarnwick.sources import tables

FIELDS = "task array<double>, backbone array<double>, loss array<double>, key_idea array<double>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_dense_ranks_by_inner_product(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, None)], "paper_id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [0.9, 0.1, 0.0])], "query_id long, embedding array<float>")
    assert [(r.paper_id, r.rank) for r in search.dense_topk(queries, docs, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert search.dense_topk(queries.limit(0), docs, 2).count() == 0


def test_bm25_keeps_zero_scores_and_drops_blank_queries(spark):
    docs = spark.createDataFrame([(1, "graph neural"), (2, "matrix factors"), (3, None)], "paper_id long, text string")
    queries = spark.createDataFrame([(1, "graph"), (2, ""), (3, "   ")], "query_id long, text string")
    got = search.bm25_topk(queries, docs, 3).orderBy("rank").collect()
    assert [(r.query_id, r.paper_id, r.score > 0) for r in got] == [(1, 1, True), (1, 2, False), (1, 3, False)]


def card(i, **fields):
    return (i, *[fields.get(f) for f in ("task", "backbone", "loss", "key_idea")])


@pytest.mark.parametrize(
    ("a", "b", "how", "want"),
    [
        ({"task": [1.0, 0.0], "backbone": [1.0, 0.0]}, {"task": [1.0, 0.0], "backbone": [1.0, 0.0]}, {}, 0.5),
        ({"task": [1.0, 0.0], "backbone": [1.0, 0.0]}, {"task": [1.0, 0.0], "backbone": [1.0, 0.0]}, {"normalised": True}, 1.0),
        ({"task": [1.0, 0.0]}, {"task": [1.0, 0.0]}, {"normalised": True, "least_fields": 2}, 0.0),
        ({"task": [1.0, 0.0]}, {"loss": [1.0, 0.0]}, {"normalised": True}, 0.0),
        ({"task": [1.0, 0.0]}, {}, {}, 0.0),
    ],
)
def test_field_match(spark, a, b, how, want):
    anchors = spark.createDataFrame([card(1, **a)], f"query_id long, {FIELDS}")
    rows = spark.createDataFrame([card(1, **a), card(2, **b)], f"paper_id long, {FIELDS}")
    got = search.field_match(anchors, rows, 5, **how).collect()
    assert [(r.paper_id, round(r.score, 9)) for r in got] == [(2, want)]


def test_fusion(spark):
    rows = [("dense", 1, 1), ("dense", 2, 2), ("bm25", 1, 1), ("bm25", 3, 2), ("method_match", 1, 1), ("method_match", 2, 2)]
    s = spark.createDataFrame([(1, p, n, 0.5, r) for n, p, r in rows], "query_id long, paper_id long, signal string, score double, rank int")
    got = {r.paper_id: (round(r.score, 6), r.bm25) for r in search.fuse(s, 10).collect()}
    assert got == {1: (round(1 / 61, 6), 0.5), 2: (round(0.8 / 62, 6), None), 3: (round(0.2 / 62, 6), 0.5)}


def test_rerank_drops_missing_texts(spark):
    hits = spark.createDataFrame([(1, 1), (1, 2), (1, 9)], "query_id long, paper_id long")
    queries = spark.createDataFrame([(1, "q")], "query_id long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, "bbb")], "paper_id long, text string")
    got = search.rerank(hits, queries, docs, lambda q, d: [float(len(x)) for x in d], 5).orderBy("rank").collect()
    assert [r.paper_id for r in got] == [2, 1]


def test_metrics(spark):
    runs = spark.createDataFrame([("m", 1, p, r) for r, p in enumerate([9, 1, 8, 2, 7], 1)] + [("m", 2, 5, 1), ("m", 3, 5, 1)], "method string, query_id long, paper_id long, rank int")
    gold = spark.createDataFrame([(1, 1), (1, 2), (3, 6)], "query_id long, paper_id long")
    anchored = spark.createDataFrame([(1,), (2,)], "query_id long")
    r = {(x.method, x.query_id): x for x in evaluation.per_query(runs, gold, methods=["m", "x", "method_match_norm"], anchored=anchored).collect()}
    assert set(r) == {("m", 1), ("m", 3), ("x", 1), ("x", 3), ("method_match_norm", 1)}  # no answer counts, no anchor does not
    assert math.isclose(r["m", 1].ndcg, (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))) and (r["m", 1].mrr, r["m", 1].recall) == (0.5, 1.0)
    assert {(x.ndcg, x.mrr, x.recall) for k, x in r.items() if k != ("m", 1)} == {(0.0, 0.0, 0.0)}


def test_verdict_and_classification(spark):
    t = spark.createDataFrame([("dense", 0.2), ("a", 0.3), ("b", 0.1), ("c", 0.2)], "method string, ndcg double")
    assert {r.method: (r.verdict, r.code) for r in evaluation.verdict(t).collect()} == {"a": ("BEATS", 0), "b": ("BELOW", 2), "c": ("matches", 0)}
    m = spark.createDataFrame([("dense", 1), ("bm25", 1), ("a", 1), ("dense", 2)], "method string, query_id long")
    assert {tuple(r) for r in evaluation.same_subset(m, spark.createDataFrame([(1,)], "query_id long")).select("method", "query_id").collect()} == {("dense", 1), ("a", 1)}
    p = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, predicted int")
    r = evaluation.classification(p, [0, 1, 2]).first()
    assert (round(r.macro_f1, 6), round(r.accuracy, 6), r.n) == (round((2 / 3 + 2 / 3 + 0) / 3, 6), 0.666667, 3)


def papers(spark, *titles):
    return spark.createDataFrame([(i, i, t, a) for i, (t, a) in enumerate(titles)], "paper_id long, pos long, title string, abstract string")


def test_titles(spark):
    assert one(spark, T.title_key(F.lit("  Étion, a_b! (X)"))) == "étion a_b x"
    assert one(spark, T.marked_up_title_key(F.lit("<i>DiffNet</i>++"))) == "diffnet plusplus"
    p = papers(spark, ("LightGCN", "short"), ("LightGCN: simplifying and powering graph convolution", "a longer one"), ("Graph neural networks for recommendation", ""), ("Graph neural networks for social recommendation", ""), ("graph, neural networks FOR recommendation", "x"))
    assert {(r.a, r.b) for r in corpus.duplicate_titles(p).collect()} == {(0, 1)}
    assert {(r.paper_id, r.slot, r.n) for r in corpus.dedupe_exact(p).collect()} == {(0, 0, 1), (1, 1, 1), (4, 2, 2), (3, 3, 1)}


def test_titles_match_by_the_shorter_in_characters(spark):
    p = papers(spark, ("lightgcn of the and for networks", ""), ("lightgcn abc", ""), ("", "x"), ("", "y"), (" ", ""), ("Alpha beta gamma delta", ""), ("alpha beta gamma delta eps", ""))
    assert {(r.a, r.b) for r in corpus.duplicate_titles(p).collect()} == {(5, 6)}
    assert {(r.paper_id, r.n) for r in corpus.dedupe_exact(p).collect()} == {(i, 1) for i in range(7)}


def test_fuller_records_have_more_of_five_things(spark):
    rows = [(0, 0, "T one two", "ab", ["x"], ["a"], {}), (1, 1, "t one two", "ab", ["x", "y"], [], {}), (2, 2, "T, one two", "ab", ["x", "y"], [], {"s": "1"})]
    p = spark.createDataFrame(rows, "paper_id long, pos long, title string, abstract string, references array<string>, authors array<string>, source_ids map<string,string>")
    assert [(r.paper_id, r.slot, r.n) for r in corpus.dedupe_exact(p).collect()] == [(2, 0, 3)]


def plain_match(a, b):
    """The rule of two title keys, a the newer one, word for word."""
    wa, wb = corpus.significant(a), corpus.significant(b)
    (s, ws), (l, wl) = ((a, wa), (b, wb)) if len(a) <= len(b) else ((b, wb), (a, wa))
    if a == b:
        return bool(a)
    if not wa or not wb:
        return False
    return (len(ws) == 1 and len(next(iter(ws))) >= 4 and ws <= wl) or (len(ws) >= 3 and len(ws & wl) >= 0.9 * len(ws) - 1e-9 and len(s) >= 0.75 * len(l))


def test_known_titles_find_the_first_match():
    rng = random.Random(4)
    keys = [" ".join(rng.choice(("graph", "lightgcn", "kgat", "abc", "social", "the", "deep", "rank", "user")) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    known, order = corpus.KnownTitles(), []
    for k in keys:
        want = k if k in order else next((x for x in order if plain_match(k, x)), None)
        assert known.match(k) == (None if want is None else order.index(want)), k
        if rng.random() < 0.3:
            known.learn(k)
            order += [k] * (k not in order)


def test_greedy_dedupe_keeps_the_fuller_in_the_first_slot():
    rec = [{"id": "a", "ids": ["1"], "key": "lightgcn", "fuller": (1, 5)}, {"id": "b", "ids": ["2"], "key": "lightgcn simplifying graph convolution", "fuller": (1, 50)}, {"id": "c", "ids": ["2"], "key": "other", "fuller": (1, 1)}, {"id": "d", "ids": [], "key": "other", "fuller": (0, 0)}]
    assert [r["id"] for r in corpus.greedy_dedupe(iter(rec))] == ["b", "d"]
    blank = [{"id": i, "ids": [], "key": "", "fuller": (0, 0)} for i in range(3)]
    assert [r["id"] for r in corpus.greedy_dedupe(iter(blank))] == [0, 1, 2]
    moved = [{"id": "a", "ids": ["1"], "key": "alpha beta", "fuller": (1,)}, {"id": "b", "ids": ["2"], "key": "gamma delta", "fuller": (1,)}, {"id": "c", "ids": ["2"], "key": "alpha beta", "fuller": (2,)}, {"id": "d", "ids": [], "key": "alpha beta", "fuller": (3,)}]
    assert [r["id"] for r in corpus.greedy_dedupe(iter(moved))] == ["a", "d"]  # the title went over to the second slot


def test_greedy_dedupe_over_a_corpus(spark):
    from tarnwick.plans.greedy import greedy

    p = papers(spark, ("LightGCN", "short"), ("lightgcn: simplifying and powering", "a longer one"), ("Alpha beta gamma", "x"), ("alpha, beta gamma", "x"), ("Other", ""), ("", "y"), ("", "z"))
    assert sorted(r.paper_id for r in greedy(p).collect()) == [1, 2, 4, 5, 6]
    by_work = p.withColumn("work_id", F.when(F.col("paper_id").isin(4, 6), "W7"))
    assert sorted(r.paper_id for r in greedy(by_work).collect()) == [1, 2, 5, 6]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 9), (3, 0)], "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    assert {r.rep: r.component for r in corpus.linked_titles(pairs).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 9: 5}


def test_merged_seeds_match_titles_and_each_other(spark):
    c = papers(spark, ("LightGCN: simplifying graph convolution", ""), ("", ""))
    rows = [(10, 0, "LightGCN"), (11, 1, "KGAT"), (12, 2, "KGAT attention for users"), (13, 3, ""), (14, 4, " "), (0, 5, "new title"), (15, 6, "Fresh paper of seeds"), (15, 7, "again"), (16, 8, "fresh paper of seeds")]
    s = spark.createDataFrame([(i, p, t, "") for i, p, t in rows], "paper_id long, pos long, title string, abstract string")
    assert sorted(r.paper_id for r in corpus.merge_seeds(c, s).collect()) == [11, 13, 14, 15]


def test_title_resolution(spark):
    p = papers(spark, ("LightGCN: Simplifying GCN", ""), ("SiReN: Sign-Aware", ""), ("Neural Graph Collaborative Filtering", ""), ("DiffNet", ""), ("DiffNet++", ""), ("SelfGNN: x", ""))
    gold = spark.createDataFrame([(1, "LightGCN"), (2, "<i>SiReN</i>"), (3, "NGCF"), (4, "DiffNet"), (5, "DiffNet++"), (6, "FGNN"), (7, "Collaborative Filter"), (8, "zzz")], "title_id long, title string")
    got = {r.title_id: (r.paper_id, r.strategy) for r in corpus.resolve_titles(gold, p, vocabulary.TITLE_ALIASES).collect()}
    assert got == {1: (0, "colon"), 2: (1, "colon"), 3: (2, "alias"), 4: (3, "exact"), 5: (4, "exact"), 6: (None, None), 7: (2, "substring"), 8: (None, None)}
    anchors = spark.createDataFrame([("diffnet", 5), ("zzz", 77)], "key string, paper_id long")
    got = {r.title_id: (r.paper_id, r.strategy) for r in corpus.resolve_titles(gold, p, anchors=anchors).collect()}
    assert (got[4], got[8]) == ((5, "anchor"), (None, None))
    r = corpus.resolve_close(gold.limit(0).unionByName(spark.createDataFrame([(1, "Hypergraph Contrastive Collaborativ Filtering"), (2, "FGNN"), (3, "")], gold.schema)), papers(spark, ("Hypergraph Contrastive Collaborative Filtering", ""), ("SelfGNN: x", "")), vocabulary.TITLE_ALIASES)
    assert {x.title_id: x.strategy for x in r.collect()} == {1: "fuzzy", 2: None, 3: None}


def test_close_titles_are_the_closest_of_all(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choices("abc de", k=rng.randrange(1, 40))).strip() for _ in range(150)] + ["", "long " * 60, "long " * 59 + "lung"]
    keys += keys[:5]
    gold = ["".join(c for c in k if rng.random() > 0.08) for k in keys[:60]] + ["", "x", "long " * 60 + "end"]
    p = spark.createDataFrame([(100 + i, i, k) for i, k in enumerate(keys)], "paper_id long, pos long, key string").repartition(3)
    got = {r.title_id: (r.paper_id, r.ratio) for r in corpus.close_titles(spark.createDataFrame(list(enumerate(gold)), "title_id long, key string"), p, block=300).collect()}
    for i, g in enumerate(gold):
        hit = get_close_matches(g, [k for k in keys if k], n=1, cutoff=0.85) if g else []
        assert got.get(i, (None,))[0] == (100 + keys.index(hit[0]) if hit else None)
    assert corpus.close_titles(p.limit(0).select(F.col("pos").alias("title_id"), "key"), p).count() == 0


def test_balanced_selection(spark):
    p = spark.createDataFrame([(0, 0, "early"), (1, 1, "early"), (2, 2, "early"), (3, 3, "late"), (4, 4, "late"), (5, 5, "seed")], "paper_id long, pos long, area string")
    assert [r.paper_id for r in corpus.balanced_select(p, ["early", "late"], 4).orderBy("turn", "area").collect()] == [0, 3, 1, 4]


EDGES = "src long, dst long, edge_pos long, intent string"


def test_ancestors(spark):
    edges = spark.createDataFrame([(1, 2, 0, None), (2, 3, 0, None), (3, 1, 0, None)], EDGES)
    sims = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.7)], "anchor long, node long, similarity double")
    anchors = spark.createDataFrame([(1,), (4,)], "anchor long")
    got = {r.node: (r.rank, round(r.score, 6)) for r in graph.ancestors(anchors, edges, sims).collect()}
    assert got == {2: (1, 0.45), 3: (2, 0.175)}
    assert {r.node for r in graph.ancestors(anchors, edges, sims, max_hops=1).collect()} == {2}


def test_opposing(spark):
    sims = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.95), (1, 4, 0.5)], "anchor long, node long, similarity double")
    anchors = spark.createDataFrame([(1,)], "anchor long")
    edges = spark.createDataFrame([(1, 2, 0, "comparison"), (4, 1, 0, "comparison"), (1, 3, 1, "method"), (1, 9, 2, "comparison")], EDGES)
    assert [(r.node, r.fallback) for r in graph.opposing(anchors, edges, sims).orderBy("rank").collect()] == [(2, False), (4, False)]
    plain = edges.withColumn("intent", F.lit("method"))
    assert [(r.node, round(r.score, 6)) for r in graph.opposing(anchors, plain, sims).orderBy("rank").collect()] == [(2, 0.9), (4, 0.5), (3, 0.05)]


def test_induced_graph(spark):
    p = spark.createDataFrame([(1, [2, 2, 99]), (2, [3]), (3, None), (6, [])], "paper_id long, references array<long>")
    e = graph.induced_edges(p)
    assert {(r.src, r.dst) for r in e.collect()} == {(1, 2), (2, 3)}
    r = graph.graph_counts(p.select(F.col("paper_id").alias("node")), e).first()
    assert (r.n_nodes, r.n_edges, r.n_isolated) == (4, 2, 1)


def test_annotation(spark):
    edges = spark.createDataFrame([(1, 2, None), (2, 3, "background"), (5, 5, None)], "src long, dst long, intent string")
    c = spark.createDataFrame([(1, 2, 0, None), (1, 2, 1, ["background", "methodology"]), (1, 2, 2, ["result"]), (2, 3, 0, ["result"]), (5, 5, 0, ["result"])], "src long, dst long, pos long, intents array<string>")
    assert {(r.src, r.intent) for r in graph.annotate(edges, c).collect()} == {(1, "method"), (2, "background"), (5, None)}
    assert {(r.src, r.intent) for r in graph.annotate(edges, c, relabel=True).collect()} == {(1, "comparison"), (2, "comparison"), (5, None)}


def test_labels_and_ids(spark):
    for raw, want in (("methodology", "method"), ("result", "comparison"), ("odd", "background"), (None, "background")):
        assert one(spark, T.label_map(F.lit(raw).cast("string"), T.SERVICE_INTENTS)) == want
    assert one(spark, T.label_map(F.lit("LABEL_2"), T.CLASSIFIER_INTENTS)) == "comparison"
    assert one(spark, T.doi(F.lit("https://doi.org/10.1145/ABC "))) == "10.1145/abc" and one(spark, T.doi(F.lit(" "))) is None
    assert one(spark, T.short_id(F.lit("https://x.org/W12"))) == "W12"
    index = F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.array(F.lit(1)), F.array(F.lit(0), F.lit(2))))
    assert one(spark, T.from_inverted_index(index)) == "a b a"


@pytest.mark.parametrize(("raw", "ok"), [('{"paragraph": "p"}', True), ('```json\n{"paragraph": "p"}\n```', True), ('Well: {"paragraph": "p"} there', True), ("garbage", False)])
def test_replies(spark, raw, ok):
    r = extraction.parse_replies(spark.createDataFrame([(1, raw)], "id long, raw string")).first()
    assert (r.paragraph, r.failed) == (("p", False) if ok else ("garbage", True))


def test_citation_check(spark):
    assert one(spark, T.markers(F.lit("[1], [2] and [1]"))) == [1, 2]
    cited = spark.createDataFrame([(1, "See [1] and [3]")], "id long, paragraph string")
    refs = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "id long, n int, paper_id string")
    shown = spark.createDataFrame([(1, 1, "X"), (1, 2, "B")], "id long, n int, paper_id string")
    assert sorted((r.issue, r.n) for r in extraction.check_citations(cited, refs, shown).collect()) == [("marker without reference", 3), ("number not shown", 3), ("paper differs", 1), ("reference never cited", 2)]


def test_entities_and_spans(spark):
    e = spark.createDataFrame([(1, 0, "Light ##GCN", "B-Method", 0.9), (1, 1, "lightgcn", "method", 0.8), (1, 2, "Gowalla", "dataset", 0.7), (1, 3, "x", "odd", 0.1)], "paper_id long, pos long, word string, label string, score double")
    assert sorted((r.text, r.kind) for r in extraction.dedupe_entities(e).collect()) == [("Gowalla", "dataset"), ("LightGCN", "method")]
    texts = spark.createDataFrame([(1, "On Gowalla data")], "paper_id long, text string")
    terms = spark.createDataFrame([(1, "gowalla"), (1, "absent"), (1, " ")], "paper_id long, term string")
    assert [(r.term, r.start, r.end) for r in extraction.spans(texts, terms).collect()] == [("gowalla", 3, 10)]


def test_prompts_and_filters(spark):
    p = papers(spark, ("T", "Abstract"))
    r = p.select(extraction.messages("s", [("q", "a")] * 4, F.col("title"), F.col("abstract")).alias("m")).select(F.size("m").alias("n"), extraction.estimated_tokens(F.col("m")).alias("t")).first()
    assert (r.n, r.t) == (10, (1 + 8 + len("Title: T\n\nAbstract: Abstract")) // 4)
    assert [one(spark, T.is_survey(F.lit(x).cast("string"))) for x in ("A Survey of x", "R1", None)] == [True, False, False]
    assert one(spark, corpus.topical(F.lit("Graph for recommendation"), ("graph",), ("recommend",))) is True


def test_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"paper_id": "W1", "title": "t", "odd": 1}, {"paper_id": "W2", "title": "u", "references": ["W1"]}]')
    p = tables.read_papers(spark, str(tmp_path / "p.json"))
    assert [(r.paper_id, r.citation_count, r.references) for r in p.orderBy("pos").collect()] == [("W1", 0, []), ("W2", 0, ["W1"])]
    path = str(tmp_path / "cache")
    make = lambda df: df.select("paper_id", F.lit("x").alias("v"))
    assert tables.append_missing(p.limit(1), path, make) == 1 and tables.append_missing(p, path, make) == 1 and tables.append_missing(p, path, make) == 0
    tables.write_versioned(p, str(tmp_path / "g"), partial=True)
    assert tables.current_version(spark, str(tmp_path / "g")) is None
    assert tables.current_version(spark, str(tmp_path / "g")) != tables.write_versioned(p, str(tmp_path / "g")) == tables.current_version(spark, str(tmp_path / "g"))
    waits = []
    with pytest.raises(OSError):
        tables.with_backoff(lambda: (_ for _ in ()).throw(OSError()), sleep=waits.append)
    assert waits == [2.0, 4.0, 8.0, 16.0]
    assert tables.all_pages(lambda c, n: (list(range(n)), "more"), 450) == [*range(200), *range(200), *range(50)]


def test_stream_extracts_each_id_once(spark, tmp_path):
    from tarnwick.streaming.incremental import keep_extracted

    spark.createDataFrame([(1,), (1,), (2,)], "paper_id long").write.parquet(str(tmp_path / "in"))
    make = lambda df: df.select("paper_id", F.lit("x").alias("v"))
    for n in range(2):
        stream = spark.readStream.schema("paper_id long").parquet(str(tmp_path / "in"))
        keep_extracted(stream, str(tmp_path / "out"), make, str(tmp_path / f"c{n}")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_catalogue_has_sql_for_its_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert catalogue.FLAGSHIP in catalogue.queries()


def _random_graph(spark, n=60):
    rng = random.Random(5)
    edges = [(s, d, i, rng.choice(["method", "background", "comparison", None])) for s in range(n) for i, d in enumerate(rng.sample(range(n), rng.choice([1, 3, 14, 20]))) if s != d]
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    cards = [(i, *[vector() if rng.random() < 0.7 and i % 7 else None for _ in range(4)]) for i in range(n)]
    cards = spark.createDataFrame(cards, "paper_id long, " + ", ".join(f"{f} array<double>" for f in search.FIELD_WEIGHTS))
    return spark.createDataFrame(edges, "src long, dst long, edge_pos long, intent string"), cards


def test_similarity_of_the_pairs_asked_for(spark):
    _, cards = _random_graph(spark)
    queries = cards.withColumnRenamed("paper_id", "query_id")
    want = {(r.query_id, r.paper_id): round(r.score, 9) for r in search.field_match(queries, cards, 100).where("n_fields > 0").collect()}
    similarity = search.FieldSimilarity(queries, cards)
    pairs = spark.range(60).selectExpr("id AS anchor").join(spark.range(0, 60, 3).selectExpr("id AS node"))
    assert {(r.anchor, r.node): round(r.similarity, 9) for r in similarity.of(pairs).collect()} == {p: s for p, s in want.items() if p[1] % 3 == 0}
    least = spark.range(60).selectExpr("id AS anchor", "id / 60D AS least")
    assert {(r.anchor, r.node): round(r.similarity, 9) for r in similarity.above(least).collect()} == {p: s for p, s in want.items() if s >= p[0] / 60}


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_ancestors_are_the_best_of_all_arrivals(spark, hops):
    """the last hop goes only to nodes that can be among the best, and only their similarities are looked up."""
    edges, cards = _random_graph(spark)
    anchors = spark.range(0, 60, 4).selectExpr("id AS anchor")
    similarity = search.FieldSimilarity(cards.withColumnRenamed("paper_id", "query_id"), cards)
    sims = {(r.query_id, r.paper_id): r.score for r in search.field_match(cards.withColumnRenamed("paper_id", "query_id"), cards, 100).where("n_fields > 0").collect()}
    found = {}
    for r in graph.arrivals(anchors, edges, hops).collect():
        weight = sum(graph.INTENT_WEIGHTS[i] for i in r.intents)
        score = weight / r.hop / r.hop * max(sims.get((r.anchor, r.node), 0.0), 1e-6)
        found.setdefault(r.anchor, {}).setdefault(r.node, []).append((-round(score, 9), r.hop, r.path))
    want = set()
    for a, nodes in found.items():
        for node in sorted(nodes, key=lambda n: (min(nodes[n])[0], n))[:4]:
            want |= {(a, node, i + 1, *map(str, p[1:])) for i, p in enumerate(sorted(nodes[node])[:2])}
    got = graph.ancestors(anchors, edges, similarity, max_hops=hops, k=4, paths=2).collect()
    assert {(r.anchor, r.node, r.path_rank, str(r.hop), str(r.path)) for r in got} == want


def test_opposing_asks_for_neighbours_only(spark):
    """similarities are not made for pairs without an edge."""
    edges = spark.createDataFrame([(1, 2, 0, "comparison"), (3, 1, 1, "method"), (2, 3, 2, None)], "src long, dst long, edge_pos long, intent string")
    asked = []

    class Asked(graph.Known):
        def of(self, pairs):
            asked.append({(r.anchor, r.node) for r in pairs.collect()})
            return super().of(pairs)

    sims = spark.createDataFrame([(a, b, 0.1 * b) for a in range(5) for b in range(5)], "anchor long, node long, similarity double")
    anchors = spark.createDataFrame([(1,)], "anchor long")
    assert [r.node for r in graph.opposing(anchors, edges, Asked(sims)).collect()] == [2]
    assert [r.node for r in graph.opposing(anchors, edges, Asked(sims), comparison=False).orderBy("rank").collect()] == [2, 3]
    assert asked == [{(1, 2)}, {(1, 2), (1, 3)}]


def test_known_titles_compare_few_of_many(monkeypatch):
    """a title meets those that share its rare words, not all that share a frequent one; matches stay the rule's."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)] + ["graph", "abc", "survey"]
    keys = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 11, 20]))) for _ in range(400)]
    known, learnt = corpus.KnownTitles(), []
    for key in dict.fromkeys(keys):
        want = None
        for i, other in enumerate(learnt):
            short, long = (key, other) if len(key) <= len(other) else (other, key)
            s, both = corpus.significant(short), len(corpus.significant(short) & corpus.significant(long))
            if (len(s) == 1 == both and len(min(s)) >= 4) or (len(s) >= 3 and len(short) >= 0.75 * len(long) and both >= 0.9 * len(s) - 1e-9):
                want = i
                break
        assert known.match(key) == want
        if len(learnt) % 3 or want is None:
            known.learn(key)
            learnt.append(key)
    looked = []
    both = corpus.KnownTitles.both
    monkeypatch.setattr(corpus.KnownTitles, "both", lambda self, *a: looked.append(1) or both(self, *a))
    many = [f"deep common network number{i} of" for i in range(500)]
    known = corpus.KnownTitles(corpus.word_counts(many))
    for key in many:
        assert known.match(key) is None
        known.learn(key)
    assert len(looked) < len(many)


def test_close_titles_compare_few_of_many(spark, monkeypatch):
    """a key's bound is known before the scan, so titles of fitting lengths are ruled out by their characters; results are those of all."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(80)]
    titles = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 7, 15, 60]))) for _ in range(150)]
    gold = [t[:3] + t[4:] for t in titles[::3]] + [t[:-2] + "é" + t[-2:] for t in titles[1::3]]
    p = spark.createDataFrame([(i, i, t) for i, t in enumerate(titles)], "paper_id long, pos long, key string")
    found = corpus.close_titles(spark.createDataFrame(list(enumerate(gold)), "title_id long, key string"), p, block=400).collect()
    got = {r.title_id: (titles[r.paper_id], r.ratio) for r in found}
    want = {i: get_close_matches(g, set(titles), 1, 0.85) for i, g in enumerate(gold)}
    assert {i: w[0] for i, w in want.items() if w} == {i: t for i, (t, _) in got.items()}
    met = []
    common = corpus.CloseTitle.common
    monkeypatch.setattr(corpus.CloseTitle, "common", lambda self, other: met.append(1) or common(self, other))
    targets = corpus.CloseTitles([corpus.CloseTitle(i, g, got[i][1] if i in got else 0.0) for i, g in enumerate(gold)], 0.85)
    for t in titles:
        targets.meet(t)
    assert {t.title_id: t.best[1] for t in targets.all if t.best} == {i: t for i, (t, _) in got.items()}
    assert len(met) < len(gold) * 5
