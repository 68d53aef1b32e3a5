"""Queries for corpus building, parsing, prompts, checks and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import corpus, evaluation, extraction

from . import greedy
from . import views as V

GRAPH_WORDS, TOPIC_WORDS = ("graph", "the", "que", "ung", "ción"), ("recommend", "tion", "der ", "la ")


def topic_gate(spark, sf_dir):
    p = corpus.with_abstract(V.papers(spark, sf_dir))
    whole = F.concat_ws(" ", "title", "abstract")
    return p.where(corpus.topical(whole, GRAPH_WORDS, TOPIC_WORDS)).select("paper_id", corpus.first_area(whole, V.AREAS).alias("area"))


def title_normalize(spark, sf_dir):
    return V.papers(spark, sf_dir).select("paper_id", T.title_key(F.col("title")).alias("key"))


def title_normalize_html(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(T.marked_up_title_key(F.col("html"))).alias("key_md5"))


def title_dup_pairs(spark, sf_dir):
    return corpus.duplicate_titles(V.papers(spark, sf_dir))


def dedupe_exact(spark, sf_dir):
    return corpus.dedupe_exact(V.papers(spark, sf_dir)).select("paper_id", "slot", "n")


def first_seen_area(spark, sf_dir):
    p = V.papers(spark, sf_dir).select(T.title_key(F.col("title")).alias("key"), F.col("origin").alias("area"), "pos")
    return corpus.first_seen(p)


def merge_seeds(spark, sf_dir):
    """Papers of one language are the corpus, those of the others the seeds."""
    p = V.papers(spark, sf_dir)
    return corpus.merge_seeds(p.where("lang = 'en'"), p.where("lang <> 'en'")).select("paper_id")


def merge_ids(spark, sf_dir):
    """Wanted are the labelled ids, and their negatives, which no work has."""
    p = V.papers(spark, sf_dir)
    ids = V.table(spark, sf_dir, "labels").select(F.explode(F.array("doc_id", -F.col("doc_id") - 1)).alias("paper_id"))
    return corpus.merge_ids(p.where("lang = 'en'"), ids, p)


def balanced_select(spark, sf_dir):
    p = V.papers(spark, sf_dir)
    whole = F.concat_ws(" ", "title", "abstract")
    return corpus.balanced_select(p.select("paper_id", "pos", corpus.first_area(whole, V.AREAS).alias("area")), list(V.AREAS), 400)


def seed_match(spark, sf_dir):
    """The first paper whose title key holds a test item's, or is it."""
    items = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), T.title_key(F.col("text")).alias("text"))
    p = V.papers(spark, sf_dir).select("paper_id", T.title_key(F.concat_ws(" ", "title", "abstract")).alias("text"))
    return corpus.holding(items, p).groupBy(F.col("pattern_id").alias("item_id")).agg(F.min("paper_id").alias("paper_id"), F.count("*").alias("n"))


def _gold_titles(spark, sf_dir):
    """Titles in tags for every paper whose id is divisible by 50, and the test items."""
    p = V.papers(spark, sf_dir).where("paper_id % 50 = 0").select(F.col("paper_id").alias("title_id"), F.concat(F.lit("<i>"), "title", F.lit("</i>")).alias("title"))
    b = V.table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("title_id"), F.col("text").alias("title"))
    return p.unionByName(b)


def gold_resolution(spark, sf_dir):
    return corpus.resolve_titles(_gold_titles(spark, sf_dir), V.papers(spark, sf_dir))


def gold_resolution_rate(spark, sf_dir):
    r = corpus.resolve_titles(_gold_titles(spark, sf_dir), V.papers(spark, sf_dir))
    return r.agg(F.count("*").alias("n"), F.count("paper_id").alias("n_resolved"), F.count_distinct("paper_id").alias("n_papers"), (F.count("paper_id") >= evaluation.RESOLVED * F.count("*")).alias("passes"))


def gold_resolution_fuzzy(spark, sf_dir):
    """Titles that lack their fourth character, for every paper whose id is divisible by 50."""
    p = V.papers(spark, sf_dir)
    gold = p.where("paper_id % 50 = 0").select(F.col("paper_id").alias("title_id"), F.concat(F.substring("title", 1, 3), F.expr("substring(title, 5)")).alias("title"))
    return corpus.resolve_close(gold, p)


def top_cited(spark, sf_dir):
    from tarnwick.operators import graph

    d = graph.degrees(V.nodes(spark, sf_dir), V.edges(spark, sf_dir))
    return d.orderBy(F.desc("in_degree"), "node").limit(20).select("node", "in_degree")


def select_by_ids(spark, sf_dir):
    """Labelled ids in their order with what is known of them; missing ones are reported."""
    ids = V.table(spark, sf_dir, "labels").select(F.explode(F.array("doc_id", F.col("doc_id") + 10**9)).alias("paper_id"))
    return ids.join(V.papers(spark, sf_dir).select("paper_id", "lang"), "paper_id", "left").select("paper_id", "lang", F.col("lang").isNull().alias("is_missing"))


def extract_missing(spark, sf_dir):
    return extraction.missing(V.papers(spark, sf_dir).select("paper_id", "lang"), V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id")))


def card_sample(spark, sf_dir):
    return extraction.sampled(V.papers(spark, sf_dir).select("paper_id", "origin", "lang"), 20, seed=7)


def survey_filter(spark, sf_dir):
    """Pages whose markup does not name a survey or review."""
    return V.table(spark, sf_dir, "pages").where(~T.is_survey(F.col("html"))).select("page_id")


def corpus_stats(spark, sf_dir):
    return V.papers(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("n"), F.count_if(F.col("abstract") != "").alias("with_abstract"), F.sum(F.length("title")).alias("title_chars"))


def field_fill_rates(spark, sf_dir):
    return evaluation.fill_rates(V.papers(spark, sf_dir), ["title", "abstract", "origin"])


def abstract_rebuild(spark, sf_dir):
    """Every text's words from an inverted index of it."""
    w = V.texts(spark, sf_dir).select("paper_id", F.posexplode(T.tokens(F.col("text"))).alias("p", "w")).groupBy("paper_id", "w").agg(F.collect_list("p").alias("ps"))
    index = w.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("i"))
    return index.select("paper_id", F.md5(T.from_inverted_index(F.col("i"))).alias("text_md5"))


def id_normalize(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    made = F.concat(F.lit(" https://doi.org/10.1/"), F.upper("url"), F.lit(" "))
    return p.select("page_id", T.short_id(F.col("url")).alias("short"), T.doi(made).alias("doi"), T.lookup_id(F.when(F.col("page_id") % 2 == 0, made), F.col("page_id").cast("string")).alias("lookup"))


def context_records(spark, sf_dir):
    """Events' properties as context records: the first text or an empty one."""
    e = V.table(spark, sf_dir, "events")
    held = F.filter(F.array(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.ref")), lambda x: x.isNotNull() & (x != ""))
    return e.select("event_id", F.coalesce(F.get(held, F.lit(0)), F.lit("")).alias("context"), F.size(held).alias("n"))


def llm_json_parse(spark, sf_dir):
    """Turns wrapped as a model might: bare, fenced, amid prose, or no JSON."""
    c = V.table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    body = F.to_json(F.struct(F.col("role").alias("paragraph")))
    kind = F.col("turn") % 4
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), body, F.lit(" Done."))).otherwise("no json")
    return extraction.parse_replies(c.select("id", raw.alias("raw")))


def prompt_messages(spark, sf_dir):
    p = V.papers(spark, sf_dir)
    prompt = extraction.messages("Extract.", [("Q", "A")], F.col("title"), F.col("abstract"))
    return p.select("paper_id", prompt.alias("m")).select("paper_id", F.size("m").alias("n"), extraction.estimated_tokens(F.col("m")).alias("tokens"), F.md5(F.element_at("m", -1)["content"]).alias("last_md5"))


def citation_check(spark, sf_dir):
    """Paragraphs with markers made from the turn's number, against references and what was shown."""
    c = V.table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    cited = c.select("id", F.concat(F.lit("See [1], ["), (F.col("turn") + 1).cast("string"), F.lit("] and [1].")).alias("paragraph"))
    refs = c.select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).withColumn("paper_id", F.concat("id", F.lit("/"), F.col("n").cast("string")))
    shown = refs.where("n < 3").withColumn("paper_id", F.when(F.col("n") == 2, "other").otherwise(F.col("paper_id")))
    return extraction.check_citations(cited, refs, shown)


def entity_dedupe(spark, sf_dir):
    """Words of the test items as a recogniser's pieces."""
    b = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("paper_id"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))
    label = F.element_at(F.array(*map(F.lit, ("B-Method", "I-Dataset", "metric", "other"))), (F.length("word") % 4 + 1).cast("int"))
    found = extraction.dedupe_entities(b.select("paper_id", "pos", F.concat("word", F.lit(" ##s")).alias("word"), label.alias("label"), F.lit(1.0).alias("score")))
    return found.select("paper_id", "pos", "text", "kind")


def weak_ner_spans(spark, sf_dir):
    """The longest word of each text, found again in it."""
    d = V.texts(spark, sf_dir)
    words = F.transform(T.tokens(F.col("text")), lambda x: F.struct(F.length(x).alias("n"), x.alias("w")))
    terms = d.select("paper_id", F.array_max(words)["w"].alias("term")).where("term IS NOT NULL")
    return extraction.spans(d, terms)


def classifier_metrics(spark, sf_dir):
    """A rule on length against three classes: neither label, one of them, both."""
    both = V.table(spark, sf_dir, "labels").join(V.texts(spark, sf_dir), F.col("doc_id") == F.col("paper_id"))
    m = evaluation.classification(both.select((F.col("quality") + F.col("toxic")).cast("int").alias("label"), (F.length("text") > 400).cast("int").alias("predicted")), [0, 1, 2])
    return m.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"), "n")


def history_latest(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    h = e.select(F.col("event_type").alias("method"), (F.col("user_id") % 10).alias("notes"), F.col("event_id").alias("pos"), F.round("value", 4).alias("value"))
    return evaluation.latest(h)


def dedupe_greedy(spark, sf_dir):
    """What the order-dependent pass keeps; no SQL expresses it."""
    return greedy.greedy(V.papers(spark, sf_dir))


P = f"WITH {V.PAPERS}"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


AREA = "CASE " + " ".join(f"WHEN {_any(words)} THEN '{a}'" for a, words in V.AREAS.items()) + " ELSE 'other' END"
LOW = "lower(concat_ws(' ', title, abstract)) AS t"
KEY, WORDS = V.title_key_sql("title"), f"list_distinct(list_filter(string_split(key, ' '), lambda x: x <> '' AND NOT list_contains({V.GENERIC_SQL}, x)))"

RESOLUTION = f"""{P},
keyed AS (
  SELECT paper_id, pos, {V.marked_up_key_sql("title")} AS key, contains(title, ':') AS colon,
         {V.marked_up_key_sql("split_part(title, ':', 1)")} AS head FROM papers),
wanted AS (
  SELECT title_id, {V.marked_up_key_sql("title")} AS key FROM (
    SELECT paper_id AS title_id, '<i>' || title || '</i>' AS title FROM papers WHERE paper_id % 50 = 0
    UNION ALL SELECT -item_id - 1, text FROM benchmark)),
exact AS (SELECT key, min_by(paper_id, pos) AS exact FROM keyed WHERE key <> '' GROUP BY 1),
heads AS (SELECT head AS key, min_by(paper_id, pos) AS head FROM keyed WHERE colon AND head <> '' GROUP BY 1),
parts AS (SELECT title_id, min_by(paper_id, pos) AS part FROM wanted w JOIN keyed k ON contains(k.key, w.key) WHERE length(w.key) >= 4 GROUP BY 1),
resolved AS (
  SELECT title_id, coalesce(exact, head, part) AS paper_id,
         CASE WHEN exact IS NOT NULL THEN 'exact' WHEN head IS NOT NULL THEN 'colon' WHEN part IS NOT NULL THEN 'substring' END AS strategy
  FROM wanted LEFT JOIN exact USING (key) LEFT JOIN heads USING (key) LEFT JOIN parts USING (title_id))"""

ORACLE = {
    "topic_gate": f"{P}, x AS (SELECT paper_id, {LOW} FROM papers WHERE abstract <> '') SELECT paper_id, {AREA} AS area FROM x WHERE {_any(GRAPH_WORDS)} AND {_any(TOPIC_WORDS)}",
    "title_normalize": f"{P} SELECT paper_id, {KEY} AS key FROM papers",
    "title_normalize_html": f"SELECT page_id, md5({V.marked_up_key_sql('html')}) AS key_md5 FROM pages",
    "title_dup_pairs": f"""{P}, k AS (SELECT paper_id, {KEY} AS key FROM papers),
c AS (SELECT min(paper_id) AS rep, key, {WORDS} AS words, length(key) AS chars FROM k WHERE key <> '' GROUP BY key),
o AS (SELECT *, CASE WHEN len(words) = 1 THEN min(rep) OVER (PARTITION BY words) END AS lead FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b, a.lead, CASE WHEN a.chars < b.chars THEN a.words ELSE b.words END AS s, CASE WHEN a.chars < b.chars THEN b.words ELSE a.words END AS l,
         least(a.chars, b.chars) AS cs, greatest(a.chars, b.chars) AS cl
  FROM o a JOIN o b ON a.rep < b.rep AND list_has_any(a.words, b.words))
SELECT a, b FROM p
WHERE (len(s) = 1 AND length(s[1]) >= 4 AND list_contains(l, s[1]) AND (len(l) > 1 OR a = lead))
   OR (len(s) >= 3 AND cs >= 0.75 * cl AND len(list_intersect(s, l)) >= 0.9 * len(s) - 1e-9)""",
    "dedupe_exact": f"{P}, k AS (SELECT *, {KEY} AS key FROM papers) SELECT first(paper_id ORDER BY (abstract <> '') DESC, length(abstract) DESC, pos) AS paper_id, min(pos) AS slot, count(*) AS n FROM k GROUP BY key, CASE WHEN key = '' THEN paper_id END",
    "first_seen_area": f"{P}, k AS (SELECT *, {KEY} AS key FROM papers) SELECT key, min_by(origin, pos) AS area FROM k GROUP BY key",
    "merge_seeds": f"""WITH RECURSIVE {P[5:]}, k AS (SELECT *, {KEY} AS key FROM papers),
t AS (SELECT paper_id, pos, lang = 'en' AS there, key, {WORDS} AS words, length(key) AS chars FROM k),
h AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM t WHERE NOT there),
u AS (SELECT paper_id, 0 AS i, key, words, chars FROM t WHERE there UNION ALL SELECT paper_id, i, key, words, chars FROM h),
m AS (
  SELECT x.i, y.i AS j FROM (
    SELECT a.i, a.key AS ka, b.i AS bi, b.key AS kb, CASE WHEN a.chars <= b.chars THEN a.words ELSE b.words END AS s,
           CASE WHEN a.chars <= b.chars THEN b.words ELSE a.words END AS l, least(a.chars, b.chars) AS cs, greatest(a.chars, b.chars) AS cl
    FROM h a JOIN u b ON b.i < a.i AND (a.key = b.key OR list_has_any(a.words, b.words)) WHERE a.key <> '') x, LATERAL (SELECT x.bi AS i) y
  WHERE ka = kb OR (len(s) = 1 AND length(s[1]) >= 4 AND list_contains(l, s[1]))
     OR (len(s) >= 3 AND cs >= 0.75 * cl AND len(list_intersect(s, l)) >= 0.9 * len(s) - 1e-9)),
free AS (SELECT i FROM h WHERE i NOT IN (SELECT i FROM m WHERE j = 0)),
e AS (SELECT i, list(j) AS js, row_number() OVER (ORDER BY i) AS n FROM m WHERE i IN (SELECT i FROM free) GROUP BY i),
r AS (
  SELECT 0 AS n, (SELECT coalesce(list(i), []) FROM free WHERE i NOT IN (SELECT i FROM e)) AS taken
  UNION ALL
  SELECT e.n, CASE WHEN list_has_any(e.js, r.taken) THEN r.taken ELSE list_append(r.taken, e.i) END FROM r JOIN e ON e.n = r.n + 1)
SELECT paper_id FROM h WHERE i IN (SELECT unnest(taken) FROM r WHERE n = (SELECT max(n) FROM r))""",
    "merge_ids": """WITH w AS (SELECT DISTINCT unnest([doc_id, -doc_id - 1]) AS paper_id FROM labels)
SELECT paper_id, CASE WHEN lang = 'en' THEN 'present' WHEN doc_id IS NOT NULL THEN 'added' ELSE 'failed' END AS outcome FROM w LEFT JOIN documents ON doc_id = paper_id""",
    "balanced_select": f"""{P}, x AS (SELECT paper_id, pos, {LOW} FROM papers), a AS (SELECT paper_id, pos, {AREA} AS area FROM x),
t AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY pos) AS turn FROM a WHERE area <> 'other')
SELECT paper_id, area, CAST(turn AS INTEGER) AS turn FROM t ORDER BY turn, list_position({list(V.AREAS)}, area) LIMIT 400""",
    "seed_match": f"""{P}, b AS (SELECT item_id, {V.title_key_sql("text")} AS k FROM benchmark), p AS (SELECT paper_id, {V.title_key_sql("concat_ws(' ', title, abstract)")} AS k FROM papers)
SELECT item_id, min(paper_id) AS paper_id, count(*) AS n FROM b JOIN p ON contains(p.k, b.k) WHERE b.k <> '' GROUP BY 1""",
    "gold_resolution": f"{RESOLUTION} SELECT title_id, paper_id, strategy FROM resolved",
    "gold_resolution_rate": f"{RESOLUTION} SELECT count(*) AS n, count(paper_id) AS n_resolved, count(DISTINCT paper_id) AS n_papers, count(paper_id) >= 0.6 * count(*) AS passes FROM resolved",
    "top_cited": f"WITH {V.EDGES} SELECT vec_id AS node, (SELECT count(*) FROM edges WHERE dst = vec_id) AS in_degree FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20",
    "select_by_ids": "WITH w AS (SELECT unnest([doc_id, doc_id + 1000000000]) AS paper_id FROM labels) SELECT paper_id, lang, lang IS NULL AS is_missing FROM w LEFT JOIN documents ON doc_id = paper_id",
    "extract_missing": "SELECT doc_id AS paper_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "card_sample": f"{P} SELECT paper_id, origin, lang FROM papers ORDER BY md5(paper_id || ':7'), paper_id LIMIT 20",
    "survey_filter": "SELECT page_id FROM pages WHERE NOT (contains(lower(html), 'survey') OR contains(lower(html), 'review') OR contains(lower(html), 'systematic literature'))",
    "corpus_stats": f"{P} SELECT origin, count(*) AS n, count(*) FILTER (abstract <> '') AS with_abstract, CAST(sum(length(title)) AS BIGINT) AS title_chars FROM papers GROUP BY 1",
    "field_fill_rates": f"{P} " + " UNION ALL ".join(f"SELECT '{c}' AS field, round_even(100 * avg(CASE WHEN trim({c}, ' ') <> '' THEN 1.0 ELSE 0.0 END), 1) AS rate FROM papers" for c in ("title", "abstract", "origin")),
    "abstract_rebuild": f"SELECT doc_id AS paper_id, md5(array_to_string({V.tokens_sql('text')}, ' ')) AS text_md5 FROM documents WHERE len({V.tokens_sql('text')}) > 0",
    "id_normalize": "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS short, '10.1/' || lower(url) AS doi, CASE WHEN page_id % 2 = 0 THEN 'DOI:10.1/' || lower(url) ELSE 'MAG:' || page_id END AS lookup FROM pages",
    "context_records": "WITH h AS (SELECT event_id, list_filter([json_extract_string(props, '$.page'), json_extract_string(props, '$.ref')], lambda x: x IS NOT NULL AND x <> '') AS held FROM events) SELECT event_id, coalesce(held[1], '') AS context, CAST(len(held) AS INTEGER) AS n FROM h",
    "llm_json_parse": "SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 4 = 3 THEN 'no json' ELSE role END AS paragraph, turn % 4 = 3 AS failed FROM conversations",
    "prompt_messages": f"""{P}, m AS (SELECT paper_id, 'Title: ' || title || chr(10) || chr(10) || 'Abstract: ' || abstract AS last FROM papers)
SELECT paper_id, 4 AS n, CAST(floor((8 + 1 + 1 + length(last)) / 4) AS BIGINT) AS tokens, md5(last) AS last_md5 FROM m""",
    "citation_check": """WITH c AS (SELECT conv_id || '-' || turn AS id, CAST(turn + 1 AS INTEGER) AS k FROM conversations)
SELECT id, 'marker without reference' AS issue, k AS n FROM c WHERE k > 3
UNION ALL SELECT id, 'reference never cited', n FROM c, (SELECT unnest([2, 3]) AS n) WHERE n <> k
UNION ALL SELECT id, 'number not shown', 3 FROM c
UNION ALL SELECT id, 'number not shown', k FROM c WHERE k > 3
UNION ALL SELECT id, 'paper differs', 2 FROM c""",
    "entity_dedupe": f"""WITH b AS (SELECT item_id AS paper_id, unnest({V.tokens_sql("text")}) AS w, generate_subscripts({V.tokens_sql("text")}, 1) - 1 AS pos FROM benchmark),
e AS (SELECT paper_id, CAST(pos AS INTEGER) AS pos, trim(replace(w || ' ##s', ' ##', ''), ' ') AS text, ['method', 'dataset', 'metric', NULL][length(w) % 4 + 1] AS kind FROM b)
SELECT paper_id, pos, text, kind FROM e WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id, lower(text), kind ORDER BY pos) = 1""",
    "weak_ner_spans": f"""WITH t AS (SELECT doc_id AS paper_id, text, list_max(list_transform({V.tokens_sql("text")}, lambda x: {{'n': length(x), 'w': x}})).w AS term FROM documents)
SELECT paper_id, term, CAST(position(term IN lower(text)) - 1 AS INTEGER) AS start, CAST(position(term IN lower(text)) - 1 + length(term) AS INTEGER) AS "end" FROM t WHERE term IS NOT NULL AND position(term IN lower(text)) > 0""",
    "classifier_metrics": """WITH p AS (SELECT quality + toxic AS label, (length(text) > 400)::INT AS predicted FROM labels JOIN documents USING (doc_id)),
c AS (SELECT unnest([0, 1, 2]) AS c), f AS (SELECT c, (SELECT count(*) FROM p WHERE label = c AND predicted = c) AS tp, (SELECT count(*) FROM p WHERE label = c) AS nl, (SELECT count(*) FROM p WHERE predicted = c) AS np FROM c)
SELECT round(avg(CASE WHEN nl + np > 0 THEN 2.0 * tp / (nl + np) ELSE 0 END), 6) AS macro_f1, round(sum(tp) / sum(nl), 6) AS accuracy, CAST(sum(nl) AS BIGINT) AS n FROM f""",
    "history_latest": "SELECT event_type AS method, user_id % 10 AS notes, event_id AS pos, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY event_id DESC) = 1",
}

QUERIES = (
    topic_gate, title_normalize, title_normalize_html, title_dup_pairs, dedupe_exact, first_seen_area, merge_seeds, merge_ids,
    balanced_select, seed_match, gold_resolution, gold_resolution_rate, gold_resolution_fuzzy,
    top_cited, select_by_ids, extract_missing, card_sample, survey_filter,
    corpus_stats, field_fill_rates, abstract_rebuild, id_normalize, context_records, llm_json_parse, prompt_messages,
    citation_check, entity_dedupe, weak_ner_spans, classifier_metrics, history_latest, dedupe_greedy,
)
