"""Removal of recurring lines, by a log-template tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, discard, fresh, written

#: A template recurs if documents with so many different leads hold it; a leaf of the tree is grown from as many.
SUPPORT = 20
#: Parts of a line: the tree is entered by token count and the tokens of one of them, the leading, middle or last ones.
PARTS = 3
LEAVES = tuple(f"leaf{i}" for i in range(PARTS))
#: A document follows the lead of an earlier one that has at least one in so many of the characters of its lines.
FOLLOWS = 3
#: Tokens of a leaf stay if SUPPORT lines have them at their place; or, for a second reading, so large a share of all.
STAYS = (4, 5)
#: Share of a line's tokens that its template must keep, as a fraction.
KEEPS = (3, 5)
#: Recurring templates (8 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_TEMPLATES = 500_000
#: Tokens that stay in a leaf and are joined to its lines as one array; leaves with more are joined token by token.
WIDE = 256

#: What stands for a variable field, what makes a token one (a digit, or an address), and white space.
WILDCARD = "<*>"
VARIABLE = r"[0-9@]|://"
SPACE = r"[ \t\r\f\x0B]+"
UNEVEN = r"[\t\r\f\x0B]|  "


def bare(line: Column) -> Column:
    """The line's tokens with single spaces between them."""
    return F.trim(F.when(line.rlike(UNEVEN), F.regexp_replace(line, SPACE, " ")).otherwise(line))


def masked(line: Column) -> Column:
    """The bare line with a wildcard for each token that has a digit or is an address, whatever its length."""
    fields = F.transform(F.split(line, " "), lambda x: F.when(x.rlike(VARIABLE), WILDCARD).otherwise(x))
    return F.when(line.rlike(VARIABLE), F.array_join(fields, " ")).otherwise(line)


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(key, doc, line_no, template, chars, leaf0 and on, line) for each line with tokens, of docs (key, doc, text).

    line is masked and template its hash; its leaves are the hashes of paths, each of the token count and
    the tokens of one part. Lines with fewer tokens than parts have none.
    """
    each = docs.select("key", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "x"))
    each = each.where(F.trim(F.col("x"), F.lit(" \t\r\f\x0b")) != "").select("key", "doc", "line_no", masked(bare(F.col("x"))).alias("line")).withColumn("t", F.split("line", " "))
    n = F.size("t")
    paths = []
    for i in range(PARTS):
        first, end = F.floor(n * i / PARTS).cast("int"), F.floor(n * (i + 1) / PARTS).cast("int")
        path = F.xxhash64(n, F.lit(i), F.slice("t", first + 1, end - first))
        paths.append(F.when(n >= PARTS, path).alias(f"leaf{i}"))
    return each.select("key", "doc", "line_no", F.xxhash64("line").alias("template"), F.length("line").alias("chars"), *paths, "line")


def leads(held: DataFrame) -> DataFrame:
    """(doc, lead) for the documents that follow another one, from the lines (template, doc, chars) that each holds.

    Near copies count once, under one lead. Each line points to the first document that holds it. A document's lead is the one before it that most of its
    characters point to, each line once, if these are at least one in FOLLOWS of all; the smaller of equal ones.
    """
    first = held.groupBy("template").agg(F.min("doc").alias("first"))
    votes = held.select("template", "doc", "chars").join(first, "template").groupBy("doc", "first").agg(F.sum("chars").alias("chars"))
    other = F.when(F.col("first") != F.col("doc"), F.struct("chars", F.bitwise_not("first").alias("mark"), "first"))
    best = votes.groupBy("doc").agg(F.sum("chars").alias("all"), F.max(other).alias("best"))
    return best.where(F.col("best.chars") * FOLLOWS >= F.col("all")).select("doc", F.col("best.first").alias("lead"))


def bounded(keys: DataFrame, most: int = BROADCAST_TEMPLATES) -> DataFrame:
    """The written rows, to be broadcast if they are at most so many."""
    return F.broadcast(keys) if keys.count() <= most else keys


def grown(credited: DataFrame, lines: DataFrame, support: int) -> DataFrame:
    """(template, pattern): the patterns that leaves make of the lines in them, by which lines of one template meet.

    credited has (template, lead, leaf0 and on). A leaf is grown if lines of at least ``support`` leads reach it. Its tokens
    stay where as many lines have them at their place, each counted for every lead that holds it, the others become
    wildcards; a second pattern keeps only the tokens that nearly all of these have. Patterns that keep too few tokens of a line are left out.

    The tokens of the leaf's own part stay always, so only the others are counted, by a hash of place and token: those
    of one line of the leaf, less the lines that differ from it there, and those that differ. What stays in a leaf joins
    its lines as one array; leaves where more stays than WIDE join by place and token.
    """
    reach = credited.select("template", "lead", F.posexplode(F.array(*LEAVES)).alias("part", "leaf")).where("leaf IS NOT NULL")
    reached = written(reach.groupBy("leaf").agg(F.count("*").alias("all")).where(F.col("all") >= support), "reached")
    near = reach.join(bounded(reached), "leaf")
    ripe = written(near.select("leaf", "all", "lead").distinct().groupBy("leaf", "all").agg(F.count("*").alias("leads")).where(F.col("leads") >= support).select("leaf", "all"), "ripe")
    inside = written(reach.join(bounded(ripe), "leaf").groupBy("leaf", "template", "part", "all").agg(F.count("*").alias("n")), "inside")
    wanted = written(inside.select("template").distinct(), "leaf-templates")
    texts = lines.select("template", "line").join(bounded(wanted), "template", "left_semi").dropDuplicates(["template"])
    own = written(inside.join(texts, "template"), "leaf-lines")
    tokens = F.split("line", " ")
    size = F.size(tokens)
    first, end = F.floor(size * F.col("part") / PARTS), F.floor(size * (F.col("part") + 1) / PARTS)

    def slot(x: Column, i: Column) -> Column:
        return F.xxhash64(i, x)

    def outside(take) -> Column:
        """Of each token outside the leaf's part, what take gives for it and its place, nulls left out."""
        each = F.transform(tokens, lambda x, i: F.when((i < first) | (i >= end), take(x, i)))
        return F.explode(F.filter(each, lambda v: v.isNotNull()))

    # one line of a leaf stands for what its lines share: the others add only the tokens in which they differ from it
    chosen = own.groupBy("leaf").agg(F.min("template").alias("template"))
    base = written(own.join(chosen, ["leaf", "template"]).select("leaf", "part", "all", "line"), "leaf-bases")

    def place(x: Column, i: Column) -> Column:
        return F.struct(i.alias("at"), slot(x, i).alias("slot"))

    def differs(x: Column, i: Column) -> Column:
        return F.when(~x.eqNullSafe(F.get("base", i)), place(x, i))

    unlike = own.join(base.select("leaf", F.split("line", " ").alias("base")), "leaf").select("leaf", "all", "n", outside(differs).alias("d"))
    unlike = written(unlike.groupBy("leaf", "d.at", "d.slot").agg(F.sum("n").alias("own"), F.max("all").alias("all")), "unlike")
    missing = unlike.groupBy("leaf", "at").agg(F.sum("own").alias("missing"))
    shared = base.select("leaf", "all", outside(place).alias("d")).select("leaf", "all", "d.at", "d.slot").join(missing, ["leaf", "at"], "left")
    shared = shared.select("leaf", "slot", (F.col("all") - F.coalesce("missing", F.lit(0))).alias("own"), "all")
    counts = shared.unionByName(unlike.drop("at"))
    often, nearly = F.col("own") >= support, F.col("own") * STAYS[1] >= F.col("all") * STAYS[0]
    stays = written(counts.where(often | nearly).select("leaf", "slot", often.alias("often"), nearly.alias("nearly")), "stays")
    sizes = written(stays.groupBy("leaf").agg(F.count("*").alias("wide")), "stay-counts")
    few, many = sizes.where(F.col("wide") <= WIDE), sizes.where(F.col("wide") > WIDE)

    def arrays(by: list[str], rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.collect_list(F.when(F.col(how), F.col("slot"))).alias(how) for how in ("often", "nearly")])

    narrow = own.join(arrays(["leaf"], stays.join(few.select("leaf"), "leaf", "left_semi")), "leaf")
    each = own.join(many.select("leaf"), "leaf", "left_semi").select("leaf", "template", outside(slot).alias("slot")).join(stays, ["leaf", "slot"])
    wide = own.join(arrays(["leaf", "template"], each), ["leaf", "template"])
    # the places that stay are counted first, and written: few lines keep enough of their tokens to have a pattern
    ways = ("often", "nearly")
    places = F.transform(tokens, lambda x, i: slot(x, i))
    kept = narrow.unionByName(wide).select("template", "line", "part", *[F.array_intersect(places, how).alias(how) for how in ways])

    def enough(how: str) -> Column:
        return (F.size(how) + (end - first)) * KEEPS[1] >= size * KEEPS[0]

    kept = written(kept.where(enough("often") | enough("nearly")), "kept")

    def read(how: str) -> DataFrame:
        stay = F.transform(tokens, lambda x, i: F.when(((i >= first) & (i < end)) | F.array_contains(how, slot(x, i)), x).otherwise(WILDCARD))
        return kept.where(enough(how)).select("template", F.xxhash64(stay).alias("pattern"))

    found = written(read("often").unionByName(read("nearly")).distinct(), "patterns")
    discard(reached, ripe, inside, wanted, own, base, unlike, stays, sizes, kept)
    return found


def recurring(lines: DataFrame, support: int) -> DataFrame:
    """Hashes of the masked lines whose template recurs: that of the line itself, or a pattern of its leaves."""
    greatest = [F.max(x).alias(x) for x in LEAVES]
    held = written(lines.groupBy("template", "doc").agg(F.max("chars").alias("chars"), *greatest), "held")
    following = written(leads(held), "leads")
    credited = written(held.join(following, "doc", "left").groupBy("template", F.coalesce("lead", "doc").alias("lead")).agg(*greatest), "credited")
    alone = credited.groupBy("template").count().where(F.col("count") >= support).select("template")
    patterns = grown(credited, lines, support)
    often = patterns.join(credited.select("template", "lead"), "template").select("pattern", "lead").distinct().groupBy("pattern").count().where(F.col("count") >= support)
    found = written(alone.unionByName(patterns.join(often, "pattern", "left_semi").select("template")).distinct(), "templates")
    discard(held, following, credited, patterns)
    return found


def text_key() -> Column:
    """Tells documents apart."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def drop_recurring_lines(docs: DataFrame, *, support: int = SUPPORT, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs without the lines whose template recurs across documents, with ``n_lines`` and ``n_dropped``.

    Tokens with a digit, a mail or web address are wildcards. Lines then go down a tree of fixed depth, by their token
    count and leading tokens (or those of their middle or last third, as fields may vary at the start), to leaves in
    which tokens that vary become wildcards too. A template recurs if at least ``support`` documents hold lines of it,
    where near copies count as one: all that follow the same lead (see leads). Rows with one doc_id are one document
    here, and so are those with a null one.

    Lines end at a line feed. Lines without tokens always stay. A null text stays null, with no lines; an empty one
    is one line. All columns and rows stay, repeated rows and null ids included; columns that have the names of the
    two counts are replaced; an empty table gives no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (n_lines.lower(), n_dropped.lower())])
    key, drop = fresh(docs, "key"), fresh(docs, "drop")
    own = text_key()
    source = docs.select(own.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    lines = written(numbered_lines(source), "lines")
    bad = recurring(lines, support)
    hits = lines.select("key", "line_no", "template").join(bounded(bad), "template")
    drops = written(hits.groupBy(F.col("key").alias(key)).agg(F.collect_set("line_no").alias(drop)), "drops")
    discard(lines)
    # the drops grow with the documents, so no size of theirs is broadcast
    joined = docs.withColumn(key, own).join(drops.hint("merge"), key, "left")
    parts = F.split(F.col("text").cast("string"), "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(drop, i)), "\n")
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(left)
    columns = [text.alias(c) if c.lower() == "text" else own for c, own in zip(docs.columns, columns_of(docs), strict=True)]
    return joined.select(*columns, F.coalesce(F.size(parts), F.lit(0)).alias(n_lines), F.coalesce(F.size(drop), F.lit(0)).alias(n_dropped))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their recurring lines taken out, with the columns they came with.

    Null and empty texts, null ids, repeated rows and empty tables are as drop_recurring_lines has them.
    """
    return drop_recurring_lines(docs, n_lines=fresh(docs, "n_lines"), n_dropped=fresh(docs, "n_dropped")).select(*columns_of(docs))
