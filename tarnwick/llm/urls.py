"""URL filter: host and path rules, and gradient-boosted trees on lexical features. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The rules, as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Trees, their depth, the step of each, and the pull of leaves towards zero.
TREES, DEPTH, RATE, RIDGE = 8, 2, 0.4, 1.0
#: A url that no rule fits is blocked from this probability on; trees that know nothing of it say about one half.
BLOCK = 0.6
#: Bins of each feature; folds of the labelled urls; and how many urls the prior counts for in a suffix's rate.
BINS, FOLDS, PRIOR_URLS = 16, 5, 10

LEXICAL = ("length", "depth", "digits", "entropy", "parameters", "labels")
FEATURES = (*LEXICAL, "suffix_rate", "suffix_weight")


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end; else empty."""
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        suffix, slash, start = rule.partition("/")
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(slash + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def entropy(text: Column) -> Column:
    """Bits a character of the text's own distribution."""
    n = F.length(text)
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def binned(x: Column, step: float) -> Column:
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(x / step))).cast("int")


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with one column of small integers for each lexical feature."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    values = {
        "length": binned(F.length(url), 8.0),
        "depth": binned(F.size(F.filter(F.split("path", "/"), lambda x: x != "")), 1.0),
        "digits": binned(F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)), 0.02),
        "entropy": binned(entropy(url), 0.35),
        "parameters": binned(F.size(F.filter(F.split(query, "&"), lambda x: x != "")), 1.0),
        "labels": binned(F.size(F.split("host", r"\.")), 1.0),
    }
    return df.withColumns({f"f_{k}": v for k, v in values.items()})


def suffix_features(rate: Column, weight: Column) -> dict[str, Column]:
    """The features of a suffix with a rate of blocked urls among so many labelled ones; nulls for a suffix without any."""
    known = {"suffix_rate": binned(F.coalesce(rate, F.lit(0.5)), 1.0 / BINS), "suffix_weight": binned(F.log2(F.coalesce(weight, F.lit(0)) + F.lit(1)), 1.5)}
    return {f"f_{k}": v for k, v in known.items()}


def rate_of(n: Column, blocked: Column, even: float, odd: float) -> Column:
    """Share of blocked urls, both verdicts at equal weight, drawn to one half."""
    return (blocked * odd + PRIOR_URLS * 0.5) / (blocked * odd + (n - blocked) * even + PRIOR_URLS)


def features(df: DataFrame, statistics: DataFrame | None) -> DataFrame:
    """df (url, host, path) with one column of small integers for each feature; the statistics of suffixes are joined."""
    own = lexical(df)
    if statistics is None:
        return own.withColumns(suffix_features(F.lit(None).cast("double"), F.lit(None).cast("long")))
    joined = own.withColumn("suffix_", suffix_of(F.col("host"))).join(statistics.select(F.col("suffix").alias("suffix_"), "rate_", "weight_"), "suffix_", "left")
    return joined.withColumns(suffix_features(F.col("rate_"), F.col("weight_"))).drop("suffix_", "rate_", "weight_")


def tree_column(tree: dict) -> Column:
    """A tree as nested conditions."""
    if "leaf" in tree:
        return F.lit(float(tree["leaf"]))
    return F.when(F.col(f"f_{tree['feature']}") <= tree["bin"], tree_column(tree["low"])).otherwise(tree_column(tree["high"]))


def raw_score(model: dict) -> Column:
    total = F.lit(float(model["start"]))
    for tree in model["trees"]:
        total = total + tree_column(tree)
    return total


def best_split(rows: list, ridge: float) -> tuple | None:
    """(gain, feature, bin) from (feature, bin, g, h) sums of one node; the first of equal gains."""
    best = None
    for name in FEATURES:
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == name)
        g, h = sum(r[1] for r in own), sum(r[2] for r in own)
        a = b = 0.0
        for place, x, y in own[:-1]:
            a, b = a + x, b + y
            gain = a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, name, place)
    return best


def summed(labelled: DataFrame, even: float, odd: float) -> tuple[DataFrame, DataFrame]:
    """Weights of all and of blocked urls by their features, and the statistics (suffix, rate_, weight_) of all suffixes.

    A url learns from its suffix's statistics in the other folds, never from its own verdict; and each counts once more
    as if its suffix were unknown, so that the trees know what to make of suffixes without labelled urls.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold")
    names = [f"f_{x}" for x in LEXICAL]
    each = written(lexical(labelled).select(*names, suffix_of(F.col("host")).alias("suffix"), fold, "blocked").groupBy(*names, "suffix", "fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("b")), "labelled-urls")
    by_fold = each.groupBy("suffix", "fold").agg(F.sum("n").alias("own_n"), F.sum("b").alias("own_b"))
    totals = by_fold.groupBy("suffix").agg(F.sum("own_n").alias("all_n"), F.sum("own_b").alias("all_b"))
    n, b = F.col("all_n") - F.col("own_n"), F.col("all_b") - F.col("own_b")
    others = by_fold.join(totals, "suffix").where(n > 0).select("suffix", "fold", rate_of(n, b, even, odd).alias("rate_"), n.alias("weight_"))
    seen = each.join(others, ["suffix", "fold"], "left").withColumns(suffix_features(F.col("rate_"), F.col("weight_")))
    unseen = each.withColumns(suffix_features(F.lit(None).cast("double"), F.lit(None).cast("long")))
    columns = [*(f"f_{x}" for x in FEATURES), "n", "b"]
    both = seen.select(*columns).unionByName(unseen.select(*columns)).groupBy(*columns[:-2]).agg(((F.sum("n") - F.sum("b")) * even + F.sum("b") * odd).alias("n"), (F.sum("b") * odd).alias("b"))
    statistics = totals.select("suffix", rate_of(F.col("all_n"), F.col("all_b"), even, odd).alias("rate_"), F.col("all_n").alias("weight_"))
    return written(both, "urls"), written(statistics, "suffixes")


def train(labelled: DataFrame, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE) -> dict:
    """Trees from labelled urls (url, host, path, blocked), for logistic loss with both classes at equal weight.

    All labelled rows count. They are first summed by their features, which the number of bins bounds; each level of
    a tree is one aggregation of gradients by node, feature and bin, and only those sums reach the driver.
    """
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    if not n or blocked in (0, n):
        return {"start": 1.0 if n and blocked else -1.0, "trees": [], "statistics": None}
    rows, statistics = summed(labelled, n / (2.0 * (n - blocked)), n / (2.0 * blocked))
    model = {"start": 0.0, "trees": [], "statistics": statistics}
    for _ in range(trees):
        p = 1.0 / (1.0 + F.exp(-raw_score(model)))
        graded = rows.withColumn("g", F.col("b") - F.col("n") * p).withColumn("h", F.col("n") * p * (1 - p))
        tree: dict = {}
        open_nodes = [(tree, F.lit(True))]
        for level in range(depth + 1):
            node = F.lit(-1)
            for i, (_, here) in enumerate(open_nodes):
                node = F.when(here, F.lit(i)).otherwise(node)
            pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"f_{x}").alias("bin")) for x in FEATURES]))
            sums = graded.withColumn("node", node).where("node >= 0").select("node", "g", "h", pairs.alias("p")).groupBy("node", "p.feature", "p.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            after = []
            for i, (place, here) in enumerate(open_nodes):
                own = [(r["feature"], r["bin"], r["g"], r["h"]) for r in sums if r["node"] == i]
                split = best_split(own, ridge) if level < depth else None
                if split is None:
                    g, h = (sum(r[k] for r in own if r[0] == FEATURES[0]) for k in (2, 3))
                    place["leaf"] = rate * g / (h + ridge)
                else:
                    place |= {"feature": split[1], "bin": int(split[2]), "low": {}, "high": {}}
                    side = F.col(f"f_{split[1]}") <= int(split[2])
                    after += [(place["low"], here & side), (place["high"], here & ~side)]
            open_nodes = after
            if not open_nodes:
                break
        model["trees"].append(tree)
    return model


def judge(pages: DataFrame, *, rules=RULES, **training) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' block probability for every url.

    The verdict is that of the longest rule that fits the host, or a host above it, and the start of the path; where
    none fits (then rule is null), that of boosted trees over lexical features, trained on the urls that rules
    label. A null url, or one without ``://``, has an empty host and path. Repeated rows and null ids come out as
    they come; other columns are ignored; an empty table gives no rows; where rules label urls of one kind only, that
    kind is the verdict of all, and allow where they label none.
    """
    url = F.col("url")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.cast("string").alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    ruled = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    model = train(ruled.where("r IS NOT NULL").select("url", "host", "path", (F.col("r.verdict") == "block").cast("int").alias("blocked")), **training)
    scored = features(ruled, model["statistics"]).withColumn("block_probability", 1.0 / (1.0 + F.exp(-raw_score(model))))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("block_probability") >= BLOCK, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "block_probability")
