"""Operator 3: URL filters. Host and path rules first; the rest by gradient-boosted trees on lexical features.

The trees learn from the urls that the rules label, at most `sample` of them (the first in the order of a hash, so
the same rows at any partitioning; a fifth of all urls, by another hash, is never learnt from). Statistics of suffixes
(the last label of a host) and likewise of sections (the first directory of a path) are the share of all urls that have it,
how many labelled urls have it, and the share of allowed ones among these. The latter two are taken from one half of the
sample and the trees are fitted to the other half, so no url is described by its own label. The trees are turned into one SQL expression, so that scoring runs in generated code next to
the scan. If the rules label no url, or only one way, the method's verdict is that way (or allow).

Null urls, or urls without '://', have an empty host and path and get the method's verdict like any other; urls of any
length are judged whole; an empty table gives an empty result; repeated rows are judged alike. Only `keep` and url are read,
so other columns, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, fresh

SAMPLE = 20_000
TREES, DEPTH, BINS = 20, 3, 32
LEAST_SHARE = 0.001
"""Suffixes and sections of at least this share of all urls have one in the table: at most a thousand of either."""
PARTS = ("suffix", "section")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))



def parsed(pages: DataFrame, url: str) -> DataFrame:
    """pages with u (url, null as ''), host and path in struct columns; host in lower case for A-Z."""
    u, rest, host, path = fresh(pages, "u_", "rest_", "host_", "path_")
    out = pages.withColumn(u, F.coalesce(F.col(url).cast("string"), F.lit("")))
    out = out.withColumn(rest, F.when(F.locate("://", F.col(u)) > 0, F.expr(f"substring(`{u}`, locate('://', `{u}`) + 3)")).otherwise(F.lit("")))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    out = out.withColumn(host, F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return out.withColumn(path, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def matching(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (ties: the first named), or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def features(u: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a url, all doubles."""
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    counted = F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda acc, c: acc - (lambda p: p * F.log2(p))(F.greatest((F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n, F.lit(1e-9))),
    )
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda c, chars_: F.length(c) - F.length(F.translate(c, chars_, ""))
    out = {
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "depth": count(path, "/"), "labels": count(host, ".") + 1, "digits": count(u, "0123456789") / n,
        "hyphens": count(u, "-_"), "entropy": counted,
        "parameters": F.when(query == "", F.lit(0)).otherwise(count(query, "&") + 1), "escapes": count(u, "%"),
        "suffix_length": F.length(suffix_of(host)), "fragment": F.locate("#", u) > 0, "secure": u.startswith("https"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$"),
    }
    return {k: v.cast("double") for k, v in out.items()}


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def learnable(url: Column) -> Column:
    """Whether a url may be learnt from; the others, a fifth, only measure."""
    return F.pmod(F.crc32(F.concat(url, F.lit("/learn"))), F.lit(5)) != 0


def section_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^/([^/]*)/", 1)


def statistics(part: str) -> dict[str, float]:
    """Columns of a part's statistics, and their values where the table has none."""
    return {f"{part}_share": 0.0, f"{part}_labelled": 0.0, f"{part}_allowed": 0.5}


def part_table(urls: DataFrame, known: DataFrame, part: str) -> DataFrame:
    """The column `part` with its statistics. urls: all rows; known: `part` and y (1 allowed, 0 blocked) of a bounded
    sample. At most 1 / LEAST_SHARE rows and one for each row of the sample."""
    n = cut(urls.groupBy(part).agg(F.count("*").alias("n")))
    total = n.agg(F.sum("n")).first()[0] or 1
    frequent = n.where(F.col("n") >= LEAST_SHARE * total).select(part, (F.col("n") / total).alias("share"))
    told = known.groupBy(part).agg(F.count("*").cast("double").alias("told"), F.sum("y").alias("ones"))
    both = frequent.join(told, part, "full")
    zero = F.lit(0.0)
    values = (F.coalesce("share", zero), F.coalesce("told", zero), (F.coalesce("ones", zero) + 0.5) / (F.coalesce("told", zero) + 1))
    return both.select(part, *[v.alias(k) for k, v in zip(statistics(part), values, strict=True)])


def fit(rows: DataFrame, names: list[str], label: str) -> Column | float:
    """Margin over the columns `names` (a SQL expression), or +-inf or 0 where there is nothing to learn.

    rows: `names` and a 0/1 double `label`, bounded by the caller."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    n, ones = rows.agg(F.count("*"), F.sum(label)).first()
    if not n:
        return 0.0
    if ones in (0, n):
        return float("inf") if ones else float("-inf")
    data = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("x", F.col(label).alias("label"))
    model = GBTClassifier(featuresCol="x", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=7, stepSize=0.2).fit(data)
    return sum((w * _tree(t._call_java("rootNode"), names) for t, w in zip(model.trees, model.treeWeights, strict=True)), F.lit(0.0))


def _tree(node, names: list[str]) -> Column:
    """A fitted tree as nested CASE expressions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild(), names)).otherwise(_tree(node.rightChild(), names))


def judge(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """`keep` columns, host, path, rule, verdict and margin (the trees' vote; positive: allow)."""
    kept = [f"keep_{i}" for i in range(len(keep))]
    rows = parsed(pages.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{url}`").alias("url")), "url")
    u, host, path = (F.col(c) for c in [rows.columns[-4], *rows.columns[-2:]])
    rule, verdict = matching(host, path, rules)
    fs = features(u, host, path)
    base = rows.select(*kept, host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled"), u.alias("u"), suffix_of(host).alias("suffix"), section_of(path).alias("section"), *[v.alias(n) for n, v in fs.items()])
    labelled = base.where(F.col("ruled").isNotNull() & learnable(F.col("u")))
    half = F.pmod(F.crc32(F.concat("u", F.lit("/half"))), F.lit(2)) == 0
    taken = cut(labelled.select("u", *PARTS, (F.col("ruled") == "allow").cast("double").alias("y"), half.alias("half"), *fs).orderBy(F.xxhash64("u"), "u").limit(sample))
    tables = {p: F.broadcast(cut(part_table(base, taken.where("half"), p))) for p in PARTS}  # bounded by LEAST_SHARE and the sample

    def described(rows: DataFrame) -> DataFrame:
        for p, table in tables.items():
            rows = rows.join(table, p, "left")
        return rows.withColumns({k: F.coalesce(k, F.lit(v)) for p in PARTS for k, v in statistics(p).items()})

    margin = fit(described(taken.where("NOT half")), [*fs, *(k for p in PARTS for k in statistics(p))], "y")
    out = described(base).withColumn("margin", margin if isinstance(margin, Column) else F.lit(margin))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "host", "path", "rule", F.coalesce("ruled", F.when(F.col("margin") >= 0, "allow").otherwise("block")).alias("verdict"), "margin")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
