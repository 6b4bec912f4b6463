"""URL filters: host and path rules first, gradient-boosted trees for the rest.

URLs that a rule fits are the labelled ones.  The trees learn from a sample of
them, drawn by a hash of the URL (``TRAIN`` rows are expected, however many
there are), on lexical features: lengths, depth, digit ratio, entropy, counts
of parameters and hyphens, and for the URL's suffixes (top-level domain,
registered name, first path segment, that under the domain) the share of blocked URLs in the sample.
The suffix tables have at most one row for each sampled URL, so they are
broadcast.  All features are column expressions; training and scoring are
Spark's own GBTClassifier.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and goes to the trees with empty features; with one class
among the labelled URLs that class is every verdict of the method, and with
none it is ``allow``.  Repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN = 20_000
SUFFIXES = ("tld", "name", "section", "place")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules_of(lines: dict[str, str]) -> list[Rule]:
    """``{"net/en/": "allow"}`` as rules."""
    return [Rule(v, k[:k.index("/")], k[k.index("/"):]) for k, v in lines.items()]


# Fixed rules.
RULES = rules_of({"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"})


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    before = F.substring_index(rest, "?", 1)
    raw = F.substring_index(before, "/", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.substr(before, F.length(raw) + 1), F.substr(rest, F.length(before) + 2)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first, so it comes last here
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def entropy(s: Column) -> Column:
    """Bits a character."""
    n = F.length(s)
    share = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def count_of(s: Column, char: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))).cast("double")


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host, path, the lexical features ``f_*`` and the suffix keys."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path, query = parts(F.col(url))
    df = df.withColumns({"host": host, "path": path, "_query": query})
    host, path, query = F.col("host"), F.col("path"), F.col("_query")
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    return df.withColumns({
        "f_length": F.length(u).cast("double"),
        "f_host": F.length(host).cast("double"),
        "f_path": F.length(path).cast("double"),
        "f_depth": count_of(path, "/"),
        "f_labels": count_of(host, "."),
        "f_hyphens": count_of(host, "-"),
        "f_digits": F.coalesce(F.try_divide(digits, F.length(u)), F.lit(0.0)),
        "f_entropy": entropy(host),
        "f_params": F.when(F.length(query) > 0, count_of(query, "&") + 1).otherwise(0.0),
        "f_extension": F.rlike(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("double"),
        "tld": F.substring_index(host, ".", -1),
        "name": F.substring_index(host, ".", -2),
        "section": F.substring_index(F.substr(path, F.lit(2)), "/", 1),
        "place": F.concat_ws("/", F.substring_index(host, ".", -1), F.substring_index(F.substr(path, F.lit(2)), "/", 1)),
    }).drop("_query")


class Model:
    def __init__(self, taught: DataFrame, train: int = TRAIN):
        """``taught``: the output of ``lexical`` with ``blocked`` (0 or 1)."""
        seen = {r["blocked"]: r["count"] for r in taught.groupBy("blocked").count().collect()}
        self.only = ("block" if 1 in seen else "allow") if len(seen) < 2 else None
        if self.only:
            return
        share = min(1.0, train / sum(seen.values()))
        u = F.pmod(F.xxhash64(F.lit("urls"), "host", "path", "f_length"), F.lit(1 << 40)) / float(1 << 40)
        sample = taught.where(u < share).select("blocked", *(c for c in taught.columns if c.startswith("f_")), *SUFFIXES).coalesce(4).cache()
        self.prior = seen[1] / sum(seen.values())
        # at most one row for each sampled URL
        self.tables = {s: sample.groupBy(s).agg(((F.sum("blocked") + 2 * self.prior) / (F.count("*") + 2)).alias(f"f_{s}")) for s in SUFFIXES}
        self.features = [c for c in sample.columns if c.startswith("f_")] + [f"f_{s}" for s in SUFFIXES]
        self.assembler = VectorAssembler(inputCols=self.features, outputCol="_x")
        learner = GBTClassifier(featuresCol="_x", labelCol="blocked", predictionCol="_blocked", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.3, seed=7)
        self.trees = learner.fit(self.assembler.transform(self._with_suffixes(sample)).select("_x", F.col("blocked").cast("double").alias("blocked")))

    def _with_suffixes(self, df: DataFrame) -> DataFrame:
        for s, table in self.tables.items():
            df = df.join(F.broadcast(table), s, "left").fillna({f"f_{s}": self.prior})
        return df

    def verdicts(self, df: DataFrame, out: str) -> DataFrame:
        if self.only:
            return df.withColumn(out, F.lit(self.only))
        scored = self.trees.transform(self.assembler.transform(self._with_suffixes(df)))
        return scored.withColumn(out, F.when(F.col("_blocked") > 0.5, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    read = lexical(pages.select(F.col(id_col), F.col(url)), url)
    text, verdict = ruled(F.col("host"), F.col("path"), rules)
    read = read.withColumns({"rule": text, "_fixed": verdict})
    model = Model(read.where(F.col("rule").isNotNull()).withColumn("blocked", (F.col("_fixed") == "block").cast("int")))
    return model.verdicts(read, "_method").select(id_col, "host", "path", "rule", F.coalesce("_fixed", "_method").alias("verdict"))
