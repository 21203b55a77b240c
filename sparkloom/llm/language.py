"""Language ID by Bayesian evidence fusion.

Four kinds of evidence about a web page are combined as log-probabilities by language:

* the likelihood of its visible text under byte trigram models, tempered to the weight of at most STRONG trigrams, as
  neighbouring trigrams are not independent;
* the language that its markup declares, and the suffix of its address, each by a table of P(value | language) with
  additive smoothing;
* a prior of its host, smoothed towards that of its domain, which is smoothed towards that of all pages.

The tables and priors are grouped aggregations of the pages' text posteriors (soft counts) over all pages. A page's own
soft count is taken out of its host's and domain's before they are used. The trigram models are fitted on at most
``max_rows`` texts with a known language, those with the smallest hashes of doc_id.

Edge cases: a page without text, declaration or address is judged by what is left, at last by the prior of all pages;
nulls count as empty; repeated rows count as often as they come; ties go to the language first in order; an empty table
gives no rows; extra columns are ignored. Without labelled texts there are no languages and ``lang`` is null.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, whole_text, written

BITS = 15
STRONG = 60.0
MAX_ROWS = 4_000
KAPPA_HOST, KAPPA_DOMAIN, ALPHA = 4.0, 16.0, 0.5
SEED = 5

_BLOCKS = re.compile(r"<!--.*?-->|<(script|style|nav|header|footer|aside|form|noscript)\b.*?</\1\s*>|<div[^>]*class=[\"']?(?:ad|ads|advert|cookie|menu)\b.*?</div\s*>", re.S | re.I)
_TAGS = re.compile(r"<[^>]*>")
_COMMENTS = re.compile(r"<!--.*?-->", re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible_text(page: str) -> str:
    return markup.unescape(_TAGS.sub(" ", _BLOCKS.sub(" ", page)))


def trigrams(text: str, bits: int = BITS) -> np.ndarray:
    data = np.frombuffer(" ".join(f" {text} ".lower().split()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    h = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)
    return h >> np.uint32(32 - bits)


class Languages:
    """names, and log P(trigram bucket | language), a row for each bucket."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table.astype(np.float32)

    def log_likelihood(self, text: str) -> np.ndarray:
        """Sum of log-probabilities less the best, tempered."""
        at = trigrams(text)
        if not len(at):
            return np.zeros(len(self.names))
        mean = self.table[at].mean(axis=0, dtype=np.float64)
        return (mean - mean.max()) * min(len(at), STRONG)


def fit(texts: list[str], langs: list[str], bits: int = BITS) -> Languages:
    names = sorted(set(langs))
    counts = np.full((1 << bits, len(names)), 0.1)
    for text, lang in zip(texts, langs, strict=True):
        counts[:, names.index(lang)] += np.bincount(trigrams(text, bits), minlength=1 << bits)
    return Languages(names, np.log(counts / counts.sum(axis=0)) if names else counts)


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> Languages:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    n = max(1, known.count())
    share = min(1.0, max_rows / n)
    picked = known.select("doc_id", "lang", whole_text().alias("text"), F.xxhash64(F.lit(SEED), "doc_id").alias("h")).where(
        F.pmod(F.col("h"), F.lit(1_000_003)) < int(1_000_003 * share) + 1
    )
    rows = picked.orderBy("h", "doc_id").limit(max_rows).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def host_of(url: Column) -> Column:
    """The address' host in lower case, without user, port and a final dot."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?:[:/?#]|$)", 1))


def evidence(pages: DataFrame, languages: Languages) -> DataFrame:
    """page_id, host, domain, suffix, declared, text_score (array by language)."""
    shared = pages.sparkSession.sparkContext.broadcast(languages)

    def run(batches):
        for batch in batches:
            declared, score = [], []
            for page in batch.column(2).to_pylist():
                m = _LANG.search(_COMMENTS.sub(" ", page))
                declared.append(m[1].lower() if m else "")
                score.append([round(float(x), 6) for x in shared.value.log_likelihood(visible_text(page))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(score, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "text_score"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    seen = read.mapInArrow(run, "page_id long, host string, declared string, text_score array<double>")
    return seen.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def _softmax(score: Column) -> Column:
    top = F.array_max(score)
    weights = F.transform(score, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: F.round(w / total, 9))


def _soft_counts(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(n)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.round(f"s{i}", 6) for i in range(n)]).alias(name))


def fuse(pages: DataFrame, languages: Languages) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host, and the posterior by language."""
    n = len(languages.names)
    if not n:
        return pages.selectExpr("page_id", "cast(null as string) lang", "0.0d confidence", "cast(null as string) text_lang", "'' declared", "'' host", "cast(array() as array<double>) posterior")
    seen = cut_lineage(evidence(pages, languages).withColumn("soft", F.when(F.array_max("text_score") > F.array_min("text_score"), _softmax(F.col("text_score"))).otherwise(F.array(*[F.lit(0.0)] * n))))
    everything = _soft_counts(seen, [], n, "all").first()["all"] or [0.0] * n
    everything = np.array([x or 0.0 for x in everything])
    prior = (everything + 1) / (everything.sum() + n)
    # as tables their sizes are known: few values are broadcast, many are dealt, and a hot one is then split
    by_value = lambda key: written(_soft_counts(seen, [key], n, f"c_{key}").where(F.col(key) != ""))

    def table(key: str) -> DataFrame:
        """log P(value | language) by value; the values seen share the smoothing."""
        counts = by_value(key)
        values = max(1, counts.count())
        logs = [F.log((F.col(f"c_{key}")[i] + ALPHA) / F.lit(float(everything[i] + ALPHA * (values + 1)))) for i in range(n)]
        return counts.select(key, F.array(*logs).alias(f"l_{key}"))

    hosts, domains = by_value("host"), by_value("domain")  # pages without an address are no host
    joined = seen.join(hosts, "host", "left").join(domains, "domain", "left").join(table("declared"), "declared", "left").join(table("suffix"), "suffix", "left")
    base = F.array(*[F.lit(float(p)) for p in prior])
    less = lambda c: F.zip_with(F.coalesce(c, "soft"), "soft", lambda a, b: F.greatest(a - b, F.lit(0.0)))  # noqa: E731  without the page itself
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda c, up, kappa: F.zip_with(c, up, lambda a, u: (a + kappa * u) / (total(c) + kappa))
    joined = joined.withColumn("c_host", less(F.col("c_host"))).withColumn("c_domain", less(F.col("c_domain")))
    joined = joined.withColumn("p_domain", smooth(F.col("c_domain"), base, KAPPA_DOMAIN))
    joined = joined.withColumn("p_host", smooth(F.col("c_host"), F.col("p_domain"), KAPPA_HOST))
    zero = F.array(*[F.lit(0.0)] * n)
    parts = [F.col("text_score"), F.coalesce("l_declared", zero), F.coalesce("l_suffix", zero), F.transform("p_host", lambda p: F.log(p))]
    score = parts[0]
    for p in parts[1:]:
        score = F.zip_with(score, p, lambda a, b: a + b)
    joined = joined.withColumn("posterior", _softmax(score))
    names = F.array(*[F.lit(x) for x in languages.names])
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return joined.select(
        "page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"),
        F.when(F.array_max("soft") > 0, best(F.col("soft"))).alias("text_lang"), "declared", "host", "posterior",
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    made = fuse(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))
    return made.withColumn("posterior", F.array_join(F.col("posterior").cast("array<string>"), ","))
