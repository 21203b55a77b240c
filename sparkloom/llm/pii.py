"""Personal data by fixed forms and by bootstrapped contextual extraction, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of a form for each kind that also pass its check. Every one of them,
whatever its characters, is a seed of the bootstrap. Candidates are the tokens outside base spans that look like an
identifier: MIN_LENGTH characters or more with a digit, an at sign or an underscore. The nearest words on both sides of a
seed or candidate, at any distance, are its lexical patterns. On the graph of patterns and distinct instances, a pattern's
confidence is the mean score of its instances, and an unseen candidate's score is the chance that at least one of its
confident patterns is right, 1 - prod(1 - confidence); seeds stay at 1. Scores only grow from round to round; rounds end
when one finds no new candidate and no new confident pattern. Candidates with a high score are added as spans of kind
``context``.

The forms below are equal in what they match to plainer ones: possessive repeats and look-behinds only keep long runs
of one kind of character from being tried again and again.

Edge cases: a null text counts as an empty one; texts without any span have empty lists; repeated rows have equal
spans, and their candidates count once, as every distinct candidate does; an empty table gives no rows; extra columns
are ignored. Texts are searched whole; positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, whole_text, written

# fixed values: the forms of each kind, in the order of kinds
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this can't have a span of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CANDIDATE = r"(?<!\S)[^\s0-9@_]*+[0-9@_]\S*+"
EDGE = r"\"'()<>\[\]{}|,;:!?.%$&*#"
BLOCK = 64
MIN_LENGTH = 4
MIN_SEEDS, PATTERN_CONFIDENCE, INSTANCE_SCORE = 3, 0.6, 0.8


def _pieces(text: Column, form: str) -> tuple[Column, Column]:
    return F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _starts(between: Column, matches: Column) -> Column:
    """Where each match starts: sums of what lies before it, in two levels so that many matches stay cheap."""
    n = F.size(matches)
    steps = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(between, i)))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

    def starts(step: Column) -> Column:
        sums = F.transform(blocks, lambda b: _total(F.slice(step, b * BLOCK + 1, BLOCK)))

        def within(sum_: Column) -> Column:
            before = F.transform(sum_, lambda _, b: _total(F.slice(sum_, F.lit(1), b)))
            block = lambda i: F.floor(i / BLOCK).cast("int")
            return F.element_at(F.transform(F.array(before), lambda at: F.transform(
                matches, lambda _, i: F.get(at, block(i)) + _total(F.slice(step, block(i) * BLOCK + 1, i % BLOCK)) + F.length(F.get(between, i)))), 1)

        return F.element_at(F.transform(F.array(sums), within), 1)

    return F.when(n > 0, F.element_at(F.transform(F.array(steps), starts), 1)).otherwise(F.array().cast("array<int>"))


def _located(df: DataFrame, form: str, out: str, there: Column | None = None) -> DataFrame:
    """Adds out: array of (start, end, match, before, after); before and after are the texts between matches."""
    between, matches = _pieces(F.col("text"), form)
    if there is not None:
        between, matches = F.when(there, between).otherwise(F.array(F.col("text"))), F.when(there, matches).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__m", matches)
    df = df.withColumn("__b", F.when(F.size("__m") > 0, between))
    df = df.withColumn("__s", _starts(F.col("__b"), F.col("__m")))
    span = lambda m, i: F.struct(
        F.get("__s", i).alias("start"), (F.get("__s", i) + F.length(m)).alias("end"), m.alias("match"),
        F.get("__b", i).alias("before"), F.get("__b", i + 1).alias("after"),
    )
    return df.withColumn(out, F.transform("__m", span)).drop("__m", "__b", "__s")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(short(p)) <= 3, F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda f: passes(kind, f["match"])


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, seeds (token, patterns) and, for each kind, an array of (start, end)."""
    df = docs.select("doc_id", whole_text().alias("text"))
    for kind, form in FORMS.items():
        there = F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
        if kind == "ip":
            there = F.col("text").rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
        df = _located(df, form, "__found", there)
        good = F.filter("__found", _passing(kind))
        df = df.withColumn("__good", good)
        df = df.withColumn(kind, F.transform("__good", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))
        df = df.withColumn(f"__seeds_{kind}", F.transform("__good", lambda f: F.struct(F.xxhash64(F.lower(f["match"])).alias("token"), _patterns(f).alias("patterns")))).drop("__found", "__good")
    names = [f"__seeds_{kind}" for kind in FORMS]
    return df.withColumn("seeds", F.concat(*names)).drop(*names)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{EDGE}]++|(?<![{EDGE}])[{EDGE}]++$", "")


def _patterns(f: Column) -> Column:
    """The nearest word before and after a match, lower-cased and without signs around it, as far as there are any."""
    before = F.regexp_extract(f["before"], rf"(?<!\S)([{EDGE}]*+[^\s{EDGE}]\S*+)(?:\s++|$)[\s{EDGE}]*+$", 1)
    after = F.regexp_extract(f["after"], rf"^[\s{EDGE}]*+(\S++)", 1)
    left, right = _stripped(F.lower(before)), _stripped(F.lower(after))
    return F.filter(F.array(F.when(left != "", F.concat(F.lit("<"), left)), F.when(right != "", F.concat(F.lit(">"), right))), lambda p: p.isNotNull())


def candidates(df: DataFrame) -> DataFrame:
    """Adds candidates: array of (start, end, token, patterns) of the tokens that look like identifiers."""
    df = _located(df, CANDIDATE, "__found", F.col("text").rlike("[0-9@_]"))
    taken = F.concat(*FORMS)

    def make(f: Column) -> Column:
        lead = F.length(F.regexp_extract(f["match"], f"^([{EDGE}]*+)", 1))
        token = _stripped(f["match"])
        start, end = f["start"] + lead, f["start"] + lead + F.length(token)
        return F.struct(
            start.alias("start"), end.alias("end"), F.xxhash64(F.lower(token)).alias("token"), _patterns(f).alias("patterns"),
            F.exists(taken, lambda b: (b["start"] < end) & (start < b["end"])).alias("base"),
        )

    made = F.filter(F.transform("__found", make), lambda c: ~c["base"] & (c["end"] - c["start"] >= MIN_LENGTH))
    return df.withColumn("candidates", made).drop("__found")


def bootstrap(found: DataFrame) -> DataFrame:
    """Tokens that confident patterns discover (column token), from rows with arrays of seeds and candidates."""
    ends = lambda column, seed: found.select(F.explode(column).alias("c")).select("c.token", F.lit(seed).alias("seed"), F.explode("c.patterns").alias("pattern"))
    each = ends("seeds", True).unionAll(ends("candidates", False))
    edges = cut_lineage(each.groupBy("pattern", "token").agg(F.max("seed").alias("seed")))
    seeds = edges.groupBy("token").agg(F.max("seed").alias("seed"))
    scores, known = cut_lineage(seeds.select("token", "seed", F.col("seed").cast("double").alias("score"))), None
    while True:
        patterns = edges.join(scores.select("token", "score"), "token").groupBy("pattern").agg(
            F.avg("score").alias("confidence"), F.sum((F.col("score") >= INSTANCE_SCORE).cast("long")).alias("support")
        )
        # as a table its size is known: few patterns are broadcast, many are dealt, and a hot one is then split
        good = written(patterns.where((F.col("confidence") >= PATTERN_CONFIDENCE) & (F.col("support") >= MIN_SEEDS)).select("pattern", "confidence"))
        wrong = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        reached = edges.join(good, "pattern").groupBy("token").agg(F.round(1 - F.exp(wrong), 9).alias("reached"))
        scores = cut_lineage(scores.select("token", "seed").join(reached, "token", "left").select(
            "token", "seed", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score")
        ))
        new = scores.where(~F.col("seed") & (F.col("score") >= INSTANCE_SCORE)).select("token")
        counts = (new.count(), good.count())
        if counts == known or not counts[1]:
            return new
        known = counts


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and an array of (start, end) for each kind and for context, a row for each row of docs."""
    found = candidates(base_spans(docs)).withColumn("h", F.xxhash64("text")).drop("text")
    found = cut_lineage(found)
    tokens = bootstrap(found)
    each = found.where(F.size("candidates") > 0).select("doc_id", "h", F.explode("candidates").alias("c"))
    each = each.select("doc_id", "h", F.col("c.token").alias("token"), F.col("c.start").alias("start"), F.col("c.end").alias("end")).distinct()
    hits = each.join(tokens, "token").groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("context"))
    key = (F.col("f.doc_id").eqNullSafe(F.col("x.doc_id"))) & (F.col("f.h") == F.col("x.h"))
    return found.drop("candidates", "seeds").alias("f").join(hits.alias("x"), key, "left").select(
        "f.*", F.coalesce("x.context", F.array().cast("array<struct<start:int,end:int>>")).alias("context")
    )


def span_text(*kinds: str) -> Column:
    def part(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(part, kinds)), ",")


def redact(docs: DataFrame, mask: str = "█") -> DataFrame:
    """docs with every base span of the text overwritten by as many masks."""
    df = base_spans(docs.withColumn("doc_id", F.struct(*docs.columns)))
    chars = F.split("text", "")
    spans = F.concat(*FORMS)
    hidden = F.array_join(F.transform(chars, lambda c, i: F.when(F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])), F.lit(mask)).otherwise(c)), "")
    return df.select(*[(F.when(F.size(spans) > 0, hidden).otherwise(F.col("doc_id.text")) if c == "text" else F.col(f"doc_id.{c}")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    made = personal_data(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in FORMS], F.sha2(span_text(*FORMS).cast("binary"), 256).alias("base_sha256"),
        span_text(*FORMS, "context").alias("spans"), F.size("context").cast("long").alias("n_context"),
    )
