"""Secret scans: fixed patterns, plus strings that a character Markov model takes for random.

Only DataFrame functions. Two first-order models over printable ASCII, of random strings and of ordinary identifiers, are trained
from labelled samples; what scoring needs is one table of 96 x 96 log-likelihood ratios, whatever the samples' size. A run of at least
min_run characters of the base64 and identifier alphabets is reported if the sum of its ratios passes the threshold and no
pattern span overlaps it. Text passes through whole; each pattern first tests a text and only those that match are cut up.

Spans are (start, end, kind) in code points, end exclusive, by start and then kind. Defined results: null text has no spans;
rows that repeat a doc_id each get a row; very long texts count whole, in time linear in their matches; an empty table gives no rows;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns of the kinds, in their order, with the group and least length that a match needs.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
_FIRST, _SYMBOLS = 32, 96

#: Ordinary words that labelled identifiers are made of.
_WORDS = (
    "account address amount application array before between buffer cache check class client code column command common config content"
    " context control count create current customer data database default delete description direct document element error event example"
    " export field file filter format function global group handler header history image import index info input instance integer"
    " interface item keyword label language length level library limit list local location login manager master memory message method"
    " model module name network node number object offer option order output package page parameter parser password path payment"
    " pending person picture plan player point position price process product profile project property public query queue random record"
    " region register report request resource response result return sample schema screen search second section select sequence server"
    " service session setting shipping single source start state status storage store stream string system table target template"
    " token total track transfer type unit update upload user value variable vector version view window worker"
    " und der die das nicht mit einer werden les des une dans pour est que los las por para con una del"
).split()


def labelled_samples(spark: SparkSession, n: int = 6000, first: int = 0) -> DataFrame:
    """(value, is_random): n random strings over several alphabets and n ordinary identifiers, made by rule from the numbers from first on."""
    ids = spark.range(first, first + n)
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    random = ids.select(
        F.element_at(
            F.array(digest, b64, F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 20)), F.translate(b64, "+/=", "-_")),
            (F.col("id") % 4).cast("int") + 1,
        ).alias("value"),
        F.lit(1).alias("is_random"),
    )
    words = F.array(*[F.lit(w) for w in _WORDS])

    def word(k: int) -> Column:
        return F.element_at(words, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(_WORDS))).cast("int") + 1)

    a, b, c, d = (word(k) for k in range(4))
    number = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(10_000)).cast("string")
    forms = [
        F.concat_ws("_", a, b, c, d),
        F.concat_ws("-", a, b, c, number),
        F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)),
        F.upper(F.concat_ws("_", a, b, c)),
        F.concat_ws("/", F.lit(""), a, b, c, number),
        F.concat(a, b, c, d),
        F.repeat(F.substring(F.lit("-=_+/#*.ax0"), F.pmod(F.col("id"), F.lit(11)).cast("int") + 1, F.lit(1)), 24),
        F.upper(F.concat(a, b, c)),
        F.concat(F.lit("20240101"), number, number, number),
    ]
    ordinary = ids.select(F.element_at(F.array(*forms), (F.col("id") % len(forms)).cast("int") + 1).alias("value"), F.lit(0).alias("is_random"))
    return random.unionByName(ordinary)


def _codes(value: Column) -> Column:
    """Symbol numbers of a string's characters; what isn't printable ASCII is the last symbol."""
    inside = lambda c: F.when((c >= _FIRST) & (c < _FIRST + _SYMBOLS - 1), c - _FIRST).otherwise(_SYMBOLS - 1)
    return F.transform(F.split(value, ""), lambda ch: inside(F.ascii(ch)))


def _pairs(value: Column) -> Column:
    """Cell numbers, from 1, of a string's neighbouring characters."""
    codes = _codes(value)
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: (a * _SYMBOLS + b + 1).cast("int"))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary) for each pair of symbols, in cell order."""
    usable = samples.filter("value IS NOT NULL AND length(value) > 1 AND is_random IS NOT NULL")
    pairs = usable.select("is_random", F.explode(_pairs(F.col("value"))).alias("cell"))
    counts = {(r.is_random, r.cell): r.n for r in pairs.groupBy("is_random", "cell").agg(F.count("*").alias("n")).collect()}  # 2 x 96 x 96 at most
    ratios = []
    for first in range(_SYMBOLS):
        cells = [first * _SYMBOLS + second + 1 for second in range(_SYMBOLS)]
        totals = [sum(counts.get((k, c), 0) for c in cells) + smoothing * _SYMBOLS for k in (0, 1)]
        ratios += [
            math.log((counts.get((1, c), 0) + smoothing) / totals[1]) - math.log((counts.get((0, c), 0) + smoothing) / totals[0]) for c in cells
        ]
    return ratios


def log_ratio(value: Column, model: list[float]) -> Column:
    """How much likelier a string is as a random one than as an ordinary identifier, in nats."""
    table = F.lit(model)
    steps = F.transform(_pairs(value), lambda cell: F.element_at(table, cell))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


_CHUNK = 256


def _running(items: str, out: str, zero: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> list[tuple[str, Column]]:
    """Columns, to be added one after the other, of which the last holds combine's running value before each item of an array.

    In two levels, chunks and items: an array grown inside aggregate is copied at each step, so none may be long.
    """
    chunks, heads = f"__{out}_chunks", f"__{out}_heads"

    def run(part: Column, start: Column, of: Callable[[Column], Column]) -> Column:
        none = F.array().cast("array<int>")
        step = lambda acc, x: F.struct(combine(acc["at"], of(x)).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("seen")), step, lambda acc: acc["seen"])

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _CHUNK).cast("int"))
    cut = F.transform(F.when(F.size(items) > 0, numbers).otherwise(F.array().cast("array<int>")), lambda c: F.slice(items, c * _CHUNK + 1, _CHUNK))
    totals = F.transform(chunks, lambda chunk: F.aggregate(chunk, zero, lambda acc, x: combine(acc, value(x))))
    inside = F.flatten(F.zip_with(chunks, heads, lambda chunk, head: run(chunk, head, value)))
    return [(chunks, cut), (heads, run(totals, zero, lambda t: t)), (out, inside)]


def _with(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    for name, column in columns:
        df = df.withColumn(name, column)
    return df


def _add_matches(df: DataFrame, name: str, pattern: str, group: int) -> DataFrame:
    """df with array column name: (start, end, part) of the matches in its column __text, part being a group's text; [] where there are none."""
    text = F.col("__text")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pieces = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("len"), part.alias("part"))
    items, before = f"__{name}_pieces", f"__{name}_before"
    df = df.withColumn(items, F.when(text.rlike(pattern), pieces).otherwise(F.array().cast("array<struct<gap:int,len:int,part:string>>")))
    df = _with(df, _running(items, before, F.lit(0), lambda p: p["gap"] + p["len"], lambda x, y: x + y))

    def placed(p: Column, at: Column) -> Column:
        return F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["len"]).alias("end"), p["part"].alias("part"))

    return df.withColumn(name, F.zip_with(items, before, placed))


def find_secrets(docs: DataFrame, model: list[float], threshold: float = 12.0, min_run: int = 20) -> DataFrame:
    """(doc_id, base, spans): sorted arrays of (start, rank, end, kind); base holds the fixed kinds, spans also the model's."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    for kind, pattern, group, _ in KINDS:
        df = _add_matches(df, kind, pattern, group)
    df = _add_matches(df, "runs", f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{min_run},}}", 0)

    def ranked(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def long_enough(kind: str, least: int) -> Column:
        return F.filter(kind, lambda s: F.length(s["part"]) >= least)

    df = df.withColumn("base", F.sort_array(F.concat(*[ranked(long_enough(kind, least), i, kind) for i, (kind, _, _, least) in enumerate(KINDS)])))
    # A run is free if no base span that starts before its end ends after its start: one pass over both by place, runs first at a tie.
    event = lambda at, base, start, end, part: F.struct(at.alias("at"), F.lit(base).alias("base"), start.alias("start"), end.alias("end"), part.alias("part"))
    of_base = F.transform("base", lambda b: event(b["start"], 1, b["start"], b["end"], F.lit("")))
    of_runs = F.transform("runs", lambda r: event(r["end"], 0, r["start"], r["end"], r["part"]))
    df = df.withColumn("__events", F.sort_array(F.concat(of_base, of_runs)))
    reach = _running("__events", "__reach", F.lit(-1), lambda e: F.when(e["base"] == 1, e["end"]).otherwise(F.lit(-1)), F.greatest)
    df = _with(df, reach)
    met = F.zip_with("__events", "__reach", lambda e, r: F.when((e["base"] == 0) & (r <= e["start"]), e))
    df = df.withColumn("__free", F.filter(met, lambda e: e.isNotNull()))
    random = F.filter("__free", lambda e: log_ratio(e["part"], model) > threshold)
    return df.select("doc_id", "base", F.sort_array(F.concat("base", ranked(random, len(KINDS), "markov"))).alias("spans"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
