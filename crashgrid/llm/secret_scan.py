"""Secrets in texts: fixed patterns and a battery of randomness tests.

Patterns find assignments, access keys and long hexadecimal numbers. The battery looks at
every other long run of token characters. It infers the encoding (the smallest alphabet
that holds all characters), and tests letters against the uniform distribution (chi
squared), the sequence of low and high letters (runs) and neighbours (serial
correlation); the three p-values are combined by Fisher's method. A run is reported if
randomness is not rejected and if ordinary text is rejected.

Ordinary text is a chain of token characters: the pairs of neighbours in all distinct words
of the corpus that are shorter than the runs under test (WORD_LENGTHS), leaning on fixed rates of changes between
kinds of characters where a character is rare. The likelihood of a run under the uniform
distribution over its encoding, over that under the chain, has mean 1 for ordinary text,
so its inverse (times the number of encodings, from which the best is taken) bounds the
p-value at every length. False discoveries are controlled within bands of length: in
each band the Benjamini-Hochberg threshold is found over all distinct runs of the corpus
that overlap no span of a pattern.

Everything is made of Spark's own expressions. Null is read as empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrid.llm.texts import read, text_column

# Kinds in their order, with their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGNED_LENGTH = 6
KINDS = ("assign", "access", "hex", "random")

RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Lower ends of the bands of length.
BANDS = (20, 28, 40, 64)
FALSE_DISCOVERIES = 0.01
RANDOMNESS_LEVEL = 0.001
#: Steps of -ln(p) in which p-values are counted, and the last step.
STEP, LAST_STEP = 0.125, 400

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from narrow to wide.
ENCODINGS = (
    DIGITS,
    DIGITS + LOWER[:6],
    DIGITS + UPPER[:6],
    UPPER + "234567",
    LOWER,
    UPPER,
    DIGITS + LOWER,
    DIGITS + UPPER,
    LOWER + UPPER,
    DIGITS + LOWER + UPPER,
    UPPER + LOWER + DIGITS + "+/-_",
)

#: Lengths of the words whose pairs are counted, and the characters of words and runs.
WORD_LENGTHS, CHARACTERS = (8, BANDS[0] - 1), LOWER + UPPER + DIGITS + "+/-_"
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,%d}+(?![A-Za-z0-9+/_-])" % WORD_LENGTHS
#: How often a kind of character (lower, upper, digit, sign) follows another in
#: ordinary runs; and the number of pairs per first character that they stand for.
CHANGES = ((0.94, 0.02, 0.01, 0.03), (0.50, 0.45, 0.02, 0.03), (0.05, 0.02, 0.85, 0.08), (0.60, 0.15, 0.15, 0.10))
LEAN = 50

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: str, pattern: str, kind: int, matches: str, least: int = 0) -> Column:
    """Spans of the matches in column ``matches``, placed by the texts between them."""
    keep = f"length(regexp_extract(x.m, '{_quoted(pattern)}', 2)) >= {least}" if least else "true"
    found = f"""
    aggregate(
      zip_with(split({text}, '{_quoted(pattern)}', -1), {matches}, (g, m) -> struct(length(g) as g, m)),
      named_struct('at', 0, 'out', cast(array() as {_SPAN})),
      (acc, x) -> named_struct(
        'at', acc.at + x.g + coalesce(length(x.m), 0),
        'out', if(x.m is not null and {keep},
          concat(acc.out, array(named_struct('start', acc.at + x.g, 'kind', {kind}, 'end', acc.at + x.g + length(x.m)))),
          acc.out)),
      acc -> acc.out)"""
    return F.expr(f"if(size({matches}) = 0, cast(array() as {_SPAN}), {found})")


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base``: spans of the patterns as (start, kind, end), sorted."""
    found = docs.select(
        "*",
        *[
            F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias(f"_m{i}")
            for i, p in enumerate((ASSIGN, ACCESS, HEX))
        ],
    )
    parts = [
        _spans(text, p, i, f"_m{i}", ASSIGNED_LENGTH if i == 0 else 0) for i, p in enumerate((ASSIGN, ACCESS, HEX))
    ]
    return found.select(*docs.columns, F.sort_array(F.concat(*parts)).alias("_base"))


def _encoding(run: str) -> str:
    """The narrowest encoding that holds all letters of ``run``."""
    cases = [f"when length(translate({run}, '{letters}', '')) = 0 then '{letters}'" for letters in ENCODINGS[:-1]]
    return "case " + " ".join(cases) + f" else '{ENCODINGS[-1]}' end"


def pair_counts(docs: DataFrame, text: str) -> dict[str, int]:
    """How often each pair of neighbours occurs in the distinct words of all texts: at most 66 * 66 numbers."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    pairs = docs.select(F.explode(words).alias("w")).distinct().select(
        F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("pair")
    )
    return {r.pair: r.n for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}


def chain(counts: dict[str, int]) -> str:
    """Negative logarithms of how often each character follows each, in order of CHARACTERS, comma-joined."""
    kinds = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 4
    out = []
    for i, first in enumerate(CHARACTERS):
        total = sum(counts.get(first + c, 0) for c in CHARACTERS)
        for j, second in enumerate(CHARACTERS):
            usual = CHANGES[kinds[i]][kinds[j]] / kinds.count(kinds[j])
            out.append(f"{-math.log((counts.get(first + second, 0) + LEAN * usual) / (total + LEAN)):.4f}")
    return ",".join(out)


def _two_sided(z: str) -> str:
    """P-value of a standard normal value, by a logistic fit of the normal distribution."""
    return f"(2 / (1 + exp(least(1.5976D * abs({z}) + 0.07056D * pow(abs({z}), 3), 600D))))"


#: The battery as steps, each a list of (name, expression over the fields so far).
_BATTERY = (
    [("s", "regexp_replace(t.run, '=+$', '')")],
    [
        ("e", _encoding("t.s")),
        ("n", "double(length(t.s))"),
        ("c", f"transform(split(t.s, ''), c -> instr('{CHARACTERS}', c))"),
    ],
    [
        ("k", "double(length(t.e))"),
        ("squares", "aggregate(split(t.e, ''), 0D, (acc, c) -> acc + pow(length(t.s) - length(replace(t.s, c, '')), 2))"),
        ("x", "transform(split(t.s, ''), c -> double(instr(t.e, c)))"),
    ],
    [
        ("mean", "aggregate(t.x, 0D, (acc, v) -> acc + v) / t.n"),
        ("high", "transform(t.x, v -> int(v > floor(t.k / 2)))"),
        ("last", "int(t.n) - 1"),
    ],
    [
        ("ones", "double(aggregate(t.high, 0, (acc, v) -> acc + v))"),
        (
            "changes",
            "aggregate(zip_with(slice(t.high, 1, t.last), slice(t.high, 2, t.last), (u, v) -> int(u != v)), 0, (acc, v) -> acc + v)",
        ),
        (
            "covariance",
            "aggregate(zip_with(slice(t.x, 1, t.last), slice(t.x, 2, t.last), (u, v) -> (u - t.mean) * (v - t.mean)), 0D, (acc, v) -> acc + v)",
        ),
        ("variance", "aggregate(t.x, 0D, (acc, v) -> acc + pow(v - t.mean, 2))"),
        (
            "text_l",
            "aggregate(zip_with(slice(t.c, 1, t.last), slice(t.c, 2, t.last),"
            f" (u, v) -> element_at({{chain}}, (u - 1) * {len(CHARACTERS)} + v)), 0D, (acc, v) -> acc + v)",
        ),
    ],
    [
        ("expected", "2 * t.ones * (t.n - t.ones) / t.n + 1"),
        ("chi_z", "(t.squares * t.k / t.n - t.n - (t.k - 1)) / sqrt(2 * (t.k - 1) * (1 - 1 / t.n))"),
        ("serial_z", "if(t.variance > 0, t.covariance / t.variance * sqrt(t.n), 40D)"),
        ("ratio", f"t.text_l - t.last * ln(t.k) - ln({len(ENCODINGS)})"),
    ],
    [("runs_var", "(t.expected - 1) * (t.expected - 2) / (t.n - 1)")],
    [("runs_z", "if(t.runs_var > 0, (t.changes + 1 - t.expected) / sqrt(t.runs_var), 40D)")],
    [
        ("f", f"-ln({_two_sided('t.chi_z')}) - ln({_two_sided('t.runs_z')}) - ln({_two_sided('t.serial_z')})"),
    ],
)
_VERDICT = (
    ("run", "t.run"),
    ("random_p", "exp(-t.f) * (1 + t.f + t.f * t.f / 2)"),
    ("step", f"int(greatest(least(floor(t.ratio / {STEP}D), {LAST_STEP}), 0))"),
    ("band", " + ".join(f"int(t.n >= {low})" for low in BANDS[1:])),
)


def tested(runs: str, logs: str) -> Column:
    """Tests of a column of arrays of runs: array of (run, random_p, step, band), in order.

    ``logs`` is the chain of ordinary text. ``random_p`` is the combined test of
    randomness, ``step`` counts -ln p of ordinary text in units of STEP, ``band`` is the
    band of length.
    """
    table = f"cast(split('{logs}', ',') as array<double>)"
    out, fields = f"transform({runs}, r -> named_struct('run', r))", ["run"]
    for step in _BATTERY:
        held = [f"'{f}', t.{f}" for f in fields]
        made = [f"'{name}', {e.replace('{chain}', table)}" for name, e in step]
        out = f"transform({out}, t -> named_struct({', '.join([*held, *made])}))"
        fields += [name for name, _ in step]
    return F.expr(f"transform({out}, t -> named_struct({', '.join(f"'{name}', {e}" for name, e in _VERDICT)}))")


def _runs(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_base``, ``_m3`` (long runs), ``_places`` (their spans) and ``_free`` (overlaps no base span)."""
    based = base_spans(docs, text).withColumn("_m3", F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))
    placed = based.withColumn("_places", _spans(text, RUN, 3, "_m3"))
    return placed.withColumn("_free", F.expr("transform(_places, p -> not exists(_base, b -> b.start < p.end and p.start < b.end))"))


def thresholds(docs: DataFrame, text: str, logs: str) -> dict[int, int]:
    """Least step that passes in each band, by Benjamini-Hochberg over distinct runs outside base spans.

    At most one number per band comes to the driver.
    """
    some = _runs(docs.where(F.col(text).rlike(RUN)).select(text), text)
    free = F.expr("transform(filter(arrays_zip(_m3, _free), r -> r._free), r -> r._m3)")
    runs = some.select(F.explode(free).alias("run")).distinct()
    counted = runs.select(tested("array(run)", logs)[0].alias("t")).groupBy("t.band", "t.step").agg(F.count("*").alias("rows"))
    by_band = Window.partitionBy("band")
    above = F.sum("rows").over(by_band.orderBy(F.desc("step")))
    share = counted.select("band", "step", (above / F.sum("rows").over(by_band)).alias("share"))
    passing = share.where(F.exp(-F.col("step") * STEP) <= F.col("share") * FALSE_DISCOVERIES)
    return {r.band: r.step for r in passing.groupBy("band").agg(F.min("step").alias("step")).collect()}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_spans`` and ``_base``: spans as (start, kind, end) in code points, sorted.

    ``kind`` counts in KINDS. ``_base`` has the spans of the patterns; ``_spans`` also the
    random runs that overlap none of them. Columns of these two names are replaced.
    """
    own = [c for c in docs.columns if c not in ("_spans", "_base")]
    filled = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), text_column(text).alias("_text"))
    logs = chain(pair_counts(filled, "_text"))
    least = thresholds(filled, "_text", logs)
    placed = _runs(filled, "_text").withColumn("_tests", tested("_m3", logs))
    passes = " or ".join(f"(t.band = {band} and t.step >= {step})" for band, step in least.items()) or "false"
    marked = f"zip_with(_places, zip_with(_tests, _free, (t, f) -> f and t.random_p >= {RANDOMNESS_LEVEL}D and ({passes})), (p, g) -> struct(p, g as good))"
    random = F.expr(f"transform(filter({marked}, r -> r.good), r -> r.p)")
    return placed.select("_doc.*", F.sort_array(F.concat("_base", random)).alias("_spans"), "_base")


def listed(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')"
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; null texts stay null."""
    cut = f"""
    aggregate(_spans, named_struct('at', 0, 'out', ''),
      (acc, s) -> named_struct(
        'at', greatest(acc.at, s.end),
        'out', if(s.start >= acc.at, concat(acc.out, substring(_body, acc.at + 1, s.start - acc.at), '{mark}'), acc.out)),
      acc -> concat(acc.out, substring(_body, acc.at + 1)))"""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_body"))
    clean = F.expr(f"if(size(_spans) = 0, _body, {cut})")
    return scan(whole, "_body").select(*[clean.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir).select("doc_id", "text"))
    counts = [
        F.expr(f"size(filter(_base, s -> s.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])
    ]
    return found.select("doc_id", *counts, F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans"))
