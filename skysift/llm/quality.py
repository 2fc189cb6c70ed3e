"""Quality rules whose cutoffs bound how many good documents they reject.

Each rule is a measure of a text; a document is rejected where any measure
exceeds its stratum's cutoff.  Labelled documents are dealt to two halves by
their id.  The first half's histograms give each stratum a path of cutoffs, all
rules together, from the loosest on: each step tightens the rule that catches
most bad documents for the good ones it costs.  The second half tests the path:
a step stands if the exact binomial probability of so few rejected good
documents, were their share ``risk``, is at most ``delta`` over the number of
strata (Bonferroni; steps are tested in their order and the first failure ends
them, which needs no further correction).  Then, with probability 1 - delta, the
rules together reject at most ``risk`` of the good documents of every stratum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import SPACES, crc_mod, map_rows, written

SYMBOLS = b"#*$%&|<>"
#: Measures, each a share or ratio of which more is worse.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "capitals": "n_upper_words / greatest(n_words, 1)",
    "single_letters": "n_bare_words / greatest(n_words, 1)",
}
#: Cutoffs from the loosest to the strictest.
CUTOFFS = [round(2.0 * 0.9**i, 6) for i in range(48)]
#: A good document lost weighs as much as so many bad ones caught, when valid cutoffs compete.
GOOD_WEIGHT = 5

_MEASURES = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_lines", "long"), ("n_upper_words", "long"), ("n_bare_words", "long")]


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that stand twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) > 1_000_000:  # three factors would overflow
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, counts = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(len(words), bool)
    often = counts[which] > 1
    for k in range(3):
        hit[k : k + len(often)] |= often
    return int(hit.sum())


def measures_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(_MEASURES)
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, SPACES))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
        sum(map((1).__eq__, map(len, words))),
    )


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Measures of whole texts beside doc_id and the columns in keep; null: as empty."""
    names = ["doc_id", *keep]
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
    df = docs.select(*[F.col(c).cast("long" if c == "doc_id" else "string") for c in names], F.col("text").alias("_text"))
    schema = pa.schema([(c, kinds["long" if c == "doc_id" else "string"]) for c in names] + [(c, kinds[t]) for c, t in _MEASURES])
    ddl = ", ".join([f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names] + [f"{c} {t}" for c, t in _MEASURES])

    def run(rows: dict[str, list]) -> dict[str, list]:
        got = [measures_of(t) for t in rows["_text"]]
        return {c: rows[c] for c in names} | {c: [g[i] for g in got] for i, (c, _) in enumerate(_MEASURES)}

    return map_rows(df, run, schema, ddl)


def base_failed() -> Column:
    """The plain rule that holds before any cutoff."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """Probability of at most k of n, each with probability p."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in range(k + 1)]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def path_of(counts: dict[str, list[tuple[int, int, int]]]) -> list[tuple[str, int]]:
    """Steps (rule, index of the cutoff), from each rule's rows (bin, good, bad); a bin's documents exceed the cutoffs from CUTOFFS[bin] on."""
    gains = {rule: {i: (sum(x for b, _, x in rows if b == i), sum(g for b, g, _ in rows if b == i)) for i in range(len(CUTOFFS))} for rule, rows in counts.items()}
    at, path = dict.fromkeys(sorted(gains), -1), []
    while True:
        # A rule's next step goes as far as its best ratio of bad to good.
        best = None
        for rule, last in at.items():
            bad = good = 0
            for i in range(last + 1, len(CUTOFFS)):
                bad, good = bad + gains[rule][i][0], good + gains[rule][i][1]
                if bad and (best is None or (bad + 1) / (good + 1) > best[0]):
                    best = ((bad + 1) / (good + 1), rule, i)
        if best is None:
            return path
        at[best[1]] = best[2]
        path.append(best[1:])


def choose(tested: list[tuple[int, int]], total: int, risk: float, level: float) -> int:
    """How many steps of a path to take; tested: good and bad documents that each step is the first to reject, total: good ones in all."""
    good = bad = 0
    best, steps = 0, 0
    for i, (g, x) in enumerate(tested, 1):
        good, bad = good + g, bad + x
        if not total or tail(good, total, risk) > level:
            break
        if bad - GOOD_WEIGHT * good > best:
            best, steps = bad - GOOD_WEIGHT * good, i
    return steps


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str, risk: float, delta: float) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule) from all labelled documents that pass the plain rule.

    Rows that repeat a document's id and measures are one document: the bounds
    are of independent ones.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_good")).withColumnRenamed("doc_id", "_id")
    held = measured.where(~base_failed()).join(marks, F.col("doc_id") == F.col("_id"))
    grid = ", ".join(f"{c}D" for c in CUTOFFS)
    bins = {name: F.expr(f"size(filter(array({grid}), c -> {value} <= c))") for name, value in RULES.items()}
    held = held.select("doc_id", F.coalesce(stratum, F.lit("")).alias("s"), "_good", crc_mod(F.col("doc_id"), 2).alias("half"), *[b.alias(f"b_{n}") for n, b in bins.items()])
    held = written(held.distinct().drop("doc_id"), "held")
    both = [F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"b_{n}").alias("bin")) for n in RULES]))
    counts: dict[str, dict[str, list[tuple[int, int, int]]]] = {}
    for r in held.where("half = 0").select("s", "_good", each.alias("r")).groupBy("s", "r.rule", "r.bin").agg(*both).collect():  # strata x rules x cutoffs rows
        counts.setdefault(r.s, {}).setdefault(r.rule, []).append((r.bin, r.good, r.bad))
    paths = {s: path_of(c) for s, c in counts.items()}
    # The first step that rejects a document: the first of each rule's steps that goes to its bin.
    first = F.lit(None).cast("int")
    for s, path in paths.items():
        of = [F.when(F.col(f"b_{rule}") <= i, F.lit(at)) for at, (rule, i) in enumerate(path)]
        first = F.when(F.col("s") == s, F.array_min(F.array_compact(F.array(*of)))).otherwise(first) if of else first
    tested: dict[str, dict[int | None, tuple[int, int]]] = {}
    for r in held.where("half = 1").groupBy("s", first.alias("first")).agg(*both).collect():  # strata x steps rows
        tested.setdefault(r.s, {})[r.first] = (r.good, r.bad)
    out = {}
    for s, path in paths.items():
        got = tested.get(s, {})
        steps = choose([got.get(i, (0, 0)) for i in range(len(path))], sum(g for g, _ in got.values()), risk, delta / len(paths))
        out |= {(s, rule): CUTOFFS[i] for rule, i in path[:steps]}
    return out


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.005, delta: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """Measures of every document, base_failed, reasons (rules whose cutoff it exceeds) and kept.

    A null or empty text has no words and fails the plain rule; a null stratum
    is a stratum of its own; repeated rows are judged each alike; labels that
    contradict one another count as good; without labels no cutoff stands and
    the plain rule alone decides.  Other columns don't matter.
    """
    keep = keep or []
    measured = written(measure(docs, [stratum, *[c for c in keep if c != stratum]]), "measures")
    cuts = calibrate(measured, labels, stratum, risk, delta)
    reasons = [F.when((F.coalesce(stratum, F.lit("")) == s) & (F.expr(RULES[rule]) > cut), F.lit(rule)) for (s, rule), cut in sorted(cuts.items())]
    return (
        measured.withColumn("base_failed", base_failed())
        .withColumn("reasons", F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>"))
        .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    )
