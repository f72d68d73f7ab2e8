"""Engines, augmentations and estimators by name, and runs that load, count or estimate, and write results.

`python -m globmill count <engine> <data> <workload>` and `python -m globmill estimate <model> <data> <workload>` are the
same from the command line.
"""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .learned.models import MODELS
from .operators import counting as C
from .operators import engines as N
from .operators import estimators as E
from .operators import reports as R
from .operators import statistics as S
from .plans import planner
from .sources import files

#: Counting engines: (strings, patterns) -> pattern, card. `ordered` may be followed by digits: the gaps between tokens in the order of their joins.
ENGINES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "naive": C.naive, "candidates": C.candidates, "typed": C.typed, "positional": C.positional, "narrow": N.narrow, "planned": planner.count,
    "ordered": N.ordered, "forward": lambda s, p: N.ordered(s, p, "forward"), "backward": lambda s, p: N.ordered(s, p, "backward"),
}

#: What is counted of a workload: its patterns, or all prefixes, suffixes or both of their canonical forms.
AUGMENT = ("base", "prefix", "suffix", "both")

#: Augmentations of one pattern, as arrays of patterns.
FORMS = {
    "query": lambda q: F.array(q), "prefix": P.prefixes, "delimiter": P.delimiter, "placeholder": P.placeholder, "packed": P.packed, "all": P.augmented,
}


def engine(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    if name.startswith("ordered") and name[7:].isdigit():
        return lambda s, p: N.ordered(s, p, name[7:])
    if name not in ENGINES:
        raise KeyError(f"no engine {name!r}; there are {', '.join(ENGINES)} and ordered<digits>")
    return ENGINES[name]


def counted(name: str, strings: DataFrame, patterns: DataFrame, augment: str = "base") -> DataFrame:
    """pattern, card of a workload or of what is augmented from it."""
    run = engine(name)
    if augment == "base":
        return run(strings, patterns)
    if augment == "both":
        return C.both_cards(strings, patterns, run)
    way = {"prefix": C.prefix_cards, "suffix": C.suffix_cards}[augment]
    return way(strings, patterns, run)


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; overridden() takes those of a data set over the defaults."""

    grams: int = 5
    threshold: int = 1
    ratio: float = 0.4
    sample: int = 200
    most: float = 2.0
    signature: int = 10
    seed: str = "0"
    extra: dict = field(default_factory=dict)

    def overridden(self, table: dict[str, dict], name: str) -> "Settings":
        known = {f.name for f in fields(self)}
        own = table.get(name, {})
        return replace(self, **{k: v for k, v in own.items() if k in known}, extra=self.extra | {k: v for k, v in own.items() if k not in known})


class Estimator(Protocol):
    """What an estimator has to have. fit() may use labelled patterns; estimate() keeps every pattern."""

    def fit(self, strings: DataFrame, labelled: DataFrame | None = None) -> "Estimator": ...

    def estimate(self, patterns: DataFrame) -> DataFrame:
        """pattern, est (double)."""
        ...

    def size(self) -> int:
        """Bytes of what is kept."""
        ...


class Sampled:
    """Estimates from the first rows by md5: scaled up (`plain`), with half a match for none (`half`), or the middle of the likely interval (`middle`)."""

    def __init__(self, settings: Settings, way: str = "half"):
        self.settings, self.way = settings, way

    def fit(self, strings: DataFrame, labelled: DataFrame | None = None) -> "Sampled":
        rows = strings.select("s", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("_i")).withColumn("_k", F.concat_ws("\0", "s", F.col("_i").cast("string")))
        self.n = strings.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        self.rows = [r["s"] for r in S.sample(rows, "_k", self.settings.sample, self.settings.seed).select("s").collect()]  # bounded by the parameter
        return self

    def estimate(self, patterns: DataFrame) -> DataFrame:
        m = max(1, len(self.rows))
        sampled = patterns.sparkSession.createDataFrame([(s,) for s in self.rows], "s string")
        if self.way == "plain":
            return S.est_plain(sampled, patterns, self.n, m).select("pattern", "est")
        x = S.est_s(sampled, patterns, self.n, m)
        return (E.est_m(x, self.n, m) if self.way == "middle" else x).select("pattern", F.col("est").cast("double").alias("est"))

    def size(self) -> int:
        return sum(len(s.encode()) for s in self.rows)


class Bounded:
    """Exact counts from an n-gram table where it has them, else its upper bound."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def fit(self, strings: DataFrame, labelled: DataFrame | None = None) -> "Bounded":
        k = self.settings
        self.table = S.ngram_table(strings, k.grams).where(F.col("cnt") >= k.threshold)
        return self

    def estimate(self, patterns: DataFrame) -> DataFrame:
        k = self.settings
        x = S.upper_bound(self.table, patterns, k.grams, k.threshold).join(R.exact_hits(self.table, patterns, k.grams), "pattern", "left")
        return x.select("pattern", F.coalesce("cnt", "bound").cast("double").alias("est"))

    def size(self) -> int:
        return int(self.table.agg(F.coalesce(F.sum(F.octet_length("gram") + 8), F.lit(0))).first()[0])


#: Estimators by name: Settings -> Estimator. register() adds to them.
ESTIMATORS: dict[str, Callable[[Settings], Estimator]] = {
    "sample_plain": lambda k: Sampled(k, "plain"), "sample_half": lambda k: Sampled(k, "half"), "sample_middle": lambda k: Sampled(k, "middle"), "bound": Bounded, **MODELS,
}


def register(name: str, make: Callable[[Settings], Estimator]) -> None:
    ESTIMATORS[name] = make


def estimator(name: str, settings: Settings | None = None) -> Estimator:
    if name not in ESTIMATORS:
        raise KeyError(f"no estimator {name!r}; there are {', '.join(ESTIMATORS)}")
    return ESTIMATORS[name](settings or Settings())


def latencies(model: Estimator, patterns: DataFrame, most: int = 20) -> DataFrame:
    """pattern, seconds: one pattern at a time, the first `most` by md5 (a report, so it is small)."""
    spark = patterns.sparkSession
    own, out = [r["pattern"] for r in S.shuffled_rank(patterns.select("pattern").distinct(), "pattern").where(F.col("rank") < most).collect()], []
    for q in own:
        began = time.perf_counter()
        model.estimate(spark.createDataFrame([(q,)], "pattern string")).collect()
        out.append((q, time.perf_counter() - began))
    return spark.createDataFrame(out, "pattern string, seconds double")


def result_path(root: str, data: str, workload: str, model: str, trial: int = 0, kind: str = "estimation") -> str:
    """Where a run's results go: root/data/workload/model/trial/kind."""
    return "/".join([root.rstrip("/"), data, workload, model, str(trial), kind])


def run_count(spark: SparkSession, name: str, strings: str, patterns: str, out: str, augment: str = "base") -> float:
    """Count a file's strings by a file's patterns, write the counts and the time, and return the seconds."""
    began = time.perf_counter()
    s = C.weighted(files.lines(spark, strings), "s")
    p = files.lines(spark, patterns).withColumnRenamed("s", "pattern")
    files.write_counts(counted(name, s, p, augment), f"{out}/counts", augment)
    took = time.perf_counter() - began
    n = p.count()
    files.write_times(spark, f"{out}/time", name, n, took)
    return took


def run_estimate(spark: SparkSession, name: str, strings: str, labelled: dict[str, str], out: str, settings: Settings | None = None, split: str = "test") -> dict:
    """Load, fit, estimate, compare and write: estimates, times, and statistics as YAML. labelled: split -> file."""
    s = C.weighted(files.lines(spark, strings), "s")
    work = files.workload(spark, labelled)
    began = time.perf_counter()
    model = estimator(name, settings).fit(s, work.where(F.col("split") == "train").select("pattern", "card"))
    built = time.perf_counter() - began
    test = work.where(F.col("split") == split).select("pattern", "card")
    began = time.perf_counter()
    x = test.join(model.estimate(test), "pattern").select(F.col("pattern").alias("query"), F.col("card").alias("true"), "est")
    files.write_estimates(x, f"{out}/estimation")
    per = (time.perf_counter() - began) / max(1, x.count())
    files.write_estimates(x, f"{out}/time", per)
    q = {f"q{r['p']:03d}": r["q"] for r in S.q_error_percentiles(x).collect()}
    stat = {"time": built, "time_est": per, "model_size": model.size(), "avg": S.q_error_stats(x).first()["avg_q"]} | q
    files.write_stat(spark, stat, f"{out}/stat")
    return stat


def sweep(run: Callable[[Settings], dict], settings: Settings, **values) -> list[tuple[Settings, dict]]:
    """A run for each combination of parameter values, such as grams=(3, 4, 5), seed=("0", "1")."""
    out = [settings]
    for name, each in values.items():
        out = [replace(k, **{name: v}) for k in out for v in each]
    return [(k, run(k)) for k in out]


def main(argv: list[str] | None = None) -> None:
    """The command line."""
    a = argparse.ArgumentParser(prog="globmill")
    sub = a.add_subparsers(dest="what", required=True)
    one = sub.add_parser("count", help="exact counts of a file of strings by a file of patterns")
    one.add_argument("engine")
    one.add_argument("strings")
    one.add_argument("patterns")
    one.add_argument("--augment", choices=AUGMENT, default="base")
    two = sub.add_parser("estimate", help="estimates beside labels, with Q-errors")
    two.add_argument("model", choices=sorted(ESTIMATORS))
    two.add_argument("strings")
    two.add_argument("train")
    two.add_argument("test")
    for f in fields(Settings):
        if f.name != "extra":
            two.add_argument(f"--{f.name}", type=type(f.default), default=f.default)
    three = sub.add_parser("workload", help="labelled patterns of all words of a file of strings")
    three.add_argument("strings")
    three.add_argument("--longest", type=int, default=4)
    for p in (one, two, three):
        p.add_argument("--out", default=os.path.join(os.getcwd(), "results"))
    k = a.parse_args(argv)
    spark = SparkSession.builder.appName("globmill").getOrCreate()
    if k.what == "count":
        print(f"{run_count(spark, k.engine, k.strings, k.patterns, k.out, k.augment):.3f} s")
    elif k.what == "estimate":
        given = Settings(**{f.name: getattr(k, f.name) for f in fields(Settings) if f.name != "extra"})
        print(run_estimate(spark, k.model, k.strings, {"train": k.train, "test": k.test}, k.out, given))
    else:
        from .operators import workloads as W

        s = C.weighted(files.lines(spark, k.strings), "s")
        files.write_labelled(W.split_union(s, k.longest).select("pattern", "card").distinct(), k.out)
