"""Quality rules: signals of each text, failures by host, shrunk rates, and host verdicts joined back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from schedlake.llm.shared import bind, split_words, written

WINDOW = 8
#: A host is rejected where the shrunk share of its failing documents reaches this. A host then has next to nothing
#: but failing documents: clean documents of an ordinary or mixed host stay.
HOST_FAILURE_RATE = 0.9
SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice in the same list; windows are compared by a 64-bit hash.

    Texts without a repeated window are told apart by a hash set; only the others sort their windows. Linear, but for
    that sort.
    """
    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(window))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return bind(placed, lambda p: F.aggregate(
            F.sort_array(F.filter(F.transform(p, lambda x, i: F.when(
                (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["i"])), F.isnotnull)),
            F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("total")),
            lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(window), i - a["last"])).alias("total")),
            lambda a: a["total"]))

    def among(w: Column) -> Column:
        return bind(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                    .otherwise(covered(h)))

    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(among(words))


def signals(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` plus the five signals of each row; a null text has none of anything."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        *(keep or []),
        bind(F.struct(split_words(whole).alias("w"), lines.alias("l")), lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            repeated_words(x["w"]).alias("n_repeat_words"))).alias("s"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    ).select(*[c for c in ["id", "host"] if keep], *["s.n_words", "s.word_chars", "n_symbols", "s.n_dup_lines",
                                                     "s.n_repeat_words"])


#: The rules as conditions on the signals; the first two reject a document, the others count only for its host.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 25 * word_chars",
    "odd_words": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}


def with_failures(signals: DataFrame) -> DataFrame:
    return signals.select("*", *[F.expr(rule).alias(name) for name, rule in RULES.items()])


def host_rates(judged: DataFrame, names: list[str]) -> DataFrame:
    """``host, n, failed_<rule>, rate_<rule>``: failure rates shrunk towards a beta prior that is fitted per rule.

    The prior's mean is the share of failing documents, its strength comes from the variance of the rates between
    hosts, weighted by their documents and less the part that binomial noise explains (method of moments). One row
    per host leaves the partial sums, so a host with a third of all rows costs no more than another.
    """
    by_host = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col(name).cast("long")).alias(f"failed_{name}") for name in names])
    by_host = written(by_host, "host-failures")
    moments = by_host.agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"failed_{name}").alias(f"f_{name}") for name in names],
        *[F.sum(F.col(f"failed_{name}") * F.col(f"failed_{name}") / F.col("n")).alias(f"q_{name}") for name in names],
    ).first()
    rates = []
    for name in names:
        alpha, beta = beta_prior(moments["total"] or 0, moments["hosts"] or 0, moments[f"f_{name}"] or 0,
                                 moments[f"q_{name}"] or 0.0)
        rates.append(((F.col(f"failed_{name}") + alpha) / (F.col("n") + (alpha + beta))).alias(f"rate_{name}"))
    return by_host.select("*", *rates)


def beta_prior(total: int, hosts: int, failed: int, squares: float) -> tuple[float, float]:
    """Alpha and beta from counts; ``squares`` is the sum over hosts of failed² / documents.

    With no spread beyond binomial noise, or fewer than two hosts, the prior weighs as much as 1000 documents.
    """
    if not total:
        return 1.0, 1.0
    mean = min(max(failed / total, 0.5 / (total + 1)), 1 - 0.5 / (total + 1))
    spread = squares - total * (failed / total) ** 2 - (hosts - 1) * mean * (1 - mean)
    between = spread / max(total - hosts, 1)
    strength = 1000.0 if hosts < 2 or between <= 0 else min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
            host_failure_rate: float = HOST_FAILURE_RATE) -> DataFrame:
    """``doc_id``, the signals, ``base_failed``, ``host_failed``, ``kept``; one row per row of docs.

    A row is kept unless it fails itself or its host fails: a host fails where the shrunk rate of one rule reaches
    ``host_failure_rate``. A null host is a host of its own; null and empty texts have no words and fail. Only three
    columns are read, so others may have any name. An empty table gives no rows.
    """
    base = written(signals(docs, text, [F.col(doc_id).alias("id"), F.col(host).alias("host")]), "quality-signals")
    judged = with_failures(base)
    rates = host_rates(judged, list(RULES))
    bad = written(rates.where(F.greatest(*[F.col(f"rate_{name}") for name in RULES]) >= host_failure_rate)
                  .select("host"), "rejected-hosts").withColumn("host_failed", F.lit(True))
    out = judged.join(bad, judged["host"].eqNullSafe(bad["host"]), "left").drop(bad["host"])
    base_failed = F.col("short") | F.col("repeats")
    host_failed = F.coalesce("host_failed", F.lit(False))
    return out.select(F.col("id").alias(doc_id), *SIGNALS, base_failed.alias("base_failed"),
                      host_failed.alias("host_failed"), (~base_failed & ~host_failed).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source",
              host_failure_rate: float = HOST_FAILURE_RATE) -> DataFrame:
    """The rows of docs that pass, with all their columns; nulls and ties as in ``quality``."""
    row = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(host).alias("host"))
    judged = with_failures(signals(row, "text", [F.col("row").alias("id"), F.col("host")]))
    judged = written(judged.select("id", "host", *RULES), "quality-rows")
    rates = host_rates(judged.drop("id"), list(RULES))
    bad = written(rates.where(F.greatest(*[F.col(f"rate_{name}") for name in RULES]) >= host_failure_rate)
                  .select("host"), "rejected-hosts")
    good = judged.where(~F.col("short") & ~F.col("repeats"))
    return good.join(bad, good["host"].eqNullSafe(bad["host"]), "left_anti").select("id.*")
