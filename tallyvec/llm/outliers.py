"""Quality rules: robust multivariate outliers among text statistics.

Each language and source gets a minimum-covariance-determinant estimate of its transformed
statistics. Concentration steps fit mean and covariance to the half of the documents that lies nearest
to the last fit; they run from several starts (medians and absolute deviations of all or some
statistics, lower quartiles) until no determinant falls any more. The fit with the lowest determinant is
kept and made again from all documents that are no outliers to it. Documents far from
the fit of their group by Mahalanobis distance are rejected. All steps are aggregations by
group and start, combined before the shuffle; a group is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvec.llm.ballots import Chunk
from tallyvec.llm.substring_dedup import Words
from tallyvec.llm.suffix_dedup import roller
from tallyvec.sources.stage import write_stage

SYMBOLS = b"#*$%&|<>"
WINDOW = 5  # words in a repeated window
LEAST = 25  # documents that an estimate needs; smaller groups are judged by that of their language, or of all
STEPS = 30  # concentration steps at most; a dozen are usual
SETTLED = 1e-3  # fall of the logarithm of a determinant that is none
CORE = 0.5  # share of a group that a step fits to
# Fixed values for five dimensions: a normal cloud's covariance over that of its core of half
# the points; the squared distance within which 97.5 % of it lie, and the same ratio there.
CORE_SCALE, NEAR, NEAR_SCALE = 1.916, 12.83, 1.055
CUT = 14.0  # squared distance from which a document is an outlier
DIMS = 5
# Smallest spread of each transformed statistic, as a standard deviation: below it a
# difference is not worth a rejection, and a constant statistic stays invertible.
FLOOR = (0.06, 0.08, 0.06, 0.08, 0.06)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]


def _slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    lengths = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column).cast(pa.binary())])
    start = 0
    while start < batch.num_rows:
        before = lengths[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(lengths, before + size)))
        yield batch.slice(start, end - start)
        start = end


def _repeated_words(table: pa.Table) -> np.ndarray:
    """Words inside windows found twice or more, by row of a table with row numbers as ids."""
    chunk = Chunk(table)
    words = Words(chunk)
    starts = words.windows(WINDOW)
    owner = np.searchsorted(words.first, starts, side="right") - 1
    names = roller(7).at(words.names, WINDOW, starts)
    order = np.lexsort((names, owner))
    same = (names[order][1:] == names[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.zeros(len(starts), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words.names) + 1, np.int64)
    np.add.at(edge, starts[again], 1)
    np.add.at(edge, starts[again] + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    out = np.empty(table.num_rows, np.int64)
    out[chunk.doc_ids.to_numpy()] = inside[words.first[1:]] - inside[words.first[:-1]]
    return out


def _counts(text: str) -> tuple[int, ...]:
    raw = text.encode()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    seen: set[str] = set()
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\v\f\r")]
    for line in lines:
        seen.add(line)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(raw.split()), len(text) - spaces, symbols, len(lines) - len(seen), upper, len(lines)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` with the counts of ``COUNTS``; null texts count as empty."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 3):
                texts = [x or "" for x in batch.column(3).to_pylist()]
                rows = np.array([_counts(t) for t in texts], np.int64).reshape(-1, 6)
                table = pa.table({"doc_id": np.arange(len(texts)), "text": pa.array(texts, pa.string())})
                columns = [*rows.T[:4], _repeated_words(table), *rows.T[4:]]
                arrays = [batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2)]
                arrays += [pa.array(np.ascontiguousarray(c)) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "source", *COUNTS])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(work, schema)


def transformed() -> list[Column]:
    """Statistics on scales where groups are near to normal; little text is drawn to a prior."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log((chars + 100) / (words + 20)),
        F.sqrt(F.col("n_symbols") / (chars + 20)),
        F.sqrt(F.col("n_upper") / (chars + 40)),
        F.col("n_dup_lines") / (F.col("n_lines") + 4),
        F.col("n_repeat_words") / (words + 20),
    ]


def _distance() -> Column:
    off = [F.col(f"x{i}") - F.col("center")[i] for i in range(DIMS)]
    terms = [off[i] * off[j] * F.col("inverse")[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _params(moments: DataFrame, scale: float) -> DataFrame:
    """Centre, inverse covariance and the logarithm of its determinant, from one row of sums per group and start."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            centers, inverses, sizes = [], [], []
            for r in rows.itertuples(index=False):
                mean = np.array([getattr(r, f"s{i}") for i in range(DIMS)]) / r.n
                cov = np.empty((DIMS, DIMS))
                for i in range(DIMS):
                    for j in range(i, DIMS):
                        cov[i, j] = cov[j, i] = getattr(r, f"s{i}{j}") / r.n - mean[i] * mean[j]
                cov = cov * scale + np.diag(np.square(FLOOR))
                centers.append(mean.tolist())
                inverses.append(np.linalg.inv(cov).reshape(-1).tolist())
                sizes.append(float(np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame({"t": rows["t"], "start": rows["start"], "center": centers, "inverse": inverses, "size": sizes})

    schema = "t string, start int, center array<double>, inverse array<double>, size double"
    return moments.mapInPandas(solve, schema)


NAMES = [f"x{i}" for i in range(DIMS)]


def _moments(core: DataFrame) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)]
    sums += [
        F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}{j}") for i in range(DIMS) for j in range(i, DIMS)
    ]
    return core.groupBy("t", "start").agg(F.count("*").alias("n"), *sums)


def _middle(column: Column, share: float) -> Column:
    return F.percentile_approx(column, F.lit(share), F.lit(2000))


def _starts(members: DataFrame) -> DataFrame:
    """``(t, start, center, inverse)``: medians and absolute deviations, of all or of some statistics, and lower quartiles."""
    middles = members.groupBy("t").agg(
        F.array(*[_middle(F.col(x), 0.5) for x in NAMES]).alias("center"),
        F.array(*[_middle(F.col(x), 0.25) for x in NAMES]).alias("lower"),
    )
    middles = write_stage(middles, "outlier-medians")
    apart = [_middle(F.abs(F.col(x) - F.col("center")[i]), 0.5).alias(f"m{i}") for i, x in enumerate(NAMES)]
    spread = members.join(middles, "t").groupBy("t").agg(*apart, F.first("center").alias("center"), F.first("lower").alias("lower"))
    starts = []
    for number, (center, used) in enumerate(
        [("center", range(DIMS)), ("center", [0]), ("center", [1, 2]), ("center", [3, 4]), ("lower", range(DIMS))]
    ):
        diagonal = [
            1 / (F.pow(1.4826 * F.col(f"m{i}"), 2) + FLOOR[i] ** 2) if i == j and i in used else F.lit(0.0)
            for i in range(DIMS) for j in range(DIMS)
        ]
        starts.append(F.struct(F.lit(number).alias("start"), F.col(center).alias("center"), F.array(*diagonal).alias("inverse")))
    return spread.select("t", F.inline(F.array(*starts)))


def estimates(members: DataFrame) -> DataFrame:
    """``(t, center, inverse)``: the estimate of each group of ``members(t, x0 ...)``."""
    params = write_stage(_starts(members), "outlier-fit")
    before: DataFrame | None = None
    for _ in range(STEPS):
        near = members.join(params.select("t", "start", "center", "inverse"), "t").withColumn("d", _distance())
        cuts = write_stage(near.groupBy("t", "start").agg(_middle(F.col("d"), CORE).alias("cut")), "outlier-cuts")
        core = near.join(cuts, ["t", "start"]).where("d <= cut")
        params = write_stage(_params(_moments(core), CORE_SCALE), "outlier-fit")
        if before is not None:
            was = before.select("t", "start", F.col("size").alias("was"))
            falls = params.join(was, ["t", "start"]).agg(F.max(F.col("was") - F.col("size"))).first()[0]
            if falls is None or falls < SETTLED:
                break
        before = params
    best = params.groupBy("t").agg(F.min(F.struct("size", "start", "center", "inverse")).alias("b"))
    best = write_stage(best.select("t", F.col("b.start").alias("start"), "b.center", "b.inverse"), "outlier-best")
    near = members.join(best, "t").withColumn("d", _distance()).where(F.col("d") <= NEAR)
    return write_stage(_params(_moments(near), NEAR_SCALE).select("t", "center", "inverse"), "outlier-estimates")


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of each document with ``base_failed``, ``distance`` and ``kept``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated
    windows. A document is kept if it has not failed and its squared distance from its
    group is at most ``CUT``. Languages and sources may be null, which makes groups of their own; a
    source of fewer than ``LEAST`` documents is judged by the estimate of its whole language, and such a language
    by that of all documents. Needs ``doc_id, lang, source, text``; repeated rows are judged alike; no rows give none.
    """
    counted = statistics(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = counted.withColumn("base_failed", failed).select(
        "*", *[x.cast("double").alias(n) for x, n in zip(transformed(), NAMES)]
    )
    scored = write_stage(scored, "outlier-statistics")
    fits = scored.where(~F.col("base_failed"))

    def name(*columns: str) -> Column:
        """Null and the empty string differ, and no two groups share a name."""
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

    sizes = write_stage(fits.groupBy("lang", "source").agg(F.count("*").alias("n")), "outlier-groups")
    in_lang = Window.partitionBy("lang")
    team = (
        F.when(F.col("n") >= LEAST, name("lang", "source"))
        .when(F.sum("n").over(in_lang) >= LEAST, name("lang"))
        .otherwise(F.lit("all"))
    )
    teams = write_stage(sizes.select(F.col("lang").alias("l"), F.col("source").alias("s"), team.alias("team")), "outlier-teams")
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    used = write_stage(teams.select(F.col("team").alias("t")).distinct(), "outlier-used")
    named = fits.select(F.explode(F.array(name("lang", "source"), name("lang"), F.lit("all"))).alias("t"), *NAMES)
    members = write_stage(named.join(used, "t", "left_semi"), "outlier-members")
    found = estimates(members)
    judged = scored.join(teams, same, "left").join(found, F.col("team") == F.col("t"), "left")
    judged = judged.withColumn("distance", _distance())
    # Without any document that has not failed there is no estimate, and nothing to be kept.
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return judged.select("doc_id", "lang", "source", *COUNTS, "base_failed", "distance", kept.alias("kept"), *NAMES)
