"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they occur. Weak ones (identifiers, long mixed
tokens, endpoints) mean little alone; they are linked by an interval join of the parts of
one document, within a scope of so many characters, and reported only if the parts that
complete them are there: an identifier needs a secret, a token needs an identifier, an
endpoint needs both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvec.sources.stage import write_stage

SCOPE = 200  # characters between the end of a part and the start of one linked to it, at most

# The strong patterns, in the order in which ties are listed.
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?(" + VALUE + ")"
BASE = {
    "assign": (ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
    "access": ("AKIA[A-Z0-9]+", lambda m: F.char_length(m) >= 18),
    # Greedy runs; shorter ones would be dropped anyway, and none can hide a longer one.
    "hex": ("[0-9a-f]{16,}", lambda m: F.char_length(m) >= 16),
}
# Weak parts: reported only with what completes them.
RUN = "[A-Za-z0-9+/_=-]++"
WEAK = {
    "identifier": (
        "(?i:\\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))[\"']?\\x20*[:=]\\x20*[\"']?"
        "[A-Za-z0-9_.@-]{3,}", lambda m: F.lit(True),
    ),
    "token": (
        # Dots may join runs, as in a JWT; one at the end is a full stop.
        "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_.=-]{20})" + RUN + "(?:\\." + RUN + ")*+",
        lambda m: (F.char_length(m) >= 20) & m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"),
    ),
    "endpoint": ("(?i:https?|ftp|jdbc:[a-z]+|redis|mongodb|amqp)://[^\\x20\\x09-\\x0D\"'<>]+", lambda m: F.lit(True)),
}
KINDS = [*BASE, *WEAK]
SPAN = "array<struct<start: int, rank: int, end: int>>"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(kind: str, pattern: str, holds, text: Column) -> Column:
    """Spans of leftmost matches that pass: lengths between and of matches, added up.

    Matches are taken in stretches, as many as each is long: a list that grows by a span is
    copied, so a single long one would cost the square of its length.
    """
    rank = KINDS.index(kind)
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(between, matches, lambda n, m: F.struct(n.alias("n"), m.alias("m")))

    def length(piece: Column) -> Column:
        return piece["n"] + F.coalesce(F.char_length(piece["m"]), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + piece["n"]
        end = state["at"] + length(piece)
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        good = piece["m"].isNotNull() & holds(piece["m"])
        out = F.when(good, F.concat(state["out"], span)).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def walk(pieces: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(pieces, start, step, lambda state: state["out"])

    def cut(pieces: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / width).cast("int"))
        return F.transform(numbers, lambda i: F.slice(pieces, i * width + 1, width))

    def joined(stretches: Column) -> Column:
        sums = F.transform(stretches, lambda s: F.aggregate(s, F.lit(0), lambda n, piece: n + length(piece)))
        return _bound(
            sums,
            lambda sizes: F.flatten(
                F.transform(
                    stretches,
                    lambda own, i: walk(own, F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n)),
                )
            ),
        )

    spans = _bound(_bound(both, cut), joined)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])
    )
    return F.array_join(one, ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document ``doc_id, n_assign, n_access, n_hex, base, spans`` (lists as text).

    ``base`` lists the strong spans and ``spans`` all of them as ``kind:start:end`` in
    characters, by start. Null texts are empty; repeated rows and null ids are documents
    of their own; other columns are ignored; no rows give none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = F.concat(*[_found(k, p, h, text) for k, (p, h) in BASE.items()])
    weak = F.concat(*[_found(k, p, h, text) for k, (p, h) in WEAK.items()])
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", strong.alias("strong"), weak.alias("weak")
    )
    # Written before it is joined: the row numbers are data from here on.
    found = write_stage(found, "secret-spans")
    mixed = found.where(F.size("weak") > 0).select("row", "strong", "weak")
    parts = mixed.select("row", F.explode(F.concat("strong", "weak")).alias("s")).select("row", "s.*")

    def cell(at: str) -> Column:
        return F.floor(F.col(at) / scope)

    def within(candidates: DataFrame, kinds: list[str]) -> DataFrame:
        """Candidates that have a part of ``kinds`` in their scope, some twice; overlapping spans are the same part.

        What counts is the gap from the end of one part to the start of the next, however long
        they are: a candidate's end meets the starts after it, its start the ends before it.
        """
        def meeting(after: bool, at: str, cells: list[Column]) -> Column:
            return F.transform(F.array(*cells), lambda c: F.struct(F.lit(after).alias("after"), F.col(at).alias("at"), c.alias("cell")))

        wanted = parts.where(F.col("rank").isin([KINDS.index(k) for k in kinds])).select(
            F.col("row").alias("r"),
            F.explode(F.concat(
                meeting(True, "start", [cell("start") - 1, cell("start")]),
                meeting(False, "end", [cell("end"), cell("end") + 1]),
            )).alias("w"),
        )
        ends = candidates.withColumn(
            "p", F.explode(F.concat(meeting(True, "end", [cell("end")]), meeting(False, "start", [cell("start")])))
        )
        gap = F.when(F.col("p.after"), F.col("w.at") - F.col("p.at")).otherwise(F.col("p.at") - F.col("w.at"))
        near = (
            (F.col("row") == F.col("r")) & (F.col("p.after") == F.col("w.after")) & (F.col("p.cell") == F.col("w.cell"))
            & gap.between(0, scope)
        )
        return ends.join(wanted, near, "left_semi").drop("p")

    def of(kind: str) -> DataFrame:
        return parts.where(F.col("rank") == KINDS.index(kind))

    secrets, names = ["assign", "hex", "token"], ["access", "identifier"]
    linked = (
        within(of("identifier"), secrets)
        .unionByName(within(of("token"), names))
        .unionByName(within(within(of("endpoint"), secrets), names))
    )
    gathered = linked.groupBy("row").agg(F.collect_set(F.struct("start", "rank", "end")).alias("linked"))
    whole = found.join(gathered, "row", "left")
    spans = F.concat("strong", F.coalesce("linked", F.array().cast(SPAN)))
    def count(rank: int, kind: str) -> Column:
        return F.size(F.filter("strong", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [count(rank, kind) for rank, kind in enumerate(BASE)]
    return whole.withColumn("all", spans).select(
        "doc_id", *counts, _listed("strong").alias("base"), _listed("all").alias("spans")
    )
