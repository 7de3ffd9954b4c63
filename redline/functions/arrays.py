"""Array functions that take little more than linear time. A fold that grows an array by ``concat`` copies it once for
every element; these only sort and double distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline.functions.text import let

#: 1, 2, 4 … as one constant: the distances that double.
_POWERS = "array(" + ", ".join(str(1 << k) for k in range(30)) + ")"


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element combined with all before it. ``combine`` is associative. Works by doubling distances: log2(n) passes."""

    def passes(v: Column) -> Column:
        return F.aggregate(
            F.filter(F.expr(_POWERS), lambda p: p < F.size(v)), v,
            lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, combine(F.get(acc, i - p), x)).otherwise(x)),
        )

    return let(values, passes)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def first_fitting(spans: Column) -> Column:
    """Places of the spans that stay when each, in order, stays if it starts at or after the end of the last that stayed.
    Spans are structs with start and end, sorted by start. The span to follow each one comes from one sort of all ends and
    starts; the chain of followers from the first span is then laid out by doubling, so nothing grows span by span."""

    def followers(v: Column) -> Column:
        ends = F.transform(v, lambda s, i: F.struct(s["end"].alias("at"), F.lit(0).alias("kind"), i.alias("place")))
        starts = F.transform(v, lambda s, i: F.struct(s["start"].alias("at"), F.lit(1).alias("kind"), i.alias("place")))
        events = F.sort_array(F.concat(ends, starts))

        def counted(e: Column) -> Column:
            seen = F.arrays_zip(e.alias("e"), running_sum(F.transform(e, lambda x: x["kind"])).alias("n"))
            own = F.transform(F.filter(seen, lambda x: x["e"]["kind"] == 0), lambda x: F.struct(x["e"]["place"].alias("place"), x["n"].alias("n")))
            return F.transform(F.sort_array(own), lambda x: F.greatest(x["n"], x["place"] + 1))

        return let(events, counted)

    def chain(v: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("chain"), followers(v).alias("jump"))

        def doubled(acc: Column, p: Column) -> Column:
            ahead = F.filter(F.transform(acc["chain"], lambda i: F.get(acc["jump"], i)), lambda j: j < F.size(v))
            far = F.transform(acc["jump"], lambda j: F.coalesce(F.get(acc["jump"], j), j))
            return F.struct(F.concat(acc["chain"], ahead).alias("chain"), far.alias("jump"))

        steps = F.filter(F.expr(_POWERS), lambda p: p < F.size(v))
        return F.sort_array(F.aggregate(steps, start, doubled, lambda acc: acc["chain"]))

    def fitting(v: Column) -> Column:
        clash = F.exists(F.transform(v, lambda s, i: (i > 0) & (s["start"] < F.coalesce(F.get(v, i - 1)["end"], F.lit(0)))), lambda x: x)
        every = F.transform(v, lambda s, i: i)
        return F.when(clash, chain(v)).otherwise(every)

    return let(spans, fitting)


def touching(spans: Column, others: Column) -> Column:
    """For each span the place of the last of the others that shares a character with it, or -1. Both are arrays of structs
    with start and end, sorted and disjoint. One sort of all ends and starts; of the others that start before a span
    ends, counted along, only the last can reach into it."""

    def among(both: Column) -> Column:
        spans, others = both["spans"], both["others"]
        asked = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("kind"), s["start"].alias("start")))
        given = F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("start")))

        def placed(e: Column) -> Column:
            seen = F.arrays_zip(e.alias("e"), running_sum(F.transform(e, lambda x: x["kind"])).alias("n"))
            own = F.filter(seen, lambda x: x["e"]["kind"] == 0)  # at one place a span ends before another starts
            return F.transform(own, lambda x: F.when((x["n"] > 0) & (F.get(others, x["n"] - 1)["end"] > x["e"]["start"]), x["n"] - 1).otherwise(-1))

        return F.when(F.size(others) == 0, F.transform(spans, lambda s: F.lit(-1))).otherwise(let(F.sort_array(F.concat(asked, given)), placed))

    return let(F.struct(spans.alias("spans"), others.alias("others")), among)
