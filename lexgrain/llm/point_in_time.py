"""Point-in-time features by pushed difference arrays.

A probe is a time of a client; a row (a click, a sale, a line of a sale) counts for the probes from when it is known to when it
leaves the window. Rows are pushed to probes: each end of a row's range is a point of its client's time. Points and probes are
dealt out by ranges of (client, time), so a client of any size spreads over as many ranges as it needs, and each range holds
chunks of a client's probes. Within a chunk the probes are ranked, searchsorted finds the first probe a point affects, np.add.at
adds what the point brings there, and cumsum gives every probe its features. What covers a chunk from earlier ranges enters as
the chunk's constants: the totals that the ranges before it left open, one row a range.

Distinct items need disjoint ranges: those of one (client, item) are merged in the same way, by a running maximum over ranges of
(client, item, start) that carries one row a range. The latest click is a running maximum too: of the clicks known at a time the
latest one is in the window if any is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..plans.lineage import stored
from ..plans.order import partitions

DAY, MINUTE = 86_400_000_000, 60_000_000
#: Rows of a sorted range that are worked on together.
BLOCK = 1 << 16
#: Kinds of points; a point's code is 4 * kind + a mask of the windows it counts for.
CLICK, SALE, LINE, ITEM, LABEL = range(5)
PROBE = 100
#: Counters per window, then the label.
PER_WINDOW = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_items")
#: Where a kind's three amounts go.
COUNTER = {CLICK: (0, 1, 2), SALE: (3, None, 4), LINE: (5, None, 6), ITEM: (7, None, None)}
N = 2 * len(PER_WINDOW) + 1
LEAST = -(1 << 63)


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a time; one without a zone counts as UTC, whatever the session's zone."""
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        return (F.expr(f"cast(cast((`{name}` - timestamp_ntz'1970-01-01 00:00:00') as interval second) as decimal(20,6))") * 1_000_000).cast("long")
    return F.unix_micros(F.col(name).cast("timestamp"))


def cents(c: Column) -> Column:
    """floor(100 x + 0.5); 0 for null and for what is no finite number."""
    x = c.cast("double")
    return F.coalesce(F.when(F.abs(x) < 9e15, F.floor(F.lit(100.0) * x + 0.5)), F.lit(0)).cast("long")


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[list[np.ndarray]]:
    """The columns of consecutive rows, ``rows`` of them or more; nulls are LEAST."""
    held: list[pa.RecordBatch] = []
    n = 0

    def columns() -> list[np.ndarray]:
        whole = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        return [(c.fill_null(LEAST) if c.null_count else c).to_numpy() for c in whole]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield columns()
            held, n = [], 0
    if held:
        yield columns()


def open_ranges(ends: list[tuple], merge) -> list[tuple]:
    """(part, what earlier ranges leave open for its first key, else None) from (part, first key, last key, what its last key leaves).

    There is one row for every range, so that joins with it are planned alike, whether a key goes on over ranges or not.
    """
    out, key, left = [], None, None
    for part, first, last, own in sorted(ends, key=lambda e: e[0]):
        goes_on = key is not None and first == key
        out.append((part, left if goes_on else None))
        if goes_on and last == first:
            own = merge(left, own)
        key, left = last, own
    return out


# ---- distinct items ------------------------------------------------------------------------------------------------


def _merge_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (client, item, start, sold) -> the latest earlier ``sold`` of their (client, item); and the range's ends."""
    part = TaskContext.get().partitionId()
    first = last = None
    best = LEAST
    names = ["part", "mark", "client", "item", "start", "sold", "before", "open"]
    for client, item, start, sold in blocks(batches):
        new = np.append((client[0], item[0]) != last, (client[1:] != client[:-1]) | (item[1:] != item[:-1]))
        first = first or (int(client[0]), int(item[0]))
        group = np.cumsum(new)
        values = np.unique(np.append(sold, best))
        rank = np.searchsorted(values, sold)
        size = len(values)
        # running maximum up to the row before, within the group; 0: none
        run = np.maximum.accumulate(group * (size + 1) + rank + 1)
        before = np.append(0, run[:-1]) - group * (size + 1)
        if not new[0] and best != LEAST:
            own = np.searchsorted(values, best) + 1
            before = np.where(group == 0, np.maximum(before, own), before)
        before = np.where(before > 0, values[np.maximum(before, 1) - 1], LEAST)
        same = (client == first[0]) & (item == first[1])
        keep = np.flatnonzero(sold > before)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keep), part, np.int32)), pa.array(np.zeros(len(keep), np.int32)), *(pa.array(c[keep]) for c in (client, item, start, sold, before)), pa.array(same[keep])], names=names
        )
        tail = group == group[-1]
        top = int(sold[tail].max())
        best = max(best, top) if group[-1] == 0 and not new[0] else top
        last = (int(client[-1]), int(item[-1]))
    if first is not None:
        rows = [(part, 1, *first, 0, 0, 0, False), (part, 2, *last, 0, best, 0, False)]
        kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def item_ranges(lines: DataFrame, windows: tuple[int, int]) -> DataFrame:
    """(client, time, what, n) points of the disjoint ranges in which a client has an item, from (client, item, start, sold).

    A range ends a window after the sale, so of all earlier ranges of the item only the latest sale counts, in every window.
    """
    spark = lines.sparkSession
    order = ("client", "item", "start", "sold")
    dealt = lines.where("item IS NOT NULL").select(*order).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    merged = stored(dealt.mapInArrow(_merge_items, "part int, mark int, client long, item long, start long, sold long, before long, open boolean"), "items")
    ends: dict[int, dict[int, tuple]] = {}
    for r in merged.where("mark > 0").select("part", "mark", "client", "item", "sold").collect():  # two rows a range
        ends.setdefault(r.part, {})[r.mark] = ((r.client, r.item), r.sold)
    left = open_ranges([(p, e[1][0], e[2][0], e[2][1]) for p, e in ends.items()], max)
    carried = spark.createDataFrame([(p, x) for p, x in left], "part int, carried long")
    rows = merged.where("mark = 0").join(F.broadcast(carried), "part", "left")
    rows = rows.withColumn("before", F.when(F.col("open") & F.col("carried").isNotNull(), F.greatest("before", "carried")).otherwise(F.col("before")))
    rows = rows.withColumn("before", F.when(F.col("before") > LEAST, F.col("before")))
    points = []
    for w, days in enumerate(windows):
        start, end = F.greatest(F.col("start"), F.col("before") + days * DAY), F.col("sold") + days * DAY
        there = start < end
        points += [F.when(there, _point(start, ITEM, 1 << w)), F.when(there, _point(end, ITEM, 1 << w, sign=-1))]
    return _points(rows, points)


# ---- points --------------------------------------------------------------------------------------------------------


def _point(time: Column, kind: int, mask: Column | int, n: Column | int = 1, m: Column | int = 0, c: Column | int = 0, at: Column | None = None, ident: Column | None = None, sign: int = 1) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("long")
    parts = {"time": time, "what": F.lit(4 * kind) + lit(mask), "n": lit(n) * sign, "m": lit(m) * sign, "c": lit(c) * sign, "at": none if at is None else at, "ident": none if ident is None else ident}
    return F.struct(*[v.cast("int" if k == "what" else "long").alias(k) for k, v in parts.items()])


def _points(rows: DataFrame, points: list[Column]) -> DataFrame:
    each = F.filter(F.array(*points), lambda p: p.isNotNull())
    return rows.select("client", F.inline(each))


def _pushed(rows: DataFrame, kind: int, windows: tuple[int, int], n: str | int = 1, m: str | int = 0, c: str | int = 0, click: bool = False) -> DataFrame:
    """Both ends of each row's range in each window, from (client, start, sold): known from start on, in a window until ``sold`` plus its days."""
    col = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    fits = [F.col("start") < F.col("sold") + days * DAY for days in windows]
    mask = F.when(fits[0], 1).otherwise(0) + F.when(fits[1], 2).otherwise(0)
    more = {"at": F.col("sold"), "ident": F.col("ident")} if click else {}
    points = [_point(F.col("start"), kind, mask, col(n), col(m), col(c), **more)]
    points += [F.when(fits[w], _point(F.col("sold") + days * DAY, kind, 1 << w, col(n), col(m), col(c), sign=-1)) for w, days in enumerate(windows)]
    return _points(rows.where(fits[0] | fits[1]), points)


# ---- the scan ------------------------------------------------------------------------------------------------------


def _features(client, time, what, n, m, c, at, ident, carry):
    """Counters (N, probes), latest click (time, id) of each probe of a block, and what the block's last client leaves open.

    ``carry``: (client, counters, latest click) that the block before left open.
    """
    new = np.append(carry is None or client[0] != carry[0], client[1:] != client[:-1])
    group = np.cumsum(new) - new[0]
    probes, points = np.flatnonzero(what == PROBE), np.flatnonzero(what != PROBE)
    affected = np.searchsorted(probes, points)  # the first probe at or after a point
    of_probe = group[probes]
    inside = np.append(of_probe, -1)[affected] == group[points]  # a point after its client's last probe affects none here
    last = group[points] == group[-1]
    diff, left = np.zeros((N, len(probes) + 1), np.int64), np.zeros(N, np.int64)

    def push(counter: int, sel: np.ndarray, amount: np.ndarray) -> None:
        here = inside[sel]
        np.add.at(diff[counter], affected[sel][here], amount[here])
        left[counter] += amount[last[sel]].sum()

    codes, width = what[points], len(PER_WINDOW)
    for code in np.unique(codes).tolist():
        sel = np.flatnonzero(codes == code)
        rows, (kind, mask) = points[sel], divmod(code, 4)
        if kind == LABEL:
            push(N - 1, sel, n[rows])
            continue
        for w in (0, 1):
            if mask >> w & 1:
                for counter, amount in zip(COUNTER[kind], (n, m, c), strict=True):
                    if counter is not None:
                        push(w * width + counter, sel, amount[rows])
    total = np.cumsum(diff[:, :-1], axis=1)
    starts = np.searchsorted(of_probe, of_probe)  # first probe of the client in this block
    total -= np.where(starts > 0, total[:, starts - 1], 0)
    same = carry is not None and not new[0]
    if same:
        total[:, of_probe == 0] += carry[1][:, None]
        if group[-1] == 0:
            left += carry[1]
    clicks = points[(codes >> 2 == CLICK) & (n[points] > 0)]
    times, ids = np.append(at[clicks], carry[2][0] if same else LEAST), np.append(ident[clicks], carry[2][1] if same else LEAST)
    order = np.lexsort((ids, times))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    size = len(order) + 1
    value = group * size
    value[clicks] += rank[:-1]
    if same:
        value[0] = max(value[0], rank[-1])
    run = np.maximum.accumulate(value) - group * size
    pick = lambda r: (np.where(r > 0, times[order[r - 1]], LEAST), np.where(r > 0, ids[order[r - 1]], LEAST))
    latest = pick(run[probes])
    end = pick(run[-1:])
    return probes, total, latest, (int(client[-1]), left, (int(end[0][0]), int(end[1][0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, first, carry = TaskContext.get().partitionId(), None, None
    names = ["part", "mark", "client", "t", "sale_id", "open", *(f"v{k}" for k in range(N)), "click_at", "click_id"]
    for client, time, what, n, m, c, at, ident in blocks(batches):
        first = int(client[0]) if first is None else first
        probes, total, latest, carry = _features(client, time, what, n, m, c, at, ident, carry)
        if len(probes):
            own = client[probes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(probes), part, np.int32)), pa.array(np.zeros(len(probes), np.int32)), pa.array(own), pa.array(time[probes]), pa.array(ident[probes]), pa.array(own == first), *map(pa.array, total), *map(pa.array, latest)], names=names
            )
    if carry is not None:
        rows = [(part, 1, first, 0, 0, False, *[0] * N, LEAST, LEAST), (part, 2, carry[0], 0, 0, False, *carry[1].tolist(), *carry[2])]
        kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * (N + 2))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _added(a: tuple, b: tuple) -> tuple:
    return (*(x + y for x, y in zip(a[:N], b[:N], strict=True)), *max(a[N:], b[N:]))


def pushed_features(points: DataFrame, probes: DataFrame, windows: tuple[int, int]) -> DataFrame:
    """(sale_id, t, v0 ... , click_at, click_id) of probes (client, t, sale_id) under points (client, time, what, n, m, c, at, ident)."""
    spark = points.sparkSession
    none = F.lit(None).cast("long")
    asked = probes.select("client", F.col("t").alias("time"), F.lit(PROBE).alias("what"), *[none.alias(x) for x in ("n", "m", "c", "at")], F.col("sale_id").alias("ident"))
    order = ("client", "time", "what")  # at one time points come before probes
    dealt = points.unionByName(asked).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    counters = [f"v{k}" for k in range(N)]
    schema = ", ".join(["part int, mark int, client long, t long, sale_id long, open boolean", *(f"{v} long" for v in counters), "click_at long, click_id long"])
    scanned = stored(dealt.mapInArrow(_scan, schema), "scanned")
    ends: dict[int, dict[int, tuple]] = {}
    for r in scanned.where("mark > 0").select("part", "mark", "client", *counters, "click_at", "click_id").collect():  # two rows a range
        ends.setdefault(r.part, {})[r.mark] = (r.client, tuple(r[3:]))
    left = open_ranges([(p, e[1][0], e[2][0], e[2][1]) for p, e in ends.items()], _added)
    fields = [*counters, "click_at", "click_id"]
    carried = spark.createDataFrame([(p, *(x or [None] * (N + 2))) for p, x in left], ", ".join(["part int", *(f"_{f} long" for f in fields)]))
    both = scanned.where("mark = 0").join(F.broadcast(carried), "part", "left")
    ours = F.col("open") & F.col("_v0").isNotNull()
    later = F.greatest(F.struct("click_at", "click_id"), F.struct(F.col("_click_at").alias("click_at"), F.col("_click_id").alias("click_id")))
    latest = F.when(ours, later).otherwise(F.struct("click_at", "click_id"))
    return both.select("sale_id", "t", *[(F.col(v) + F.when(ours, F.col(f"_{v}")).otherwise(0)).alias(v) for v in counters], latest["click_at"].alias("click_at"), latest["click_id"].alias("click_id"))


# ---- the table -----------------------------------------------------------------------------------------------------


def feature_table(
    clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, int] = (2, 14), label_days: int = 7, delay_minutes: int = 240, spread_seconds: int = 259_200
) -> DataFrame:
    """One row per sale with client, time and id, and window d of ``windows`` (days): sale_id, d, t_us, label, the counts of
    PER_WINDOW and last_click_id.

    t is sold_at plus crc32(sale_id) modulo ``spread_seconds``. A click or sale counts from the later of its time and its arrival
    plus ``delay_minutes`` on, until d days after its time; a line of a counted sale also not before shipped_at. A click without
    client, time or arrival, a sale without client, time or arrival, and a line without sale or shipping time never count; sales
    that never arrived still make labels. Wholly equal clicks count once; equal lines each; a sale row that repeats counts, and is
    asked, each time, with its lines. A sale without an id has no t and no rows of its own. Amounts are cents, null and
    non-finite ones 0; of clicks at the latest time one without an id is the last only if all are. Other columns only tell clicks apart. Empty tables give zeros, or no rows without sales.
    """
    wait = delay_minutes * MINUTE
    named = ("client_id", "ts", "arrived_at", "click_id", "kind", "value")
    rest = [c for c in clicks.columns if c not in named]
    digest = F.unhex(F.sha2(F.to_json(F.struct(*rest)).cast("binary"), 256)) if rest else F.lit(None).cast("binary")
    own = clicks.where("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL")
    own = own.select(*named, digest.alias("_rest")).distinct()
    own = own.select(
        F.col("client_id").cast("long").alias("client"), micros(clicks, "ts").alias("sold"), F.greatest(micros(clicks, "ts"), micros(clicks, "arrived_at") + wait).alias("start"),
        F.coalesce((F.col("kind") == "purchase").cast("long"), F.lit(0)).alias("m"), cents(F.col("value")).alias("c"), F.col("click_id").cast("long").alias("ident"),
    )
    sold = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL").select(
        F.col("sale_id").cast("long").alias("sale_id"), F.col("client_id").cast("long").alias("client"), micros(sales, "sold_at").alias("sold"),
        F.greatest(micros(sales, "sold_at"), micros(sales, "arrived_at") + wait).alias("start"), F.col("arrived_at").isNotNull().alias("there"), cents(F.col("total")).alias("c"),
    )
    known = sold.where("there")
    # equal lines of a sale first, so that a sale with very many of them is small before the join
    some = lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL").select(F.col("sale_id").cast("long").alias("sale_id"), F.col("item_id").cast("long").alias("item"), micros(lines, "shipped_at").alias("shipped"), cents(F.col("amount")).alias("c"))
    some = some.groupBy("sale_id", "item", "shipped").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    bought = some.join(known.select("sale_id", "client", "sold", "start"), "sale_id").select("client", "item", F.greatest("start", "shipped").alias("start"), "sold", "n", "c")
    bought = stored(bought.where(F.col("start") < F.col("sold") + max(windows) * DAY), "bought")

    points = _pushed(own, CLICK, windows, 1, "m", "c", click=True)
    points = points.unionByName(_pushed(known, SALE, windows, 1, 0, "c")).unionByName(_pushed(bought, LINE, windows, "n", 0, "c")).unionByName(item_ranges(bought, windows))
    ahead = label_days * DAY
    points = points.unionByName(_points(sold, [_point(F.col("sold") - ahead, LABEL, 0), _point(F.col("sold"), LABEL, 0, sign=-1)]))
    t = F.col("sold") + F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(spread_seconds)) * 1_000_000
    found = pushed_features(points, sold.where("sale_id IS NOT NULL").select("client", t.alias("t"), "sale_id"), windows)

    def window(w: int, days: int) -> Column:
        inside = (F.col("click_at") > LEAST) & (F.col("click_at") + days * DAY > F.col("t")) & (F.col("click_id") > LEAST)
        values = [F.col(f"v{w * len(PER_WINDOW) + k}").alias(name) for k, name in enumerate(PER_WINDOW)]
        return F.struct(F.lit(days).alias("d"), *values, F.when(inside, F.col("click_id")).alias("last_click_id"))

    each = found.select("sale_id", F.col("t").alias("t_us"), (F.col(f"v{N - 1}") > 0).alias("label"), F.inline(F.array(*[window(w, days) for w, days in enumerate(windows)])))
    return each.select("sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
