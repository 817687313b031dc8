"""Problem 1: quantities recorded in different units, brought to percent or plain won.

A hidden Markov model per device (one quantity of one subject, or of one position in a portfolio) has the unit as
its hidden state. Observations are the recorded values in order of date; their logarithms follow a level that moves
smoothly once it is in the common unit, so a change of unit shows as a jump of log(factor). What a row states of its
unit (unit column, text, note of its source) is evidence that admits one state only; Viterbi finds the cheapest path of
states through every row of a device, so rows that state nothing are decoded from the jumps between their neighbours.

Devices of up to ``heavy_rows`` rows are decoded whole, many at a time. Longer ones, of which there are at most
rows / heavy_rows, are range-sorted by date and cut into blocks: each block yields the cost of its best path between every
pair of first and last states, one short pass along those tables settles the states at the borders, and every block is
decoded between them. The path is the one of the whole device, and no task holds more than a block.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.functions import units as U
from graindeck.session import cut, parallelism
from graindeck.sources.tables import finite, folded_key

COMMON = {"share": ("percent_observed", "none"), "amount": ("currency_amount", "KRW")}
#: The first number of a text says nothing of its unit; without it few different texts are left.
FIRST_NUMBER = r"^([^0-9]*)[0-9][0-9,]*(\.[0-9]+)?"
#: Costs of the model: spread of the level's logarithm (its variance doubles in LEVEL_DAYS), of a change of unit, and of changing to another unit than the common one.
SPREAD, LEVEL_DAYS, SWITCH, RARE = 0.35, 30.0, 3.0, 1.0
#: Devices times states times states that a step of the decoder has in memory at once.
STEP_CELLS = 1 << 19


def metric_recordings(metrics: DataFrame, catalog: DataFrame, sources: DataFrame) -> DataFrame:
    """numeric_value of metrics that are shares or amounts, with all that each row has to tell its unit. A row of a
    metric that the catalog doesn't list is no share or amount; a source that isn't listed has no note."""
    kinds = catalog.where(F.col("dimension").isin("share", "amount")).select("metric_id", "dimension").dropDuplicates(["metric_id"])
    m = metrics.select("subject_key", "metric_id", "numeric_value", "raw_text_value", "unit_code", "currency_code", "effective_as_of", "source_id", "source_row_id")
    m = _noted(m.join(F.broadcast(kinds), "metric_id"), sources)  # the catalog lists metrics: tens of rows at any scale
    untold = F.col("unit_code").isNull()
    return m.select(
        F.lit(0).alias("kind"), F.concat("metric_id", F.lit("@"), "source_row_id").alias("row_key"), (F.col("dimension") == "amount").alias("amount"),
        F.xxhash64(F.lit("m"), folded_key("subject_key"), "metric_id").alias("device"), F.col("effective_as_of").alias("at"),
        F.col("numeric_value").alias("value"), F.col("unit_code").alias("unit"), F.col("currency_code").alias("currency"),
        F.when(untold | (F.lower(F.trim("unit_code")) == "number"), F.regexp_replace("raw_text_value", FIRST_NUMBER, "$10")).alias("text"), F.when(untold, F.col("note")).alias("note"))


def holding_recordings(holdings: DataFrame, sources: DataFrame) -> DataFrame:
    """weight_value and value_amount of holdings, two rows each, with all that each has to tell its unit."""
    h = holdings.select("holding_key", "portfolio_key", "security_key", "held_isin_raw", "security_name_raw", "effective_as_of", "requested_as_of",
                        "weight_value", "weight_unit", "value_amount", "value_amount_unit", "currency", "source_id")
    item = F.coalesce("security_key", "held_isin_raw", F.lower("security_name_raw"))
    h = _noted(h, sources).withColumn("device", F.xxhash64(F.lit("h"), folded_key("portfolio_key"), item))
    both = h.select("holding_key", "device", F.coalesce("effective_as_of", "requested_as_of").alias("at"), "note", "currency", F.explode(F.array(
        F.struct(F.lit(1).alias("kind"), F.col("weight_value").alias("value"), F.col("weight_unit").alias("unit")),
        F.struct(F.lit(2).alias("kind"), F.col("value_amount").alias("value"), F.col("value_amount_unit").alias("unit")),
    )).alias("q")).select("*", "q.*")
    return both.select("kind", F.col("holding_key").alias("row_key"), (F.col("kind") == 2).alias("amount"), F.xxhash64("device", "kind").alias("device"), "at", "value", "unit",
                       "currency", F.lit(None).cast("string").alias("text"), F.when(F.col("unit").isNull(), F.col("note")).alias("note"))


def _noted(rows: DataFrame, sources: DataFrame) -> DataFrame:
    notes = sources.where(F.col("note").isNotNull()).groupBy("source_id").agg(F.min("note").alias("note"))
    return rows.join(F.broadcast(notes), "source_id", "left")  # one row per source load, tens at any scale


def states(unit_reference: DataFrame, currency_rate: DataFrame, bound: int = 10_000) -> list[tuple[str, str, str, float]]:
    """The hidden states: (dimension, unit_id, currency_code, factor to percent or won), the common ones first.

    Both tables are reference data of tens of rows; more than ``bound`` rows are refused.
    """
    units = unit_reference.where(F.col("dimension").isin("share", "amount")).select("dimension", "unit_id", F.col("factor_to_common").cast("double")).limit(bound + 1).collect()
    rates = currency_rate.select("currency_code", F.col("krw_per_unit").cast("double")).limit(bound + 1).collect()
    if len(units) * len(rates) > bound:
        raise ValueError(f"more than {bound} units or currencies")
    out = [("share", u, "none", f) for d, u, f in units if d == "share"]
    out += [("amount", u, c, f * k) for d, u, f in units if d == "amount" for c, k in rates if c != "GBX" or u == "currency_amount"]
    return sorted(out, key=lambda s: ((s[1], s[2]) != COMMON[s[0]], s))


def moves(logs: np.ndarray, days: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Cost of going from each state of row ``at - 1`` to each state of row ``at``: [rows, from, to].

    Squared jump of the level against a variance that grows with the days between, plus the cost of another unit. A row
    without a value (NaN) says nothing of the level.
    """
    k = len(factors)
    change = (SWITCH + RARE * (np.arange(k) > 0))[None, :] * (1 - np.eye(k))
    jump = (logs[at] - logs[at - 1])[:, None, None] + (factors[None, :] - factors[:, None])[None]
    wide = 2 * SPREAD**2 * (1 + np.maximum(days[at] - days[at - 1], 0) / LEVEL_DAYS)
    return np.nan_to_num(jump * jump / wide[:, None, None], nan=0.0) + change[None]


def first_costs(pinned: np.ndarray, k: int) -> np.ndarray:
    """[rows, states]: cost of starting in a state; a pinned row has one state only."""
    cost = np.tile(RARE * (np.arange(k) > 0.0), (len(pinned), 1))
    return np.where((pinned < 0)[:, None], cost, np.where(np.arange(k)[None, :] == pinned[:, None], 0.0, np.inf))


def viterbi(logs: np.ndarray, days: np.ndarray, pinned: np.ndarray, starts: np.ndarray, ends: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The state of every row on the cheapest path of its device. logs: log |value| (NaN: says nothing); pinned: the state a row
    states, or -1; a device has rows ``starts`` to ``ends``, in order; factors: log factor of each state, the common one first.

    All devices advance together, row by row; of equal costs the earlier state wins.
    """
    k, path = len(factors), np.full(len(logs), -1, np.int32)
    long = np.argsort(starts - ends, kind="stable")
    s, n = starts[long], (ends - starts)[long]
    cost = first_costs(pinned[s], k)
    back = []
    for t in range(1, int(n[0]) if len(n) else 0):
        live = int(np.count_nonzero(n > t))  # the longest come first
        at = s[:live] + t
        was, own = pinned[at - 1], pinned[at]
        new, came = np.full((live, k), np.inf), np.zeros((live, k), np.int16)
        tied = np.flatnonzero((was >= 0) & (own >= 0))  # one state before, one after: one cost
        if len(tied):
            i, j, r = was[tied], own[tied], at[tied]
            jump = logs[r] + factors[j] - logs[r - 1] - factors[i]
            wide = 2 * SPREAD**2 * (1 + np.maximum(days[r] - days[r - 1], 0) / LEVEL_DAYS)
            new[tied, j] = cost[tied, i] + np.nan_to_num(jump * jump / wide, nan=0.0) + (i != j) * (SWITCH + RARE * (j > 0))
            came[tied, j] = i
        free = np.flatnonzero((was < 0) | (own < 0))
        for part in np.array_split(free, max(1, -(-len(free) * k * k // STEP_CELLS))):
            if len(part):
                total = cost[part][:, :, None] + moves(logs, days, at[part], factors)
                came[part] = total.argmin(1)
                best = total.min(1)
                stated = own[part] >= 0
                best[stated] = np.where(np.arange(k)[None, :] == own[part][stated][:, None], best[stated], np.inf)
                new[part] = best
        cost[:live] = new
        back.append(came)
    if len(n):
        path[s + n - 1] = cost.argmin(1)
    for t in range(len(back), 0, -1):
        at = s[: len(back[t - 1])] + t
        path[at - 1] = back[t - 1][np.arange(len(at)), path[at]]
    return path


def transfer(logs: np.ndarray, days: np.ndarray, pinned: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """[first state, last state]: cost of the best path through the rows between them (infinite where a pinned row forbids it)."""
    k = len(factors)
    allowed = lambda p: np.arange(k) if p < 0 else np.array([p])
    best = np.where(np.eye(k, dtype=bool), 0.0, np.inf)[:, allowed(pinned[0])]
    for t in range(1, len(logs)):
        step = moves(logs, days, np.array([t]), factors)[0][np.ix_(allowed(pinned[t - 1]), allowed(pinned[t]))]
        best = (best[:, :, None] + step[None]).min(1)
    out = np.full((k, k), np.inf)
    out[:, allowed(pinned[-1])] = best
    return out


class Decoder:
    """What the tasks of ``decode`` share: states, the reading of statements, and the columns."""

    FIELDS = {"table_name": pa.string(), "quantity": pa.string(), "row_key": pa.string(), "unit_id": pa.string(), "currency_code": pa.string(), "value": pa.float64(), "value_common": pa.float64(), "basis": pa.string()}
    ROW = {"kind": pa.int32(), "device": pa.int64(), "day": pa.int32(), "row_key": pa.string(), "amount": pa.bool_(), "value": pa.float64(), "unit": pa.string(), "currency": pa.string(), "text": pa.string(), "note": pa.string()}
    BLOCK = {"block": pa.int64(), "place": pa.int32(), "shown": pa.bool_(), "borders": pa.list_(pa.float64()), "costs": pa.list_(pa.float64())}

    def __init__(self, hidden: list[tuple[str, str, str, float]]):
        self.hidden = hidden
        self.index = {(u, c): i for i, (_, u, c, _) in enumerate(hidden)}
        self.factor = np.array([f for *_, f in hidden])
        shares = np.array([d == "share" for d, *_ in hidden])
        self.own = {False: np.flatnonzero(shares), True: np.flatnonzero(~shares)}  # by "is an amount"
        self.seen: dict = {}

    def read(self, t: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """What each row states, the state that is, the logarithm of its value and its day."""
        if len(self.seen) > 1 << 16:
            self.seen.clear()
        said, seen = [], self.seen
        for row in zip(*(t[f].to_pylist() for f in ("amount", "unit", "currency", "text", "note"))):
            if row not in seen:
                seen[row] = U.stated(not row[0], *row[1:])
            said.append(seen[row])
        pins = np.array([-1 if x is None else self.index.get(x[:2], -1) for x in said], np.int32)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.log(np.abs(t["value"].to_numpy(zero_copy_only=False).astype(float)))
        logs[~np.isfinite(logs)] = np.nan
        return said, pins, logs, t["day"].to_numpy().astype(float)

    def place(self, pins: np.ndarray, amount: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pins as numbers among the states of that dimension, and the log factors of those."""
        own = self.own[amount]
        place = np.full(len(self.hidden) + 1, -1)
        place[own] = np.arange(len(own))
        return place[pins], np.log(self.factor[own])

    def decoded(self, t: pa.Table, pins: np.ndarray, logs: np.ndarray, days: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state of every row; -1 in devices of which no row states a unit."""
        state, cash = np.full(len(pins), -1, np.int32), t["amount"].to_numpy(zero_copy_only=False)
        tied = np.add.reduceat(pins >= 0, starts) > 0 if len(starts) else np.zeros(0, bool)
        for amount in (False, True):
            mine = tied & (cash[starts] == amount)
            if mine.any():
                local, factors = self.place(pins, amount)
                path = viterbi(logs, days, local, starts[mine], ends[mine], factors)
                state = np.where(path >= 0, self.own[amount][path], state)
        return state

    def out(self, t: pa.Table, state: np.ndarray, pins: np.ndarray, said: list, shown: np.ndarray) -> pa.RecordBatch:
        tables, quantities = pa.array(["metric_observation", "holding_observation", "holding_observation"]), pa.array(["numeric_value", "weight_value", "value_amount"])
        value, told = t["value"].to_numpy(zero_copy_only=False).astype(float), state >= 0
        common = np.where(told, value * self.factor[np.where(told, state, 0)], np.nan)
        basis = pa.array([x[2] if p >= 0 else "level" if y else None for x, p, y in zip(said, pins, told)], pa.string())
        take, kinds = pa.array(np.where(told, state, 0), pa.int32(), mask=~told), t["kind"].combine_chunks()
        return pa.RecordBatch.from_arrays(
            [tables.take(kinds), quantities.take(kinds), t["row_key"].combine_chunks(), pa.array([u for _, u, _, _ in self.hidden]).take(take), pa.array([c for _, _, c, _ in self.hidden]).take(take),
             t["value"].combine_chunks(), pa.array(common, mask=~told | ~np.isfinite(value)), basis], names=[*self.FIELDS]).filter(pa.array(shown))

    @staticmethod
    def fresh(t: pa.Table, before: tuple | None = None) -> np.ndarray:
        """False on re-delivered rows: device, day and key equal those of the row ahead (``before``: of the row ahead of the table)."""
        device, day, key = t["device"].to_numpy(), t["day"].to_numpy(), t["row_key"].combine_chunks().to_numpy(zero_copy_only=False)
        out = np.ones(t.num_rows, bool)
        keyed = np.array([x is not None for x in key])  # a row without a key is no re-delivery of another
        out[1:] = ~((device[1:] == device[:-1]) & (day[1:] == day[:-1]) & (key[1:] == key[:-1]) & keyed[1:])
        out[0] = not (before is not None and keyed[0] and before == (device[0], day[0], key[0]))
        return out

    def whole(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (device, day, key), no device cut between tasks."""
        for t in _by_key(batches, "device"):
            said, pins, logs, days = self.read(t)
            device = t["device"].to_numpy()
            starts = np.flatnonzero(np.r_[True, device[1:] != device[:-1]])
            state = self.decoded(t, pins, logs, days, starts, np.r_[starts[1:], t.num_rows])
            yield self.out(t, state, pins, said, self.fresh(t))

    def blocks(self, batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
        """The rows of range-sorted heavy devices with their block, and a row per block with its borders (first log and day, last
        log and day, pinned rows) and its ``transfer``."""
        schema = self.ROW | self.BLOCK
        number, before, held = TaskContext.get().partitionId() << 40, None, None

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number, before
            n = t.num_rows
            _, pins, logs, days = self.read(t)
            local, factors = self.place(pins, t["amount"][0].as_py())
            more = {"block": pa.array([number] * n, pa.int64()), "place": pa.array(range(n), pa.int32()), "shown": pa.array(self.fresh(t, before))}
            one = {"device": t["device"][0].as_py(), "amount": t["amount"][0].as_py(), "block": number,
                   "borders": [logs[0], days[0], logs[-1], days[-1], float((pins >= 0).sum())], "costs": transfer(logs, days, local, factors).ravel().tolist()}
            yield pa.RecordBatch.from_arrays([t[c].combine_chunks().cast(x) if c in t.column_names else more.get(c, pa.nulls(n, x)) for c, x in schema.items()], names=[*schema])
            yield pa.RecordBatch.from_arrays([pa.array([one.get(c)], x) for c, x in schema.items()], names=[*schema])
            before, number = (t["device"][n - 1].as_py(), t["day"][n - 1].as_py(), t["row_key"][n - 1].as_py()), number + 1

        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            while t.num_rows:
                device = t["device"].to_numpy()
                end = int(np.searchsorted(device, device[0], "right"))
                if end == t.num_rows and end < block_rows:
                    break
                yield from emit(t.slice(0, min(end, block_rows)).combine_chunks())
                t = t.slice(min(end, block_rows))
            held = t if t.num_rows else None
        if held is not None:
            yield from emit(held.combine_chunks())

    def chain(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last state of every block, from the blocks of a device in order: (block, first_state, last_state), -1 where nothing is stated."""
        device, cost, last, steps, pins, amount = None, None, None, [], 0.0, False

        def done() -> Iterator[pa.RecordBatch]:
            if steps:
                end, ids, firsts, lasts = int(cost.argmin()), [], [], []
                for block, entered, began in reversed(steps):
                    first = int(began[end])
                    ids, firsts, lasts = [*ids, block], [*firsts, first], [*lasts, end]
                    end = int(entered[first])
                own = self.own[amount]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([int(own[x]) if pins else -1 for x in xs], pa.int32()) for xs in (firsts, lasts))], names=["block", "first_state", "last_state"])

        for b in batches:
            for d, cash, block, (log0, day0, log1, day1, n), costs in zip(*(b.column(i).to_pylist() for i in range(5))):
                own = self.own[cash]
                k, factors = len(own), np.log(self.factor[own])
                if d != device:
                    yield from done()
                    device, steps, pins, amount, entry, entered = d, [], 0.0, cash, first_costs(np.array([-1]), k)[0], np.zeros(k, np.int16)
                else:
                    total = cost[:, None] + moves(np.array([last[0], log0]), np.array([last[1], day0]), np.array([1]), factors)[0]
                    entry, entered = total.min(0), total.argmin(0).astype(np.int16)
                through = entry[:, None] + np.array(costs).reshape(k, k)
                cost, last, pins = through.min(0), (log1, day1), pins + n
                steps.append((block, entered, through.argmin(0).astype(np.int16)))
        yield from done()

    def finish(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (block, place) with the states of their block's ends, decoded between them."""
        for t in _by_key(batches, "block"):
            said, pins, logs, days = self.read(t)
            block, first, last = (t[c].to_numpy() for c in ("block", "first_state", "last_state"))
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = np.r_[starts[1:], t.num_rows]
            fixed = pins.copy()
            fixed[starts], fixed[ends - 1] = first[starts], last[ends - 1]
            state = self.decoded(t, np.where(first >= 0, fixed, -1), logs, days, starts, ends)
            yield self.out(t, state, pins, said, t["shown"].to_numpy(zero_copy_only=False))


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches joined and cut again where ``key`` changes, so that no key is cut."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t, keys = pa.Table.from_batches([b]), b.column(b.schema.get_field_index(key)).to_numpy()
        cut_at = int(np.searchsorted(keys, keys[-1]))
        if cut_at == 0 and held and held[-1][key][-1].as_py() != keys[0]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if cut_at:
            yield pa.concat_tables([*held, t.slice(0, cut_at)]).combine_chunks()
            held = []
        held.append(t.slice(cut_at))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _ddl(columns: dict) -> str:
    of = {pa.string(): "string", pa.float64(): "double", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.list_(pa.float64()): "array<double>"}
    return ", ".join(f"{c} {of[x]}" for c, x in columns.items())


def decode(recordings: DataFrame, hidden: list[tuple[str, str, str, float]], partitions: int | None = None, heavy_rows: int = 1 << 17, block_rows: int = 4_096) -> DataFrame:
    """One row per recorded value with the unit on the Viterbi path of its device and its value in percent or won.

    Adds value_common and basis: column, text or note where the row states its unit, 'level' where the path alone tells it, null
    (with unit, currency and value_common null) in devices of which no row states a unit. Rows equal in device, date,
    quantity and row_key are re-deliveries and come out once. Null, NaN and infinite values keep their unit and get no
    common value. An empty input gives an empty result. The result depends on no parameter but ``hidden``.
    """
    d, spark = Decoder(hidden), recordings.sparkSession
    rows = recordings.select("kind", "device", F.coalesce(F.datediff("at", F.lit("1970-01-01")), F.lit(-1_000_000)).alias("day"), "row_key", "amount", "value", "unit", "currency", "text", "note")
    heavy = cut(rows.groupBy("device").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_rows).select("device"), "units-heavy")
    any_heavy = heavy.first() is not None
    light = rows.join(heavy, "device", "left_anti") if any_heavy else rows
    light = light.repartition(partitions, "device") if partitions else light.repartition("device")
    out = light.sortWithinPartitions("device", "day", "row_key").mapInArrow(d.whole, _ddl(d.FIELDS))
    if not any_heavy:
        return out
    hot = rows.join(heavy, "device", "left_semi").repartitionByRange(partitions or parallelism(spark), "device", "day", "row_key").sortWithinPartitions("device", "day", "row_key")
    # written once: a second run of the sort could draw its range borders elsewhere and give other blocks
    parts = cut(hot.mapInArrow(lambda b: d.blocks(b, block_rows), _ddl(d.ROW | d.BLOCK)), "units-blocks")
    tables = parts.where(F.col("costs").isNotNull()).select("device", "amount", "block", "borders", "costs").repartition("device").sortWithinPartitions("device", "block")
    ends = tables.mapInArrow(d.chain, "block bigint, first_state int, last_state int")
    rows = parts.where(F.col("costs").isNull()).drop("borders", "costs").join(ends, "block").repartition("block").sortWithinPartitions("block", "place")
    return out.unionByName(rows.mapInArrow(d.finish, _ddl(d.FIELDS)))


def with_percent_weight(holdings: DataFrame, sources: DataFrame, unit_reference: DataFrame) -> DataFrame:
    """Keys of holdings (holding_key, family_id, portfolio_key, security_key) with weight_percent: weight_value in percent, null where it or its unit is unknown or it isn't finite.

    Distinct spellings of a unit are read once; at most ``len(SHARE_WORDS)`` units have a factor, the rest join to nothing.
    """
    words = {w: unit for unit, ws in U.SHARE_WORDS.items() for w in ws}
    spelt = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    notes = sources.where(F.col("note").isNotNull()).groupBy("source_id").agg(F.min("note").alias("note"))
    told = notes.mapInPandas(lambda it: (b.assign(note_unit=[U.note_units(n)[0] for n in b["note"]])[["source_id", "note_unit"]] for b in it), "source_id string, note_unit string")
    factors = unit_reference.where(F.col("dimension") == "share").select(F.col("unit_id").alias("weight_unit_id"), F.col("factor_to_common").alias("__f"))
    h = holdings.select("holding_key", "family_id", "portfolio_key", "security_key", "weight_value", "weight_unit", "source_id")
    h = h.join(F.broadcast(told), "source_id", "left")  # source loads, tens at any scale
    unit = F.when(F.col("weight_unit").isNull(), F.col("note_unit")).otherwise(spelt[F.lower(F.trim("weight_unit"))])
    h = h.withColumn("weight_unit_id", unit).join(F.broadcast(factors), "weight_unit_id", "left")
    return h.withColumn("weight_percent", F.when(finite("weight_value"), F.col("weight_value") * F.col("__f"))).select("holding_key", "family_id", "portfolio_key", "security_key", "weight_percent")


def normalise(metrics: DataFrame, holdings: DataFrame, catalog: DataFrame, sources: DataFrame, unit_reference: DataFrame, currency_rate: DataFrame) -> DataFrame:
    """Every share and amount of both tables in its common unit (see ``decode``)."""
    rows = metric_recordings(metrics, catalog, sources).unionByName(holding_recordings(holdings, sources))
    return decode(rows, states(unit_reference, currency_rate))


def found(normalised: DataFrame) -> DataFrame:
    """Finite values whose stated unit is not the common one, with unit and currency."""
    usual = F.when(F.col("currency_code") == "none", F.col("unit_id") == "percent_observed").otherwise((F.col("unit_id") == "currency_amount") & (F.col("currency_code") == "KRW"))
    return normalised.where(finite("value") & F.col("basis").isin("column", "text", "note") & ~usual).select(
        "table_name", "quantity", "row_key", F.col("unit_id").alias("recorded_unit"), F.col("currency_code").alias("recorded_currency"))
