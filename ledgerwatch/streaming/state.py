"""What a stream keeps of every customer, in Spark's own keyed state (RocksDB).

Every call of the state is a round trip between Python and the JVM, so a customer of up to ``WHOLE`` rows is two values, read and written
once a batch: totals, and all the rest packed. Beyond that the rest moves into maps. Per such customer: running totals, the counts of channels and hours, the accounts with their newest event, sums per hour of event time, and
the events of each hour. A micro-batch reads and writes the customers that it holds, and of their events only the hours in which
one of its rows' windows begins; hours wholly inside a window count by their sums. Hours that no window can reach any more are
removed. Results are those of ``operators.features`` in arrival order, whatever rows form a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..functions import scalars as X

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = {"n_60s": S.MINUTE, "n_1h": S.HOUR, "n_24h": S.DAY}
SUMMED = {"s_1h": S.HOUR, "s_6h": 6 * S.HOUR, "s_24h": S.DAY, "s_7d": S.WEEK}
WHOLE = 4096  # rows up to which a customer's state is read and written as a whole
BLOCK = 256  # rows of a customer that are compared with each other at a time
EVENT = np.dtype([("ts", "<i8"), ("minor", "<i8"), ("round", "<i8")])

# Columns that the state adds to a row.
ADDED = (
    "txns_so_far bigint, total_so_far bigint, squares_so_far string, max_so_far_minor bigint, min_so_far_minor bigint, usual_channel string, "
    "usual_hour int, accounts_per_customer bigint, first_us bigint, previous_us bigint, "
    + ", ".join(f"{c} bigint" for c in (*COUNTED, *SUMMED)) + ", max_24h bigint, q_24h string, round_24h bigint, accounts_24h bigint, late boolean"
)

ANSWERS = [f.split()[0] for f in ADDED.split(", ")[:-1]]
USED = ("ts_us", "amount_minor", "round_amount", "channel", "event_hour", "account_id", "arrival_seq")


def integers(values: list) -> np.ndarray:
    """Whole numbers; the smallest stands for a missing one."""
    return np.array([-(1 << 63) if v is None or v != v else int(v) for v in values], np.int64)


class Past:
    """Events of a customer in the order of their times, or sums of hours in which no window begins, for questions about all
    that is not older than a cutoff."""

    def __init__(self, ts=(), n=(), minor=(), squares=(), high=(), rounds=()):
        order = np.argsort(np.asarray(ts, np.int64), kind="stable")
        self.ts = np.asarray(ts, np.int64)[order]
        self.n, self.minor, self.high, self.rounds = (np.asarray(v, np.int64)[order] for v in (n, minor, high, rounds))
        self.squares = np.asarray(squares, object)[order]  # beyond 64 bits
        back = lambda v: np.concatenate([np.cumsum(v[::-1])[::-1], np.zeros(1, v.dtype)])
        self.after = {"n": back(self.n), "minor": back(self.minor), "rounds": back(self.rounds), "squares": back(self.squares)}
        self.top = np.concatenate([np.maximum.accumulate(self.high[::-1])[::-1], [np.iinfo(np.int64).min]])

    def with_rows(self, ts: np.ndarray, minor: np.ndarray, rounds: np.ndarray) -> Past:
        own = minor.astype(object)
        join = lambda a, b: np.concatenate([a, b])
        return Past(join(self.ts, ts), join(self.n, np.ones(len(ts), np.int64)), join(self.minor, minor), join(self.squares, own * own),
                    join(self.high, minor), join(self.rounds, rounds))

    def windows(self, ts: np.ndarray, minor: np.ndarray, rounds: np.ndarray) -> dict[str, np.ndarray]:
        """Values of all windows for rows in arrival order: those of the past, and those of the rows that arrived before, itself included."""
        arrived = np.tri(len(ts), dtype=bool)
        inside = {h: arrived & (ts[None, :] >= (ts - h)[:, None]) for h in {*COUNTED.values(), *SUMMED.values()}}
        place = {h: np.searchsorted(self.ts, ts - h) for h in inside}
        out = {c: self.after["n"][place[h]] + inside[h].sum(1) for c, h in COUNTED.items()}
        out |= {c: self.after["minor"][place[h]] + inside[h] @ minor for c, h in SUMMED.items()}
        day, at = inside[S.DAY], place[S.DAY]
        out["round_24h"] = self.after["rounds"][at] + day @ rounds
        out["max_24h"] = np.maximum(self.top[at], np.where(day, minor[None, :], np.iinfo(np.int64).min).max(1))
        own = minor.astype(object)
        out["q_24h"] = self.after["squares"][at] + day.astype(object) @ (own * own)
        return out


class Packed:
    """All of a customer of few rows but the totals: counts of channels and hours, accounts with their newest event, events."""

    def __init__(self, usual: str = "[]", accounts: str = "[]", events: bytes = b""):
        self.usual = {(kind, value): count for kind, value, count in json.loads(usual)}
        self.accounts = {(known, account): newest for known, account, newest in json.loads(accounts)}
        self.events = np.frombuffer(events, EVENT)

    def row(self) -> tuple[str, str, bytes]:
        return (json.dumps([[*k, v] for k, v in self.usual.items()]), json.dumps([[*k, v] for k, v in self.accounts.items()]), self.events.tobytes())

    def past(self) -> Past:
        ts, minor = self.events["ts"].astype(np.int64), self.events["minor"].astype(np.int64)
        own = minor.astype(object)
        return Past(ts, np.ones(len(ts), np.int64), minor, own * own, minor, self.events["round"])


class CustomerState(StatefulProcessor):
    """Adds the running values and windows of ``ADDED`` to the rows of a customer.

    ``lateness``: a row that is older than the customer's newest event by more microseconds comes back with ``late`` and changes nothing;
    None: no row is late, and nothing is removed."""

    def __init__(self, lateness: int | None):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState(
            "totals", "n bigint, total bigint, squares string, high bigint, low bigint, first bigint, previous bigint, newest bigint, accounts bigint, "
            "channel string, channel_n bigint, channel_first bigint, hour int, hour_n bigint, hour_first bigint")
        self.usual = handle.getMapState("usual", "kind string, value string", "n bigint, first bigint")
        self.accounts = handle.getMapState("accounts", "known boolean, account string", "newest bigint")
        self.sums = handle.getMapState("sums", "hour bigint", "n bigint, minor bigint, squares string, high bigint, rounds bigint")
        self.events = handle.getMapState("events", "hour bigint", "rows binary")
        self.whole = handle.getValueState("whole", "usual string, accounts string, events binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The source's admission bounds a batch, and with it a customer's rows in one.
        table = pd.concat(list(rows), ignore_index=True).sort_values("arrival_seq", kind="stable", ignore_index=True)
        yield pd.concat([table, pd.DataFrame(self.answers({c: table[c].tolist() for c in USED}), dtype=object)], axis=1)

    def answers(self, rows: dict[str, list]) -> dict[str, list]:
        """The columns of ``ADDED`` for a batch's rows of the customer, in arrival order."""
        found = self.totals.get()
        t = list(found) if found is not None else [0, 0, "0", None, None, None, None, None, 0, None, 0, 0, None, 0, 0]
        late = self.late(integers(rows["ts_us"]), t[7])
        some = np.flatnonzero(~late).tolist()
        added = self.values(rows if len(some) == len(late) else {c: [v[i] for i in some] for c, v in rows.items()}, t) if some else {}
        out = {name: [None] * len(late) for name in ANSWERS}
        for name, values in added.items():
            for i, v in zip(some, values if isinstance(values, list) else values.tolist()):
                out[name][i] = v
        return out | {"late": late.tolist()}

    def packed(self, n: int, more: int) -> Packed | None:
        """The state of a customer of ``n`` rows before these, if it is kept as a whole; one that grows too large moves into the maps."""
        if not n:
            return Packed() if more <= WHOLE else None
        found = self.whole.get()
        if found is None:
            return None
        known = Packed(found[0], found[1], bytes(found[2]))
        if n + more <= WHOLE:
            return known
        for own, count in known.usual.items():
            self.usual.updateValue(own, tuple(count))
        for own, newest in known.accounts.items():
            self.accounts.updateValue(own, (newest,))
        self.add(known.events["ts"], known.events["minor"], known.events["round"])
        self.whole.clear()
        return None

    def late(self, ts: np.ndarray, newest: int | None) -> np.ndarray:
        out = np.zeros(len(ts), bool)
        if self.lateness is not None:
            for i, at in enumerate(ts.tolist()):
                out[i] = newest is not None and at < newest - self.lateness
                if not out[i] and (newest is None or at > newest):
                    newest = at
        return out

    def values(self, rows: dict[str, list], t: list) -> dict[str, object]:
        ts, minor, rounds = (integers(rows[c]) for c in ("ts_us", "amount_minor", "round_amount"))
        n, wide = len(ts), minor.astype(object)
        whole = self.packed(t[0], n)
        out: dict[str, object] = {"txns_so_far": t[0] + 1 + np.arange(n), "total_so_far": t[1] + np.cumsum(minor)}
        squares = int(t[2]) + np.cumsum(wide * wide)
        high, low = np.maximum.accumulate(minor), np.minimum.accumulate(minor)
        if t[3] is not None:
            high, low = np.maximum(high, t[3]), np.minimum(low, t[4])
        first = int(ts[0]) if t[5] is None else t[5]
        out |= {"squares_so_far": [str(v) for v in squares], "max_so_far_minor": high, "min_so_far_minor": low, "first_us": np.full(n, first),
                "previous_us": [t[6], *ts[:-1].tolist()]}
        out["usual_channel"], t[9:12] = self.usual_of("channel", rows["channel"], rows["arrival_seq"], t[9:12], whole)
        hours, t[12:15] = self.usual_of("hour", [int(h) for h in rows["event_hour"]], rows["arrival_seq"], t[12:15], whole)
        out["usual_hour"] = [int(h) for h in hours]
        out["accounts_per_customer"], out["accounts_24h"] = self.accounts_of(rows["account_id"], ts, whole)
        out |= self.windows_of(ts, minor, rounds) if whole is None else self.windows_after(whole.past(), ts, minor, rounds)
        newest = int(ts.max()) if t[7] is None else max(t[7], int(ts.max()))
        self.totals.update((t[0] + n, int(out["total_so_far"][-1]), str(squares[-1]), int(high[-1]), int(low[-1]), first, int(ts[-1]), newest,
                            int(out["accounts_per_customer"][-1]), *t[9:15]))
        if whole is None:
            self.keep(ts, minor, rounds, newest)
        else:
            self.keep_whole(whole, ts, minor, rounds, newest)
        out["q_24h"] = [str(v) for v in out["q_24h"]]
        return out

    def usual_of(self, kind: str, values: list, order: list[int], best: list, whole: Packed | None = None) -> tuple[list, list]:
        """The most frequent value after each row; of equally frequent ones the first seen."""
        counts, out = {}, []

        def known(own: tuple[str, str], seq: int) -> list[int]:
            if whole is not None:
                return whole.usual.get(own) or [0, seq]
            return list(self.usual.getValue(own)) if self.usual.containsKey(own) else [0, seq]

        for value, seq in zip(values, order):
            name = None if value is None or value != value else str(value)
            if name not in counts:
                counts[name] = known((kind, "-" if name is None else f"+{name}"), int(seq))
            counts[name][0] += 1
            if (counts[name][0], -counts[name][1]) > (best[1], -best[2]) or best[1] == 0:
                best = [name, counts[name][0], counts[name][1]]
            out.append(best[0])
        for name, count in counts.items():
            own = (kind, "-" if name is None else f"+{name}")
            if whole is None:
                self.usual.updateValue(own, tuple(count))
            else:
                whole.usual[own] = count
        return out, [best[0] if kind == "channel" else int(best[0]), *best[1:]]

    def accounts_of(self, accounts: list, ts: np.ndarray, whole: Packed | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Accounts seen so far, and those with an event not older than a day, after each row."""
        known = [(tuple(k), v[0]) for k, v in self.accounts.iterator()] if whole is None else list(whole.accounts.items())
        place = {k: i for i, (k, _) in enumerate(known)}
        newest = np.full(len(known) + len(accounts), np.iinfo(np.int64).min)
        newest[: len(known)] = [v for _, v in known]
        seen, recent, own = [], [], set()
        for account, at in zip(accounts, ts.tolist()):
            key = (account is not None, account or "")
            i = place.setdefault(key, len(place))
            newest[i] = max(at, newest[i])
            own.add(key)
            seen.append(len(place))
            recent.append(int(np.count_nonzero(newest[: len(place)] >= at - S.DAY)))
        for key in own:
            if whole is None:
                self.accounts.updateValue(key, (int(newest[place[key]]),))
            else:
                whole.accounts[key] = int(newest[place[key]])
        return np.array(seen), np.array(recent)

    def windows_of(self, ts: np.ndarray, minor: np.ndarray, rounds: np.ndarray) -> dict[str, np.ndarray]:
        lengths = np.array(sorted({*COUNTED.values(), *SUMMED.values()}))
        begins = set(((ts[:, None] - lengths[None, :]) // S.HOUR).ravel().tolist())
        oldest = min(begins)
        past = []
        for (hour,), (n, total, squares, high, some) in self.sums.iterator():
            if hour in begins:
                events = np.frombuffer(self.events.getValue((hour,))[0], EVENT)
                past += [(int(a), 1, int(m), int(m) ** 2, int(m), int(r)) for a, m, r in events.tolist()]
            elif hour >= oldest:
                past.append((hour * S.HOUR, n, total, int(squares), high, some))
        return self.windows_after(Past(*zip(*past)) if past else Past(), ts, minor, rounds)

    def windows_after(self, known: Past, ts: np.ndarray, minor: np.ndarray, rounds: np.ndarray) -> dict[str, np.ndarray]:
        parts = []
        for i in range(0, len(ts), BLOCK):
            block = ts[i : i + BLOCK], minor[i : i + BLOCK], rounds[i : i + BLOCK]
            parts.append(known.windows(*block))
            if i + BLOCK < len(ts):
                known = known.with_rows(*block)
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def keep(self, ts: np.ndarray, minor: np.ndarray, rounds: np.ndarray, newest: int) -> None:
        """Adds the rows to their hours, and removes hours that no further row's window reaches."""
        self.add(ts, minor, rounds)
        if self.lateness is not None:
            for hour in [k[0] for k in self.sums.keys() if k[0] < self.reach(newest)]:
                self.sums.removeKey((hour,))
                self.events.removeKey((hour,))

    def keep_whole(self, whole: Packed, ts: np.ndarray, minor: np.ndarray, rounds: np.ndarray, newest: int) -> None:
        events = np.zeros(len(ts), EVENT)
        events["ts"], events["minor"], events["round"] = ts, minor, rounds
        whole.events = np.concatenate([whole.events, events])
        if self.lateness is not None:
            whole.events = whole.events[whole.events["ts"] // S.HOUR >= self.reach(newest)]
        self.whole.update(whole.row())

    def reach(self, newest: int) -> int:
        """The first hour that a further row's window may reach."""
        return (newest - self.lateness - S.WEEK) // S.HOUR

    def add(self, ts: np.ndarray, minor: np.ndarray, rounds: np.ndarray) -> None:
        hours = ts // S.HOUR
        for hour in np.unique(hours).tolist():
            some = hours == hour
            events = np.zeros(int(some.sum()), EVENT)
            events["ts"], events["minor"], events["round"] = ts[some], minor[some], rounds[some]
            own = [int(m) for m in minor[some]]
            value = [len(own), sum(own), sum(m * m for m in own), max(own), int(rounds[some].sum())]
            data = events.tobytes()
            if self.sums.containsKey((hour,)):
                n, total, squares, high, many = self.sums.getValue((hour,))
                value = [value[0] + n, value[1] + total, value[2] + int(squares), max(value[3], high), value[4] + many]
                data = bytes(self.events.getValue((hour,))[0]) + data
            self.sums.updateValue((hour,), (value[0], value[1], str(value[2]), value[3], value[4]))
            self.events.updateValue((hour,), (data,))


class CustomerRows(CustomerState):
    """The same over plain rows: a data frame for each customer and batch costs more than the answers."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        table = sorted(rows, key=lambda r: (r["arrival_seq"] is None, r["arrival_seq"] or 0))
        added = self.answers({c: [r[c] for r in table] for c in USED})
        of = Row(*table[0].__fields__, *added)
        for row, values in zip(table, zip(*added.values())):
            yield of(*row, *values)


def use_keyed_state(spark: SparkSession) -> None:
    """State in RocksDB, which this needs, unless the session names another provider of its own."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch writes what it changed


def with_state(rows: DataFrame, columns: list[str], lateness: int | None) -> DataFrame:
    """``columns`` of a stream of transactions, with the columns of ``ADDED`` as ``features.assemble`` takes them.

    Rows without customer are one customer of their own."""
    use_keyed_state(rows.sparkSession)
    marked = rows.select(
        *columns, F.hour("event_ts").alias("event_hour"), X.flag(X.is_round_amount()).cast("bigint").alias("round_amount"),
        F.when(F.col("customer_id").isNull(), "-").otherwise(F.concat(F.lit("+"), "customer_id")).alias("state_key"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    found = marked.groupBy("state_key").transformWithState(CustomerRows(lateness), f"{fields}, {ADDED}", "append", "none")
    wide = "decimal(38,0)"
    return found.withColumns({
        "_total": F.col("total_so_far"), "_squares": F.col("squares_so_far").cast(wide), "q_24h": F.col("q_24h").cast(wide),
        "std_24h": F.lit(None).cast("double"), "_hour": F.col("event_hour"), "_first_us": F.col("first_us"), "_previous_us": F.col("previous_us"),
        "_usual_channel": F.struct(F.col("usual_channel").alias("value")), "_usual_hour": F.struct(F.col("usual_hour").alias("value")),
    })
