"""Keyed state machines for transformWithStateInPandas.

Input rows: ``us`` (event time in microseconds), ``seq`` (bigint tie breaker) and the columns named below; every
decision that can be a Column is computed before the grouping, so the Python part only moves state.

Rows wait in a buffer of their key until the watermark has passed them and are then applied in the order of
(ts, seq). So rows that come out of order within the delay give what they give in order. A row at or before what was
already applied is late: it is not applied, and the key's output carries a row that counts it. Rows repeated under
one (ts, seq) count once. The buffer holds the rows of one delay; the rest of a key's state is a few scalars.

Ready rows are cut into runs of equal inputs with array operations; Python runs once for each run, not for each row.
"""

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

MICRO = 1000


def _stamp(us):
    return pd.Timestamp(int(us) * MICRO)


def _plain(value):
    """As a Python object; missing values are None."""
    if isinstance(value, np.generic):
        value = value.item()
    return None if value is None or value != value else value


def runs(frame: pd.DataFrame, inputs: list[str]):
    """(values, us, seq) of consecutive rows with equal inputs."""
    if not len(frame):
        return
    change = np.zeros(len(frame), bool)
    change[0] = True
    for name in inputs:
        now, before = frame[name], frame[name].shift()
        change |= (now.ne(before) & ~(now.isna() & before.isna())).to_numpy(bool)
    starts = np.flatnonzero(change)
    us, seq = frame["us"].to_numpy(), frame["seq"].to_numpy()
    for low, high in zip(starts, [*starts[1:], len(frame)]):
        yield [_plain(frame[c].iat[low]) for c in inputs], us[low:high], seq[low:high]


class Ordered(StatefulProcessor):
    """A value state moved by runs of ordered rows, and one event-time timer for whatever the key waits for.

    ``keep_s``: a key without rows for so long, and without anything to wait for, is forgotten; None: never.
    """

    state_schema = ""
    inputs: list[str] = []
    input_schema = ""
    outputs: list[str] = []
    initial: tuple = ()
    keep_s: int | None = None

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.state_schema}, floor_us bigint, last_us bigint, timer_ms bigint")
        self.buffer = handle.getListState("buffer", "us bigint, seq bigint" + (f", {self.input_schema}" if self.inputs else ""))

    def handleInputRows(self, key, rows, timerValues):
        yield self.advance(key, pd.concat(list(rows)), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self.advance(key, None, timerValues.getCurrentWatermarkInMs())

    def advance(self, key, new, watermark_ms):
        columns = ["us", "seq", *self.inputs]
        held = self.state.get()
        *state, floor, last, timer = held if held else (*self.initial, None, None, 0)
        passed = watermark_ms * MICRO if watermark_ms > 0 else None
        late, rows = 0, pd.DataFrame(list(self.buffer.get()), columns=columns) if timer else pd.DataFrame(columns=columns)
        if new is not None:
            new = new[columns]
            if floor is not None:
                old = (new["us"] <= floor).to_numpy()
                late, new = int(old.sum()), new[~old]
            rows = pd.concat([rows, new], ignore_index=True) if len(rows) else new
        rows = rows.drop_duplicates(["us", "seq"]).sort_values(["us", "seq"], kind="stable")
        ready = (rows["us"] <= passed).to_numpy(bool) if passed is not None else np.zeros(len(rows), bool)
        rest, out = rows[~ready], []
        for values, us, seq in runs(rows[ready], self.inputs):
            state = self.step(state, values, us, seq, out)
            last = int(us[-1])
        if passed is not None:
            floor, state = passed, self.tick(state, passed, out)
        self.settle(state, floor, last, timer, rest, passed)
        frame = pd.DataFrame([(*key, *row, None) for row in out] + ([(*key, *[None] * len(self.outputs), late)] if late else []), columns=[*self.keys, *self.outputs, "late_rows"])
        return frame.astype({"late_rows": "Int64"})

    def settle(self, state, floor, last, timer, rest, passed):
        """Keeps what is left, or forgets the key, and sets the timer to the next moment that matters."""
        due = self.due(state) if state is not None else None
        waits = [t for t in (due, int(rest["us"].min()) if len(rest) else None) if t]
        end = None if self.keep_s is None or last is None else last + self.keep_s * 1000000
        gone = state is None or (end is not None and passed is not None and end <= passed)
        if timer:
            self.handle.deleteTimer(timer)
        if gone and not waits:
            self.state.clear()
            self.buffer.clear()
            return
        wake = min(waits + ([end] if end else []), default=None)
        timer = -(-wake // 1000) if wake else 0
        if timer:
            self.handle.registerTimer(timer)
        self.state.update((*(self.initial if state is None else state), floor, last, timer))
        if len(rest):
            self.buffer.put([tuple(map(_plain, row)) for row in rest.itertuples(index=False, name=None)])
        else:
            self.buffer.clear()

    def step(self, state, values, us, seq, out):
        """State after a run of rows with equal inputs."""
        raise NotImplementedError

    def tick(self, state, passed, out):
        """State once no row at or before ``passed`` can come any more."""
        return state

    def due(self, state):
        """When ``tick`` has something to do, or None."""
        return None

    def close(self):
        pass


class Changes(Ordered):
    """Emits a row when the text ``value`` differs from the one held."""

    state_schema = "value string"
    inputs, input_schema = ["value"], "value string"
    outputs = ["ts", "seq", "value"]

    def __init__(self, keys, initial=None, keep_s=None):
        self.keys, self.initial, self.keep_s = keys, (initial,), keep_s

    def step(self, state, values, us, seq, out):
        if values[0] != state[0]:
            out.append((_stamp(us[0]), seq[0], values[0]))
        return [values[0]]


class Runs(Ordered):
    """Counts failures since the last success (``ok``); emits at ``limit`` of them and on recovery."""

    state_schema = "run bigint"
    inputs, input_schema = ["ok"], "ok boolean"
    outputs = ["ts", "seq", "outcome", "tries"]
    initial = (0,)

    def __init__(self, keys, limit, recoveries=True, keep_s=None):
        self.keys, self.limit, self.recoveries, self.keep_s = keys, limit, recoveries, keep_s

    def step(self, state, values, us, seq, out):
        run = state[0]
        if values[0]:
            if self.recoveries and 0 < run < self.limit:
                out.append((_stamp(us[0]), seq[0], "complete", run))
            return [0]
        if run < self.limit <= run + len(us):
            at = self.limit - run - 1
            out.append((_stamp(us[at]), seq[at], "fail", self.limit))
        return [run + len(us)]


class Jobs(Ordered):
    """Outcome of an attempt from its status ``code``; later checks of a finished attempt are ignored until it is forgotten."""

    state_schema = "checks bigint, done boolean"
    inputs, input_schema = ["code"], "code int"
    outputs = ["ts", "seq", "outcome", "checks"]
    initial = (0, False)

    def __init__(self, keys, limit, keep_s):
        self.keys, self.limit, self.keep_s = keys, limit, keep_s

    def step(self, state, values, us, seq, out):
        checks, done = state
        at, outcome = len(us), None
        if values[0] == 1:
            at, outcome = 0, "success"
        elif values[0] in (0, 2):
            at, outcome = max(0, self.limit + 1 - checks), "fail"
        if not done and at < len(us):
            out.append((_stamp(us[at]), seq[at], outcome, checks + at + 1))
            done = True
        return [checks + len(us), done]


class Builds(Ordered):
    """Outcome of a rebuild from two counters: all checks, and those at which nothing was being built."""

    state_schema = "checks bigint, idle bigint, done boolean"
    inputs, input_schema = ["code", "standby", "normal"], "code int, standby boolean, normal boolean"
    outputs = ["ts", "seq", "outcome", "checks"]
    initial = (0, 0, False)

    def __init__(self, keys, limit, keep_s):
        self.keys, self.limit, self.keep_s = keys, limit, keep_s

    def step(self, state, values, us, seq, out):
        checks, idle, done = state
        code, standby, normal = values
        at, outcome = len(us), None
        if code == 1:
            at, outcome = 0, "fail"
        elif code == 0 and standby and normal:
            at, outcome = 0, "success"
        elif code == 0 and normal is False:
            at, outcome = max(0, self.limit + 1 - idle), "success_not_normal"
        if not done and at < len(us):
            out.append((_stamp(us[at]), seq[at], outcome, checks + at + 1))
            done = True
        # a status that is not known is no idle check, as in the batch form
        return [checks + len(us), idle + (len(us) if code is not None and code != 2 else 0), done]


class Stuck(Ordered):
    """Emits when the text ``value`` stays in a waiting state (``waiting``) longer than the deadline."""

    state_schema = "value string, since_us bigint, due_us bigint"
    inputs, input_schema = ["value", "waiting"], "value string, waiting boolean"
    outputs = ["value", "valid_from", "timeout_at"]
    initial = (None, 0, 0)

    def __init__(self, keys, deadline_s):
        self.keys, self.wait_us = keys, deadline_s * 1000000

    def due(self, state):
        return state[2] or None

    def tick(self, state, passed, out):
        value, since, due = state
        if due and due <= passed:
            out.append((value, _stamp(since), _stamp(due)))
            due = 0
        return [value, since, due]

    def step(self, state, values, us, seq, out):
        # nothing came before this row, but a row at the deadline itself is in time
        state = self.tick(state, int(us[0]) - 1, out)
        if values[0] == state[0]:
            return state
        return [values[0], int(us[0]), int(us[0]) + self.wait_us if values[1] else 0]


class Availability(Ordered):
    """Availability mode from the ``signal``: reached is off at once, lone is on, short is on after the timeout."""

    state_schema = "signal string, due_us bigint, mode boolean"
    inputs, input_schema = ["signal"], "signal string"
    outputs = ["switched_at", "switch"]
    initial = (None, 0, False)

    def __init__(self, keys, timeout_s):
        self.keys, self.wait_us = keys, timeout_s * 1000000

    def due(self, state):
        return state[1] or None

    def turn(self, mode, wanted, us, out):
        if mode != wanted:
            out.append((_stamp(us), "ON" if wanted else "OFF"))
        return wanted

    def tick(self, state, passed, out):
        signal, due, mode = state
        if due and due <= passed:
            mode, due = self.turn(mode, True, due, out), 0
        return [signal, due, mode]

    def step(self, state, values, us, seq, out):
        signal, due, mode = self.tick(state, int(us[0]) - 1, out)
        if values[0] == signal:
            return [signal, due, mode]
        signal, due = values[0], 0
        if signal == "reached":
            mode = self.turn(mode, False, us[0], out)
        elif signal == "lone":
            mode = self.turn(mode, True, us[0], out)
        elif signal == "short":
            due = int(us[0]) + self.wait_us
        return [signal, due, mode]


class Multiline(Ordered):
    """Joins lines (``text``) that start no record (``is_start``) to the record before.

    The record is emitted whole with the next start, or after silence.
    """

    state_schema = "record bigint, first_seq bigint, lines bigint, text string, due_us bigint"
    inputs, input_schema = ["text", "is_start"], "text string, is_start boolean"
    outputs = ["record", "first_seq", "lines", "text"]
    initial = (0, 0, 0, "", 0)

    def __init__(self, keys, silence_s):
        self.keys, self.wait_us = keys, silence_s * 1000000

    def due(self, state):
        return state[4] or None

    def tick(self, state, passed, out):
        record, first, lines, text, due = state
        if due and due <= passed:
            out.append((record, first, lines, text))
            return [record, 0, 0, "", 0]
        return state

    def step(self, state, values, us, seq, out):
        text, starts = values
        for at, number in zip(us.tolist(), seq.tolist()):
            state = self.tick(state, at - 1, out)
            record, first, lines, held, _ = state
            if lines and starts:
                out.append((record, first, lines, held))
                lines = 0
            if lines == 0:
                state = [record + (1 if starts else 0), number, 1, text, at + self.wait_us]
            else:
                state = [record, first, lines + 1, f"{held}\n{text}", at + self.wait_us]
        return state


class Polls(Ordered):
    """Runs of periods without a poll: reported once as open when the first one has passed, and closed by the next poll."""

    state_schema = "last_slot bigint, told boolean"
    outputs = ["after_slot", "missed", "still_open"]
    initial = (None, False)

    def __init__(self, keys, period_s):
        self.keys, self.period = keys, period_s * 1000000

    def due(self, state):
        return None if state[0] is None or state[1] else (state[0] + 2) * self.period

    def tick(self, state, passed, out):
        due = self.due(state)
        if due is None or due > passed:
            return state
        out.append((state[0], passed // self.period - state[0] - 1, True))
        return [state[0], True]

    def step(self, state, values, us, seq, out):
        slots = np.unique(us // self.period).tolist()
        for before, slot in zip([state[0], *slots], slots):
            if before is not None and slot - before > 1:
                out.append((before, slot - before - 1, False))
        return [slots[-1], bool(state[1] and slots[-1] == state[0])]


class Retention(Ordered):
    """Two deadlines for each file, counted from its last change: compress, then drop, each reported once."""

    state_schema = "changed_us bigint, compressed boolean"
    outputs = ["action", "due_at"]
    initial = (None, False)

    def __init__(self, keys, compress_us, drop_us):
        self.keys, self.compress_us, self.drop_us = keys, compress_us, drop_us

    def due(self, state):
        return None if state[0] is None else state[0] + (self.drop_us if state[1] else self.compress_us)

    def tick(self, state, passed, out):
        due = self.due(state)
        if due is None or due > passed:
            return state
        if not state[1]:
            out.append(("compress", _stamp(due)))
            return self.tick([state[0], True], passed, out)
        out.append(("drop", _stamp(due)))
        return None

    def step(self, state, values, us, seq, out):
        for at in us.tolist():
            state = self.tick(list(state), at - 1, out) or list(self.initial)
            state = [at, False]
        return state
